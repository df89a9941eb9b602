"""Line dedup: near copies send their token sets once a company, and only places of lines that may go are shuffled."""

from eventloom.llm import line_dedup


def _p(token, place, size=20):
    return token << 32 | place << 16 | size


def test_postings_of_the_same_lines_are_one(spark):
    rows = [(1, [_p(5, 0), _p(6, 1), _p(7, 2)]), (2, [_p(5, 1), _p(6, 2), _p(8, 3)]), (3, [_p(7, 0), _p(9, 4)]), (4, [_p(8, 6), _p(9, 5)])]
    got = line_dedup.companies(spark.createDataFrame(rows, "h long, ps array<long>")).collect()
    company = {}
    for r in got:
        company.setdefault(r.company, {})[r.h] = r.p
    # Tokens 5 and 6 hold lines 1 and 2 both; the first place in each counts.
    assert sorted(map(sorted, (c.items() for c in company.values()))) == sorted(
        [[(1, _p(0, 0)), (2, _p(0, 1))], [(1, _p(0, 2)), (3, _p(0, 0))], [(2, _p(0, 3)), (4, _p(0, 6))], [(3, _p(0, 4)), (4, _p(0, 5))]]
    )


def test_lines_that_stay_are_not_joined(spark):
    same = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(i, f"{same} x{i}\nalone {i} {i * 7}\ntwice\n") for i in range(1, 5)], "doc_id long, text string")
    gone = line_dedup.removed_lines(docs).orderBy("doc_id").collect()
    assert [r.removed for r in gone] == ["", "0,2", "0,2", "0,2"]
    found, hit = line_dedup.matched_lines(docs)
    assert {r.n: r["count"] for r in found.groupBy("n").count().collect()} == {1: 8, 4: 1}
    assert hit.columns == ["h", "g"] and hit.count() == 3
