"""Token sets of lines: right on odd white space, and built by compiled operators."""

from pyspark.sql import functions as F

from eventloom.llm import line_dedup


def test_no_lambda_in_an_explode(spark):
    docs = spark.createDataFrame([(1, "a b c d e\na b c d e f"), (2, "x")], "doc_id long, text string")
    plan = line_dedup.removed_lines(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan
    assert not [x for x in plan.splitlines() if "Generate" in x and "lambdafunction" in x]


def test_token_sets(spark):
    lines = ["b  a\tB a ", "Ä ä x\r", "a", "one\x0btwo\x0cone", "  "]
    df = spark.createDataFrame(list(enumerate(lines)), "i long, line string")
    rank, _ = line_dedup.rarity(df.select(F.col("line").alias("text")))
    got = {r.i: r.tokens for r in line_dedup.with_tokens(df, rank).collect()}
    assert [len(got[i]) for i in range(5)] == [2, 2, 1, 2, 0]
    assert got[2][0] in got[0] and all(t == sorted(t) for t in got.values())
    docs = spark.createDataFrame([(7, "\n".join(lines))], "doc_id long, text string")
    assert {r.line_no for r in line_dedup.lines_of(docs).collect()} == {0, 1, 2, 3}
