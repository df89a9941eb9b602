"""Dimensions, ranks, details and names, and the grouping of one large component."""

import json

import pyarrow as pa
from pyspark.sql import functions as F

from eventloom.functions import text as tx
from eventloom.operators import dedup, dimensions, merge, registry, venues
from eventloom.plans import build
from eventloom.sources import tables


def grouped(rows, size=1000):
    names = ("component", "turn", "a", "b", "source")
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows[i : i + size]], kinds[k]) for k in range(5)], names) for i in range(0, len(rows), size)]
    return {i: c for b in dedup._grouped(iter(batches)) for i, c in zip(*(b.column(k).to_pylist() for k in (0, 1)))}


def test_grouping_keeps_sources_apart_and_forces_the_rest():
    node = lambda comp, i, s: (comp, dedup.NODE, i, None, s)
    edge = lambda comp, turn, a, b: (comp, turn, a, b, None)
    rows = [node(1, 1, "x"), node(1, 2, "y"), node(1, 3, "x"), node(1, 4, "z"), node(1, 5, "z")]
    pairs = [edge(1, dedup.PAIR, 1, 2), edge(1, dedup.PAIR, 2, 3), edge(1, dedup.PAIR, 3, 4)]
    assert grouped(rows + pairs) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert grouped(rows + pairs + [edge(1, dedup.SELF, 1, 3)]) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5}
    # A line-up takes the listing that is alone, not the one that has company.
    assert grouped(rows + pairs + [edge(1, dedup.LINE, 1, 5), edge(1, dedup.LINE, 1, 4)]) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 1}
    assert grouped([]) == {}


def test_components_that_cross_batches_stay_whole():
    rows = []
    for k in range(50):
        rows += [(k, dedup.NODE, 10 * k + i, None, f"s{i}") for i in range(5)] + [(k, dedup.PAIR, 10 * k, 10 * k + i, None) for i in range(1, 5)]
    want = {10 * k + i: 10 * k for k in range(50) for i in range(5)}
    assert all(grouped(rows, n) == want for n in (1, 7, 450))


def test_one_component_of_many_listings():
    n = 60_000
    rows = [(7, dedup.NODE, i, None, f"s{i}") for i in range(n)] + [(7, dedup.PAIR, i, i + 1, None) for i in range(n - 1)]
    assert set(grouped(rows, 10_000).values()) == {0}


def test_unknown_sources_rank_last_and_shared_ranks_show(spark):
    known = spark.createDataFrame([("b", 5), ("a", 1), ("c", 5)], "source string, rank int")
    rows = spark.createDataFrame([(1, "a"), (2, "zz"), (3, None), (4, "c")], "id int, source string")
    got = {r["id"]: r["pos"] for r in tables.ranked_by(rows, tables.source_registry(known)).collect()}
    assert got == {1: 0, 2: 3, 3: 3, 4: 2}
    assert [(r["rank"], r["sources"]) for r in tables.shared_ranks(known).collect()] == [(5, ["b", "c"])]
    none = known.where("false")
    assert {r["pos"] for r in tables.ranked_by(rows, tables.source_registry(none)).collect()} == {0}


def test_names_and_addresses_for_a_search(spark):
    names = ["Haus (Saal 2) am See", "Club - Träger e.V. - x", "Bühne im Kraftwerk Mitte", "Ostpol Dresden ", "Dresdenfrei", "", None, "Im Eck"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string")
    got = [r["n"] for r in df.select("i", tx.place_search_name(F.col("name")).alias("n")).orderBy("i").collect()]
    assert got == ["Haus am See", "Club", "Bühne", "Ostpol", "Dresdenfrei", "", None, "Im Eck"]
    rows = [("Weg 1", "01099", "Dresden", "x"), ("Weg 1", None, "", "x"), ("", "01099", "Dresden", "Markt"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "s string, p string, c string, g string")
    got = [r["a"] for r in df.select(tx.postal_address(F.col("s"), F.col("p"), F.col("c"), F.col("g")).alias("a")).collect()]
    assert got == ["Weg 1, 01099 Dresden", "Weg 1", "Markt", None]


def test_details_fill_blanks_and_replace_short_lines(spark):
    long = "x" * 80
    cols = "id int, url string, description string, price_text string, image_url string"
    rows = spark.createDataFrame([(1, "u", " ", None, "own"), (2, "v", "kurz", "5", ""), (3, "v", long + "y", "", None), (4, None, None, None, None), (5, "none", "kurz", None, None)], cols)
    pages = spark.createDataFrame([("u", "neu", "", "page"), ("v", long, "9", None)], "url string, description string, price_text string, image_url string")
    got = {r["id"]: tuple(r)[2:] for r in merge.with_details(rows, pages).collect()}
    assert got == {1: ("neu", None, "own"), 2: (long, "5", ""), 3: (long + "y", "9", None), 4: (None, None, None), 5: ("kurz", None, None)}


def test_places_suspects_and_dimensions(spark):
    cols = "slug string, name string, lat double, lon double, region string, kind string"
    v = spark.createDataFrame([("a", 'A "x"', 51.0, 13.7, None, None), ("b", "B", None, 13.7, "dresden", "club"), ("c", "C", 51.0, 13.0, "dresden", "treffpunkt")], cols)
    got = {r["slug"]: json.loads(r["json"]) for r in registry.geo_table(v).collect()}
    assert got == {"a": {"n": 'A "x"', "lat": 51.0, "lon": 13.7, "r": None, "k": None}}
    pairs = spark.createDataFrame([("a", "d", 2), ("a", "b", 2), ("x", "y", 9), ("a", "c", 2)], "a string, b string, n int")
    assert [tuple(r) for r in venues.suspects(pairs, 3).collect()] == [("x", "y", 9), ("a", "b", 2), ("a", "c", 2)]
    assert [r["slug"] for r in dimensions.categories(spark).orderBy("pos").collect()][-2:] == ["fuehrungen", "sonstiges"]
    used = spark.createDataFrame([("techno",), ("zz",), ("kirche",), ("aa",), ("zz",)], "slug string")
    assert [(r["slug"], r["label"]) for r in dimensions.tags(spark, used).collect()] == [("kirche", "Kirche"), ("techno", "Techno"), ("aa", None), ("zz", None)]
    assert {r["slug"]: r["n"] for r in dimensions.counted(dimensions.tags(spark, used), used, "slug").collect()}["zz"] == 2


def test_build_fills_listings_from_details(spark):
    rows = spark.sql("select 1L as id, 'q' as source, 0 as rank, date '2024-01-05' as date, '20:00' as time, 'Großes Konzert' as title, 'Ostpol' as venue, 'Konzert' as raw_category, 'https://x.de/a/1' as url, 'kurz' as description")
    places = spark.createDataFrame([("ostpol", "Ostpol", [], None, 1)], "slug string, name string, aliases array<string>, region string, pos int")
    pages = spark.createDataFrame([("https://x.de/a/1", "lang " * 20, "9 €", "i.jpg")], "url string, description string, price_text string, image_url string")
    got = [(r["description"].strip(), r["price_text"], r["image_url"], r["ort"]) for r in build.build(rows, places, details=pages).collect()]
    assert got == [(("lang " * 20).strip(), "9 €", "i.jpg", "ostpol")]
