"""Extraction rules, upserts and the bookmark stream on small inputs."""

import datetime

from pyspark.sql import functions as F

from eventloom.functions import extract as ex
from eventloom.operators import history, pages
from eventloom.streaming import bookmarks


def values(spark, f, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_prices_and_times(spark):
    texts = ["Eintritt: 11€-18€ (unter 18 Jahren Eintritt frei)", "Eintritt ist frei", "alles kostenlos", "Eintritt: nach  Wahl. Mehr", "nichts", "", None]
    assert values(spark, ex.price, texts) == ["11€-18€", "Eintritt ist frei", "kostenlos", "nach Wahl", None, None, None]
    assert values(spark, ex.time_text, ["19.30 bis 22.00", "21.08.2026 | 08:00", "21.08.2026", "", None]) == ["19.30 bis 22.00", "08:00", None, None, None]
    assert values(spark, ex.start_time, ["Einlass: 19 Uhr, Beginn: 20:30 Uhr", "Einlass 18 Uhr", "Beginn 25 Uhr", None]) == ["20:30", "18:00", None, None]
    assert values(spark, ex.clock, ["11:00 PM", "12:15 am", "19.30", None]) == ["23:00", "00:15", "19:30", None]


def test_images_moves_and_repair(spark):
    got = values(spark, ex.image_variant, ["a 400w, b 800w, c 1200w", "a 300w, b 400w", "a, b", "", None])
    assert got == ["b", "b", "b", None, None]
    assert values(spark, ex.moved_to, ["Band (verlegt ins Haus)", "Band [hochverlegt in die Halle ] live", "Band", None]) == ["Haus", "Halle", None, None]
    assert values(spark, ex.unmoved_title, ["Band [hochverlegt in die Halle] live", "Band  x", None]) == ["Band live", "Band  x", None]
    assert values(spark, ex.repaired, ["grÃ¶Ã\x9fer", "größer", "日本", None]) == ["größer", "größer", "日本", None]
    assert values(spark, ex.feed_category, ["Highlights, Konzerte", "Highlights", "Lesung,Highlights", None]) == ["Konzert", None, "Lesung", None]


def test_year_is_inferred(spark):
    df = spark.createDataFrame([(1, 5, datetime.date(2026, 12, 20)), (12, 15, datetime.date(2026, 12, 20)), (2, 30, datetime.date(2026, 1, 1))], "m int, d int, t date")
    got = [r[0] for r in df.select(ex.next_day(F.col("m"), F.col("d"), F.col("t"))).collect()]
    assert got == [datetime.date(2027, 1, 5), datetime.date(2026, 12, 15), None]


def test_pages_without_html(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, '<meta property="og:title" content="T"><a href="https://x.de">X</a>')], "page_id long, html string")
    assert [tuple(r)[:2] for r in pages.metadata(df).orderBy("page_id").collect()] == [(1, None), (2, None), (3, "T")]
    assert {r["page_id"]: r["status"] for r in pages.outbound(df, "own.de").collect()} == {1: "not_found", 2: "not_found", 3: "not_found"}


def test_upsert_weights_and_marks(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, f string, s string")
    new = spark.createDataFrame([(2, None, "z"), (3, "c", "w")], "k int, f string, s string")
    assert sorted(tuple(r) for r in history.upsert(old, new, "k", ["f"], ["s"]).collect()) == [(1, "a", "x"), (2, "b", "y"), (3, "c", "w")]
    steps = [2, -5, 1, 3, -1]
    held = 0
    for x in steps:
        held = max(held + x, 0)
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(steps)], "key string, t int, x long")
    assert history.weights(df, "key", "x", ["t"]).collect()[0]["weight"] == held
    item = "g string, items array<struct<k:string,d:string>>"
    day = "2026-09-26"
    rows = [("a", [(f"{day}|x", day), (f"{day}|x", day), ("2020-01-01|y", "2020-01-01")]), ("b", [("z|x", day)]), ("c", [])]
    got = {r["g"]: [tuple(x) for x in r["items"]] for r in history.valid_marks(spark.createDataFrame(rows, item), day).collect()}
    assert got == {"a": [(f"{day}|x", day)], "c": []}


def test_bookmark_stream_keeps_the_newest_message(spark, tmp_path):
    schema = "g string, items array<string>, t long, id long"
    for i, rows in enumerate([[("a", ["1"], 1, 1), ("b", ["2"], 1, 2)], [("a", ["3", "4"], 2, 3)], [("b", [], 1, 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    query = bookmarks.sync(stream, str(tmp_path / "state"), str(tmp_path / "cp"), availableNow=True)
    query.awaitTermination(120)
    got = {r["g"]: r["items"] for r in bookmarks.read_state(spark, str(tmp_path / "state"), query).collect()}
    assert got == {"a": ["3", "4"], "b": ["2"]}
