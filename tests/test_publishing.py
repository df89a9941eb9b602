"""Documents, day files, paired tables, orphan guards and reclassification on small stores."""

import json
import os

import pytest
from pyspark.sql import functions as F

from eventloom.functions import text as tx
from eventloom.operators import publishing as pub
from eventloom.plans import catalog


def test_image_links(spark):
    rows = {
        "https://a.de/x.jpg": "https://a.de/x.jpg",
        "javascript:x": None,
        "https://kulturkalender-dresden.de/img/fallback/1.png": None,
        "https://i.ytimg.com/vi/k/maxresdefault.jpg": "https://i.ytimg.com/vi/k/hqdefault.jpg",
        "https://i.ytimg.com/vi/k/hqdefault.jpg": "https://i.ytimg.com/vi/k/hqdefault.jpg",
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in rows], "u string")
    assert {r[0]: r[1] for r in df.select("u", tx.image_url(F.col("u"))).collect()} == rows


def test_documents_hold_no_empty_keys(spark):
    names = "uid date time title ort ort_roh category url image_url description price_text sources region laufend".split()
    events = spark.createDataFrame(
        [("1", "2026-01-02", None, "Jazz", None, "Irgendwo", "musik", "ftp://x", "", None, "", "a,b", None, False), ("2", "2026-01-02", "20:00", 'A "b"', "paula", "Paula", "demo", "http://x", None, "t", "5", "c", "umland", True)],
        ", ".join(f"{n} {'boolean' if n == 'laufend' else 'string'}" for n in names),
    )
    venue = "slug string, name string, heart boolean, homepage string, address string, kind string, cover string, lat double, lon double"
    venues = spark.createDataFrame(
        [("paula", "Paula", False, None, "", "club", None, 51.123456789, 0.0), ("tonne", "Tonne", True, "https://t", "Weg 1", None, None, None, None), ("fern", "Fern", False, None, None, None, None, None, None), ("bunt", "Bunt", False, None, None, None, None, None, None)],
        venue,
    )
    flavours = spark.createDataFrame([("bunt", "jazz"), ("nirgends", "rock")], "slug string, flavour string")
    got = {r["uid"]: json.loads(r["json"]) for r in pub.event_documents(events, venues, flavours).collect()}
    assert got["1"] == {"u": "1", "d": "2026-01-02", "ti": "Jazz", "or": "Irgendwo", "k": "musik", "q": ["a", "b"], "rt": ["jazz", "musik"]}
    assert got["2"] == {"u": "2", "d": "2026-01-02", "t": "20:00", "ti": 'A "b"', "o": "paula", "or": "Paula", "k": "demo", "url": "http://x", "b": "t", "p": "5", "q": ["c"], "r": "umland", "rt": ["demo"], "l": 1}
    places = {r["slug"]: json.loads(r["json"]) for r in pub.venue_documents(venues, events, flavours).collect()}
    assert places == {"paula": {"n": "Paula", "art": "club", "lat": 51.12346}, "tonne": {"n": "Tonne", "h": 1, "w": "https://t", "a": "Weg 1"}, "bunt": {"n": "Bunt"}}


def _days(spark, *rows):
    docs = spark.createDataFrame([(d, None, t, t, json.dumps(t)) for d, t in rows], "date string, time string, title string, uid string, json string")
    return pub.day_documents(docs)


def test_only_changed_days_are_written_and_others_keep_their_stamp(spark, tmp_path):
    path = str(tmp_path / "days")
    rows = [("2026-01-01", "a"), ("2026-01-01", "b"), ("2026-01-02", "c")]
    assert pub.write_days(_days(spark, *rows), path, "t1") == 2
    files = sorted(os.path.join(p, f) for p, _, fs in os.walk(path) for f in fs)
    assert pub.write_days(_days(spark, *reversed(rows)), path, "t2") == 0
    assert files == sorted(os.path.join(p, f) for p, _, fs in os.walk(path) for f in fs)
    assert pub.write_days(_days(spark, *rows, ("2026-01-02", "d"), ("2026-01-03", "e")), path, "t3") == 2
    got = {str(r["date"]): (r["n"], r["generated_at"], r["json"]) for r in spark.read.parquet(path).collect()}
    assert got == {"2026-01-01": (2, "t1", '["a","b"]'), "2026-01-02": (2, "t3", '["c","d"]'), "2026-01-03": (1, "t3", '["e"]')}


def test_a_failed_second_write_leaves_the_pair_before(spark, tmp_path):
    path = str(tmp_path / "store")
    first = spark.createDataFrame([("a", "A", [1, 2, 2])], "uid string, title string, listing_ids array<long>")
    pub.replace_events(first, path)
    broken = first.withColumn("uid", F.lit("b")).withColumn("listing_ids", F.array(F.raise_error(F.lit("no")).cast("long")))
    with pytest.raises(Exception, match="no"):
        pub.replace_events(broken, path)
    events, bridge = pub.stored_events(spark, path)
    assert [tuple(r) for r in events.collect()] == [("a", "A")]
    assert sorted(tuple(r) for r in bridge.collect()) == [("a", 1), ("a", 2)]
    pub.replace_events(first.withColumn("uid", F.lit("c")), path)
    assert [r["uid"] for r in pub.stored_events(spark, path)[0].collect()] == ["c"]


def test_orphans_are_reported_with_what_holds_them_back(spark):
    seen = spark.createDataFrame([(u, "bad" if u in "xyz" else "ok") for u in "abcdefgxyz"], "uid string, source string")
    events = seen.select("uid", F.upper("uid").alias("title"), F.lit("2026-01-01").alias("date"))
    orphans = spark.createDataFrame([(u, "ok") for u in "abc"] + [(u, "bad") for u in "xy"], "uid string, signature string")
    hearts = spark.createDataFrame([("a", "h1", []), ("q", "h2", ["b", "a"])], "event_uid string, run_key string, member_uids array<string>")
    bookings = spark.createDataFrame([("d", "c"), ("e", "c"), ("c", "f")], "duplicate string, canonical string")
    report = pub.orphan_report(orphans, events, hearts, bookings, seen)
    assert {r["uid"]: (r["held_by"], r["unlinked"], r["booked"]) for r in report.collect()} == {
        "a": ("herz", 0, False), "b": ("herz", 0, False), "c": (None, 2, True), "x": ("quelle", 0, False), "y": ("quelle", 0, False),
    }
    assert [tuple(r) for r in pub.orphan_summary(report).collect()] == [("ok", 1, "C")]
    assert {tuple(r) for r in pub.hearts_of(orphans, hearts).collect()} == {("a", "h1"), ("b", "h2")}


def test_a_second_reclassification_changes_nothing(spark):
    events = spark.createDataFrame(
        [(1, "Orgelkonzert", "Frauenkirche", None, "x", None, []), (2, "Techno Nacht", None, "Party", "musik", "alt", ["techno"])],
        "uid long, title string, venue string, raw_category string, category string, venue_hint string, tags array<string>",
    )
    venues = spark.createDataFrame([("f", "Frauenkirche", "kirche")], "slug string, name string, kind string")
    fresh, changes = pub.reclassified(events, venues)
    got = {(r["uid"], r["field"]): (r["old"], r["new"]) for r in changes.collect()}
    assert got[1, "tags"] == ("", "kirche,klassik") or got[1, "tags"] == ("", "kirche")
    assert got[1, "venue_hint"] == (None, "kirche") and got[2, "venue_hint"] == ("alt", None)
    assert pub.reclassified(fresh, venues)[1].count() == 0


def test_a_query_name_is_used_once():
    with pytest.raises(ValueError, match="two queries"):
        catalog.query("scl1_slugify")(lambda spark, d: None)
