"""Page links, places, feeds, registry upkeep and marks on small inputs."""

from pyspark.sql import functions as F

from eventloom.operators import feeds, hearts, history, pages, runs, venues


def test_link_kinds(spark):
    cases = [
        ("https://www.haus.de/start", "haus.de/", "homepage"), ("https://haus.de", "Website", "homepage"), ("https://haus.de", "Programm", "other"),
        ("https://www.eventim.de/x", "Website", "other"), ("https://m.facebook.com/h", "Website", "social"), ("https://haus.de/?u=facebook.com", None, "other"),
        ("httpx", "web", "homepage"), ("https://haus.de", "haus.de mehr", "other"),
    ]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(cases)], "i int, href string, label string, want string")
    got = df.withColumn("got", pages.link_kind(F.col("href"), F.col("label"))).where("not (got <=> want)").collect()
    assert got == []


def test_outbound_counts_an_address_once_by_its_first_label(spark):
    own = '<a href="https://portal.de/x">Website</a><a href="/here">Website</a><a href="https://facebook.com/portal">f</a>'
    rows = [
        (1, own + '<a href="https://a.de">Tickets</a><a href="https://a.de">Website</a>'),
        (2, own + "<a href='https://a.de'>a.de</a><a href=\"https://b.de\">Web</a>"),
        (3, own + '<a href="https://instagram.com/h"></a>'), (4, own), (5, None), (6, ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, html string")
    got = {r["page_id"]: (r["homepage"], r["status"]) for r in pages.outbound(df, "portal.de", ("facebook.com/portal",)).collect()}
    none = (None, "not_found")
    assert got == {1: none, 2: ("https://a.de", "ok_mehrdeutig"), 3: (None, "nur_social"), 4: none, 5: none, 6: none}


def test_address_blocks_and_places(spark):
    block = '<div class="box-location-description">Haus<br>tel: 12<br/>01099  Dresden <b>N</b></div>'
    rows = [(1, '<a href="/x">Haus</a><address>Haus <a href="/o/1">A</a> <a href="/o/2">B</a></address>' + block), (2, '<address>Haus <a href="https://y.de">A B</a></address>'), (3, None)]
    df = spark.createDataFrame(rows, "page_id long, html string")
    got = {r["label"]: r["href"] for r in pages.alias_targets(df, "https://p.de").collect()}
    assert got == {"Haus A B": "https://p.de/o/1"}
    place = {r["page_id"]: (r["address"], r["street"], r["city"]) for r in pages.locations(df).collect()}
    assert place == {1: ("01099 Dresden N", None, "Dresden N"), 2: (None, None, None), 3: (None, None, None)}


def test_galleries_at_any_depth(spark):
    texts = ['{"a":[{"b":{"x_galleryData":{"items":[{"metaData":{"title":" T  1"}},{"metaData":{}}]}}},{"y_galleryData":{"items":[{"metaData":{"title":"T2"}}]}}]}', "no json", "", None, "[1]"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, value string")
    assert [(r["i"], r["title"]) for r in feeds.gallery_items(df).orderBy("i", "item").collect()] == [(0, "T 1"), (0, "T2")]


def test_assemblies_without_a_valid_day_or_place_are_left_out(spark):
    texts = ['{"Versammlungen":[{"Ort":"P","Thema":"T","Datum":"2024-01-05","Zeit":"ab 8:05"},{"Thema":"T","Datum":"2024-01-05"},{"Ort":"P","Thema":"T","Datum":"x"},{"Ort":"P","Thema":"T","Datum":"2024-01-05","Status":"Abgemeldet"}]}', "{}", "x", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, value string")
    assert [(r["i"], r["time"], r["venue"]) for r in feeds.assemblies(df, "2024-01-01", "2024-01-31").collect()] == [(0, "08:05", "P")]


def test_merged_venues_keep_what_says_more(spark):
    schema = "slug string, name string, aliases array<string>, art string, homepage string"
    reg = spark.createDataFrame([("a", "A", ["A1"], "sonstiges", ""), ("b", "B", None, "sonstiges", "h"), ("c", "C", ["A1", ""], "club", "i"), ("d", "D", None, None, None)], schema)
    mapping = spark.createDataFrame([("b", "a", 1), ("c", "a", 2)], "old string, target string, ord int")
    got = {r["slug"]: (r["name"], r["art"], r["homepage"], r["aliases"]) for r in venues.merge_into(reg, mapping, ("art", "homepage")).collect()}
    assert got == {"a": ("A", "club", "h", ["A1", "B", "C"]), "d": ("D", None, None, [])}


def test_chains_of_duplicates_and_circles(spark):
    chain = [(f"u{i}", f"u{i + 1}") for i in range(20)]
    events = [(u, to) for u, to in chain if u not in ("u3", "u7")] + [("u20", None), ("x", "y"), ("y", "x"), ("z", "gone")]
    df = spark.createDataFrame(events, "uid string, duplicate_of string")
    bookings = spark.createDataFrame([("u3", "u4"), ("u7", "u8")], "duplicate string, canonical string")
    got = {r["uid"]: r["winner"] for r in hearts.final_winners(df, bookings).collect()}
    assert got == {f"u{i}": "u20" for i in range(21)}
    assert hearts.final_winners(df.limit(0), bookings.limit(0)).count() == 0


def test_hearts_find_their_event_again(spark):
    ev = "uid string, run_key string, date string, time string, duplicate_of string, identity_key string"
    events = spark.createDataFrame(
        [("a", "r1", "d", "20:00", None, "i1"), ("b", "r1", "d", "19:00", None, "i2"), ("c", "r2", "d", None, "b", "i3"), ("e", "r9", "d", None, None, "i5")], ev
    )
    marks = [("ok", "a", "r1", None, "i1", "d"), ("run", "c", "r1", None, "i3", "d"), ("chain", "c", "r2", None, "i3", "d"), ("member", "q", "r7", ["c"], "-", "d"), ("same", "q", "r7", [], "i5", "d"), ("lost", "q", "r7", None, "i5", "other")]
    df = spark.createDataFrame(marks, "heart string, event_uid string, run_key string, member_uids array<string>, identity_key string, run_date string")
    none = spark.createDataFrame([], "duplicate string, canonical string")
    got = {r["heart"]: tuple(r)[1:] for r in hearts.relinked_hearts(df, events, none).collect()}
    new = "neu_verknuepft"
    assert got == {
        "ok": ("a", "r1", 2, "ok"), "run": ("b", "r1", 2, new), "chain": ("b", "r1", 2, new),
        "member": ("b", "r1", 2, new), "same": ("e", "r9", 1, new), "lost": ("q", "r7", 0, "verwaist"),
    }
    on = spark.createDataFrame([("r1", "a", True), ("r1", "a", True), ("r3", "k", False), ("r4", "l", True)], "run_key string, event_uid string, on boolean")
    before = spark.createDataFrame([("r1", "first"), ("r3", "k")], "run_key string, event_uid string")
    assert sorted(tuple(r) for r in hearts.set_hearts(before, on).collect()) == [("r1", "first"), ("r4", "l")]


def test_relinking_twice_changes_nothing_and_the_ledger_grows(spark, tmp_path):
    events = spark.createDataFrame([("a", "q1"), ("b", "q2")], "uid string, source string")
    found = spark.createDataFrame([("a", "b", 0.9, "t")], "duplicate string, canonical string, score double, reason string")
    old = spark.createDataFrame([("a", "d0"), ("stale", "d0")], "duplicate string, first_seen string")
    once = history.relinked(old, found, events, "d1")
    assert [tuple(r) for r in once.collect()] == [("a", "b", "q1", "q2", 0.9, "t", "d0", "d1")]
    assert history.relinked(once, found, events, "d1").collect() == once.collect()
    linked = history.unlinked(events.withColumn("duplicate_of", F.lit("old")), once)
    assert {r["uid"]: r["duplicate_of"] for r in linked.collect()} == {"a": "b", "b": None}
    for _ in range(2):
        runs.record_runs(events, str(tmp_path / "ledger"))
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 4
