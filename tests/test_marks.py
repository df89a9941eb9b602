"""The bookmark stream with keyed state: newest message, limit by address, restart."""

from eventloom.streaming import marks

T = 4_102_444_800_000  # 2100-01-01
DAY = "2100-01-05"


def _put(spark, path, rows):
    spark.createDataFrame(rows, marks.MESSAGE).coalesce(1).write.mode("append").parquet(path)


def _run(spark, src, tmp_path):
    stream = spark.readStream.schema(marks.MESSAGE).option("maxFilesPerTrigger", 1).parquet(src)
    query = marks.sync(stream, str(tmp_path / "out"), str(tmp_path / "cp"), most=2, availableNow=True)
    assert query.awaitTermination(180)
    assert query.exception() is None
    return {(r["g"], r["k"]) for r in marks.held(spark, str(tmp_path / "cp"), "2100-01-01").collect()}


def test_stream_with_restart(spark, tmp_path):
    src = str(tmp_path / "in")
    item = lambda k, d=DAY: (k, d)
    _put(spark, src, [("p", "a", [item("1"), item("old", "1999-01-01")], T, 1), ("p", "b", [item("2")], T, 2), ("p", "c", [item("3")], T, 3), ("q", "d", [item("4")], T, 4)])
    # The third device of an address is turned away.
    assert _run(spark, src, tmp_path) == {("a", "1"), ("b", "2"), ("d", "4")}
    # A new start goes on with the state: older messages lose, an empty list clears, a known device may go on.
    _put(spark, src, [("p", "a", [item("9"), item("10")], T + 5, 5), ("p", "b", [item("8")], T - 5, 6), ("q", "d", [], T + 1, 7), ("p", "e", [item("11")], T + 9, 8)])
    assert _run(spark, src, tmp_path) == {("a", "9"), ("a", "10"), ("b", "2")}
    assert _run(spark, src, tmp_path) == {("a", "9"), ("a", "10"), ("b", "2")}
    got = sorted((r["g"], r["id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 1), ("a", 5), ("b", 2), ("d", 4), ("d", 7)]
