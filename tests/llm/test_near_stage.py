"""The near-copy stage links by SimHash as well as by shared shingles."""

import corpus_pipeline


def test_equal_fingerprints_of_unlike_sets_are_linked(spark):
    rows = [(1, "a b c " * 300), (2, "a b c " * 300 + "x y z"), (3, "other words stand here now"), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {1, 3, 4}
