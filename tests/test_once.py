"""Slugs are worked out once a row, wherever the optimizer puts them, and stay what they were."""

import unicodedata

from pyspark.sql import functions as F

from eventloom.functions import classify
from eventloom.functions import text as tx
from eventloom.operators import feeds


def plan(df):
    """All expressions of the optimized plan, in full."""
    out, nodes = [], [df._jdf.queryExecution().optimizedPlan()]
    while nodes:
        node = nodes.pop()
        kids, own = node.children(), node.expressions()
        nodes += [kids.apply(i) for i in range(kids.size())]
        out += [own.apply(i).sql() for i in range(own.size())]
    return " ".join(out)


def test_place_and_region_fold_a_town_once(spark):
    rows = spark.createDataFrame([("Pirna, Haus, Weg 1",), ("Dresden, Haus",), ("Leipzig, Haus",), ("",), (None,)], "loc string")
    place, near = feeds.place_in_region(F.col("loc"))
    got = rows.select(place.alias("place"), near.alias("near"))
    assert plan(got).count("lower(") <= 6  # of both columns; 16 while parts were spelt out anew wherever they are named
    assert [tuple(r) for r in got.collect()] == [("Haus Pirna", True), ("Haus", True), (None, False), (None, True), (None, True)]


def test_rules_do_not_repeat_the_slug(spark):
    rows = spark.createDataFrame([("Semperoper",), ("Grünes Gewölbe",), ("Haus",), (None,)], "v string")
    large = rows.select(feeds.is_large_house(tx.slugify(F.col("v"))).alias("large"))
    assert plan(large).count("lower(") == 1 and "exists(lambda" not in plan(large)
    assert plan(large).index("lower(") < plan(large).index("exists(")
    assert [r["large"] for r in large.collect()] == [True, True, False, False]
    judged = rows.withColumn("c", classify.category(F.lit(""), tx.slugify(F.col("v")), F.lit(""))).where("c = 'demo'")
    assert plan(judged).count("lower(") <= 2


def test_slug_of_rare_letters(spark):
    texts = ["Zugabe & Gäste", "  --ÀÉ ﬁn ½ Ⅷ ㎏-", "Łódź Ωmega", "ß", "", None, "ABC def"]
    got = [r["s"] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tx.slugify(F.col("t")).alias("s")).collect()]
    assert got[0] == "zugabe-gaeste" and got[3:] == ["ss", "", "", "abc-def"]
    assert all(unicodedata.normalize("NFKD", s).isascii() for s in got)
