"""A task's share of pages does not grow with the table."""

from pyspark.sql import functions as F

from eventloom.operators import blocks


def test_more_html_gives_more_tasks(spark):
    page = F.concat(F.lit("<p>"), F.repeat(F.lit("x"), 100_000), F.lit("</p>")).alias("html")
    counts = [blocks.tokens(spark.range(n).select(F.col("id").alias("page_id"), page)).rdd.getNumPartitions() for n in (10, 400, 800)]
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert counts == [least, 10, 20]
    nothing = spark.createDataFrame([], "page_id long, html string")
    assert blocks.tokens(nothing).count() == 0
