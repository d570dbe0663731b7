"""Connected components by alternating stars, on tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.llm.common import drop_path, scratch


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a long, b long); root is the least
    node of its component.

    Each round joins every node's neighbours to the least of them, larger ones
    first (large star), then smaller ones (small star); it ends when a round
    changes nothing. ``edges`` is computed once, here; rounds are written tables, the
    driver sees a count and a checksum. Loops, repeated edges and nulls are ignored.
    """
    spark = edges.sparkSession
    last = None

    def keep(df):
        nonlocal last
        path = scratch(spark, "edges")
        df.write.parquet(path)
        old, last = last, path
        if old:
            drop_path(spark, old)
        return spark.read.schema("a long, b long").parquet(path)

    def star(df, rows):
        least = df.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return rows(df.join(least, "a")).filter("a <> b").distinct()

    def both(df):
        return df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def large(df):
        return star(both(df), lambda j: j.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")))

    def small(df):
        down = df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        return star(down, lambda j: j.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(j.select("a", F.col("m").alias("b")).distinct()))

    def mark(df):
        r = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return tuple(r)

    now = keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(now)
    while seen[0]:
        now = keep(small(large(now)))
        found = mark(now)
        if found == seen:
            break
        seen = found
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
