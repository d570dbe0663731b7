"""Contiguous, byte-balanced shards from global prefix sums (DataFrame only).

The rows are range-partitioned by id; each range contributes one total, the
running totals of the ranges are the global prefix sums, and a row's own
position is its range's prefix plus a running sum inside the range. Cutting the
byte axis at equal targets gives contiguous shards whose sizes differ by less
than one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralens.llm.common import stash


def shard_by_bytes(df: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot.

    Order: ascending id, nulls first; rows of one id keep any fixed order (a row
    number makes the order total, so a hot id is split over ranges as well).
    size is the UTF-8 length plus 1; a null or empty text has size 1 and CRC 0.
    A row goes to the shard that holds its middle byte. slot counts from 0
    within a shard. Repeated rows are rows of their own. An empty table gives an
    empty result. Other columns are not read, so their names can't clash.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = df.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.monotonically_increasing_id().alias("row"),
    )
    # Written once: the ranges that every later step refers to are those in the files.
    dealt = stash(slim.repartitionByRange(ranges, "id", "row").withColumn("part", F.spark_partition_id()), "shards")

    # One row per range; the window without a key runs over these few rows alone.
    parts = dealt.groupBy("part").agg(F.sum("size").alias("bytes"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    prefix = parts.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"),
        F.sum("bytes").over(Window.partitionBy()).alias("total"),
    )
    run = Window.partitionBy("part").orderBy(F.col("id").asc_nulls_first(), "row")
    placed = (
        dealt.join(F.broadcast(prefix), "part")  # as many rows as there are ranges
        .withColumn("end", F.col("start") + F.sum("size").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.expr(f"(2 * end - size) * {n_shards} div (2 * total)")).cast("int"))
    )
    inside = placed.withColumn("nth", F.row_number().over(Window.partitionBy("part", "shard").orderBy(F.col("id").asc_nulls_first(), "row")))
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    first = counts.select(
        "shard", "part", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first")
    )
    # A range meets few shards: at most ranges + n_shards rows.
    return inside.join(F.broadcast(first), ["part", "shard"]).select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("first") + F.col("nth") - 1).alias("slot")
    )


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return shard_by_bytes(docs, 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


SQL = """
WITH tab AS (SELECT list_transform(range(256), lambda i: list_reduce([i::BIGINT] || list_transform(range(8), lambda j: 0::BIGINT),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
b AS (SELECT doc_id, octet_length(encode(x))::BIGINT + 1 AS size, hex(encode(x)) AS h FROM d),
l AS (SELECT doc_id, size, [4294967295::BIGINT] || list_transform(range(size - 1), lambda k: CAST('0x' || substr(h, (2 * k + 1)::BIGINT, 2) AS BIGINT)) AS bytes FROM b),
c AS (SELECT doc_id, size, xor(list_reduce(bytes, lambda c, v: xor(c >> 8, t[(xor(c, v) & 255) + 1])), 4294967295) AS crc FROM l, tab),
s AS (SELECT *, sum(size) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS upto, sum(size) OVER ()::BIGINT AS total FROM c),
p AS (SELECT *, least(7, (2 * upto - size) * 8 // (2 * total))::INTEGER AS shard FROM s)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INTEGER AS grown_shard FROM p
"""
