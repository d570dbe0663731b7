"""The hot-spot signal over a stream of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16, names: str = "*") -> DataFrame:
    """Parquet files that arrive in a folder, by name pattern."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", names).parquet(path)


def windowed(events: DataFrame, time: str, key: str, value: str, late: str = "1 day", window: str = "7 days", slide: str = "1 day") -> DataFrame:
    """Hot spots and radiative power per key and sliding window; events later than
    ``late`` behind the newest are left out, and their windows' state is dropped."""
    w = F.window(time, window, slide)
    g = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(w, key)
    total = F.sum(F.col(value).cast("decimal(18,4)")).cast("double")
    return g.agg(F.count(F.lit(1)).alias("focos"), total.alias("frp_total")).select("window.start", "window.end", key, "focos", "frp_total")


def refresh(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Work off what has arrived and stop: a daily refresh. The sink overwrites its
    output for a batch, so a repeated batch does no harm."""
    return events.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(spark: SparkSession, out: str, keys: list[str], schema: str) -> DataFrame:
    """The table that ``refreshed_table`` keeps: of every key the row of the last batch."""
    rows = spark.read.schema(schema + ", batch long").parquet(f"{out}/table")
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")


def refreshed_table(spark: SparkSession, totals: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Run a streaming aggregate with a watermark over what has arrived, and return its
    table. A batch adds the rows that it changed as files of its own, so nothing that is
    being read is overwritten, and state behind the watermark is dropped."""
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in totals.schema.fields)

    def sink(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/table/batch={batch}")

    refresh(totals, sink, f"{out}/checkpoint", "update").awaitTermination()
    return upserted(spark, out, keys, ddl)
