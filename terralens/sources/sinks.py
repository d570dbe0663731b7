"""Sinks: tables as CSV, Parquet and workbooks, summaries as JSON, models, rasters,
vector archives, reports."""

from __future__ import annotations

import io
import logging
import pickle
from html import escape

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terralens.sources import tiff, workbook
from terralens.sources.readers import exists

log = logging.getLogger("terralens.report")
#: Rows of a sheet in the format, and of a table in a report.
SHEET_ROWS, REPORT_ROWS = 1_048_576, 5_000


def csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """CSV with a header and a fixed column order."""
    (df.select(*columns) if columns else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def parquet(df: DataFrame, path: str, *partition: str) -> None:
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def summary(df: DataFrame, path: str) -> None:
    """A table of one row as one JSON document."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """One file, through the file system that holds the path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        for i in range(0, len(data), 1 << 20):
            out.write(bytearray(data[i : i + (1 << 20)]))
    finally:
        out.close()


def get(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).first()["content"])


def _bounded(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of more than {most} rows does not go into this file: write it as CSV or Parquet")
    return rows


def _plain(v):
    return v if v is None or isinstance(v, (bool, int, float, str)) else str(v)


def xlsx(spark: SparkSession, sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook with a sheet per table. A sheet holds a million rows at most, and a
    table that has more is refused, not cut."""
    data = {name: [df.columns, *([_plain(v) for v in r] for r in _bounded(df, SHEET_ROWS - 1))] for name, df in sheets.items()}
    put(spark, path, workbook.write(data))


def report(spark: SparkSession, title: str, parts: list[tuple[str, str | DataFrame]], path: str) -> None:
    """A document (HTML) of headed paragraphs and small tables; a large one is refused."""
    out = [f"<!doctype html><meta charset=utf-8><title>{escape(title)}</title><h1>{escape(title)}</h1>"]
    for head, body in parts:
        out.append(f"<h2>{escape(head)}</h2>")
        if isinstance(body, str):
            out.append(f"<p>{escape(body)}</p>")
            continue
        line = lambda tag, values: "<tr>" + "".join(f"<{tag}>{escape('' if v is None else str(v))}</{tag}>" for v in values) + "</tr>"
        out.append("<table>" + line("th", body.columns) + "".join(line("td", r) for r in _bounded(body, REPORT_ROWS)) + "</table>")
    put(spark, path, "\n".join(out).encode())


def console(df: DataFrame, title: str, n: int = 20) -> str:
    """The first rows as text, which also goes to the log."""
    rows = [[("" if v is None else str(v)) for v in r] for r in df.limit(n).collect()]
    wide = [max(map(len, c)) for c in zip(df.columns, *rows, strict=True)]
    text = "\n".join([title, *("  ".join(v.ljust(w) for v, w in zip(r, wide, strict=True)).rstrip() for r in [df.columns, *rows])])
    log.info("%s", text)
    return text


def image(spark: SparkSession, pixels: DataFrame, path: str, height: int, width: int, value: str = "value", kind: str = "uint8", transform=None, tile: int = 4096) -> None:
    """A mask or band of (row, col, value) pixels as TIFF files of ``tile`` x ``tile``
    pixels, each written by one task; pixels without a value are 0. ``path`` is a folder,
    whose files are named by the tile's first row and column."""
    from terralens.sources.files import put_bytes

    a, b, c, d, e, f = transform or (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)

    def run(pdf):
        top, left = int(pdf["ti"].iloc[0]) * tile, int(pdf["tj"].iloc[0]) * tile
        out = np.zeros((min(tile, height - top), min(tile, width - left)), kind)
        out[pdf["row"].to_numpy() - top, pdf["col"].to_numpy() - left] = pdf["v"].to_numpy()
        put_bytes(f"{path}/{top}-{left}.tif", tiff.write(out, (a, b, c + a * left + b * top, d, e, f + d * left + e * top)))
        return pdf[["ti", "tj"]].head(1)

    inside = pixels.filter((F.col("row") >= 0) & (F.col("row") < height) & (F.col("col") >= 0) & (F.col("col") < width))
    place = [F.floor(F.col(x) / tile).cast("int").alias(n) for x, n in (("row", "ti"), ("col", "tj"))]
    rows = inside.select(*place, F.col("row").cast("int"), F.col("col").cast("int"), F.col(value).cast("double").alias("v"))
    rows.groupBy("ti", "tj").applyInPandas(run, "ti int, tj int").count()


def vector_archive(spark: SparkSession, df: DataFrame, vector: str, order: str, path: str, name: str = "vectors", most: int = 5_000_000) -> None:
    """Vectors in a fixed order as one matrix in an .npz archive; more than ``most`` are
    refused: Parquet holds them."""
    rows = _bounded(df.select(order, vector).orderBy(order), most)
    buf = io.BytesIO()
    np.savez_compressed(buf, **{name: np.array([r[vector] for r in rows], "float32")})
    put(spark, path, buf.getvalue())


def model(spark: SparkSession, m, path: str) -> None:
    """A fitted model as one file."""
    put(spark, path, pickle.dumps(m))


def load_model(spark: SparkSession, path: str):
    """A model written by ``model``; only files of one's own are to be read so."""
    return pickle.loads(get(spark, path))  # noqa: S301


def absent(spark: SparkSession, paths: list[str]) -> list[str]:
    """Outputs that are not there."""
    return [p for p in paths if not exists(spark, p)]
