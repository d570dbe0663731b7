"""Session settings the package is built for, and tables written on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "terralens", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; further settings as keywords with
    ``_`` for ``.`` are left to the caller's builder."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k.replace("_", "."), v)
    return b.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``).
    Where the session names none, a local session, as in tests, gets a temporary one;
    on a cluster every machine would use its own, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.gettempdir()
    return f"{root.rstrip('/')}/terralens/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table that is read several times and read it back: it is computed once,
    and a lost executor costs only the rereading of a file."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_KNOWN: dict[tuple, str] = {}


def state_of(spark: SparkSession, paths: list[str]) -> tuple:
    """Name, length and time of every file below the paths, which tells when they change."""
    jvm, out = spark.sparkContext._jvm, []
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        found = fs.globStatus(p)
        for top in list(found) if found is not None else []:
            files = fs.listFiles(top.getPath(), True)
            while files.hasNext():
                f = files.next()
                out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


def materialised(spark: SparkSession, name: str, sources: list[str], build) -> DataFrame:
    """A table that many queries start from: built and written by the first that needs
    it, and again once a file of its sources has changed."""
    key = (spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None), name, tuple(sources), state_of(spark, sources))
    if key not in _KNOWN:
        path = scratch_path(spark, name)
        build().write.parquet(path)
        _KNOWN[key] = path
    return spark.read.parquet(_KNOWN[key])
