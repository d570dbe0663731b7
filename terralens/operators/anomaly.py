"""Isolation forest: trees grown in parallel on small samples, rows scored in batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.operators.index import minmax, order_statistics
from terralens.session import written

#: Rows a tree is grown on; also the bound of what a task holds.
SAMPLE = 256
#: Rows that the trees draw from.
POOL = 65_536


def _path(n: float) -> float:
    """Mean depth of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow(x: np.ndarray, seed: int) -> list[tuple]:
    """Nodes (feature, cut, left, right, value); leaves have feature -1."""
    r, nodes, limit = np.random.default_rng(seed), [], int(np.ceil(np.log2(max(2, len(x)))))

    def node(rows, depth):
        at = len(nodes)
        nodes.append((-1, 0.0, -1, -1, depth + _path(len(rows))))
        span = np.flatnonzero(x[rows].max(axis=0) > x[rows].min(axis=0)) if len(rows) > 1 and depth < limit else []
        if len(span):
            f = int(r.choice(span))
            cut = float(r.uniform(x[rows, f].min(), x[rows, f].max()))
            low = x[rows, f] <= cut
            left, right = node(rows[low], depth + 1), node(rows[~low], depth + 1)
            nodes[at] = (f, cut, left, right, 0.0)
        return at

    if len(x):
        node(np.arange(len(x)), 0)
    return nodes


def depths(nodes: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Path length of every row in one tree, level by level."""
    at = np.zeros(len(x), np.int64)
    while True:
        f = nodes[at, 0].astype(np.int64)
        inner = np.flatnonzero(f >= 0)
        if not len(inner):
            return nodes[at, 4]
        n = nodes[at[inner]]
        at[inner] = np.where(x[inner, f[inner]] <= n[:, 1], n[:, 2], n[:, 3]).astype(np.int64)


def isolation_forest(df: DataFrame, features: tuple[str, ...], key: str, trees: int = 300, contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """With score_anomalia (0 to 1 by the table's range) and es_anomalia.

    The POOL rows of least hash are the sample, all rows of a smaller table; every tree
    draws SAMPLE of them. So one law holds at every size, and what is collected and
    broadcast, the pool and the forest of trees x 2 SAMPLE nodes at most, has a bound.
    Null features count as 0.
    """
    spark = df.sparkSession
    x = df.select(F.xxhash64(F.col(key), F.lit(seed)).alias("_o"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in features])
    drawn = x.orderBy("_o", *features).limit(POOL).toPandas().sort_values(["_o", *features])
    pool = spark.sparkContext.broadcast(drawn[list(features)].to_numpy(float))

    def plant(batches):
        for pdf in batches:
            for tree in pdf["id"]:
                r = np.random.default_rng([seed, int(tree)])
                rows = r.choice(len(pool.value), min(SAMPLE, len(pool.value)), replace=False)
                nodes = grow(pool.value[rows], seed + int(tree))
                yield pd.DataFrame(nodes, columns=["f", "cut", "l", "r", "v"]).assign(tree=tree, node=range(len(nodes)))[["tree", "node", "f", "cut", "l", "r", "v"]]

    tasks = min(trees, spark.sparkContext.defaultParallelism)
    grown = spark.range(trees, numPartitions=tasks).mapInPandas(plant, "tree long, node int, f double, cut double, l double, r double, v double").toPandas()
    forest = [g.sort_values("node")[["f", "cut", "l", "r", "v"]].to_numpy(float) for _, g in grown.groupby("tree")]
    unit = _path(min(SAMPLE, len(drawn)))
    shared = spark.sparkContext.broadcast(forest)
    schema = df.schema.simpleString()[7:-1] + ",_raw:double"

    def judge(batches):
        for pdf in batches:
            m = pdf[list(features)].fillna(0).to_numpy(float)
            mean = np.mean([depths(t, m) for t in shared.value], axis=0) if shared.value and len(m) else np.zeros(len(m))
            yield pdf.assign(_raw=np.floor(2 ** (-mean / max(unit, 1e-9)) * 1e6 + 0.5) / 1e6)

    scored = df.mapInPandas(judge, schema)
    # read for its range, its quantile and the result; a score has six decimals, so a million values at most
    return flag(written(scored, "anomalies"), "_raw", contamination).drop("_raw")


def flag(df: DataFrame, value: str, contamination: float = 0.05) -> DataFrame:
    """With score_anomalia, the value stretched over the table's range, and es_anomalia,
    1 where it lies above the quantile that the share of anomalies leaves."""
    cut = F.lit(order_statistics(df, value, (1 - contamination,))[0])
    return minmax(df, value, "score_anomalia").withColumn("es_anomalia", (F.col(value) > cut).cast("int"))


def crossed(df: DataFrame, level: str = "riesgo_nivel") -> DataFrame:
    """One row: anomalies, those in the two high levels, those not prioritised."""
    high = F.col(level).isin("Alto", "Crítico")
    hit = F.col("es_anomalia") == 1
    return df.agg(F.count_if(hit).alias("anomalias"), F.count_if(hit & high).alias("en_nivel_alto"), F.count_if(hit & ~high).alias("no_priorizadas"))


def ranked(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The n most anomalous flagged rows, ties by key."""
    return df.filter("es_anomalia = 1").orderBy(F.col("score_anomalia").desc(), F.col(key)).limit(n)
