"""Exact top-k inner products by norm-bucketed retrieval.

All vectors are sorted by length, longest first, and written as buckets of similar
length. A query visits the buckets from the longest on. With its k-th best product
so far and the bucket's greatest length it has a local cosine threshold: above 1
the bucket and all later ones fall out; a high one is served by coordinate pruning
(a bound on the cosine from the query's largest coordinate), a low one by length
pruning (the bucket's vectors that are long enough). What is left is verified by
its product. Buckets and query blocks are files in the shared folder; a task maps
one shard of buckets and one block of queries into memory. Shards are visited in
waves of twice the number, longest vectors first: a wave starts from the k-th best
products of those before, and pairs of a block and a shard too short for all of its
queries are not formed.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terralens.llm import hashindex as hx
from terralens.llm.common import filesystem, put_file, released, scratch, stash

BUCKET, QUERIES = 1024, 256
#: Local cosine threshold from which coordinates prune better than lengths.
COORDINATE_FROM = 0.5
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1
_BUCKETS = pa.schema([("shard", pa.string()), ("at", pa.int32()), ("dim", pa.int32()), ("n", pa.int32()), ("top", pa.float64())])
_FOUND = "q_shard string, q_at int, query_id long, q_norm double, vec_id long, score long"
_CLEAN = pa.schema([("vec_id", pa.int64()), ("dim", pa.int32()), ("norm", pa.float64()), ("vec", pa.binary())])


def whole_vector(components) -> np.ndarray | None:
    """floor(256 x) of every component; None if one is null or not finite."""
    if components is None or any(c is None for c in components):
        return None
    with np.errstate(over="ignore", invalid="ignore"):
        v = np.floor(np.array(components, np.float64) * 256.0)
    return v if np.isfinite(v).all() else None


def _clean(batches):
    for b in batches:
        rows = []
        for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            v = whole_vector(x.as_py())
            if i is not None and v is not None:
                rows.append((i, len(v), float(np.linalg.norm(v)), v.tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _CLEAN.types, strict=True)], schema=_CLEAN)


def _writer(root: str, size: int):
    """Writes the sorted rows of a partition as one file of arrays with a directory of
    its buckets, and returns a row per bucket."""
    def run(batches):
        from pyspark import TaskContext

        # named by the attempt, so that a file never stands beside another attempt's directory
        shard, buckets, held = f"s{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}", [], []
        fsys, path = filesystem(f"{root}/{shard}.arrays")
        fsys.create_dir(path.rsplit("/", 1)[0], recursive=True)
        out, at = None, 0

        def close():
            nonlocal out, at
            out = out or fsys.open_output_stream(path, compression=None)
            ids, norms = np.array([h[0] for h in held], np.int64), np.array([h[2] for h in held], np.float64)
            buckets.append([shard, held[0][1], len(held), norms[0], norms[-1], at])
            for raw in (ids.tobytes(), norms.tobytes(), b"".join(h[3] for h in held)):
                out.write(raw)
                at += len(raw)
            held.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (len(held) == size or held[0][1] != row[1]):
                    close()
                held.append(row)
        if held:
            close()
        if buckets:
            out.close()
            put_file(f"{root}/{shard}.json", json.dumps(buckets).encode())
            cols = [[shard] * len(buckets), range(len(buckets)), *([b[i] for b in buckets] for i in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _BUCKETS.types, strict=True)], schema=_BUCKETS)

    return run


def _directory(root, shard):
    fsys, path = filesystem(f"{root}/{shard}.json")
    with fsys.open_input_file(path) as f:
        return json.loads(f.read())


def _load(root, entry):
    shard, dim, n, _, _, at = entry
    raw = hx.Column.get(f"{root}/{shard}.arrays", np.uint8)[at : at + 8 * n * (2 + dim)]
    return raw[: 8 * n].view(np.int64), raw[8 * n : 16 * n].view(np.float64), raw[16 * n :].view(np.float64).reshape(n, dim)


def floor_of(score: int) -> float:
    """The score as a threshold: beyond 2**53 a double rounds, so it stays below the
    integer, since equal scores must still enter."""
    low = float(score)
    return low if abs(low) < 2.0**53 else low - abs(low) * 1e-15


class Best:
    """The k best (score, id) of each query, ties to the smaller id."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor, self.rows = k, floor, [[] for _ in range(n)]

    def offer(self, q: int, scores, ids):
        rows = sorted([*self.rows[q], *zip((-s for s in scores), ids, strict=True)])[: self.k]
        self.rows[q] = rows
        if len(rows) == self.k:
            self.floor[q] = max(self.floor[q], floor_of(-rows[-1][0]))


def products(queries: np.ndarray, vecs: np.ndarray, q_norm: float, v_norm: float) -> np.ndarray:
    """Exact integer products: in doubles while these are exact, else in Python
    integers, held within 64 bits."""
    if q_norm * v_norm < 2.0**52:
        return queries @ vecs.T
    big = np.array([[min(max(sum(int(a) * int(b) for a, b in zip(q, v, strict=True)), _LOW), _HIGH) for v in vecs] for q in queries], object)
    return big.reshape(len(queries), len(vecs))


def visit(best: Best, q_ids, q_norms, q_vecs, ids, norms, vecs) -> bool:
    """Compare a query block with one bucket; False if no query can use shorter vectors."""
    top, exact = float(norms[0]), q_norms.max(initial=0.0) * float(norms[0]) < 2.0**52
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(best.floor > 0, best.floor / np.maximum(q_norms * top, 1e-300), -np.inf)
    slack = 1e-9
    alive = local <= 1 + slack
    if not alive.any():
        return False
    coords = np.flatnonzero(alive & (local >= COORDINATE_FROM)) if exact and vecs.shape[1] else np.zeros(0, np.int64)
    unit = {}
    for q in coords:
        f = int(np.argmax(np.abs(q_vecs[q])))
        if f not in unit:
            c = np.clip(vecs[:, f] / np.maximum(norms, 1e-300), -1, 1)
            unit[f] = c, np.sqrt(1 - c * c)
        c, rest = unit[f]
        x = float(np.clip(q_vecs[q, f] / q_norms[q], -1, 1))
        at = np.flatnonzero(x * c + np.sqrt(1 - x * x) * rest >= local[q] - 1e-6)
        if len(at):
            s = vecs[at] @ q_vecs[q]
            keep = (s >= best.floor[q]) & (ids[at] != q_ids[q])
            if keep.any():
                best.offer(int(q), [int(v) for v in s[keep]], ids[at][keep].tolist())
    lengths = np.flatnonzero(alive & ~np.isin(np.arange(len(q_ids)), coords))
    if len(lengths):
        # vectors too short for every one of these queries are a tail of the bucket
        with np.errstate(divide="ignore", invalid="ignore"):
            need = np.where(best.floor[lengths] > 0, best.floor[lengths] / np.maximum(q_norms[lengths], 1e-300), -np.inf).min()
        n = int(np.searchsorted(-norms, -(need * (1 - slack)), "right")) if np.isfinite(need) else len(norms)
        s = products(q_vecs[lengths], vecs[:n], q_norms.max(initial=0.0), top)
        ok = (s >= best.floor[lengths, None]) & (ids[None, :n] != q_ids[lengths, None])
        for r in np.flatnonzero(ok.any(axis=1)):
            at = np.flatnonzero(ok[r])
            v = s[r, at]
            if len(at) > 4 * best.k and exact:
                cut = np.partition(v, len(v) - best.k)[len(v) - best.k]
                at, v = at[v >= cut], v[v >= cut]
            best.offer(int(lengths[r]), [int(z) for z in v], ids[at].tolist())
    return True


def top_k(df: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows but its own.

    ``is_query`` is a condition on the id. Null vectors, vectors with a null or
    non-finite component and null ids take no part; vectors of another dimension
    are no candidates of a query. Rows of one id are one query (the least vector)
    and all are candidates, of other ids. An empty table gives an empty result;
    extra columns are not read.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ddl = "vec_id long, dim int, norm double, vec binary"
    src = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = stash(src.mapInArrow(released(_clean), ddl), "vectors")
    queries = rows.filter(is_query(F.col("vec_id"))).groupBy("vec_id").agg(F.min(F.struct("dim", "norm", "vec")).alias("q")).select("vec_id", "q.*")

    def written(frame, name, size):
        root = scratch(spark, name)
        order = ["dim", F.col("norm").desc(), "vec_id"]
        out = frame.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(released(_writer(root, size)), "shard string, at int, dim int, n int, top double")
        return root, stash(out, name + "-list")

    (root, buckets), (q_root, blocks) = written(rows, "buckets", BUCKET), written(queries, "queries", QUERIES)
    blocks = blocks.select(F.col("shard").alias("q_shard"), F.col("at").alias("q_at"), "dim", "n")
    # a row per shard and dimension, and as many shards as partitions; shards of one dimension are numbered by falling length
    waves: dict[int, list] = {}
    last, place = None, 0
    for r in sorted(buckets.groupBy("dim", "shard").agg(F.max("top").alias("top")).collect(), key=lambda r: (r["dim"], r["shard"])):
        place = place + 1 if r["dim"] == last else 1
        last = r["dim"]
        waves.setdefault(int(math.log2(place)), []).append((r["dim"], r["shard"], r["top"]))

    def run(batches):
        for b in batches:
            for q_shard, q_at, shard, known in zip(*(c.to_pylist() for c in b.columns), strict=True):
                entry = _directory(q_root, q_shard)[q_at]
                q_ids, q_norms, q_vecs = _load(q_root, entry)
                floors = {x["query_id"]: floor_of(x["low"]) for x in known or []}
                best = Best(len(q_ids), k, np.array([floors.get(i, -np.inf) for i in q_ids.tolist()]))
                for bucket in _directory(root, shard):
                    if bucket[1] == entry[1] and not visit(best, q_ids, q_norms, q_vecs, *_load(root, bucket)):
                        break
                out = [(q_shard, q_at, int(q_ids[q]), float(q_norms[q]), i, -s) for q, found in enumerate(best.rows) for s, i in found]
                if out:
                    types = [pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["q_shard", "q_at", "query_id", "q_norm", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = None
    for _, shards in sorted(waves.items()):
        pairs = blocks
        if best is not None:
            # the k-th best of each query, and the least length that any query of a block can use
            low = best.filter(F.col("rank") == k).groupBy("q_shard", "q_at").agg(
                F.collect_list(F.struct("query_id", F.col("score").alias("low"))).alias("known"),
                F.count(F.lit(1)).alias("c"), F.min("score").alias("least"), F.min(F.try_divide(F.col("score").cast("double"), F.col("q_norm"))).alias("need"),
            )
            pairs = blocks.join(low, ["q_shard", "q_at"], "left")
            pairs = pairs.withColumn("need", F.when((F.col("c") == F.col("n")) & (F.col("least") > 0), F.col("need") * (1 - 1e-9)).otherwise(0.0))
        else:
            pairs = pairs.withColumns({"known": F.lit(None).cast("array<struct<query_id:long,low:long>>"), "need": F.lit(0.0)})
        listed = spark.createDataFrame(shards, "dim int, shard string, top double")  # of this wave
        pairs = pairs.join(F.broadcast(listed), "dim").filter("need <= top").select("q_shard", "q_at", "shard", "known")
        found = pairs.repartition(parts, "q_shard", "q_at", "shard").mapInArrow(released(run), _FOUND)
        # k rows per query and shard come here
        if best is not None:
            found = found.unionByName(best.drop("rank"))
        best = stash(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best")
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return best.select("query_id", "rank", "vec_id", "score")


def op7_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 50 == 0, 5)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS z FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.z AS DOUBLE[]), CAST(c.z AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
