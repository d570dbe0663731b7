import random

import numpy as np
import pytest

from terralens.llm import topk as T

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k, every):
    vs = [(i, T.whole_vector(None if v is None else [None if x is None else float(np.float32(x)) for x in v])) for i, v in rows]
    vs = [(i, [int(x) for x in v]) for i, v in vs if v is not None and i is not None]
    out, qs = [], {}
    for i, v in vs:
        if i % every == 0:
            qs[i] = min(qs.get(i, (np.linalg.norm(v), v)), (np.linalg.norm(v), v))
    for i, (_, q) in qs.items():
        s = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in vs if j != i and len(v) == len(q))[:k]
        out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def data(kind):
    r = random.Random(kind)
    dim = 16
    rows = []
    for i in range(3000):
        scale = {"unit": 1, "skewed": r.paretovariate(1.2), "clusters": 1}[kind]
        v = [r.gauss(0, 1) for _ in range(dim)]
        if kind == "clusters":
            c = i % 7
            v = [0.05 * x + (3 if j == c else 0) for j, x in enumerate(v)]
        n = sum(x * x for x in v) ** 0.5
        rows.append((i, [scale * x / n for x in v]))
    same = rows[7][1]
    rows += [(3000 + i, same) for i in range(40)]
    rows += [(4000, None), (4050, [None] * dim), (4100, [float("nan")] * dim), (4150, [float("inf")] + [0.0] * 15), (None, same), (4200, [0.0] * dim), (4250, [])]
    rows += [(4300, [1.0, 2.0]), (4301, [2.0, 1.0]), (4350, [-0.5] * dim)]
    return rows


@pytest.mark.parametrize("kind", ["unit", "skewed", "clusters"])
def test_matches_brute_force(spark, kind):
    rows = data(kind)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in T.top_k(df, lambda i: i % 50 == 0, 5).collect())
    assert got == brute(rows, 5, 50)


def test_few_rows_repeats_and_huge_components(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.5])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    assert sorted(tuple(r) for r in T.top_k(df, lambda i: i == 0).collect()) == [(0, 1, 1, 65536), (0, 2, 1, 65536), (0, 3, 2, -65536)]
    rows = [(0, [3e6, 1.0]), (1, [2e5, 1.0]), (2, [3e20, 0.0]), (3, [3e19, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    q, v = [3_000_000 * 256, 256], [200_000 * 256, 256]
    assert [(r.vec_id, r.score) for r in T.top_k(df, lambda i: i == 0).orderBy("rank").collect()] == [(2, T._HIGH), (3, T._HIGH), (1, sum(a * b for a, b in zip(q, v)))]
    assert T.top_k(df.filter("false"), lambda i: i == 0).collect() == []


def test_query_matches_sql(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as from '{d}/embeddings.parquet'")
    assert sorted(con.execute(T.SQL).fetchall()) == sorted(tuple(r) for r in T.op7_topk(spark, d).collect())


def test_waves_match_brute_force(spark, monkeypatch):
    """Several waves, of shards whose vectors are long and short."""
    r = random.Random(2)
    rows = [(i, [(100 if i < 400 else 0.01) * x for x in (r.gauss(0, 1) + (1 if j == 0 else 0) for j in range(8))]) for i in range(4000)]
    monkeypatch.setattr(T, "BUCKET", 64)
    monkeypatch.setattr(T, "QUERIES", 16)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(3)
    written = []
    keep = T.stash
    monkeypatch.setattr(T, "stash", lambda d, name: written.append(name) or keep(d, name))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        got = sorted(tuple(x) for x in T.top_k(df, lambda i: i % 50 == 0, 5).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == brute(rows, 5, 50) and written.count("best") >= 4
