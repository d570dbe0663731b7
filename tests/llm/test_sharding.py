import random
import re
import zlib

from terralens.llm import sharding as S

SCHEMA = "doc_id long, text string, shard string, size string, part string"


def brute(rows, n):
    """{(id, text): ...} is not unique, so rows come back as sorted tuples."""
    sizes = [len((t or "").encode()) + 1 for _, t in rows]
    total, at, out, seen = sum(sizes), 0, [], {}
    for (i, t), z in zip(rows, sizes):
        s = min(n - 1, (2 * at + z) * n // (2 * total))
        out.append((i, z, zlib.crc32((t or "").encode()), s, seen.get(s, 0)))
        seen[s] = seen.get(s, 0) + 1
        at += z
    return out


def test_matches_brute_force(spark):
    r = random.Random(1)
    rows = [(i, r.choice([None, "", "é" * r.randrange(400), "x" * r.randrange(3000)])) for i in range(500)]
    df = spark.createDataFrame([(*x, "a", "b", "c") for x in rows], SCHEMA).repartition(5)
    for n, ranges in ((8, 7), (3, 40), (1, 1)):
        got = sorted(tuple(x) for x in S.shard_by_bytes(df, n, ranges=ranges).collect())
        assert got == brute(rows, n)
    sizes = {}
    for _, z, _, s, _ in brute(rows, 8):
        sizes[s] = sizes.get(s, 0) + z
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 3001


def test_hot_and_null_ids(spark):
    rows = [(None, "n" * 10)] * 200 + [(7, "m" * 10)] * 300 + [(9, "z" * 10)]
    df = spark.createDataFrame([(*x, "a", "b", "c") for x in rows], SCHEMA).repartition(3)
    got = S.shard_by_bytes(df, 8, ranges=6).collect()
    assert sorted(((x.doc_id, x.size, x.text_crc32, x.shard, x.slot) for x in got), key=str) == sorted(brute(rows, 8), key=str)


def test_empty_table(spark):
    assert S.shard_by_bytes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_long_text(spark):
    df = spark.createDataFrame([(1, "x" * 2_000_000, "", "", ""), (2, "", "", "", "")], SCHEMA)
    assert sorted((x.doc_id, x.shard, x.slot) for x in S.shard_by_bytes(df).collect()) == [(1, 3, 0), (2, 7, 0)]
    assert [(x.doc_id, x.size) for x in S.shard_by_bytes(df).orderBy("doc_id").collect()] == [(1, 2_000_001), (2, 1)]


def test_query_matches_sql_and_stays_native(spark):
    from oracle import connect, duck_rows, spark_rows

    d = "/root/testdata/sf0.001"
    df = S.op2_sharding(spark, d)
    assert spark_rows(df) == duck_rows(connect(d), S.SQL)
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())
