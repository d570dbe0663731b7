import hashlib
import random

import numpy as np
import xxhash

from pyspark.sql import functions as F

from terralens.llm import fingerprints as P

SCHEMA = "doc_id long, text string, bucket string, head string"


def prose(r, n):
    return "".join(r.choice("abcdefghij éß中") for _ in range(n))


def test_chunks_cover_the_text_within_bounds():
    r = random.Random(1)
    for n in (0, 1, 15, 16, 17, 100, 5000):
        raw = np.frombuffer(prose(r, n).encode(), np.uint8)
        ends = P.chunk_ends(raw)
        sizes = np.diff([0, *ends])
        assert (ends[-1] if ends else 0) == len(raw) and all(0 < s <= P.MAX_SIZE for s in sizes) and all(s >= P.MIN_SIZE for s in sizes[:-1])


def test_gear_hash_is_that_of_the_window():
    raw = np.frombuffer(prose(random.Random(2), 200).encode(), np.uint8)
    h = P.gear_hashes(raw)
    for i in (0, 3, 15, 16, 100):
        v = 0
        for b in raw[max(0, i - 15) : i + 1]:
            v = ((v << 1) + int(P.GEAR[b])) & 0xFFFF
        assert v == h[i]


def test_shift_changes_little():
    r = random.Random(3)
    text = prose(r, 8000)
    a = P.text_fingerprint(text)
    assert P.likeness(a, P.text_fingerprint("inserted " + text)) > 0.95
    assert P.likeness(a, P.text_fingerprint(text[:4000] + "xyz" + text[4000:])) > 0.95
    assert P.likeness(a, P.text_fingerprint(prose(r, 8000))) < 0.1
    assert P.likeness(a, P.text_fingerprint(text[:2000])) > 0.9  # contained
    assert P.likeness(a, a) == 1 and P.likeness(a[:0], a[:0]) == 1 and P.likeness(a, a[:0]) == 0


def plain_chunks(raw):
    """Chunks of a byte string, byte by byte from the description: a hash of the last 16
    bytes; 16 bytes at least and 160 at most; below 40 seven zero bits at the top of 16
    end a chunk, from there on three do."""
    gear = {b: xxhash.xxh64_intdigest(bytes([b]), 11) % 65536 for b in set(raw)}
    out, start = [], 0
    for end in range(1, len(raw) + 1):
        size = end - start
        h = sum(gear[b] << j for j, b in enumerate(raw[max(0, end - 16) : end][::-1])) % 65536
        cut = h < (1 << 9) if size < 40 else h < (1 << 13)
        if end == len(raw) or size == 160 or (size >= 16 and cut):
            out.append(raw[start:end])
            start = end
    return out


def plain_set(text):
    """{chunk: length}"""
    return {c: len(c) for c in plain_chunks(text.encode())}


def plain_likeness(a, b):
    if not a or not b:
        return float(not a and not b)
    return sum(n for c, n in a.items() if c in b) / min(sum(a.values()), sum(b.values()))


def plain_text(chunks):
    numbers = sorted(((xxhash.xxh3_64_intdigest(c) % (1 << 48)) << 16) + len(c) for c in chunks)
    return "".join(f"{n:016x}" for n in numbers)


def brute(rows):
    """Nothing of the module: texts, chunks, sets and shares from the contract."""
    out = []
    for k, (i, t) in enumerate(rows):
        t, y = t or "", rows[(k + 1) % len(rows)][1] or ""
        gone = len(t) // 4
        e = t[: len(t) - gone] + y[:gone]
        a, b, c = map(plain_set, (t, e, y))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), plain_text(a), plain_text(b), plain_likeness(a, b), plain_likeness(a, c)))
    return out


def test_matches_brute_force(spark):
    r = random.Random(4)
    rows = [(i * 3, r.choice([None, "", prose(r, r.randrange(40)), prose(r, r.randrange(3000))])) for i in range(120)]
    rows += [(1000, rows[5][1]), (1001, rows[5][1]), (1002, "y" * 100_000)]
    df = spark.createDataFrame([(*x, "b", "h") for x in rows], SCHEMA).repartition(4)
    for buckets in (1, 7, 300):
        assert sorted(tuple(x) for x in P.chunk_fingerprints(df, buckets=buckets).collect()) == brute(rows)


def test_small_tables_and_repeated_ids(spark):
    df = spark.createDataFrame([(5, "only one text here", "", "")], SCHEMA)
    assert [tuple(x) for x in P.chunk_fingerprints(df).collect()] == brute([(5, "only one text here")])
    assert P.chunk_fingerprints(df.filter("false")).collect() == []
    many = spark.createDataFrame([(None, "a", "", ""), (2, "b", "", ""), (2, "b", "", ""), (2, "b", "", ""), (3, None, "", "")], SCHEMA)
    got = P.chunk_fingerprints(many, buckets=3).collect()
    assert sorted((str(x.doc_id), x.n_chars) for x in got) == [("2", 1), ("2", 1), ("2", 1), ("3", 0), ("None", 1)]


def test_a_hot_id_is_split_and_keeps_its_order(spark):
    """Rows of one id follow one another by the hash of their text."""
    r = random.Random(6)
    rows = [(7, f"{prose(r, 60)} {i}") for i in range(400)] + [(i, prose(r, 50)) for i in [*range(7), *range(8, 200)]] + [(7, "twice " * 9)] * 2
    df = spark.createDataFrame([(*x, "b", "h") for x in rows], SCHEMA).repartition(4)
    hashes = {x.text: x.h for x in df.selectExpr("text", "xxhash64(text) AS h").collect()}
    want = brute(sorted(rows, key=lambda x: (x[0], hashes[x[1]])))
    got = P.chunk_fingerprints(df, buckets=16)
    assert sorted(tuple(x) for x in got.collect()) == sorted(want)
    spread = got.filter("doc_id = 7").groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) >= 5 and max(x["count"] for x in spread) < 200


def test_bucket_is_the_number_of_cuts_not_above(spark):
    cuts = sorted((k, h) for k in (3, 3, 5, 9, 20) for h in (-(1 << 63), 0))
    df = spark.range(25).withColumn("h", F.expr("CASE WHEN id % 2 = 0 THEN 0L ELSE -1L END"))
    got = df.withColumn("b", P._bucket(cuts, F.struct(F.col("id").alias("k"), F.col("h").alias("row")))).collect()
    assert all(x.b == sum(c <= (x.id, x.h) for c in cuts) for x in got)


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = sorted((x.doc_id, x.text) for x in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect())
    assert sorted(tuple(x) for x in P.op8_fingerprints(spark, d).collect()) == brute(docs)
