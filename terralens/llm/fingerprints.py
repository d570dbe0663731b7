"""Content-defined chunking fingerprints.

A gear hash over 16 bytes slides along the UTF-8 bytes; a chunk ends where the
hash clears a mask. The mask is strict below the normal size and loose above it
(normalised chunking), so sizes gather around the normal one. Because a chunk is
never shorter than the hash's window, a boundary depends on the bytes near it and
not on where the text began: an edit moves boundaries only in its neighbourhood.
A fingerprint is the set of (chunk digest, chunk length); two are compared by
length-weighted containment.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralens.llm.common import released

WINDOW = 16
MIN_SIZE, NORMAL_SIZE, MAX_SIZE = 16, 40, 160
STRICT, LOOSE = np.uint16(0xFE00), np.uint16(0xE000)


def _gear_table(seed: int = 11) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(bytes([b]), seed) & 0xFFFF for b in range(256)], np.uint16)


GEAR = _gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of GEAR[data[i-j]] << j modulo 2**16, in four doubling steps."""
    h = GEAR[data]
    for shift in (1, 2, 4, 8):
        nxt = h.copy()
        nxt[shift:] += h[:-shift] << np.uint16(shift)
        h = nxt
    return h


def chunk_ends(data: np.ndarray, start: int = 0) -> list[int]:
    """Ends of the chunks of data[start:]; the last one is len(data)."""
    n = len(data)
    if start >= n:
        return []
    h = gear_hashes(data[start:])
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = (loose[(h[loose] & STRICT) == 0] + (start + 1)).tolist()
    loose = (loose + (start + 1)).tolist()
    ends, at, i, j, ns, nl = [], start, 0, 0, len(strict), len(loose)
    while n - at > MIN_SIZE:
        i = bisect_left(strict, at + MIN_SIZE, i)
        if i < ns and strict[i] < at + NORMAL_SIZE:
            at = strict[i]
        else:
            j = bisect_left(loose, at + NORMAL_SIZE, j)
            at = min(loose[j] if j < nl else n, at + MAX_SIZE, n)
        ends.append(at)
    if not ends or ends[-1] < n:
        ends.append(n)
    return ends


def chunk_records(raw: bytes, ends: list[int], start: int = 0) -> list[int]:
    """digest (48 bits) << 16 | length of every chunk."""
    out, digest = [], xxhash.xxh3_64_intdigest
    for e in ends:
        out.append((digest(raw[start:e]) & 0xFFFFFFFFFFFF) << 16 | (e - start))
        start = e
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Bytes of the chunks that both sets hold, over the bytes of the smaller set
    (containment); 1 for two empty sets, 0 if one is empty."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    mask = np.uint64(0xFFFF)
    both = np.intersect1d(a, b, assume_unique=True)
    return float((both & mask).sum()) / float(min((a & mask).sum(), (b & mask).sum()))


def fingerprint(records: list[int]) -> np.ndarray:
    return np.unique(np.array(records, np.uint64))


def as_text(fp: np.ndarray) -> str:
    return fp.astype(">u8").tobytes().hex()


def text_fingerprint(text: str) -> np.ndarray:
    """The chunk set of one text; empty for an empty one."""
    raw = text.encode()
    return fingerprint(chunk_records(raw, chunk_ends(np.frombuffer(raw, np.uint8))))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the other text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


SCHEMA = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_ARROW = pa.schema([("id", pa.int64()), ("n_chars", pa.int64()), *[(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")], ("near_edited", pa.float64()), ("near_next", pa.float64())])


class _Doc:
    def __init__(self, bucket, head, key, text):
        self.bucket, self.head, self.key, self.text = bucket, head, key, text
        self.raw = text.encode()
        self.ends = chunk_ends(np.frombuffer(self.raw, np.uint8))
        self.records = chunk_records(self.raw, self.ends)
        self.fp = fingerprint(self.records)

    def against(self, nxt: _Doc) -> tuple:
        text = edited(self.text, nxt.text)
        raw = text.encode()
        kept_bytes = len(self.text[: len(self.text) - len(self.text) // 4].encode())
        # A chunk is settled once its end lies within the kept text; go on after the last such chunk.
        k = bisect_left(self.ends, kept_bytes + 1)
        k -= k > 0 and self.ends[k - 1] == len(self.raw)
        start = self.ends[k - 1] if k else 0
        rest = chunk_records(raw, chunk_ends(np.frombuffer(raw, np.uint8), start), start)
        other = fingerprint(self.records[:k] + rest)
        return (self.key, len(self.text), hashlib.sha256(raw).hexdigest(), as_text(self.fp), as_text(other), likeness(self.fp, other), likeness(self.fp, nxt.fp))


def _pairs(batches):
    """Rows come sorted by (bucket, id, row); the head of the next bucket closes each bucket."""
    last, out, size = None, [], 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _ARROW.types, strict=True)], schema=_ARROW)

    for batch in batches:
        buckets, heads, keys = (batch.column(i).to_pylist() for i in range(3))
        texts = batch.column(3)
        for i, (b, h, k) in enumerate(zip(buckets, heads, keys, strict=True)):
            doc = _Doc(b, h, k, texts[i].as_py() or "")
            if last is not None and last.bucket == b and not last.head:
                out.append(last.against(doc))
                size += len(out[-1][3]) + len(out[-1][4])
                if size > 4 << 20:
                    yield flush()
                    out, size = [], 0
            last = doc
    if out:
        yield flush()


def _bucket(cuts: list[tuple[int, int]], key) -> Column:
    """Number of the sorted cut points that are not above the key, found by halving."""
    if not cuts:
        return F.lit(0)
    edges = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(h).cast("long").alias("row")) for k, h in cuts])
    strides = F.array(*[F.lit(1 << j) for j in reversed(range(len(cuts).bit_length()))])
    fits = lambda at, n: (at + n <= len(cuts)) & (F.get(edges, at + n - 1) <= key)
    return F.aggregate(strides, F.lit(0), lambda at, n: F.when(fits(at, n), at + n).otherwise(at))


def chunk_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprint every text and its edited form, next to its follower by id.

    Nulls count as empty texts; a null id sorts first. Rows with one id follow
    one another by the hash of their text. Rows are dealt out by id and, where an id
    is frequent, by that hash; only rows equal in both stay together, and these pass
    through a task one by one. A table of one row is its own follower; an
    empty table gives an empty result. Extra columns are not read. The id must
    be an integer.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # Cut points: a mergeable sketch of the ids, `buckets` numbers at most. An id that is
    # several of them is a hot one: its rows are cut again, by the hash of their text.
    probs = [i / buckets for i in range(1, buckets)]
    got = src.agg(F.percentile_approx("id", probs, 20 * buckets).alias("cuts")).first() if probs else None
    times = Counter((got["cuts"] or []) if got else [])
    cuts = sorted((c, -(1 << 63) + (j << 64) // m) for c, m in times.items() for j in range(m))
    key = F.coalesce(F.col("id"), F.lit(-(1 << 63)))
    keyed = src.withColumn("bucket", _bucket(cuts, F.struct(key.alias("k"), F.xxhash64("text").alias("row"))))
    order = keyed.withColumn("row", F.xxhash64("text"))
    # The first row of every bucket, one per bucket, closes the bucket before it.
    heads = order.select("bucket", F.struct(key.alias("k"), "row").alias("at")).groupBy("bucket").agg(F.min("at").alias("at")).orderBy("bucket").collect()
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    target = spark.createDataFrame(
        [(h["bucket"], h["at"]["k"], h["at"]["row"], heads[i - 1]["bucket"]) for i, h in enumerate(heads)], "bucket int, k long, row long, closes int"
    )
    head_rows = (
        order.withColumn("k", key).join(F.broadcast(target), ["bucket", "k", "row"])  # one row per bucket
        .groupBy("closes").agg(F.first("text").alias("text"))
        .select(F.col("closes").alias("bucket"), F.lit(True).alias("head"), F.lit(None).cast("long").alias("id"), "text")
    )
    body = keyed.select("bucket", F.lit(False).alias("head"), "id", "text")
    rows = body.unionByName(head_rows).repartition(max(buckets, len(heads)), "bucket")
    rows = rows.sortWithinPartitions("bucket", "head", F.col("id").asc_nulls_first(), F.xxhash64("text"))
    return rows.mapInArrow(released(_pairs), SCHEMA).withColumnRenamed("id", id_col)


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    return chunk_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = None
