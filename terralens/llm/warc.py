"""WARC archives with a two-level capture index.

Writing: every task writes one archive of gzip members, a record per row. Of equal
payloads one is stored (response), the others refer to it (revisit). Only digests are
shuffled: those that occur twice or more are written as sorted files, in which the
writers look their rows up, so a payload stays where it was read. Indexing: the
captures are sorted by reversed-host URL key and dealt into index shards; a shard
is a file of compressed blocks of sorted lines plus a sparse directory with the
first key of each block. Reading: binary search over the shards' first keys, then
over one shard's directory, then inside one block, then one range read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections import OrderedDict
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.llm.common import U64, filesystem, put_file, released, scratch, stash
from terralens.llm.hashindex import Shelf, bucket_bits, bucket_edges

BLOCK_LINES = 256
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Sorts a capture without an id before all others.
NO_ID = -(1 << 63)


def url_key(url: str | None) -> str:
    """Reversed-host key: ``http://www.A.example/x?y#z`` -> ``example,a)/x?y``, the same
    for a URL and for the form of it that headers hold."""
    url = _uri(url)
    try:
        p = urlsplit(url if "://" in url else "//" + url)
        host, port = (p.hostname or "").removeprefix("www."), p.port
    except ValueError:
        return ")" + url.lower()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "")
    return (key + ")" + (p.path or "/").lower() + (f"?{p.query.lower()}" if p.query else "")).replace("\t", "%09").replace("\n", "%0a")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _uri(url: str | None) -> str:
    """The URL as a header holds it: without blanks around it, and what no URL may hold
    percent-encoded. Index keys are made of this form too, on writing and on reading."""
    return quote((url or "").strip(), safe="%/:?#[]@!$&'()*+,;=~-._")


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, target: tuple | None, date: str) -> bytes:
    """One gzip member; ``target`` is (id, url) of the record that a revisit refers to."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if target else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if target else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_uri(url)}"]
    if target:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{target[0]}>", f"WARC-Refers-To-Target-URI: {_uri(target[1])}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def parse_record(member: bytes) -> tuple[dict, bytes]:
    """(headers by lower-case name, HTTP payload) of one gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in head.decode().split("\r\n")[1:])}
    return headers, rest[: int(headers["content-length"])].partition(b"\r\n\r\n")[2]


def _id_of(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return None if text in ("", "None") else int(text)


_ENTRY = pa.schema([("key", pa.string()), ("id", pa.int64()), ("file", pa.string()), ("start", pa.int64()), ("length", pa.int64())])


class Repeats:
    """The digests that occur twice or more, with id and URL of the record that holds
    the payload, as sorted arrays per bucket of digests, which writers map and search."""

    KINDS = {"key": U64, "sha": np.uint8, "id": np.int64, "at": np.int64, "url": np.uint8}

    def __init__(self, shelf: Shelf):
        self.shelf = shelf

    def of(self, shas: np.ndarray) -> list[tuple | None]:
        """(id, URL), or nothing, of each of the 20-byte digests (rows of an array)."""
        out: list = [None] * len(shas)
        keys = sha_key(shas)
        order = np.argsort(keys, kind="stable")
        tops, at = bucket_edges(keys[order], self.shelf.bits) if len(keys) else ([], [0])
        for b, lo, hi in zip(tops, at[:-1], at[1:], strict=True):
            arrays = self.shelf.get(int(b))
            if arrays is None:
                continue
            known, full, ids, places, urls = arrays
            full = full.reshape(-1, 20)
            rows = order[lo:hi]
            # a key is the digest's first 8 bytes: what shares them is told apart by all 20
            first, last = (np.searchsorted(known, keys[rows], side) for side in ("left", "right"))
            for i, j, k in zip(rows.tolist(), first.tolist(), last.tolist(), strict=True):
                while j < k and (full[j] != shas[i]).any():
                    j += 1
                if j < k:
                    out[i] = int(ids[j]), urls[places[j] : places[j + 1]].tobytes().decode()
        return out


def sha_key(shas: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(shas[:, :8]).view(">u8").reshape(-1).astype(U64)


def write_repeats(keyed: DataFrame, root: str) -> Repeats:
    """Find the repeated digests of rows (sha, id, url) and write them below ``root``.

    Partial counts run in the tasks that read, so a frequent payload costs a row per
    task. Buckets follow the number of rows.
    """
    spark = keyed.sparkSession
    bits = bucket_bits(keyed.count(), 1 << 18)
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "url")))
    firsts = keyed.groupBy("sha").agg(least.alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1 AND first IS NOT NULL")
    top = F.conv(F.substring("sha", 1, 8), 16, 10).cast("long")
    dealt = firsts.select(F.shiftright(top, 32 - bits).cast("int").alias("bucket"), F.unhex("sha").alias("sha"), "first.id", F.coalesce("first.url", F.lit("")).alias("url"))

    shelf = Shelf(root, bits, Repeats.KINDS)

    def run(batches):
        out, now, rows = shelf.writer(), None, []

        def close():
            shas = np.frombuffer(b"".join(r[0] for r in rows), np.uint8).reshape(-1, 20)
            urls = [r[2].encode() for r in rows]
            out.add(now, sha_key(shas), shas, [r[1] for r in rows], np.cumsum([0, *map(len, urls)]), b"".join(urls))

        for b in batches:
            for bucket, *row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bucket != now and rows:
                    close()
                    rows = []
                now = bucket
                rows.append(row)
        if rows:
            close()
        yield pa.RecordBatch.from_pydict({"done": pa.array([np.array(out.close(), np.int32).tobytes()], pa.binary())})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(parts, F.shiftright("bucket", shelf.shift)).sortWithinPartitions("bucket", "sha")
    got = dealt.mapInArrow(released(run), "done binary").collect()
    return Repeats(shelf.filled(np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(r[0], np.int32) for r in got)])))


def write_archives(df: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the archives below ``root``; returns the captures (key, id, file, start, length).

    Equal payloads of ``min_bytes`` or more: the smallest id is the response (all
    rows with that id, if it is repeated), the others are revisits. A null payload
    is empty; a null id counts only where its group has no other and is then the
    response. A null URL has the key ``)/``. An archive has the name of the task
    attempt that wrote it, so of two attempts one's file never stands beside the
    other's offsets.
    """
    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    keyed = src.withColumn("sha", F.sha1("payload"))
    repeats = write_repeats(keyed.select("sha", "id", "url"), f"{root}/repeats")

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        name = f"pages-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        fsys, path = filesystem(f"{root}/{name}")
        fsys.create_dir(path.rsplit("/", 1)[0], recursive=True)
        at, out = 0, None
        for batch in batches:
            done = []
            ids, urls, shas = (batch.column(i).to_pylist() for i in (0, 1, 3))
            found = repeats.of(np.frombuffer(bytes.fromhex("".join(shas)), np.uint8).reshape(-1, 20))
            for page_id, url, payload, sha, first in zip(ids, urls, batch.column(2), shas, found, strict=True):
                out = out or fsys.open_output_stream(path, compression=None)
                payload = payload.as_py()
                repeat = first is not None and first[0] != page_id and len(payload) >= min_bytes
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                member = make_record(page_id, url, payload, digest, first if repeat else None, date)
                out.write(member)
                done.append((url_key(url), page_id, name, at, len(member)))
                at += len(member)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), _ENTRY.types, strict=True)], schema=_ENTRY)
        if out is not None:
            out.close()

    rows = keyed.select("id", "url", "payload", "sha")
    return stash(rows.mapInArrow(released(run), "key string, id long, file string, start long, length long"), "captures")


def write_index(captures: DataFrame, root: str, block_lines: int = BLOCK_LINES) -> list[tuple]:
    """Write the index shards; returns (first key, first id, shard) of each, sorted.
    There are as many shards as partitions, so this list stays small."""
    spark = captures.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = captures.withColumn("id", F.coalesce("id", F.lit(NO_ID))).repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id")

    def run(batches):
        from pyspark import TaskContext

        shard = f"index-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"
        blocks, directory, lines, at, first = [], [], [], 0, None

        def close():
            nonlocal at, lines
            z = zlib.compress("\n".join("\t".join(map(str, x)) for x in lines).encode(), 6)
            directory.append([lines[0][0], lines[0][1], at, len(z)])
            blocks.append(z)
            at += len(z)
            lines = []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                first = first or row[:2]
                lines.append(row)
                if len(lines) == block_lines:
                    close()
        if lines:
            close()
        if first:
            put_file(f"{root}/{shard}.blocks", b"".join(blocks))
            put_file(f"{root}/{shard}.directory", zlib.compress(json.dumps(directory).encode(), 6))
            yield pa.RecordBatch.from_pydict({"key": [first[0]], "id": pa.array([first[1]], pa.int64()), "shard": [shard]})

    return sorted((r["key"].encode(), r["id"], r["shard"]) for r in ordered.mapInArrow(released(run), "key string, id long, shard string").collect())


class Kept(OrderedDict):
    """The last few values that a function of the key made."""

    def __init__(self, make, size):
        super().__init__()
        self.make, self.size = make, size

    def of(self, key):
        if key in self:
            self.move_to_end(key)
        else:
            self[key] = self.make(key)
            if len(self) > self.size:
                self.popitem(last=False)
        return self[key]


class CaptureReader:
    """Looks captures up in the index and reads their records."""

    def __init__(self, root: str, shards: list[tuple]):
        self.root, self.shards = root, shards
        self.starts = [s[:2] for s in shards]
        self.files = Kept(self._open, 64)
        self.directories = Kept(self._directory, 8)
        self.blocks = Kept(self._block, 16)
        self.targets = Kept(self._target, 256)

    def _open(self, name):
        fsys, path = filesystem(f"{self.root}/{name}")
        return fsys.open_input_file(path)

    def _directory(self, shard):
        rows = json.loads(zlib.decompress(self.files.of(f"{shard}.directory").read_at(self.files.of(f"{shard}.directory").size(), 0)))
        return [(r[0].encode(), r[1]) for r in rows], rows

    def _block(self, at):
        shard, start, length = at
        lines = [x.split("\t") for x in zlib.decompress(self.files.of(f"{shard}.blocks").read_at(length, start)).decode().split("\n")]
        return [(x[0].encode(), int(x[1])) for x in lines], lines

    def find(self, key: str, page_id: int | None) -> list[tuple]:
        """(file, start, length) of every capture of that key and id."""
        want, out = (key.encode(), NO_ID if page_id is None else page_id), []
        # Equal captures can begin in the shard and block before the one that starts with them.
        for s in range(max(0, bisect_left(self.starts, want) - 1), bisect_right(self.starts, want)):
            shard = self.shards[s][2]
            keys, rows = self.directories.of(shard)
            for b in range(max(0, bisect_left(keys, want) - 1), bisect_right(keys, want)):
                found, lines = self.blocks.of((shard, rows[b][2], rows[b][3]))
                out += [(x[2], int(x[3]), int(x[4])) for x in lines[bisect_left(found, want) : bisect_right(found, want)]]
        return out

    def record(self, at: tuple) -> tuple[dict, bytes]:
        return parse_record(self.files.of(at[0]).read_at(at[2], at[1]))

    def _target(self, want):
        for at in self.find(*want):
            headers, payload = self.record(at)
            if headers["warc-type"] == "response" and headers["warc-payload-digest"] == want_digest(want):
                return payload
        raise LookupError(f"no record {want}")

    def read(self, at: tuple) -> tuple:
        """(id, payload, digest, type, refers_to); a revisit is followed to its payload."""
        headers, payload = self.record(at)
        kind, refers = headers["warc-type"], None
        if kind == "revisit":
            refers = _id_of(headers["warc-refers-to"])
            payload = self.targets.of(Target(url_key(headers["warc-refers-to-target-uri"]), refers, headers["warc-payload-digest"]))
        return _id_of(headers["warc-record-id"]), payload, headers["warc-payload-digest"].removeprefix("sha1:"), kind, refers


class Target(tuple):
    """Key and id of a record to look up, and the digest that it must have."""

    def __new__(cls, key, page_id, digest):
        self = super().__new__(cls, (key, page_id))
        self.digest = digest
        return self

    def __hash__(self):
        return hash((tuple(self), self.digest))

    def __eq__(self, other):
        return tuple(self) == tuple(other) and self.digest == other.digest


def want_digest(target: Target) -> str:
    return target.digest


_READ = pa.schema([("id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_captures(lookups: DataFrame, root: str, shards: list[tuple], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Look the (id, URL) pairs up in the index and read their records back, with
    the digest computed anew from the full payload. Repeated pairs count once, and
    each capture of a pair gives a row."""
    spark = lookups.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def key(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in b.column(1).to_pylist()], pa.string()), b.column(0)], names=["key", "id"])

    keyed = lookups.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url")).mapInArrow(released(key), "key string, id long").distinct()
    # Sorted like the index, a task's look-ups touch each block once.
    ordered = keyed.repartitionByRange(parts, "key", F.col("id").asc_nulls_first()).sortWithinPartitions("key", F.col("id").asc_nulls_first())

    def run(batches):
        reader = CaptureReader(root, shards)
        for b in batches:
            done = []
            for k, i in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for at in reader.find(k, i):
                    page_id, payload, digest, kind, refers = reader.read(at)
                    if digest_of(payload) != digest:
                        raise ValueError(f"payload of {page_id} does not match its digest")
                    done.append((page_id, len(payload), digest, kind, refers))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), _READ.types, strict=True)], schema=_READ)

    return ordered.mapInArrow(released(run), "id long, payload_bytes long, payload_digest string, record_type string, refers_to long").withColumnRenamed("id", id_col)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    root = scratch(spark, "warc")
    shards = write_index(write_archives(pages, root), root)
    return read_captures(pages, root, shards)


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
q AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM q
"""
