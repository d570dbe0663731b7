"""Sorted hash arrays in the shared folder: counted by Spark, memory-mapped by workers.

Mappers fold the 64-bit keys of a task to (key, count) and pack them per bucket
(the key's top bits); one shuffle brings a bucket together; the reducer keeps
what it wants and writes one sorted array per bucket, many buckets a file. Keys are hashes, so buckets
are even whatever the data; a frequent key arrives once per flush of a task.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from terralens.llm.common import U64, filesystem, pack, released, unpack

BLOBS = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
BLOBS_DDL = "bucket int, blob binary"
#: Keys a mapper holds, at least and at most, before it folds and sends them.
FLUSH, FLUSH_MOST = 1_500_000, 12_000_000
#: Bits of the number of a shelf's file.
PART_BITS = 14


def bucket_bits(n_bytes: int, per_bucket: int = 32 << 20) -> int:
    """Bits of the bucket number: buckets follow the input's size, from 32 on (so that
    small tables use several tasks). The number is an int, whose 30 bits would do for
    an exabyte."""
    return min(30, max(5, (max(1, n_bytes) // per_bucket).bit_length()))


def flush_size(bits: int) -> int:
    """Keys a mapper holds: more where there are many buckets, so that a bucket's share
    stays worth a message."""
    return min(FLUSH_MOST, max(FLUSH, 64 << bits))


def bitmap(numbers, bits: int) -> np.ndarray:
    """A set of numbers of so many bits, as a bitmap."""
    out = np.zeros(max(1, (1 << bits) // 8), np.uint8)
    numbers = np.asarray(numbers, np.int64)
    np.bitwise_or.at(out, numbers >> 3, np.left_shift(1, numbers & 7).astype(np.uint8))
    return out


def has(filled: np.ndarray, bucket: int) -> bool:
    return bool(filled[bucket >> 3] >> (bucket & 7) & 1)


def fold(keys: np.ndarray, counts: np.ndarray | None = None):
    """Sorted distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    if counts is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.add.reduceat(counts, at)


def bucket_edges(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets present in sorted keys, and where each begins (and the last ends)."""
    top = (keys >> U64(64 - bits)).astype(np.int32)
    at = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))
    return top[at], np.append(at, len(keys))


def spool(arrays, bits: int, cap: int | None = None):
    """Batches of (bucket, packed keys and counts) from arrays of keys."""
    held, size, limit = [], 0, flush_size(bits)

    def flush():
        keys, counts = fold(np.concatenate(held))
        if not len(keys):
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in BLOBS.types], schema=BLOBS)
        counts = np.minimum(counts, cap).astype(np.uint8) if cap else counts.astype(np.int64)
        tops, at = bucket_edges(keys, bits)
        blobs = [pack(keys[a:b], counts[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(tops, pa.int32()), pa.array(blobs, pa.binary())], schema=BLOBS)

    for a in arrays:
        held.append(a)
        size += len(a)
        if size >= limit:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def by_bucket(batches):
    """(bucket, list of blobs) from batches sorted by bucket."""
    now, blobs = None, []
    for batch in batches:
        for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if b != now and blobs:
                yield now, blobs
                blobs = []
            now = b
            blobs.append(blob)
    if blobs:
        yield now, blobs


def merged(blobs: list[bytes], kind):
    """Folded keys and counts of one bucket."""
    parts = [unpack(b, kind) for b in blobs]
    return fold(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64))


def gathered(blob_df, parts: int, bits: int):
    """The blobs dealt by the shelf part that holds their bucket, sorted by bucket."""
    return blob_df.repartition(parts, F.shiftright("bucket", max(0, bits - PART_BITS))).sortWithinPartitions("bucket")


class Shelf:
    """Arrays of every bucket below a root. A file holds the buckets of one part, a run
    of bucket numbers, so there are 2**PART_BITS files at most, however many buckets;
    at its end stands where each bucket's arrays are."""

    def __init__(self, root: str, bits: int, kinds: dict):
        self.root, self.bits, self.kinds, self.parts = root, bits, kinds, None
        self.shift = max(0, bits - PART_BITS)

    def filled(self, parts) -> Shelf:
        """Tell which parts were written."""
        self.parts = bitmap(parts, self.bits - self.shift)
        return self

    def get(self, bucket: int) -> list[np.ndarray] | None:
        part = bucket >> self.shift
        if not has(self.parts, part):
            return None
        raw = Column.get(f"{self.root}/{part}", np.uint8)
        size = 16 * len(self.kinds) << self.shift
        table = raw[len(raw) - size :].view(np.int64).reshape(1 << self.shift, len(self.kinds), 2)
        places = table[bucket - (part << self.shift)]
        if places[0, 0] < 0:
            return None
        return [raw[at : at + n].view(kind) for (at, n), kind in zip(places.tolist(), self.kinds.values(), strict=True)]

    def writer(self) -> ShelfWriter:
        return ShelfWriter(self)


class ShelfWriter:
    """Writes the buckets of a task, which come in order, part by part. A part's file is
    written whole or not at all, so that a repeated or speculative task does no harm."""

    def __init__(self, shelf: Shelf):
        self.shelf, self.part, self.done = shelf, None, []

    def add(self, bucket: int, *arrays) -> None:
        part = bucket >> self.shelf.shift
        if part != self.part:
            self.close()
            self.part = part
            self.fsys, self.path = filesystem(f"{self.shelf.root}/{part}")
            self.fsys.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
            self.tmp, self.at = f"{self.path}.{uuid.uuid4().hex}.tmp", 0
            self.out = self.fsys.open_output_stream(self.tmp, compression=None)
            self.table = np.full((1 << self.shelf.shift, len(self.shelf.kinds), 2), -1, np.int64)
        for i, (a, kind) in enumerate(zip(arrays, self.shelf.kinds.values(), strict=True)):
            raw = np.ascontiguousarray(np.frombuffer(a, np.uint8) if isinstance(a, bytes) else np.asarray(a).astype(kind, copy=False)).tobytes()
            self.table[bucket - (part << self.shelf.shift), i] = self.at, len(raw)
            self.out.write(raw + bytes(-len(raw) % 8))
            self.at += len(raw) + -len(raw) % 8

    def close(self) -> list[int]:
        """Finish the part at hand; the parts written so far."""
        if self.part is not None:
            self.out.write(self.table.tobytes())
            self.out.close()
            self.fsys.move(self.tmp, self.path)
            self.done.append(self.part)
            self.part = None
        return self.done


def write_buckets(blob_df, shelf: Shelf, one) -> Shelf:
    """Deal the blobs out by bucket and write what ``one(blobs)`` makes of a bucket, if
    anything. Every task sends the numbers of its parts in one row."""
    def write(batches):
        out = shelf.writer()
        for bucket, blobs in by_bucket(batches):
            arrays = one(blobs)
            if len(arrays[0]):
                out.add(bucket, *arrays)
        yield pa.RecordBatch.from_pydict({"done": pa.array([np.array(out.close(), np.int32).tobytes()], pa.binary())})

    parts = int(blob_df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = gathered(blob_df, parts, shelf.bits).mapInArrow(released(write), "done binary").collect()
    return shelf.filled(np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(r[0], np.int32) for r in rows)]))


def written(blob_df, root: str, least: int, bits: int) -> Shelf:
    """Write the keys that occur ``least`` times or more as sorted arrays below ``root``."""
    def one(blobs):
        keys, counts = merged(blobs, np.uint8)
        return (keys[counts >= least],)

    return write_buckets(blob_df, Shelf(root, bits, {"key": U64}), one)


class Column:
    """One file as an array, memory-mapped where the shared folder is a mounted one."""

    _open: OrderedDict = OrderedDict()

    @classmethod
    def get(cls, uri: str, kind):
        if uri in cls._open:
            cls._open.move_to_end(uri)
            return cls._open[uri]
        if uri.startswith(("file:", "/")):
            path = filesystem(uri)[1]
            array = np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
        else:  # an object store has no mapping: the file is read, and few are held
            fsys, path = filesystem(uri)
            with fsys.open_input_file(path) as f:
                array = np.frombuffer(f.read(), kind)
        cls._open[uri] = array
        while len(cls._open) > (20_000 if uri.startswith(("file:", "/")) else 8):
            cls._open.popitem(last=False)
        return array

    @classmethod
    def close(cls, root: str) -> None:
        """Let go of the arrays below ``root``, so that deleting them frees their disk."""
        for uri in [u for u in cls._open if u.startswith(root)]:
            del cls._open[uri]


def find(shelf: Shelf, sorted_keys: np.ndarray) -> dict[str, np.ndarray]:
    """Rows of sorted keys in a shelf, whose first array is the keys; missing keys get
    zeros. ``found`` tells which are there."""
    names = list(shelf.kinds)[1:]
    out = {c: np.zeros(len(sorted_keys), shelf.kinds[c]) for c in names}
    out["found"] = np.zeros(len(sorted_keys), bool)
    if not len(sorted_keys):
        return out
    tops, at = bucket_edges(sorted_keys, shelf.bits)
    for b, lo, hi in zip(tops.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
        arrays = shelf.get(b)
        if arrays is None:
            continue
        keys, want = arrays[0], sorted_keys[lo:hi]
        i = np.searchsorted(keys, want)
        i[i == len(keys)] = 0
        hit = np.asarray(keys[i]) == want
        out["found"][lo:hi] = hit
        for c, column in zip(names, arrays[1:], strict=True):
            out[c][lo:hi][hit] = column[i[hit]]
    return out
