"""Shared helpers: scratch tables in the cluster's shared folder, and numpy
word spans / word hashes over the UTF-8 bytes of Arrow string columns."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# --------------------------------------------------------------------------
# shared folder


_OWN: list[str] = []
_MADE: list[str] = []


def shared_dir(spark) -> str:
    """Folder that the driver and all executors share (``spark.checkpoint.dir``),
    with the scheme of its file system.

    Where the session names none, a local session (as in tests) gets a fresh local
    folder. On a cluster there is none to take: driver and executors would each use
    a disk of their own, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="terralens-"))
        root = _OWN[0]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.makeQualified(path).toString().rstrip("/")


def scratch(spark, name: str) -> str:
    """A new, unique path below the shared folder."""
    _MADE.append(f"{shared_dir(spark)}/terralens/{name}-{uuid.uuid4().hex}")
    return _MADE[-1]


def scratch_made() -> int:
    """How many scratch paths there are so far, for ``drop_scratch``."""
    return len(_MADE)


def drop_scratch(spark, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Delete the scratch paths made since then but those to keep. A result that still
    reads them has to be written first."""
    for path in _MADE[since:]:
        if path not in keep:
            drop_path(spark, path)
    _MADE[since:] = [p for p in _MADE[since:] if p in keep]


def stash(df, name: str):
    """Write ``df`` to the shared folder and read it back: the lineage ends
    there and a lost executor costs only the rereading of a file."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_path(spark, path: str) -> None:
    """Delete a scratch path through the Hadoop file system that holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI, for Python on any executor."""
    import os

    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return fs.LocalFileSystem(), os.path.abspath(uri)
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, data) -> None:
    """Write a file whole or not at all: under a name of its own first, then
    renamed, so that a repeated or speculative task does no harm."""
    fsys, path = filesystem(uri)
    fsys.create_dir(path.rsplit("/", 1)[0], recursive=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    with fsys.open_output_stream(tmp) as out:
        out.write(memoryview(data).cast("B") if not isinstance(data, (bytes, bytearray)) else data)
    fsys.move(tmp, path)


# --------------------------------------------------------------------------
# memory of workers


def let_go() -> None:
    """Give freed memory back to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it keeps what it holds
        pass


def released(run):
    """``run`` over the batches of a task; then what it has freed goes back, since the
    worker stays, idle or for another task, beside those that do the next work."""

    def whole(batches):
        yield from run(batches)
        let_go()

    return whole


# --------------------------------------------------------------------------
# bytes, words, hashes

U64 = np.uint64
_WS = np.zeros(256, bool)
_WS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_PIECE = 1 << 20
#: Odd base of the polynomial word hash, and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> U64(27))
        x = x * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i < some size >= n."""
    size = 1 << max(12, int(n - 1).bit_length())
    if size not in _POW:
        with np.errstate(over="ignore"):
            p, q = np.full(size, _BASE, U64), np.full(size, _INV, U64)
            p[0] = q[0] = 1
            p, q = np.multiply.accumulate(p), np.multiply.accumulate(q)
        if size > 4 * _PIECE:
            return p, q
        _POW[size] = (p, q)
    return _POW[size]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of values[s:e] for every span, from one prefix sum."""
    if not len(starts):
        return np.zeros(0, U64)
    p, q = powers(len(values) + 1)
    with np.errstate(over="ignore"):
        acc = np.zeros(len(values) + 1, U64)
        np.cumsum((values.astype(U64) + U64(1)) * p[: len(values)], out=acc[1:])
        return mix64((acc[ends] - acc[starts]) * q[starts] + U64(0x632BE59BD9B4E019))


def text_bytes(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) else col
    col = pc.fill_null(col.cast(pa.large_string()), "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8)
    buf = col.buffers()[2]
    data = np.frombuffer(buf, np.uint8) if buf is not None and buf.size else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def pieces(batches, rows: int = 512):
    """The batches in parts of so many rows, so that only a part's texts are copied."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def row_slices(offs: np.ndarray, limit: int = 2 << 20):
    """Runs (lo, hi) of whole rows of at most ``limit`` bytes, one row at least."""
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def words(data: np.ndarray, offs: np.ndarray, lower: bool = False, breaks: np.ndarray = _WS):
    """Words ``[^\\x20\\x09-\\x0D]+`` of every row: (starts, ends, first word of
    each row, hashes). ``lower`` folds A-Z before hashing; ``breaks`` tells which
    bytes part words, if others do than white space."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64), np.zeros(0, U64)
    ws = breaks[data]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    prev = np.empty(n, bool)
    prev[0] = True
    np.logical_or(ws[:-1], first[1:n], out=prev[1:])
    starts = np.flatnonzero(prev & ~ws)
    nxt = np.empty(n, bool)
    nxt[-1] = True
    np.logical_or(ws[1:], first[1:n], out=nxt[:-1])
    ends = np.flatnonzero(nxt & ~ws) + 1
    rows = np.searchsorted(starts, offs)
    hashes = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        s = starts[i]
        j = max(i + 1, int(np.searchsorted(starts, s + _PIECE)))
        e = ends[j - 1]
        part = data[s:e]
        hashes[i:j] = span_hashes(LOWER[part] if lower else part, starts[i:j] - s, ends[i:j] - s)
        i = j
    return starts, ends, rows, hashes


def pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted u64 keys (as differences) and integer columns, byte planes apart,
    under zstd: about the entropy of the keys."""
    import zstandard

    delta = np.diff(keys, prepend=U64(0))
    parts = [delta.view(np.uint8).reshape(-1, 8).T.tobytes()]
    parts += [np.ascontiguousarray(c).view(np.uint8).reshape(len(keys), c.dtype.itemsize).T.tobytes() for c in columns]
    return zstandard.ZstdCompressor(level=1).compress(len(keys).to_bytes(8, "little") + b"".join(parts))


def unpack(blob: bytes, *dtypes) -> list[np.ndarray]:
    """Inverse of ``pack``."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for i, kind in enumerate((U64, *dtypes)):
        size = np.dtype(kind).itemsize
        planes = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n)
        col = np.ascontiguousarray(planes.T).view(kind).reshape(-1)
        out.append(np.cumsum(col, dtype=U64) if i == 0 else col)
        at += n * size
    return out
