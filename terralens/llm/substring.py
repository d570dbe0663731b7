"""Exact duplicate passages by a relative Lempel-Ziv parse.

The reference is the whole table, a block per document. Its index holds, as sorted
hash arrays, every passage of ``min_words`` words that stands at two places or more,
with two of these places (block and offset). A document is parsed from left to right:
at a word whose passage is in the index the parse takes the longest factor, which
goes on word by word as long as a known place of the next passage follows on, and
continues behind it. A factor is at least ``min_words`` long, so it is a duplicate
span. At a factor's end, passages that begin inside it and reach beyond are looked
up too: those found are duplicate spans of their own. No passage of the document is
left out by that, so the spans hold every word of every repeated passage.

Only passages with a repeated anchor are worth indexing. The anchor of a passage
is its least hash of ``min_words // 2 - 1`` consecutive words, so equal passages
have equal anchors, about one word in ten is one, and an anchor that occurs once
rules out all its passages. The text is read four times (its size, anchors, passages,
parse) and never shuffled.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.llm import hashindex as hx
from terralens.llm.common import U64, mix64, pack, powers, released, row_slices, scratch, span_hashes, text_bytes, unpack, words

_MAX = U64(0xFFFFFFFFFFFFFFFF)
#: A place is a block's number times 2**24 plus a word's offset.
_OFFSET = U64(24)


def slide(op, a: np.ndarray, width: int) -> np.ndarray:
    """op over every run of ``width`` values, by doubling."""
    size = 1
    while size * 2 <= width:
        a = op(a[:-size], a[size:])
        size *= 2
    return op(a[: len(a) - (width - size)], a[width - size :]) if size < width else a


def run_hashes(word_hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every k consecutive words."""
    n = len(word_hashes)
    p, q = powers(n + 1)
    with np.errstate(over="ignore"):
        acc = np.zeros(n + 1, U64)
        np.cumsum(word_hashes * p[:n], out=acc[1:])
        return mix64((acc[k:] - acc[:-k]) * q[: n - k + 1] + U64(k))


class Passages:
    """Anchors and passages of the rows of one slice."""

    def __init__(self, data, offs, min_words):
        self.w, self.k = min_words, max(1, min_words // 2 - 1)
        self.starts, self.ends, self.rows, self.hashes = words(data, offs)
        n = len(self.hashes)
        self.count = max(0, n - self.w + 1)
        if not self.count:
            return
        step = np.zeros(n + 1, np.int32)
        a, b = self.rows[:-1], self.rows[1:]
        long = b - a >= self.w
        np.add.at(step, a[long], 1)
        np.add.at(step, b[long] - self.w + 1, -1)
        self.valid = np.cumsum(step)[: self.count] > 0
        self.grams = run_hashes(self.hashes, self.k)
        self.span = self.w - self.k + 1
        self.least = slide(np.minimum, self.grams, self.span)
        seen = np.where(self.valid, self.least, U64(0))
        pad = np.zeros(self.span - 1, U64)
        self.is_anchor = slide(np.maximum, np.concatenate((pad, seen, pad)), self.span) == self.grams
        self.is_anchor &= self.grams > 0

    def anchors(self) -> np.ndarray:
        return self.grams[self.is_anchor] if self.count else np.zeros(0, U64)

    def candidates(self, index) -> np.ndarray:
        """Starts of the passages whose anchor is in the index of repeated anchors."""
        if not self.count:
            return np.zeros(0, np.int64)
        keys, back = np.unique(self.anchors(), return_inverse=True)
        kept = hx.find(index, keys)["found"][back]
        if not kept.any():
            return np.zeros(0, np.int64)
        grams = np.full(len(self.grams), _MAX, U64)
        at = np.flatnonzero(self.is_anchor)[kept]
        grams[at] = self.grams[at]
        return np.flatnonzero(self.valid & (slide(np.minimum, grams, self.span) == self.least))

    def passages(self, at: np.ndarray) -> np.ndarray:
        return run_hashes(self.hashes, self.w)[at] if len(at) else np.zeros(0, U64)

    def places(self, at: np.ndarray) -> np.ndarray:
        """Block (40 bits of the document's hash) and offset of each word of ``at``."""
        if not len(at):
            return np.zeros(0, U64)
        row = np.searchsorted(self.rows, at, "right") - 1
        block = span_hashes(self.hashes, self.rows[:-1], self.rows[1:]) >> _OFFSET << _OFFSET
        return block[row] + (at - self.rows[row]).astype(U64)


def factors(at: np.ndarray, own: np.ndarray, a: np.ndarray, b: np.ndarray, width: int):
    """Greedy parse over the passages of a slice that are in the index: ``at`` their
    first words, ``own`` their places, ``a`` and ``b`` two places of each in the
    reference. Returns (first word, words, source place, is a boundary's) of every span.
    """
    n = len(at)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, U64), np.zeros(0, bool)
    # two sources a passage, neither of them the passage itself
    source = np.concatenate((np.where(a == own, b, a), np.where(b == own, a, b)))
    nxt = np.full(2 * n + 1, 2 * n)
    with np.errstate(over="ignore"):
        on = (at[1:] == at[:-1] + 1) & (own[1:] == own[:-1] + U64(1))
        for s in (0, n):
            for t in (n, 0):
                j = np.flatnonzero(on & (source[t + 1 : t + n] == source[s : s + n - 1] + U64(1)))
                nxt[s + j] = t + j + 1
    # passages in a row from each on, by doubling
    length = np.ones(2 * n + 1, np.int64)
    length[-1] = 0
    while (nxt < 2 * n).any():
        length, nxt = length + length[nxt], nxt[nxt]
    second = length[n:-1] > length[:n]
    longest, source = np.where(second, length[n:-1], length[:n]), np.where(second, source[n:], source[:n])
    where, run = at.tolist(), longest.tolist()
    taken, beyond, j = [], [], 0
    while j < n:
        taken.append(j)
        end = where[j] + run[j] + width - 1
        j += run[j]
        k = bisect_left(where, end, j)
        beyond += range(j, k)  # begin in the factor and end behind it
        j = k
    pick = np.array(taken + beyond, np.int64)
    count = longest[pick]
    count[len(taken) :] = 1
    edge = np.arange(len(pick)) >= len(taken)
    order = np.argsort(at[pick], kind="stable")
    pick = pick[order]
    return at[pick], count[order] + width - 1, source[pick], edge[order]


def _slices(batches, column=0):
    for batch in batches:
        data, offs = text_bytes(batch.column(column))
        for lo, hi in row_slices(offs):
            yield batch, lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]


def _first_two(keys: np.ndarray, places: np.ndarray, by_place: bool = False):
    """Sorted keys with the places of two rows of each at most."""
    order = np.lexsort((places, keys)) if by_place else np.argsort(keys, kind="stable")
    keys, places = keys[order], places[order]
    third = np.zeros(len(keys), bool)
    third[2:] = (keys[2:] == keys[1:-1]) & (keys[2:] == keys[:-2])
    return keys[~third], places[~third]


def _spool_places(pairs, bits: int):
    """Batches of (bucket, packed keys and places) from pairs of arrays."""
    held, size, limit = [], 0, hx.flush_size(bits)

    def flush():
        keys, places = _first_two(*(np.concatenate(x) for x in zip(*held, strict=True)))
        tops, at = hx.bucket_edges(keys, bits) if len(keys) else ([], [0])
        blobs = [pack(keys[a:b], places[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(tops, pa.int32()), pa.array(blobs, pa.binary())], schema=hx.BLOBS)

    for keys, places in pairs:
        held.append((keys, places))
        size += len(keys)
        if size >= limit:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def duplicate_index(df: DataFrame, text_col: str = "text", min_words: int = 35):
    """The two indexes of a table: repeated anchors, and repeated passages with two places."""
    spark = df.sparkSession
    texts = df.select(F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = hx.bucket_bits(size)

    def anchors(batches):
        yield from hx.spool((Passages(d, o, min_words).anchors() for _, _, _, d, o in _slices(batches)), bits, 2)

    first = hx.written(texts.mapInArrow(released(anchors), hx.BLOBS_DDL), scratch(spark, "anchors"), 2, bits)

    def passages(batches):
        def each():
            for _, _, _, d, o in _slices(batches):
                p = Passages(d, o, min_words)
                at = p.candidates(first)
                yield p.passages(at), p.places(at)

        yield from _spool_places(each(), bits)

    def two_places(blobs):
        parts = [unpack(x, U64) for x in blobs]
        keys, places = _first_two(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), True)
        at = np.flatnonzero(keys[1:] == keys[:-1])
        return keys[at], places[at], places[at + 1]

    shelf = hx.Shelf(scratch(spark, "passages"), bits, {"key": U64, "a": U64, "b": U64})
    return first, hx.write_buckets(texts.mapInArrow(released(passages), hx.BLOBS_DDL), shelf, two_places)


def _parse(batches, index, min_words, emit):
    """emit(row bytes, word starts, word ends, covered, factors) for every row; factors
    are as ``factors`` gives them, in the order of the text."""
    first, second = index
    for batch, lo, hi, data, offs in _slices(batches, 1):
        p = Passages(data, offs, min_words)
        at = p.candidates(first)
        keys, back = np.unique(p.passages(at), return_inverse=True)
        known = hx.find(second, keys)
        there = known["found"][back]
        at, back = at[there], back[there]
        spans = factors(at, p.places(at), known["a"][back], known["b"][back], min_words)
        step = np.zeros(len(p.hashes) + 1, np.int32)
        np.add.at(step, spans[0], 1)
        np.add.at(step, spans[0] + spans[1], -1)
        covered = np.cumsum(step)[:-1] > 0
        edges = np.searchsorted(spans[0], p.rows).tolist()
        rows, offs = p.rows.tolist(), offs.tolist()
        done = []
        for i in range(hi - lo):
            a, b, o = rows[i], rows[i + 1], offs[i]
            mine = slice(edges[i], edges[i + 1])
            done.append(emit(data[o : offs[i + 1]], p.starts[a:b] - o, p.ends[a:b] - o, covered[a:b], (spans[0][mine] - a, *(x[mine] for x in spans[1:]))))
        yield batch.slice(lo, hi - lo), done
    for shelf in index:
        hx.Column.close(shelf.root)


def _spans(covered: np.ndarray):
    edge = np.diff(np.concatenate(([0], covered.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _without(raw: np.ndarray, starts, ends, covered) -> str:
    """The row's text less its duplicate spans; the white space after one goes with it."""
    if not covered.any():
        return raw.tobytes().decode()
    keep, data = [], raw.tobytes()
    at = 0
    for s, e in zip(*_spans(covered), strict=True):
        keep.append(data[at : starts[s]])
        at = starts[e] if e < len(starts) else len(data)
    return b"".join([*keep, data[at:]]).decode()


def duplicate_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 35) -> DataFrame:
    """(id, n_words, spans, factors, kept_text) of every row; a span is (first word, end
    word). A factor is (first word, words, block, offset, boundary): where it stands
    here and, by the hash of its document and the place of its first word, there;
    boundary tells those found at the end of another.

    A null text counts as empty, and texts of fewer than ``min_words`` words have
    no span. Repeated rows duplicate each other and lose every word (if long
    enough). An empty table gives an empty result; extra columns are not read.
    """
    index = duplicate_index(df, text_col, min_words)

    def emit(raw, starts, ends, covered, found):
        s, e = _spans(covered)
        listed = [
            {"start": a, "words": n, "block": src >> 24, "offset": src & 0xFFFFFF, "boundary": edge}
            for a, n, src, edge in zip(*(x.tolist() for x in found), strict=True)
        ]
        return len(starts), [{"start": int(a), "end": int(b)} for a, b in zip(s, e, strict=True)], listed, _without(raw, starts, ends, covered)

    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    factor = pa.struct([("start", pa.int64()), ("words", pa.int64()), ("block", pa.int64()), ("offset", pa.int64()), ("boundary", pa.bool_())])
    schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(span)), ("factors", pa.list_(factor)), ("kept_text", pa.string())])

    def run(batches):
        for rows, done in _parse(batches, index, min_words, emit):
            cols = list(zip(*done, strict=True))
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, t) for c, t in zip(cols, schema.types[1:], strict=True))], schema=schema)

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ddl = "id long, n_words long, spans array<struct<start:long,end:long>>, factors array<struct<start:long,words:long,block:long,offset:long,boundary:boolean>>, kept_text string"
    return src.mapInArrow(released(run), ddl).withColumnRenamed("id", id_col)


def remove_duplicate_passages(df: DataFrame, text_col: str = "text", min_words: int = 35) -> DataFrame:
    """The same rows and columns, the text without its duplicate spans."""
    index = duplicate_index(df, text_col, min_words)
    order = [text_col, *(c for c in df.columns if c != text_col)]

    def emit(raw, starts, ends, covered, found):
        return _without(raw, starts, ends, covered)

    def run(batches):
        flipped = (pa.RecordBatch.from_arrays([b.column(0), *b.columns], names=["", *b.schema.names]) for b in batches)
        for rows, done in _parse(flipped, index, min_words, emit):
            text = pa.array([None if old is None else t for t, old in zip(done, rows.column(1).to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([text, *rows.columns[2:]], names=rows.schema.names[1:])

    src = df.select(*[f"`{c}`" for c in order])
    return src.mapInArrow(released(run), src.schema).select(*[f"`{c}`" for c in df.columns])


def op10_substring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = duplicate_index(docs, "text", 35)

    def emit(raw, starts, ends, covered, found):
        tokens, gone = raw.tobytes().split(), int(covered.sum())
        kept = b" ".join(compress(tokens, (~covered).tolist()) if gone else tokens)
        return len(tokens), gone, hashlib.sha256(kept).hexdigest()

    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches):
        for rows, done in _parse(batches, index, 35, emit):
            cols = list(zip(*done, strict=True))
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(c, t) for c, t in zip(cols, schema.types[1:], strict=True))], schema=schema)

    src = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return src.mapInArrow(released(run), "doc_id long, n_words long, n_removed long, kept_sha256 string")


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS t FROM documents),
pos AS (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i FROM w),
h AS (SELECT doc_id, i, t[i] AS word, CASE WHEN i + 34 <= len(t) THEN md5(array_to_string(t[i : i + 34], ' ')) END AS h FROM pos),
r AS (SELECT h FROM h WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
m AS (SELECT h.doc_id, i, word, max((r.h IS NOT NULL)::INT) OVER (PARTITION BY h.doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
  FROM h LEFT JOIN r ON h.h = r.h),
k AS (SELECT doc_id, sum(gone)::BIGINT AS n, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0), '')) AS kept FROM m GROUP BY doc_id)
SELECT w.doc_id, len(t)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, coalesce(kept, sha256('')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
