"""Interpolated modified Kneser-Ney trigram model over hashed words.

Counting: mappers fold the trigrams (u, v, w) of a task, pack them per bucket and one
shuffle brings a bucket together. A bucket is named by the middle word, so the counts
of the context (u, v) and the contexts of the pair (v, w) are whole in it. A middle word
that would fill more than two buckets by itself is spread by u, and a pair (u, v) that
would by w; their sums meet in a second, small shuffle. Storage: per bucket sorted
hash arrays of trigrams (count), pairs (number of contexts) and contexts that occur
twice or more (count, words seen once, twice, more often), and arrays of words. Scoring: workers map these arrays
into memory and search them; no model is collected, broadcast or joined.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.llm import hashindex as hx
from terralens.llm.common import U64, mix64, pack, pieces, released, row_slices, scratch, stash, text_bytes, unpack, words

#: Words are told apart by the upper 48 bits of their hash.
_HIGH = U64(0xFFFFFFFFFFFF0000)
END, BOS = U64(0x8C3A5D1E77F20000), U64(0x3F19C2E4A6D80000)
#: Tokens that a mapper folds at once; their numbers have to fit 21 bits.
TOKENS = 1_200_000
#: Bytes of text whose trigrams make a bucket.
BUCKET_BYTES = 16 << 20
#: Bytes of text that are tokenised at once.
SLICE = 1 << 20
#: Buckets that a word fills by itself before it is spread, and sampled tokens per bucket.
SPREAD, SAMPLED = 2, 64
WORD_COLUMNS = {"key": U64, "c": np.int64, "nc": np.int64, "cx": np.int64, "g": np.float64}
_ROWS = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary())])
_ROWS_DDL = "kind int, bucket int, blob binary"
#: Kinds of rows that the first reducers send on.
_STATS, _WORDS, _MIDDLES, _PAIRS, _CONTEXTS = range(5)


def tokens(data: np.ndarray, offs: np.ndarray):
    """(two before, one before, token, first token of each row): the words of every row,
    A-Z folded, then one end; two starts come before the first token."""
    _, _, rows, hashes = words(data, offs, lower=True)
    n = len(offs) - 1
    first = rows + np.arange(n + 1)
    seq = np.full(len(hashes) + n, END, U64)
    seq[np.arange(len(hashes)) + np.repeat(np.arange(n), np.diff(rows))] = hashes & _HIGH
    one, two = np.full(len(seq), BOS, U64), np.full(len(seq), BOS, U64)
    one[1:] = seq[:-1]
    one[first[:-1]] = BOS
    two[1:] = one[:-1]
    two[first[:-1]] = BOS
    return two, one, seq, first


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(a) + b)


def triple_key(u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(mix64(mix64(u) + v) + w)


#: Key of the context of a row's first token, which is no pair of tokens.
_STARTS = pair_key(np.array([BOS]), np.array([BOS]))[0]


class Places:
    """Which bucket holds what; ``hot_words`` and ``hot_pairs`` are sorted keys with the
    bits by which each is spread."""

    def __init__(self, bits: int, hot_words: dict[int, int], hot_pairs: dict[int, int]):
        self.bits = bits
        self.words, self.word_bits = self._sorted(hot_words)
        self.pairs, self.pair_bits = self._sorted(hot_pairs)

    @staticmethod
    def _sorted(found):
        keys = np.array(sorted(found), U64)
        return keys, np.array([found[int(k)] for k in keys], np.int64)

    @staticmethod
    def _at(keys, asked):
        if not len(keys):
            return np.full(len(asked), -1)
        i = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where(keys[i] == asked, i, -1)

    def top(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U64(64 - self.bits)).astype(np.int32)

    def hot_word(self, v: np.ndarray) -> np.ndarray:
        return self._at(self.words, v) >= 0

    def hot_pair(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return self._at(self.pairs, pair_key(u, v)) >= 0 if len(self.pairs) else np.zeros(len(u), bool)

    def triple(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Bucket of a trigram, which is that of its context unless the pair is hot."""
        key = v.copy()
        i = self._at(self.words, v)
        hot = np.flatnonzero(i >= 0)
        if len(hot):
            key[hot] = mix64(v[hot] ^ mix64((u[hot] >> (U64(64) - self.word_bits[i[hot]].astype(U64))) + U64(1)))
            pair = pair_key(u[hot], v[hot])
            j = self._at(self.pairs, pair)
            both = np.flatnonzero(j >= 0)
            at = hot[both]
            key[at] = mix64(pair[both] ^ mix64((w[at] >> (U64(64) - self.pair_bits[j[both]].astype(U64))) + U64(1)))
        return self.top(key)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts from the numbers of grams seen once to four times;
    where a small table leaves one undefined or out of range, an absolute one."""
    n1, n2, n3, n4 = (float(x) for x in n)
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d1 = 1 - 2 * y * n2 / n1
    d2 = 2 - 3 * y * n3 / n2
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return tuple(min(max(d, 0.05), k) for k, d in ((0.99, d1), (1.98, d2), (2.97, d3)))


def _discount(counts: np.ndarray, d) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal sorted keys begins."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def _counts_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype(np.int64)


# --------------------------------------------------------------------------
# packed arrays


class Packed:
    """Sorted 64-bit keys, of which a directory holds the upper bits and an array the
    next 32, with a row of small numbers each: a byte names one of 255 frequent rows,
    and the rare others stand apart. Some six bytes an entry; two keys of an array are
    told apart by 32 bits and four less than its length has."""

    @staticmethod
    def build(keys: np.ndarray, columns: list[np.ndarray]) -> bytes:
        n, m = len(keys), len(columns)
        t = max(1, n.bit_length() - 4)
        top = (keys >> U64(64 - t)).astype(np.int64)
        directory = np.searchsorted(top, np.arange((1 << t) + 1)).astype(np.uint32)
        low = (keys << U64(t) >> U64(32)).astype(np.uint32)
        small = np.ones(n, bool)
        packed = np.zeros(n, np.int64)
        width = 60 // m
        for i, c in enumerate(columns):
            small &= c < 1 << width
            packed |= np.where(c < 1 << width, c, 0) << (width * i)
        kinds, back, times = np.unique(packed, return_inverse=True, return_counts=True)
        often = np.argsort(-times, kind="stable")[:255]
        number = np.full(len(kinds), 255, np.int64)
        number[often] = np.arange(len(often))
        code = np.where(small, number[back], 255).astype(np.uint8)
        rare = np.flatnonzero(code == 255)
        table = np.stack([(kinds[often] >> (width * i)) & ((1 << width) - 1) for i in range(m)], axis=1) if n else np.zeros((0, m), np.int64)
        others = np.stack([c[rare] for c in columns], axis=1).astype(np.int64)
        head = np.array([t, n, m, len(table), len(rare)], np.int64)
        return b"".join(np.ascontiguousarray(x).tobytes() for x in (head, table, others, directory, low, rare.astype(np.uint32), code))

    def __init__(self, raw: np.ndarray):
        t, n, m, k, r = (int(x) for x in raw[:40].view(np.int64))
        at = 40
        self.t, self.parts = t, []
        for size, kind in ((k * m, np.int64), (r * m, np.int64), ((1 << t) + 1, np.uint32), (n, np.uint32), (r, np.uint32), (n, np.uint8)):
            end = at + size * np.dtype(kind).itemsize
            self.parts.append(raw[at:end].view(kind))
            at = end
        self.table, self.others = self.parts[0].reshape(k, m), self.parts[1].reshape(r, m)
        self.directory, self.low, self.rare, self.code = self.parts[2:]
        self.m = m

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which are there, their rows; zeros for the others)"""
        top = (keys >> U64(64 - self.t)).astype(np.int64)
        want = (keys << U64(self.t) >> U64(32)).astype(np.uint32)
        lo, end = self.directory[top].astype(np.int64), self.directory[top + 1].astype(np.int64)
        hi = end.copy()
        for _ in range(int((end - lo).max(initial=0)).bit_length()):
            mid = (lo + hi) >> 1
            open_ = lo < hi
            less = open_ & (self.low[np.where(open_, mid, 0)] < want)
            lo, hi = np.where(less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        found = lo < end
        found[found] = self.low[lo[found]] == want[found]
        rows = np.zeros((len(keys), self.m), np.int64)
        at = lo[found]
        code = self.code[at].astype(np.int64)
        got = self.table[np.minimum(code, max(0, len(self.table) - 1))] if len(self.table) else np.zeros((len(at), self.m), np.int64)
        big = np.flatnonzero(code == 255)
        if len(big):
            got = np.array(got)
            got[big] = self.others[np.searchsorted(self.rare, at[big].astype(np.uint32))]
        rows[found] = got
        return found, rows


class Store:
    """Packed arrays with ``m`` numbers an entry, one for each bucket of a shelf."""

    def __init__(self, shelf: hx.Shelf, m: int):
        self.shelf, self.m = shelf, m

    def find(self, keys: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        there, rows = np.zeros(len(keys), bool), np.zeros((len(keys), self.m), np.int64)
        order = np.argsort(buckets, kind="stable")
        at = np.append(_runs(buckets[order]), len(order))
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            some = order[lo:hi]
            arrays = self.shelf.get(int(buckets[some[0]]))
            if arrays is not None:
                there[some], rows[some] = Packed(arrays[0]).find(keys[some])
        return there, rows


# --------------------------------------------------------------------------
# counting


def _planes(x: np.ndarray, size: int) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)[:, :size].T.tobytes()


def _from_planes(raw: bytes, at: int, n: int, size: int, kind) -> tuple[np.ndarray, int]:
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T
    return out.view(kind).reshape(-1), at + n * size


def _pack_triples(known: np.ndarray, u, v, w, count) -> bytes:
    """Trigrams, sorted by v and u, as numbers of the blob's own words, frequent ones first
    (by powers of four, and by hash within one), so that most numbers are small."""
    used, back, times = np.unique(np.concatenate((u, v, w)), return_inverse=True, return_counts=True)
    order = np.argsort(-(np.frexp(times)[1] // 2), kind="stable")
    place = np.empty(len(used), np.uint32)
    place[order] = np.arange(len(used), dtype=np.uint32)
    used, back = used[order], place[back]
    u, v, w = np.split(back, 3)
    order = np.lexsort((u, v))
    u, v, w, count = u[order], v[order], w[order], count[order]
    # u goes up within each v
    up = np.diff(u, prepend=np.uint32(0))
    at = _runs(v)
    up[at] = u[at]
    parts = [_planes(np.diff(known[used] >> U64(16), prepend=U64(0)), 6), _planes(np.diff(v, prepend=np.uint32(0)), 4), _planes(up, 4), _planes(w, 4), _planes(count.astype(np.uint32), 4)]
    head = np.array([len(used), len(u)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(parts))


def _unpack_triples(blob: bytes):
    raw = zstandard.ZstdDecompressor().decompress(blob)
    k, n = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    known, at = _from_planes(raw, 16, k, 6, U64)
    known = np.cumsum(known, dtype=U64) << U64(16)
    out = []
    for _ in range(4):
        x, at = _from_planes(raw, at, n, 4, np.uint32)
        out.append(x)
    v, up, w, count = out
    v = np.cumsum(v, dtype=np.uint32)
    at, u = _runs(v), np.cumsum(up, dtype=np.uint32)
    u -= np.repeat(u[at] - up[at], np.diff(np.append(at, n)))
    return known[u], known[v], known[w], count.astype(np.int64)


def _triple_blobs(batches, places: Places):
    held, size = [], 0

    def flush():
        starts = np.cumsum([0, *(len(x[0]) for x in held[:-1])])
        u, v, w = (np.concatenate(x) for x in zip(*held, strict=True))
        known = np.unique(np.concatenate((w, [BOS], u[starts], v[starts])))
        # the word before is the token before, unless a row or a piece of one begins
        number = lambda x: np.searchsorted(known, x).astype(U64)
        bos, numbers = number(BOS), [number(w)]
        for before in (v, u):
            n = np.roll(numbers[-1], 1)
            n[before == BOS] = bos
            n[starts] = number(before[starts])
            numbers.append(n)
        triple = np.sort(numbers[1] << U64(42) | numbers[2] << U64(21) | numbers[0])
        at = _runs(triple)
        count, triple = np.diff(np.append(at, len(triple))), triple[at]
        mask = U64((1 << 21) - 1)
        v, u, w = ((triple >> U64(s) & mask).astype(np.int64) for s in (42, 21, 0))
        bucket = places.triple(known[u], known[v], known[w])
        order = np.argsort(bucket.astype(np.uint16) if places.bits <= 16 else bucket, kind="stable")
        edge = np.append(_runs(bucket[order]), len(order))
        blobs = [_pack_triples(known, u[i], v[i], w[i], count[i]) for i in (order[a:b] for a, b in zip(edge[:-1], edge[1:], strict=True))]
        return pa.RecordBatch.from_arrays([pa.array(bucket[order[edge[:-1]]], pa.int32()), pa.array(blobs, pa.binary())], schema=hx.BLOBS)

    for batch in pieces(batches):
        data, offs = text_bytes(batch.column(0))
        for lo, hi in row_slices(offs, SLICE):
            u, v, w, _ = tokens(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            for i in range(0, len(w), TOKENS):  # a very long row by itself
                part = slice(i, i + TOKENS)
                if size + len(w[part]) > TOKENS and held:
                    yield flush()
                    held, size = [], 0
                held.append((u[part], v[part], w[part]))
                size += len(w[part])
    if held:
        yield flush()


def hot_places(texts: DataFrame, size: int, bits: int, spread: float = SPREAD) -> Places:
    """Words and pairs that fill more than ``spread`` buckets, by a sample of the rows.

    The sample only decides where things are counted, not what; it has some 64 tokens
    a bucket, 4 MB of text at least. There are at most as many hot words as buckets.
    """
    share = min(1.0, max(SAMPLED * 6 << bits, 4 << 20) / max(1, size))
    sample = texts if share >= 1 else texts.filter(F.rand(29) < share)

    def run(batches):
        for batch in pieces(batches):
            data, offs = text_bytes(batch.column(0))
            for lo, hi in row_slices(offs, SLICE):
                u, v, _, _ = tokens(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                (a, na), (b, nb) = hx.fold(v), hx.fold(pair_key(u, v))
                kind = np.repeat(np.array([0, 1], np.int32), [len(a), len(b)])
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate((a, b)).view(np.int64)), pa.array(np.concatenate((na, nb)))], names=["kind", "key", "n"])

    counted = sample.mapInArrow(released(run), "kind int, key long, n long")
    total = F.sum(F.when(F.col("kind") == 0, F.col("n")))
    seen = counted.agg(total.alias("n")).first()["n"] or 0
    least = max(8.0, spread * seen / (1 << bits))
    rows = counted.groupBy("kind", "key").agg(F.sum("n").alias("n")).filter(F.col("n") > least).collect()
    found: tuple[dict, dict] = ({}, {})
    for r in rows:
        found[r["kind"]][r["key"] & (1 << 64) - 1] = max(1, int(np.ceil(np.log2(r["n"] * (1 << bits) / seen))))
    # a pair is spread only where its second word is
    return Places(bits, found[0], found[1])


def _send(rows: list, kind: int, keys: np.ndarray, places: Places, *columns: np.ndarray) -> None:
    """Rows (kind, bucket, blob) of sorted keys."""
    if not len(keys):
        return
    tops, edge = hx.bucket_edges(keys, places.bits)
    rows += [(kind, int(t), pack(keys[a:b], *(c[a:b].astype(np.int64) for c in columns))) for t, a, b in zip(tops, edge[:-1], edge[1:], strict=True)]


def _sums(keys: np.ndarray, *columns: np.ndarray):
    """Sorted distinct keys and the sums of the columns."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = _runs(keys)
    return keys[at], *(np.add.reduceat(c[order].astype(np.int64), at) if len(at) else np.zeros(0, np.int64) for c in columns)


def _of_pairs(rows: list, v: np.ndarray, w: np.ndarray, nc: np.ndarray, places: Places):
    """Send on what pairs (v, w) with their numbers of contexts tell of their words."""
    key, kinds = _sums(w, np.ones(len(w), np.int64))
    _send(rows, _WORDS, key, places, np.zeros(len(key), np.int64), kinds)
    key, *sums = _sums(v, nc, nc == 1, nc == 2, nc >= 3)
    _send(rows, _MIDDLES, key, places, *sums)


def _batch(rows: list):
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ROWS.types, strict=True)], schema=_ROWS)


def train(df: DataFrame, text_col: str = "text", spread: float = SPREAD) -> dict:
    """Count the words, pairs and trigrams of all rows and write the model to the shared
    folder.

    Returns its description: places, discounts, N (training tokens), V (distinct
    ones). A null text counts as empty and adds one end; an empty table gives a
    model without tokens.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(F.col(text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = hx.bucket_bits(size, BUCKET_BYTES)
    places = hot_places(texts, size, bits, spread)
    shelf = {k: hx.Shelf(scratch(spark, k), bits, {"packed": np.uint8}) for k in ("triples", "contexts", "pairs", "hot-contexts", "hot-pairs")}
    words_shelf = hx.Shelf(scratch(spark, "words"), bits, WORD_COLUMNS)

    def reduce_triples(batches):
        out = {k: shelf[k].writer() for k in ("triples", "contexts", "pairs")}
        seen = {"triples": np.zeros(4, np.int64), "pairs": np.zeros(4, np.int64)}

        def keep(name, bucket, keys, columns):
            if len(keys):
                out[name].add(bucket, Packed.build(keys, columns))

        for bucket, blobs in hx.by_bucket(batches):
            parts_ = [_unpack_triples(blobs.pop()) for _ in range(len(blobs))]
            u, v, w, count = (np.concatenate([p[i] for p in parts_]) for i in range(4))
            del parts_
            key = triple_key(u, v, w)
            order = np.argsort(key)
            key, count = key[order], count[order]
            at = _runs(key)
            key, count, first = key[at], np.add.reduceat(count, at), order[at]
            u, v, w = u[first], v[first], w[first]
            del order, first
            keep("triples", bucket, key, [count])
            seen["triples"] += _counts_of_counts(count)
            rows: list = []
            key, times = _sums(w, count)
            _send(rows, _WORDS, key, places, times, np.zeros(len(key), np.int64))
            # contexts (u, v)
            hot = places.hot_pair(u, v)
            for chosen in (~hot, hot):
                n = count[chosen]
                ctx = _sums(pair_key(u[chosen], v[chosen]), n, n == 1, n == 2, n >= 3)
                if chosen is hot:
                    _send(rows, _CONTEXTS, ctx[0], places, *ctx[1:])
                else:  # a context that occurs once is known by its pair, which is kept as one
                    often = (ctx[1] > 1) | (ctx[0] == _STARTS)
                    keep("contexts", bucket, ctx[0][often], [x[often] for x in ctx[1:]])
            # pairs (v, w): a trigram is a context of its pair
            hot = places.hot_word(v)
            for chosen in (~hot, hot):
                key = pair_key(v[chosen], w[chosen])
                order = np.argsort(key)
                key, at = key[order], _runs(key[order])
                nc, first = np.diff(np.append(at, len(key))), order[at]
                a, b = v[chosen][first], w[chosen][first]
                if chosen is hot:
                    _send(rows, _PAIRS, key[at], places, nc, a.view(np.int64), b.view(np.int64))
                else:
                    keep("pairs", bucket, key[at], [nc])
                    seen["pairs"] += _counts_of_counts(nc)
                    _of_pairs(rows, a, b, nc, places)
            yield _batch(rows)
        told = [np.concatenate((seen["triples"], seen["pairs"])), *(np.array(w.close(), np.int64) for w in out.values())]
        yield _batch([(_STATS, i, x.tobytes()) for i, x in enumerate(told)])

    def reduce_hot(batches):
        """Contexts and pairs that several buckets hold a part of."""
        out = {k: shelf[k].writer() for k in ("hot-contexts", "hot-pairs")}
        seen, now, rows = np.zeros(4, np.int64), None, {_CONTEXTS: [], _PAIRS: []}

        def close():
            sent: list = []
            if rows[_CONTEXTS]:
                got = [unpack(x, *[np.int64] * 4) for x in rows[_CONTEXTS]]
                key, *cols = _sums(*(np.concatenate([g[i] for g in got]) for i in range(5)))
                out["hot-contexts"].add(now, Packed.build(key, cols))
            if rows[_PAIRS]:
                key, nc, v, w = (np.concatenate(x) for x in zip(*(unpack(x, *[np.int64] * 3) for x in rows[_PAIRS]), strict=True))
                order = np.argsort(key)
                at = _runs(key[order])
                nc, first = np.add.reduceat(nc[order], at), order[at]
                out["hot-pairs"].add(now, Packed.build(key[first], [nc]))
                seen[:] += _counts_of_counts(nc)
                _of_pairs(sent, v[first].view(U64), w[first].view(U64), nc, places)
            return sent

        for batch in batches:
            for kind, bucket, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and now is not None:
                    if sent := close():
                        yield _batch(sent)
                    rows = {_CONTEXTS: [], _PAIRS: []}
                now = bucket
                rows[kind].append(blob)
        if now is not None and (sent := close()):
            yield _batch(sent)
        told = [seen, *(np.array(w.close(), np.int64) for w in out.values())]
        yield _batch([(_STATS, i, x.tobytes()) for i, x in enumerate(told)])

    def told(table):
        """What the tasks of a stage tell: a few rows from each."""
        out: dict[int, list] = {}
        for r in table.filter(F.col("kind") == _STATS).select("bucket", "blob").collect():
            out.setdefault(r["bucket"], []).append(np.frombuffer(r["blob"], np.int64))
        return out

    def store(name, lists, m):
        return Store(shelf[name].filled(np.concatenate([np.zeros(0, np.int64), *lists])), m)

    blobs = texts.mapInArrow(released(lambda it: _triple_blobs(it, places)), hx.BLOBS_DDL)
    reduced = stash(hx.gathered(blobs, parts, bits).mapInArrow(released(reduce_triples), _ROWS_DDL), "triple-stats")
    told_one = told(reduced)
    seen = sum(told_one.get(0, []), np.zeros(8, np.int64))
    pair_seen, stats, hot_filled = seen[4:].copy(), reduced, [[], []]
    if len(places.words):
        part = reduced.filter(F.col("kind").isin(_PAIRS, _CONTEXTS))
        merged = stash(hx.gathered(part, parts, bits).mapInArrow(released(reduce_hot), _ROWS_DDL), "hot-stats")
        told_two = told(merged)
        pair_seen += sum(told_two.get(0, []), np.zeros(4, np.int64))
        hot_filled = [told_two.get(1, []), told_two.get(2, [])]
        stats = reduced.unionByName(merged)
    triple_d, pair_d = discounts(seen[:4].tolist()), discounts(pair_seen.tolist())

    def reduce_words(batches):
        out, now, rows = words_shelf.writer(), None, {_WORDS: [], _MIDDLES: []}
        counts = np.zeros(8, np.int64)

        def close():
            empty = [np.zeros(0, U64), *[np.zeros(0, np.int64)] * 4]
            w = [unpack(x, np.int64, np.int64) for x in rows[_WORDS]] or [empty[:3]]
            m = [unpack(x, *[np.int64] * 4) for x in rows[_MIDDLES]] or [empty]
            wk, c, nc = _sums(*(np.concatenate([g[i] for g in w]) for i in range(3)))
            mk, *mid = _sums(*(np.concatenate([g[i] for g in m]) for i in range(5)))
            key = np.union1d(wk, mk)
            cols = np.zeros((6, len(key)), np.int64)
            cols[:2, np.searchsorted(key, wk)] = c, nc
            cols[2:, np.searchsorted(key, mk)] = mid
            g = (pair_d[0] * cols[3] + pair_d[1] * cols[4] + pair_d[2] * cols[5]) / np.maximum(cols[2], 1)
            out.add(now, key, cols[0], cols[1], cols[2], g)
            counts[:4] += [(cols[0] > 0).sum(), cols[0].sum(), cols[1].sum(), 0]
            counts[4:] += _counts_of_counts(cols[1])

        for batch in batches:
            for kind, bucket, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and now is not None:
                    close()
                    rows = {_WORDS: [], _MIDDLES: []}
                now = bucket
                rows[kind].append(blob)
        if now is not None:
            close()
        yield _batch([(_STATS, 0, counts.tobytes()), (_STATS, 1, np.array(out.close(), np.int64).tobytes())])

    dealt = hx.gathered(stats.filter(F.col("kind").isin(_WORDS, _MIDDLES)), parts, bits)
    last: dict[int, list] = {0: [], 1: []}
    for r in dealt.mapInArrow(released(reduce_words), _ROWS_DDL).collect():  # two rows a task
        last[r["bucket"]].append(np.frombuffer(r["blob"], np.int64))
    total = sum(last[0], np.zeros(8, np.int64))
    V, N, S = (int(x) for x in total[:3])
    return {
        "places": places, "N": N, "V": V, "S": S, "triple_d": triple_d, "pair_d": pair_d, "word_d": discounts(total[4:].tolist()), "m": total[4:].tolist(),
        "triples": store("triples", told_one.get(1, []), 1), "contexts": store("contexts", told_one.get(2, []), 4), "pairs": store("pairs", told_one.get(3, []), 1),
        "hot-contexts": store("hot-contexts", hot_filled[0], 4), "hot-pairs": store("hot-pairs", hot_filled[1], 1),
        "words": words_shelf.filled(np.concatenate([np.zeros(0, np.int64), *last[1]])),
    }


# --------------------------------------------------------------------------
# scoring


class Scorer:
    """Memory-mapped view of a model in one worker."""

    def __init__(self, model: dict):
        self.m, self.places = model, model["places"]
        d, s = model["word_d"], max(1, model["S"])
        m1, m2 = model["m"][:2]
        self.free = (d[0] * m1 + d[1] * m2 + d[2] * max(0, model["V"] - m1 - m2)) / s if model["S"] else 1.0

    def _either(self, keys, hot, buckets, plain: str, other: str):
        """Rows of one store, or of the other where hot."""
        there, rows = np.zeros(len(keys), bool), np.zeros((len(keys), self.m[plain].m), np.int64)
        for name, chosen, at in ((plain, ~hot, buckets), (other, hot, self.places.top(keys))):
            if chosen.any():
                there[chosen], rows[chosen] = self.m[name].find(keys[chosen], at[chosen])
        return there, rows

    def score(self, data: np.ndarray, offs: np.ndarray):
        """Per row: tokens, known tokens, base log10 probability, the model's."""
        m, places = self.m, self.places
        u, v, w, first = tokens(data, offs)
        distinct, back = np.unique(np.append(w, BOS), return_inverse=True)
        known = hx.find(m["words"], distinct)
        back, bos = back[:-1], back[-1]
        one_back = np.full(len(w), bos)
        one_back[1:] = back[:-1]
        one_back[first[:-1]] = bos
        c = known["c"][back]
        base = np.log10((c + 1) / (m["N"] + m["V"] + 1))
        nc = known["nc"]
        p1 = np.maximum(nc - _discount(nc, m["word_d"]), 0) / max(1, m["S"]) + self.free / (m["V"] + 1)

        # pairs (v, w), by their numbers of contexts
        there = known["found"]
        nc2 = np.zeros(len(w), np.int64)
        at = np.flatnonzero((c > 0) & there[one_back])
        if len(at):
            nc2[at] = self._either(pair_key(v[at], w[at]), places.hot_word(v[at]), places.top(v[at]), "pairs", "hot-pairs")[1][:, 0]
        cx = known["cx"][one_back]
        p2 = np.where(cx > 0, np.maximum(nc2 - _discount(nc2, m["pair_d"]), 0) / np.maximum(cx, 1) + known["g"][one_back] * p1[back], p1[back])

        # contexts (u, v), each the pair of the token before, and trigrams
        context = np.zeros((len(w), 4), np.int64)
        seen = np.roll(nc2, 1) > 0
        seen[first[:-1]] = there[bos]
        at = np.flatnonzero(seen)
        bucket = places.triple(u, v, w) if len(w) else np.zeros(0, np.int32)
        if len(at):
            often, context[at] = self._either(pair_key(u[at], v[at]), places.hot_pair(u[at], v[at]), bucket[at], "contexts", "hot-contexts")
            context[at[~often]] = 1, 1, 0, 0
        n = np.zeros(len(w), np.int64)
        at = np.flatnonzero((context[:, 0] > 0) & (nc2 > 0))
        if len(at):
            n[at] = m["triples"].find(triple_key(u[at], v[at], w[at]), bucket[at])[1][:, 0]
        d = m["triple_d"]
        total = np.maximum(context[:, 0], 1)
        g = (d[0] * context[:, 1] + d[1] * context[:, 2] + d[2] * context[:, 3]) / total
        p = np.where(context[:, 0] > 0, np.maximum(n - _discount(n, d), 0) / total + g * p2, p2)
        return np.diff(first), *(np.add.reduceat(x, first[:-1]) for x in ((c > 0).astype(np.int64), base, np.log10(p)))


_SCORE = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row.

    A null or empty text is its end alone, one token. Repeated rows give repeated
    results, an empty table an empty one; extra columns are not read. Perplexity
    is 10 ** (-score / n_tokens).
    """
    def run(batches):
        scorer = Scorer(model)
        for batch in pieces(batches):
            data, offs = text_bytes(batch.column(1))
            for lo, hi in row_slices(offs, SLICE):
                n, known, base, own = scorer.score(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
                train = np.full(hi - lo, model["N"], np.int64)
                cols = [batch.column(0).slice(lo, hi - lo), *(pa.array(x) for x in (n.astype(np.int64), known, train, base, own))]
                yield pa.RecordBatch.from_arrays(cols, schema=_SCORE)

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = src.mapInArrow(released(run), "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens"))).withColumnRenamed("id", id_col)


def op4_kneser_ney(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    model = train(docs.filter(~F.coalesce(out, F.lit(False))))
    return score(docs, model).select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")


SQL = None
