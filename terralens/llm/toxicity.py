"""Toxic spans by a linear-chain conditional random field.

Token labels come from document labels: in a bounded sample of labelled documents,
a word or word beginning that toxic documents hold far more often than the others
(a likelihood-ratio test against the number of candidates) marks its tokens in
toxic documents. The field is trained on those tokens, with the word, its
beginnings and its ending as features and weights for neighbouring labels. Forward
and backward passes give every token's marginal; a document's marginals give its
score, and the tokens above one half its offending spans.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralens.llm.common import LOWER, U64, mix64, released, row_slices, span_hashes, text_bytes, words
from terralens.llm.hashindex import fold
from terralens.llm.substring import run_hashes

#: Bound of the training sample: labelled documents of either label, bytes of text. It
#: bounds the model too, as a feature stands in three documents of the sample at least.
MAX_TOXIC, MAX_CLEAN, MAX_BYTES = 2000, 6000, 24 << 20
#: Tokens of a sequence. Training takes each by itself, and BLOCK of them at once;
#: tagging carries the passes over the cuts.
LENGTH = 64
BLOCK = 8192
PREFIXES = (3, 4, 5, 6, 7, 8)
_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def token_features(data, starts, ends):
    """Feature hashes (tokens x features): word, beginnings, ending; zero for none."""
    low, n = LOWER[data], ends - starts
    out = np.zeros((len(starts), len(PREFIXES) + 2), U64)
    out[:, 0] = span_hashes(low, starts, ends)
    for i, k in enumerate(PREFIXES, 1):
        long = n > k
        out[long, i] = span_hashes(low, starts[long], starts[long] + k) ^ U64(k)
    long = n > 4
    out[long, -1] = span_hashes(low, ends[long] - 4, ends[long]) ^ U64(99)
    return out


class Tokens:
    """Tokens of one slice of texts, their distinct words and the words' features."""

    def __init__(self, data, offs):
        self.starts, self.ends, self.rows, self.hashes = words(data, offs, lower=True, breaks=_BREAK)
        kinds, first, self.kind = np.unique(self.hashes, return_index=True, return_inverse=True)
        self.hash, self.features = kinds, token_features(data, self.starts[first], self.ends[first])


def padded(rows: np.ndarray):
    """(step, sequence, sequence count): where each token goes when rows are cut into
    sequences of LENGTH and laid out step by sequence. A row's sequences follow one
    another."""
    n = np.diff(rows)
    within = np.arange(rows[-1]) - np.repeat(rows[:-1], n)
    cuts = -(-n // LENGTH)
    seq = np.repeat(np.cumsum(cuts) - cuts, n) + within // LENGTH
    return within % LENGTH, seq, int(cuts.sum())


def _lse_ratio(a, b, c, d, x):
    """log((e^a + e^(b+x)) / (e^c + e^(d+x)))"""
    return np.logaddexp(a, b + x) - np.logaddexp(c, d + x)


def marginals(score: np.ndarray, real: np.ndarray, trans: np.ndarray, start, after=0.0):
    """Forward and backward log-odds and P(label 1) of every step (step x sequence).
    ``score`` is the log-odds of a token by itself, ``trans[i][j]`` the weight of label j after i;
    ``start`` and ``after`` are what comes in before the first step and, of full sequences, after the last."""
    steps = len(score)
    fwd, bwd = np.empty_like(score), np.zeros_like(score)
    bwd[-1:] = after
    for t in range(steps):
        fwd[t] = score[t] + (start if t == 0 else _lse_ratio(trans[0, 1], trans[1, 1], trans[0, 0], trans[1, 0], fwd[t - 1]))
    for t in range(steps - 2, -1, -1):
        b = _lse_ratio(trans[1, 0], trans[1, 1], trans[0, 0], trans[0, 1], score[t + 1] + bwd[t + 1])
        bwd[t] = np.where(real[t + 1], b, 0.0)
    return fwd, bwd, 1 / (1 + np.exp(-np.clip(fwd + bwd, -60, 60)))


def carried(score: np.ndarray, real: np.ndarray, trans: np.ndarray, start: float, cuts: np.ndarray):
    """(start, after) for the sequences of documents of ``cuts`` sequences each, so that
    the passes run over whole documents. A sequence maps the odds that come in to those
    that go out as a 2 x 2 matrix (kept as logs): the product of its steps forward, and
    its transpose backward."""
    first = np.cumsum(cuts) - cuts
    before, after = np.full(score.shape[1], start, float), np.zeros(score.shape[1])
    docs = np.flatnonzero(cuts > 1)
    if not len(docs):
        return before, after
    (t00, t01), (t10, t11) = trans
    where = np.repeat(cuts > 1, cuts)  # sequences with a neighbour
    at = np.cumsum(where) - 1
    s, r = score[:, where], real[:, where]
    m = [t11 + s[0], t01 + s[0], np.full(s.shape[1], t10), np.full(s.shape[1], t00)]
    opens = at[first[docs]]
    m[0][opens] = m[1][opens] = s[0, opens] + start
    m[2][opens] = m[3][opens] = 0.0
    for t in range(1, len(s)):
        a, b, c, d = m
        step = s[t] + np.logaddexp(t11 + a, t01 + c), s[t] + np.logaddexp(t11 + b, t01 + d), np.logaddexp(t10 + a, t00 + c), np.logaddexp(t10 + b, t00 + d)
        m = [np.where(r[t], new, old) for new, old in zip(step, m, strict=True)]
    x = np.zeros(len(docs))
    for j in range(int(cuts.max()) - 1):
        go = cuts[docs] > j + 1
        docs, x = docs[go], x[go]
        i = at[first[docs] + j]
        x = np.logaddexp(m[0][i] + x, m[1][i]) - np.logaddexp(m[2][i] + x, m[3][i])
        before[first[docs] + j + 1] = _lse_ratio(t01, t11, t00, t10, x)
    docs = np.flatnonzero(cuts > 1)
    last = first[docs] + cuts[docs] - 1
    x = np.zeros(len(docs))
    for j in range(int(cuts.max()) - 1):
        go = cuts[docs] > j + 1
        docs, last, x = docs[go], last[go], x[go]
        i = at[last - j]
        x = np.logaddexp(m[0][i] + x, m[2][i]) - np.logaddexp(m[1][i] + x, m[3][i])
        after[last - j - 1] = x
    return before, after


def _pair_marginals(fwd, bwd, score, trans):
    """P(labels i, j of steps t, t+1), as four arrays."""
    a, c = fwd[:-1], score[1:] + bwd[1:]
    w = np.stack([trans[0, 0] + 0 * a, trans[0, 1] + c, trans[1, 0] + a, trans[1, 1] + a + c])
    w = np.exp(w - w.max(axis=0))
    return w / w.sum(axis=0)


class Field:
    """Weights of the model: sorted feature hashes, their weights, bias, transitions,
    and the line that turns a document's marginals into its score."""

    def __init__(self):
        self.keys, self.weights = np.zeros(0, U64), np.zeros(0)
        self.bias, self.start, self.trans = -4.0, 0.0, np.zeros((2, 2))
        self.line = np.array([-2.0, 0.0, 0.0])
        self.learnt = True

    def emissions(self, numbers: np.ndarray) -> np.ndarray:
        return self.bias + (np.append(self.weights, 0.0)[numbers]).sum(axis=1)

    def numbers(self, features: np.ndarray) -> np.ndarray:
        """Number of each feature; one past the last for an unknown one."""
        if not len(self.keys):
            return np.zeros(features.shape, np.int64)
        i = np.searchsorted(self.keys, features)
        i[i == len(self.keys)] = 0
        return np.where(self.keys[i] == features, i, len(self.keys))

    def tag(self, t: Tokens, numbers: np.ndarray | None = None) -> np.ndarray:
        """P(toxic) of every token."""
        if not len(t.kind):
            return np.zeros(0)
        numbers = self.numbers(t.features) if numbers is None else numbers
        step, seq, count = padded(t.rows)
        score, real = np.zeros((LENGTH, count)), np.zeros((LENGTH, count), bool)
        score[step, seq] = self.emissions(numbers)[t.kind]
        real[step, seq] = True
        before, after = carried(score, real, self.trans, self.start, -(-np.diff(t.rows) // LENGTH))
        return marginals(score, real, self.trans, before, after)[2][step, seq]

    @staticmethod
    def evidence(p: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Per document: constant, largest marginal, log of one plus their sum."""
        n = len(rows) - 1
        total, top = np.zeros(n), np.zeros(n)
        full = np.flatnonzero(np.diff(rows))
        if len(full):
            total[full] = np.add.reduceat(p, rows[:-1][full])
            top[full] = np.maximum.reduceat(p, rows[:-1][full])
        return np.stack([np.ones(n), top, np.log1p(total)], axis=1)

    def scores(self, p: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(p, rows) @ self.line, -60, 60)))


def within_bytes(sizes: list[int], labels: list[int]) -> list[int]:
    """The rows, in order, that a sample of MAX_BYTES holds. The label with fewer bytes
    so far comes next, toxic first, and a row that doesn't fit is passed over: none
    ends the sample, and no label fills it before the other has had its turn."""
    ahead = {y: [i for i, label in enumerate(labels) if (label == 1) == (y == 1)][::-1] for y in (1, 0)}
    used, keep = {1: 0, 0: 0}, []
    while ahead[1] or ahead[0]:
        y = min((y for y in (1, 0) if ahead[y]), key=used.get)
        i = ahead[y].pop()
        if used[1] + used[0] + sizes[i] <= MAX_BYTES:
            used[y] += sizes[i]
            keep.append(i)
    return sorted(keep)


def _thinned(texts: list[str], labels: list[int]):
    """The sample without copies of its own documents: copies would count as
    independent evidence for every word they hold."""
    seen, keep = set(), []
    for i in within_bytes([len(x.encode()) for x in texts], labels):
        x = texts[i]
        data, offs = text_bytes(pa.array([x]))
        _, _, _, h = words(data, offs, lower=True)
        runs = run_hashes(h, 5) if len(h) >= 5 else h
        least = set(np.partition(runs, 2)[:3].tolist()) if len(runs) > 3 else set(runs.tolist())
        if not least & seen:
            seen |= least
            keep.append(i)
    return [texts[i] for i in keep], np.array([labels[i] for i in keep], np.int64)


def _likelihood_ratio(df1, df0, n1, n0):
    """G statistic of a feature's document counts, signed by the side it favours."""
    def part(k, n, r):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k / (n * r)), 0) + np.where(n > k, (n - k) * np.log((n - k) / (n * (1 - r))), 0)

    r = np.clip((df1 + df0) / (n1 + n0), 1e-12, 1 - 1e-12)
    return 2 * (part(df1, n1, r) + part(df0, n0, r)) * np.sign(df1 / n1 - df0 / n0)


def fit(texts: list[str], labels: list[int], rounds: int = 30) -> Field:
    """Train on the labelled texts of a sample. Without a toxic or without a clean
    text the scores are the share of toxic ones, (toxic + 0.5) / (all + 1)."""
    field = Field()
    texts, y = _thinned(texts, labels)
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    if not n1 or not n0:
        share = (n1 + 0.5) / (n1 + n0 + 1)
        field.line = np.array([np.log(share / (1 - share)), 0.0, 0.0])
        field.learnt = False
        return field

    col = pa.array(texts, pa.large_string())
    data, offs = text_bytes(col)
    slices = [(lo, Tokens(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])) for lo, hi in row_slices(offs, 1 << 20)]
    del data, col
    known = np.zeros(0, U64)
    for _, t in slices:  # what the sample doesn't need is let go: it is held on the driver
        t.starts = t.ends = t.hashes = None
        t.kind = t.kind.astype(np.int32)
        known = np.union1d(known, t.features.reshape(-1))
    known = known[known > 0]
    numbered = []
    for _, t in slices:
        numbered.append(np.where(t.features > 0, np.searchsorted(known, t.features), -1).astype(np.int32))
        t.features = None

    # document frequency of every feature, by label
    def document_counts(skip):
        """Documents of either label that hold a feature; a word with a feature in ``skip`` doesn't count."""
        df = np.zeros((2, len(known)), np.int64)
        for (lo, t), num in zip(slices, numbered, strict=True):
            doc = np.repeat(np.arange(len(t.rows) - 1), np.diff(t.rows))
            pair = fold(doc * (len(t.hash) + 1) + t.kind.astype(np.int64))[0]
            if skip is not None:
                pair = pair[~skip[num].any(axis=1)[pair % (len(t.hash) + 1)]]
            doc, f = pair // (len(t.hash) + 1), num[pair % (len(t.hash) + 1)]
            each = np.repeat(doc, f.shape[1]) * (len(known) + 1) + f.reshape(-1)
            each = fold(each[f.reshape(-1) >= 0])[0]
            doc, f = each // (len(known) + 1), each % (len(known) + 1)
            for label in (0, 1):
                df[label] += np.bincount(f[y[lo + doc] == label], minlength=len(known))
        return df

    def marked(df, purity):
        rate = (df[1] / n1) / np.maximum(df[1] / n1 + df[0] / n0, 1e-12)
        return (df.sum(axis=0) >= 3) & (_likelihood_ratio(df[1], df[0], n1, n0) > threshold) & (rate > purity)

    df = document_counts(None)
    often = np.flatnonzero(df.sum(axis=0) >= 3)
    threshold = 2 * np.log(max(2, len(often))) + 2
    # First what clean documents hardly hold. A beginning that some do hold has to
    # stand out without the words that are marked already.
    marks = np.append(marked(df, 0.995), False)
    marks[:-1] |= marked(document_counts(marks), 0.9)
    field.keys = known[often]
    marks = np.append(marks[often], False)
    field.weights = np.where(marks[:-1], 2.0, 0.0)

    # tokens of the sample, laid out for the field
    place = np.full(len(known) + 1, len(often), np.int32)
    place[often] = np.arange(len(often), dtype=np.int32)
    parts = []
    for i, (lo, t) in enumerate(slices):
        num = numbered[i] = place[numbered[i]]
        if not len(t.kind):
            continue
        hit = marks[num].any(axis=1)[t.kind]
        bad = hit & (np.repeat(y[lo : lo + len(t.rows) - 1], np.diff(t.rows)) == 1)
        step, seq, count = padded(t.rows)
        grid = np.full((LENGTH, count), -1, np.int32)
        grid[step, seq] = t.kind
        tag = np.zeros((LENGTH, count), bool)
        tag[step, seq] = bad
        # every sequence that holds a mark, in clean documents too, and about as many
        # others, drawn by a hash of their words
        some = np.zeros(count, bool)
        some[seq[hit]] = True
        share = max(100, int(some.sum())) / max(1, count - int(some.sum()))
        drawn = mix64(np.add.reduceat(t.hash[t.kind], np.flatnonzero(step == 0))) >> U64(11)
        take = np.flatnonzero(some | (drawn < min(1.0, share) * 2.0**53))
        parts.append((num, grid[:, take], tag[:, take]))
    if any(p[2].any() for p in parts):
        _train(field, parts, rounds, marks[:-1])
    del parts
    p = [field.evidence(field.tag(t, num), t.rows) for (_, t), num in zip(slices, numbered, strict=True)]
    field.line = _logistic(np.concatenate(p), y)
    return field


def _train(field: Field, parts, rounds: int, marks: np.ndarray, rate: float = 0.3, ridge: float = 1e-4) -> None:
    """Adam on the log-likelihood of the labelled sequences. Only marked features may
    speak for label 1; the others can only speak against it."""
    base = 0
    kinds, grids, tags = [], [], []
    for num, grid, tag in parts:
        kinds.append(num)
        grids.append(np.where(grid >= 0, grid.astype(np.int64) + base, -1))
        tags.append(tag)
        base += len(num)
    num, grid, tag = np.concatenate(kinds), np.concatenate(grids, axis=1), np.concatenate(tags, axis=1)
    used, back = np.unique(grid, return_inverse=True)
    back = back.reshape(grid.shape) - (used[0] < 0)
    num = num[used[used >= 0]]
    real = grid >= 0
    n = len(field.keys)
    theta = np.concatenate((field.weights, [field.bias, field.start], field.trans.reshape(-1)))
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    both = real[1:]
    pair = tag[:-1].astype(np.int64) * 2 + tag[1:]
    want_pairs = np.bincount(pair[both], minlength=4)
    want = np.bincount(back[real], tag[real], minlength=len(num))
    total = max(1, int(real.sum()))
    for i in range(1, rounds + 1):
        w, bias, start, trans = theta[:n], theta[n], theta[n + 1], theta[n + 2 :].reshape(2, 2)
        kind = bias + np.append(w, 0.0)[num].sum(axis=1)
        got, got_pairs, got_first = np.zeros(len(num)), np.zeros(4), 0.0
        for lo in range(0, grid.shape[1], BLOCK):
            here, at, two = real[:, lo : lo + BLOCK], back[:, lo : lo + BLOCK], both[:, lo : lo + BLOCK]
            score = np.where(here, kind[np.where(here, at, 0)], 0.0)
            fwd, bwd, p = marginals(score, here, trans, start)
            got += np.bincount(at[here], p[here], minlength=len(num))
            got_pairs += _pair_marginals(fwd, bwd, score, trans)[:, two].sum(axis=1)
            got_first += p[0][here[0]].sum()
        diff = want - got
        grad = np.zeros_like(theta)
        grad[:n] = np.bincount(num.reshape(-1), np.repeat(diff, num.shape[1]), minlength=n + 1)[:n]
        grad[n] = diff.sum()
        grad[n + 1] = tag[0][real[0]].sum() - got_first
        grad[n + 2 :] = want_pairs - got_pairs
        grad = grad / total - ridge * np.append(theta[:n], np.zeros(6)) / max(1, n) ** 0.5
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-10) * (1 - (i - 1) / rounds)
        theta[:n][~marks] = np.minimum(theta[:n][~marks], 0.0)
        theta[n + 2] = 0.0  # one of the four is free
    field.weights, field.bias, field.start, field.trans = theta[:n], theta[n], theta[n + 1], theta[n + 2 :].reshape(2, 2)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Newton steps for a regularised logistic line."""
    w = np.zeros(x.shape[1])
    hold = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + hold
        w = w + np.clip(np.linalg.solve(h, x.T @ (y - p) - hold @ w), -5, 5)
    return w


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"):
    """(text, label) rows: at most MAX_TOXIC and MAX_CLEAN labelled ones, chosen by a
    hash of the id. A repeated id counts with its largest label; null labels and ids don't count."""
    one = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__y"))
    picked = None
    for y, most in ((1, MAX_TOXIC), (0, MAX_CLEAN)):
        part = one.filter(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(most)
        picked = part if picked is None else picked.unionByName(part)
    # MAX_TOXIC + MAX_CLEAN ids at most are broadcast
    src = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__t"))
    met = src.join(F.broadcast(picked), "__id").groupBy("__id").agg(F.max("__y").alias("y"), F.min("__t").alias("t"))
    return met.select(F.xxhash64("__id", F.lit(1)).alias("o"), "t", F.col("y").cast("int").alias("y"))


_OUT = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))])


def _tagged(batches, field, column):
    """(batch, lo, hi, row scores, tokens, token marginals) slice by slice."""
    for b in batches:
        data, offs = text_bytes(b.column(column))
        for lo, hi in row_slices(offs):
            t = Tokens(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            p = field.tag(t)
            yield b, lo, hi, field.scores(p, t.rows), t, p, offs[lo : hi + 1] - offs[lo]


def tag(df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted, spans) of every row; a span is a run of offending
    tokens with its UTF-8 byte offsets and largest marginal.

    A null text counts as empty: no span, and the score of a text without
    evidence. Repeated rows give repeated results, an empty table an empty one;
    extra columns are not read. The model, hashes and weights of the features of a
    bounded sample, is broadcast. A long text is one chain like any other.
    """
    model = df.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for b, lo, hi, scores, t, p, offs in _tagged(batches, model.value, 1):
            spans = [[] for _ in range(hi - lo)]
            hits = np.flatnonzero(p >= 0.5)
            rows = np.searchsorted(t.rows, hits, "right") - 1
            last = (-2, -1)
            for i, r in zip(hits.tolist(), rows.tolist(), strict=True):
                if last == (i - 1, r):
                    spans[r][-1]["end"] = int(t.ends[i] - offs[r])
                    spans[r][-1]["score"] = max(spans[r][-1]["score"], float(p[i]))
                else:
                    spans[r].append({"start": int(t.starts[i] - offs[r]), "end": int(t.ends[i] - offs[r]), "score": float(p[i])})
                last = (i, r)
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, _OUT.types[3])], schema=_OUT)

    src = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(released(run), "id long, score double, predicted int, spans array<struct<start:int,end:int,score:double>>").withColumnRenamed("id", id_col)


def drop_toxic(df: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """The rows with a score below one half, all columns; every row if the field has
    not seen both labels, as its scores then tell no document from another."""
    if not field.learnt:
        return df
    model = df.sparkSession.sparkContext.broadcast(field)
    at = df.columns.index(text_col)

    def run(batches):
        for b, lo, hi, scores, *_ in _tagged(batches, model.value, at):
            yield b.slice(lo, hi - lo).filter(pa.array(scores < 0.5))

    return df.mapInArrow(released(run), df.schema)


def in_held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained(docs: DataFrame, labels: DataFrame) -> Field:
    """The field learnt from the labels outside the held-out fifth. The sample, of
    bounded size, goes to one task that fits the field; the driver gets the model."""
    sample = training_sample(docs, labels.filter(~in_held_out())).coalesce(1)

    def run(batches):
        rows = sorted(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        rows = [rows[i] for i in within_bytes([len(r[1].encode()) for r in rows], [r[2] for r in rows])]
        field = fit([r[1] for r in rows], [r[2] for r in rows])
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(field)], pa.binary())})

    got = sample.mapInArrow(released(run), "model binary").first()
    return pickle.loads(got["model"]) if got else fit([], [])  # noqa: S301


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = tag(docs, trained(docs, labels))
    return out.select("doc_id", in_held_out().alias("held_out"), "score", "predicted", "spans")


SQL = None
