import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terralens.llm import kneser_ney as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, score string"


def toks(text):
    return WORD.findall((text or "").translate(FOLD)) + ["</s>"]


def plain_discounts(counts):
    """D(k) = k - (k + 1) Y n(k+1) / n(k) with Y = n(1) / (n(1) + 2 n(2)), in fractions;
    kept between 0.05 and a hundredth below k times one, as tables this small need."""
    n = [Fraction(sum(c == k for c in counts)) for k in range(1, 5)]
    if not n[0] or not n[1]:
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else None for k in (1, 2, 3)]
    d[2] = d[1] if d[2] is None else d[2]
    return [float(min(max(x, Fraction(1, 20)), Fraction(99, 100) * k)) for k, x in zip((1, 2, 3), d)]


class Brute:
    """The model from its definition, on words."""

    def __init__(self, texts):
        self.c, self.triples = Counter(), Counter()
        for t in texts:
            w = toks(t)
            self.c.update(w)
            self.triples.update(zip(["<s>", "<s>", *w], ["<s>", *w], w))
        self.pairs, self.nc = Counter((v, w) for _, v, w in self.triples), Counter()
        self.nc.update(w for _, w in self.pairs)
        self.three, self.two_ = defaultdict(list), defaultdict(list)
        for (u, v, _), n in self.triples.items():
            self.three[u, v].append(n)
        for (v, _), n in self.pairs.items():
            self.two_[v].append(n)
        self.d3, self.d2, self.d1 = (plain_discounts(x.values()) for x in (self.triples, self.pairs, self.nc))
        self.N, self.V, self.S = sum(self.c.values()), len(self.c), sum(self.nc.values())
        self.free = sum(self.d1[min(n, 3) - 1] for n in self.nc.values()) / self.S if self.S else 1.0

    def one(self, w):
        n = self.nc[w]
        return (n - self.d1[min(n, 3) - 1] if n else 0) / max(1, self.S) + self.free / (self.V + 1)

    @staticmethod
    def mixed(n, counts, d, lower):
        if not counts:
            return lower
        total = sum(counts)
        left = sum(d[min(k, 3) - 1] for k in counts) / total
        return (n - d[min(n, 3) - 1] if n else 0) / total + left * lower

    def two(self, v, w):
        return self.mixed(self.pairs[v, w], self.two_.get(v), self.d2, self.one(w))

    def prob(self, u, v, w):
        return self.mixed(self.triples[u, v, w], self.three.get((u, v)), self.d3, self.two(v, w))

    def score(self, text):
        w = toks(text)
        base = sum(math.log10((self.c[x] + 1) / (self.N + self.V + 1)) for x in w)
        return len(w), sum(self.c[x] > 0 for x in w), self.N, base, sum(math.log10(self.prob(u, v, x)) for u, v, x in zip(["<s>", "<s>", *w], ["<s>", *w], w))


def same(got, want):
    assert got[:3] == want[:3], (got, want)
    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in zip(got[3:], want[3:])), (got, want)


def fixture():
    r = random.Random(3)
    vocab = ["The", "the", "É", "a", "b", "c-d", "x,", *[f"w{i}" for i in range(40)]]
    rows = [" ".join(r.choices(vocab, k=r.randrange(0, 60), weights=[1 / (i + 1) for i in range(len(vocab))])) for _ in range(120)]
    return rows + [None, "", " \t\n", "rare", rows[0], rows[0], "the\x0bthe the " * 300]


def fields(r):
    return r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score


@pytest.mark.parametrize("spread", [1000, K.SPREAD, 0.5, 0.001])
def test_matches_brute_force(spark, monkeypatch, spread):
    """With hot words and pairs spread over buckets, and without; in small pieces, too."""
    if spread < 1:
        monkeypatch.setattr(K, "BUCKET_BYTES", 300)
    rows = fixture()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], SCHEMA).repartition(3)
    model, brute = K.train(df.filter("doc_id % 3 > 0"), spread=spread), Brute([t for i, t in enumerate(rows) if i % 3])
    assert (model["N"], model["V"], model["S"]) == (brute.N, brute.V, brute.S)
    assert (len(model["places"].words) > 0, len(model["places"].pairs) > 0) == (spread < 1000, spread < 1000)
    assert all(math.isclose(a, b) for k, d in (("triple_d", brute.d3), ("pair_d", brute.d2), ("word_d", brute.d1)) for a, b in zip(model[k], d))
    got = {r.doc_id: fields(r) for r in K.score(df, model).collect()}
    assert len(got) == len(rows)
    for i, t in enumerate(rows):
        same(got[i], brute.score(t))
    for u, v in (("the", "w1"), ("<s>", "the"), ("<s>", "<s>"), ("never", "the"), ("the", "never"), ("a", "b")):
        assert math.isclose(sum(brute.prob(u, v, w) for w in brute.c) + brute.prob(u, v, "never"), 1, rel_tol=1e-9)


def test_pieces_of_long_rows(monkeypatch):
    r = random.Random(4)
    texts = [" ".join(r.choices("abcdefg", k=n)) for n in (0, 1, 500, 3, 40)]
    want = Counter()
    for t in texts:
        w = toks(t)
        want.update(zip(["<s>", "<s>", *w], ["<s>", *w], w))
    names = {int(K.BOS): "<s>", int(K.END): "</s>"}
    for x in "abcdefg":
        names[int(K.words(*K.text_bytes(pa.array([x])), lower=True)[3][0] & K._HIGH)] = x
    for size in (7, 64, 1000):
        monkeypatch.setattr(K, "TOKENS", size)
        got = Counter()
        for b in K._triple_blobs([pa.RecordBatch.from_pydict({"t": texts})], K.Places(3, {}, {})):
            for bucket, blob in zip(*(c.to_pylist() for c in b.columns)):
                for u, v, w, n in zip(*(x.tolist() for x in K._unpack_triples(blob))):
                    assert v >> 61 == bucket
                    got[names[u], names[v], names[w]] += n
        assert got == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 6), st.sampled_from([0, 1, 2, 300, 70_000, 2**40])), max_size=400, unique_by=lambda r: r[0]), st.integers(1, 2))
def test_packed_arrays(rows, m):
    rows = sorted(rows)
    keys = np.array([r[0] for r in rows], K.U64)
    cols = [np.array([r[i + 1] for r in rows], np.int64) for i in range(m)]
    if not rows:
        return
    p = K.Packed(np.frombuffer(K.Packed.build(keys, cols), np.uint8))
    there, got = p.find(keys)
    stored = lambda ks: list(zip((ks >> K.U64(64 - p.t)).tolist(), (ks << K.U64(p.t) >> K.U64(32)).tolist()))
    if len(set(stored(keys))) == len(keys):
        assert there.all() and got.tolist() == [list(r) for r in zip(*(c.tolist() for c in cols))]
    for moved in (keys ^ K.U64(1 << 40), keys ^ K.U64(1 << 63), ~keys):
        there, got = p.find(moved)
        assert there.tolist() == [x in set(stored(keys)) for x in stored(moved)] and not got[~there].any()


def test_many_unlike_counts():
    """More kinds of rows than a byte names."""
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 2**63, 5000).astype(K.U64) * K.U64(2))
    cols = [r.integers(0, 600, len(keys)) for _ in range(4)]
    p = K.Packed(np.frombuffer(K.Packed.build(keys, cols), np.uint8))
    order = r.permutation(len(keys))
    there, got = p.find(keys[order])
    assert there.all() and (got == np.stack(cols, axis=1)[order]).all() and len(p.others) > 4000
    assert not p.find(keys + K.U64(1 << 30))[0][~np.isin(keys + K.U64(1 << 30), keys)].any()


def test_no_training_rows(spark):
    df = spark.createDataFrame([(1, "a b", ""), (None, None, "")], SCHEMA)
    got = sorted(fields(r) for r in K.score(df, K.train(df.filter("false"))).collect())
    assert [g[:3] for g in got] == [(1, 0, 0), (3, 0, 0)] and all(g[4] == 0 for g in got)
    assert K.score(df.filter("false"), K.train(df)).collect() == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    out = {x.doc_id: zlib.crc32(str(x.doc_id).encode()) % 7 == 2 for x in docs}
    brute = Brute([x.text for x in docs if not out[x.doc_id]])
    got = {r.doc_id: r for r in K.op4_kneser_ney(spark, d).collect()}
    for x in docs:
        assert got[x.doc_id].held_out == out[x.doc_id]
        same(fields(got[x.doc_id]), brute.score(x.text))
