import math
import random
import re
import zlib
from itertools import product

import numpy as np

from terralens.llm import toxicity as X

SCHEMA = "doc_id long, text string, score string"


def test_marginals_match_enumeration():
    r = np.random.default_rng(1)
    trans, start = r.normal(size=(2, 2)), 0.7
    score = r.normal(size=(5, 3))
    real = np.arange(5)[:, None] < np.array([5, 1, 3])
    score[~real] = 0
    fwd, bwd, p = X.marginals(score, real, trans, start)
    pairs = X._pair_marginals(fwd, bwd, score, trans)
    for s, n in enumerate((5, 1, 3)):
        total, one, two = 0.0, np.zeros(n), np.zeros((4, n))
        for y in product((0, 1), repeat=n):
            w = start * y[0] + sum(score[t, s] * y[t] for t in range(n)) + sum(trans[y[t], y[t + 1]] for t in range(n - 1))
            total += np.exp(w)
            for t in range(n):
                one[t] += np.exp(w) * y[t]
                if t + 1 < n:
                    two[2 * y[t] + y[t + 1], t] += np.exp(w)
        assert np.allclose(p[:n, s], one / total)
        assert np.allclose(pairs[:, : n - 1, s], two[:, : n - 1] / total)


def corpus(n, seed):
    r = random.Random(seed)
    vocab = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "te") for b in ("ran", "sol", "pi") for c in ("x", "dé", "um", "")]
    docs = []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randrange(0, 150))]
        y = int(r.random() < 0.15 and len(w) > 5)
        for _ in range(r.randrange(2, 5) * y):
            w[r.randrange(len(w))] = r.choice(["Vilest", "grubog", "grubax!", "grubin,"])
        docs.append((i, " ".join(w), y))
    return docs


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_learns_spans(spark):
    docs = corpus(1500, 3)
    frame = spark.createDataFrame([(i, t, "x") for i, t, _ in docs] + [(5000, None, "x"), (5001, "", "x"), (5002, "karanx " * 40000, "x"), (None, "grubnew vilest", "x")], SCHEMA)
    labels = spark.createDataFrame([(i, y) for i, _, y in docs] + [(1, None), (None, 1), (7000, 1)], "doc_id long, toxic int")
    field = X.trained(frame, labels)
    got = {r.doc_id: r for r in X.tag(frame, field).collect()}
    assert len(got) == 1504
    wrong = [i for i, _, y in docs if got[i].predicted != y]
    assert not wrong, wrong
    for i, t, y in docs:
        words = [t.encode()[s.start : s.end].decode().lower() for s in got[i].spans]
        assert all(all(w in ("vilest", "grubog", "grubax", "grubin") for w in x.replace("!", "").replace(",", "").split()) for x in words) and bool(words) == bool(y)
    assert got[None].predicted == 1 and [(s.start, s.end) for s in got[None].spans] == [(0, 14)]
    for i in (5000, 5001, 5002):
        assert got[i].predicted == 0 and got[i].spans == [] and 0 <= got[i].score < 0.5
    kept = X.drop_toxic(frame, field)
    assert kept.columns == frame.columns and sorted(r.doc_id for r in kept.collect()) == sorted([i for i, _, y in docs if not y] + [5000, 5001, 5002])


def test_degenerate_labels(spark):
    frame = spark.createDataFrame([(1, "a b", ""), (2, None, "")], SCHEMA)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in X.tag(frame, X.trained(frame, none)).collect()} == {0.5}
    clean = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert all(0 < r.score < 0.5 and r.predicted == 0 for r in X.tag(frame, X.trained(frame, clean)).collect())
    assert X.tag(frame.filter("false"), X.trained(frame, none)).collect() == []


M64 = (1 << 64) - 1


def plain_hash(raw: bytes) -> int:
    """The polynomial hash of a byte string, in Python's whole numbers."""
    base = 0x9E3779B97F4A7C15
    x = (sum((b + 1) * pow(base, i, 1 << 64) for i, b in enumerate(raw)) + 0x632BE59BD9B4E019) & M64
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & M64
    return x ^ (x >> 31)


def plain_score(field, text, known={}):
    """Score and P(toxic) of the tokens of one text: the chain over the whole document,
    step by step, in probabilities."""
    weights = known.setdefault(id(field), dict(zip(field.keys.tolist(), field.weights.tolist())))
    words = [w for w in re.split(rb"[^0-9A-Za-z\x80-\xff]+", (text or "").encode()) if w]
    (t00, t01), (t10, t11) = np.exp(field.trans).tolist()
    odds = []
    for w in words:
        w = w.lower()
        names = [plain_hash(w)] + [plain_hash(w[:k]) ^ k for k in (3, 4, 5, 6, 7, 8) if len(w) > k] + ([plain_hash(w[-4:]) ^ 99] if len(w) > 4 else [])
        odds.append(math.exp(field.bias + sum(weights.get(f, 0.0) for f in names)))
    p = []
    if words:
        a = [(1.0, odds[0] * math.exp(field.start))]
        for o in odds[1:]:
            x, y = a[-1]
            x, y = x * t00 + y * t10, (x * t01 + y * t11) * o
            a.append((x / (x + y), y / (x + y)))
        b = [(1.0, 1.0)]
        for o in odds[:0:-1]:
            x, y = b[-1]
            x, y = t00 * x + t01 * o * y, t10 * x + t11 * o * y
            b.append((x / (x + y), y / (x + y)))
        p = [y * v / (x * u + y * v) for (x, y), (u, v) in zip(a, b[::-1])]
    z = field.line[0] + field.line[1] * max(p, default=0.0) + field.line[2] * math.log1p(sum(p))
    return 1 / (1 + math.exp(-z)), p


def test_query_matches_plain_python(spark):
    """Every score and span of the query, from the model's weights alone."""
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    field = X.trained(docs, labels)
    got = {r.doc_id: r for r in X.op3_toxicity(spark, d).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    spans = 0
    for r in rows:
        score, p = plain_score(field, r.text)
        g = got[r.doc_id]
        assert abs(g.score - score) < 1e-6 and g.predicted == int(g.score >= 0.5) and g.held_out == held(r.doc_id)
        runs = sum(v >= 0.5 and (i == 0 or p[i - 1] < 0.5) for i, v in enumerate(p))
        assert len(g.spans) == runs
        spans += runs
    assert spans > 20


def test_held_out_labels(spark):
    """Recall and precision of toxic documents that were not learnt from, and the share
    of clean ones flagged; always saying clean has recall 0."""
    d = "/root/testdata/sf0.1"
    rows = X.op3_toxicity(spark, d).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    test = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    hit, said, true = sum(p and y for p, y in test), sum(p for p, _ in test), sum(y for _, y in test)
    assert true > 50 and hit / true >= 0.9 and hit / said >= 0.9 and (said - hit) / (len(test) - true) < 0.01


def test_training_uses_every_marked_sequence(monkeypatch):
    texts, labels = ([x[i] for x in corpus(600, 5)] for i in (1, 2))
    seen = []
    monkeypatch.setattr(X, "_train", lambda field, parts, rounds, marks: seen.append(sum(int(p[2].sum()) for p in parts)))
    X.fit(texts, labels)
    bad = sum(w.lower().strip("!,") in ("vilest", "grubog", "grubax", "grubin") for t, y in zip(*X._thinned(texts, labels)) if y for w in t.split())
    assert seen == [bad]


def test_blocks_do_not_change_the_model(monkeypatch):
    texts, labels = ([x[i] for x in corpus(400, 6)] for i in (1, 2))
    want = X.fit(texts, labels)
    monkeypatch.setattr(X, "BLOCK", 7)
    got = X.fit(texts, labels)
    assert np.allclose(got.weights, want.weights, atol=1e-9) and np.allclose(got.line, want.line, atol=1e-6)


def test_long_rows_do_not_end_the_sample(monkeypatch):
    texts = [t for _, t, _ in corpus(600, 5)]
    labels = [y for _, _, y in corpus(600, 5)]
    monkeypatch.setattr(X, "MAX_BYTES", 2 * sum(len(t.encode()) for t in texts))
    long = "karanx " * (X.MAX_BYTES // 7 + 1)
    for y in (0, 1):
        field, want = X.fit([long, *texts], [y, *labels]), X.fit(texts, labels)
        assert field.learnt and np.array_equal(field.keys, want.keys) and np.allclose(field.line, want.line)


def test_one_label_does_not_fill_the_sample(monkeypatch):
    monkeypatch.setattr(X, "MAX_BYTES", 100)
    assert X.within_bytes([60, 60, 30, 5, 200, 5], [0, 0, 0, 1, 1, 1]) == [0, 2, 3, 5]
    assert X.within_bytes([50, 50], [0, 1]) == [0, 1]
    assert X.within_bytes([], []) == []


def test_nothing_is_dropped_without_both_labels(spark):
    frame = spark.createDataFrame([(1, "a b", ""), (2, None, "")], SCHEMA)
    for rows in ([], [(1, 1), (2, 1)], [(1, 0), (2, 0)]):
        labels = spark.createDataFrame(rows, "doc_id long, toxic int")
        assert X.drop_toxic(frame, X.trained(frame, labels)).count() == 2


def test_passes_cross_the_cuts_of_long_documents():
    r = np.random.default_rng(4)
    words = [f"w{i}" for i in range(40)]
    sizes = [0, 1, 63, 64, 65, 128, 129, 700, 0, 3]
    texts = [" ".join(r.choice(words, n)) for n in sizes]
    data, offs = X.text_bytes(X.pa.array(texts))
    t = X.Tokens(data, offs)
    field = X.Field()
    field.keys = np.sort(t.features[:, 0])
    field.weights, field.bias = r.normal(size=len(field.keys)) * 2, -0.5
    field.start, field.trans = 0.8, np.array([[0.0, -1.5], [-2.0, 2.5]])
    score = field.emissions(field.numbers(t.features))[t.kind]
    want = []
    for a, b in zip(t.rows[:-1], t.rows[1:], strict=True):  # each document as one sequence
        if b > a:
            want.append(X.marginals(score[a:b, None], np.ones((b - a, 1), bool), field.trans, field.start)[2][:, 0])
    assert np.diff(t.rows).tolist() == sizes
    assert np.allclose(field.tag(t), np.concatenate(want), rtol=0, atol=1e-12)
