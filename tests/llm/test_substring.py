import hashlib
import random
import re
from collections import Counter

from pyspark.sql import Row

from terralens.llm import substring as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, bucket string"


def brute(rows, w):
    """{row number: (words, covered flags)}"""
    toks = [WORD.findall(t or "") for t in rows]
    seen = Counter(tuple(t[i : i + w]) for t in toks for i in range(len(t) - w + 1))
    out = []
    for t in toks:
        gone = [False] * len(t)
        for i in range(len(t) - w + 1):
            if seen[tuple(t[i : i + w])] > 1:
                gone[i : i + w] = [True] * w
        out.append((t, gone))
    return out


def fixture():
    r = random.Random(5)
    vocab = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(60)]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    shared = [text(40), text(36), text(90)]
    rows = []
    for i in range(60):
        parts = [text(r.randrange(0, 80))]
        for s in shared:
            if r.random() < 0.4:
                parts += [s, text(r.randrange(0, 50))]
        rows.append("  ".join(parts) + ("\n" if i % 3 else ""))
    rows += [rows[0], rows[1], None, "", "   ", "one", "ab " * 120, "a b c " * 30, text(5000), "x" * 5000]
    rows += [" ".join(shared[2].split()[10:]) + "\t" + shared[0]]
    return rows


def test_spans_match_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([Row(doc_id=i, text=t, bucket="x") for i, t in enumerate(rows)], SCHEMA).repartition(5)
    got = {r.doc_id: r for r in S.duplicate_spans(df, min_words=35).collect()}
    assert len(got) == len(rows)
    for i, (toks, gone) in enumerate(brute(rows, 35)):
        flags = [False] * len(toks)
        for s in got[i].spans:
            flags[s.start : s.end] = [True] * (s.end - s.start)
        assert (got[i].n_words, flags) == (len(toks), gone), i
        assert WORD.findall(got[i].kept_text) == [t for t, g in zip(toks, gone) if not g]
    # other lengths, and the columns of the input
    cut = {r.doc_id: r for r in S.remove_duplicate_passages(df, min_words=6).collect()}
    for i, (toks, gone) in enumerate(brute(rows, 6)):
        assert WORD.findall(cut[i].text or "") == [t for t, g in zip(toks, gone) if not g], i
        assert cut[i].bucket == "x" and (cut[i].text is None) == (rows[i] is None)


def test_factors_are_copies_and_as_long_as_can_be(spark):
    rows = fixture()
    toks = [WORD.findall(t or "") for t in rows]
    df = spark.createDataFrame([Row(doc_id=i, text=t, bucket="x") for i, t in enumerate(rows)], SCHEMA).repartition(5)
    got = {r.doc_id: r for r in S.duplicate_spans(df, min_words=35).collect()}
    block = {}
    for i, t in enumerate(toks):
        data, offs = S.text_bytes(S.pa.array([" ".join(t)]))
        p = S.Passages(data, offs, 1)
        if t:
            block.setdefault(int(p.places(S.np.array([0]))[0]) >> 24, i)
    seen, flat = 0, Counter(tuple(t[i : i + 35]) for t in toks for i in range(len(t) - 34))
    for i, t in enumerate(toks):
        end = 0
        for f in got[i].factors:
            src = toks[block[f.block]]
            here = t[f.start : f.start + f.words]
            assert f.words >= 35 and here == src[f.offset : f.offset + f.words]
            assert toks[block[f.block]] is not t or f.offset != f.start or flat[tuple(here[:35])] > 1
            if f.boundary:
                assert f.words == 35 and f.start < end < f.start + 35
            else:
                # the parse goes on behind a factor, and words between factors begin no repeated passage
                assert f.start >= end and all(flat[tuple(t[k : k + 35])] < 2 for k in range(end, f.start))
                end, seen = f.start + f.words, seen + 1
    assert seen > 60 and any(f.boundary for r in got.values() for f in r.factors) and max(f.words for r in got.values() for f in r.factors) > 80


def test_longest_of_two_sources():
    at = S.np.array([0, 1, 2, 3, 10])
    own = (at + 1000).astype(S.U64)
    a = S.np.array([50, 51, 80, 90, 1010], S.U64)  # breaks off after two passages
    b = S.np.array([70, 71, 72, 73, 1010], S.U64)  # goes on
    start, words, source, edge = S.factors(at, own, a, b, 4)
    assert start.tolist() == [0, 10] and words.tolist() == [7, 4] and source.tolist() == [70, 1010] and not edge.any()


def test_short_passages(spark):
    rows = ["a b", "b c", "c", "b a", "d d"]
    df = spark.createDataFrame([Row(doc_id=i, text=t, bucket=None) for i, t in enumerate(rows)], SCHEMA)
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in S.duplicate_spans(df, min_words=1).collect()}
    assert got == {0: [(0, 2)], 1: [(0, 2)], 2: [(0, 1)], 3: [(0, 2)], 4: [(0, 2)]}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.duplicate_spans(df).collect() == [] and S.remove_duplicate_passages(df).collect() == []


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in S.op10_substring(spark, d).collect()}
    for doc, (toks, gone) in zip(docs, brute([x.text for x in docs], 35)):
        r = got[doc.doc_id]
        kept = " ".join(t for t, g in zip(toks, gone) if not g)
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(toks), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
