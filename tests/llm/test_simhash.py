import random
import re

import numpy as np
import xxhash

from terralens.llm import simhash as S
from terralens.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, fp string"


def fp(text, k=3):
    w = WORD.findall((text or "").translate(FOLD))
    s = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, radius):
    """least index reachable, for a list of fingerprints"""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_index_finds_all_pairs():
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(300)]
    fps = base + [b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base] + [base[0] ^ r.getrandbits(5) for _ in range(200)]
    fps = np.array(sorted(set(fps)), np.uint64)
    for n in (1, 5, 17, 400, len(fps)):
        part = fps[:n]
        index = S.GrayIndex(part, 4)
        got = {(int(part[q]), int(index.fps[m])) for qs, ms in index.search(part, 2, room=64) for q, m in zip(qs, ms)}
        want = {(int(a), int(b)) for a in part for b in part if (int(a) ^ int(b)).bit_count() <= 2}
        assert got == want


def test_links_connect_like_brute_force(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(400)]
    fps = list(dict.fromkeys([0, *base, *(b ^ (1 << r.randrange(64)) for b in base[:200]), *(base[5] ^ (1 << i) ^ (1 << j) for i in range(0, 64, 3) for j in range(64))]))
    want = classes(fps, 2)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    for block, hot in ((512, 40), (0, 1 << 16), (0, 20)):
        links = S.fingerprint_links(nodes, 2, block, hot)
        root = {x.node: x.root for x in components(links).collect()}
        group = {}
        for f, w in zip(signed, want):
            group.setdefault(w, set()).add(root.get(f, f))
        assert all(len(g) == 1 for g in group.values()) and len({min(g) for g in group.values()}) == len(group)


def test_some_choice_of_bits_is_shared():
    r = random.Random(7)
    for total, radius, size in ((10**4, 2, 512), (10**10, 2, 512), (10**13, 2, 512), (10**6, 1, 512), (10**6, 4, 512)):
        ways = S.block_masks(total, radius, size)
        masks = [sum(((1 << w) - 1) << low for low, w in way) for way in ways]
        assert all(sum(w for _, w in way) == m.bit_count() for way, m in zip(ways, masks))
        for _ in range(300):
            a = r.getrandbits(64)
            b = a
            for _ in range(radius):
                b ^= 1 << r.randrange(64)
            assert any((a ^ b) & m == 0 for m in masks)
    assert len(S.block_masks(10**9, 2, 512)) == 3 and len(S.block_masks(10**12, 2, 512)) == 6


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (7, 100), (5, 5), (200, 201), (202, 200), (300, None)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 0, 200: 200, 201: 200, 202: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_rows(spark):
    r = random.Random(4)
    vocab = [f"W{i}é" for i in range(50)]
    rows = [" ".join(r.choices(vocab, k=r.choice([0, 1, 2, 3, 4, 200]))) for _ in range(150)]
    rows += [rows[0], rows[20].upper(), None, "", " \n", "a b c d " * 2000] + [rows[60] + " end"] * 20
    ids = [1000 - i for i in range(len(rows))]
    df = spark.createDataFrame([(i, t, "x") for i, t in zip(ids, rows)], SCHEMA).repartition(3)
    got = {x.doc_id: x for x in S.near_fingerprints(df).collect()}
    fps = [fp(t) for t in rows]
    least = {}
    for i, c in zip(ids, classes(fps, 2)):
        least[c] = min(least.get(c, i), i)
    for i, f, c in zip(ids, fps, classes(fps, 2)):
        assert (got[i].fp % (1 << 64), got[i].component) == (f, least[c])
    assert S.near_fingerprints(df.filter("false")).collect() == []
    twice = S.near_fingerprints(spark.createDataFrame([(None, "a", ""), (5, "a", ""), (5, "a", "")], SCHEMA)).collect()
    assert [x.component for x in twice] == [5, 5, 5]


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [fp(x.text) for x in docs]
    want = [docs[c].doc_id for c in classes(fps, 2)]
    got = {r.doc_id: r for r in S.op6_simhash(spark, d).collect()}
    for x, f, c in zip(docs, fps, want):
        assert (got[x.doc_id].fingerprint, got[x.doc_id].component_id) == (f"{f:016x}", c)
