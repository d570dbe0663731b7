import hashlib
import random
import re
from collections import defaultdict
from fractions import Fraction

from terralens.llm import mixing as M

SCHEMA = "doc_id long, text string, lang string, source string, tokens string, __end string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def domain_of(source):
    return f"d{int(md5(source)[0], 16) % 4}"


def share_out(children, budget, weight):
    """children: {name: cap}; whole tokens, shortages to siblings by weight."""
    out, open_ = {}, sorted(children, key=lambda c: (children[c] / weight(c), c))
    while open_:
        c, w = open_[0], sum(map(weight, open_))
        if Fraction(budget * weight(c), w) < children[c]:
            break
        out[c] = children[c]
        budget -= children[c]
        open_.pop(0)
    w = sum(map(weight, open_))
    part = {c: budget * weight(c) // w for c in sorted(open_)}
    spare = budget - sum(part.values())
    return out | {c: p + (i < spare) for i, (c, p) in enumerate(part.items())}


def brute(rows, share, weights, epochs, seed):
    items = [(i, (domain_of(s or ""), g or "", s or ""), len(WORD.findall(t or "")), md5(t or "")) for i, t, g, s in rows]
    tree = defaultdict(int)
    for _, leaf, n, _ in items:
        for k in range(4):
            tree[leaf[:k]] += n
    if not items:
        return []
    budgets = {(): min(tree[()] * round(share * 1_000_000) // 1_000_000, tree[()] * epochs)}
    for k in range(3):
        for node in [x for x in tree if len(x) == k]:
            kids = {x[k]: tree[x] * epochs for x in tree if len(x) == k + 1 and x[:k] == node}
            got = share_out(kids, budgets[node], lambda v, k=k: weights.get(M.LEVELS[k], {}).get(v, 1))
            budgets |= {(*node, v): b for v, b in got.items()}
    out = []
    for leaf in [x for x in tree if len(x) == 3]:
        mine, b = [x for x in items if x[1] == leaf], budgets[leaf]
        whole = b // tree[leaf] if tree[leaf] else 0
        out += [(i, *leaf, e, n) for i, _, n, _ in mine for e in range(whole)]
        rest, at = b - whole * tree[leaf], 0
        for _, n, i in sorted((md5(f"{seed}:{whole}:{'' if i is None else i}:{d}"), n, i) for i, _, n, d in mine):
            if at < rest:
                out.append((i, *leaf, whole, min(n, rest - at)))
            at += n
    return sorted(out, key=str)


def fixture():
    r = random.Random(9)
    rows = []
    for i in range(500):
        s = "src0" if i % 3 == 0 else f"src{r.randrange(9)}"
        rows.append((i, " ".join(["w"] * r.choice([0, 1, 5, 40, 300])), r.choice(["en", "en", "fr", "de", "zz"]), s))
    return rows + [(900, None, "en", "src1"), (901, "a b", None, "src1"), (902, "a b", "en", None), (903, "", "en", "src2"), (None, "x y z", "fr", "src3"), (5, "a b", "en", "src4"), (5, "a b", "en", "src4")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)


def test_matches_brute_force(spark):
    rows = fixture()
    for share, epochs in ((0.3, 1), (0.8, 2), (1.7, 2), (9, 3), (0, 1)):
        df = frame(spark, rows)
        got = M.mix(df, M.source_domain("source"), share, M.WEIGHTS, epochs, 5).collect()
        assert sorted(map(tuple, got), key=str) == brute(rows, share, M.WEIGHTS, epochs, 5)


def test_rows_keep_their_columns(spark):
    rows = fixture()
    df = frame(spark, rows)
    for share in (0.5, 1.0):
        got = M.mix_rows(df, M.source_domain("source"), share, M.WEIGHTS, 5)
        assert got.columns == df.columns
        assert sorted((r.doc_id for r in got.collect()), key=str) == sorted((x[0] for x in brute(rows, share, M.WEIGHTS, 1, 5)), key=str)


def test_repeated_rows(spark):
    one = "w " * 10
    for rows in ([(1, one, "en", "src1")] * 50, [(1, one, "en", "src1")] * 40 + [(i, one, "en", "src1") for i in range(2, 12)], [(1, "", "en", "src1")] * 20 + [(2, one, "en", "src1")] * 5):
        for share in (0.03, 0.5):
            df = frame(spark, rows)
            want = brute(rows, share, {}, 1, 5)
            assert sorted(map(tuple, M.mix(df, M.source_domain("source"), share, {}, 1, 5).collect()), key=str) == want
            got = M.mix_rows(df, M.source_domain("source"), share, {}, 5)
            assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == sorted(x[0] for x in want)


def test_empty_table(spark):
    df = frame(spark, [])
    assert M.mix(df, M.source_domain("source"), 0.5, {}).collect() == [] and M.mix_rows(df, M.source_domain("source"), 0.5, {}).collect() == []


def test_query_matches_sql_and_stays_native(spark):
    import duckdb

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as from '{d}/documents.parquet'")
    df = M.op1_mixing(spark, d)
    assert sorted(map(str, con.execute(M.SQL).fetchall())) == sorted(str(tuple(r)) for r in df.collect())
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())
