import random
import re

from terralens.llm import simhash as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, __rid string"


def shingles(text, k=5):
    w = WORD.findall((text or "").translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def groups(texts, threshold=0.8):
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (not a and not b) or (a | b and len(a & b) / len(a | b) >= threshold):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def fixture():
    r = random.Random(8)
    vocab = [f"word{i}" for i in range(400)]
    rows = [" ".join(r.choices(vocab, k=r.choice([1, 3, 4, 5, 6, 30, 80, 300]))) for _ in range(150)]
    for t in rows[:100]:
        for share in (0.005, 0.02, 0.04, 0.06):
            w = t.split()
            for i in range(len(w)):
                if r.random() < share:
                    w[i] = r.choice(vocab)
            rows.append(" ".join(w))
    rows += [rows[3].upper(), None, "", " \n", rows[60] + " tail", "a " * 500] + [rows[90]] * 30
    for _ in range(120):  # one large group of near copies
        w = rows[149].split() + vocab[:200]
        w[r.randrange(len(w))] = "changed"
        rows.append(" ".join(w))
    r.shuffle(rows)
    return rows


def test_groups_match_brute_force(spark):
    rows = fixture()
    df = spark.createDataFrame([(2000 - i, t, "x") for i, t in enumerate(rows)], SCHEMA).repartition(3)
    got = S.drop_near_duplicates(df)
    assert got.columns == df.columns
    want = {}
    for i, g in enumerate(groups(rows)):
        want[g] = min(want.get(g, 2000 - i), 2000 - i)
    kept = got.collect()
    assert sorted(x.doc_id for x in kept) == sorted(want.values()) and all(x["__rid"] == "x" for x in kept)


def test_crowded_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(S, "CROWD", 7)
    test_groups_match_brute_force(spark)


def test_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b", ""), (1, "a b", ""), (None, "a b", ""), (None, "c", ""), (None, None, "")], SCHEMA)
    assert sorted(map(str, ((x.doc_id, x.text) for x in S.drop_near_duplicates(df).collect()))) == ["(1, 'a b')", "(None, 'c')", "(None, None)"]
    assert S.drop_near_duplicates(df.filter("false")).collect() == []
    assert S.drop_near_duplicates(df.filter("text is null")).count() == 1


def test_copies_with_a_long_repeated_run(spark):
    # the run sets the fingerprint of the copy, and adds few shingles to its set
    r = random.Random(3)
    rows = []
    for i in range(30):
        w = [f"w{i}x{r.randrange(10**6)}" for _ in range(300)]
        rows += [" ".join(w), " ".join(w + ["junk"] * r.randrange(150, 401))]
    apart = [bin(a ^ b).count("1") for a, b in zip(*[iter([S.simhash(S.shingle_hashes(t, 5)) for t in rows])] * 2, strict=True)]
    assert max(apart) > 30
    assert groups(rows) == [i - i % 2 for i in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], SCHEMA).repartition(3)
    assert sorted(x.doc_id for x in S.drop_near_duplicates(df).collect()) == list(range(0, 60, 2))
