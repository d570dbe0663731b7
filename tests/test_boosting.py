import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from terralens.operators import boosting as B
from terralens.operators import model, stats
from terralens.plans.queries import QUERIES
from terralens.schema import FEATURES, INDICES, LEVELS

D = "/root/testdata/sf0.01"


def data(n=600, seed=1):
    r = np.random.default_rng(seed)
    x = np.column_stack([r.normal(size=n), r.integers(0, 4, n), r.normal(size=n), r.integers(0, 2, n), r.normal(size=n)]).astype(float)
    y = np.digitize(x[:, 0] + 0.5 * x[:, 1] * x[:, 3], [-0.5, 0.5, 1.5])
    return x, y


def leaf_of(m, t, row):
    """Down one tree, step by step."""
    at = 0
    while at < 15:
        f = m.feature[t, at]
        at = 2 * at + 1 + int(f >= 0 and row[f] > m.cut[t, at])
    return at


def expected(m, t, row, known, at=0):
    """Value of a tree when only some features are known: the others lead both ways by cover."""
    if at >= 15:
        return m.leaf[t, at - 15]
    f = int(m.feature[t, at])
    if f < 0:
        return expected(m, t, row, known, 2 * at + 1)
    if f in known:
        return expected(m, t, row, known, 2 * at + 1 + int(row[f] > m.cut[t, at]))
    share = m.cover[t, 2 * at + 1] / m.cover[t, at]
    return share * expected(m, t, row, known, 2 * at + 1) + (1 - share) * expected(m, t, row, known, 2 * at + 2)


def test_learns_and_predicts():
    x, y = data()
    m = B.fit(x, y, tuple("abcde"), 4, rounds=60)
    assert m.leaf.shape == (240, 16)
    margins = m.margins(x[:20])
    for i in range(20):
        want = [sum(m.leaf[t, leaf_of(m, t, x[i]) - 15] for t in range(c, 240, 4)) for c in range(4)]
        assert np.allclose(margins[i], want)
    fresh, truth = data(seed=2)
    assert (m.margins(fresh).argmax(axis=1) == truth).mean() > 0.9
    assert (B.fit(x, y, tuple("abcde"), 4, rounds=60).leaf == m.leaf).all()


def test_shapley_values_match_enumeration():
    x, y = data()
    m = B.fit(x, y, tuple("abcde"), 4, rounds=3)
    phi = m.shapley(x[:15])
    for i in range(15):
        for c in range(4):
            for f in range(5):
                want = 0.0
                others = [j for j in range(5) if j != f]
                for k in range(5):
                    for chosen in itertools.combinations(others, k):
                        w = math.factorial(k) * math.factorial(4 - k) / math.factorial(5)
                        want += w * sum(expected(m, t, x[i], {*chosen, f}) - expected(m, t, x[i], set(chosen)) for t in range(c, 12, 4))
                assert math.isclose(phi[i, c, f], want, abs_tol=1e-9)
    base = np.array([sum(expected(m, t, x[0], set()) for t in range(c, 12, 4)) for c in range(4)])
    assert np.allclose(phi.sum(axis=2) + base, m.margins(x[:15]))


def test_small_and_odd_tables(spark):
    df = spark.createDataFrame([(1, 0.5, 0, "z"), (2, None, 1, "z"), (3, 0.1, None, "z")], "id int, a double, y int, p string").select("id", "a", "y")
    m = B.train(df, "id", ("a",), classes=2, rounds=5)
    got = B.predict(m, df, ("low", "high")).collect()
    assert len(got) == 3 and all(abs(sum(r.p) - 1) < 1e-9 for r in got)
    none = B.train(df.filter("false"), "id", ("a",), classes=2, rounds=5)
    assert all(r.confianza == 0.5 for r in B.predict(none, df, ("low", "high")).collect())
    assert B.predict(m, df.filter("false"), ("low", "high")).collect() == []
    assert {r.feature: r.importance for r in B.importances(none, df).collect()} == {"a": 0.0}


def test_large_tables_are_sampled(spark, monkeypatch):
    monkeypatch.setattr(B, "MAX_ROWS", 500)
    df = spark.range(5000).select("id", (F.col("id") % 100).cast("double").alias("a"), (F.col("id") % 100 >= 50).cast("int").alias("y"))
    m = B.train(df, "id", ("a",), classes=2, rounds=20)
    # half the rows weigh 1/2 in the first round's curvature
    assert abs(m.cover[0, 0] - 500 * 0.9 / 2) < 30
    assert (B.predict(m, df, ("0", "1")).filter("riesgo_pred <> string(y)").count()) == 0


def test_model_of_territories(spark):
    """The fifteen columns, better than naming the commonest level, all four levels told
    apart, all columns weighed, and three of the five indices among the first five."""
    assert len(FEATURES) == 15 and "focos_7d" in FEATURES and set(INDICES) < set(FEATURES)
    rows = QUERIES["model_evaluation"](spark, D).collect()
    assert {r.label for r in rows} == {0, 1, 2, 3} and rows[0].accuracy > rows[0].baseline and rows[0].macro_f1 > 0.5
    assert all(sum(r[f"pred_{k}"] for k in range(4)) == r.support for r in rows) and sum(r.support for r in rows) == rows[0].n
    imp = [r.feature for r in sorted(QUERIES["model_importances"](spark, D).collect(), key=lambda r: -r.importance)]
    assert set(imp) == set(FEATURES) and len(set(imp[:5]) & set(INDICES)) >= 3
    p = QUERIES["model_train_predict"](spark, D).collect()
    assert all(0 <= r.confianza <= 1 and r.riesgo_pred in LEVELS for r in p) and len(p) == 1500
    for level in LEVELS:
        n = sum(r.riesgo_nivel == level for r in p)
        assert sum(r.is_test for r in p if r.riesgo_nivel == level) == math.floor(n * 0.25 + 0.5)
    c = QUERIES["model_coverage"](spark, D).first()
    assert c.repeats == 100 and 0.85 < c.coverage < 0.97 and c.set_size < 1.5
    why = QUERIES["model_attributions"](spark, D).collect()
    assert len(why) == 4 * 1500 and {r.place for r in why} == {1, 2, 3, 4}


def test_ranks_match_sorting(spark):
    r = np.random.default_rng(3)
    rows = [(int(g), float(v)) for g, v in zip(r.integers(0, 3, 5000), np.round(r.lognormal(0, 4, 5000), 3))] + [(0, 0.0)] * 3000 + [(3, 7.0)] + [(1, None)] * 5
    df = spark.createDataFrame(rows, "g int, v double")
    ranks = [F.lit(0), F.floor(F.col("n") * 0.37), F.col("n") - 1, F.col("n") + 5]
    got = {x.g: x for x in stats.at_ranks(df, "v", ["g"], ranks).collect()}
    for g in range(4):
        v = sorted(b for a, b in rows if a == g and b is not None)
        n = len(v)
        assert (got[g].n, got[g].v0, got[g].v1, got[g].v2, got[g].v3) == (n, v[0], v[math.floor(n * 0.37)], v[-1], None)
    big = spark.range(10_000).select(F.xxhash64("id").alias("h"))
    v = sorted(x.h for x in big.collect())
    assert stats.at_ranks(big, "h", [], [F.lit(1234), F.lit(9999)]).select("v0", "v1").first() == (v[1234], v[9999])
    assert stats.at_ranks(df.filter("false"), "v", [], [F.lit(0)]).collect() == [] and stats.percentile(df.filter("false"), "v", 0.5).collect() == []
    assert math.isclose(stats.percentile(df.filter("g = 2"), "v", 0.97).first().p, np.quantile([b for a, b in rows if a == 2], 0.97))


def test_split_by_class(spark):
    df = spark.createDataFrame([(i, i % 3 if i < 90 else 5) for i in range(91)] + [(500, None)], "id int, y int")
    got = model.stratified_split(df, "y", model.hashed_order("id")).collect()
    assert len(got) == 92 and {y: sum(r.is_test for r in got if r.y == y) for y in (0, 1, 2, 5, None)} == {0: 8, 1: 8, 2: 8, 5: 0, None: 0}
