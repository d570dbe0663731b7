import math
import random

from pyspark.sql import functions as F

from terralens.operators import conformal, index, metrics, report, territory
from terralens.schema import LEVELS, WEIGHTS


def test_weights_sum_to_one():
    assert math.isclose(sum(WEIGHTS.values()), 1)


def test_log_minmax(spark):
    df = spark.createDataFrame([(0.0, 5.0), (9.0, 5.0), (99.0, 5.0)], "a double, b double")
    got = index.log_minmax(df, {"a": "ia", "b": "ib"}).collect()
    assert [r.ia for r in got] == [0.0, 0.5, 1.0] and [r.ib for r in got] == [0.0] * 3
    assert index.log_minmax(df.limit(1), {"a": "ia"}).first().ia == 0.0
    assert index.log_minmax(df.filter("false"), {"a": "ia"}).collect() == []


def test_fire_water_sensitivity(spark):
    df = spark.createDataFrame([(None, None, 0.9, 1), (99.0, 0.4, 0.5, 0), (9.0, 1.0, 0.5, 1)], "frp double, ica double, s double, pdet int")
    got = index.fire_index(df, "frp").withColumns({"w": index.water_index("ica"), "r": index.raised("s", "pdet")}).collect()
    assert [x.idx_fuego for x in got] == [0.0, 1.0, 0.5] and [x.w for x in got] == [0.0, 0.6, 0.0] and [x.r for x in got] == [1.0, 0.5, 0.75]
    assert index.fire_index(df.filter("frp is null"), "frp").first().idx_fuego == 0.0


def test_order_statistics_and_levels(spark):
    r = random.Random(4)
    for n in (1, 2, 20, 333):
        v = [round(r.random(), 2) for _ in range(n)]
        df = spark.createDataFrame([(x,) for x in v], "v double")
        want = [sorted(v)[min(n - 1, int(p * n))] for p in (0.6, 0.85, 0.95)]
        assert index.order_statistics(df, "v", (0.6, 0.85, 0.95)) == want
        for x in index.with_level(df, "v", "l").collect():
            assert x.l == LEVELS[sum(x.v >= q for q in want)]
    assert index.order_statistics(df.filter("false"), "v", (0.5,)) == [None]


def test_level_shares_without_ties(spark):
    df = spark.range(1122).withColumn("v", F.col("id").cast("double"))
    n = {r.l: r.n for r in report.frequency(index.with_level(df, "v", "l"), "l").collect()}
    assert [n[x] for x in LEVELS] == [673, 280, 112, 57]


def test_territory_joins(spark):
    spine = spark.createDataFrame([("1", "x"), ("2", "y")], "cod string, m string")
    rows = spark.createDataFrame([("1", 5.0), ("1", 9.0), ("3", 7.0), ("2", 0.0)], "cod string, v double")
    assert sorted(r.cod for r in territory.known_only(rows, spine).collect()) == ["1", "1", "2"]
    out = territory.assemble(spine, [territory.worst(rows, "cod", "v", "w"), territory.membership(rows.filter("v > 6"), "cod", "f")], "cod", ("w", "f"))
    assert sorted(map(tuple, out.collect())) == [("1", "x", 9.0, 1), ("2", "y", 0.0, 0)]
    names = spark.createDataFrame([("A", "1", 0), ("A", "2", 1)], "k string, cod string, ord int")
    assert territory.by_name(spark.createDataFrame([("A", 3)], "k string, v int"), names, "k").first().cod == "2"


def test_metrics(spark):
    pairs = [(0, 0)] * 5 + [(0, 1)] * 2 + [(1, 1)] * 3 + [(2, 0)] * 1
    df = spark.createDataFrame(pairs, "y int, p int")
    per = {r.label: r for r in metrics.per_class(df, "y", "p").collect()}
    assert math.isclose(per[0].precision, 5 / 6) and math.isclose(per[0].recall, 5 / 7) and per[2].f1 == 0 and per[2].support == 1
    s = metrics.summary(df, "y", "p").first()
    assert math.isclose(s.accuracy, 8 / 11) and math.isclose(s.baseline, 7 / 11) and s.majority == 0 and math.isclose(s.macro_f1, sum(r.f1 for r in per.values()) / 3)
    tie = spark.createDataFrame([(1, 1), (0, 0)], "y int, p int")
    assert metrics.summary(tie, "y", "p").first().majority == 0
    assert metrics.summary(df.filter("false"), "y", "p").collect() == []


def test_conformal(spark):
    p = [[0.7, 0.2, 0.1, 0.0], [0.4, 0.35, 0.25, 0.0], [0.25, 0.25, 0.25, 0.25], [0.1, 0.2, 0.3, 0.4]]
    df = spark.createDataFrame([(i, x, i % 4) for i, x in enumerate(p)], "id int, p array<double>, y int")
    s = df.withColumn("s", conformal.nonconformity("p", "y"))
    q = conformal.qhat(s, "s", 0.1).first()
    assert q.n_cal == 4 and math.isclose(q.qhat, max(1 - x[i] for i, x in enumerate(p)))
    got = {r.id: r for r in conformal.sets(df, "p", F.lit(0.7), LEVELS).collect()}
    assert got[0].conjunto_conformal == "Bajo" and got[0].certeza_calibrada == "Alta"
    assert got[1].conjunto_conformal == "Bajo / Medio" and got[2].tamano_conjunto == 1 and got[2].conjunto_conformal == "Bajo"
    many = spark.createDataFrame([(i, p[i % 4], i % 3) for i in range(201)], "id long, p array<double>, y int")
    c = conformal.coverage(many, "p", "y", (F.col("id") * 7919 + F.col("rep") * 31) % 211 * 1000 + F.col("id"), 5, 0.2).first()
    covers, sizes = [], []
    for rep in range(5):
        cal, judged = [], []
        for y in range(3):
            rows = sorted((i for i in range(201) if i % 3 == y), key=lambda i: (i * 7919 + rep * 31) % 211 * 1000 + i)
            cal, judged = cal + rows[: len(rows) // 2], judged + rows[len(rows) // 2 :]
        n = len(cal)
        level = min(1.0, math.ceil((n + 1) * 0.8) / n)
        q = sorted(1 - p[i % 4][i % 3] for i in cal)[math.ceil(level * (n - 1) - 1e-9)]
        sets = {i: [k for k, v in enumerate(p[i % 4]) if v >= 1 - q] for i in judged}
        covers.append(sum(i % 3 in s for i, s in sets.items()) / len(judged))
        sizes.append(sum(map(len, sets.values())) / len(judged))
    assert c.repeats == 5 and math.isclose(c.coverage, sum(covers) / 5) and math.isclose(c.set_size, sum(sizes) / 5)
    assert conformal.qhat(s.filter("false"), "s").collect() == []


def test_reports(spark):
    df = spark.createDataFrame([("a", 1, 0.9, "H", 2), ("a", 2, 0.5, "L", 0), ("b", 3, 0.4, "L", 0), ("c", 4, 0.3, "L", 5)], "g string, k int, v double, l string, e int")
    got = {r.g: r for r in report.rollup_groups(df, "g", F.col("l") == "H", "v", "k", 6, "e").collect()}
    assert set(got) == {"a", "c"} and got["a"].leaders == "1" and got["c"].leaders == "" and got["a"].total == 2
    cover = {r.signal: (r.n, r.percent) for r in report.coverage(df, {"e": "events"}).collect()}
    assert cover == {"events": (2, 50.0)}
    assert [r.k for r in report.top_per_group(df, 1, "g", "v", "k").orderBy("g").collect()] == [1, 3, 4]
    assert report.violations(df, {"small": F.col("v") < 0.6}).first().small == 1
