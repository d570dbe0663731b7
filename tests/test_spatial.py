import math
import random

from pyspark.sql import functions as F

from terralens.functions.geo import haversine, in_ring
from terralens.operators import spatial as S


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(h))


def inside(lon, lat, ring):
    hit = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > lat) != (y2 > lat) and lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1:
            hit = not hit
    return hit


def test_haversine(spark):
    r = random.Random(1)
    pts = [(r.uniform(-4, 13), r.uniform(-79, -66), r.uniform(-4, 13), r.uniform(-79, -66)) for _ in range(50)]
    df = spark.createDataFrame(pts, "a double, b double, c double, d double")
    for row in df.withColumn("km", haversine(*map(F.col, "abcd"))).collect():
        assert math.isclose(row.km, km((row.a, row.b), (row.c, row.d)), rel_tol=1e-12)


def test_nearest_matches_brute_force(spark):
    r = random.Random(2)
    cents = [(i, i, r.uniform(-60, 60), r.uniform(-79, -60)) for i in range(80)] + [(80, 80, 5.0, -70.0), (81, 81, 5.0, -70.0)]
    pts = [(i, r.uniform(-60, 60), r.uniform(-79, -60)) for i in range(400)] + [(400, 5.1, -70.0)]
    c = spark.createDataFrame(cents, "cod int, ord int, lat double, lon double")
    p = spark.createDataFrame(pts, "id int, lat double, lon double")
    for radius in (50.0, 400.0):
        got = {x.id: x.cod for x in S.nearest(p, c, radius, "id").collect()}
        want = {}
        for i, la, lo in pts:
            d, _, k = min((km((la, lo), (a, b)), o, k) for k, o, a, b in cents)
            if d < radius:
                want[i] = k
        assert got == want
    assert got[400] == 80  # of two at one place the first


def test_radius_edge(spark):
    per_km = math.degrees(1 / 6371.0)
    c = spark.createDataFrame([(1, 1, 0.0, 10.0)], "cod int, ord int, lat double, lon double")
    p = spark.createDataFrame([(i, d * per_km, 10.0) for i, d in enumerate((49.99, 50.01))], "id int, lat double, lon double")
    assert [x.id for x in S.nearest(p, c, 50.0, "id").collect()] == [0]


def test_polygons_match_brute_force(spark):
    r = random.Random(3)
    rings = []
    for _ in range(20):
        x, y, n = r.uniform(-78, -70), r.uniform(-3, 8), r.randrange(3, 9)
        turn = sorted(r.uniform(0, 2 * math.pi) for _ in range(n))
        rings.append([(x + 1.5 * math.cos(t), y + 1.5 * math.sin(t)) for t in turn])
    rings += [[(-75.0, 0.0), (-74.0, 0.0), (-74.0, 1.0), (-75.0, 1.0)], [(-74.0, 0.0), (-73.0, 0.0), (-73.0, 1.0), (-74.0, 1.0)]]
    pts = [(i, r.uniform(-4, 9), r.uniform(-80, -68)) for i in range(600)] + [(600, 0.0, -75.0), (601, 0.5, -74.0), (602, 1.0, -74.5), (603, 40.0, 0.0)]
    polys = spark.createDataFrame([(i, i, [{"lon": x, "lat": y} for x, y in g]) for i, g in enumerate(rings)], "cod int, ord int, ring array<struct<lon:double,lat:double>>")
    p = spark.createDataFrame(pts, "id int, lat double, lon double")
    got = {x.id: x.cod for x in S.assign_polygons(p, polys, "id").collect()}
    assert got == {i: next((k for k, g in enumerate(rings) if inside(lo, la, g)), None) for i, la, lo in pts}
    only = S.assign_polygons(p, polys, "id", outer=False).collect()
    assert {x.id for x in only} == {i for i, k in got.items() if k is not None}
    box = S.area_of_interest(polys, [20, 21]).first()
    assert tuple(box) == (-75.0, 0.0, -73.0, 1.0)


def test_ring_of_constant_latitude(spark):
    df = spark.createDataFrame([([{"lon": 0.0, "lat": 1.0}, {"lon": 2.0, "lat": 1.0}],)], "ring array<struct<lon:double,lat:double>>")
    assert df.select(in_ring(F.lit(1.0), F.lit(1.0), F.col("ring"))).first()[0] is False


def test_nearest_at_the_poles_and_across_the_date_line(spark):
    r = random.Random(4)
    cents = [(i, i, *x) for i, x in enumerate([(89.9, 10.0), (89.8, -170.0), (-90.0, 0.0), (-89.7, 90.0), (0.0, 179.95), (0.2, -179.9), (85.0, 179.9), (81.0, -179.9), (60.0, 180.0), (60.0, -180.0)])]
    pts = [(i, r.choice([1, -1]) * r.uniform(88.5, 90), r.uniform(-180, 180)) for i in range(150)]
    pts += [(200 + i, r.uniform(-1, 1), r.choice([1, -1]) * r.uniform(179, 180)) for i in range(150)]
    pts += [(400 + i, r.uniform(59, 86), r.choice([1, -1]) * r.uniform(175, 180)) for i in range(150)]
    c = spark.createDataFrame(cents, "cod int, ord int, lat double, lon double")
    p = spark.createDataFrame(pts, "id int, lat double, lon double")
    got = {x.id: x.cod for x in S.nearest(p, c, 120.0, "id").collect()}
    want = {}
    for i, la, lo in pts:
        d, _, k = min((km((la, lo), (a, b)), o, k) for k, o, a, b in cents)
        if d < 120:
            want[i] = k
    assert got == want and len(want) > 250


def test_polygons_of_very_unlike_size(spark):
    r = random.Random(5)
    sizes = [0.001, 0.01, 0.3, 2.0, 15.0, 60.0, 170.0]
    boxes = [(r.uniform(-60, 60), r.uniform(-30, 30), s) for s in sizes for _ in range(4)]
    rings = [[(x - s / 2, y - s / 4), (x + s / 2, y - s / 4), (x + s / 2, y + s / 4), (x - s / 2, y + s / 4)] for x, y, s in boxes]
    pts = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(400)] + [(1000 + i, y, x) for i, (x, y, _) in enumerate(boxes)]
    polys = spark.createDataFrame([(i, i, [{"lon": x, "lat": y} for x, y in g]) for i, g in enumerate(rings)], "cod int, ord int, ring array<struct<lon:double,lat:double>>")
    p = spark.createDataFrame(pts, "id int, lat double, lon double")
    got = {x.id: x.cod for x in S.assign_polygons(p, polys, "id").collect()}
    assert got == {i: next((k for k, g in enumerate(rings) if inside(lo, la, g)), None) for i, la, lo in pts}
    assert S.assign_polygons(p, polys.filter("false"), "id").filter("cod IS NOT NULL").count() == 0
