import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marketgrid.operators import spatial
from marketgrid.functions.columns import METRES_PER_MILE


def points(n, seed, clustered=True):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        if clustered and i % 3 == 0:      # a third of the points crowd into one cell
            out.append((i, 1000 + rnd.uniform(0, 300), 2000 + rnd.uniform(0, 300)))
        else:
            out.append((i, rnd.uniform(-80000, 80000), rnd.uniform(-80000, 80000)))
    return out


def dist(a, b):
    return math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) / METRES_PER_MILE


def test_radius_join_matches_brute_force(spark):
    circles, pts = points(60, 1), points(150, 2)
    tiers = ["metro", "micro", "rural"]
    radius = {"metro": 2.0, "micro": 9.0, "rural": 25.0}
    c = spark.createDataFrame([(i, x, y, tiers[i % 3]) for i, x, y in circles], "cid int, cx0 double, cy0 double, tier string")
    p = spark.createDataFrame(pts, "pid int, px double, py double")
    r = spark.createDataFrame(list(radius.items()), "tier string, radius_miles double")
    got = {(x.cid, x.pid) for x in spatial.radius_join(c, p, r).select("cid", "pid").collect()}
    want = {(a[0], b[0]) for a in circles for b in pts if dist(a, b) <= radius[tiers[a[0] % 3]]}
    assert got == want
    sums = spatial.radius_sums(c, p.withColumn("w", F.lit(1)), r, ["cid"], ["w"])
    count = {x.cid: x.w for x in sums.collect()}
    assert count == {i: sum(1 for a in want if a[0] == i) for i in {a[0] for a in want}}


@pytest.mark.parametrize("crowded,levels", [(64, 4), (3, 4), (3, 2), (0, 3)])
def test_sums_in_a_crowd(spark, crowded, levels):
    """Thousands of places within one radius: whole cells, rim cells and their finer ones add up to the exact sums."""
    rnd = random.Random(7)
    pts = [(i, rnd.gauss(0, 1500), rnd.gauss(0, 1500)) for i in range(3000)] + [(3000 + i, 40.0, 40.0) for i in range(50)]
    circles = pts[:40] + [(9000, 9e5, 9e5), (9001, -3000.0, 10.0), (9002, None, 1.0)]
    c = spark.createDataFrame([(i, x, y, "metro") for i, x, y in circles], "cid int, cx0 double, cy0 double, tier string")
    p = spark.createDataFrame(pts + [(1, None, 2.0)], "pid int, px double, py double").withColumn("w", F.lit(1)).withColumn("v", F.col("pid"))
    r = spark.createDataFrame([("metro", 1.5)], "tier string, radius_miles double")
    got = {x.cid: (x.w, x.v) for x in spatial.radius_sums(c, p, r, ["cid"], ["w", "v"], crowded, levels).collect()}
    want = {}
    for a in circles:
        near = [b[0] for b in pts if a[1] is not None and dist(a, b) <= 1.5]
        if near:
            want[a[0]] = (len(near), sum(near))
    assert got == want


def test_nearest_other_with_copies_and_outliers(spark):
    pts = points(80, 3) + [(80, 5e6, 5e6), (81, 10.0, 10.0), (82, 10.0, 10.0)]
    df = spark.createDataFrame(pts, "id int, px double, py double")
    got = {r.id: r.nearest_miles for r in spatial.nearest_distance(df, df, ["id"], exclude_self=True).collect()}
    for a in pts:
        assert got[a[0]] == pytest.approx(min(dist(a, b) for b in pts if b[0] != a[0]))


def test_nearest_target_and_a_single_site(spark):
    q, t = points(70, 4), points(25, 5, clustered=False)
    qd = spark.createDataFrame(q, "id int, px double, py double")
    td = spark.createDataFrame(t, "tid int, px double, py double")
    got = {r.id: r.nearest_miles for r in spatial.nearest_distance(qd, td, ["id"]).collect()}
    for a in q:
        assert got[a[0]] == pytest.approx(min(dist(a, b) for b in t))
    lone = td.limit(1)
    assert spatial.nearest_distance(lone, lone, ["tid"], exclude_self=True).first().nearest_miles is None


SQUARES = {
    "A": [[(0, 0), (1, 0), (1, 1), (0, 1)]],
    "B": [[(1, 0), (2, 0), (2, 1), (1, 1)], [(1.25, 0.25), (1.25, 0.75), (1.75, 0.75), (1.75, 0.25)]],   # a hole
    "C": [[(0, 1), (1, 1), (1, 2), (0, 2)], [(3, 3), (4, 3), (4, 4), (3, 4)]],                           # two parts
}


@pytest.fixture(scope="module")
def vertices(spark):
    rows = []
    for poly, rings in SQUARES.items():
        for k, ring in enumerate(rings):
            closed = ring + [ring[0]] if poly == "A" else ring      # explicit and implicit closing
            rows += [(poly, k, s, float(x), float(y)) for s, (x, y) in enumerate(closed)]
    return spark.createDataFrame(rows, "poly_id string, ring_id int, seq int, lon double, lat double")


def test_point_in_polygon_edges_holes_parts(spark, vertices):
    pts = [("in_a", 0.5, 0.5), ("edge_ab", 1.0, 0.5), ("hole", 1.5, 0.5), ("in_b", 1.1, 0.5), ("part_c", 3.5, 3.5),
           ("edge_ac", 0.5, 1.0), ("out", 5.0, 5.0), ("none", None, 1.0)]
    df = spark.createDataFrame(pts, "id string, lon double, lat double")
    got = {(r.id, r.poly_id) for r in spatial.point_in_polygon(df, vertices, "id").collect()}
    assert got == {("in_a", "A"), ("edge_ab", "B"), ("in_b", "B"), ("part_c", "C"), ("edge_ac", "C")}


def test_one_polygon_keeps_the_least(spark):
    df = spark.createDataFrame([("p", "B"), ("p", "A"), ("q", "C")], "id string, poly_id string")
    got = {r.id: (r.poly_id, r.n_matches) for r in spatial.one_polygon(df, "id").collect()}
    assert got == {"p": ("A", 2), "q": ("C", 1)}


def test_dissolve_touch_distance(spark, vertices):
    group = F.when(F.col("poly_id").isin("A", "B"), "ab").otherwise("c")
    outline = spatial.dissolve(vertices, group)
    ab = outline.filter("group_id = 'ab'").count()
    assert ab == 6 + 4          # shared edge gone, hole kept
    assert [tuple(r) for r in spatial.touching_groups(outline).collect()] == [("ab", "c")]
    pts = spark.createDataFrame([("x", "ab", 0.5, 0.5), ("y", "ab", 0.5, 1.5)], "id string, g string, lon double, lat double")
    got = {r.id: r.miles_off for r in spatial.miles_to_outline(pts, outline, "id", "g").collect()}
    assert got["x"] == 0.0
    assert got["y"] > 1.0


def test_centroid_of_a_square(spark):
    ring = [(-90.0, 40.0), (-89.9, 40.0), (-89.9, 40.1), (-90.0, 40.1)]
    df = spark.createDataFrame([("s", 1, i, x, y) for i, (x, y) in enumerate(ring)],
                               "poly_id string, ring_id int, seq int, lon double, lat double")
    r = spatial.centroids(df).first()
    assert r.centroid_lon == pytest.approx(-89.95, abs=1e-4)
    assert r.centroid_lat == pytest.approx(40.05, abs=1e-3)
    assert r.square_miles == pytest.approx(6.9 * 5.29, rel=0.02)


def test_a_crowded_town_costs_a_far_query_little(spark):
    """20,000 sites on a square mile, queries inside, beside and far away: exact, and few sites are measured per query."""
    rng = np.random.default_rng(11)
    town = rng.uniform(0, 1609.344, (20_000, 2)) + (1_500_000, 900_000)
    rows = [(float(x), float(y)) for x, y in town]
    asked = [(1_500_800.0, 900_800.0), (1_498_000.0, 900_500.0), (1_400_000.0, 1_000_000.0), (-2_000_000.0, 3_000_000.0)]
    targets = spark.createDataFrame(rows, "px double, py double")
    queries = spark.createDataFrame([(k, *q) for k, q in enumerate(asked)], "id int, px double, py double")
    got = {r.id: r.nearest_miles for r in spatial.nearest_distance(queries, targets, ["id"]).collect()}
    for k, q in enumerate(asked):
        assert got[k] == pytest.approx(np.hypot(*(town - q).T).min() / 1609.344, rel=1e-12)
    spots = queries.selectExpr("px as qx", "py as qy")
    places = targets.withColumn("_copies", F.lit(1))
    tests = [r["count"] for r in spatial._tested(spots, places, False, 32).groupBy("qx", "qy").count().collect()]
    assert len(tests) == 4 and max(tests) < 1_000


def test_nearest_other_with_copies_and_lone_points(spark):
    rng = np.random.default_rng(12)
    points = [(float(x), float(y)) for x, y in rng.uniform(0, 3000, (150, 2))] + [(5.0, 5.0)] * 3 + [(9e5, 9e5)]
    table = spark.createDataFrame([(k, *p) for k, p in enumerate(points)] + [(999, None, 1.0)], "id int, px double, py double")
    for crowded in (1, 4, 1000):
        got = {r.id: r.nearest_miles for r in spatial.nearest_distance(table, table, ["id"], True, crowded).collect()}
        assert got.pop(999) is None
        for k, p in enumerate(points):
            want = min(np.hypot(p[0] - q[0], p[1] - q[1]) for j, q in enumerate(points) if j != k) / 1609.344
            assert got[k] == pytest.approx(want, rel=1e-12, abs=1e-12)


def star(n, seed, center=(-90.0, 40.0), size=1.0):
    """A ring of n vertices with a jagged radius."""
    rng = np.random.default_rng(seed)
    turn = np.arange(n) * 2 * np.pi / n
    radius = size * (1 + 0.3 * np.sin(7 * turn) + 0.02 * rng.random(n))
    return np.stack([center[0] + radius * np.cos(turn), center[1] + radius * np.sin(turn)], axis=1)


def ring_rows(poly, ring, xy):
    return [(poly, ring, k, float(x), float(y)) for k, (x, y) in enumerate(xy)]


def parity(rings, x, y):
    count = 0
    for xy in rings:
        a, b = xy, np.roll(xy, -1, axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            meets = a[:, 0] + (y - a[:, 1]) * (b[:, 0] - a[:, 0]) / (b[:, 1] - a[:, 1])
        count += int((((a[:, 1] > y) != (b[:, 1] > y)) & (x < meets)).sum())
    return count % 2 == 1


RING = "poly_id string, ring_id int, seq int, lon double, lat double"


def test_points_in_polygons_by_tree(spark):
    """Jagged outlines, a comb of tall teeth and a lattice with points on vertices and edges, against every edge."""
    comb = [(-80.0, 30.0)] + [p for k in range(150) for p in ((-80 + k / 50, 31.0), (-80 + k / 50 + 0.01, 30.1))] + [(-77.0, 30.0)]
    lattice = np.array([(x / 4, y / 4) for x, y in [(0, 0), (8, 0), (8, 8), (6, 8), (6, 2), (4, 2), (4, 8), (2, 8), (2, 2), (0, 2)]])
    polys = {
        "star": [star(900, 1), star(300, 2, size=0.3)],                 # with a hole
        "far": [star(60, 3, (-100.0, 35.0), 6.0), star(5, 4, (-85.0, 45.0), 0.01)],
        "comb": [np.array(comb)], "lattice": [lattice],
    }
    rows = [r for p, rings in polys.items() for k, xy in enumerate(rings) for r in ring_rows(p, k, xy)]
    rng = np.random.default_rng(5)
    spots = [(rng.uniform(lo, hi), rng.uniform(a, b)) for lo, hi, a, b in (
        (-91.5, -88.5, 38.5, 41.5), (-108, -92, 27, 43), (-80.1, -76.9, 29.9, 31.1), (-85.02, -84.98, 44.98, 45.02)) for _ in range(60)]
    spots += [(x / 8, y / 8) for x in range(-1, 18) for y in range(-1, 18)]
    points = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in enumerate(spots)] * 2 + [(-1, None, 1.0)],
                                   "id int, lon double, lat double")
    want = {(k, p) for k, (x, y) in enumerate(spots) for p, rings in polys.items() if parity(rings, x, y)}
    vertices = spark.createDataFrame(rows, RING)
    for crowded in (4, 32):
        got = [tuple(r) for r in spatial.point_in_polygon(points, vertices, "id", crowded).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert spatial.point_in_polygon(points, vertices.filter("false"), "id").count() == 0


def test_a_long_outline_costs_a_point_little(spark):
    """20,000 edges: leaves stay small, few edges are measured per point, distances and sides are exact."""
    n = 20_000
    xy = star(n, 6)
    outline = spark.createDataFrame(
        pd.DataFrame({"group_id": "g", "lon1": xy[:, 0], "lat1": xy[:, 1],
                      "lon2": np.roll(xy[:, 0], -1), "lat2": np.roll(xy[:, 1], -1)}))
    spots = [(-90.2, 40.3), (-88.0, 41.0), (-91.4, 40.0), (-70.0, 30.0), (-89.1, 40.05)]
    points = spark.createDataFrame([(k, "g", *s) for k, s in enumerate(spots)] + [(9, "g", None, None), (10, "none", -90.0, 40.0)],
                                   "id int, g string, lon double, lat double")
    got = {r.id: r.miles_off for r in spatial.miles_to_outline(points, outline, "id", "g").collect()}
    project = spatial.CONUS.forward("lon", "lat")
    flat = spark.createDataFrame(pd.DataFrame({"k": np.arange(n), "lon": xy[:, 0], "lat": xy[:, 1]})).select(
        "k", project[0].alias("x"), project[1].alias("y")).orderBy("k").toPandas()[["x", "y"]].to_numpy()
    asked = points.filter("id < 9").select("id", project[0].alias("x"), project[1].alias("y")).orderBy("id").toPandas()
    a, u = flat, np.roll(flat, -1, axis=0) - flat
    assert got.pop(9) is None and set(got) == set(range(5))
    for k, s in enumerate(spots):
        q = asked.loc[k, ["x", "y"]].to_numpy(float)
        t = np.clip(((q - a) * u).sum(1) / (u * u).sum(1), 0, 1)
        want = 0.0 if parity([xy], *s) else np.hypot(*(a + t[:, None] * u - q).T).min() / 1609.344
        assert got[k] == pytest.approx(want, rel=1e-9, abs=1e-12)
    lines = outline.selectExpr("group_id as tree_id", "lon1 as x1", "lat1 as y1", "lon2 as x2", "lat2 as y2")
    nodes, held = spatial.edge_tree(lines)
    assert held.groupBy("lv", "cx", "cy").count().agg(F.max("count")).first()[0] <= 32
    assert held.count() < 3 * n          # an edge of this jagged ring is some sixty times as long as its share of it
    near = spatial._nearest_leaves(points.filter("id < 9").selectExpr("g as tree_id", "lon as qx", "lat as qy"), nodes)
    tests = [r["count"] for r in near.join(held, ["tree_id", "lv", "cx", "cy"]).groupBy("qx", "qy").count().collect()]
    assert len(tests) == 5 and max(tests) < 1_000


def test_radius_sums_work_out_the_points_once(spark, monkeypatch):
    """However many levels the sums go down, the expression a point comes from stands in the first plan alone."""
    plans, store = [], spatial.materialise

    def storing(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return store(df)

    monkeypatch.setattr(spatial, "materialise", storing)
    points = spark.range(4_000).selectExpr(
        "pmod(id * 7919, 4001) * 1.0234567D as px", "pmod(id * 104729, 4003) * 1.0234567D as py", "id as weight")
    circles = spark.range(3).selectExpr("id as name", "id * 900.0D as cx0", "id * 700.0D as cy0", "'metro' as tier")
    radii = spark.createDataFrame([("metro", 1.0)], "tier string, radius_miles double")
    got = {r.name: r.weight for r in spatial.radius_sums(circles, points, radii, ["name"], ["weight"], 8, 3).collect()}
    metres, want = 1609.344, {}
    for c in circles.collect():
        inside = [p.weight for p in points.collect() if (p.px - c.cx0) ** 2 + (p.py - c.cy0) ** 2 <= metres ** 2]
        want[c.name] = sum(inside)
    assert got == want
    assert len(plans) > 2 and "1.0234567" in plans[0] and not any("1.0234567" in p for p in plans[1:])
