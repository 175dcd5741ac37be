"""Triangles and surfaces against their definitions."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from noisegrid.operators import compare, field, heights, lidar, nearest, spatial


def empty_circles(x, y, triangles):
    """Corners turn left, and no point lies inside a triangle's circle."""
    for t in triangles:
        a, b, c = ((x[i], y[i]) for i in t)
        assert (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) > 0
        rows = np.array([[p[0] - x, p[1] - y] for p in (a, b, c)])
        q = (rows**2).sum(axis=1)
        inside = q[0] * (rows[1, 0] * rows[2, 1] - rows[2, 0] * rows[1, 1]) - q[1] * (rows[0, 0] * rows[2, 1] - rows[2, 0] * rows[0, 1]) + q[2] * (rows[0, 0] * rows[1, 1] - rows[1, 0] * rows[0, 1])
        assert (inside <= 1e-6 * q.max(axis=0)).all()


def hull_area(points):
    points, hull = sorted(points), []
    for line in (points, points[::-1]):
        part = []
        for p in line:
            while len(part) > 1 and (part[-1][0] - part[-2][0]) * (p[1] - part[-2][1]) <= (part[-1][1] - part[-2][1]) * (p[0] - part[-2][0]):
                part.pop()
            part.append(p)
        hull += part[:-1]
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(hull, hull[1:] + hull[:1], strict=True)) / 2


def area(x, y, t):
    return sum((x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a]) for a, b, c in t) / 2


@pytest.mark.parametrize("seed", range(12))
def test_triangles_have_empty_circles(seed):
    """Random points, lattices whose squares have no unique triangles, lines with points beside them."""
    rng = np.random.default_rng(seed)
    if seed % 3 == 0:
        x, y = rng.uniform(0, 500, (2, 150))
    elif seed % 3 == 1:
        x, y = np.unique(rng.integers(0, 9, (60, 2)), axis=0).T.astype(float) * 10
    else:
        x, y = np.r_[np.arange(20.0), rng.uniform(0, 20, 30)], np.r_[np.zeros(20), rng.uniform(1, 9, 30)]
    t = field.triangulate(x, y)
    empty_circles(x, y, t)
    whole = hull_area(list(zip(x, y, strict=True)))
    assert area(x, y, t) == pytest.approx(whole, rel=0.02) if seed % 3 != 1 else area(x, y, t) == pytest.approx(whole)
    assert len({tuple(sorted(k)) for k in t.tolist()}) == len(t)


def test_few_or_straight_points_have_no_triangles():
    for x, y in (([], []), ([1.0], [2.0]), ([1.0, 2.0], [2.0, 3.0]), (list(map(float, range(9))), [0.0] * 9)):
        assert len(field.triangulate(np.array(x, float), np.array(y, float))) == 0


def test_filling_equals_each_centre_in_its_triangle():
    rng = np.random.default_rng(3)
    x, y, v = rng.uniform(-20, 120, (3, 60))
    t = field.triangulate(x, y)
    got = field.fill_triangles(t, x, y, v, 0.0, 0.0, 5.0, 20)
    for r in range(20):
        for k in range(20):
            u, w, want = (k + 0.5) * 5, (r + 0.5) * 5, None
            for a, b, c in t:
                d = (y[b] - y[c]) * (x[a] - x[c]) + (x[c] - x[b]) * (y[a] - y[c])
                wa = ((y[b] - y[c]) * (u - x[c]) + (x[c] - x[b]) * (w - y[c])) / d
                wb = ((y[c] - y[a]) * (u - x[c]) + (x[a] - x[c]) * (w - y[c])) / d
                if min(wa, wb, 1 - wa - wb) >= 0:
                    want = wa * v[a] + wb * v[b] + (1 - wa - wb) * v[c]
            assert np.isnan(got[r, k]) if want is None else got[r, k] == pytest.approx(want, abs=1e-6)


def test_a_crowded_cell_is_met_by_means(spark):
    """Many receivers in one place are one point of the mesh, wherever they stand in it."""
    rnd = random.Random(1)
    rows = [(0, 0, 10.0 * i + 5, 10.0 * j + 5, 50.0) for i, j in combinations(range(12), 2)] + [(0, 0, 60.2 + rnd.random() / 10, 20.2 + rnd.random() / 10, 50.0 + k % 2 * 10) for k in range(2000)]
    frame = spark.createDataFrame(rows, "home_e int, home_n int, x double, y double, laeq double")
    got = field.mesh_surface(frame, 5.0, 60.0, 100.0).collect()
    assert got and max(r.value for r in got) <= 55.0 + 1e-9


# Nearest without a limit


def brute_nearest(points, sites, k):
    out = set()
    for p, x, y in points:
        near = sorted((math.hypot(x - sx, y - sy), s) for s, sx, sy in sites)[:k]
        out |= {(p, s, round(d, 6), r + 1) for r, (d, s) in enumerate(near)}
    return out


def nearest_of(spark, points, sites, k, **more):
    frames = spark.createDataFrame(points, "pk int, x double, y double"), spark.createDataFrame(sites, "site_id int, ix double, iy double")
    away = lambda: F.hypot(F.col("x") - F.col("ix"), F.col("y") - F.col("iy"))
    return nearest.k_nearest(*frames, k, away, "pk", "site_id", **more)


def test_k_nearest_on_uneven_ground(spark):
    """A crowded block, a thin plain and a far outlier, on both sides of the origin; most points in one place."""
    rnd = random.Random(5)
    sites = [(k, rnd.uniform(0, 40), rnd.uniform(0, 40)) for k in range(150)] + [(200 + k, rnd.uniform(-9e3, 9e3), rnd.uniform(-9e3, 9e3)) for k in range(60)] + [(999, 4e6, -3e6)]
    points = [(k, rnd.uniform(-1e4, 1e4), rnd.uniform(-1e4, 1e4)) for k in range(60)] + [(100 + k, 20.0 + k % 7, 20.0) for k in range(90)] + [(300, 3e6, -3e6), (301, 41.0, 0.0)]
    for k in (1, 5):
        got = {(r.pk, r.site_id, round(r.distance, 6), r.rank) for r in nearest_of(spark, points, sites, k, crowd=16, most=8).collect()}
        assert got == brute_nearest(points, sites, k)
    few = [(1, 5.0, 5.0), (2, -700.0, 1e5)]
    assert {(r.pk, r.site_id, round(r.distance, 6), r.rank) for r in nearest_of(spark, points[:5], few, 4).collect()} == brute_nearest(points[:5], few, 4)
    assert nearest_of(spark, points, [(1, 0.0, 0.0)], 1).count() == len(points) and nearest_of(spark, [(1, None, 2.0)], few, 1).count() == 0


def test_a_crowded_cell_is_dealt_out(spark):
    """All points in one small cell: no key that points meet leaves by has more than a hand of them."""
    points = [(k, 10.0 + k % 5, 10.0) for k in range(3000)]
    got = nearest_of(spark, points, [(1, 0.0, 0.0), (2, 30.0, 30.0)], 1, crowd=100)
    assert got.count() == 3000
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_hand" in text and "Cartesian" not in text


def most_rows(spark, df):
    """The largest number of rows that a step of the plan gives out, and the rows."""
    before = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = df.collect()
    spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty()
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    last = store.executionsList().apply(int(store.executionsCount()) - 1)
    assert store.executionsCount() > before
    values = store.executionMetrics(last.executionId())
    for k in range(last.metrics().size()):
        metric = last.metrics().apply(k)
        if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
            most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most, got


@pytest.mark.parametrize("kind", ["sites", "segments", "copies"])
def test_points_meet_few_items_on_dense_ground(spark, kind):
    """4,000 points and 3,000 items in 200 m: a step gives out far fewer rows than the 12 million pairs."""
    rnd = random.Random(11)
    points = [(k, rnd.uniform(0, 200), rnd.uniform(0, 200)) for k in range(4000)]
    frame = spark.createDataFrame(points, "pk int, x double, y double")
    if kind == "segments":
        rows = [(k, *a, a[0] + rnd.uniform(-3, 3), a[1] + rnd.uniform(-3, 3)) for k in range(3000) for a in [(rnd.uniform(0, 200), rnd.uniform(0, 200))]]
        most, got = most_rows(spark, spatial.nearest_segment(frame, spark.createDataFrame(rows, "seg_id int, ax double, ay double, bx double, by double"), 300.0))
    else:
        spots = [(rnd.uniform(0, 200), rnd.uniform(0, 200)) for _ in range(3000 if kind == "sites" else 20)]
        rows = [(k, *spots[k % len(spots)]) for k in range(3000)]
        most, got = most_rows(spark, spatial.knn(frame, spark.createDataFrame(rows, "site_id int, sx double, sy double"), 3, 200.0))
        want = brute_nearest(points[:200], rows, 3)
        assert {(r.pk, r.site_id, round(r.distance, 6), r.rank) for r in got if r.pk < 200} == {w for w in want if w[2] <= 200}
    assert len({r.pk for r in got}) == 4000 and most < 300_000


def test_sites_in_one_place_look_around_once(spark):
    """400 sites in 4 places and 3,000 receivers around them: 1.2 million pairs."""
    rnd = random.Random(3)
    results = [(k, rnd.uniform(0, 100), rnd.uniform(0, 100), 40.0 + k % 30) for k in range(3000)]
    sites = [(k, 40.0 + k % 4, 50.0, 0.0) for k in range(400)]
    most, got = most_rows(spark, compare.match_monitors(spark.createDataFrame(sites, "site_id int, x double, y double, uncertainty_m double"), spark.createDataFrame(results, "pk int, x double, y double, level double"), 100.0))
    for r in got:
        near = sorted((math.hypot(x - 40.0 - r.site_id % 4, y - 50.0), level) for _, x, y, level in results)[:3]
        assert r.model == pytest.approx(sorted(level for _, level in near)[1]) and r.distance == pytest.approx(near[0][0])
    assert len(got) == 400 and most < 100_000


def test_buildings_in_one_place_count_together(spark):
    """1,500 buildings in 5 places, heights of 4 values or unknown: 2 million pairs."""
    rows = [(k, 10.0 * (k % 5), 0.0, None if k % 7 == 0 else 3.0 + k % 4) for k in range(1500)]
    most, got = most_rows(spark, heights.neighbour_stats(spark.createDataFrame(rows, "bld_id int, cx double, cy double, height_m double"), 15.0))
    for r in [r for r in got if r.bld_id % 50 < 8]:
        near = [h for k, x, _, h in rows if h is not None and k != r.bld_id and abs(x - rows[r.bld_id][1]) <= 15]
        assert (r.n, r["median"], r["mean"]) == (len(near), pytest.approx(np.median(near)), pytest.approx(np.mean(near)))
    assert len(got) == 1500 and most < 10_000


# Points by depth


def test_point_table_by_depth(spark, tmp_path):
    """All depths hold each point once; a depth and those before it have one point of each voxel; a box reads only the
    partitions that it touches."""
    rnd = random.Random(7)
    rows = [(k, rnd.uniform(-500, 2500), rnd.uniform(0, 1500), rnd.uniform(0, 30)) for k in range(3000)] + [(5000 + k, 10.0, 10.0, 1.0) for k in range(500)]
    points = spark.createDataFrame(rows, "pk int, x double, y double, z double")
    path = str(tmp_path / "points")
    lidar.write_points(points, path, "pk", 256.0, 4, points_a_file=200)
    table = spark.read.parquet(path)
    stored = table.collect()
    assert sorted((r.pk, r.x, r.y, r.z) for r in stored) == sorted(rows)
    for depth, size in enumerate((256.0, 128.0, 64.0, 32.0)):
        voxel = lambda x, y, z: tuple(math.floor(v / size) for v in (x, y, z))  # noqa: B023, E731
        seen = [voxel(r.x, r.y, r.z) for r in stored if r.depth <= depth]
        assert len(seen) == len(set(seen)) and set(seen) == {voxel(*r[1:]) for r in rows}
    box = lidar.scan_points(table, 1100.0, 100.0, 1900.0, 900.0, 2)
    assert {r.pk for r in box.collect()} == {r.pk for r in stored if r.depth <= 2 and 1100 <= r.x <= 1900 and 100 <= r.y <= 900}
    read = {"/".join(r[0].split("/")[-4:-1]) for r in box.select(F.input_file_name()).distinct().collect()}
    assert read == {f"depth={d}/cell_e=1/cell_n=0" for d in range(3)}
    plan = box._jdf.queryExecution()
    leaf = plan.executedPlan().collectLeaves().apply(0)
    plan.executedPlan().executeCollect()
    assert leaf.metrics().apply("numFiles").value() == len(list((tmp_path / "points").glob("depth=[012]/cell_e=1/cell_n=0/*.parquet")))


def test_curve_keeps_neighbours_together(spark):
    rows = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y")).withColumn("p", lidar.curve_place(F.col("x"), F.col("y"), 3)).collect()
    assert sorted(r.p for r in rows) == list(range(64))
    assert {(r.x, r.y) for r in rows if r.p < 16} == {(x, y) for x in range(4) for y in range(4)}
