"""What decides memory and time on larger tables: what is computed once, met once and never broadcast by a guess."""

import math
import random

import pytest
from pyspark.sql import functions as F

from noisegrid.functions import geometry as G
from noisegrid.operators import compare, events, field, heights, lidar, nearest, roads, tiles
from noisegrid.operators import spatial as S
from noisegrid.streaming import stateful


def square(x, y, half=5.0):
    return [(x - half, y - half), (x + half, y - half), (x + half, y + half), (x - half, y + half), (x - half, y - half)]


RING = "ring array<struct<x: double, y: double>>"


def test_a_rings_edges_are_computed_once(spark):
    ring = F.col("ring")
    assert all(str(f(ring)).count("zip_with") == 1 for f in (G.crosses_itself, G.ring_stats, G.ring_area))
    bow = [(0.0, 0.0), (10.0, 10.0), (10.0, 0.0), (0.0, 10.0), (0.0, 0.0)]
    touching = [(0.0, 0.0), (10.0, 0.0), (0.0, 0.0)]
    got = spark.createDataFrame([(1, square(0, 0)), (2, bow), (3, touching), (4, [])], "k int, " + RING).select("k", G.crosses_itself(ring)).collect()
    assert dict(got) == {1: False, 2: True, 3: False, 4: False}


def test_sides_repeated_in_cells_are_not_broadcast(spark):
    points = spark.range(5).select(F.col("id").alias("pk"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    lines = spark.range(5).select(*[F.lit(v).alias(n) for n, v in (("ax", 0.0), ("ay", 0.0), ("bx", 9.0), ("by", 9.0))])
    sites = spark.range(5).select(F.lit(1.0).alias("sx"), F.lit(1.0).alias("sy"))
    rings = spark.createDataFrame([(square(0, 0),)], RING)
    for df in (S.near_segments(points, lines, 10.0), S.within(points, sites, 10.0), S.points_in_polygons(points, rings), S.points_in_polygons(points, rings, 250.0)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan and df.count() in (5, 25)


def test_polygons_of_any_size_count_their_points_once(spark):
    """Copies of points and rings, rings of very unequal size, one below no cell border and one over many."""
    at = [(float(i % 40), float(i // 40 * 3)) for i in range(400)] * 2
    points = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(at)], "pk long, x double, y double")
    shapes = [(1, square(3.3, 3.3, 0.4)), (2, square(20.2, 9.1, 7.5)), (3, square(20.2, 9.1, 7.5)), (4, square(0.5, 0.5, 300.0)), (5, square(900.0, 0.0))]
    want = {}
    for p, ring in shapes:
        inside = [k for k, (x, y) in enumerate(at) if ring[0][0] < x < ring[1][0] and ring[0][1] < y < ring[2][1]]
        if inside:
            want[p] = (len(inside), min(inside))
    got = S.count_in_polygons(points, spark.createDataFrame(shapes, "poly_id long, " + RING))
    assert {r.poly_id: (r.n, r.first) for r in got.collect()} == want and want[2] == want[3] and 5 not in want


def met_rows(df):
    """How many rows leave the joins of a plan, as its metrics tell."""
    df.collect()
    plan, out = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return walk(node.plan())
        if name == "ReusedExchangeExec":
            return walk(node.child())
        if name.endswith("SortMergeJoinExec"):
            out.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    return max(out)


def test_receivers_in_one_place_have_their_ceiling_once(spark):
    points = spark.range(200).select(F.col("id").alias("pk"), (F.col("id") % 2).cast("double").alias("x"), F.lit(5.0).alias("y"))
    segments = spark.range(30).select(F.col("id").alias("seg_id"), F.lit(0.0).alias("ax"), F.lit(0.0).alias("ay"), F.lit(9.0).alias("bx"), F.lit(0.0).alias("by"), F.lit(1.0).alias("power"))
    found = compare.ceiling_level(points, segments, 100.0)
    assert found.count() == 200 and found.select("level").distinct().count() == 2 and met_rows(found) <= 200


def test_deck_points_of_one_place_and_height_are_counted_once(spark):
    points = spark.range(300).select((F.col("id") % 1 + 5.0).alias("x"), (F.col("id") % 1 * 1.0).alias("y"), F.when(F.col("id") % 3 == 0, 8.0).otherwise(6.0).alias("z"), F.lit(17).alias("cls"))
    decks = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 0.0)], "edge_id int, seq int, ax double, ay double, bx double, by double")
    found = lidar.deck_profile(points, decks)
    assert [tuple(r) for r in found.select("station", "z").orderBy("station").collect()] == [(0, 6), (5, 6), (10, 6)] and met_rows(found) <= 10


def test_places_and_rings_that_repeat_are_met_once(spark):
    points = spark.createDataFrame([(k, "a", 0.5 + k % 2, 0.0) for k in range(40)], "pk int, receiver_key string, x double, y double")
    records = spark.range(50).select(F.lit("f").alias("family"), F.col("id").alias("site_id"), F.lit(1.0).alias("sx"), F.lit(0.0).alias("sy"))
    parcels = spark.createDataFrame([("p", k, square(0.0, 0.0)) for k in range(50)], "family string, poly_id long, " + RING)
    near = events.inspect_point(points, records, parcels, 10.0, 3)
    assert near.count() == 120 and {(r.family, r.id) for r in near.collect()} == {("f", 0), ("p", 0), ("p", 1)} and met_rows(near) <= 200
    beside = tiles.beside_walls(points.select(F.col("pk").cast("string").alias("receiver_key"), "x", "y"), parcels, 2.0)
    assert beside.count() == 40 and met_rows(beside) <= 80


def test_nearest_building_by_places(spark):
    rows = [(k, 0.0 if k < 30 else 40.0 if k < 31 else 500.0, 0.0, 5.0, square(0.0, 0.0)) for k in range(32)]
    found = heights.height_features(spark.createDataFrame(rows, "bld_id int, cx double, cy double, height_m double, " + RING))
    assert {r.bld_id: r.nearest for r in found.collect()} == {**{k: 0.0 for k in range(30)}, 30: 40.0, 31: None}


def test_contours_meet_points_in_batches_of_every_task(spark):
    """More points than a batch in one cell, contours over several cells, rings without an inner one, and what is null."""
    points = spark.range(2000).select(F.col("id").alias("pk"), (F.col("id") % 40 * 50.0 - 1000).alias("x"), (F.floor(F.col("id") / 40) * 2.0).alias("y"))
    rows = [("a", 65.0, square(0, 0, 800.0)), ("a", 70.0, square(0, 0, 400.0)), ("b", 60.0, square(100, 0, 300.0)), ("b", 60.0, square(900, 0, 20.0)), (None, 60.0, square(0, 0)), ("c", 60.0, None), ("d", 60.0, [])]
    found = lidar.contour_level(points, spark.createDataFrame(rows, "airport string, level double, " + RING))
    assert met_rows(found) <= 200
    want = {}
    for p in points.collect():
        out, deep = 800 - max(abs(p.x), abs(p.y)), 400 - max(abs(p.x), abs(p.y))
        if -800 <= p.x < 800:
            far = max(abs(p.x) - 400, 0.0)
            want[p.pk, "a"] = 70 + 5 * min(1.0, deep / 400) if -400 <= p.x < 400 else 65 + 5 * out / (out + far)
        for middle, half in ((100, 300.0), (900, 20.0)):
            if middle - half <= p.x < middle + half and p.y < half:
                want[p.pk, "b"] = 60 + 5 * min(1.0, (half - max(abs(p.x - middle), p.y)) / half)
    got = {(r.pk, r.airport): r.level for r in found.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_tracks_of_the_same_segments_are_met_once(spark):
    tracks = spark.range(100).select(F.col("id").cast("int").alias("edge_id"), F.lit(0).alias("seq"), *[F.lit(v).alias(n) for n, v in (("ax", 0.0), ("ay", 0.0), ("bx", 200.0), ("by", 0.0))])
    found = roads.parallel_tracks(tracks)
    assert {r.tracks for r in found.collect()} == {100} and found.count() == 100 and met_rows(found) <= 1000
    crossings = spark.createDataFrame([(1, 10.0, 5.0), (1, 20.0, 1.0), (2, 20.0, 1.0)], "crossing_id int, x double, y double")
    got = roads.crossings_on_track(tracks, crossings)
    assert got.count() == 200 and {(r.crossing_id, r.station) for r in got.collect()} == {(1, 20.0), (2, 20.0)}


def test_a_source_alike_at_all_samples_has_none(spark):
    track = spark.createDataFrame([(1, 0, 0.0, -500.0, 0.0, 100.0, 500.0, 0.0)], "track_id int, seq int, t1 double, x1 double, y1 double, t2 double, x2 double, y2 double")
    sites = spark.createDataFrame([(1, 0.0, 50.0)], "site_id int, ox double, oy double")
    plain, air = (events.moving_source_sel(track, sites, [(1000.0, 80.0)], air_db_km=a) for a in (None, [1e-9]))
    assert "_nodes" not in plain._jdf.queryExecution().optimizedPlan().toString() and abs(plain.first().sel - air.first().sel) < 1e-6


def test_depths_take_one_deal_and_a_point_off_roads_one_join(spark):
    points = spark.range(300).select(F.col("id").alias("pk"), (F.col("id") * 7.0).alias("x"), (F.col("id") % 9 * 5.0).alias("y"), (F.col("id") % 5 * 3.0).alias("z"))
    depths = lidar.with_depth(points, "pk", 64.0, 4)
    assert depths._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1 and depths.count() == 300
    roads_ = spark.createDataFrame([(0.0, 0.0, 700.0, 0.0, 100.0)] * 3, "ax double, ay double, bx double, by double, aadt double")
    off = field.mesh_points(points, roads_)
    plan = off._jdf.queryExecution().executedPlan().toString()
    want = {r.pk for r in points.collect() if r.y > 8 or r.x > 708}
    assert {r.pk for r in off.collect()} == want and plan.count("SortMergeJoin") == 1


class _State(dict):
    """A state variable of a stream that counts what reaches it."""

    calls = 0

    def exists(self):
        return "value" in self

    def get(self, *_):
        return self["value"]

    def update(self, value):
        self["value"] = value

    def iterator(self):
        return iter(list(self.items()))

    def containsKey(self, key):
        self.calls += 1
        return key in self

    def updateValue(self, key, value):
        self.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.calls += 1
        del self[key]


def test_ids_of_windows_that_close_in_their_batch_stay_out_of_the_state():
    import pandas as pd

    def run(most_held):
        p = stateful.LevelProcessor(3600.0, 600.0, None, most_held)
        p.clock, p.windows, p.ids = _State(), _State(), _State()
        out = []
        for low, high in ((0, 900), (800, 1300)):
            epochs = [float(k * 10) for k in range(low, high)] * 2
            chunk = pd.DataFrame({"event_id": [f"e{t}" for t in epochs], "epoch": epochs, "sel": 50.0})
            out += [r for f in p.handleInputRows(("s",), iter([chunk.iloc[:700], chunk.iloc[700:]]), None) for r in f[["kind", "start", "n"]].fillna(0).itertuples(index=False, name=None)]
        return sorted(out), p.ids.calls, len(p.windows)

    held, spilt = run(1_000_000), run(100)
    assert held[0] == spilt[0] and [r for r in held[0] if r[0] == "level"] == [("level", 0.0, 360), ("level", 3600.0, 360), ("level", 7200.0, 360)]
    assert held[1] < 1500 and held[2] == spilt[2] == 1


@pytest.mark.parametrize("kind", ["sites", "segments", "kinds"])
def test_plans_of_the_nearest_dont_grow_with_their_steps(spark, kind):
    """2,000 places in a few small cells, of which each is split several times, and two points in each; the plan that is
    left has a few shuffles."""
    rnd = random.Random(2)
    at = [(rnd.uniform(0, 90), rnd.uniform(0, 90)) for _ in range(2000)]
    points = spark.createDataFrame([(k, *at[k % 2000]) for k in range(4000)], "pk int, x double, y double")
    ends = [(k, x, y, x + k % 4, y) for k in range(400) for x, y in [(rnd.randint(0, 60), rnd.randint(0, 60))]]
    segments = spark.createDataFrame([(k, *map(float, e)) for k, *e in ends], "site_id long, ax double, ay double, bx double, by double")
    sites = segments.select("site_id", F.col("ax").alias("sx"), F.col("ay").alias("sy"), F.lit("a").alias("kind"))
    if kind == "sites":
        found = nearest.nearest_sites(points, sites, 3)
        want = {(p, s) for p, (x, y) in enumerate(at) for _, s in sorted((math.sqrt((x - a) ** 2 + (y - b) ** 2), k) for k, a, b, *_ in ends)[:3]}
    elif kind == "segments":
        found = S.nearest_segment(points, segments, 15.0, seg="site_id")
        far = lambda x, y, a, b, c: math.sqrt((x - min(max(x, a), c)) ** 2 + (y - b) ** 2)
        near = [(p, *min((far(x, y, *e[:3]), k) for k, *e in ends)) for p, (x, y) in enumerate(at)]
        want = {(p, s) for p, d, s in near if d <= 15.0}
    else:
        found = S.nearby_places(points, sites.unionByName(sites.withColumn("kind", F.lit("b"))), {"a": 20.0, "b": 5.0, "c": 9.0}).where("kind = 'b'")
        near = [(p, *min((math.sqrt((x - a) ** 2 + (y - b) ** 2), k) for k, a, b, *_ in ends)) for p, (x, y) in enumerate(at)]
        want = {(p, s) for p, d, s in near if d <= 5.0}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 16 and "Window" not in plan
    got = {(r.pk, r.site_id) for r in found.collect()}
    assert got == want | {(p + 2000, s) for p, s in want}


def test_ceilings_make_no_row_of_a_pair(spark):
    """400 places and 300 segments of which some end just at the reach of some places, some are points, some copies."""
    rnd = random.Random(9)
    at = [(float(rnd.randint(-300, 300)), float(rnd.randint(-300, 300))) for _ in range(398)] + [(300.0, 400.0), (4000.0, 0.0)]
    ends = [(0.0, 0.0, -70.0, 0.0, 2.0), (5.0, 5.0, 5.0, 5.0, 7.0), (20.0, 0.0, 0.0, 0.0, None)]
    ends += [(float(a), float(b), float(a + rnd.randint(-9, 9)), b + 7.0, rnd.uniform(1, 9)) for a, b in ((rnd.randint(-500, 500), rnd.randint(-500, 500)) for _ in range(297))]
    points = spark.createDataFrame([(k, *p) for k, p in enumerate(at)] + [(900, None, 1.0)], "pk int, x double, y double")
    segments = spark.createDataFrame(ends * 2, "ax double, ay double, bx double, by double, power double")
    want = {}
    for k, (x, y) in enumerate(at):
        total = 0.0
        for ax, ay, bx, by, power in ends:
            long = math.hypot(bx - ax, by - ay)
            if long and power:
                dot = (x - ax) * (bx - ax) + (y - ay) * (by - ay)
                part = min(1.0, max(0.0, dot / ((bx - ax) * (bx - ax) + (by - ay) * (by - ay))))
                if math.sqrt((x - ax - part * (bx - ax)) ** 2 + (y - ay - part * (by - ay)) ** 2) <= 500.0:
                    h = max(1.0, abs((x - ax) * (by - ay) - (y - ay) * (bx - ax)) / long)
                    total += 2 * power * (math.atan((long - dot / long) / h) + math.atan(dot / long / h)) / h
        if total:
            want[k] = 10 * math.log10(total / (2 * math.pi))
    for together in (8192, 16):
        found = compare.ceiling_level(points, segments, 500.0, together=together)
        got = dict(found.collect())
        assert set(got) == set(want) and got == pytest.approx(want, abs=1e-9) and met_rows(found) <= 400
    only = compare.ceiling_level(points.where("pk = 398"), segments.limit(1), 500.0).collect()
    assert len(only) == 1


def test_a_ceiling_report_computes_its_levels_once(spark):
    rows = spark.range(100).select(F.col("id").cast("double").alias("level"), F.lit(90.0).alias("ceiling")).withColumn("level", F.col("level") + F.rand() * 0)
    report = compare.ceiling_report(rows)
    assert "rand" not in report._jdf.queryExecution().optimizedPlan().toString() and report.first().n == 100


def test_a_facade_point_stops_at_the_first_wall(spark):
    """20 and 60 footprints beside each other, three copies of each: a point on the inner sides is near many walls."""
    rings = [square(-0.001 * k, 0.0) for k in range(20)] + [square(12.5 + 0.001 * k, 0.0) for k in range(60)]
    buildings = spark.createDataFrame([(1000 * i + k, r) for i in range(3) for k, r in enumerate(rings)], "bld_id long, " + RING)
    found = tiles.facade_receivers(buildings)
    got = found.collect()
    assert len(got) == 3 * 80 * 3 and len({r.receiver_key for r in got}) == len(got) and not [r for r in got if 5.0 < r.x < 7.5]
    assert {r.receiver_key.split(":")[1] for r in got} == {str(1000 * i + k) for i in range(3) for k in range(80)} and met_rows(found) <= 720


def test_deck_heights_make_no_row_of_a_pair(spark):
    """40 decks of two segments over 600 places, across a border of cells: each station has the median of its places."""
    rnd = random.Random(4)
    at = [(rnd.uniform(230, 270), rnd.uniform(-6, 6), rnd.choice([5.0, 6.0, 6.5])) for _ in range(600)]
    decks = [(d, s, *e) for d in range(40) for s, e in enumerate([(232.0, d / 99, 250.0, d / 99), (250.0, d / 99, 267.0, 2.0)])]
    points = spark.createDataFrame([(*p, 17) for p in at] + [(240.0, 0.0, 99.0, 2)], "x double, y double, z double, cls int")
    found = lidar.deck_profile(points, spark.createDataFrame(decks, "edge_id long, seq int, ax double, ay double, bx double, by double"))
    got = {(r.edge_id, r.station): r.z for r in found.collect()}
    assert met_rows(found) <= 600 and len({d for d, _ in got}) == 40
    for d in range(0, 40, 13):
        heights = {}
        for x, y, z in at:
            before = 0.0
            for _, _, ax, ay, bx, by in [e for e in decks if e[0] == d]:
                long = math.hypot(bx - ax, by - ay)
                part = min(1.0, max(0.0, ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / long**2))
                if math.hypot(x - ax - part * (bx - ax), y - ay - part * (by - ay)) <= 4.0:
                    heights.setdefault(math.floor((before + part * long) / 5.0 + 0.5) * 5.0, []).append(z)
                before += long
        for k in heights:
            mid = sorted(heights[k])
            if (d, k) in got and len(mid) >= 3:
                assert got[d, k] == pytest.approx((mid[(len(mid) - 1) // 2] + mid[len(mid) // 2]) / 2)


def test_cells_without_places_or_without_anything_near(spark):
    """Items far from all points, points far from all items, and no items at all."""
    points = spark.createDataFrame([(k, 100.0 * k, 0.0) for k in range(60)], "pk int, x double, y double")
    sites = spark.createDataFrame([(k, 100.0 * k + 3.0, 4.0) for k in range(50, 300)], "site_id int, sx double, sy double")
    assert {(r.pk, r.site_id, r.distance) for r in S.knn(points, sites, 2, 5.0).collect()} == {(k, k, 5.0) for k in range(50, 60)}
    assert S.knn(points, sites.where("site_id < 0"), 2, 5.0).count() == 0 and S.knn(points.where("pk < 0"), sites, 2, 5.0).count() == 0
    far = points.select("x", "y", F.lit(1.0).alias("z"), F.lit(17).alias("cls"))
    deck = spark.createDataFrame([(1, 0, 9e4, 9e4, 9e4, 90010.0)], "edge_id int, seq int, ax double, ay double, bx double, by double")
    assert [r.z for r in lidar.deck_profile(far, deck).collect()] == [None] * 3
