"""Operators on small hand-made inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from noisegrid.operators import compare, events, field, heights, lidar, nearest, roads, rules, tiles, traces
from noisegrid.operators.quantiles import percentiles
from noisegrid.operators import spatial as S

SEG = "edge_id int, seq int, ax double, ay double, bx double, by double"


def test_nearest_without_limit_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    pts = [(i, *map(float, rng.uniform(0, 5000, 2))) for i in range(60)]
    segs = [(i, *map(float, rng.uniform(0, 900, 4))) for i in range(5)]
    found = nearest.nearest_segment_any(spark.createDataFrame(pts, "pk int, x double, y double"), spark.createDataFrame(segs, "seg_id int, ax double, ay double, bx double, by double")).collect()

    def far(p, s):
        a, b, q = np.array(s[1:3]), np.array(s[3:5]), np.array(p[1:])
        t = np.clip((q - a) @ (b - a) / ((b - a) @ (b - a)), 0, 1)
        return float(np.hypot(*(q - a - t * (b - a))))

    assert {r.pk: r.distance for r in found} == pytest.approx({p[0]: min(far(p, s) for s in segs) for p in pts})


def test_lines(spark):
    line = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 0.0), (1, 1, 10.0, 0.0, 10.0, 20.0)], SEG)
    assert [r.station for r in S.densify(line, 5.0).orderBy("station").collect()] == [0, 5, 10, 15, 20, 25, 30]
    cut = S.substring_line(line, spark.createDataFrame([(1, 5.0, 15.0)], "edge_id int, start_m double, end_m double")).orderBy("seq").collect()
    assert [(r.ax, r.ay, r.bx, r.by) for r in cut] == [(5, 0, 10, 0), (10, 0, 10, 5)]
    assert {r.piece for r in S.cut_line(line, 15.0).collect()} == {0, 1}


def test_conflation_prefers_the_aligned_line(spark):
    edge = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 0.0, False)], SEG + ", freeway boolean")
    recs = spark.createDataFrame([(10, 0, 0.0, 5.0, 100.0, 5.0, False, 100.0), (11, 0, 50.0, -50.0, 50.0, 50.0, False, 900.0), (12, 0, 0.0, 4.0, 100.0, 4.0, True, 900.0), (13, 0, 0.0, 6.0, 100.0, 6.0, False, 500.0)], "other_id int, seq int, ax double, ay double, bx double, by double, freeway boolean, aadt double")
    assert roads.assign_traffic(edge, recs).collect() == [(1, 13, 1.0)]


def test_conflation_of_lines_on_one_line_prefers_the_record_that_is_not_longer(spark):
    """A short edge lies wholly on the record of a longer one, too, and that has the lesser id."""
    edges = spark.createDataFrame([(1, 0, 0.0, 0.0, 250.0, 150.0, False), (2, 0, 0.0, 0.0, 50.0, 30.0, False)], SEG + ", freeway boolean")
    recs = spark.createDataFrame([(11, 0, 0.25, 0.25, 250.25, 150.25, False, 0.0), (12, 0, 0.25, 0.25, 50.25, 30.25, False, 0.0)], "other_id int, seq int, ax double, ay double, bx double, by double, freeway boolean, aadt double")
    assert sorted(roads.assign_traffic(edges, recs, 1.0).collect()) == [(1, 11, 1.0), (2, 12, 1.0)]


def test_bridges_and_crossings(spark):
    edge = spark.createDataFrame([(1, 0, 0.0, 0.0, 20.0, 0.0)], SEG)
    deck = spark.createDataFrame([(5, 0, 0.0, 1.0, 0.0, 20.0, 1.0, 10.0)], "deck_id int, seq int, ax double, ay double, az double, bx double, by double, bz double")
    assert [(r.station, r.deck_z) for r in roads.apply_bridges(edge, deck).orderBy("station").collect()] == [(0, 0), (5, 2.5), (10, 5), (15, 7.5), (20, 10)]
    track = spark.createDataFrame([(1, 0, 0.0, 0.0, 1000.0, 0.0)], SEG)
    x = spark.createDataFrame([(7, 500.0, 10.0, 36.0, 2.0, 1.0, 0.0), (8, 500.0, 90.0, 36.0, 2.0, 1.0, 0.0)], "crossing_id int, x double, y double, speed_kmh double, d double, e double, n double")
    r = roads.horn_sources(track, x).collect()
    assert len(r) == 1 and (r[0].start_m, r[0].end_m) == (325, 675) and r[0].bands_n[0] == -99
    twin = spark.createDataFrame([(1, 0, 0.0, 0.0, 200.0, 0.0), (2, 0, 0.0, 5.0, 200.0, 5.0), (3, 0, 0.0, 50.0, 200.0, 50.0)], SEG)
    assert {r.edge_id: r.tracks for r in roads.parallel_tracks(twin).collect()} == {1: 2, 2: 2, 3: 1}


def test_service_calendar(spark):
    import datetime as dt

    dates = spark.createDataFrame([(dt.date(2026, 1, 5) + dt.timedelta(i),) for i in range(7)], "date date")
    cal = spark.createDataFrame([("W", [0, 1, 2, 3, 4], dt.date(2026, 1, 1), dt.date(2026, 1, 31))], "service_id string, dow array<int>, start_date date, end_date date")
    exc = spark.createDataFrame([("W", dt.date(2026, 1, 6), 2), ("W", dt.date(2026, 1, 10), 1)], "service_id string, date date, exception_type int")
    trips = spark.createDataFrame([("t", "r", "W")], "trip_id string, route_id string, service_id string")
    assert {r.date.day for r in roads.active_trips(trips, cal, exc, dates).collect()} == {5, 7, 8, 9, 10}


TRACE = "ident string, epoch double, x double, y double, stale boolean, new_leg boolean"


def test_paths_split_on_leaving_and_refuse_equal_times(spark):
    pts = [("a", 0.0, 5.0, 5.0), ("a", 10.0, 15.0, 5.0), ("a", 20.0, 25.0, 5.0), ("a", 30.0, 15.0, 5.0), ("a", 40.0, 5.0, 5.0), ("b", 0.0, 1.0, 1.0), ("b", 0.0, 2.0, 2.0), ("b", 5.0, 3.0, 3.0)]
    frame = spark.createDataFrame([(*p, False, False) for p in pts], TRACE)
    pairs = traces.trace_pairs(frame)
    assert {r.ident for r in pairs.collect()} == {"a"}
    cut = traces.clip_pairs(traces.admissible_pairs(pairs), (0.0, 0.0, 20.0, 10.0))
    paths = traces.path_points(traces.assemble_paths(cut)).orderBy("start").collect()
    assert [[p.epoch for p in r.points] for r in paths] == [[0, 10, 15], [25, 30, 40]] and "ident" not in paths[0].asDict()
    again = traces.reclip_paths(frame.where("ident = 'a'"), (0.0, 0.0, 20.0, 10.0), "ident")
    assert again.select("path_no").distinct().count() == 2


def test_touch_and_go(spark):
    rows = [(1, 0, 0.0, "numeric", 500.0, 0.0), (1, 1, 100.0, "numeric", 100.0, 0.0), (1, 2, 150.0, "ground", None, 0.0), (1, 3, 160.0, "ground", None, 0.001), (1, 4, 200.0, "numeric", 300.0, 0.0)]
    pts = spark.createDataFrame([(*r, 0.0) for r in rows], "ident int, idx int, epoch double, alt_state string, height_ft double, x double, y double")
    found = traces.event_windows(pts, traces.ground_episodes(pts)).orderBy("operation").collect()
    assert [(r.operation, r.start_ts, r.end_ts) for r in found] == [("arrival", 100, 150), ("departure", 160, 200)]


def test_series(spark):
    s = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.0, 1.0, 9.0, 3.0, 4.0, None, None, 7.0])], "k int, o int, v double")
    fixed = traces.running_median(s.where("v is not null"), "k", "o", "v").orderBy("o").collect()
    assert [r.v for r in fixed][2] == 3.0
    assert [r.v for r in traces.interpolate_gaps(s, "k", "o", "v").orderBy("o").collect()][5:] == [5.0, 6.0, 7.0]
    ring = spark.createDataFrame([(1, i, float(i == 0) * 3) for i in range(6)], "k int, o int, v double")
    assert [r.v for r in traces.circular_mean(ring, "k", "o", "v", 6, 1).orderBy("o").collect()] == [1, 1, 0, 0, 0, 1]


def test_event_levels(spark):
    ev = spark.createDataFrame([("s", "2026-03-08 12:00:00", 90.0), ("s", "2026-03-08 19:30:00", 90.0), ("s", "2026-03-08 22:00:00", 90.0)], "site string, t string, sel double").withColumn("ts", F.to_timestamp("t"))
    assert events.daily_cnel(ev, "UTC", ["site"]).first().cnel == pytest.approx(90 + 10 * math.log10(14 / 86400))
    one = spark.createDataFrame([("s", 60.0)], "site string, sel double").withColumn("ts", F.to_timestamp(F.lit("2026-03-08 12:00:00")))
    day = events.laeq_from_sel(one, "2026-03-08 08:00:00", "2026-03-09 07:00:00", ["site"]).first()  # 23 h in Los Angeles
    assert day.laeq == pytest.approx(60 - 10 * math.log10(82800))


def test_moving_source_equals_the_closed_form(spark):
    track = spark.createDataFrame([(1, 0, 0.0, -100.0, 0.0, 10.0, 100.0, 0.0)], "track_id int, seq int, t1 double, x1 double, y1 double, t2 double, x2 double, y2 double")
    site = spark.createDataFrame([(1, 0.0, 10.0)], "site_id int, ox double, oy double")
    got = events.moving_source_sel(track, site, [(1000.0, 80.0)], reference_m=10.0).first().sel
    assert got == pytest.approx(80 + 10 * math.log10(2 * 10 / 20 * math.atan(10)), abs=0.01)


TRACK = "track_id int, seq int, t1 double, x1 double, y1 double, z1 double, heading1 double, t2 double, x2 double, y2 double, z2 double, heading2 double"


def test_moving_source_losses_and_directivity(spark):
    still = spark.createDataFrame([(1, 0, 0.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 1.0, 0.0)], TRACK)
    site = lambda *rows: spark.createDataFrame(rows, "site_id int, ox double, oy double, oz double")
    level = lambda d: {r.site_id: (r.bands[0] if r.bands else None, r.status) for r in d.collect()}
    near = level(events.moving_source_sel(still, site((1, 0.0, 10.0, 1.0), (2, 0.0, 20.0, 1.0), (3, 0.0, 0.0, 1.0)), [(1000.0, 80.0)], 10.0))
    assert near[1] == (pytest.approx(80.0), "ok") and near[1][0] - near[2][0] == pytest.approx(6.0206, abs=1e-3) and near[3] == (None, "on_track")
    lost = level(events.moving_source_sel(still, site((1, 0.0, 20.0, 1.0)), [(1000.0, 80.0)], 10.0, air_db_km=[1000.0], loss_db=[5.0]))
    assert lost[1][0] == pytest.approx(80 - 6.0206 - 10 - 5, abs=1e-3)
    turned = level(events.moving_source_sel(still, site((1, -10.0, 0.0, 1.0), (2, 10.0, 0.0, 1.0)), [(1000.0, 80.0)], 10.0, knots=[(0, 0), (180, -20)]))
    assert turned[1][0] == pytest.approx(60.0) and turned[2][0] == pytest.approx(80.0)
    by = spark.createDataFrame([(1, 0, 0.0, -10.0, 0.0, 1.0, 0.0, 1.0, 10.0, 0.0, 1.0, 0.0)], TRACK)
    assert level(events.moving_source_sel(by, site((1, 0.0, 10.0, 1.0)), [(1000.0, 80.0)], 10.0, knots=[(0, 0), (90, -20)]))[1] == (None, "unmeasured_angle")
    fast = spark.createDataFrame([(1, 0, 0.0, -2500.0, 0.0, 1.0, 0.0, 10.0, 2500.0, 0.0, 1.0, 0.0)], TRACK)
    got = level(events.moving_source_sel(fast, site((1, -315.0, 0.2, 1.0)), [(1000.0, 80.0)], 10.0))[1][0]
    assert got == pytest.approx(80 + 10 * math.log10(100 / 0.2 / 500 * (math.atan(2815 / 0.2) + math.atan(2185 / 0.2))), abs=1e-3)


def test_event_behind_the_start_of_roll(spark):
    npd = [(100.0, d, lv - x) for d, lv in ((60.0, 95.0), (600.0, 80.0)) for x in (0.0,)] + [(200.0, d, lv + 5) for d, lv in ((60.0, 95.0), (600.0, 80.0))]
    table = lambda less: spark.createDataFrame([("X", p, d, lv - less) for p, d, lv in npd], "npd_id string, power double, distance_m double, level_db double")
    roll = spark.createDataFrame([("e", 1, 0.0, 0.0, 1.0, 150.0, 500.0, 0.0, 80.0, 150.0, "D", "X")], "profile_id string, seq int, s1 double, z1 double, v1 double, p1 double, s2 double, z2 double, v2 double, p2 double, operation string, npd_id string")
    sites = spark.createDataFrame([(1, -200.0, 300.0, 0.0), (2, 250.0, 300.0, 0.0), (3, 90_000.0, 0.0, 0.0)], "site_id int, ox double, oy double, oz double")
    got = {e: {r.site_id: r.sel for r in events.event_sel(roll, sites, table(0.0), table(8.0), engine=e).collect()} for e in ("jet", "piston")}
    far, psi = math.hypot(200, 300) / 0.3048, math.degrees(math.acos(-200 / math.hypot(200, 300)))
    log = math.log(math.pi * psi / 180)
    behind = (2329.44 - 8.0573 * psi + 11.51 * math.exp(math.pi * psi / 180) - 3.4601 * psi / log - 17403338.3 * log / psi**2) * min(1, 2500 / far)
    assert set(got["jet"]) == {1, 2} and got["jet"][2] == pytest.approx(got["piston"][2])
    assert got["jet"][1] - got["piston"][1] == pytest.approx(behind, abs=1e-6)
    slant = lateral = math.hypot(200, 300)
    beta = math.degrees(math.atan2(1, lateral))
    sel = 97.5 - 15 * (math.log10(slant / 60))
    ahead = 500 / 0.3048 / (2 / math.pi * 270.05 * 10**0.8)
    finite = 10 * math.log10((ahead / (1 + ahead**2) + math.atan(ahead)) / math.pi)
    terms = 10 * math.log10(416.86 / 409.81) + 10 * math.log10(160 * 1852 / 3600 / 40.5) + finite
    assert got["piston"][1] == pytest.approx(sel + terms + 10 * math.log10(0.00384**0.0621) - 1.089 * (1 - math.exp(-0.00274 * lateral)) * (1.137 - 0.0229 * beta + 9.72 * math.exp(-0.142 * beta)), abs=0.02)


def test_percentiles_equal_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(int(k), float(round(v, 1 + k))) for k, v in zip(rng.integers(0, 3, 3000), rng.normal(0, 5, 3000), strict=True)] + [(7, 1.5), (8, None)]
    points = [0.0, 0.013, 0.5, 0.9, 1.0]
    frame = spark.createDataFrame(rows, "k int, v double")
    got = {r.k: r["values"] for r in percentiles(frame, "v", points, ["k"]).collect()}
    assert set(got) == {0, 1, 2, 7}
    for k, values in got.items():
        assert values == pytest.approx([float(x) for x in np.quantile([v for a, v in rows if a == k], points)])
    assert percentiles(frame, "v", [0.5]).first()["values"][0] == pytest.approx(float(np.median([v for _, v in rows if v is not None])))


def test_decks_under_others(spark):
    deck = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 0.0)], SEG)
    over = spark.createDataFrame([(9, 50.0, -50.0, 50.0, 50.0)], "other_id int, ax double, ay double, bx double, by double")
    on = spark.createDataFrame([(float(x), 0.5 * k, 30.0 if 35 <= x <= 65 else 10.0, 17) for x in range(0, 81, 5) for k in (-1, 0, 1)], "x double, y double, z double, cls int")
    z = {r.station: r.z for r in lidar.deck_profile(on, deck, over).collect()}
    assert z[50.0] == pytest.approx(10.0 if z[35.0] == 10.0 else z[50.0]) and z[100.0] == z[80.0] == 10.0
    assert [r.station for r in lidar.deck_crossings(deck, over).collect()] == [pytest.approx(50.0, abs=1.0)]


def test_walls_need_an_open_road_side(spark):
    wall = [(0.25 + 0.5 * i, 10.25, 5.0, 1, 1) for i in range(60)]
    shelf = [(0.25 + 0.5 * i, 30.25 - 0.5 * j, 5.0 if j == 0 else 2.5, 1, 1) for i in range(60) for j in range(5)]
    ground = [(0.25 + 0.5 * i, 0.25 + 0.5 * j, 1.0, 2, 1) for i in range(60) for j in range(70)]
    pts = spark.createDataFrame([(0, *p) for p in wall + shelf + ground], "block long, x double, y double, z double, cls int, ret int")
    grid = lidar.rasterize_points(pts)
    road = spark.createDataFrame([(-100.0, 0.0, 100.0, 0.0)], "ax double, ay double, bx double, by double")
    none = grid.where("false").select("block", "row", "col")
    found = lidar.wall_candidates(grid, grid.select("block", "row", "col"), none, road, most_thick=0.9)
    assert {r.row for r in found.select("row").distinct().collect()} == {20} and found.first().angle == 0.0
    across = spark.createDataFrame([(0.0, -100.0, 0.0, 100.0)], "ax double, ay double, bx double, by double")
    assert lidar.wall_lines(found).count() > 0 and lidar.wall_lines(lidar.wall_candidates(grid, grid.select("block", "row", "col"), none, across)).count() == 0


def test_profile(spark):
    p = spark.createDataFrame([("P", 1, 0.0, 0.0, 50.0, 100.0), ("P", 2, 1000.0, 100.0, 90.0, 100.0), ("P", 3, 1000.0, 100.0, 90.0, 100.0)], "profile_id string, seq int, dist double, alt double, speed double, power double")
    cut = events.segment_profile(p).orderBy("seq").collect()
    assert [r.dist for r in cut] == [0, pytest.approx(1000 * 0.5 * (100 + 20) / 140), 1000]
    placed = events.place_profile(events.segment_profile(p), 500.0, 0.0, 2000.0).orderBy("s").collect()
    assert [round(r.s) for r in placed] == [0, 500, 929, 1500, 2000]
    assert events.profile_segments(events.place_profile(events.segment_profile(p), 500.0, 0.0, 2000.0)).count() == 4


def test_rules(spark):
    ev = spark.createDataFrame([("a", "s", 0, 10.0, 60.0, "LAeq", "A"), ("b", "s", 5, 10.0, 60.0, "LAeq", "A"), ("c", "s", 50, 0.0, 60.0, "LAeq", "C"), ("c", "t", 90, 1.0, 60.0, "Lmax", "A")], "event_id string, site string, t int, duration_s double, laeq_db double, metric string, weighting string").withColumn("start_ts", F.timestamp_seconds("t"))
    assert sorted((r.event_id, r.rule) for r in rules.validate_events(ev).collect()) == [("b", "overlap"), ("c", "duration"), ("c", "metric"), ("c", "unique"), ("c", "weighting")]
    npd = spark.createDataFrame([("A", 1.0, 10.0, 5.0), ("A", 2.0, 10.0, 5.0), ("A", 1.0, 20.0, None)], "npd_id string, power double, distance_m double, level_db double")
    assert {r.rule for r in rules.validate_npd(npd).collect()} == {"rectangular", "finite"}
    good = ("roads", "Roads", "road", "a/b.json", "0" * 64, 10, "model", ["D"])
    layers = spark.createDataFrame([good, ("up", "Up", "road", "../x", "0" * 63, 0, "guess", [])], "id string, label string, family string, asset string, source_hash string, source_bytes long, evidence_class string, periods array<string>")
    assert sorted(r.rule for r in rules.validate_registry(layers, ["road"], ["model"]).collect()) == ["evidence", "hash", "path", "periods", "size"]
    with pytest.raises(rules.RuleError):
        rules.strict(rules.assert_count(ev, 3), "count")
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int")
    assert sorted((r.k, r.problem) for r in rules.inventory_diff(a, b, "k").collect()) == [(1, "missing"), (3, "unexpected")]
    z = spark.createDataFrame([(0, 0, 1.0), (0, 1, None)], "row int, col int, z double")
    assert rules.fill_terrain(z, spark.createDataFrame([(0, 1, 2.0)], "row int, col int, z double")).where("z is null").count() == 0
    with pytest.raises(rules.RuleError):
        rules.fill_terrain(z, z)


def test_tiles(spark):
    parts = spark.createDataFrame([("t1", "k", "D", 50.0, 60.0, 2, 0), ("t2", "k", "D", 55.0, 62.0, 1, 1)], "tile_id string, building_key string, period string, min double, max double, receiver_count int, unavailable_count int")
    r = tiles.merge_buildings(parts).first()
    assert (r.min, r.max, r.receiver_count, r.tile_ids) == (50, 62, 3, ["t1", "t2"])
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (20, 0), (20, 10), (0, 10), (0, 0))])
    house = spark.range(1).select(F.lit(1).alias("bld_id"), ring.alias("ring"))
    facade = tiles.facade_receivers(house).collect()
    assert len(facade) == 6 and all(not (0 <= r.x <= 20 and 0 <= r.y <= 10) for r in facade)
    lattice = tiles.lattice_receivers(spark.createDataFrame([(0, 0)], "cell_e int, cell_n int"))
    assert lattice.count() == 2500
    near = S.wall_ring(lattice.select(F.col("receiver_key").alias("pk"), "x", "y"), house, 15.0)
    assert near.where("x > 0 and x < 20 and y > 0 and y < 10").count() == 0 and near.count() > 0


def test_field(spark):
    cells = spark.range(900).select((F.col("id") % 30).cast("int").alias("row"), F.floor(F.col("id") / 30).cast("int").alias("col"), F.lit(50.0).alias("sum"), F.lit(1).alias("n"))
    assert {round(r.value, 9) for r in field.gaussian_surface(cells).collect()} == {50.0}
    rng = np.random.default_rng(3)
    x, y = rng.uniform(0, 100, 80), rng.uniform(0, 100, 80)
    tri = field.triangulate(x, y)
    for a, b, c in tri:
        d = 2 * (x[a] * (y[b] - y[c]) + x[b] * (y[c] - y[a]) + x[c] * (y[a] - y[b]))
        ux = ((x[a] ** 2 + y[a] ** 2) * (y[b] - y[c]) + (x[b] ** 2 + y[b] ** 2) * (y[c] - y[a]) + (x[c] ** 2 + y[c] ** 2) * (y[a] - y[b])) / d
        uy = ((x[a] ** 2 + y[a] ** 2) * (x[c] - x[b]) + (x[b] ** 2 + y[b] ** 2) * (x[a] - x[c]) + (x[c] ** 2 + y[c] ** 2) * (x[b] - x[a])) / d
        r = math.hypot(x[a] - ux, y[a] - uy)
        others = np.delete(np.hypot(x - ux, y - uy), [a, b, c])
        assert (others >= r - 1e-6).all()
    plane = spark.createDataFrame([(0, 0, float(a), float(b), float(40 + 0.1 * a + 0.2 * b)) for a, b in zip(x, y, strict=True)], "home_e int, home_n int, x double, y double, laeq double")
    mesh = field.mesh_surface(plane, 5.0, 60.0, 100.0).collect()
    assert len(mesh) > 200 and all(r.value == pytest.approx(40 + 0.1 * (r.col + 0.5) * 5 + 0.2 * (r.row + 0.5) * 5) for r in mesh)
    px = spark.createDataFrame([(1, 0, 0, 0, 0, 1.0), (1, 0, 0, 0, 1, 3.0), (1, 0, 0, 1, 0, None)], "z int, x int, y int, py int, px int, value double")
    assert field.halve(px).first().value == 2.0
    assert field.pad_edges(px.where("value is not null")).count() == 12
    assert field.pack_tiles(px, 4).first()["values"][:3] == [1.0, 3.0, None]
    grid = spark.createDataFrame([(i, j, None if (i, j) == (5, 5) else 50.0) for i in range(11) for j in range(11)], "row int, col int, value double")
    assert field.check_halos(spark.createDataFrame([(1, 5.5, 5.5), (2, 1.5, 1.5)], "pk int, x double, y double"), grid, 1.0).collect()[0].pk == 1


def test_lidar(spark):
    wall = [(0.25 + 0.5 * i, 10.25, 5.0, 1, 1) for i in range(60)]
    ground = [(0.25 + 0.5 * i, 0.25 + 0.5 * j, 1.0, 2, 1) for i in range(60) for j in range(40)]
    pts = spark.createDataFrame([(0, *p) for p in wall + ground], "block long, x double, y double, z double, cls int, ret int")
    grid = lidar.fill_gaps(lidar.rasterize_points(pts), 2)
    cand = lidar.wall_candidates(grid, grid.select("block", "row", "col"), grid.where("false").select("block", "row", "col"))
    lines = lidar.wall_lines(cand).collect()
    assert {round(r.y, 2) for r in lines} == {10.25} and {r.height for r in lines} == {4.0} and len(lines) == 15
    deck = spark.createDataFrame([(1, 0, 0.0, 0.0, 50.0, 0.0)], SEG)
    on = spark.createDataFrame([(x + 0.3 * k, 1.0, 10 + x / 10, 17) for x in (0.0, 5.0, 10.0, 40.0, 45.0, 50.0) for k in (-1, 0, 1)], "x double, y double, z double, cls int")
    z = [r.z for r in lidar.deck_profile(on, deck).orderBy("station").collect()]
    assert len(z) == 11 and z[5] == pytest.approx(12.5, abs=0.1)
    assert lidar.thin_voxels(pts.select("x", "y", "z"), 30.0).collect() == [(29.75, 10.25, 5.0)]
    blocks = lidar.blocked(spark.createDataFrame([(490.0, 250.0), (100.0, 100.0)], "x double, y double")).collect()
    assert sum(r.core for r in blocks) == 2 and len(blocks) == 3


def test_contours(spark):
    ring = lambda r: F.transform(F.sequence(F.lit(0), F.lit(180)), lambda k: F.struct((r * F.cos(k * F.pi() / 90)).alias("x"), (r * F.sin(k * F.pi() / 90)).alias("y")))
    c = spark.range(1).select(F.explode(F.array(F.struct(F.lit("a").alias("contour_id"), F.lit(65.0).alias("level"), ring(1000.0).alias("ring")), F.struct(F.lit("b").alias("contour_id"), F.lit(70.0).alias("level"), ring(700.0).alias("ring")))).alias("c")).select("c.*", F.lit("x").alias("airport"), F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"))
    rings = lidar.extend_contours(lidar.ring_radii(c), c.select("contour_id", "airport", "level"))
    mean = {r.level: r.m for r in rings.groupBy("level").agg(F.avg("radius").alias("m"), F.count("*").alias("n")).collect()}
    ratio = math.sqrt(1 / 0.49)
    assert mean[60.0] == pytest.approx(1000 * ratio, rel=0.01) and mean[55.0] == pytest.approx(1000 * ratio**2, rel=0.01)
    pts = spark.createDataFrame([(1, 850.0, 0.0), (2, 0.0, 350.0), (3, 9000.0, 0.0)], "pk int, x double, y double")
    got = {r.pk: r.level for r in lidar.contour_level(pts, lidar.contour_rings(rings, c.select("airport", "cx", "cy").distinct())).collect()}
    assert got == {1: pytest.approx(67.5, abs=0.1), 2: pytest.approx(72.5, abs=0.1)}


def test_heights_beat_the_median(spark):
    rng = np.random.default_rng(1)
    sides = rng.uniform(5, 30, 400)
    rows = [(i, *map(float, rng.uniform(0, 6000, 2)), float(s)) for i, s in enumerate(sides)]
    c = F.col
    p = lambda a, b: F.struct((c("cx") + a * c("s")).alias("x"), (c("cy") + b * c("s")).alias("y"))
    b = spark.createDataFrame(rows, "bld_id int, cx double, cy double, s double").select("bld_id", "cx", "cy", (3 + c("s") / 3).alias("height_m"), F.array(p(0, 0), p(1, 0), p(1, 1), p(0, 1), p(0, 0)).alias("ring"))
    split = heights.block_split(heights.height_features(b))
    _, _, mae, base = heights.train_heights(split, ["area", "perimeter"], 5, 3)
    assert mae < 0.5 * base


def test_compare(spark):
    sites = spark.createDataFrame([("m", 0.0, 0.0, 0.0)], "site_id string, x double, y double, uncertainty_m double")
    res = spark.createDataFrame([(1, 1.0, 0.0, 50.0), (2, 2.0, 0.0, 60.0), (3, 3.0, 0.0, 70.0), (4, 4.0, 0.0, 90.0)], "pk int, x double, y double, level double")
    assert compare.match_monitors(sites, res, 10.0).first().model == pytest.approx(60)
    ev = spark.createDataFrame([("r", "s", "stage_submitted", 1), ("r", "s", "stage_completed", 4)], "run_id string, stage string, event string, t int").withColumn("ts", F.timestamp_seconds("t"))
    assert compare.stage_seconds(ev).first().seconds == 3
    assert {(r.name, r.value, r.n) for r in compare.quality_counts(ev, ["run_id", "event"]).collect()} == {("run_id", "r", 2), ("event", "stage_submitted", 1), ("event", "stage_completed", 1)}
