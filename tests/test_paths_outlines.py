"""Path candidates by ordered events and coverage polygons, against quadratic and walking brute force."""

import math
import random


from noisegrid.plans import registry
from noisegrid.operators import outlines, traces

POINTS = "path_id string, epoch double, x double, y double, track_deg double, speed_kt double, alt_state string, height_ft double"
RUNWAY = "runway_end string, rx double, ry double, heading double"
NORTH = [("16X", 0.0, 0.0, 0.0)]


def brute(points, runway):
    """What a path may be at a runway, by trying all pairs of its points."""
    _, rx, ry, heading = runway
    h = math.radians(heading)
    pts = []
    for _, t, x, y, track, speed, state, ft in sorted(points, key=lambda p: p[1]):
        along, across = (x - rx) * math.sin(h) + (y - ry) * math.cos(h), (x - rx) * math.cos(h) - (y - ry) * math.sin(h)
        aligned = track is not None and abs((track - heading + 180) % 360 - 180) <= 18
        pts.append((along, abs(across) <= 350, aligned, speed is not None and speed >= 45, state == "ground", ft))
    arrival = departure = False
    for i, (s, near, aligned, fast, ground, _) in enumerate(pts):
        for j in range(i + 1, len(pts)):
            s2, near2, aligned2, fast2, ground2, _ = pts[j]
            if near and aligned and fast and s <= -1000 and near2 and ground2 and -250 <= s2 <= 900:
                arrival = True
            if near and ground and -1200 <= s <= 500 and near2 and aligned2 and fast2 and s + 400 <= s2 <= 12000:
                known = [p[5] for p in pts[i : j + 1] if p[5] is not None]
                departure |= len(known) >= 2 and known[-1] - known[0] >= 150
    return any(p[1] for p in pts), arrival, departure


def at(path, t, north, state="numeric", ft=1000.0, speed=100.0, track=0.0, east=0.0):
    return (path, float(t), float(east), float(north), track, speed, state, ft)


def test_approach_then_touchdown_and_ground_then_climb(spark):
    rows = [at("arrival", 0, -3330), at("arrival", 1, -1660), at("arrival", 2, 20, "ground", None, 40.0)]
    rows += [at("departure", 0, 10, "ground", 1000.0, 5.0), at("departure", 1, 670, ft=1060.0, speed=55.0), at("departure", 2, 1330, ft=1200.0, speed=90.0)]
    rows += [at("parked", 0, 10, "ground", None, 4.0, None)]
    rows += [at("unknown", 0, 10, "ground", 1000.0, 5.0), at("unknown", 1, 670, ft=None, speed=55.0)]
    rows += [at("backwards", 0, 20, "ground", None, 40.0), at("backwards", 1, -1660), at("backwards", 2, -3330)]
    rows += [at("overflight", k, -3000 + 500 * k, ft=3000.0 - 100 * k) for k in range(12)]
    rows += [at("far", 0, -2000, east=400.0)]
    got = {r.path_id: r for r in traces.classify_paths(spark.createDataFrame(rows, POINTS), spark.createDataFrame(NORTH, RUNWAY)).collect()}
    assert {p: (r.arrival, r.departure) for p, r in got.items()} == {"arrival": (True, False), "departure": (False, True), "parked": (False, False), "unknown": (False, False), "backwards": (False, False), "overflight": (False, False)}
    assert got["arrival"].arrival_confidence == "high_candidate" and got["arrival"].arrival_reason is None and got["parked"].departure_confidence == "none"
    assert got["overflight"].arrival_reason == "aligned_approach_ends_before_touchdown" and got["overflight"].departure_reason == "aligned_outbound_without_ground_anchor"
    assert got["unknown"].departure_reason == "on_runway_without_aligned_fast_climb" and got["parked"].arrival_reason == "on_ground_without_aligned_approach"


def test_rounding_of_a_runway_frame_decides_nothing(spark):
    """The cosine of 90 degrees is 6e-17: a point abeam the threshold is not beyond it, and 400 m along are 400 m."""
    abeam = [at("abeam", 0, 200, track=90.0)]
    climb = [at("climb", 0, 200, "ground", 1000.0, 5.0, 90.0), at("climb", 1, 0, ft=1200.0, track=90.0, east=400.0)]
    got = {r.path_id: r for r in traces.classify_paths(spark.createDataFrame(abeam + climb, POINTS), spark.createDataFrame([("09", 0.0, 0.0, 90.0)], RUNWAY)).collect()}
    assert got["abeam"].departure_reason == traces.NO_DEPARTURE and got["climb"].departure


def test_candidates_equal_trying_all_pairs(spark):
    """Random paths along two parallel runways and one across; many rotate on the runway, where heights and places decide
    together."""
    rnd = random.Random(12)
    runways = [("16L", 0.0, 0.0, 0.0), ("16R", 200.0, 50.0, 0.0), ("09", 0.0, 0.0, 90.0)]
    rows = []
    for path in range(250):
        place = rnd.uniform(-1500, 300)
        for t in range(rnd.randrange(2, 16)):
            place += rnd.choice([-100, 50, 150, 300, 700])
            state = rnd.choice(["ground", "numeric"])
            ft = rnd.choice([None, None, 900.0 + rnd.randrange(0, 400, 25)])
            rows.append(at(f"p{path}", t, place, state, ft, rnd.choice([None, 30.0, 80.0]), rnd.choice([None, 0.0, 10.0, 90.0, 355.0]), rnd.uniform(-400, 600)))
    frame = spark.createDataFrame(rows, POINTS)
    tries = traces.classify_paths(frame, spark.createDataFrame(runways, RUNWAY))
    got = {(r.path_id, r.runway_end): (r.arrival, r.departure) for r in tries.collect()}
    want = {}
    for path in {r[0] for r in rows}:
        for runway in runways:
            near, *ops = brute([r for r in rows if r[0] == path], runway)
            if near:
                want[path, runway[0]] = tuple(ops)
    assert got == want and sum(d for _, d in want.values()) > 10 and sum(a for a, _ in want.values()) > 3
    ends = {(r.path_id, r.operation): (r.runway_ends, r.assignment) for r in traces.path_operations(tries).collect()}
    for (path, operation), (names, assignment) in ends.items():
        assert names == sorted(e for e in ("09", "16L", "16R") if want.get((path, e), (0, 0))[operation == "departure"])
        assert assignment == ("axis_only" if len(names) > 1 else "single_end")
    counts = traces.rejection_counts(frame, tries, spark.createDataFrame(runways, RUNWAY)).collect()
    assert sum(r.paths for r in counts) == 250 - len({p for p, _ in ends})
    assert traces.classify_paths(frame.limit(0), spark.createDataFrame(runways, RUNWAY)).count() == 0


def parts(cells):
    """Cells by what they reach over their sides."""
    left, out = set(cells), []
    while left:
        todo, part = [left.pop()], []
        while todo:
            e, n = todo.pop()
            part.append((e, n))
            for q in ((e + 1, n), (e - 1, n), (e, n + 1), (e, n - 1)):
                if q in left:
                    left.remove(q)
                    todo.append(q)
        out.append(part)
    return out


def rings_of(spark, cells):
    rings, sides = outlines.coverage_rings(spark.createDataFrame(cells, "cell_e int, cell_n int"), 10.0)
    by = {}
    for s in sides.collect():
        by.setdefault(s.ring, []).append(s)
    for line in by.values():
        line.sort(key=lambda s: s.seq)
        assert [s.seq for s in line] == list(range(len(line)))
        assert all((a.x2, a.y2) == (b.x1, b.y1) for a, b in zip(line, line[1:] + line[:1], strict=True))
        assert len({(s.x1, s.y1) for s in line}) == len(line)
    return rings.collect(), rings, sides


def test_rings_of_scattered_cells(spark):
    """Rings are closed, meet no corner twice, and have the areas of parts and of their holes; corners touch often."""
    rnd = random.Random(1)
    cells = [(e, n) for e in range(-6, 10) for n in range(-3, 10) if rnd.random() < 0.65]
    rows, rings, sides = rings_of(spark, [*cells, *cells[:5]])
    want = []
    for part in parts(cells):
        around = {(e, n) for e in range(-8, 13) for n in range(-5, 13)} - set(part)
        holes = [len(h) * 100.0 for h in parts(around) if (-8, -5) not in h]
        want.append((len(part) * 100.0, sorted(holes)))
    by = {}
    for r in rows:
        by.setdefault(r.polygon, []).append(r)
    assert sorted((sum(r.area for r in p), sorted(-r.area for r in p if not r.outer)) for p in by.values()) == sorted(want)
    assert all(sum(r.outer for r in p) == 1 for p in by.values()) and any(holes for _, holes in want)
    shapes = outlines.polygons(rings, sides).collect()
    assert sum(s.area for s in shapes) == 100.0 * len(cells)
    assert all(line[0] == line[-1] for s in shapes for line in s.coordinates)


def test_a_long_ring_isn_t_walked(spark):
    """A comb of 3,000 teeth is one ring of 12,002 sides, in some 14 joins."""
    cells = spark.range(6000).selectExpr("cast(id as int) AS cell_e", "0 AS cell_n").unionByName(spark.range(3000).selectExpr("cast(2 * id as int) AS cell_e", "1 AS cell_n"))
    rings, sides = outlines.coverage_rings(cells, 1.0)
    (ring,) = rings.collect()
    assert (ring.outer, ring.area, ring.sides) == (True, 9000.0, 12_002)
    assert sides.agg({"seq": "max"}).first()[0] == 12_001


def test_no_cells_give_no_rings(spark):
    rings, sides = outlines.coverage_rings(spark.createDataFrame([], "cell_e int, cell_n int"))
    assert rings.count() == sides.count() == 0


def test_cut_paths_may_keep_standing_edges(spark):
    rows = [(1, 0.0, 5.0, 5.0), (1, 10.0, 5.0, 5.0), (1, 20.0, 9.0, 5.0), (2, 0.0, -5.0, 5.0), (2, 10.0, -5.0, 5.0)]
    points = spark.createDataFrame(rows, "path_id int, epoch double, x double, y double")
    cut = lambda **how: sorted((r.path_id, r.epoch_lo, r.epoch_hi) for r in traces.reclip_paths(points, (0.0, -1e9, 1e9, 1e9), **how).collect())
    assert cut() == [(1, 10.0, 20.0)] and cut(standing=True) == [(1, 0.0, 10.0), (1, 10.0, 20.0)]


def test_points_on_a_wall_are_not_near_it(spark, tmp_path):
    """All whole metres around some footprints: a distance is 0 on a wall, though its sum may be 1e-16."""
    blds = [(k, s) for k, s in ((1, 1), (2, 9), (3, 14), (4, 33), (5, 20), (6, 47))]
    spark.createDataFrame(blds, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    rows = []
    for k, s in blds:
        cx, cy, w, h = k * 7907 % 4000, k * 6271 % 4000, 6 + s % 10, 5 + s % 7
        for x, y in {(cx + i, cy + j) for i in (-w, w) for j in range(-h, h + 1)} | {(cx + i, cy + j) for j in (-h, h) for i in range(-w, w + 1)} | {(cx + w + 3, cy)}:
            o = len(rows) + 1
            part = next(p for p in range(4000) if (p * 53 + o * 37 + 11 - x) % 4000 == 0)
            supp = next(p for p in range(4000) if (p * 101 + o * 59 + 7 - y) % 4000 == 0)
            rows.append((o, 1, part, supp))
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert [r.distance for r in registry.QUERIES["points_at_walls"](spark, str(tmp_path)).collect()] == [3.0] * len(blds)
