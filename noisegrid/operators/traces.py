"""Trajectories: pairs, clipping, paths, ground episodes, runway events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noisegrid.functions import geometry as G
from noisegrid.operators import spatial as S

GAP_S = 90.0


def trace_pairs(points: DataFrame, ident: str = "ident", epoch: str = "epoch") -> DataFrame:
    """Consecutive points of each trace as columns a (struct) and b (struct). Traces with two points of one time are
    left out whole. Points sort by time, whatever their order in the input."""
    bad = points.groupBy(ident, epoch).agg(F.count("*").alias("n")).where("n > 1").select(ident).distinct()
    rest = [c for c in points.columns if c != ident]
    rows = points.join(bad, ident, "left_anti").select(ident, F.struct(*rest).alias("a"))
    w = W.partitionBy(ident).orderBy(F.col(f"a.{epoch}"))
    return rows.withColumn("b", F.lead("a").over(w)).where("b is not null")


def admissible_pairs(pairs: DataFrame, gap_s: float = GAP_S) -> DataFrame:
    """Pairs of fresh points of one leg at most gap_s apart."""
    step = F.col("b.epoch") - F.col("a.epoch")
    return pairs.where(~F.col("a.stale") & ~F.col("b.stale") & ~F.col("b.new_leg") & (step > 0) & (step <= gap_s))


def clip_pairs(pairs: DataFrame, box: tuple[float, float, float, float], window: tuple[float, float] | None = None) -> DataFrame:
    """The parts of pairs inside a box (x1, y1, x2, y2) and a time window: start and end points x, y, epoch, alt_ft and
    headings. An altitude is interpolated only between numeric ones of one datum."""
    a, b = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    part = G.clip_segment(a("x"), a("y"), b("x"), b("y"), *[F.lit(float(v)) for v in box])
    rows = pairs.withColumn("_c", part).where("_c is not null")
    lo, hi = F.col("_c.lo"), F.col("_c.hi")
    if window is not None:
        t = G.clip_time(a("epoch"), b("epoch"), F.lit(window[0]), F.lit(window[1]))
        rows = rows.withColumn("_t", t).where("_t is not null")
        lo, hi = F.greatest(lo, F.col("_t.lo")), F.least(hi, F.col("_t.hi"))
    rows = rows.withColumns({"lo": lo, "hi": hi}).where("lo < hi")
    same = F.lit(True)
    names = pairs.schema["a"].dataType.names
    if "alt_datum" in names:
        same = a("alt_datum") == b("alt_datum")
    cols = []
    for end in ("lo", "hi"):
        p = F.col(end)
        cols += [G.lerp(a(n), b(n), p).alias(f"{n}_{end}") for n in ("x", "y", "epoch") if n in names]
        cols += [F.when(same, G.lerp(a("alt_ft"), b("alt_ft"), p)).alias(f"alt_ft_{end}")] if "alt_ft" in names else []
        cols += [G.interp_heading(a("track_deg"), b("track_deg"), p).alias(f"track_deg_{end}")] if "track_deg" in names else []
    keep = [c for c in pairs.columns if c not in ("a", "b")]
    return rows.select(*keep, *cols)


def assemble_paths(frags: DataFrame, ident: str = "ident", kind: str | None = None) -> DataFrame:
    """Fragments with a running path number per trace: a fragment goes on with the one before where its start is the
    other's end (and the kind agrees), else it begins a path."""
    w = W.partitionBy(ident).orderBy("epoch_lo", "epoch_hi")
    joined = F.lit(True)
    for n in ("x", "y", "epoch"):
        joined = joined & (F.col(f"{n}_lo") == F.lag(f"{n}_hi").over(w))
    if kind:
        joined = joined & (F.col(kind) == F.lag(kind).over(w))
    rows = frags.withColumn("_new", F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1))
    return rows.withColumn("path_no", F.sum("_new").over(w)).drop("_new")


def path_islands(points: DataFrame, gap_s: float, ident: str = "ident", epoch: str = "t_s") -> DataFrame:
    """Points with the number of their run: a gap over gap_s begins a new one."""
    w = W.partitionBy(ident).orderBy(epoch)
    new = F.when(F.col(epoch) - F.lag(epoch).over(w) <= gap_s, 0).otherwise(1)
    return points.withColumn("_new", new).withColumn("island", F.sum("_new").over(w)).drop("_new")


def path_points(frags: DataFrame, ident: str = "ident") -> DataFrame:
    """One row per path with its points in order, ids in order of start time; the identity is left out."""
    ends = F.array(*[F.struct(*[F.col(f"{n}_{e}").alias(n) for n in ("epoch", "x", "y")]) for e in ("lo", "hi")])
    paths = frags.groupBy(ident, "path_no").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(ends)))).alias("points"))
    start = F.col("points")[0]["epoch"]
    return paths.select(F.sha2(F.concat_ws("|", F.col(ident).cast("string"), F.col("path_no").cast("string")), 256).alias("path_id"), start.alias("start"), "points")


def reclip_paths(points: DataFrame, box: tuple[float, float, float, float], ident: str = "path_id", standing: bool = False) -> DataFrame:
    """Paths cut to a smaller box: leaving and coming back makes two, edges without length go unless `standing`."""
    frags = clip_pairs(trace_pairs(points, ident), box)
    moved = (F.col("x_lo") != F.col("x_hi")) | (F.col("y_lo") != F.col("y_hi"))
    return assemble_paths(frags if standing else frags.where(moved), ident)


def ground_episodes(points: DataFrame, ident: str = "ident", gap_s: float = 60.0, apart: float = 0.004) -> DataFrame:
    """(ident, episode, start, end, n) of runs of ground points: the numbers (idx) are consecutive, the time and place
    of neighbours close."""
    w = W.partitionBy(ident).orderBy("idx")
    rows = points.where("alt_state = 'ground'")
    goes_on = (F.col("idx") - F.lag("idx").over(w) == 1) & (F.col("epoch") - F.lag("epoch").over(w) <= gap_s) & (F.abs(F.col("x") - F.lag("x").over(w)) < apart) & (F.abs(F.col("y") - F.lag("y").over(w)) < apart)
    rows = rows.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("episode", F.sum("_new").over(w))
    return rows.groupBy(ident, "episode").agg(F.min("epoch").alias("start"), F.max("epoch").alias("end"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("n"))


def event_windows(points: DataFrame, episodes: DataFrame, ident: str = "ident", before_s: float = 300.0, after_s: float = 240.0, climb_ft: float = 150.0) -> DataFrame:
    """Arrivals and departures around ground episodes, with their airborne witness.

    An arrival has a point above its field elevation at most before_s before the episode, the latest counts; a
    departure one climb_ft above it at most after_s after, the first counts. Points carry height_ft above the field.
    Episodes and points of a trace meet in time buckets, so that a long trace is no product with its episodes.
    """
    size = max(before_s, after_s)
    air = points.where("alt_state = 'numeric'").select(ident, "epoch", "height_ft", F.floor(F.col("epoch") / size).alias("_b"))
    out = None
    for kind, anchor, reach in (("arrival", "start", before_s), ("departure", "end", after_s)):
        e = episodes.select(ident, "episode", "start", "end", F.explode(F.array(F.floor(F.col(anchor) / size), F.floor(F.col(anchor) / size) + (-1 if kind == "arrival" else 1))).alias("_b"))
        gap = (F.col(anchor) - F.col("epoch")) if kind == "arrival" else (F.col("epoch") - F.col(anchor))
        met = e.join(air, [ident, "_b"]).withColumn("_gap", gap).where((F.col("_gap") > 0) & (F.col("_gap") <= reach) & (F.col("height_ft") >= (0.0 if kind == "arrival" else climb_ft)))
        best = met.groupBy(ident, "episode").agg(F.min(F.struct("_gap", "epoch", "height_ft")).alias("w"), F.first("start").alias("start"), F.first("end").alias("end"))
        rows = best.select(ident, "episode", F.lit(kind).alias("operation"), F.when(F.lit(kind) == "arrival", F.col("w.epoch")).otherwise(F.col("end")).alias("start_ts"), F.when(F.lit(kind) == "arrival", F.col("start")).otherwise(F.col("w.epoch")).alias("end_ts"), F.col("w.epoch").alias("witness_ts"), F.col("w.height_ft").alias("witness_ft"))
        out = rows if out is None else out.unionByName(rows)
    return out


def dedupe_events(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events of one exact witness as one: both runway ends and the number of fragments are kept."""
    return events.groupBy(*keys).agg(F.sort_array(F.collect_set("runway_end")).alias("runway_ends"), F.count("*").alias("fragments"))


# Fixed values of the runway rules: degrees, metres, knots, feet.
TRACK_DEG, LATERAL_M, LEAST_INBOUND_M, CORRIDOR_M = 18.0, 350.0, 1000.0, 12_000.0
TOUCHDOWN_M, GROUND_M, AIRBORNE_KT, LOW_FT, CLIMB_FT, CLIMB_M = (-250.0, 900.0), (-1200.0, 500.0), 45.0, 1600.0, 150.0, 400.0
BEYOND_M, AT_THRESHOLD_M = 1200.0, 1e-9  # a point abeam the threshold is off it by rounding only


def with_known_heights(points: DataFrame, path: str) -> DataFrame:
    """Points with their number in the path (idx) and the known heights next to them: `behind` the last up to here,
    `ahead` the first from here on, each with its number. Points of one time stand by place."""
    w = W.partitionBy(path).orderBy("epoch", "x", "y")
    rows = points.withColumn("idx", F.row_number().over(w))
    known = F.when(F.col("height_ft").isNotNull(), F.struct("idx", F.col("height_ft").alias("ft")))
    so_far = W.unboundedPreceding, 0
    return rows.withColumns({"behind": F.last(known, True).over(W.partitionBy(path).orderBy("idx").rowsBetween(*so_far)), "ahead": F.last(known, True).over(W.partitionBy(path).orderBy(F.desc("idx")).rowsBetween(*so_far))})


def runway_strips(points: DataFrame, runways: DataFrame, lateral_m: float, back_m: float, ahead_m: float, piece_m: float = 2000.0) -> DataFrame:
    """Points at most lateral_m beside the axis of a runway (runway_end, rx, ry, heading), with along and across.

    The axis, from back_m before the threshold to ahead_m beyond it, is cut into pieces whose cells points meet in an
    equi-join; a point belongs to the piece that its `along` falls on.
    """
    sin, cos = F.sin(F.radians("heading")), F.cos(F.radians("heading"))
    starts = F.sequence(F.lit(int(-back_m // piece_m)), F.lit(int(ahead_m // piece_m)))
    pieces = runways.select("runway_end", "rx", "ry", "heading", F.explode(starts).alias("_piece"))
    end = lambda k: [(F.col(o) + (F.col("_piece") + k) * piece_m * d) for o, d in (("rx", sin), ("ry", cos))]
    (ax, ay), (bx, by) = end(0), end(1)
    pieces = pieces.withColumns({"ax": ax, "ay": ay, "bx": bx, "by": by})
    met = S.near_segments(points, pieces, lateral_m + 1.0, cell=max(500.0, lateral_m))
    met = met.withColumn("_f", G.track_frame(F.col("x") - F.col("rx"), F.col("y") - F.col("ry"), F.col("heading")))
    met = met.select("*", F.col("_f.along").alias("along"), F.col("_f.across").alias("across"))
    inside = (F.floor(F.col("along") / piece_m) == F.col("_piece")) & (F.abs("across") <= lateral_m) & F.col("along").between(-back_m, ahead_m)
    return met.where(inside).drop("_f", "_piece", "ax", "ay", "bx", "by", "distance", "part")


def climbs(strips: DataFrame, path: str) -> DataFrame:
    """(path, runway_end) of paths with a ground point and, later, an aligned fast point CLIMB_M farther along and, between
    the first and the last known height from the one to the other, CLIMB_FT higher.

    A ground point counts from the moment its first height is known. One window in order of time keeps the least height
    and the least place of the ground points so far, which settles nearly all: both must be low enough, and if the
    ground point of either is low enough in both, there is a climb. `along` of a ground point is where a climb from it
    begins, so that 400 m sharp are rounded once. Only what is still open, possible while a climbing
    point is less than CLIMB_M beyond the last place of a ground point, meets the ground points of its own path.
    """
    keys = [path, "runway_end"]
    ground = strips.where((F.col("alt_state") == "ground") & F.col("along").between(*GROUND_M) & F.col("ahead").isNotNull())
    ground = ground.groupBy(*keys, F.col("ahead.idx").alias("pos")).agg((F.min("along") + CLIMB_M).alias("along"), F.first("ahead.ft").alias("ft"))
    fast = strips.where(F.col("aligned") & F.col("fast") & (F.col("along") <= CORRIDOR_M) & F.col("behind").isNotNull())
    fast = fast.select(*keys, F.col("idx").alias("pos"), F.col("along").alias("most_along"), (F.col("behind.ft") - CLIMB_FT).alias("most_ft"))
    both = ground.withColumn("at", F.struct("along", "ft")).unionByName(fast, allowMissingColumns=True)
    before = W.partitionBy(*keys).orderBy("pos").rangeBetween(W.unboundedPreceding, -1)
    nearest = F.min("at").over(before)
    lowest = F.min(F.when(F.col("at").isNotNull(), F.struct("ft", "along"))).over(before)
    seen = both.withColumns({"_low": lowest, "_near": nearest}).where("most_ft is not null and _low.ft <= most_ft and _near.along <= most_along")
    seen = seen.withColumn("sure", (F.col("_low.along") <= F.col("most_along")) | (F.col("_near.ft") <= F.col("most_ft")))
    seen = seen.withColumn("settled", F.max("sure").over(W.partitionBy(*keys)))
    open_ = seen.where("not settled").select(*keys, F.col("pos").alias("_pos"), "most_along", "most_ft")
    found = open_.join(ground, keys).where("pos < _pos and along <= most_along and ft <= most_ft").select(*keys)
    return seen.where("sure").select(*keys).unionByName(found).distinct()


def classify_paths(points: DataFrame, runways: DataFrame, path: str = "path_id", back_m: float = 60_000.0) -> DataFrame:
    """A row for each path and runway end that has a point within LATERAL_M of the other: what it may be, and why not.

    Points are (path, epoch, x, y, track_deg, speed_kt, alt_state, height_ft), where height_ft is a height of one datum
    or null. An arrival is an aligned fast point at least LEAST_INBOUND_M before the threshold (back_m at most), followed
    by a ground point in the touchdown zone. A departure is a ground point on the runway, followed by what climbs()
    finds. Confidences are `high_candidate` or `none`; a rejected one has a reason. `arrivals` and `departures` count
    the runway ends of the path that have the same candidate: parallel runways can't be told apart.

    Paths are taken whole: counts and first and last numbers by runway come from one grouped pass, the order of events
    from windows over paths, without a self join.
    """
    keys = [path, "runway_end"]
    strips = runway_strips(with_known_heights(points, path), runways, LATERAL_M, back_m, CORRIDOR_M)
    aligned = F.coalesce(G.angle_diff(F.col("track_deg"), F.col("heading")) <= TRACK_DEG, F.lit(False))
    strips = strips.withColumns({"aligned": aligned, "fast": F.coalesce(F.col("speed_kt") >= AIRBORNE_KT, F.lit(False))})
    corridor = F.col("along").between(-CORRIDOR_M, BEYOND_M)
    on_ground, inbound = F.coalesce(F.col("alt_state") == "ground", F.lit(False)), F.col("along") <= -LEAST_INBOUND_M
    first = F.min(F.when(F.col("aligned") & F.col("fast") & inbound, F.col("idx")))
    last = F.max(F.when(on_ground & F.col("along").between(*TOUCHDOWN_M), F.col("idx")))
    sums = strips.groupBy(*keys).agg(
        F.count_if(corridor).alias("corridor"), F.count_if(corridor & F.col("aligned")).alias("aligned"), F.count_if(corridor & on_ground).alias("ground"),
        F.count_if(corridor & F.col("aligned") & inbound).alias("inbound"), F.count_if(corridor & (F.col("height_ft") < LOW_FT)).alias("low"),
        F.count_if(on_ground & F.col("along").between(*GROUND_M)).alias("anchors"), F.count_if(corridor & F.col("aligned") & (F.col("along") >= AT_THRESHOLD_M)).alias("_outbound"),
        F.coalesce(first < last, F.lit(False)).alias("arrival"),
    )
    rows = sums.join(climbs(strips, path).withColumn("_climbs", F.lit(True)), keys, "left").withColumn("departure", F.coalesce("_climbs", F.lit(False)))
    no_touchdown = F.when((F.col("inbound") > 0) & (F.col("low") > 0), "aligned_low_approach_without_touchdown").when(F.col("inbound") > 0, "aligned_approach_ends_before_touchdown")
    no_climb = F.when(F.col("anchors") > 0, "on_runway_without_aligned_fast_climb").when(F.col("_outbound") > 0, "aligned_outbound_without_ground_anchor")
    confidence = lambda kind: F.when(F.col(kind), "high_candidate").otherwise("none")
    rows = rows.withColumns({
        "arrival_confidence": confidence("arrival"), "departure_confidence": confidence("departure"),
        "arrival_reason": F.when(~F.col("arrival"), F.coalesce(no_touchdown, F.when(F.col("ground") > 0, "on_ground_without_aligned_approach"), F.lit(NO_ARRIVAL))),
        "departure_reason": F.when(~F.col("departure"), F.coalesce(no_climb, F.lit(NO_DEPARTURE))),
    })
    for kind in ("arrival", "departure"):
        rows = rows.withColumn(f"{kind}s", F.count_if(kind).over(W.partitionBy(path)))
    return rows.drop("_climbs", "_outbound")


NO_ARRIVAL, NO_DEPARTURE = "no_approach_in_corridor", "no_departure_in_corridor"


def path_operations(candidates: DataFrame, path: str = "path_id") -> DataFrame:
    """(path, operation, runway_ends, assignment): the candidates of classify_paths(), one row for each path and
    operation. More than one runway end leaves only the axis known."""
    out = None
    for kind in ("arrival", "departure"):
        rows = candidates.where(kind).groupBy(path).agg(F.sort_array(F.collect_list("runway_end")).alias("runway_ends")).withColumn("operation", F.lit(kind))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("assignment", F.when(F.size("runway_ends") > 1, "axis_only").otherwise("single_end"))


def rejection_counts(points: DataFrame, candidates: DataFrame, runways: DataFrame, path: str = "path_id") -> DataFrame:
    """(reasons, paths): how many paths without a candidate share each combination of reasons. A runway end that no
    point of a path comes near gives both reasons of an empty corridor."""
    ends = runways.select("runway_end").distinct().agg(F.count("*").alias("ends"))
    per = candidates.groupBy(path).agg(F.collect_set("arrival_reason").alias("_a"), F.collect_set("departure_reason").alias("_d"), F.count("*").alias("_n"), F.max(F.col("arrival") | F.col("departure")).alias("_is"))
    rows = points.select(path).distinct().join(per, path, "left").where("_is is null or not _is").join(F.broadcast(ends))
    missed = F.when(F.coalesce("_n", F.lit(0)) < F.col("ends"), F.array(F.lit(NO_ARRIVAL), F.lit(NO_DEPARTURE))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    reasons = F.array_sort(F.array_distinct(F.concat(F.coalesce("_a", none), F.coalesce("_d", none), missed)))
    return rows.groupBy(F.array_join(reasons, ";").alias("reasons")).agg(F.count("*").alias("paths"))


def proximity_counts(points: DataFrame, x: float, y: float, radii: list[float], path: str = "ident", kind: str = "type_code") -> DataFrame:
    """(radius, kind, paths, points) within each radius of a place."""
    far = points.withColumn("_d", F.sqrt(F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2))).where(F.col("_d") <= max(radii))
    per = far.groupBy(path, kind).agg(F.min("_d").alias("_near"), *[F.count_if(F.col("_d") <= r).alias(f"_n{i}") for i, r in enumerate(radii)])
    each = F.explode(F.array(*[F.struct(F.lit(float(r)).alias("radius"), F.col(f"_n{i}").alias("n")) for i, r in enumerate(radii)]))
    return per.select(kind, each.alias("r")).where("r.n > 0").groupBy("r.radius", kind).agg(F.count("*").alias("paths"), F.sum("r.n").alias("points"))


def drop_spikes(df: DataFrame, key: str, order: str, value: str, k: int = 2, spike: float = 1.5) -> DataFrame:
    """Rows without those whose value leaves the median of the k before and after, itself included, by over spike."""
    around = F.percentile(value, 0.5).over(W.partitionBy(key).orderBy(order).rowsBetween(-k, k))
    return df.withColumn("_m", around).where(F.abs(F.col(value) - F.col("_m")) <= spike).drop("_m")


def running_median(df: DataFrame, key: str, order: str, value: str, k: int = 2, spike: float = 1.5) -> DataFrame:
    """Replace values that leave the median of the k before and after by more than spike."""
    around = F.percentile(value, 0.5).over(W.partitionBy(key).orderBy(order).rowsBetween(-k, k))
    return df.withColumn("_m", around).withColumn(value, F.when(F.abs(F.col(value) - F.col("_m")) > spike, F.col("_m")).otherwise(F.col(value))).drop("_m")


def circular_mean(df: DataFrame, key: str, place: str, value: str, n: int, k: int) -> DataFrame:
    """Mean over the k neighbours on both sides of a closed series of n places."""
    places = F.array(F.col(place), F.when(F.col(place) < k, F.col(place) + n), F.when(F.col(place) >= n - k, F.col(place) - n))
    wrapped = df.withColumn("_w", F.explode(places)).where("_w is not null").withColumn(place, F.col("_w")).drop("_w")
    return wrapped.withColumn(value, F.avg(value).over(W.partitionBy(key).orderBy(place).rangeBetween(-k, k))).where(F.col(place).between(0, n - 1))


def interpolate_gaps(df: DataFrame, key: str, order: str, value: str, hold: bool = False) -> DataFrame:
    """Unknown values between known ones by their order column; ends stay unknown, or with `hold` keep the nearest."""
    before = W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(key).orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, 0)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(order).alias("o"), F.col(value).alias("v")))
    rows = df.withColumns({"_a": F.last(known, True).over(before), "_b": F.last(known, True).over(after)})
    part = F.when(F.col("_b.o") > F.col("_a.o"), (F.col(order) - F.col("_a.o")) / (F.col("_b.o") - F.col("_a.o"))).otherwise(0.0)
    ends = [F.col("_a.v"), F.col("_b.v")] if hold else []
    return rows.withColumn(value, F.coalesce(value, G.lerp(F.col("_a.v"), F.col("_b.v"), part), *ends)).drop("_a", "_b")


