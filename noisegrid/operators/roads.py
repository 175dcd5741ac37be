"""Roads and rail: conflation by sampled points, carriageways, dead ends, bridges, crossings and services."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noisegrid.functions import geometry as G
from noisegrid.functions import timefns as T
from noisegrid.functions import traffic
from noisegrid.operators import spatial as S
from noisegrid.operators.small import dealt, hinted


def directions(segments: DataFrame, key: str) -> DataFrame:
    """(key, angle): the direction of each line from its first to its last point."""
    ends = segments.groupBy(key).agg(F.min_by(F.struct("ax", "ay"), "seq").alias("a"), F.max_by(F.struct("bx", "by"), "seq").alias("b"))
    return ends.select(key, G.line_angle(F.col("b.bx") - F.col("a.ax"), F.col("b.by") - F.col("a.ay")).alias("angle"))


def conflate(lines: DataFrame, others: DataFrame, reach: float, most_angle: float = 25.0, least_share: float = 0.5, step: float = 2.0, same: Column | None = None, prefer: str | None = None) -> DataFrame:
    """(edge_id, other_id, share): the line of `others` that follows each line of `lines` best.

    Lines are segments (edge_id, seq, ax, ay, bx, by); others likewise with other_id and any attributes. A candidate
    lies within reach of least_share of the line's points, sampled every step metres, and differs by most_angle at
    most; `same` is a test on attributes of both. The largest share wins, then `prefer`, then the shortest of the others
    (the line is the largest part of it), then the least id. The error of a share is one sample at each end.
    """
    own = [x for x in lines.columns if x not in ("seq", "ax", "ay", "bx", "by", "edge_id")]
    points = S.densify(lines, step).withColumn("_p", F.monotonically_increasing_id())
    totals = points.groupBy("edge_id").agg(F.count("*").alias("_total"))
    near = S.near_segments(points.select("edge_id", "_p", "x", "y"), others.select("other_id", "ax", "ay", "bx", "by"), reach)
    hits = near.groupBy("edge_id", "other_id").agg(F.count_distinct("_p").alias("_hits"))
    long = F.round(F.sum(F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))), 6)
    turns = directions(lines, "edge_id"), directions(others, "other_id").withColumnRenamed("angle", "_angle").join(others.groupBy("other_id").agg(long.alias("_long")), "other_id")
    rest = [x for x in others.columns if x not in ("seq", "ax", "ay", "bx", "by")]
    met = hits.join(totals, "edge_id").join(turns[0], "edge_id").join(turns[1], "other_id")
    met = met.join(others.select(*rest).dropDuplicates(["other_id"]), "other_id").join(lines.select("edge_id", *own).dropDuplicates(["edge_id"]), "edge_id")
    met = met.withColumn("share", F.col("_hits") / F.col("_total")).where((F.col("share") >= least_share) & (G.line_angle_diff(F.col("angle"), F.col("_angle")) <= most_angle))
    met = met if same is None else met.where(same)
    order = [F.desc("share"), *([F.desc_nulls_last(prefer)] if prefer else []), F.asc("_long"), F.asc("other_id")]
    return met.withColumn("_rank", F.row_number().over(W.partitionBy("edge_id").orderBy(*order))).where("_rank = 1").select("edge_id", "other_id", "share")


def assign_traffic(edges: DataFrame, records: DataFrame, reach: float = 20.0, freeway_reach: float = 60.0) -> DataFrame:
    """Records (other_id, freeway, aadt) for edges (edge_id, freeway): freeways match freeways, at their own reach."""
    same = F.col("freeway") == F.col("r_freeway")
    found = [conflate(edges.where(F.col("freeway") == f), records.where(F.col("freeway") == f).withColumnRenamed("freeway", "r_freeway"), r, same=same, prefer="aadt") for f, r in ((False, reach), (True, freeway_reach))]
    return found[0].unionByName(found[1])


def classify_streets(edges: DataFrame, ways: DataFrame) -> DataFrame:
    """The street tag of the way that an edge follows within 15 m."""
    return conflate(edges, ways.dropDuplicates(["other_id", "seq"]), 15.0).join(ways.select("other_id", "street").dropDuplicates(["other_id"]), "other_id")


def dead_ends(ends: DataFrame, box: tuple[float, float, float, float] | None = None, digits: int = 1) -> DataFrame:
    """(edge_id) of lines (edge_id, ax, ay, bx, by) with an end that no other line shares, not on the box's edge."""
    end = lambda s: F.struct(F.round(f"{s}x", digits).alias("x"), F.round(f"{s}y", digits).alias("y"))
    each = ends.select("edge_id", F.explode(F.array(end("a"), end("b"))).alias("p")).select("edge_id", "p.x", "p.y")
    free = each.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("edge_id").alias("edge_id")).where("n = 1")
    if box is not None:
        x1, y1, x2, y2 = box
        free = free.where((F.col("x") > x1 + 1) & (F.col("x") < x2 - 1) & (F.col("y") > y1 + 1) & (F.col("y") < y2 - 1))
    return free.select("edge_id").distinct()


def detect_split(edges: DataFrame, apart: float = 5.0) -> DataFrame:
    """(edge_id, split): 0.5 for freeways, and for edges of one record whose stations overlap by half at over `apart`
    metres; else 1. Takes edge_id, record_id, from_m, to_m, offset_m, freeway. Edges of a record meet in station
    buckets of 200 m."""
    size = 200.0
    e = edges.where("record_id is not null").withColumn("b", F.explode(F.sequence(F.floor(F.col("from_m") / size), F.floor(F.col("to_m") / size))))
    o = e.select("record_id", "b", F.col("edge_id").alias("o_id"), F.col("from_m").alias("o_from"), F.col("to_m").alias("o_to"), F.col("offset_m").alias("o_off"))
    overlap = F.least("to_m", "o_to") - F.greatest("from_m", "o_from")
    short = F.least(F.col("to_m") - F.col("from_m"), F.col("o_to") - F.col("o_from"))
    twins = e.join(o, ["record_id", "b"]).where((F.col("edge_id") != F.col("o_id")) & (overlap > 0.5 * short) & (F.abs(F.col("offset_m") - F.col("o_off")) > apart)).select("edge_id").distinct()
    return edges.join(twins.withColumn("_twin", F.lit(True)), "edge_id", "left").select("edge_id", F.when(F.coalesce("freeway", F.lit(False)) | F.col("_twin").isNotNull(), 0.5).otherwise(1.0).alias("split"))


def apply_bridges(edges: DataFrame, decks: DataFrame, reach: float = 8.0, step: float = 5.0, most_angle: float = 25.0) -> DataFrame:
    """(edge_id, station, x, y, deck_id, deck_z): points every step metres that lie on an aligned deck.

    Decks are segments (deck_id, seq, ax, ay, az, bx, by, bz); heights are interpolated along them.
    """
    points = S.densify(edges, step).withColumn("_p", F.monotonically_increasing_id()).join(directions(edges, "edge_id"), "edge_id")
    near = S.near_segments(points, decks, reach).withColumn("_turn", G.line_angle(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))
    near = near.where(G.line_angle_diff(F.col("angle"), F.col("_turn")) <= most_angle).withColumn("deck_z", G.lerp(F.col("az"), F.col("bz"), F.col("part")))
    best = F.row_number().over(W.partitionBy("_p").orderBy("distance", "deck_id", "seq"))
    return near.withColumn("_r", best).where("_r = 1").select("edge_id", "station", "x", "y", "deck_id", "deck_z")


def crossings_on_track(tracks: DataFrame, crossings: DataFrame, reach: float = 30.0) -> DataFrame:
    """(crossing_id, edge_id, station): the place of each crossing on every track within reach. Crossings in one place and
    tracks of the same segments are met once."""
    like, places = S.alike_lines(tracks), crossings.select("x", "y").distinct()
    near = S.near_segments(places, S.stations(tracks.join(like.where("edge_id = _like").select("edge_id"), "edge_id", "left_semi")), reach)
    best = F.min(F.struct("distance", (F.col("station") + F.col("part") * F.col("length")).alias("station")))
    found = near.groupBy("x", "y", F.col("edge_id").alias("_like")).agg(best.alias("b"))
    met = found.join(like, "_like").select("x", "y", "edge_id", "b")
    named = crossings.select("crossing_id", "x", "y").distinct().withColumn("_n", F.count("*").over(W.partitionBy("crossing_id")))
    out = lambda rows: rows.join(met.hint("merge"), ["x", "y"])
    several = out(named.where("_n > 1")).groupBy("crossing_id", "edge_id").agg(F.min("b").alias("b"))
    return out(named.where("_n = 1")).select("crossing_id", "edge_id", "b").union(several).select("crossing_id", "edge_id", F.col("b.station").alias("station"))


def horn_sources(tracks: DataFrame, crossings: DataFrame, seconds: float = 17.5, most_m: float = 402.0) -> DataFrame:
    """Stretches of track that sound: (crossing_id, edge_id, start_m, end_m, bands_d, bands_e, bands_n).

    Crossings carry speed_kmh and trains an hour d, e, n. Stretches under 10 m are dropped.
    """
    at = crossings_on_track(tracks, crossings).join(crossings.drop("x", "y"), "crossing_id")
    total = S.stations(tracks).groupBy("edge_id").agg(F.sum("length").alias("total"))
    half = F.least(F.greatest("speed_kmh", F.lit(10.0)) / 3.6 * seconds, F.lit(most_m))
    rows = at.join(total, "edge_id").withColumns({"start_m": F.greatest(F.col("station") - half, F.lit(0.0)), "end_m": F.least(F.col("station") + half, F.col("total"))})
    bands = [traffic.horn_emission(F.col(p), F.col("speed_kmh")).alias(f"bands_{p}") for p in "den"]
    return rows.where("end_m - start_m >= 10").select("crossing_id", "edge_id", "start_m", "end_m", *bands)


def parallel_tracks(tracks: DataFrame, reach: float = 8.0, least_m: float = 50.0, step: float = 2.0) -> DataFrame:
    """(edge_id, tracks): on how many parallel tracks the traffic of each is shared, itself included.

    Tracks of the same segments are met once. Of two straight tracks, the points of one beside the other follow each
    other, so that half of them can't miss its three points in the middle: only pairs that these find are counted.
    """
    c = F.col
    like = S.alike_lines(tracks)
    members = like.groupBy("_like").agg(F.count("*").alias("_members"))
    own = tracks.join(like.where("edge_id = _like").select("edge_id"), "edge_id", "left_semi")
    long = S.stations(own).groupBy("edge_id").agg(F.sum("length").alias("total"), (F.count("*") == 1).alias("_straight"))
    others = own.join(long.select("edge_id", "_straight"), "edge_id").select(c("edge_id").alias("other_id"), "ax", "ay", "bx", "by", c("_straight").alias("_other"))
    points = S.densify(own, step).withColumn("_p", F.monotonically_increasing_id()).join(long, "edge_id")
    middle = F.abs(c("station") - c("total") / 2) <= c("total") * 1.001 / F.greatest(F.ceil(c("total") / step), F.lit(1))
    straight = own.join(long.where("_straight").select("edge_id", "total"), "edge_id")
    pairs = S.near_segments(points.where(c("_straight") & middle).select("edge_id", "x", "y"), others.where("_other").drop("_other"), reach).select("edge_id", "other_id", *[c(n).alias(f"o_{n}") for n in ("ax", "ay", "bx", "by")]).distinct()
    pairs = dealt(pairs, "edge_id").join(straight, "edge_id")
    n = F.greatest(F.ceil(c("total") / step).cast("int"), F.lit(1))
    part = c("_i") / c("_n")
    each = pairs.withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(0), c("_n")))).select("edge_id", "other_id", G.point_segment(G.lerp(c("ax"), c("bx"), part), G.lerp(c("ay"), c("by"), part), c("o_ax"), c("o_ay"), c("o_bx"), c("o_by"))["distance"].alias("distance"))
    near = S.near_segments(points.where("not _straight"), others, reach).unionByName(S.near_segments(points.where("_straight"), others.where("not _other"), reach))
    hits = each.where(c("distance") <= reach).groupBy("edge_id", "other_id").agg((F.count("*") * step).alias("beside_m"))
    hits = hits.unionByName(near.groupBy("edge_id", "other_id").agg((F.count_distinct("_p") * step).alias("beside_m")))
    beside = hits.join(long, "edge_id").where(c("beside_m") > F.greatest(F.lit(least_m), c("total") / 2)).join(members.withColumnRenamed("_like", "other_id"), "other_id")
    both = beside.groupBy("edge_id").agg(F.sum(c("_members") - (c("edge_id") == c("other_id")).cast("int")).alias("n"))
    return like.join(both.withColumnRenamed("edge_id", "_like"), "_like", "left").select("edge_id", (F.coalesce("n", F.lit(0)) + 1).alias("tracks"))


def rail_sections(tracks: DataFrame, services: DataFrame, piece_m: float = 200.0) -> DataFrame:
    """Pieces of track with a row for each service: speed near its stops, trains an hour by period over the tracks.

    Services are (service, line, d, e, n, speed_kmh, stops array<struct<x, y>>); tracks carry line.
    """
    pieces = S.cut_line(tracks, piece_m).groupBy("edge_id", "line", "piece").agg(F.avg((F.col("ax") + F.col("bx")) / 2).alias("x"), F.avg((F.col("ay") + F.col("by")) / 2).alias("y"))
    rows = pieces.join(services, "line").join(parallel_tracks(tracks), "edge_id")
    stop = F.array_min(F.transform("stops", lambda s: F.sqrt(F.pow(s["x"] - F.col("x"), 2) + F.pow(s["y"] - F.col("y"), 2))))
    speed = F.when(F.size("stops") > 0, traffic.service_speed(F.col("speed_kmh"), stop)).otherwise(F.col("speed_kmh"))
    return rows.select("edge_id", "piece", "service", speed.alias("speed_kmh"), *[(F.col(p) / F.col("tracks")).alias(p) for p in "den"])


def active_trips(trips: DataFrame, calendar: DataFrame, exceptions: DataFrame, dates: DataFrame) -> DataFrame:
    """(trip_id, route_id, date): trips whose service runs on a date, by weekday and validity, exceptions added and
    removed. calendar: service_id, dow array<int> (0 Monday), start_date, end_date; exceptions: service_id, date,
    exception_type (1 added, 2 removed)."""
    base = calendar.join(dates, (F.col("date") >= F.col("start_date")) & (F.col("date") <= F.col("end_date")) & F.array_contains("dow", F.weekday("date"))).select("service_id", "date")
    runs = base.union(exceptions.where("exception_type = 1").select("service_id", "date")).distinct().join(exceptions.where("exception_type = 2").select("service_id", "date"), ["service_id", "date"], "left_anti")
    return trips.join(runs, "service_id").select("trip_id", "route_id", "date")


def trains_per_hour(stop_times: DataFrame, trips: DataFrame, days: int = 7) -> DataFrame:
    """(route_id, period, per_hour) of trips over days: a trip counts once, at its first time at the stop.

    Takes stop_times (trip_id, clock) and trips (trip_id, route_id, date).
    """
    first = stop_times.groupBy("trip_id").agg(F.min("clock").alias("clock"))
    hours = F.create_map(*[F.lit(x) for kv in (("D", 12.0), ("E", 3.0), ("N", 9.0)) for x in kv])
    rows = trips.join(first, "trip_id").select("route_id", T.period_of_clock(F.col("clock")).alias("period"))
    return rows.groupBy("route_id", "period").agg(F.count("*").alias("n")).select("route_id", "period", (F.col("n") / days / hours[F.col("period")]).alias("per_hour"))


def filter_crossings(df: DataFrame) -> DataFrame:
    """Crossings that sound: a 24 h ban (`whistle_ban` = 1) goes; a partial ban or a private one has no night."""
    return df.where(F.coalesce("whistle_ban", F.lit(0)) != 1).withColumn("night", ~((F.coalesce("whistle_ban", F.lit(0)) == 2) | F.coalesce("private", F.lit(False))))


def classify_lines(df: DataFrame, classes: DataFrame) -> DataFrame:
    """The first class (class_order, class, pattern, x1, y1, x2, y2) whose name pattern and box a line (edge_id, name,
    x, y) fits. Classes are a handful of configured rows."""
    fits = F.expr("rlike(name, pattern)") & F.col("x").between(F.col("x1"), F.col("x2")) & F.col("y").between(F.col("y1"), F.col("y2"))
    return df.join(hinted(classes), fits).groupBy("edge_id").agg(F.min_by("class", "class_order").alias("class"))


def filter_edges(df: DataFrame, box: tuple[float, float, float, float], classes: list[str] | None = None, least_m: float = 1.0) -> DataFrame:
    """Segments of motor roads clipped to a box; parts under least_m are dropped."""
    return clip_roads(df.where(F.col("mtfcc").isin(*(classes or list(traffic.CLASS_DEFAULTS)))), box, least_m)


def busy_edges(edges: DataFrame, least_aadt: float = 5000.0) -> DataFrame:
    """Edges with traffic whose two-way flow, both carriageways together, is least_aadt or more a day."""
    return edges.where(F.col("aadt_assigned") / F.col("split") >= least_aadt)


def prepare_footprints(df: DataFrame, least_m2: float = 4.0) -> DataFrame:
    """Footprints (ring) that are closed, whose edges don't cross, of least_m2 at least, with their area."""
    valid = G.once(F.col("ring"), lambda ring: (F.size(ring) >= 4) & (ring[0] == F.element_at(ring, -1)) & ~G.crosses_itself(ring))
    return df.where(valid).withColumn("area", G.ring_area(F.col("ring"))).where(F.col("area") >= least_m2)


def clip_roads(df: DataFrame, box: tuple[float, float, float, float], least_m: float = 0.5) -> DataFrame:
    """Segments cut to a box, such as a tile's core; parts under least_m are dropped."""
    c = F.col
    part = G.clip_segment(c("ax"), c("ay"), c("bx"), c("by"), *[F.lit(float(v)) for v in box])
    rows = df.withColumn("_c", part).where("_c is not null")
    cut = {n: G.lerp(c(f"a{a}"), c(f"b{a}"), c(f"_c.{p}")) for n, a, p in (("_ax", "x", "lo"), ("_ay", "y", "lo"), ("_bx", "x", "hi"), ("_by", "y", "hi"))}
    rows = rows.withColumns(cut).withColumns({n[1:]: c(n) for n in cut}).drop("_c", *cut)
    return rows.where(F.sqrt(F.pow(c("bx") - c("ax"), 2) + F.pow(c("by") - c("ay"), 2)) >= least_m)


def wall_obstacles(df: DataFrame, width: float = 0.3) -> DataFrame:
    """(wall_id, seq, ring, height, imputed): a thin rectangle for each segment of a wall with a height text."""
    from noisegrid.functions.text import wall_height

    c = F.col
    long = F.sqrt(F.pow(c("bx") - c("ax"), 2) + F.pow(c("by") - c("ay"), 2))
    nx, ny = -(c("by") - c("ay")) / long * width / 2, (c("bx") - c("ax")) / long * width / 2
    p = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(p(c("ax") + nx, c("ay") + ny), p(c("bx") + nx, c("by") + ny), p(c("bx") - nx, c("by") - ny), p(c("ax") - nx, c("ay") - ny), p(c("ax") + nx, c("ay") + ny))
    return df.where(long > 0).withColumn("_h", wall_height(c("height"))).select("wall_id", "seq", ring.alias("ring"), c("_h.value").alias("height"), c("_h.imputed").alias("imputed"))


def union_sources(*dfs: DataFrame, least_height: float = 0.5, rolling: str = "rolling") -> DataFrame:
    """All sources; rolling noise stands at least_height."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out.withColumn("z", F.when(F.col("source") == rolling, F.lit(least_height)).otherwise(F.col("z")))
