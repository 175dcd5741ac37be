"""Event exposure: SEL events to LAeq and CNEL, profiles, scenarios, moving sources, types and substitutions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noisegrid.functions import acoustics as A
from noisegrid.functions import geometry as G
from noisegrid.functions import levels as L
from noisegrid.functions import timefns as T
from noisegrid.operators import rules
from noisegrid.operators import spatial as S
from noisegrid.operators.small import hinted


def laeq_from_sel(events: DataFrame, start: str, end: str, keys: list[str]) -> DataFrame:
    """(keys, laeq) of SEL events in [start, end) (UTC), by elapsed seconds: a day with a clock change has 23 or 25 h."""
    a, b = (F.to_timestamp(F.lit(x)) for x in (start, end))
    seconds = F.unix_seconds(b) - F.unix_seconds(a)
    rows = events.where(T.in_window(F.col("ts"), a, b))
    return rows.groupBy(*keys).agg((L.energy_sum(F.col("sel")) - 10.0 * F.log10(F.first(seconds))).alias("laeq"), F.count("*").alias("n"))


def daily_cnel(events: DataFrame, zone: str, keys: list[str]) -> DataFrame:
    """(keys, day, cnel) of SEL events by local date: energies weigh 1, 3 and 10. A second definition beside
    levels.cnel, kept apart."""
    day = F.to_date(F.from_utc_timestamp("ts", zone))
    total = F.sum(L.energy(F.col("sel")) * T.cnel_weight(F.col("ts"), zone))
    return events.groupBy(*keys, day.alias("day")).agg((10.0 * F.log10(total / 86400.0)).alias("cnel"), F.count("*").alias("n"))


def subset_cnel(events: DataFrame, zone: str, keys: list[str]) -> DataFrame:
    """Counts, energies and shares by daypart, and their level over a day."""
    part, amount = T.daypart(F.col("ts"), zone), L.energy(F.col("sel"))
    weights = {"D": 1.0, "E": 3.0, "N": 10.0}
    sums = events.groupBy(*keys).agg(*[F.count_if(part == p).alias(f"n_{p.lower()}") for p in weights], *[F.sum(F.when(part == p, amount * w).otherwise(0.0)).alias(f"energy_{p.lower()}") for p, w in weights.items()])
    total = F.col("energy_d") + F.col("energy_e") + F.col("energy_n")
    return sums.select("*", *[(F.col(f"energy_{p}") / total).alias(f"share_{p}") for p in "den"], (10.0 * F.log10(total / 86400.0)).alias("cnel"))


def timed_laeq(events: DataFrame, start: str, end: str, keys: list[str], refuse: bool = True) -> DataFrame:
    """(keys, laeq, n) of level events over a period. Events that overlap, repeat, cross an edge of the period or break
    another rule are refused with an error; without `refuse` those that begin in the period count."""
    a, b = (F.to_timestamp(F.lit(x)) for x in (start, end))
    if refuse:
        rules.strict(rules.validate_events(events, a, b), "events")
    rows = events.withColumn("sel", L.sel_from_laeq(F.col("laeq_db"), F.col("duration_s"))).withColumnRenamed("start_ts", "ts")
    seconds = F.unix_seconds(b) - F.unix_seconds(a)
    return rows.where(T.in_window(F.col("ts"), a, b)).groupBy(*keys).agg((L.energy_sum(F.col("sel")) - 10.0 * F.log10(F.first(seconds))).alias("laeq"), F.count("*").alias("n"))


def segment_profile(points: DataFrame, most_kt: float = 20.0, keys: tuple[str, ...] = ("profile_id",)) -> DataFrame:
    """Profile points with equal-time breaks added where the speed over a segment changes by more than most_kt.

    Takes seq, dist, alt, speed, power; returns them with fractional order, without repeated places.
    """
    w = W.partitionBy(*keys).orderBy("seq")
    nxt = {n: F.lead(n).over(w) for n in ("dist", "alt", "speed", "power")}
    rows = points.withColumns({f"_{n}": c for n, c in nxt.items()})
    n = F.greatest(F.ceil(F.abs(F.col("_speed") - F.col("speed")) / most_kt).cast("int"), F.lit(1))
    rows = rows.withColumn("_n", F.coalesce(n, F.lit(1))).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    time = F.col("_i") / F.col("_n")  # equal times: the distance goes with the mean speed so far
    mean = F.col("speed") + F.col("_speed")
    part = F.when((F.col("_i") > 0) & (mean > 0), time * (2 * F.col("speed") + time * (F.col("_speed") - F.col("speed"))) / mean).otherwise(0.0)
    at = lambda n: F.when(F.col("_i") == 0, F.col(n)).otherwise(G.lerp(F.col(n), F.col(f"_{n}"), part))
    sq = lambda n: F.when(F.col("_i") == 0, F.col(n)).otherwise(G.lerp_sq(F.col(n), F.col(f"_{n}"), part))
    out = rows.select(*keys, (F.col("seq") + time).alias("seq"), at("dist").alias("dist"), at("alt").alias("alt"), sq("speed").alias("speed"), sq("power").alias("power"))
    same = F.col("dist") == F.lag("dist").over(w)
    return out.withColumn("_s", F.coalesce(same, F.lit(False))).where(~F.col("_s")).drop("_s")


def place_profile(profile: DataFrame, anchor_m: float, start_m: float, end_m: float, keys: tuple[str, ...] = ("profile_id",)) -> DataFrame:
    """Profile points as stations of a route (s), its distance 0 at anchor_m, extended level to start_m and end_m."""
    placed = profile.withColumn("s", F.col("dist") + anchor_m)
    w = W.partitionBy(*keys)
    ends = placed.withColumns({"_lo": F.min("s").over(w), "_hi": F.max("s").over(w)})
    first = ends.where((F.col("s") == F.col("_lo")) & (F.col("_lo") > start_m)).withColumns({"s": F.lit(float(start_m)), "seq": F.col("seq") - 1})
    last = ends.where((F.col("s") == F.col("_hi")) & (F.col("_hi") < end_m)).withColumns({"s": F.lit(float(end_m)), "seq": F.col("seq") + 1})
    return ends.unionByName(first).unionByName(last).drop("_lo", "_hi", "dist")


def profile_segments(profile: DataFrame, keys: tuple[str, ...] = ("profile_id",)) -> DataFrame:
    """Consecutive points as segments s1, z1, v1, p1 to s2, z2, v2, p2."""
    w = W.partitionBy(*keys).orderBy("seq")
    names = {"s": "s", "alt": "z", "speed": "v", "power": "p"}
    rows = profile.withColumns({f"{b}1": F.col(a) for a, b in names.items()} | {f"{b}2": F.lead(a).over(w) for a, b in names.items()})
    return rows.where("s2 > s1").select(*keys, "seq", *[f"{b}{i}" for i in (1, 2) for b in names.values()])


def event_sel(segments: DataFrame, receivers: DataFrame, npd_sel: DataFrame, npd_max: DataFrame, temp_c: float = 15.0, pressure_mmhg: float = 760.0, kind: str = "wing", engine: str = "jet", keys: tuple[str, ...] = ("profile_id",), reach_m: float = 50_000.0) -> DataFrame:
    """(keys, site_id, sel, rejected): exposure of each site (site_id, ox, oy, oz, in the frame of the route) to each
    event's segments (with npd_id and operation) within reach_m: all terms of a segment summed, then their energies.

    A runway segment of a departure that lies ahead of the site has the finite-segment term of the take-off roll and,
    for jets and turboprops (`engine`), the directivity behind the start of roll. Sites and segments meet in cells.
    """
    c = F.col
    lines = segments.withColumns({"ax": c("s1"), "ay": F.lit(0.0), "bx": c("s2"), "by": F.lit(0.0)})
    sites = receivers.withColumns({"x": c("ox"), "y": c("oy")})
    met = S.near_segments(sites, lines, reach_m, deals=32).drop("x", "y", "ax", "ay", "bx", "by", "distance", "part")
    g = A.segment_geometry(met).withColumn("distance_m", c("slant_m"))
    rows = A.with_npd_level(A.with_npd_level(g, npd_sel, "sel0", "_s1"), npd_max, "max0", "_s2")
    q_ft, length_ft, side_ft = (c(n) / 0.3048 for n in ("q_m", "length_m", "oy"))
    roll = (c("z1") <= 1) & (c("z2") <= 1) & (c("operation") == "D")
    finite = F.when(roll & (q_ft <= 0), A.takeoff_roll(c("sel0"), c("max0"), length_ft)).otherwise(A.finite_segment(c("sel0"), c("max0"), q_ft, length_ft))
    behind = F.when(roll & (q_ft < 0), A.start_of_roll(q_ft, side_ft, F.lit(engine))).otherwise(0.0) if engine in ("jet", "turboprop") else F.lit(0.0)
    duration = F.when((c("z1") <= 1) & (c("z2") <= 1) & (c("speed_mps") <= 0), 0.0).otherwise(A.duration_correction(c("speed_mps")))
    level = A.segment_sel(c("sel0"), A.impedance_adjustment(F.lit(temp_c), F.lit(pressure_mmhg)), duration, A.installation_correction(c("phi_deg"), F.lit(kind)), A.lateral_attenuation(c("beta_deg"), c("lateral_m")), finite, behind)
    return rows.withColumn("level", level).groupBy(*keys, "site_id").agg(L.energy_sum(c("level")).alias("sel"), F.count_if(c("level").isNull()).alias("rejected"))


def scenario_grid(events: DataFrame, sites: DataFrame, sides: list[str], heights_ft: list[float], offsets_m: list[float]) -> DataFrame:
    """Every event x site x runway side x height x offset. Sites are few; the lists are literals."""
    values = lambda xs, n: F.explode(F.array(*[F.lit(x) for x in xs])).alias(n)
    rows = events.crossJoin(hinted(sites))
    for n, xs in (("side", sides), ("height_ft", heights_ft), ("offset_m", offsets_m)):
        rows = rows.select("*", values(xs, n))
    return rows


def moving_source_sel(tracks: DataFrame, receivers: DataFrame, spectrum: list[tuple[float, float]], reference_m: float = 1.0, reference_deg: float = 0.0, knots: list[tuple[float, float]] | None = None, air_db_km: list[float] | None = None, loss_db: list[float] | None = None, reach_m: float = 5000.0, panels: int = 64) -> DataFrame:
    """(track_id, site_id, sel, bands, closest_m, status): exposure of sites within reach_m of a moving source.

    The source has band levels (hz, level) at reference_m and reference_deg off its heading; `knots` are gains by angle
    off the heading, air_db_km and loss_db the bands' air absorption and other losses against the reference path.
    Tracks are segments (track_id, seq, t1, x1, y1, z1, heading1, t2, ...; headings in degrees counter-clockwise from
    east; heights and headings may be absent) and sites (site_id, ox, oy, oz). bands are unweighted exposures, sel their
    A-weighted sum. A site on a segment (`on_track`) or seen at an angle beyond the knots (`unmeasured_angle`) has null.

    Over a segment, time is integrated by Simpson's rule in the angle seen from the site, in which spherical spreading
    is constant; a source that stands still is one sample. Without knots, a band without air absorption is constant too
    and needs no samples.
    """
    c, n = F.col, len(spectrum)
    air, loss = air_db_km or [0.0] * n, loss_db or [0.0] * n
    for name in ("z1", "z2", "heading1", "heading2"):
        tracks = tracks if name in tracks.columns else tracks.withColumn(name, F.lit(0.0))
    sites = (receivers if "oz" in receivers.columns else receivers.withColumn("oz", F.lit(0.0))).withColumns({"x": c("ox"), "y": c("oy")})
    lines = tracks.withColumns({"ax": c("x1"), "ay": c("y1"), "bx": c("x2"), "by": c("y2")}).where("t2 > t1")
    met = S.near_segments(sites, lines, reach_m, deals=32)
    d = {a: c(f"{a}2") - c(f"{a}1") for a in "xyz"}
    to = {a: c(f"o{a}") - c(f"{a}1") for a in "xyz"}
    long = F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"])
    along = (to["x"] * d["x"] + to["y"] * d["y"] + to["z"] * d["z"]) / F.nullif(c("_l"), F.lit(0.0))
    far2 = F.greatest(to["x"] * to["x"] + to["y"] * to["y"] + to["z"] * to["z"], F.lit(1e-24))
    met = met.withColumn("_l", long).withColumn("_q", F.when(c("_l") > 0, along).otherwise(0.0)).withColumn("_b", F.sqrt(F.greatest(far2 - c("_q") * c("_q"), F.lit(0.0))))
    nearest = F.sqrt(F.pow(c("_b"), 2) + F.pow(c("_q") - F.least(F.greatest(c("_q"), F.lit(0.0)), c("_l")), 2))
    met = met.withColumns({"_near": nearest, "_b": F.greatest(c("_b"), F.lit(1e-6))})
    lo, hi = F.atan(-c("_q") / c("_b")), F.atan((c("_l") - c("_q")) / c("_b"))
    moving = c("_l") > 0

    def node(i: Column) -> Column:
        u = lo + (hi - lo) * i / panels
        part = F.when(moving, (c("_q") + c("_b") * F.tan(u)) / F.nullif(c("_l"), F.lit(0.0))).otherwise(i / panels)
        at = {a: c(f"{a}1") + part * d[a] for a in "xyz"}
        r = F.when(moving, c("_b") / F.cos(u)).otherwise(F.sqrt(far2))
        bearing = F.degrees(F.atan2(c("oy") - at["y"], c("ox") - at["x"]))
        turned = G.angle_diff(bearing, G.interp_heading(c("heading1"), c("heading2"), part))
        w = F.when((i == 0) | (i == panels), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        return F.struct(w.alias("w"), r.alias("r"), (F.lit(0.0) if knots is None else A.directivity_gain(turned, _knots(knots)) - A.directivity_gain(F.lit(float(reference_deg)), _knots(knots))).alias("gain"))

    sampled = knots is not None or any(air)
    met = met.withColumn("_nodes", F.transform(F.sequence(F.lit(0), F.lit(panels)), node)) if sampled else met
    # with s = q + b tan(u), ds / r^2 = du / b; standing still, the time over r^2
    scale = F.when(moving, (hi - lo) / panels / 3.0 / c("_b") * (c("t2") - c("t1")) / F.nullif(c("_l"), F.lit(0.0))).otherwise((c("t2") - c("t1")) / panels / 3.0 / far2)

    def band(level: float, absorbed: float, lost: float) -> Column:
        if knots is None and not absorbed:  # alike at every node: the sum of the weights
            return F.lit(3.0 * panels) * scale * L.energy(F.lit(float(level) - lost)) * reference_m**2
        received = F.aggregate("_nodes", F.lit(0.0), lambda acc, x: acc + x["w"] * L.energy(x["gain"] - absorbed * (x["r"] - reference_m) / 1000.0))
        return received * scale * L.energy(F.lit(float(level) - lost)) * reference_m**2

    energies = [band(level, air[k], loss[k]).alias(f"_e{k}") for k, (_, level) in enumerate(spectrum)]
    status = F.when(c("_near") <= 1e-9, "on_track")
    status = status if knots is None else status.when(F.exists("_nodes", lambda x: x["gain"].isNull()), "unmeasured_angle")
    rows = met.select("track_id", "site_id", c("_near"), status.alias("_bad"), *energies)
    sums = rows.groupBy("track_id", "site_id").agg(F.max("_bad").alias("_bad"), F.min("_near").alias("closest_m"), *[F.sum(f"_e{k}").alias(f"_e{k}") for k in range(n)])
    weighted = sum((c(f"_e{k}") * L.energy(L.a_weighting(F.lit(float(hz)))) for k, (hz, _) in enumerate(spectrum)), F.lit(0.0))
    good = lambda x: F.when(c("_bad").isNull(), x)
    return sums.select("track_id", "site_id", good(10.0 * F.log10(weighted)).alias("sel"), good(F.array(*[10.0 * F.log10(f"_e{k}") for k in range(n)])).alias("bands"), "closest_m", F.coalesce("_bad", F.lit("ok")).alias("status"))


def _knots(knots: list[tuple[float, float]]) -> Column:
    return F.array(*[F.struct(F.lit(float(a)).alias("angle"), F.lit(float(g)).alias("gain")) for a, g in knots])


def map_types(types: DataFrame, registry: DataFrame, npd: DataFrame) -> DataFrame:
    """(type_code, anp_id, status): unknown_type, no_model, no_curves or mapped."""
    have = npd.select(F.col("npd_id").alias("_npd")).distinct()
    met = types.join(registry.select("type_code", "anp_id", "npd_id", F.lit(True).alias("_r")), "type_code", "left").join(have, F.col("npd_id") == F.col("_npd"), "left")
    status = F.when(F.col("_r").isNull(), "unknown_type").when(F.col("anp_id").isNull(), "no_model").when(F.col("_npd").isNull(), "no_curves").otherwise("mapped")
    return met.withColumn("status", status).drop("_r", "_npd")


def profile_index(profiles: DataFrame, steps: DataFrame, weights: DataFrame, npd: DataFrame) -> DataFrame:
    """Counts of profile points, procedure steps, weights and metrics per aircraft and operation."""
    keys = ["acft_id", "op"]
    parts = [(profiles, "profile_points"), (steps, "steps"), (weights, "weights")]
    out = npd.groupBy(*keys).agg(F.count_distinct("metric").alias("metrics"))
    for df, name in parts:
        out = out.join(df.groupBy(*keys).agg(F.count("*").alias(name)), keys, "full_outer")
    return out.na.fill(0)


def resolve_substitutions(codes: DataFrame, substitutions: DataFrame, index: DataFrame) -> DataFrame:
    """The proxy of each code and operation with the largest delta among those with profiles and both metrics."""
    complete = index.where("(profile_points > 0 or steps > 0) and metrics >= 2").select(F.col("acft_id").alias("proxy"), "op")
    met = codes.join(substitutions, "code").join(complete, ["proxy", "op"])
    best = F.row_number().over(W.partitionBy("code", "op").orderBy(F.desc("delta_db"), "proxy"))
    return met.withColumn("_r", best).where("_r = 1").select("code", "op", "proxy", "delta_db")


def candidate_review(events: DataFrame, mapping: DataFrame) -> DataFrame:
    """Events per operation and mapping status."""
    return events.join(mapping.select("type_code", "status"), "type_code", "left").groupBy("operation", F.coalesce("status", F.lit("unmapped")).alias("status")).agg(F.count("*").alias("n"))


def inspect_point(points: DataFrame, records: DataFrame, polygons: DataFrame, reach: float, most: int = 4, key: str = "pk") -> DataFrame:
    """The nearest record of each family within reach, then the context polygons around, four at most per point. Of a
    family's records in one place only the least can be given, of polygons of one ring the `most` least."""
    places = records.groupBy("family", "sx", "sy").agg(F.min("site_id").alias("site_id"))
    near = S.within(points.select(key, "x", "y"), places, reach)
    alike = F.row_number().over(W.partitionBy("ring").orderBy("poly_id"))
    polygons = polygons.withColumn("_r", alike).where(F.col("_r") <= most).drop("_r")
    first = near.groupBy(key, "family").agg(F.min(F.struct("distance", "site_id")).alias("b")).select(key, F.lit(0).alias("rank"), "family", F.col("b.site_id").alias("id"), F.col("b.distance").alias("distance"))
    held = S.points_in_polygons(points.select(key, "x", "y"), polygons).select(key, F.lit(1).alias("rank"), "family", F.col("poly_id").alias("id"), F.lit(0.0).alias("distance"))
    order = F.row_number().over(W.partitionBy(key).orderBy("rank", "distance", "id"))
    return first.unionByName(held).withColumn("_r", order).where(F.col("_r") <= most).drop("_r", "rank")


