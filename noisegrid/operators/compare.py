"""Comparison: error statistics, runs, bands, the physical ceiling, monitors, throughput."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noisegrid.functions import geometry as G
from noisegrid.functions import levels as L
from noisegrid.operators import spatial as S
from noisegrid.operators.nearest import stored
from noisegrid.operators.quantiles import percentiles
from noisegrid.operators.small import dealt
from noisegrid.operators.tiles import numbered


def error_stats(df: DataFrame, estimate: str, reference: str, keys: list[str] | None = None, within: tuple[float, ...] = (1.0, 3.0)) -> DataFrame:
    """n, mae, rmse, bias, median, percentiles of the absolute error and shares within some dB, for each group."""
    keys, error, size = keys or [], F.col("_e"), F.abs("_e")
    rows = df.select(*keys, (F.col(estimate) - F.col(reference)).alias("_e"))
    shares = [(F.count_if(size <= k) / F.count(error)).alias(f"within_{k:g}") for k in within]
    out = rows.groupBy(*keys).agg(F.count(error).alias("n"), F.avg(size).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(error).alias("bias"), *shares)
    middle = percentiles(rows, "_e", [0.5], keys).withColumnRenamed("values", "_m")
    points = percentiles(rows.withColumn("_e", size), "_e", [0.5, 0.9, 0.95, 0.99], keys).withColumnRenamed("values", "_p")
    for more in (middle, points):
        out = out.join(more, keys, "left") if keys else out.join(more, how="left")
    named = [F.col("_m")[0].alias("median"), *[F.col("_p")[i].alias(f"p{p}") for i, p in enumerate((50, 90, 95, 99))]]
    return out.select(*keys, "n", "mae", "rmse", "bias", *named, *[f"within_{k:g}" for k in within])


def compare_runs(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, a, b, side) of two runs by key."""
    met = a.select(key, F.col(value).alias("a"), F.lit(1).alias("_a")).join(b.select(key, F.col(value).alias("b"), F.lit(1).alias("_b")), key, "full_outer")
    return met.withColumn("side", F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("both")).drop("_a", "_b")


def compare_run_bands(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Error statistics of rows (a, b) for each named flag; a row counts in every band whose flag it meets."""
    names = F.array_compact(F.array(*[F.when(test, name) for name, test in flags.items()]))
    return error_stats(df.withColumn("band", F.explode(names)), "b", "a", ["band"])


def compare_bands(df: DataFrame, bands: list[tuple[str, float, float]], least: int = 20) -> DataFrame:
    """Median and mean difference by distance band and class; bands with fewer than `least` rows are dropped."""
    band = F.lit(None).cast("string")
    for name, lo, hi in bands:
        band = F.when((F.col("distance") >= lo) & (F.col("distance") < hi), name).otherwise(band)
    error = F.col("model") - F.col("reference")
    rows = df.withColumn("band", band).where("band is not null").groupBy("band", "cls").agg(F.count("*").alias("n"), F.percentile(error, 0.5).alias("median"), F.avg(error).alias("mean"), (F.count_if(F.col("model").isNull()) / F.count("*")).alias("blank"))
    return rows.where(F.col("n") >= least)


def facade_error(a: DataFrame, b: DataFrame) -> DataFrame:
    """Error statistics of two layouts' loudest facade per building and period."""
    met = a.select("building_key", "period", F.col("max").alias("a")).join(b.select("building_key", "period", F.col("max").alias("b")), ["building_key", "period"])
    return error_stats(met, "b", "a", ["period"])


def ceiling_level(points: DataFrame, segments: DataFrame, reach: float, floor_m: float = 1.0, key: str = "pk", together: int = 8192) -> DataFrame:
    """(key, level): what all segments (power as linear energy a metre) within reach could give a receiver without any
    attenuation but distance: energy times the angle seen over the distance of the segment's line. Receivers in one
    place are given their level once, powers of segments between the same ends are added up before. Places of a cell,
    dealt into hands of about `together`, meet the segments around it over arrays; levels are written to the shared
    folder."""
    c, size = F.col, max(50.0, reach / 2)
    ends, at = ["ax", "ay", "bx", "by"], ["_ce", "_cn", "_hand"]
    points = points.where(c("x").isNotNull() & c("y").isNotNull())
    places = stored(S.with_cell(points.select("x", "y").distinct(), size), "places")
    hands = stored(places.groupBy("_ce", "_cn").agg(F.ceil(F.count("*") / F.lit(together)).cast("int").alias("_hands")), "hands")
    lines = segments.where(" and ".join(f"{e} is not null" for e in ends) + " and (ax <> bx or ay <> by)").groupBy(*ends).agg(F.coalesce(F.sum("power"), F.lit(0.0)).cast("double").alias("power"))
    near = S.into_cells(lines, F.least("ax", "bx") - reach, F.least("ay", "by") - reach, F.greatest("ax", "bx") + reach, F.greatest("ay", "by") + reach, size)
    near = near.join(hands.hint("merge"), ["_ce", "_cn"]).withColumn("_hand", F.explode(F.sequence(F.lit(0), c("_hands") - 1))).select(*at, *ends, "power")
    placed = places.join(hands.hint("merge"), ["_ce", "_cn"]).withColumn("_hand", F.pmod(F.xxhash64("x", "y"), c("_hands")).cast("int")).select(*at, "x", "y")
    levels = dealt(placed, *at).groupBy(*at).cogroup(dealt(near, *at).groupBy(*at)).applyInArrow(_ceilings(reach, floor_m), "x double, y double, total double")
    levels = stored(levels, "ceilings").select("x", "y", (10.0 * F.log10(c("total") / (2 * math.pi))).alias("level"))
    return points.select(key, "x", "y").join(levels.hint("merge"), ["x", "y"]).select(key, "level")


def _ceilings(reach: float, floor_m: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A function from places and segments around them to (x, y, total): the sum of power times angle over distance of
    the segments in reach, where there are any."""

    def block(x: np.ndarray, y: np.ndarray, lines: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        ax, ay, bx, by, power = lines
        x0, y0 = x[0], y[0]
        dx, dy = bx - ax, by - ay
        long = np.sqrt(dx * dx + dy * dy)
        ux, uy = dx / long, dy / long
        # metres along and beside a segment's line, as sums of three products
        here = np.stack([x - x0, y - y0, np.ones(len(x))], axis=1)
        to_along = np.stack([ux, uy, (x0 - ax) * ux + (y0 - ay) * uy])
        to_beside = np.stack([uy, -ux, (x0 - ax) * uy - (y0 - ay) * ux])
        sums, met = np.zeros(len(x)), np.zeros(len(x), dtype=bool)
        step = max(1, (1 << 14) // len(x))
        for i in range(0, len(long), step):
            own = slice(i, i + step)
            along, h = here @ to_along[:, own], here @ to_beside[:, own]
            rest = long[own] - along
            over = np.maximum(np.maximum(-along, -rest), 0.0)
            far2 = h * h + over * over - reach * reach
            near = far2 <= 0
            # at the limit the distance decides as it is computed elsewhere
            for p, q in zip(*np.nonzero(np.abs(far2) < 1e-3), strict=True):
                near[p, q] = G.far_from_segments(x[p], y[p], ax[i + q], ay[i + q], bx[i + q], by[i + q]) <= reach
            h = np.maximum(np.abs(h), floor_m)
            # the two angles of the perpendicular add up: tan(a + b)
            under = h * h - rest * along
            angle = np.arctan(h * long[own] / under)
            angle[under < 0] += math.pi
            angle *= power[own]
            angle /= h
            angle[~near] = 0.0
            sums += angle.sum(axis=1)
            met |= near.any(axis=1)
        return sums, met

    def look(x: np.ndarray, y: np.ndarray, lines: list[np.ndarray], depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
        x1, x2, y1, y2 = x.min(), x.max(), y.min(), y.max()
        half = math.hypot(x2 - x1, y2 - y1) / 2 + 1e-6
        far = G.far_from_segments((x1 + x2) / 2, (y1 + y2) / 2, *lines[:4])
        lines = [v[far <= reach + half] for v in lines]
        if len(x) <= 64 or half < reach / 32 or depth > 30:
            return block(x, y, lines)
        sums, met = np.zeros(len(x)), np.zeros(len(x), dtype=bool)
        part = (x > (x1 + x2) / 2) * 2 + (y > (y1 + y2) / 2)
        for own in (np.flatnonzero(part == p) for p in range(4)):
            if len(own):
                sums[own], met[own] = look(x[own], y[own], lines, depth + 1)
        return sums, met

    def run(places: pa.Table, lines: pa.Table) -> pa.Table:
        x, y = places["x"].to_numpy(), places["y"].to_numpy()
        sums, met = np.zeros(len(x)), np.zeros(len(x), dtype=bool)
        if len(x) and len(lines):
            with np.errstate(divide="ignore", invalid="ignore"):
                sums, met = look(x, y, [lines[n].to_numpy() for n in ("ax", "ay", "bx", "by", "power")])
        return pa.table({"x": x[met], "y": y[met], "total": sums[met]})

    return run


def ceiling_report(df: DataFrame, margin: float = 6.0) -> DataFrame:
    """Percentiles of level - ceiling, and how many exceed the margin."""
    excess = F.col("excess")
    df = stored(df.select((F.col("level") - F.col("ceiling")).alias("excess")), "excesses")
    sums = df.agg(F.count(excess).alias("n"), F.count_if(excess > margin).alias("flagged"))
    names = [f"p{p}" for p in (50, 90, 99, 100)]
    at = percentiles(df, "excess", [0.5, 0.9, 0.99, 1.0])
    return sums.join(at).select("n", *[F.col("values")[i].alias(n) for i, n in enumerate(names)], "flagged")


def top_excess(df: DataFrame, k: int = 20) -> DataFrame:
    return df.withColumn("excess", F.col("level") - F.col("ceiling")).orderBy(F.desc("excess"), "pk").limit(k)


def lattice_error(fine: DataFrame, coarse: DataFrame, step: float) -> DataFrame:
    """Error statistics of a coarse lattice interpolated at the points of a finer one (pk, x, y, value)."""
    met = S.lattice_interpolate(fine, coarse, step).withColumnRenamed("value", "estimate").join(fine.select("pk", F.col("value").alias("truth")), "pk")
    return error_stats(met, "estimate", "truth")


def match_monitors(sites: DataFrame, results: DataFrame, reach: float, k: int = 3) -> DataFrame:
    """(site_id, model, distance): the median one of the k nearest receivers' levels around each site's ring.

    Sites are (site_id, x, y, uncertainty_m); results (pk, x, y, level).
    """
    ring = S.uncertainty_ring(sites)
    # sites in one place look around the same points
    spots = ring.select("x", "y").distinct().withColumn("_q", F.struct("x", "y"))
    found = S.knn(spots, results.select("pk", F.col("x").alias("sx"), F.col("y").alias("sy")), k, reach, "_q", "pk")
    ranked = found.join(results.select("pk", "level"), "pk").withColumns({"x": F.col("_q.x"), "y": F.col("_q.y")})
    at = ranked.groupBy("x", "y").agg(F.percentile("level", 0.5).alias("level"), F.min("distance").alias("distance"))
    middle = ring.select("site_id", "x", "y").join(at, ["x", "y"])
    return middle.groupBy("site_id").agg(L.energy_mean(F.col("level")).alias("model"), F.min("level").alias("low"), F.max("level").alias("high"), F.min("distance").alias("distance"))


def throughput(runs: DataFrame, now: str, hours: float = 3.0, fallback: float = 24.0, least: int = 3) -> DataFrame:
    """(host, runs, per_second, hours): receivers a second over the last hours, over the longer span where a host has
    fewer than `least` runs. Takes host, ended (timestamp), receivers, seconds."""
    age = (F.unix_seconds(F.to_timestamp(F.lit(now))) - F.unix_seconds(F.col("ended").cast("timestamp"))) / 3600.0
    rows = runs.withColumn("_age", age).where((F.col("_age") >= 0) & (F.col("_age") <= fallback))
    short = F.col("_age") <= hours
    sums = rows.groupBy("host").agg(F.count_if(short).alias("n"), F.count("*").alias("n_all"), F.sum(F.when(short, F.col("receivers"))).alias("r"), F.sum("receivers").alias("r_all"), F.sum(F.when(short, F.col("seconds"))).alias("s"), F.sum("seconds").alias("s_all"))
    few = F.col("n") < least
    pick = lambda x: F.when(few, F.col(f"{x}_all")).otherwise(F.col(x))
    return sums.select("host", pick("n").alias("runs"), (pick("r") / pick("s")).alias("per_second"), F.when(few, fallback).otherwise(hours).alias("hours"))


def estimated_receivers(buildings: Column) -> Column:
    """A cell's receivers from its buildings, by the published fit."""
    return 6507.0 + 2.69 * buildings


def stage_seconds(events: DataFrame) -> DataFrame:
    """(run_id, stage, seconds) from rows (run_id, stage, event, ts): stage_submitted to stage_completed."""
    at = lambda e, f: f(F.when(F.col("event") == e, F.unix_micros(F.col("ts").cast("timestamp"))))
    return events.groupBy("run_id", "stage").agg(((at("stage_completed", F.max) - at("stage_submitted", F.min)) / 1e6).alias("seconds"))


def quality_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(name, value, n) for every value of the named columns, in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in cols]))
    return df.select(pairs.alias("p")).groupBy("p.name", "p.value").agg(F.count("*").alias("n"))


def count_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("n"))


def recent_runs(df: DataFrame, k: int = 8) -> DataFrame:
    return df.orderBy(F.desc("ended"), "run_id").limit(k)


def stride_sample(df: DataFrame, order: str, most: int = 2200) -> DataFrame:
    """Every n-th row in an order, the first included, with the least n that gives at most `most` rows."""
    step = max(1, -(-df.count() // most))
    return numbered(df.orderBy(order), "_place").where(F.col("_place") % step == 0).drop("_place")


def correction_summary(df: DataFrame, col: str) -> DataFrame:
    sums = df.agg(F.count(col).alias("n"), F.min(col).alias("min"), F.max(col).alias("max"))
    return sums.join(percentiles(df, col, [0.5])).select("n", "min", F.col("values")[0].alias("median"), "max")


def visible_tiles(tiles: DataFrame, x1: float, y1: float, x2: float, y2: float) -> DataFrame:
    return tiles.where((F.col("x1") <= x2) & (F.col("x2") >= x1) & (F.col("y1") <= y2) & (F.col("y2") >= y1))


def lod_for_zoom(zoom: Column) -> Column:
    return F.when(zoom < 13, "overview").when(zoom < 15, "neighbourhood").otherwise("exact")


def visible_layers(layers: DataFrame, view: str, period: str, toggles: dict[str, bool], withheld: DataFrame | None = None) -> DataFrame:
    """Layers of a view that are switched on, support the period and are not withheld."""
    on = F.lit(False)
    for name, value in toggles.items():
        on = F.when(F.col("id") == name, F.lit(value)).otherwise(on)
    rows = layers.where(F.array_contains("views", view) & F.array_contains("periods", period) & on)
    return rows if withheld is None else rows.join(withheld, "id", "left_anti")
