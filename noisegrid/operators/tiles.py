"""Tile assembly: levels to receivers, classes to periods, receivers to buildings, tiles to layers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noisegrid.functions import geometry as G
from noisegrid.functions import levels as L
from noisegrid.operators import spatial as S
from noisegrid.operators.nearest import stored
from noisegrid.operators.quantiles import percentiles

PERIODS = ["D", "E", "N"]


def join_levels(receivers: DataFrame, levels: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Levels with their receiver; rows whose points differ by more than the tolerance are left out (see
    rules.assert_same_point)."""
    other = levels.withColumnsRenamed({"x": "_x", "y": "_y"})
    met = receivers.join(other, ["tile_id", "pk"])
    return met.where((F.abs(F.col("x") - F.col("_x")) <= tolerance) & (F.abs(F.col("y") - F.col("_y")) <= tolerance)).drop("_x", "_y")


def link_buildings(receivers: DataFrame, buildings: DataFrame) -> DataFrame:
    """Facade receivers with their building and `error`: no_building, or other_source where the source ids differ."""
    b = buildings.select("tile_id", "building_pk", "building_key", F.col("source_bld_id").alias("_sid"))
    met = receivers.where(F.col("building_pk").isNotNull()).join(b, ["tile_id", "building_pk"], "left")
    return met.withColumn("error", F.when(F.col("building_key").isNull(), "no_building").when(~F.col("source_bld_id").eqNullSafe(F.col("_sid")), "other_source")).drop("_sid")


def add_rail(result: DataFrame, rail: DataFrame, runs: DataFrame) -> DataFrame:
    """Add train levels d, e, n (rail: tile_id, key, rail_d, rail_e, rail_n) where the tile's rail run is complete and
    of the same run or the same count of receivers (runs: tile_id, complete, run_id, road_run_id, count, road_count)."""
    usable = runs.where(F.col("complete") & ((F.col("run_id") == F.col("road_run_id")) | (F.col("count") == F.col("road_count")))).select("tile_id")
    met = result.join(rail.join(usable, "tile_id", "left_semi"), ["tile_id", "key"], "left")
    return met.withColumns({p: L.energy_add(F.col(p), F.col(f"rail_{p}")) for p in "den"}).drop("rail_d", "rail_e", "rail_n")


def pivot_periods(levels: DataFrame, keys: list[str], value: str = "laeq") -> DataFrame:
    """One row per key with d, e, n; further periods in a map."""
    cols = [F.max(F.when(F.col("period") == p, F.col(value))).alias(p.lower()) for p in PERIODS]
    others = F.collect_list(F.when(~F.col("period").isin(*PERIODS), F.struct("period", value)))
    return levels.groupBy(*keys).agg(*cols, F.map_from_entries(F.array_distinct(others)).alias("by_class"))


def rollup_classes(levels: DataFrame, keys: list[str]) -> DataFrame:
    """Class periods (DF, DA, ...) summed to D, E, N; a class that is missing counts nothing."""
    return levels.groupBy(*keys, F.substring("period", 1, 1).alias("period")).agg(L.energy_sum(F.col("laeq")).alias("laeq"), F.count("laeq").alias("classes"))


def building_summary(result: DataFrame, keys: list[str], value: str = "level") -> DataFrame:
    """(keys, period) -> lowest and highest level, receivers, and receivers without a level."""
    return result.groupBy(*keys, "period").agg(F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("receiver_count"), F.count_if(F.col(value).isNull()).alias("unavailable_count"))


def period_map(summary: DataFrame, keys: list[str]) -> DataFrame:
    """A map from period to its summary."""
    entry = F.struct("period", F.struct("min", "max", "receiver_count", "unavailable_count").alias("s"))
    return summary.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("periods"))


def merge_buildings(parts: DataFrame) -> DataFrame:
    """One row per building and period over the tiles that released it: extremes, added counts, tiles in order."""
    return parts.groupBy("building_key", "period").agg(F.min("min").alias("min"), F.max("max").alias("max"), F.sum("receiver_count").alias("receiver_count"), F.sum("unavailable_count").alias("unavailable_count"), F.sort_array(F.collect_set("tile_id")).alias("tile_ids"))


def merge_tiles(receivers: DataFrame, buildings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merge by stable key: distinct receivers with their tiles, building statistics over all receivers, and the keys
    whose footprints differ between tiles."""
    merged = receivers.groupBy("receiver_key").agg(F.sort_array(F.collect_set("tile_id")).alias("tile_ids"), F.first("building_key", ignorenulls=True).alias("building_key"), *[F.max(p).alias(p) for p in "den"])
    long = merged.where("building_key is not null").select("building_key", F.explode(F.array(*[F.struct(F.lit(p).alias("period"), F.col(p.lower()).alias("level")) for p in PERIODS])).alias("s")).select("building_key", "s.*")
    conflicts = buildings.groupBy("building_key").agg(F.count_distinct(F.xxhash64("ring")).alias("shapes")).where("shapes > 1")
    return merged, building_summary(long, ["building_key"]), conflicts


def facade_extremes(result: DataFrame) -> DataFrame:
    """Loudest (max_) and quietest (min_) facade of each building."""
    return result.groupBy("building_key").agg(*[f(p).alias(f"{n}_{p}") for p in "den" for n, f in (("max", F.max), ("min", F.min))])


def building_percentiles(buildings: DataFrame, cols: list[str]) -> DataFrame:
    """The 101 percentiles of each column over all buildings."""
    out = None
    for c in cols:
        one = percentiles(buildings, c, [i / 100 for i in range(101)]).withColumnRenamed("values", c)
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def percentile_rank(value: Column, table: Column) -> Column:
    """The first of 101 percentiles that reaches a value: louder than so many percent; 100 beyond all."""
    return F.when(value.isNotNull(), F.least(F.size(F.filter(table, lambda p: p < value)), F.lit(100)))


def envelope(df: DataFrame) -> DataFrame:
    return df.agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max("x").alias("x2"), F.max("y").alias("y2"))


def tile_summary(result: DataFrame, level: Column) -> DataFrame:
    """Rows, masks, labels and level range of each tile."""
    return result.groupBy("tile_id").agg(F.count("*").alias("receiver_count"), F.count_if("masked").alias("masked_count"), F.count_if("on_road").alias("on_road_count"), F.min(level).alias("min_level"), F.max(level).alias("max_level"))


def apply_flags(result: DataFrame, excess: DataFrame, road: DataFrame, margin: float = 6.0, road_m: float = 3.0) -> DataFrame:
    """Mask receivers over the physical ceiling (pk, excess): they lose their levels. Label those within road_m of a
    road (pk, distance): they keep them."""
    met = result.join(excess.select("pk", "excess"), "pk", "left").join(road.select("pk", F.col("distance").alias("_d")), "pk", "left")
    met = met.withColumns({"masked": F.coalesce(F.col("excess") > margin, F.lit(False)), "on_road": F.coalesce(F.col("_d") <= road_m, F.lit(False))})
    return met.withColumns({p: F.when(~F.col("masked"), F.col(p)) for p in "den"}).drop("_d", "excess")


def shared_buildings(buildings: DataFrame) -> DataFrame:
    """Buildings that more than one tile releases, with all their tiles and whether their footprints agree."""
    return buildings.groupBy("building_key").agg(F.sort_array(F.collect_set("tile_id")).alias("tile_ids"), (F.count_distinct(F.xxhash64("ring")) == 1).alias("same")).where(F.size("tile_ids") > 1)


def resolve_selection(requests: DataFrame, receivers: DataFrame, buildings: DataFrame) -> DataFrame:
    """(request_id, building_key): a receiver's own building, else the requested one if it exists."""
    own = receivers.select(F.col("receiver_key"), F.col("building_key").alias("_own"))
    known = buildings.select(F.col("building_key").alias("_known")).distinct()
    met = requests.join(own, "receiver_key", "left").join(known, F.col("building_key") == F.col("_known"), "left")
    return met.select("request_id", F.coalesce("_own", "_known").alias("building_key"))


def latest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order (newest run, later root, best source)."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest completed run of each tile, better models first."""
    return latest(runs.where("completed"), ["tile_id"], F.desc("model_rank"), F.desc("ended_at"), F.desc("run_id"))


def collect_tiles(*roots: DataFrame) -> DataFrame:
    """All tiles of several roots; later roots win."""
    out = None
    for i, df in enumerate(roots):
        df = df.withColumn("_root", F.lit(i))
        out = df if out is None else out.unionByName(df)
    return latest(out, ["tile_id"], F.desc("_root")).drop("_root")


def assign_ids(df: DataFrame, keys: list[str], *order: Column, name: str = "id") -> DataFrame:
    """Numbers from 1 within each key."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))


def target_cells(density: DataFrame, least: int = 25, only: DataFrame | None = None) -> DataFrame:
    rows = density.where(F.col("buildings") >= least)
    return rows if only is None else rows.join(only, ["cell_e", "cell_n"], "left_semi")


def ready_cells(cells: DataFrame, blocks: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of which every required block (keys, block_id) is done."""
    missing = blocks.join(done.select("block_id"), "block_id", "left_anti").select(*keys).distinct()
    return cells.join(missing, keys, "left_anti")


def todo_cells(cells: DataFrame, *done: DataFrame, keys: list[str]) -> DataFrame:
    for d in done:
        cells = cells.join(d.select(*keys), keys, "left_anti")
    return cells


def work_order(cells: DataFrame, done: DataFrame, keys: list[str], x: float, y: float) -> DataFrame:
    """Cells never computed first, then nearest first."""
    met = cells.join(done.select(*keys).distinct().withColumn("_d", F.lit(True)), keys, "left")
    return met.withColumn("_m", F.pow(F.col("x") - x, 2) + F.pow(F.col("y") - y, 2)).orderBy(F.col("_d").isNotNull(), "_m", *keys).drop("_d", "_m")


def ordered(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in the order in which files are written: by receiver, building or path key, whatever order they came in."""
    return df.orderBy(*keys)


def numbered(rows: DataFrame, name: str = "place") -> DataFrame:
    """Sorted rows with their places from 0.

    Places are the row's number in its partition after the counts of the partitions before it, so that no task sees all
    rows; the rows are kept for the second look.
    """
    rows = rows.withColumn("_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_id", 33)).persist()
    before, starts = 0, []
    for part, n in sorted(rows.groupBy("_part").count().collect()):
        starts.append((part, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts, "_part long, _start long")
    return rows.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + F.col("_id") - F.shiftleft("_part", 33)).drop("_id", "_part", "_start")


def changed_files(new: DataFrame, old: DataFrame) -> DataFrame:
    """Files (path, sha) that the published index lacks or has with another hash."""
    return new.join(old.select("path", F.col("sha").alias("_old")), "path", "left").where(~F.col("sha").eqNullSafe(F.col("_old"))).drop("_old")


def key_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(side, n): keys in both, only in a, only in b."""
    sides = a.select(key).distinct().withColumn("_a", F.lit(1)).join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "full_outer")
    return sides.groupBy(F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("both").alias("side")).agg(F.count("*").alias("n"))


def point_overlap(a: DataFrame, b: DataFrame, digits: int = 7) -> DataFrame:
    rounded = lambda d: d.select(F.round("lon", digits).alias("lon"), F.round("lat", digits).alias("lat"))
    return rounded(a).intersect(rounded(b))


def stale_tiles(tiles: DataFrame, results: DataFrame) -> DataFrame:
    """Tiles without a result for their inputs and configuration (tile_id, signature)."""
    return tiles.join(results.select("tile_id", "signature"), ["tile_id", "signature"], "left_anti")


def lattice_receivers(tiles: DataFrame, spacing: float = 20.0, size: float = 1000.0, height: float = 1.5) -> DataFrame:
    """Open-ground receivers at the middles of a lattice in each tile, footprints or not; see open_receivers."""
    steps = F.sequence(F.lit(0), F.lit(int(size / spacing) - 1))
    rows = tiles.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    rows = rows.withColumns({"x": F.col("cell_e") * size + (F.col("_i") + 0.5) * spacing, "y": F.col("cell_n") * size + (F.col("_j") + 0.5) * spacing, "height_agl_m": F.lit(height)})
    return rows.withColumn("receiver_key", F.format_string("grid%d:%d:%d", F.lit(int(spacing)), F.floor("x"), F.floor("y"))).drop("_i", "_j")


def open_receivers(tiles: DataFrame, roads: DataFrame, buildings: DataFrame, spacing: float = 20.0, dense: float = 10.0, near_m: float = 100.0, clear_m: float = 2.0, size: float = 1000.0) -> DataFrame:
    """The lattice of each tile and, within near_m of a road, a denser one too; without points in a footprint or within
    clear_m of its wall."""
    fine = lattice_receivers(tiles, dense, size)
    near = S.nearest_segment(fine.select("receiver_key", "x", "y"), roads, near_m, "receiver_key").select("receiver_key")
    both = lattice_receivers(tiles, spacing, size).withColumn("spacing_m", F.lit(spacing)).unionByName(fine.join(near, "receiver_key", "left_semi").withColumn("spacing_m", F.lit(dense)))
    return both.join(beside_walls(both, buildings, clear_m), "receiver_key", "left_anti")


def beside_walls(points: DataFrame, buildings: DataFrame, clear_m: float) -> DataFrame:
    """(receiver_key) of points in a footprint (ring) or within clear_m of its wall. Points of one place, footprints of one
    ring and walls between the same ends are met once."""
    taken = taken_places(points.select("x", "y").distinct(), buildings, clear_m)
    return points.select("receiver_key", "x", "y").join(taken, ["x", "y"], "left_semi").select("receiver_key")


def taken_places(places: DataFrame, buildings: DataFrame, clear_m: float) -> DataFrame:
    """Places (x, y) in a footprint (ring) or within clear_m of its wall; the first wall found ends a place's search."""
    rings = buildings.select("ring").distinct()
    ends = [F.col(f"e.{p}.{a}").alias(f"{p}{a}") for p in "ab" for a in "xy"]
    walls = rings.select(F.explode(G.edges(F.col("ring"))).alias("e")).select(*ends).distinct()
    close = S.beside_segments(places, walls, clear_m)
    return close.union(S.points_in_polygons(places, rings).select("x", "y")).distinct()


def facade_receivers(buildings: DataFrame, spacing: float = 10.0, out_m: float = 2.0, least: int = 4, height: float = 4.0, clear_m: float = 1.0) -> DataFrame:
    """Points along each footprint, at least four and at most `spacing` apart, out_m outside the wall; those in another
    footprint or within clear_m of a wall are left out. Footprints of one ring have their points once, in the shared
    folder."""
    points = stored(facade_points(buildings.select("ring").distinct(), spacing, out_m, least), "facades")
    taken = taken_places(points.select("x", "y").distinct(), buildings, clear_m)
    free = points.join(taken.hint("merge"), ["x", "y"], "left_anti")
    key = F.format_string("facade:%s:%d", F.col("bld_id").cast("string"), F.col("_k"))
    return buildings.select("bld_id", "ring").join(free.hint("merge"), "ring").select("bld_id", key.alias("receiver_key"), "x", "y", F.lit(height).alias("height_agl_m"))


def facade_points(rings: DataFrame, spacing: float, out_m: float, least: int) -> DataFrame:
    """(ring, _k, x, y): the points of facade_receivers, free or not."""
    c, es = F.col, G.edges(F.col("ring"))
    long = lambda e: F.sqrt(F.pow(e["b"]["x"] - e["a"]["x"], 2) + F.pow(e["b"]["y"] - e["a"]["y"], 2))
    rows = rings.withColumn("_s", G.ring_stats(c("ring"))).withColumn("_n", F.greatest(F.ceil(c("_s.perimeter") / spacing), F.lit(least)).cast("int"))
    signed = F.aggregate(es, F.lit(0.0), lambda acc, e: acc + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    rows = rows.withColumns({"_turn": F.signum(signed), "_es": es, "_k": F.explode(F.sequence(F.lit(0), c("_n") - 1))})
    rows = rows.withColumn("_at", (c("_k") + 0.5) * c("_s.perimeter") / c("_n"))
    start = F.struct(F.lit(0.0).alias("at"), F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"))

    def step(acc: Column, e: Column) -> Column:
        part = (c("_at") - acc["at"]) / long(e)
        here = acc["x"].isNull() & (long(e) > 0) & (part >= 0) & (part <= 1)
        x = e["a"]["x"] + part * (e["b"]["x"] - e["a"]["x"]) + c("_turn") * out_m * (e["b"]["y"] - e["a"]["y"]) / long(e)
        y = e["a"]["y"] + part * (e["b"]["y"] - e["a"]["y"]) - c("_turn") * out_m * (e["b"]["x"] - e["a"]["x"]) / long(e)
        return F.struct((acc["at"] + long(e)).alias("at"), F.when(here, x).otherwise(acc["x"]).alias("x"), F.when(here, y).otherwise(acc["y"]).alias("y"))

    rows = rows.withColumn("_p", F.aggregate("_es", start, step))
    return rows.select("ring", "_k", c("_p.x").alias("x"), c("_p.y").alias("y"))
