"""Stored surfaces and their pyramids, kept up to date: only what a change reaches is computed and written again.

A surface is stored by cell, a pyramid by zoom and tile. Every stored cell holds, beside its values, one mark: a row
without a place that carries the signature of what the cell was computed from. A refresh compares signatures, spreads
the changed cells to the tiles over them and to those tiles' ancestors, and overwrites these partitions alone; the files
of all others stay as they are. A cell's values and mark are replaced together, so a refresh that breaks off is taken up
by the next one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noisegrid.functions import geometry as G
from noisegrid.operators import field
from noisegrid.operators import spatial as S
from noisegrid.shared import new_path

CELL = ["cell_e", "cell_n"]
SURFACE = "row int, col int, value double, signature string, cell_e int, cell_n int"
PIXELS = "py int, px int, value double, z int, x int, y int"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What is stored at a path; nothing if there is no such path yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_surface(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, value, cell_e, cell_n) of a stored surface."""
    return _stored(spark, path, SURFACE).where("row is not null").drop("signature")


def read_pyramid(spark: SparkSession, path: str) -> DataFrame:
    """(z, x, y, py, px, value) of a stored pyramid."""
    return _stored(spark, path, PIXELS).where("py is not null").select("z", "x", "y", "py", "px", "value")


def _kept(df: DataFrame, name: str) -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _overwrite(df: DataFrame, path: str, by: list[str]) -> None:
    """Replace the partitions that df has rows of, a file each, and no others."""
    df.repartition(*by).write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def dirty_cells(now: DataFrame, stored: DataFrame) -> DataFrame:
    """(cell_e, cell_n, signature) of cells that are new, changed or gone; gone ones have an empty signature."""
    old = stored.select(*CELL, F.col("signature").alias("_old"))
    both = now.select(*CELL, "signature").join(old, CELL, "full_outer")
    both = both.select(*CELL, F.coalesce("signature", F.lit("")).alias("signature"), "_old")
    return both.where(~F.col("signature").eqNullSafe(F.col("_old"))).drop("_old")


def refresh_surface(points: DataFrame, path: str, surface: Callable[[DataFrame], DataFrame], size: float, step: float, version: str, cols: list[str]) -> DataFrame:
    """Bring a stored surface up to date with points (x, y, ...), and return the cells that were written.

    `surface` gives (row, col, value) of points on a grid of `step` metres, each value from points at most one cell of
    `size` metres away. A cell is computed again when `cols` of its own or its neighbours' points, or `version`, have
    changed; only the points in and around such cells are read. The returned table stays in the shared folder.
    """
    spark = points.sparkSession
    cells = points.withColumns({"cell_e": F.floor(F.col("x") / size).cast("int"), "cell_n": F.floor(F.col("y") / size).cast("int")})
    marks = _stored(spark, path, SURFACE).where("signature is not null").select(*CELL, "signature")
    dirty = _kept(dirty_cells(field.cell_signature(cells, version, cols), marks), "dirty-cells")
    if dirty.isEmpty():
        return dirty
    around = S.with_neighbours(dirty.select(*CELL)).select(F.col("home_e").alias("cell_e"), F.col("home_n").alias("cell_n")).distinct()
    values = surface(cells.join(around, CELL, "left_semi").drop(*CELL))
    of = lambda c: F.floor(F.col(c) * step / size).cast("int")
    values = values.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "value", of("col").alias("cell_e"), of("row").alias("cell_n"))
    values = values.join(dirty.select(*CELL), CELL, "left_semi").withColumn("signature", F.lit(None).cast("string"))
    _overwrite(values.unionByName(dirty, allowMissingColumns=True).select("row", "col", "value", "signature", *CELL), path, CELL)
    return dirty


@dataclass
class Tiling:
    """How cells of a surface and tiles of a pyramid's highest zoom meet: tiles (x, y) over cells, cells under tiles, and
    the pixels (x, y, py, px, value) of tiles from the surface under them."""

    zoom: int
    tiles: Callable[[DataFrame], DataFrame]
    cells: Callable[[DataFrame], DataFrame]
    pixels: Callable[[DataFrame, DataFrame], DataFrame]


def _ranges(df: DataFrame, names: tuple[str, str], a: tuple[Column, Column], b: tuple[Column, Column]) -> DataFrame:
    """The whole numbers between two corners, as two columns."""
    first, second = (F.sequence(lo.cast("int"), hi.cast("int")) for lo, hi in zip(a, b, strict=True))
    return df.select(F.explode(first).alias(names[0]), second.alias("_s")).select(names[0], F.explode("_s").alias(names[1])).distinct()


def metre_tiling(zoom: int, size: float, step: float, tile: int = 256) -> Tiling:
    """Tiles of `tile` surface values a side, a pixel each."""
    span = tile * step

    def tiles(cells: DataFrame) -> DataFrame:
        e, n = F.col("cell_e") * size, F.col("cell_n") * size
        return _ranges(cells, ("x", "y"), (F.floor(e / span), F.floor(n / span)), (F.ceil((e + size) / span) - 1, F.ceil((n + size) / span) - 1))

    def cells(tiles: DataFrame) -> DataFrame:
        e, n = F.col("x") * span, F.col("y") * span
        return _ranges(tiles, ("cell_e", "cell_n"), (F.floor(e / size), F.floor(n / size)), (F.ceil((e + span) / size) - 1, F.ceil((n + span) / size) - 1))

    def pixels(tiles: DataFrame, grid: DataFrame) -> DataFrame:
        at = lambda c: F.floor(F.col(c) / tile).cast("int")
        rows = grid.select(at("col").alias("x"), at("row").alias("y"), F.pmod("row", F.lit(tile)).alias("py"), F.pmod("col", F.lit(tile)).alias("px"), "value")
        return rows.join(tiles, ["x", "y"], "left_semi")

    return Tiling(zoom, tiles, cells, pixels)


def web_tiling(zoom: int, size: float, step: float, tile: int = 256) -> Tiling:
    """Web-mercator tiles, resampled from the surface. Corners are met with two steps to spare, as pixels read the four
    values around them and cells aren't square on the map."""
    spare = 2 * step

    def box(df: DataFrame, lo: tuple[Column, Column], hi: tuple[Column, Column], turn: Callable[[Column, Column], Column]) -> DataFrame:
        """The least and greatest coordinates of a box's corners, turned."""
        corners = F.array(*[F.struct(u.alias("u"), v.alias("v")) for u in (lo[0], hi[0]) for v in (lo[1], hi[1])])
        met = df.select(F.transform(corners, lambda p: turn(p["u"], p["v"])).alias("m"))
        return met.select(*[f(f"m.{o}").alias(f"{n}_{o}") for n, f in (("lo", F.array_min), ("hi", F.array_max)) for o in ("x", "y")])

    def tiles(cells: DataFrame) -> DataFrame:
        def turn(u: Column, v: Column) -> Column:
            at = G.utm_to_lonlat(u, v)
            w = G.world_px(at["lon"], at["lat"], zoom, tile)
            return F.struct((w["x"] / tile).alias("x"), (w["y"] / tile).alias("y"))

        e, n = F.col("cell_e") * size, F.col("cell_n") * size
        met = box(cells, (e - spare, n - spare), (e + size + spare, n + size + spare), turn)
        return _ranges(met, ("x", "y"), (F.floor("lo_x"), F.floor("lo_y")), (F.floor("hi_x"), F.floor("hi_y")))

    def cells(tiles: DataFrame) -> DataFrame:
        def turn(px: Column, py: Column) -> Column:
            at = G.tile_pixel_lonlat(zoom, F.col("x"), F.col("y"), px, py, tile)
            return G.lonlat_to_utm(at["lon"], at["lat"])

        met = box(tiles, (F.lit(-1), F.lit(-1)), (F.lit(tile), F.lit(tile)), turn)
        low, high = (lambda c: F.floor((F.col(c) - spare) / size)), (lambda c: F.floor((F.col(c) + spare) / size))
        return _ranges(met, ("cell_e", "cell_n"), (low("lo_x"), low("lo_y")), (high("hi_x"), high("hi_y")))

    def pixels(tiles: DataFrame, grid: DataFrame) -> DataFrame:
        return field.resample_tiles(tiles, grid, zoom, step, tile).drop("z")

    return Tiling(zoom, tiles, cells, pixels)


def refresh_pyramid(dirty: DataFrame, surface_path: str, path: str, tiling: Tiling, lowest: int, tile: int = 256) -> DataFrame:
    """Bring a stored pyramid up to date after `dirty` cells of its surface were written; return (z, x, y) of the tiles
    that were.

    The tiles over the cells are computed from the surface under them, each lower zoom's from the stored tiles one zoom
    above; the tiles of a zoom are written before the next is read.
    """
    spark = dirty.sparkSession
    tiles = _kept(tiling.tiles(dirty).distinct(), "dirty-tiles")
    under = read_surface(spark, surface_path).join(tiling.cells(tiles).distinct(), CELL, "left_semi")
    pixels, written = tiling.pixels(tiles, under.select("row", "col", "value")).withColumn("z", F.lit(tiling.zoom)), None
    for z in range(tiling.zoom, lowest - 1, -1):
        if z < tiling.zoom:
            children = tiles
            tiles = _kept(children.select(F.floor(F.col("x") / 2).cast("int").alias("x"), F.floor(F.col("y") / 2).cast("int").alias("y")).distinct(), "dirty-tiles")
            quarter = F.explode(F.array(*[F.struct((F.col("x") * 2 + i).alias("x"), (F.col("y") * 2 + j).alias("y")) for i in (0, 1) for j in (0, 1)]))
            above = read_pyramid(spark, path).where(F.col("z") == z + 1).join(tiles.select(quarter.alias("q")).select("q.*"), ["x", "y"], "left_semi")
            pixels = field.halve(above, tile)
        marks = tiles.select(F.lit(None).cast("int").alias("py"), F.lit(None).cast("int").alias("px"), F.lit(None).cast("double").alias("value"), F.lit(z).alias("z"), "x", "y")
        _overwrite(pixels.select(F.col("py").cast("int").alias("py"), F.col("px").cast("int").alias("px"), "value", "z", "x", "y").unionByName(marks), path, ["z", "x", "y"])
        now = tiles.select(F.lit(z).alias("z"), "x", "y")
        written = now if written is None else written.unionByName(now)
    return written
