"""Writers: every output is a table written by its tasks; small summaries stand beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_features(df: DataFrame, path: str, x: str = "x", y: str = "y") -> None:
    """NDJSON point features; the other columns are properties."""
    rest = [c for c in df.columns if c not in (x, y)]
    geometry = F.struct(F.lit("Point").alias("type"), F.array(x, y).alias("coordinates"))
    df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*rest).alias("properties"))).alias("value")).write.mode("overwrite").text(path)


def write_tile_documents(df: DataFrame, path: str, metadata: DataFrame | None = None) -> None:
    """A folder per tile, several files in that of a large tile; metadata is a table of its own."""
    df.hint("rebalance", "tile_id").write.mode("overwrite").partitionBy("tile_id").json(f"{path}/tiles")
    if metadata is not None:
        metadata.write.mode("overwrite").json(f"{path}/metadata")


def write_cells(df: DataFrame, path: str) -> None:
    """A folder per cell, several files in that of a large cell; rows carry `cells`, and are repeated in each."""
    rows = df.withColumn("c", F.explode("cells")).select("*", "c.cell_e", "c.cell_n").drop("c", "cells")
    rows.hint("rebalance", "cell_e", "cell_n").write.mode("overwrite").partitionBy("cell_e", "cell_n").parquet(path)


def write_pyramid(df: DataFrame, path: str) -> None:
    """Tiles (z, x, y, ...) in order of place, so that a viewport reads few files."""
    df.repartitionByRange("z", "x", "y").sortWithinPartitions("z", "x", "y").write.mode("overwrite").partitionBy("z").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_paths(df: DataFrame, path: str, most_bytes: int = 2_000_000_000) -> None:
    """Paths (path_id, start, points) without identities; refuses more than most_bytes."""
    hidden = {"ident", "icao"} & set(df.columns)
    if hidden:
        raise ValueError(f"identities must not leave: {sorted(hidden)}")
    size = df.agg(F.sum(F.length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{size} bytes are more than {most_bytes}")
    df.write.mode("overwrite").json(path)


def receipt(**dfs: DataFrame) -> DataFrame:
    """One row per named table: its rows and an order-free hash of them."""
    out = None
    for name, df in dfs.items():
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(20,0)")).alias("sum")).select(F.lit(name).alias("name"), "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), F.col("sum").cast("string")), 256).alias("sha256"))
        out = row if out is None else out.unionByName(row)
    return out


def write_receipt(path: str, **dfs: DataFrame) -> None:
    receipt(**dfs).coalesce(1).write.mode("overwrite").json(path)


def coverage_features(polygons: DataFrame) -> DataFrame:
    """Polygons (polygon, area, coordinates) as GeoJSON features, one a row."""
    geometry = F.struct(F.lit("Polygon").alias("type"), "coordinates")
    return polygons.select(F.lit("Feature").alias("type"), F.struct("polygon", "area").alias("properties"), geometry.alias("geometry"))


def write_layer_index(path: str, coverage: DataFrame, percentiles: DataFrame, counts: DataFrame) -> None:
    """Coverage polygons as features, percentile tables and counts beside the layers."""
    for name, df in (("coverage", coverage_features(coverage)), ("percentiles", percentiles), ("counts", counts)):
        df.write.mode("overwrite").json(f"{path}/{name}")


def write_rail_results(df: DataFrame, path: str) -> None:
    """Rail levels pivoted to d, e, n, by tile."""
    wide = df.groupBy("tile_id", "receiver_key").agg(*[F.max(F.when(F.col("period") == p, F.col("laeq"))).alias(f"rail_{p.lower()}") for p in "DEN"])
    wide.hint("rebalance", "tile_id").write.mode("overwrite").partitionBy("tile_id").parquet(path)


def write_ascii_grid(df: DataFrame, path: str, corner_x: float, corner_y: float, size: float, n_cols: int, n_rows: int) -> None:
    """An ESRI ASCII grid of cells (row from the bottom, col, z): the header, then a line per row from the top.

    A line is built by its row's task; one task puts the lines in order, for the format is one ordered file.
    """
    cells = df.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("col", "z"))).alias("m"))
    rows = df.sparkSession.range(n_rows).select(F.col("id").cast("int").alias("row")).join(cells, "row", "left")
    values = F.transform(F.sequence(F.lit(0), F.lit(n_cols - 1)), lambda c: F.coalesce(F.when(F.col("m").isNotNull(), F.col("m")[c]), F.lit(-9999.0)).cast("string"))
    head = f"ncols {n_cols}\nnrows {n_rows}\nxllcorner {corner_x}\nyllcorner {corner_y}\ncellsize {size}\nNODATA_value -9999"
    first = df.sparkSession.range(1).select(F.lit(1 << 30).alias("row"), F.lit(head).alias("value"))
    first.union(rows.select("row", F.array_join(values, " "))).orderBy(F.desc("row")).select("value").coalesce(1).write.mode("overwrite").text(path)
