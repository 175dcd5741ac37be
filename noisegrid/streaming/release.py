"""Releases by tile: batches of new runs are built and checked aside, and readers see them only once a pointer moves.

A release folder has `data` by batch, `manifests` by version (which batch a tile's rows are in) and `pointer`, one small
file for each version that readers may use. A version's data and manifest are complete before its pointer is written,
which is a single file's rename; what breaks off before it changes nothing for readers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

RUN = ["tile_id", "rank", "ended"]


def newest_version(spark: SparkSession, target: str) -> int | None:
    """The version that readers use; None before the first."""
    try:
        return spark.read.schema("version long").json(f"{target}/pointer").agg(F.max("version")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_manifest(spark: SparkSession, target: str, version: int | None = None) -> DataFrame | None:
    """(tile_id, rank, ended, batch) of a version, by default of the newest."""
    version = newest_version(spark, target) if version is None else version
    return None if version is None else spark.read.parquet(f"{target}/manifests/version={version}")


def read_release(spark: SparkSession, target: str) -> DataFrame:
    """The rows of each tile's newest published run. Batches that no tile is read from are pruned by the join."""
    manifest = read_manifest(spark, target)
    if manifest is None:
        raise ValueError(f"{target} has no release yet")
    return spark.read.parquet(f"{target}/data").join(manifest.select("tile_id", "batch"), ["tile_id", "batch"]).drop("batch")


def winning_runs(runs: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """(tile_id, rank, ended): the best run of each tile in a batch, by rank, then time, if it beats the published one.
    A run that is published already doesn't beat itself."""
    best = runs.groupBy("tile_id").agg(F.max(F.struct("rank", "ended")).alias("b")).select("tile_id", "b.*")
    if manifest is None:
        return best
    old = manifest.select("tile_id", F.struct("rank", "ended").alias("_old"))
    return best.join(old, "tile_id", "left").where(F.col("_old").isNull() | (F.struct("rank", "ended") > F.col("_old"))).drop("_old")


def stage(batch: DataFrame, number: int, target: str, build: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], DataFrame]) -> None:
    """Write the data and the manifest of a version beside what readers see. `build` gives the layers of runs, with
    their tile_id; `check` the rows that break a rule: any keep the batch from being published."""
    spark = batch.sparkSession
    manifest = read_manifest(spark, target)
    runs = batch.join(winning_runs(batch, manifest), RUN, "left_semi").persist()
    try:
        layers = build(runs)
        broken = check(layers).limit(3).collect()
        if broken:
            raise ValueError(f"batch {number} is not published: {broken}")
        layers.repartition("tile_id").write.mode("overwrite").parquet(f"{target}/data/batch={number}")
        now = runs.select(*RUN).distinct().withColumn("batch", F.lit(number).cast("long"))
        kept = now if manifest is None else manifest.join(now, "tile_id", "left_anti").unionByName(now)
        kept.write.mode("overwrite").parquet(f"{target}/manifests/version={number}")
    finally:
        runs.unpersist()


def switch(spark: SparkSession, number: int, target: str) -> None:
    """Let readers see a staged version."""
    spark.range(1).select(F.lit(number).cast("long").alias("version")).coalesce(1).write.mode("append").json(f"{target}/pointer")


def publish(batch: DataFrame, number: int, target: str, build: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], DataFrame]) -> None:
    """Publish a batch of runs (tile_id, rank, ended, ...), unless its number has been published already."""
    at = newest_version(batch.sparkSession, target)
    if at is None or number > at:
        stage(batch, number, target, build, check)
        switch(batch.sparkSession, number, target)


def stream_release(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], check: Callable[[DataFrame], DataFrame], files_a_batch: int = 1000) -> StreamingQuery:
    """Publish the runs in files that are new, batch by batch, then stop.

    A tile's newest run wins, by rank, then time; a run that comes late and is older changes nothing. A batch that fails
    leaves readers what they had and is tried again by the next start; one that was published before the stream could
    note it isn't published again.
    """
    runs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    return runs.writeStream.foreachBatch(lambda batch, number: publish(batch, number, target, build, check)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unused_batches(spark: SparkSession, target: str) -> DataFrame:
    """(batch): data folders that no tile of the newest version is read from."""
    stored = spark.read.parquet(f"{target}/data").select("batch").distinct()
    return stored.join(read_manifest(spark, target).select("batch").distinct(), "batch", "left_anti")
