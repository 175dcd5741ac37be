"""Streams of built-in operators: hourly levels and rolling throughput. Stateful ones are in `stateful`, releases in
`release`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noisegrid.functions import levels as L


def stream_laeq(events: DataFrame, watermark: str = "10 minutes", window: str = "1 hour", keys: tuple[str, ...] = ("site",)) -> DataFrame:
    """Level of SEL events (event_id, site, ts, sel) by site and hour: repeats within the watermark count once."""
    once = events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])
    sums = once.groupBy(F.window("ts", window), *keys).agg(L.energy_sum(F.col("sel")).alias("sum"), F.count("*").alias("n"))
    seconds = F.unix_seconds("window.end") - F.unix_seconds("window.start")
    return sums.select(F.col("window.start").alias("start"), *keys, (F.col("sum") - 10.0 * F.log10(seconds)).alias("laeq"), "n")


def stream_throughput(runs: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Receivers a second per host over three hours, every ten minutes."""
    w = F.window("ended", "3 hours", "10 minutes")
    return runs.withWatermark("ended", watermark).groupBy(w, "host").agg((F.sum("receivers") / F.sum("seconds")).alias("per_second"), F.count("*").alias("runs")).select(F.col("window.end").alias("at"), "host", "per_second", "runs")
