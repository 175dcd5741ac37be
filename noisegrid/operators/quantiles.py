"""Exact percentiles without bringing all values of a group to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def percentiles(df: DataFrame, col: str, points: list[float], keys: list[str] | None = None, width: float = 0.01) -> DataFrame:
    """(keys, values): the percentiles `points` (0 to 1, linear between ranks) of a column in each group, as an array.

    Equal values are counted before they meet. Values fall in bins `width` wide; sums over bins tell which bins hold
    the wanted ranks, and only the values of those bins are ranked, each bin by itself. Nulls are left out; a group
    without values has no row.
    """
    keys = keys or []
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("_v")).agg(F.count("*").alias("_n")).withColumn("_bin", F.floor(F.col("_v") / width))
    order = W.partitionBy(*keys).orderBy("_bin")
    bins = counts.groupBy(*keys, "_bin").agg(F.sum("_n").alias("_n")).withColumns({"_end": F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, 0)), "_total": F.sum("_n").over(W.partitionBy(*keys))})
    at = [p * (F.col("_total") - 1) for p in points]
    asked = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), (F.floor(x) if side == 0 else F.ceil(x)).cast("long").alias("rank"), (x - F.floor(x)).alias("part")) for i, x in enumerate(at) for side in (0, 1)])
    inside = F.filter(asked, lambda a: (a["rank"] >= F.col("_end") - F.col("_n")) & (a["rank"] < F.col("_end")))
    wanted = bins.select(*keys, "_bin", (F.col("_end") - F.col("_n")).alias("_start"), F.explode(inside).alias("a")).select(*keys, "_bin", "a.i", "a.side", "a.part", (F.col("a.rank") - F.col("_start")).alias("_offset"))
    ranked = W.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    some = counts.join(wanted.select(*keys, "_bin").distinct(), [*keys, "_bin"], "left_semi").withColumn("_upto", F.sum("_n").over(ranked))
    met = wanted.join(some, [*keys, "_bin"]).where((F.col("_offset") < F.col("_upto")) & (F.col("_offset") >= F.col("_upto") - F.col("_n")))
    side = lambda k: F.max(F.when(F.col("side") == k, F.col("_v")))
    each = met.groupBy(*keys, "i").agg(side(0).alias("_lo"), side(1).alias("_hi"), F.first("part").alias("part"))
    each = each.select(*keys, "i", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("part")).alias("v"))
    return each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("values"))
