"""Connected components of a graph that is given as a DataFrame of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noisegrid.llm._common import checkpoint, join_groups


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Alternate large-star and small-star steps until the edges form stars.

    Takes edges between longs or strings; nulls and loops are ignored. Returns (node, root) for every node but the
    roots, where the root is the smallest node of the component. Every step is a grouped minimum and an equi-join; a
    node with very many neighbours is pre-aggregated before the shuffle and joined by a broadcast of such nodes. Each
    step is checkpointed in the shared folder.
    """
    now = checkpoint(
        edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    mark = _mark(now)
    while mark[0]:
        both = now.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(now.select("hi", "lo"))
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = checkpoint(join_groups(both.where("v > u"), least, "u", "n").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct())
        nearest = checkpoint(large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("n")))
        small = join_groups(large, nearest, "hi", "n").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).where("lo < hi")
        now = checkpoint(small.union(nearest.select(F.col("m").alias("lo"), "hi")).distinct())
        before, mark = mark, _mark(now)
        if mark == before:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    """Edges and a sum of their hashes: equal before and after a round only when nothing changed."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)"))).first()
    return row[0], row[1]
