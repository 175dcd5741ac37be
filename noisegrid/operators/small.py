"""Broadcast hints behind a check of rows and bytes, and parts that stay apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hinted(df: DataFrame, most: int = 100_000, most_bytes: int = 64 << 20) -> DataFrame:
    """df with a broadcast hint if it has at most `most` rows and, as text, most_bytes; unchanged, for Spark to choose,
    if it has more."""
    size = df.limit(most + 1).agg(F.count("*"), F.sum(F.length(F.to_json(F.struct("*"))))).first()
    return F.broadcast(df) if size[0] <= most and (size[1] or 0) <= most_bytes else df


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df by keys in as many parts as Spark shuffles into. They aren't merged however few bytes they have, for rows whose
    work is large for their size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
