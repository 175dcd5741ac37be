"""Mix sources to target weights by weighted fair queueing, with DataFrame operations only."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noisegrid.llm._common import checkpoint, n_words

MOST_EPOCHS = 3


def source_targets(sizes: DataFrame, weights: Column | None = None, share: float = 1.0, epochs: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> (source, source_size, weight, target).

    Targets share `share` of all sizes by weight. None is above `epochs` times its source's size: the excess goes to
    the others by weight, round by round, until none is above. Without `weights`, sources in code point order, null
    last, weigh 1, 2, 3, repeating. A row for each source, few beside the documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    weights = weights if weights is not None else ((F.row_number().over(order) - 1) % 3 + 1).cast("double")
    rows = checkpoint(sizes.select("source", "source_size", weights.alias("weight")))
    most = F.lit(float(epochs)) * F.col("source_size")
    budget = share * float(rows.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        capped = F.lit(level) * F.col("weight") > most
        full, free = rows.agg(F.sum(F.when(capped, most).otherwise(0.0)), F.sum(F.when(~capped, F.col("weight")).otherwise(0.0))).first()
        if not free or (budget - full) / free <= level:
            break
        level = (budget - full) / free
    return rows.select("source", "source_size", "weight", F.least(F.lit(level) * F.col("weight"), most).alias("target"))


def mix(docs: DataFrame, size: Column | None = None, epochs: int = MOST_EPOCHS, seed: int = 0) -> DataFrame:
    """Weighted fair queueing of all documents: (doc_id, source, size, source_size, target, weight, position, taken).

    Documents of a source queue in an order shuffled by a hash of their id and text. A copy of a document finishes at the
    source's tokens up to its end, divided by the source's target; copies of all sources are range-sorted by that time
    and cut where the total budget is used up. `taken` is the document's size times the copies before the cut, so 0,
    1, 2 or 3 (epochs) times; `position` is the first copy's finish time.

    A null text has size 0 and is never taken; rows that repeat an id queue one by one; an empty table gives no rows.
    Queue positions come from sums over hash ranges of a source, about as many as each range of the largest source
    has documents, and a window in each range: no task holds a whole source.
    """
    mark = F.xxhash64(F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text") if c in docs.columns])
    rows = docs.select("doc_id", "source", (n_words(F.col("text")) if size is None else size).alias("size"), mark.alias("order"))
    rows = checkpoint(rows)
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    targets = source_targets(by_source, epochs=epochs).select(F.col("source").alias("t_source"), "source_size", "weight", "target")
    largest = by_source.agg(F.max("n")).first()[0] or 0
    buckets = max(1, isqrt(largest))
    rows = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("order", 33), F.lit(1 << 31)) * F.lit(buckets) / F.lit(float(1 << 31)))
    rows = rows.withColumn("bucket", F.floor("bucket"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        sums.withColumn("start", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)))
        .join(targets, F.col("source").eqNullSafe(F.col("t_source")))
        .select(F.col("source").alias("s_source"), F.col("bucket").alias("s_bucket"), "start", "source_size", "weight", "target")
    )
    inside = W.partitionBy("s_source", "s_bucket").orderBy("order", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    queued = (
        rows.join(starts, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("bucket") == F.col("s_bucket")))
        .withColumn("end", F.col("start") + F.sum("size").over(inside))
        .select("doc_id", "source", "size", "source_size", "target", "weight", "end")
    )
    queued = checkpoint(queued)
    finish = (F.col("end") + F.col("epoch") * F.col("source_size")) / F.col("target")
    copies = queued.where("size > 0 and target > 0").select("source_size", "target", "end", "size", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")).select("size", finish.alias("finish"))
    last = cutoff(copies, float(queued.agg(F.sum("size")).first()[0] or 0))
    taken = sum(((F.col("end") + k * F.col("source_size")) / F.col("target") <= last).cast("long") for k in range(epochs))
    taken = F.when((F.col("size") > 0) & (F.col("target") > 0), F.col("size") * taken).otherwise(F.lit(0)).cast("long")
    return queued.select("doc_id", "source", "size", "source_size", "target", "weight", F.when(F.col("target") > 0, F.col("end") / F.col("target")).alias("position"), taken.alias("taken"))


def cutoff(copies: DataFrame, budget: float, most: int = 1_000_000) -> float:
    """The largest finish time up to which the copies (size, finish) fit the budget; -1 if none does.

    The copies are range-sorted; each partition's total is added up on the driver (a number for each partition). The
    partition in which the budget runs out is range-sorted again while it has more than `most` rows, so that the rows
    which one task adds up one by one stay few at every size. Copies with equal times fit or fail together.
    """
    used, last, left = 0.0, -1.0, copies
    while True:
        ranged = checkpoint(left.repartitionByRange("finish").sortWithinPartitions("finish").withColumn("part", F.spark_partition_id()))
        parts = sorted(ranged.groupBy("part").agg(F.sum("size"), F.min("finish"), F.max("finish"), F.count("*")).collect())
        for part, size, first, end, n in parts:
            if used + size > budget:
                break
            used, last = used + size, end
        else:
            return last
        if first == end:
            return last
        left = ranged.where(F.col("part") == part).select("size", "finish", "part")
        if n <= most or len(parts) == 1:
            running = F.sum("size").over(W.partitionBy("part").orderBy("finish").rangeBetween(W.unboundedPreceding, 0))
            inner = left.withColumn("used", running + used).where(F.col("used") <= budget).agg(F.max("finish")).first()[0]
            return last if inner is None else inner
        left = left.drop("part")
