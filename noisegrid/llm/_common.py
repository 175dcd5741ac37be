"""What several operators of this package share: word rules, hashing, and tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noisegrid.shared import new_path, shared_dir

#: Words are runs of anything but ASCII white space.
WORD_GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def words(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))


def n_words(text: Column) -> Column:
    """How many words a text has; 0 for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, WORD_GAP))).cast("long")


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, hot: int = 256, most: int = 20_000) -> DataFrame:
    """rows joined with groups, which holds one row for each key and in `size` the number of the key's rows.

    Keys of more than `hot` rows are joined by a broadcast while they are at most `most`, so that no task gets all rows
    of a large group; the others, or all where there are more, meet in a shuffle.
    """
    large = groups.where(F.col(size) > hot)
    if not 0 < large.limit(most + 1).count() <= most:
        return rows.join(groups, key)
    small = rows.join(F.broadcast(large.select(key)), key, "left_anti").join(groups.where(F.col(size) <= hot), key)
    return rows.join(F.broadcast(large), key).unionByName(small)


def crc_rest(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo divisor; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def held_out(doc_id: Column, divisor: int) -> Column:
    """True where crc32(doc_id as text) mod divisor is 2; false for a null id."""
    return F.coalesce(crc_rest(doc_id, divisor) == 2, F.lit(False))


def private(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    while name in df.columns:
        name = f"_{name}"
    return name


def most_frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the highest counts, at most `most`: those from a level on that keeps all rows of a level together.

    Levels are 32nds of a doubling, so the driver sees at most 2,048 numbers, and no task ranks the table.
    """
    level = F.floor(F.log2(count) * 32)
    left, cut = most, None
    for at, n in sorted(df.groupBy(level.alias("at")).agg(F.count("*").alias("n")).collect(), reverse=True):
        left -= n
        if left < 0:
            break
        cut = at
    return df.where(level >= cut) if cut is not None else df.where(F.lit(False))
