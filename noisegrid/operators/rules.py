"""Data-quality rules: each returns the rows that break it; strict() raises instead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


class RuleError(ValueError):
    """Rows broke a rule."""


def strict(violations: DataFrame, name: str) -> None:
    """Raise with up to five of the violations; the rest stay where they are."""
    rows = violations.limit(5).collect()
    if rows:
        raise RuleError(f"{name}: {rows}")


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def assert_complete(levels: DataFrame, periods: list[str], keys: list[str]) -> DataFrame:
    """Keys that lack a period, with the ones they lack."""
    have = levels.groupBy(*keys).agg(F.collect_set("period").alias("have"))
    return have.select(*keys, F.array_except(F.array(*[F.lit(p) for p in periods]), "have").alias("missing")).where(F.size("missing") > 0)


def assert_same_point(df: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    return df.where((F.abs(F.col("x") - F.col("other_x")) > tolerance) | (F.abs(F.col("y") - F.col("other_y")) > tolerance))


def assert_same_geometry(df: DataFrame) -> DataFrame:
    """Keys whose rings differ."""
    return df.groupBy("building_key").agg(F.count_distinct(F.xxhash64("ring")).alias("shapes")).where("shapes > 1")


def assert_count(df: DataFrame, expected: int) -> DataFrame:
    return df.agg(F.count("*").alias("n")).where(F.col("n") != expected)


def inventory_diff(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, problem): missing or unexpected."""
    met = expected.select(key, F.lit(1).alias("_e")).distinct().join(actual.select(key, F.lit(1).alias("_a")).distinct(), key, "full_outer")
    return met.where("_e is null or _a is null").select(key, F.when(F.col("_a").isNull(), "missing").otherwise("unexpected").alias("problem"))


def verify_hashes(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(path, problem) of files (path, length, content) against a manifest (path, size, sha256)."""
    have = files.select("path", F.col("length").alias("_n"), F.sha2("content", 256).alias("_sha"))
    met = manifest.join(have, "path", "full_outer")
    problem = F.when(F.col("_sha").isNull(), "missing").when(F.col("sha256").isNull(), "unexpected").when(F.col("_n") != F.col("size"), "size").when(F.col("_sha") != F.lower("sha256"), "hash")
    return met.select("path", problem.alias("problem")).where("problem is not null")


def broken(df: DataFrame, rules: dict[str, Column], keys: list[str]) -> DataFrame:
    """(keys, rule): a row for every rule that is not true."""
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(test, F.lit(False)), name) for name, test in rules.items()]))
    return df.select(*keys, F.explode(failed).alias("rule"))


def validate_registry(df: DataFrame, families: list[str], evidence: list[str], most_bytes: int = 512 << 20) -> DataFrame:
    """Layers (id, label, family, asset, source_hash, source_bytes, evidence_class, periods) against the contract."""
    rules = {
        "id": F.col("id").rlike("^[a-z0-9][a-z0-9-]*$"),
        "label": F.length(F.trim("label")) > 0,
        "family": F.col("family").isin(*families),
        "evidence": F.col("evidence_class").isin(*evidence),
        "hash": F.col("source_hash").rlike("^[0-9a-f]{64}$"),
        "path": F.col("asset").rlike(r"^[A-Za-z0-9_][A-Za-z0-9_./-]*$") & ~F.col("asset").rlike(r"(^|/)\.\.?(/|$)|//"),
        "size": F.col("source_bytes").between(1, most_bytes),
        "periods": (F.size("periods") > 0) & F.forall("periods", lambda p: p.isin("D", "E", "N", "Q")),
    }
    return broken(df, rules, ["id"]).unionByName(assert_unique(df, ["id"]).select("id", F.lit("unique").alias("rule")))


def validate_events(df: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """(event_id, rule) of timed events (event_id, site, start_ts, duration_s, laeq_db, metric, weighting): valid
    fields, inside the period, unique ids, no overlap with the event before at the site."""
    finish = F.unix_micros("start_ts") / 1e6 + F.col("duration_s")
    level = F.col("laeq_db")
    rules = {"metric": F.col("metric") == "LAeq", "weighting": F.col("weighting") == "A", "duration": F.col("duration_s") > 0, "level": ~F.isnan(level) & (F.abs(level) < float("inf"))}
    if start is not None:
        rules["before_start"] = F.col("start_ts") >= start
    if end is not None:
        rules["after_end"] = finish <= F.unix_micros(end) / 1e6
    ahead = F.max(finish).over(W.partitionBy("site").orderBy("start_ts", "event_id").rowsBetween(W.unboundedPreceding, -1))
    rows = df.withColumn("_ahead", ahead)
    rules["overlap"] = F.coalesce(F.col("_ahead") <= F.unix_micros("start_ts") / 1e6, F.lit(True))
    return broken(rows, rules, ["event_id"]).unionByName(assert_unique(df, ["event_id"]).select("event_id", F.lit("unique").alias("rule")))


def validate_npd(npd: DataFrame) -> DataFrame:
    """(npd_id, rule) of tables (npd_id, power, distance_m, level_db): rectangular, increasing, positive, finite."""
    shape = npd.groupBy("npd_id").agg(F.count("*").alias("n"), F.count_distinct("power").alias("p"), F.count_distinct("distance_m").alias("d"), F.count_distinct("power", "distance_m").alias("pd"), F.min("distance_m").alias("least"), F.count_if(F.col("level_db").isNull() | F.isnan("level_db") | (F.abs("level_db") == float("inf"))).alias("bad"))
    rules = {"rectangular": F.col("n") == F.col("p") * F.col("d"), "distinct": F.col("n") == F.col("pd"), "two_distances": F.col("d") >= 2, "two_powers": F.col("p") >= 2, "positive": F.col("least") > 0, "finite": F.col("bad") == 0}
    return broken(shape, rules, ["npd_id"])


def validate_tracks(df: DataFrame) -> DataFrame:
    """(track_id, rule): times increase, and no point stands on a receiver nearer than 1 cm where hit_m says so."""
    w = W.partitionBy("track_id").orderBy("seq")
    rows = df.withColumn("_step", F.col("time_s") - F.lag("time_s").over(w))
    return broken(rows.groupBy("track_id").agg(F.min("_step").alias("step"), F.count("*").alias("n"), F.min("hit_m").alias("hit")), {"increasing": F.coalesce(F.col("step") > 0, F.lit(True)), "two_points": F.col("n") >= 2, "clear": F.coalesce(F.col("hit") > 0.01, F.lit(True))}, ["track_id"])


def validate_spectrum(df: DataFrame) -> DataFrame:
    """(spectrum_id, rule) of arrays band_hz and level_db: paired, sorted, positive."""
    rules = {"paired": F.size("band_hz") == F.size("level_db"), "sorted": F.col("band_hz") == F.array_sort(F.array_distinct("band_hz")), "positive": F.forall("band_hz", lambda x: x > 0), "some": F.size("band_hz") > 0}
    return broken(df, rules, ["spectrum_id"])


def validate_losses(df: DataFrame, losses: list[str]) -> DataFrame:
    """(spectrum_id, rule): every array of losses has a value of at least 0 for each band, and the reference angle lies
    within half a turn."""
    rules = {
        "losses_paired": F.forall(F.array(*[F.size(c) for c in losses]), lambda n: n == F.size("band_hz")),
        "losses_positive": F.forall(F.flatten(F.array(*losses)), lambda x: x >= 0),
        "reference": F.col("reference_deg").between(0, 180),
    }
    return broken(df, rules, ["spectrum_id"])


def validate_directivity(df: DataFrame) -> DataFrame:
    """(spectrum_id, rule) of knots (array of angle, gain): they start at angle and gain 0 and increase within half a
    turn."""
    angles = F.transform("knots", lambda k: k["angle"])
    first = F.get("knots", F.lit(0))
    rules = {
        "starts_at_zero": (first["angle"] == 0) & (F.abs(first["gain"]) <= 1e-9),
        "increasing": (angles == F.array_sort(F.array_distinct(angles))) & (F.element_at(angles, -1) <= 180),
    }
    return broken(df, rules, ["spectrum_id"])


def fill_terrain(a: DataFrame, b: DataFrame, most_empty: float = 0.01) -> DataFrame:
    """Cells (row, col, z) of a, gaps from b; raises if more than most_empty of all stay empty."""
    met = a.withColumnRenamed("z", "_a").join(b.withColumnRenamed("z", "_b"), ["row", "col"], "full_outer").select("row", "col", F.coalesce("_a", "_b").alias("z"))
    empty = met.agg(F.avg(F.col("z").isNull().cast("double"))).first()[0] or 0.0
    if empty > most_empty:
        raise RuleError(f"{empty:.1%} of the terrain is empty")
    return met


def qualified_events(events: DataFrame, primary: str = "adsb_icao") -> DataFrame:
    """Events whose witnesses (array of structs with source) all come from the primary source."""
    return events.where(F.forall("witnesses", lambda w: w["source"] == primary))


def reported_rows(df: DataFrame, variables: list[str]) -> DataFrame:
    return df.where(F.coalesce(*[F.nullif(F.col(v), F.lit("")) for v in variables]).isNotNull())


def qa_points(df: DataFrame, families: list[str], floor: float = 45.0) -> DataFrame:
    """Receivers for comparison: not masked, of a family, with class levels, loud enough."""
    return df.where(~F.col("masked") & F.col("family").isin(*families) & (F.size("by_class") > 0) & (F.col("level") >= floor))
