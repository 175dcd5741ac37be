"""Quality rules: a learned decision list over text statistics, with DataFrame operations only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noisegrid.llm._common import BLANKS, held_out, words, write_table

SYMBOLS = "#*$%&|<>"


def text_stats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id and counts of the whole text; a null text has no words and all counts are 0.

    n_repeat_words compares 3-word windows by a 64-bit hash within one text. Everything happens within the row, in
    time n log n of its words.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    rows = docs.select("doc_id", text.alias("t")).select("doc_id", "t", words(F.col("t")).alias("w"), lines.alias("lines"))
    grams = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2))))
    rows = rows.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("t", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.length("t") - F.length(F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
        (F.length("t") - F.length(F.translate("t", "!?", ""))).cast("long").alias("n_bangs"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.coalesce(grams, F.array().cast("array<bigint>")).alias("grams"),
    )
    again = F.size(F.array_distinct("grams")) < F.size("grams")
    ordered = F.when(again, F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))
    rows = rows.withColumn("ordered", ordered).drop("grams")
    n = F.size("ordered")
    equal = F.filter(F.zip_with(F.slice("ordered", F.lit(1), n - 1), F.slice("ordered", F.lit(2), n - 1), lambda a, b: F.when(a.g == b.g, F.array(a.i, b.i))), lambda x: x.isNotNull())
    covered = F.size(F.array_distinct(F.flatten(F.transform(F.flatten(equal), lambda i: F.array(i, i + 1, i + 2)))))
    return rows.withColumn("n_repeat_words", F.when(F.col("ordered").isNotNull(), covered).otherwise(F.lit(0)).cast("long")).drop("ordered")


#: What rules may test; each is defined for every count, 0 where the text has no words.
def features() -> dict[str, Column]:
    per = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": per("word_chars", "n_words"),
        "symbols_a_word": per("n_symbols", "n_words"),
        "dup_lines": per("n_dup_lines", "n_lines"),
        "repeats": per("n_repeat_words", "n_words"),
        "upper": per("n_upper", "word_chars"),
        "bangs_a_word": per("n_bangs", "n_words"),
        "distinct": per("n_distinct", "n_words"),
    }


@dataclass(frozen=True)
class Test:
    feature: str
    at_least: bool
    threshold: float

    def column(self, values: dict[str, Column]) -> Column:
        return values[self.feature] >= self.threshold if self.at_least else values[self.feature] < self.threshold


def _tests(rule: list[Test], values: dict[str, Column]) -> Column:
    out = F.lit(True)
    for t in rule:
        out = out & t.column(values)
    return out


def learn(labelled: DataFrame, most_rules: int = 8, most_tests: int = 3, quantiles: int = 32, least_precision: float = 0.8, least_rows: int = 3) -> list[list[Test]]:
    """Sequential covering of the rows with label 0 in (doc_id, label, counts as text_stats() gives them).

    Two thirds of the rows grow a rule: the test with the best information gain is added until no row with label 1 is
    left in it; the rest prune it to the prefix with the best (p - n) / (p + n). A rule stays if its precision on all
    uncovered rows is least_precision and it covers least_rows rows; the rows it covers are removed. Each step is one
    grouped count whose result is bounded by features x quantiles. No labels give no rules.
    """
    names = list(features())
    values = {n: F.col(n) for n in names}
    rows = labelled.where("label is not null").select("label", (F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2).alias("grows"), *[c.alias(n) for n, c in features().items()])
    cuts: dict[str, list[float]] = {n: [] for n in names}
    steps = [(i + 1) / quantiles for i in range(quantiles)]
    for r in rows.groupBy("label").agg(*[F.percentile_approx(n, steps, 1000).alias(n) for n in names]).collect():
        for n in names:
            cuts[n] += r[n] or []
    cuts = {n: sorted(set(c)) for n, c in cuts.items()}
    if not cuts["words"]:
        return []
    rows = rows.select("*", F.array(*[_place(n, cuts[n]) for n in names]).alias("place"))
    rows = write_table(rows, "quality-labelled")
    rules: list[list[Test]] = []
    covered = F.lit(False)
    for _ in range(most_rules):
        left = rows.where(~covered)
        rule: list[Test] = []
        while len(rule) < most_tests and (best := _best_test(left.where("grows").where(_tests(rule, values)), names, cuts)):
            rule.append(best)
        if not rule:
            break
        ways = [_tests(rule[: k + 1], values) for k in range(len(rule))]
        sums = left.agg(*[F.count_if(w & (F.col("label") == y) & (where if fold else F.lit(True))) for w in ways for fold in (True, False) for where in (~F.col("grows"),) for y in (0, 1)]).first()
        scored = []
        for k in range(len(rule)):
            p, n, all_p, all_n = sums[4 * k : 4 * k + 4]
            scored.append(((p - n) / (p + n) if p + n else -1.0, -k, all_p, all_n))
        _, k, p, n = max(scored)
        if p + n < least_rows or p < least_precision * (p + n):
            break
        rules.append(rule[: 1 - k])
        covered = covered | ways[-k]
    return rules


def _place(name: str, cuts: list[float]) -> Column:
    """How many of the cuts are at most the value."""
    return F.size(F.filter(F.array(*[F.lit(float(x)) for x in cuts]), lambda x: x <= F.col(name)))


def _best_test(rows: DataFrame, names: list[str], cuts: dict[str, list[float]]) -> Test | None:
    """The test with the best FOIL gain; None if the rows are pure or nothing gains."""
    counts: dict[tuple[int, int], dict[int, int]] = {}
    for f, place, y, n in rows.select("label", F.posexplode("place").alias("f", "place")).groupBy("f", "place", "label").count().collect():
        counts.setdefault((f, y), {})[place] = n
    pos, neg = (sum(counts.get((0, y), {}).values()) for y in (0, 1))
    if not pos or not neg:
        return None
    now, best, found = math.log2(pos / (pos + neg)), 1e-9, None
    for f, name in enumerate(names):
        p = n = 0
        for i, cut in enumerate(cuts[name]):
            p += counts.get((f, 0), {}).get(i, 0)
            n += counts.get((f, 1), {}).get(i, 0)
            for at_least, a, b in ((True, pos - p, neg - n), (False, p, n)):
                gain = a * (math.log2(a / (a + b)) - now) if a else 0.0
                if gain > best:
                    best, found = gain, Test(name, at_least, cut)
    return found


def verdict(rules: list[list[Test]]) -> Column:
    """The ordered list as one conditional expression over text_stats() columns: false where a rule rejects."""
    out, values = None, features()
    for rule in rules:
        test = _tests(rule, values)
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, base_failed and kept for every document, by rules learned from labels.quality.

    Labels teach only where crc32(doc_id) mod 4 is not 2. A document with several labels counts once for each. Empty
    tables give no rows; without labels the base rules alone decide.
    """
    stats = write_table(text_stats(docs.select("doc_id", "text")), "quality-stats")
    known = labels.where(F.col("quality").isin(0, 1)).select(F.col("doc_id").alias("l_id"), F.col("quality").alias("label"))
    rules = learn(stats.where(~held_out(F.col("doc_id"), 4)).join(known, F.col("doc_id") == F.col("l_id")).drop("l_id"))
    kept = ~base_failed() & verdict(rules)
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), kept.alias("kept"))
