"""Personal data: patterns, and terms that co-occur with what they match so strongly that they disclose it.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noisegrid.llm._common import checkpoint, most_frequent, private, write_table

KINDS = ["email", "ip", "card", "phone", "term"]
#: The patterns of the contract, possessive and anchored to the start of a run so that long runs take linear time:
#: what they match, leftmost and without overlap, is the same.
_L = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_L})|\G){_L}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match that counts.
NEEDS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "phone": lambda t: t.contains("+"),
}
WORD = r"\p{L}{3,}+"
_SPANS = "array<struct<start:int,end:int,value:string>>"


def find_spans(text: Column, pattern: str) -> Column:
    """Matches of pattern as array<struct<start, end, value>>, in code points, end exclusive."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("value"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value")))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(end.isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    return F.aggregate(parts, empty, step, lambda acc: acc["out"])


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.when(F.length(F.ltrim(p, F.lit("0"))) <= 3, F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255).otherwise(F.lit(False)))
    digits = _digits(value)
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    return F.length(digits).between(10, 15) if kind == "phone" else F.lit(True)


def _spans_of(text: Column, k: int, kind: str) -> Column:
    def one(s: Column) -> Column:
        return F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"), s["value"].alias("value"))

    return F.transform(F.filter(find_spans(text, PATTERNS[kind]), lambda s: _passes(kind, s["value"])), one)


def base_spans(text: Column) -> Column:
    """All base spans of a text as array<struct<start, k, end, value>>, by start, then kind."""
    found = [F.when(NEEDS[kind](text), _spans_of(text, k, kind)) for k, kind in enumerate(KINDS[:4])]
    none = F.array().cast("array<struct<start:int,k:int,end:int,value:string>>")
    some = F.coalesce(*[F.when(NEEDS[kind](text), F.lit(True)) for kind in KINDS[:4]])
    return F.when(some, F.sort_array(F.concat(*[F.coalesce(f, none) for f in found]))).otherwise(none)


def masked(text: Column, spans: Column) -> Column:
    """The text with a digit for every code point of a span, so that what remains stays in place."""
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        over = F.repeat(F.lit("0"), F.greatest(s["end"] - F.greatest(s["start"], acc["at"]), F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, over).alias("out"))

    return F.aggregate(spans, first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, row, digest, spans, rest, words): one line per row, in the shared folder.

    digest tells texts apart; rest is the text without its spans, null where there are none; words are the different
    words of three letters or more outside of spans, in small letters.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("t")).select("doc_id", "t", base_spans(F.col("t")).alias("spans"))
    rows = rows.select("doc_id", "t", "spans", F.when(F.size("spans") > 0, masked(F.col("t"), F.col("spans"))).alias("rest"))
    words = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("rest", "t"), F.lit(WORD), F.lit(0)), F.lower))
    return write_table(rows.select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64("t").alias("digest"), "spans", "rest", words.alias("words")), "pii-scan")


def _broadcast(df: DataFrame, most: int) -> DataFrame:
    """df for a broadcast where it has at most `most` rows, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def lower_chance(hits: Column, n: Column, z: float) -> Column:
    """The lower end of Wilson's interval for a chance of which `hits` of `n` cases were seen."""
    n, p = n.cast("double"), hits / n.cast("double")
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def disclosing_terms(scanned: DataFrame, generalise: float = 0.75, remove: float = 0.9, chance: float = 0.5, z: float = 1.645, most_common: int = 100_000, most_broadcast: int = 200_000, most_copies: int = 1_000_000) -> DataFrame:
    """Terms that disclose an entity of their text: (digest, term, removes).

    Each distinct text counts once, as a whole; a copy adds no evidence. With n_t of all N texts that hold the term, n_e
    that hold the entity and n_te that hold both, the chance of the entity given the term is taken as no more than
    the corpus shows: the lower end of Wilson's interval for n_te of n_t (z = 1.645, so right in 95 of 100 cases). The
    term's pointwise mutual information log2(chance N / n_e) is compared with the entity's information content
    log2(N / n_e): a ratio of `generalise` or more generalises the term in the texts that hold the entity, of `remove` or
    more removes it, where the chance is `chance` or more. Entities in all texts have no information to disclose.

    It follows from the interval that a term and an entity that meet in fewer than z^2 chance / (1 - chance) texts,
    here 3, never pass; such entities, and terms too rare or too common, are left out before pairs meet (of the common
    ones up to most_common). Entities that the same texts hold have the same counts and are taken as one, by two hashes
    over their texts.
    """
    first = checkpoint(scanned.groupBy("digest").agg(F.min("row").alias("row")).select("row"))
    total = float(first.count())
    least = z * z * chance / (1 - chance)
    copies = scanned.select("row").join(first, "row", "left_anti")
    kept = scanned.join(_broadcast(checkpoint(copies), most_copies), "row", "left_anti")
    value = lambda s: F.when(s["k"] >= 2, _digits(s["value"])).otherwise(F.lower(s["value"]))
    entities = F.array_distinct(F.transform("spans", lambda s: F.concat(s["k"].cast("string"), F.lit(":"), value(s))))
    texts = checkpoint(kept.where(F.size("spans") > 0).select("digest", entities.alias("entities"), "words"))
    holds = texts.select("digest", F.explode("entities").alias("entity"))
    mark = [F.bit_xor(F.xxhash64("digest", F.lit(i))).alias(f"h{i}") for i in (1, 2)]
    of_entity = checkpoint(holds.groupBy("entity").agg(F.count("*").alias("n_e"), *mark).where(F.col("n_e") >= least))
    group = ["n_e", "h1", "h2"]
    held = checkpoint(holds.join(_broadcast(of_entity, most_broadcast), "entity").select("digest", *group).distinct())
    most = of_entity.agg(F.max("n_e")).first()[0] or 0
    of_term = checkpoint(kept.select(F.explode("words").alias("term")).groupBy("term").agg(F.count("*").alias("n_t")).where(F.col("n_t") >= least))
    common = most_frequent(of_term.where(F.col("n_t") > most / chance), "n_t", most_common)
    words = texts.join(held.select("digest").distinct(), "digest", "left_semi").select("digest", F.explode("words").alias("term"))
    near = checkpoint(held.join(words.join(F.broadcast(common.select("term")), "term", "left_anti"), "digest"))
    information = F.log2(F.lit(total) / F.col("n_e"))
    low = lower_chance(F.col("n_te"), F.col("n_t"), z)
    mutual = F.log2(low * F.lit(total) / F.col("n_e"))
    told = (
        near.groupBy(*group, "term")
        .agg(F.count("*").alias("n_te"))
        .join(of_term, "term")
        .where((information > 0) & (low >= chance) & (mutual >= generalise * information))
        .select(*group, "term", F.when(mutual >= remove * information, 1).otherwise(0).alias("removes"))
    )
    told = _broadcast(checkpoint(told), most_broadcast)
    return near.join(told, [*group, "term"]).groupBy("digest", "term").agg(F.max("removes").alias("removes"))


def _by_text(terms: DataFrame) -> DataFrame:
    """(digest, gone, hidden): the terms to remove and to generalise in each text that has some."""
    pick = lambda n: F.collect_list(F.when(F.col("removes") == n, F.col("term")))
    return checkpoint(terms.groupBy("digest").agg(pick(1).alias("gone"), pick(0).alias("hidden")))


def term_spans(rest: Column, gone: Column, hidden: Column) -> Column:
    """Everywhere the terms stand in a masked text, as array<struct<start, k, end, action>>."""
    parts = F.arrays_zip(F.split(rest, WORD, -1).alias("gap"), F.regexp_extract_all(rest, F.lit(WORD), F.lit(0)).alias("value"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,k:int,end:int,action:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start, term = acc["at"] + F.length(x["gap"]), F.lower(x["value"])
        end = start + F.length(x["value"])
        action = F.when(F.array_contains(gone, term), "remove").when(F.array_contains(hidden, term), "generalise")
        one = F.array(F.struct(start.alias("start"), F.lit(4).alias("k"), end.alias("end"), action.alias("action")))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(action.isNull(), acc["out"]).otherwise(F.concat(acc["out"], one)).alias("out"))

    return F.aggregate(parts, empty, step, lambda acc: acc["out"])


def _joined(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["k"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _few(terms: DataFrame, most: int) -> bool:
    """Whether all texts together have at most `most` terms, of a few dozen bytes each."""
    return (terms.agg(F.sum(F.size("gone") + F.size("hidden"))).first()[0] or 0) <= most


def find(docs: DataFrame, broadcast_terms: int = 500_000) -> DataFrame:
    """Counts of base spans, the hash of their list, and all spans, for every document.

    A null text is empty; texts without personal data have empty lists. Spans of a text depend on the corpus through
    the terms alone.
    """
    scanned = scan(docs)
    terms = _by_text(disclosing_terms(scanned))
    terms = F.broadcast(terms) if _few(terms, broadcast_terms) else terms
    short = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end")))
    rows = scanned.select("doc_id", "digest", "rest", short("spans").alias("base"))
    some = rows.where(F.size("base") > 0).join(terms, "digest", "left")
    every = F.when(F.col("gone").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", short(term_spans(F.col("rest"), F.col("gone"), F.col("hidden"))))))
    rows = some.select("doc_id", "base", every.alias("all")).union(rows.where(F.size("base") == 0).select("doc_id", "base", "base"))
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    return rows.select("doc_id", *[count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """Replace spans (start, k, end, action) by <KIND>, terms to generalise by <TERM>, terms to remove by nothing."""
    marks = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        mark = F.when(s["action"] == "remove", F.lit("")).otherwise(F.get(marks, s["k"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], kept, mark)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, first, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def sanitise(docs: DataFrame, broadcast_terms: int = 500_000) -> DataFrame:
    """The documents with base spans and disclosing terms replaced; n_chars follows where a text changed.

    Texts without base spans pass unchanged. Terms are broadcast only where all texts together have at most
    broadcast_terms of them (a few dozen bytes each), else joined.
    """
    text, own, mine, gone, hidden = F.col("text"), *[private(docs, f"_{name}") for name in ("base", "digest", "gone", "hidden")]
    terms = _by_text(disclosing_terms(scan(docs)))
    few = _few(terms, broadcast_terms)
    terms = terms.select(F.col("digest").alias(mine), F.col("gone").alias(gone), F.col("hidden").alias(hidden))
    base = F.transform(base_spans(text), lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end"), F.lit("mark").alias("action")))
    marked = docs.withColumn(own, F.coalesce(base, F.array().cast("array<struct<start:int,k:int,end:int,action:string>>")))
    joined = marked.where(F.size(own) > 0).join(F.broadcast(terms) if few else terms, F.xxhash64(text) == F.col(mine), "left")
    more = term_spans(masked(text, F.col(own)), F.col(gone), F.col(hidden))
    spans = F.when(F.col(gone).isNull(), F.col(own)).otherwise(F.sort_array(F.concat(own, more)))
    changed = joined.withColumn("text", redact(text, spans))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns).union(marked.where(F.size(own) == 0).select(*docs.columns))
