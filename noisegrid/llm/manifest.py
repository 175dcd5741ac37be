"""Merkle manifest of a data set: every document's place in its source's tree comes from rank queries on bitmaps.

Ids of a source are merged into bitmaps of 512 ids with the count of bits before each word (the popcount directory).
Sums of these counts over ranges of ids give each bitmap its base, so that a document finds its place by one look-up and
no source is sorted. Blocks of 27 places hold their nodes by slot and reduce three levels at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from noisegrid.llm._common import write_table

#: Nodes that hash into one, and how many levels a block reduces.
RUN, LEVELS = 3, 3
BLOCK = RUN**LEVELS
#: A bitmap covers 2**CHUNK_BITS ids in words of 64; a window adds up at most 2**DIGIT_BITS bitmaps or ranges of them.
CHUNK_BITS, DIGIT_BITS = 9, 14
WORDS = (1 << CHUNK_BITS) // 64
LEAST_LONG = -(1 << 63)
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def encoded(value: Column) -> Column:
    """`-` for null, else the UTF-8 length, a colon and the value: fields can be told apart when joined."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(**changed: Column) -> Column:
    """The hash of a document's fields, some of them changed."""
    return sha256(F.concat(*[encoded(changed.get(c, F.col(c))) for c in FIELDS]))


# Places by rank


def bitmaps(rows: DataFrame, value: str) -> DataFrame:
    """(group, chunk, n, w0..w7): for each group the bitmaps of its values, merged in tasks before the shuffle."""
    v = F.col(value)
    word = F.shiftright(v, 6).bitwiseAND(F.lit(WORDS - 1))
    bit = F.expr(f"shiftleft(1L, cast({value} & 63 as int))")
    merged = [F.bit_or(F.when(word == k, bit).otherwise(F.lit(0))).alias(f"w{k}") for k in range(WORDS)]
    return rows.groupBy("group", F.shiftright(v, CHUNK_BITS).alias("chunk")).agg(F.count("*").alias("n"), *merged)


def offsets(counts: DataFrame, bits: int) -> DataFrame:
    """(group, at, n) -> (group, at, base, of): n summed over smaller `at` of the group, and over all.

    `at` has at most `bits` bits. Ranges of it are summed first and their bases found the same way, so that no window
    holds more than 2**DIGIT_BITS rows however many a group has.
    """
    if bits <= DIGIT_BITS:
        ahead = W.partitionBy("group").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
        return counts.select("group", "at", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"), F.sum("n").over(W.partitionBy("group")).alias("of"))
    high = F.shiftright("at", DIGIT_BITS)
    above = offsets(counts.groupBy("group", high.alias("at")).agg(F.sum("n").alias("n")), bits - DIGIT_BITS)
    ahead = W.partitionBy("group", "high").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    inside = counts.withColumn("high", high).withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    return inside.join(above.withColumnRenamed("at", "high"), ["group", "high"]).select("group", "at", (F.col("before") + F.col("base")).alias("base"), "of")


def ranked(rows: DataFrame, value: str) -> tuple[DataFrame, bool]:
    """rows with (place, of, same): how many rows of the group have a smaller value, how many it has at all, and how
    many have this value. The second result says whether a value repeats.

    Values are longs without null. Rows of a group that repeats one value meet its bitmap in a join that AQE splits.
    """
    words = write_table(bitmaps(rows, value), "manifest-bitmaps")
    least, most = words.agg(F.min("chunk"), F.max("chunk")).first()
    bits = (most - least).bit_length() if most is not None else 0
    ones = [F.bit_count(f"w{k}").cast("long") for k in range(WORDS)]
    before = [sum(ones[:k], F.lit(0).cast("long")).alias(f"b{k}") for k in range(WORDS)]
    bases = offsets(words.select("group", (F.col("chunk") - F.lit(least or 0)).alias("at"), "n"), bits)
    bases = bases.select("group", (F.col("at") + F.lit(least or 0)).alias("chunk"), "base", "of")
    directory = words.join(bases, ["group", "chunk"])
    repeating = words.where(F.col("n") > sum(ones))
    repeats = not repeating.isEmpty()
    v, at = F.col(value), F.shiftright(F.col(value), CHUNK_BITS)
    more = same = F.lit(0)
    if repeats:
        counted = rows.withColumn("chunk", at).join(repeating.select("group", "chunk"), ["group", "chunk"], "left_semi").groupBy("group", "chunk", value).agg((F.count("*") - 1).alias("more")).where("more > 0")
        listed = counted.groupBy("group", "chunk").agg(F.collect_list(F.struct(F.col(value).alias("v"), "more")).alias("repeated"))
        directory = directory.join(listed, ["group", "chunk"], "left")
        total = lambda keep: F.aggregate(F.filter(F.coalesce("repeated", F.array()), keep), F.lit(0).cast("long"), lambda acc, r: acc + r["more"])
        more, same = total(lambda r: r["v"] < v), total(lambda r: r["v"] == v)
    word = F.shiftright(v, 6).bitwiseAND(F.lit(WORDS - 1)).cast("int")
    low = F.expr(f"~shiftleft(-1L, cast({value} & 63 as int))")
    pick = lambda c: F.array(*[F.col(f"{c}{k}") for k in range(WORDS)])[word]
    directory = directory.select("*", *before)
    joined = rows.withColumn("chunk", at).join(directory, ["group", "chunk"])
    place = F.col("base") + pick("b") + F.bit_count(pick("w").bitwiseAND(low)) + more
    return joined.select(*rows.columns, place.cast("long").alias("place"), "of", (same + 1).cast("long").alias("same")), repeats


def placed(rows: DataFrame) -> DataFrame:
    """(key, id, leaf, ...) with (i, total): the place in the key's tree, by id with null first, and its leaves.

    Rows that repeat an id are ranked again by the first 60 bits of their leaf, and those that are still equal by a row
    number; rows that are equal in all fields can't be told apart in the result.
    """
    head = F.conv(F.substring("leaf", 1, 15), 16, 10).cast("long")
    rows = rows.withColumns({"group": F.col("key"), "i": F.lit(0).cast("long"), "total": F.lit(None).cast("long")})
    values = {"rank_id": F.coalesce(F.col("id"), F.lit(LEAST_LONG)), "rank_leaf": head - F.when(F.col("id").isNull(), F.lit(1 << 60)).otherwise(0), "rank_row": F.monotonically_increasing_id()}
    done = []
    for name, value in values.items():
        found, repeats = ranked(rows.withColumn(name, value), name)
        found = found.withColumns({"i": F.col("i") + F.col("place"), "total": F.coalesce("total", "of")}).drop("place", "of")
        if not repeats:
            done.append(found)
            break
        found = write_table(found, "manifest-repeats")
        done.append(found.where("same = 1"))
        rows = found.where("same > 1").withColumn("group", F.concat("group", F.lit("|"), F.col(name).cast("string"))).drop("same", name)
    keep = [c for c in rows.columns if c not in ("group", "same", *values)]
    out = done[0].select(*keep)
    for more in done[1:]:
        out = out.unionByName(more.select(*keep))
    return out


def numbered(rows: DataFrame, order: Column) -> tuple[DataFrame, int]:
    """rows with i, their number in an order, and how many there are. Rows are range-sorted; the driver sees a count for
    each partition."""
    mark = F.monotonically_increasing_id()
    rows = write_table(rows.orderBy(order).withColumn("mark", mark), "manifest-order")
    part = F.shiftright("mark", 33)
    sizes = dict(rows.groupBy(part.alias("part")).count().collect())
    starts, ahead = [], 0
    for k in range(max(sizes, default=0) + 1):
        starts.append(ahead)
        ahead += sizes.get(k, 0)
    start = F.array(*[F.lit(s).cast("long") for s in starts])[part.cast("int")]
    return rows.withColumn("i", start + F.col("mark").bitwiseAND(F.lit((1 << 33) - 1))).drop("mark"), ahead


# Trees


def _reduced(nodes: Column) -> Column:
    """The hashes of runs of three nodes; a last run may be shorter."""
    runs = F.sequence(F.lit(0), F.ceil(F.size(nodes) / F.lit(RUN)).cast("int") - 1)
    return F.transform(runs, lambda k: sha256(F.array_join(F.slice(nodes, k * RUN + 1, RUN), "")))


def blocks(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """(key, i, total, hash, ...) -> (key, block, total, entries, level0..level3): 27 places a block, nodes by slot, and
    the levels above them. A level is null where the whole tree has one node left before it."""
    slot = (F.col("i") % BLOCK).cast("int").alias("slot")
    out = nodes.groupBy("key", F.expr(f"i div {BLOCK}").alias("block")).agg(F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct(slot, "hash", *carried))).alias("entries"))
    out = out.withColumn("level0", F.col("entries.hash"))
    left = F.col("total")
    for k in range(LEVELS):
        out = out.withColumn(f"level{k + 1}", F.when(left > 1, _reduced(F.col(f"level{k}"))))
        left = F.ceil(left / F.lit(RUN))
    return out


def grown(leaves: DataFrame, carried: list[str], largest: int) -> list[DataFrame]:
    """The blocks of all trees, a table for each round, until every tree has one block. Each round's table holds a
    27th of the rows of the round before."""
    tables, nodes = [], leaves
    while True:
        tables.append(write_table(blocks(nodes, carried if not tables else []), "manifest-blocks"))
        largest = -(-largest // BLOCK)
        if largest <= 1:
            return tables
        nodes = tops(tables[-1])


def tops(table: DataFrame) -> DataFrame:
    """The topmost node of each block, as nodes of the next round."""
    top = F.coalesce(*[F.col(f"level{k}") for k in range(LEVELS, -1, -1)])[0]
    return table.select("key", F.col("block").alias("i"), F.ceil(F.col("total") / F.lit(BLOCK)).alias("total"), top.alias("hash"))


def _steps(slot: Column) -> Column:
    """What a node meets on its way up in its block: the siblings to its left and right, level by level."""
    steps = []
    for k in range(LEVELS):
        level, at = F.col(f"level{k}"), F.floor(slot / F.lit(RUN**k)).cast("int")
        place = at % RUN
        left = F.array_join(F.slice(level, at - place + 1, place), "")
        right = F.array_join(F.slice(level, at + 2, RUN - 1 - place), "")
        steps.append(F.when(F.col(f"level{k + 1}").isNotNull(), F.struct(left.alias("left"), right.alias("right"))))
    return F.array_compact(F.array(*steps))


def paths(tables: list[DataFrame], above: DataFrame, passed: list[str]) -> DataFrame:
    """The entries of the lowest blocks with (key, path): siblings from the leaf to the top, then what `above` (key,
    path, ...) goes on with. Blocks get their path from the block over them, so the work is that of the leaves."""
    down = above.withColumn("block", F.lit(0).cast("long"))
    for k in range(len(tables) - 1, -1, -1):
        met = tables[k].join(down.select("key", "block", "path", *passed), ["key", "block"])
        entries = met.select("*", F.explode("entries").alias("entry"))
        entries = entries.select("key", *passed, "entry", (F.col("block") * BLOCK + F.col("entry.slot")).alias("i"), F.concat(_steps(F.col("entry.slot")), F.col("path")).alias("path"))
        down = entries.withColumnRenamed("i", "block")
    return down.drop("block")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, s: sha256(F.concat(s["left"], node, s["right"])))


def proof_digest(path: Column) -> Column:
    return sha256(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def proofs(docs: DataFrame, suspect: Column | None = None) -> DataFrame:
    """(doc_id, source, leaf, subroot, root, path, suspect_leaf) for every document.

    A leaf hashes doc_id, source, lang, n_chars and text. Leaves of a source stand by doc_id; every three consecutive
    nodes become their hash, level by level, up to the subroot; subroots by source (null first, then by bytes) up to the
    root. `path` has the siblings (left, right) of each level, from the leaf to the root. Where `suspect` gives another
    text, suspect_leaf is that text's leaf, else null.

    Null fields hash as `-`; ids are integers, null first; rows that repeat an id stand by their leaf, so equal rows in
    any order; an empty table gives no rows; other columns are neither hashed nor returned. No task holds more than
    27 places or 512 ids of a source.
    """
    changed = leaf(text=suspect) if suspect is not None else F.lit(None).cast("string")
    rows = docs.select(encoded(F.col("source")).alias("key"), F.col("doc_id").cast("long").alias("id"), leaf().alias("leaf"), changed.alias("suspect_leaf"))
    leaves = write_table(placed(rows).withColumnRenamed("leaf", "hash"), "manifest-leaves")
    largest = leaves.agg(F.max("total")).first()[0] or 1
    tables = grown(leaves, ["id", "suspect_leaf"], largest)
    subroots = tops(tables[-1]).select(F.col("key").alias("source_key"), "hash")
    subroots, n = numbered(subroots, _source_of("source_key").asc_nulls_first())
    over = grown(subroots.select(F.lit("all").alias("key"), "source_key", "hash", "i", F.lit(n).cast("long").alias("total")), ["source_key"], n)
    none = F.array().cast("array<struct<left:string,right:string>>")
    root = tops(over[-1]).select("key", none.alias("path"), F.col("hash").alias("root"))
    by_source = paths(over, root, ["root"]).select(F.col("entry.source_key").alias("key"), F.col("entry.hash").alias("subroot"), "root", "path")
    out = paths(tables, by_source, ["subroot", "root"])
    return out.select(F.col("entry.id").alias("doc_id"), _source_of("key").alias("source"), F.col("entry.hash").alias("leaf"), "subroot", "root", "path", F.col("entry.suspect_leaf").alias("suspect_leaf"))


def _source_of(key: str) -> Column:
    return F.when(F.col(key) != "-", F.expr(f"substring({key}, instr({key}, ':') + 1)"))


def roots(docs: DataFrame) -> DataFrame:
    """(source, n, subroot, root): the manifest itself, a row for each source."""
    return proofs(docs).groupBy("source", "subroot", "root").agg(F.count("*").alias("n"))


def verify(docs: DataFrame) -> DataFrame:
    """Proofs of all documents, checked where every second one (by crc32 of its id) has lost its line breaks."""
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    found = proofs(docs, F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    found = found.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.col("suspect_leaf"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
