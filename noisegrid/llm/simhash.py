"""SimHash near-duplicates: pivot distance tables inside lossless Hamming blocks, then components.

Pivot distances alone can't deal fingerprints out to tasks: the distance of a 64-bit fingerprint to any reference is
32 +- 4, so almost all pairs pass a single pivot. Blocks therefore choose which fingerprints meet (no pair within the
radius is lost), the pivot table discards pairs among those that meet, and the survivors are verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from noisegrid.llm._common import checkpoint, join_groups, private
from noisegrid.llm.graph import connected_components

RADIUS = 4
BITS = 64
SHINGLE = 4
#: Reference fingerprints, from a rule.
PIVOTS = np.array([xxhash.xxh64_intdigest(i.to_bytes(4, "little"), 42) for i in range(16)], dtype=np.uint64)


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """64 majority bits of the XXH64 of word shingles, as an unsigned number; 0 for a text without words."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1)[:n].tolist()
    ends = ends[shingle - 1 :].tolist() or [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], dtype="<u8")
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, n, 16384):
        counts += np.unpackbits(hashes[k : k + 16384].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > n).view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp): the fingerprint's bits as a signed long. A null text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """Masks of all choices of blocks - radius blocks: two fingerprints within the radius agree under one of them."""
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def choose_blocks(n: int, radius: int = RADIUS, per_bucket: int = 8) -> int:
    """The fewest blocks whose buckets hold about per_bucket of n evenly spread fingerprints at most."""
    for blocks in range(radius + 2, radius + 8):
        if n >> (BITS * (blocks - radius) // blocks) <= per_bucket:
            break
    return blocks


def _bucket_edges(groups: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each fingerprint to the least one of its component within its group; groups are runs."""
    cut = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    sizes = np.diff(np.r_[cut, len(groups)])
    signed, out_a, out_b = fps.view(np.int64), [], []
    keep = np.repeat(sizes, sizes) > 1
    at = np.repeat(cut, sizes)
    table = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8) if keep.any() else None
    small = keep & (np.repeat(sizes, sizes) <= 16)
    if small.any():
        for lag in range(1, int(sizes[sizes <= 16].max())):
            i = np.flatnonzero(small[:-lag] & (at[:-lag] == at[lag:]))
            i = i[np.abs(table[i] - table[i + lag]).max(axis=1) <= radius] if len(i) else i
            i = i[np.bitwise_count(fps[i] ^ fps[i + lag]) <= radius] if len(i) else i
            out_a.append(np.minimum(signed[i], signed[i + lag]))
            out_b.append(np.maximum(signed[i], signed[i + lag]))
    for start, size in zip(cut[sizes > 16].tolist(), sizes[sizes > 16].tolist(), strict=True):
        own, rows = fps[start : start + size], table[start : start + size]
        order = np.argsort(own.view(np.int64), kind="stable")
        own, rows = own[order], rows[order]
        open_ = np.arange(size)  # not reached yet; a component is walked from its least fingerprint
        while len(open_):
            root, open_ = open_[0], open_[1:]
            front = [root]
            while front and len(open_):
                x = front.pop()
                near = np.flatnonzero(np.abs(rows[open_] - rows[x]).max(axis=1) <= radius)
                near = near[np.bitwise_count(own[open_[near]] ^ own[x]) <= radius]
                if len(near):
                    hit = open_[near]
                    front += hit.tolist()
                    open_ = np.delete(open_, near)
                    out_a.append(np.full(len(hit), own[root]).view(np.int64))
                    out_b.append(own[hit].view(np.int64))
    none = np.empty(0, np.int64)
    return np.concatenate(out_a or [none]), np.concatenate(out_b or [none])


def near_edges(fps: DataFrame, radius: int = RADIUS, most: int = 2048) -> DataFrame:
    """Edges (a, b) that connect all of the distinct fingerprints `fp` within the radius of each other.

    For every choice of blocks a fingerprint goes to a bucket. In a bucket, pairs whose pivot distances differ by more
    than the radius in any coordinate are discarded and the rest verified; the bucket gives at most one edge for each
    fingerprint. A bucket of more than `most` is dealt as pairs of parts, each pair a group of its own, so that no
    task holds it all and no pair of it is missed.
    """
    n = fps.count()
    masks = block_masks(choose_blocks(n, radius), radius)
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(keys).alias("key"))
    hot = checkpoint(rows.groupBy("key").count().where(F.col("count") > most).select("key", F.ceil(F.col("count") * 2 / most).cast("int").alias("parts")))
    n_hot = hot.count()
    if n_hot:
        rows = rows.join(F.broadcast(hot) if n_hot <= 20_000 else hot, "key", "left")
        part = F.pmod(F.xxhash64(F.lit("part"), "fp"), F.col("parts")).cast("int")
        others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: o != part)
        spread = F.transform(others, lambda o: F.xxhash64("key", F.least(part, o), F.greatest(part, o)))
        rows = rows.select("fp", F.explode(F.when(F.col("parts").isNull(), F.array("key")).otherwise(spread)).alias("key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, fps_ = np.empty(0, np.int64), np.empty(0, np.int64)

        def edges(g: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = _bucket_edges(g, f.view(np.uint64), radius)
            pairs = np.unique(np.stack([a, b], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"])

        for batch in batches:
            groups = np.r_[groups, batch.column("key").to_numpy()]
            fps_ = np.r_[fps_, batch.column("fp").to_numpy()]
            last = int(np.searchsorted(groups, groups[-1])) if len(groups) else 0
            if last:
                yield edges(groups[:last], fps_[:last])
                groups, fps_ = groups[last:], fps_[last:]
        if len(groups):
            yield edges(groups, fps_)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text) -> (doc_id, fp, component_id), a row for each document.

    Fingerprints within the radius are linked; component_id is the smallest doc_id that can be reached, itself
    included, ids that are null not counted. Texts without words have fingerprint 0 and are linked like any other.
    Equal fingerprints are one node, so a group of copies of any size is one row in all that follows. Repeated rows
    stay; an empty table gives no rows.
    """
    rows = checkpoint(fingerprints(docs))
    nodes = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = connected_components(near_edges(nodes.select("fp"), radius))
    at = nodes.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    at = checkpoint(at)
    best = checkpoint(at.groupBy("root").agg(F.count("*").alias("n"), F.min("least").alias("component_id")))
    ids = join_groups(at, best, "root", "n").select(F.col("fp").alias("c_fp"), "component_id")
    return rows.join(ids, F.col("fp") == F.col("c_fp")).select("doc_id", "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component stays, that with the smallest id.

    Rows that repeat an id and a fingerprint count as copies: one of them stays. Documents without an id are copies
    of each other where their fingerprints are equal; they go where their component holds an id.
    """
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    found = checkpoint(components(docs).groupBy("doc_id", "fp").agg(F.count("*").alias("n"), F.max(own).alias("own")))
    ours, key, fp = found.where("own"), private(docs, "_id"), private(docs, "_fp")
    of_id = found.groupBy("doc_id").agg(F.sum("n").alias("n"), F.max("own").alias("own")).where("own")
    single = of_id.where("n = 1 and doc_id is not null").select(F.col("doc_id").alias(key))
    out = docs.join(single, F.col("doc_id") == F.col(key), "left_semi")
    several = of_id.where("n > 1 or doc_id is null").select(F.col("doc_id").alias(key))
    if several.isEmpty():
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text").cast(pa.binary())), np.uint64, len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], [*batch.schema.names, fp])

    again = docs.join(several, F.col("doc_id").eqNullSafe(F.col(key)), "left_semi")
    marked = again.mapInArrow(run, StructType([*docs.schema.fields, StructField(fp, LongType())])).dropDuplicates(["doc_id", fp])
    ours = ours.select(F.col("doc_id").alias(key), F.col("fp").alias(f"{fp}_"))
    return out.union(marked.join(ours, F.col("doc_id").eqNullSafe(F.col(key)) & (F.col(fp) == F.col(f"{fp}_")), "left_semi").select(*docs.columns))
