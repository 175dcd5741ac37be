"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact weighted shingles.

Every text's windows of every item length are fingerprinted, from running sums of bits, at starts at most a STRIDE-th of
the length apart and at both ends of the text. A window whose fingerprint is within RADIUS bits of an item of its length is
a candidate; the blocks find all of them. A candidate and the windows around it up to the next starts are then compared
with the item shingle by shingle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from noisegrid.llm._common import n_words

SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8 an aligned window is expected within 5 bits of its item, one half a start away within 8.
RADIUS = 14
#: Starts of windows lie the largest of these words apart that is at most a STRIDE-th of their length.
STRIDE, STRIDES = 12, (1, 2, 3, 4, 6, 12)
#: Bits at which the blocks begin and end.
EDGES = (0, 13, 26, 39, 52, 64)
BLOCKS = len(EDGES) - 1
#: Words of texts whose windows are fingerprinted at once; a longer text goes in parts that overlap by an item.
WORDS_AT_ONCE = 32_768
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 22


def tokens(text: bytes | None) -> list[bytes]:
    """Words with A-Z in lower case."""
    return (text or b"").lower().split()


def shingle_hashes(ids: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of the runs of `width` word hashes."""
    out = np.zeros(len(ids) - width + 1 if width else 0, np.uint64)
    for k in range(width):
        out = (out ^ ids[k : len(ids) - width + 1 + k]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def block_values(prints: np.ndarray, b: int) -> np.ndarray:
    return (prints >> np.uint64(EDGES[b])).astype(np.uint16) & np.uint16((1 << (EDGES[b + 1] - EDGES[b])) - 1)


def _packed(above: np.ndarray) -> np.ndarray:
    """Rows of 64 bits as numbers."""
    return np.packbits(above.ravel()).view("<u8")


def fingerprint(ids: np.ndarray) -> int:
    """SimHash of a bag of words: the bits that over half of the words' hashes have."""
    ones = np.unpackbits(ids.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int(_packed((2 * ones > len(ids))[None, :])[0])


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity; a shingle weighs as often as it occurs."""
    shared = sum(min(n, b[s]) for s, n in a.items() if s in b)
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


@dataclass
class Block:
    """Items of the benchmark, their fingerprints and shingles, and for each length the items of that length with
    tables from the values of a block of bits to whether an item is near."""

    ids: list
    words: list[np.ndarray]
    shingles: list[Counter] = field(default_factory=list)
    prints: np.ndarray | None = None
    lengths: dict[int, np.ndarray] = field(default_factory=dict)
    strides: dict[int, int] = field(default_factory=dict)
    near: dict[int, list[np.ndarray]] = field(default_factory=dict)
    slots: np.ndarray | None = None

    def prepare(self) -> Block:
        """Index the items. If two fingerprints differ in at most RADIUS bits, they differ in at most RADIUS // BLOCKS
        bits in one block at least, so the tables miss none."""
        self.prints = np.array([fingerprint(w) for w in self.words], np.uint64)
        self.slots = np.zeros(1 << _SLOTS, bool)
        for w in self.words:
            hashes = shingle_hashes(w, min(SHINGLE, len(w)))
            self.shingles.append(Counter(hashes.tolist()))
            self.slots[hashes >> np.uint64(64 - _SLOTS)] = True
        sizes = np.array([len(w) for w in self.words], np.int64)
        for length in np.unique(sizes).tolist():
            own = self.lengths[length] = np.flatnonzero(sizes == length)
            self.strides[length] = max(x for x in STRIDES if x <= max(1, length // STRIDE))
            self.near[length] = []
            for b in range(BLOCKS):
                values = np.arange(1 << (EDGES[b + 1] - EDGES[b]), dtype=np.uint16)
                close = np.zeros(len(values), bool)
                for v in np.unique(block_values(self.prints[own], b)):
                    close |= np.bitwise_count(values ^ v) <= RADIUS // BLOCKS
                self.near[length].append(close)
        return self

    def candidates(self, prints: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, item): all pairs of fingerprints and items of a length within RADIUS bits."""
        listed = np.zeros(len(prints), bool)
        for b in range(BLOCKS):
            listed |= self.near[length][b].take(block_values(prints, b))
        at, own = np.flatnonzero(listed), self.lengths[length]
        k, place = np.nonzero(np.bitwise_count(prints[at] ^ self.prints[own][:, None]) <= RADIUS)
        return at[place], own[k]


class Hashes(dict):
    """Word -> odd 64-bit hash, filled as words are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word) | 1
        return h


def search(texts: list[np.ndarray], block: Block) -> list[tuple[int, int, int, int, int, float]]:
    """(text, item, start, words, hamming, similarity) of the best window of each text, given by its word hashes, for
    each item it leaks.

    Windows have the item's length (the whole text if that is shorter). The best window is the most similar, then the
    first; hamming is the distance of its own fingerprint.
    """
    best: dict[tuple[int, int], tuple[int, int, int, float]] = {}
    longest = max(block.lengths, default=0)
    group: list[tuple[int, int, np.ndarray]] = []

    def flush() -> None:
        for text, k, start, *found in _search_group(group, block):
            old = best.get((text, k))
            if old is None or (-found[2], start) < (-old[3], old[0]):
                best[text, k] = (start, *found)
        group.clear()

    size, most = 0, max(WORDS_AT_ONCE, 4 * longest)
    for t, ids in enumerate(texts):
        for a in range(0, len(ids) - longest + 1, most - longest) if len(ids) > most else [0]:
            part = ids[a : a + most]
            if size + len(part) > most and group:
                flush()
                size = 0
            group.append((t, a, part))
            size += len(part)
    flush()
    return [(text, k, *found) for (text, k), found in sorted(best.items())]


def _search_group(group: list[tuple[int, int, np.ndarray]], block: Block) -> Iterator[tuple[int, int, int, int, int, float]]:
    group = [(t, a, w) for t, a, w in group if len(w)]
    if not group or not block.lengths:
        return
    longest = max(block.lengths)
    # each text begins at a multiple of all strides, so that its windows don't depend on its neighbours
    sizes = np.array([len(w) for _, _, w in group])
    room = -(-sizes // STRIDES[-1]) * STRIDES[-1]
    starts = np.cumsum(room) - room
    ends = starts + sizes
    ids, own = np.zeros(int(room.sum()), np.uint64), np.repeat(np.arange(len(group)), room)
    for start, (_, _, w) in zip(starts.tolist(), group, strict=True):
        ids[start : start + len(w)] = w
    # counts of each bit up to each word; four counts below 2 ** 16 are added at once as a 64-bit number. Counts of short
    # windows are differences below 256, which the last 8 bits give
    kind = np.uint16 if len(ids) < 1 << 16 else np.uint64
    bits = np.unpackbits(ids.view(np.uint8).reshape(-1, 8), axis=1).astype(kind).view(np.uint64)
    ones = np.zeros((len(ids) + 1, bits.shape[1]), np.uint64)
    ones[1:] = np.cumsum(np.ascontiguousarray(bits.T), axis=1).T  # sums along memory are faster
    ones = ones.view(kind)
    if longest < 256:
        kind, ones = np.uint8, ones.astype(np.uint8)
    marks: dict[int, np.ndarray] = {}
    for length in block.lengths:
        width = min(SHINGLE, length)
        if width not in marks:
            marks[width] = np.zeros(len(ids) + 1, np.int32)
            if len(ids) >= width:
                hit = block.slots[shingle_hashes(ids, width) >> np.uint64(64 - _SLOTS)]
                np.cumsum(hit, out=marks[width][1 : len(hit) + 1])
                marks[width][len(hit) + 1 :] = marks[width][len(hit)]
        stride = block.strides[length]
        long = np.minimum(sizes, length)
        edges, long = np.concatenate([starts, ends - long]), np.concatenate([long, long])
        prints = _packed(ones[edges + long] - ones[edges] > (long >> 1).astype(kind)[:, None])
        if len(ids) >= length:
            prints = np.concatenate([prints, _packed(ones[length::stride] - ones[: len(ids) - length + 1 : stride] > kind(length >> 1))])
        place, items = block.candidates(prints, length)
        if not len(place):
            continue
        edge = np.minimum(place, len(edges) - 1)
        inner = place >= len(edges)
        at = np.where(inner, (place - len(edges)) * stride, edges[edge])
        size = np.where(inner, length, long[edge])
        text = own[at]
        first, last = np.maximum(at - stride, starts[text]), np.minimum(at + stride + size, ends[text])
        # exact: no window around a candidate is similar enough if the region has too few shingles of any item
        inside = marks[width][np.maximum(last - width + 1, first)] - marks[width][first]
        able = (at + size <= ends[text]) & (inside * (1 + SIMILARITY) >= SIMILARITY * (size + length - 2 * width + 2) - 1e-9)
        for k, a, b, n, t in zip(items[able].tolist(), first[able].tolist(), last[able].tolist(), size[able].tolist(), text[able].tolist(), strict=True):
            if found := _best_window(ids[a:b], block, k, n, width):
                yield group[t][0], k, a + found[0] - int(starts[t]) + group[t][1], n, *found[1:]


def _best_window(ids: np.ndarray, block: Block, k: int, n: int, width: int) -> tuple[int, int, float] | None:
    """(start, hamming, similarity) of the most similar window of n words; None below SIMILARITY."""
    if len(ids) < max(n, width):
        return None
    hashes, item, best = shingle_hashes(ids, width).tolist(), block.shingles[k], None
    for start in range(len(ids) - n + 1):
        alike = similarity(Counter(hashes[start : start + n - width + 1]), item)
        if alike >= SIMILARITY and (best is None or alike > best[1]):
            best = (start, alike)
    if best is None:
        return None
    apart = np.bitwise_count(np.uint64(fingerprint(ids[best[0] : best[0] + n])) ^ block.prints[k])
    return best[0], int(apart), best[1]


def blocks_of(items: DataFrame, words_a_block: int = 1_000_000) -> Iterator[Block]:
    """The benchmark in blocks of about words_a_block words, so that what is collected and broadcast at once is bounded:
    some 50 MB. Items without words are left out. A block is collected when its turn comes."""
    sized = items.select("item_id", "text", n_words(F.col("text")).alias("n")).where("n > 0")
    total = sized.agg(F.sum("n")).first()[0] or 0
    pieces = -(-int(total) // words_a_block)
    for piece in range(pieces):
        rows = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(pieces)) == piece).select("item_id", "text").collect()
        hashes = Hashes()
        rows = sorted(rows, key=lambda r: (r.item_id is None, "" if r.item_id is None else r.item_id, r.text))
        yield Block([r.item_id for r in rows], [np.array([hashes[w] for w in tokens(r.text.encode())], np.uint64) for r in rows]).prepare()


def _found(batch: pa.RecordBatch, block: Block, hashes: Hashes) -> list[tuple]:
    if len(hashes) > 500_000:
        hashes.clear()
    get = hashes.__getitem__
    return search([np.fromiter(map(get, tokens(t.as_py())), np.uint64) for t in batch.column("text").cast(pa.binary())], block)


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def leaks(docs: DataFrame, items: DataFrame, words_a_block: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity): the best window of each leaked item per document.

    Null and empty texts leak nothing; rows that repeat an id each count; ids may be of any type. Documents are read
    once for each words_a_block words of the benchmark (once for most benchmarks) and never shuffled.
    """
    kind, item_kind = (df.schema[c].dataType for df, c in ((docs, "doc_id"), (items, "item_id")))
    schema = f"doc_id {kind.simpleString()}, item_id {item_kind.simpleString()}, start_word int, n_words int, hamming int, similarity double"
    item_type = to_arrow_type(item_kind)
    out = docs.sparkSession.createDataFrame([], schema)
    for block in blocks_of(items, words_a_block):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block, hashes = sent.value, Hashes()
            for batch in _parts(batches):
                cols = list(zip(*_found(batch, block, hashes), strict=True)) or [()] * 6
                kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64()]
                ids = pa.array([block.ids[k] for k in cols[1]], item_type)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(cols[0], pa.int64())), ids, *[pa.array(c, k) for c, k in zip(cols[2:], kinds, strict=True)]], ["doc_id", "item_id", "start_word", "n_words", "hamming", "similarity"])

        out = out.union(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def drop_leaking(docs: DataFrame, items: DataFrame, words_a_block: int = 1_000_000) -> DataFrame:
    """The documents that leak no item of the benchmark, with all their columns; nothing is shuffled. Null and empty
    texts stay, as do repeated rows; without items all stay."""
    for block in blocks_of(items, words_a_block):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            block, hashes = sent.value, Hashes()
            for batch in _parts(batches):
                clean = np.ones(len(batch), bool)
                clean[[found[0] for found in _found(batch, block, hashes)]] = False
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
