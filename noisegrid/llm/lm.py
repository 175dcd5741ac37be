"""Language-model scoring: exact word counts, and a causal self-attention model over subword ids, trained in numpy.

The model: every subword id has a row of its own with a query, a key, a value and a hidden part; ids beyond the ROWS - 1
most frequent share the last row. A position attends to itself and the positions before it in its window; what it
gathers is mixed into its hidden part, and a softmax over classes of ids and one over the ids of the class give the
next id. Windows are spans of SPAN ids, each with the span before it as context: they overlap by half, and each id is
scored once, after SPAN to 2 SPAN - 1 ids of context.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, count, pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from numpy.lib.stride_tricks import as_strided
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noisegrid.llm._common import crc_rest, most_frequent, write_table

#: The vocabulary file; spark.noisegrid.tokenizer names another one. It is read on the driver and sent to the tasks.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END_ID = 50256
IDS = 50257
#: A word never holds a line break, so this can stand for the end among words.
END = b"\n"
#: Rows of the embedding; classes; sizes of queries and of values and hidden parts; ids of a span; spans of a window.
ROWS, CLASSES, QUERY, WIDTH, SPAN, SPANS = 2048, 24, 4, 8, 8, 16
MOST = 6.0


@dataclass
class Vocabulary:
    """Subword ids as rows in order of frequency: row of an id, natural log share of its row, and the classes, which
    are runs of rows from bounds[c] to bounds[c + 1]; of_class and of_row are log shares of all and of the class."""

    rows: np.ndarray
    inside: np.ndarray
    bounds: list[int]
    classes: np.ndarray
    of_class: np.ndarray
    of_row: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Vocabulary:
        """Sizes of the classes go with the inverse root of their ids' mass, which makes the mean cost least."""
        order = np.argsort(-counts, kind="stable")
        rows, inside = np.full(IDS, ROWS - 1, np.uint16), np.zeros(IDS)
        rows[order[: ROWS - 1]] = np.arange(ROWS - 1)
        rest = counts[order[ROWS - 1 :]] + 1.0
        inside[order[ROWS - 1 :]] = np.log(rest / rest.sum())
        mass = np.bincount(rows, counts + 1.0, ROWS)
        cost = np.cumsum(np.sqrt(np.maximum(mass - 1, 0.01)))
        ends = np.searchsorted(cost, cost[-1] * np.arange(1, CLASSES) / CLASSES) + 1
        ends = np.minimum(np.maximum.accumulate(np.maximum(ends - np.arange(CLASSES - 1), 1)) + np.arange(CLASSES - 1), ROWS - CLASSES + np.arange(1, CLASSES))
        classes = np.searchsorted(ends, np.arange(ROWS), side="right").astype(np.uint8)
        total = np.bincount(classes, mass, CLASSES)
        return Vocabulary(rows, inside, [0, *ends.tolist(), ROWS], classes, np.log(total / mass.sum()), np.log(mass / total[classes]))


def new_parameters(vocabulary: Vocabulary, seed: int = 0) -> dict[str, np.ndarray]:
    """rows: query, key, value, a one, and hidden part of each row; lag: score by distance; the last column of outputs
    is the bias."""
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
    p = {"rows": draw(0.3, ROWS, _H + WIDTH), "lag": np.zeros(2 * SPAN, np.float32), "mixed": draw(WIDTH**-0.5, WIDTH, WIDTH), "classes": draw(0.1, CLASSES, WIDTH + 1), "members": draw(0.1, ROWS, WIDTH + 1)}
    p["rows"][:, _H - 1] = 1
    p["classes"][:, -1], p["members"][:, -1] = vocabulary.of_class, vocabulary.of_row
    return p


#: Positions that attend together, two spans; the distances of what they may see, and what they may not.
_BLOCK = 2 * SPAN
_I, _J = np.arange(_BLOCK)[:, None], np.arange(_BLOCK + SPAN)[None, :]
_LAG = np.clip(SPAN + _I - _J, 0, 2 * SPAN - 1)
_UNSEEN = (_J > SPAN + _I) | (_J < _I // SPAN * SPAN)
_K, _V, _H = QUERY, 2 * QUERY, 2 * QUERY + WIDTH + 1


#: Largest absolute value of each parameter, in its shape: minimum and maximum of whole arrays cost least.
_BOUNDS = {"rows": np.full((ROWS, _H + WIDTH), np.inf, np.float32), "lag": np.float32(10), "mixed": np.float32(10), "classes": np.ones((CLASSES, WIDTH + 1), np.float32), "members": np.ones((ROWS, WIDTH + 1), np.float32)}
_BOUNDS["rows"][:, :_V] = MOST
_BOUNDS["classes"][:, -1] = _BOUNDS["members"][:, -1] = np.inf


def _with_before(z: np.ndarray) -> np.ndarray:
    """(windows, positions, d) seen as (windows, blocks, _BLOCK + SPAN, d): each block after the span before it."""
    n, long, d = z.shape
    return as_strided(z, (n, long // _BLOCK, _BLOCK + SPAN, d), (z.strides[0], _BLOCK * z.strides[1], *z.strides[1:]))


def _blocks(z: np.ndarray) -> np.ndarray:
    """(windows, positions, d) seen as (windows, blocks, _BLOCK, d)."""
    return z.reshape(len(z), -1, _BLOCK, z.shape[-1])


def forward(p: dict[str, np.ndarray], vocabulary: Vocabulary, x: np.ndarray, y: np.ndarray, keep: bool = False, scored: np.ndarray | None = None) -> tuple[np.ndarray, tuple | None]:
    """Natural log probabilities of the rows y (n, spans SPAN), which follow the last spans SPAN of the rows x
    (n, (spans + 1) SPAN), and what backward needs. Only ids up to a position bear on the row that follows it.

    Where `scored` is given, the others get 0 and no softmax. Positions go through both softmaxes class by class, in
    order of their targets.
    """
    row = p["rows"].take(x, axis=0)
    q, k, v = _blocks(row[:, SPAN:, :_K]) * np.float32(QUERY**-0.5), _with_before(row[..., _K:_V]), _with_before(row[..., _V:_H])
    e = q @ k.swapaxes(-1, -2)
    e += np.where(_UNSEEN, np.float32(-200), p["lag"][_LAG])
    np.exp(e, out=e)
    order = np.argsort(y.ravel(), kind="stable")
    if scored is not None and not scored.all():
        order = order[scored.ravel()[order]]
    target = y.ravel()[order]
    u = (e @ v).reshape(-1, WIDTH + 1).take(order, axis=0)
    total = u[:, WIDTH].copy()
    z = p["mixed"].T @ u[:, :WIDTH].T
    z /= total
    h = np.ones((WIDTH + 1, len(order)), np.float32)
    np.add(z, row[:, SPAN:, _H:].reshape(-1, WIDTH).take(order, axis=0).T, out=h[:WIDTH])
    np.clip(h, 0, MOST, out=h)
    ends = np.searchsorted(target, vocabulary.bounds)
    many = np.diff(ends)
    at = (target + np.repeat(CLASSES - np.array(vocabulary.bounds[:-1]), many)) * np.repeat(many, many) + np.arange(len(order)) - np.repeat(ends[:-1], many)
    out, sums, totals, parts = *np.empty((3, len(order)), np.float32), []
    for c, (start, end) in enumerate(pairwise(ends.tolist())):
        if end > start:
            low, high = vocabulary.bounds[c : c + 2]
            weights = np.concatenate((p["classes"], p["members"][low:high]))
            b = weights @ h[:, start:end]
            np.add(b[c], b.take(at[start:end]), out=out[start:end])
            np.exp(b, out=b)
            b[:CLASSES].sum(axis=0, out=sums[start:end])
            b[CLASSES:].sum(axis=0, out=totals[start:end])
            if keep:
                parts.append((c, low, high, start, end, weights, b))
    out -= np.log(sums)
    out -= np.log(totals)
    logs = np.zeros(y.size, np.float32)
    logs[order] = out
    return logs.reshape(y.shape), (x, q, k, v, e, u, z, total, h, sums, totals, order, at, parts) if keep else None


def backward(p: dict[str, np.ndarray], kept: tuple, weight: np.ndarray) -> dict[str, np.ndarray | tuple]:
    """Gradients of the mean cross entropy, weighted by position; for rows, the rows seen and their gradients."""
    x, q, k, v, e, u, z, total, h, sums, totals, order, at, parts = kept
    w = weight.ravel()[order].astype(np.float32)
    w /= max(w.sum(), 1)
    of_class, of_row = w / sums, w / totals
    g: dict = {"classes": np.zeros_like(p["classes"]), "members": np.zeros_like(p["members"])}
    dh = np.empty((WIDTH, len(order)), np.float32)
    for c, low, high, start, end, weights, b in parts:
        b[:CLASSES] *= of_class[start:end]
        b[CLASSES:] *= of_row[start:end]
        b[c] -= w[start:end]
        b.reshape(-1)[at[start:end]] -= w[start:end]
        both = b @ h[:, start:end].T
        g["classes"] += both[:CLASSES]
        g["members"][low:high] = both[CLASSES:]
        np.matmul(weights[:, :WIDTH].T, b, out=dh[:, start:end])
    dh *= (h[:WIDTH] > 0) & (h[:WIDTH] < MOST)
    dz = dh / total
    g["mixed"] = u[:, :WIDTH].T @ dz.T
    back = np.empty((len(order), 2 * WIDTH + 1), np.float32)
    np.matmul(dz.T, p["mixed"].T, out=back[:, :WIDTH])
    z *= dz
    np.negative(z.sum(axis=0), out=back[:, WIDTH])
    back[:, WIDTH + 1 :] = dh.T
    du = np.zeros((len(x), x.shape[1] - SPAN, 2 * WIDTH + 1), np.float32)
    du.reshape(-1, 2 * WIDTH + 1)[order] = back
    dhidden, du = du[..., WIDTH + 1 :], _blocks(du)[..., : WIDTH + 1]
    de = du @ v.swapaxes(-1, -2)
    de *= e
    g["lag"] = np.bincount(_LAG.ravel(), de.sum(axis=(0, 1)).ravel(), 2 * SPAN).astype(np.float32)
    dkv = np.empty((*k.shape[:3], QUERY + WIDTH), np.float32)
    np.matmul(de.swapaxes(-1, -2), q, out=dkv[..., :QUERY])
    np.matmul(e.swapaxes(-1, -2), du[..., :WIDTH], out=dkv[..., QUERY:])
    d = np.zeros((*x.shape, _H + WIDTH + 1), np.float32)
    np.multiply(de @ k, np.float32(QUERY**-0.5), out=_blocks(d[:, SPAN:, :_K]))
    by_block, last = _blocks(d[:, :-SPAN, _K : _H - 1]), d[:, -SPAN:, _K : _H - 1]
    by_block[:] = dkv[:, :, :_BLOCK]
    by_block[:, 1:, :SPAN] += dkv[:, :-1, _BLOCK:]
    last[:] = dkv[:, -1, _BLOCK:]
    d[:, SPAN:, _H:-1] = dhidden
    by_row = np.argsort(x.ravel(), kind="stable")
    times = np.bincount(x.ravel(), minlength=ROWS)
    seen = np.flatnonzero(times)
    d = d.reshape(x.size, -1).take(by_row, axis=0).view(np.complex64)  # two columns are added as one
    g["rows"] = seen, np.add.reduceat(d, (np.cumsum(times) - times)[seen], axis=0).view(np.float32)[:, :-1]
    return g


def learn(p: dict[str, np.ndarray], sums: dict[str, np.ndarray], gradients: dict, rate: float) -> None:
    """A step of AdaGrad: rates go with the inverse root of each parameter's sum of squared gradients.

    Parameters keep to bounds within which no exponential of forward overflows: MOST for queries and keys, 1 for the
    weights of hidden values, which are at most MOST.
    """
    for name, g in gradients.items():
        if name == "rows":
            at, g = g
            total, values, most = sums[name].take(at, axis=0), p[name].take(at, axis=0), _BOUNDS[name][: len(at)]
        else:
            total, values, most = sums[name], p[name], _BOUNDS[name]
        total += g * g
        values -= rate * g / np.sqrt(total + 1e-12)
        np.minimum(values, most, out=values)
        np.maximum(values, -most, out=values)
        if name == "rows":
            sums[name][at], p[name][at] = total, values


def windows(ids: np.ndarray, sizes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows over texts whose ids stand one after the other, `sizes` of them each: (inputs, targets, scored, text).

    A window scores SPANS spans of a text; its inputs begin one span earlier. Before a text stand ends; its last window
    is padded. Every id is a scored target once.
    """
    long = SPAN * SPANS
    counts = -(-sizes // long)
    text = np.repeat(np.arange(len(sizes)), counts)
    first = (np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)) * long
    scored = np.arange(long) < (sizes[text] - first)[:, None]
    both = np.full((len(text), SPAN + 1 + long), end, ids.dtype)
    both[:, SPAN + 1 :][scored] = ids
    later = np.flatnonzero(first)
    both[later, : SPAN + 1] = both[later - 1, long:]
    return both[:, :-1], both[:, SPAN + 1 :], scored, text


def tokenizer_of(spark: SparkSession) -> Broadcast:
    with open(spark.conf.get("spark.noisegrid.tokenizer", TOKENIZER), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def load_tokenizer(ranks: bytes) -> tiktoken.Encoding:
    return tiktoken.Encoding("subwords", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}, special_tokens={})


class Pieces(dict):
    """Word -> number; the subword ids of word k are flat[starts[k]:starts[k] + sizes[k]].

    The ids of a word are those of the word with a space before it, so the ids tell where words begin.
    """

    def __init__(self, encoding: tiktoken.Encoding, begins: np.ndarray):
        super().__init__()
        self.encoding, self.begins, self.new = encoding, begins, []
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint16), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of different words; those not seen before get the next ones."""
        numbers = np.fromiter(map(self.get, words, repeat(-1)), np.int64, len(words))
        unseen = np.flatnonzero(numbers < 0)
        numbers[unseen] = np.arange(len(self), len(self) + len(unseen))
        new = [words[k] for k in unseen.tolist()]
        self.update(zip(new, count(len(self))))
        self.new += new
        return numbers

    def settle(self) -> None:
        """Take up the words seen since the last call.

        They are encoded as one text where no other white space stands in them, for then each is encoded as by itself.
        """
        if not self.new:
            return
        words = [w for w in self.new if w != END]
        text = b" ".join([b"", *words]).decode("utf-8", "replace")
        if len(text.split()) == len(words):
            flat = self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.uint16)
            at = np.flatnonzero(self.begins[flat])
            if END in self.new:
                k = self.new.index(END)
                at = np.r_[at, len(flat)]
                place = at[k]
                flat, at = np.insert(flat, place, END_ID), np.r_[at[:k], place, at[k:-1] + 1]
            sizes = np.diff(np.r_[at, len(flat)])
        else:
            each = [[END_ID] if w == END else self.encoding.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in self.new]
            flat, sizes = np.fromiter(chain.from_iterable(each), np.uint16), np.fromiter(map(len, each), np.int64, len(each))
        self.starts, self.sizes = np.r_[self.starts, len(self.flat) + np.cumsum(sizes) - sizes], np.r_[self.sizes, sizes]
        self.flat, self.new = np.r_[self.flat, flat], []

    def ids(self, numbers: np.ndarray) -> np.ndarray:
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[numbers] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The values as binaries of `sizes` values each."""
    offsets = np.r_[0, np.cumsum(sizes * flat.itemsize)]
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(flat))])


def _parts(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about `most` bytes: (place of the first, place after the last)."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64)
    group = (np.cumsum(sizes) - sizes) // most
    return pairwise([*np.flatnonzero(np.r_[True, group[1:] != group[:-1]][: len(group)]).tolist(), len(texts)])


def split_words(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Words of texts, A-Z in lower case: (place of each word's spelling, the different spellings, words of each text)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")).cast(pa.large_string()))
    words, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy())
    some = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty string there
    sizes = np.diff(np.r_[0, np.cumsum(some.to_numpy(zero_copy_only=False))][np.r_[0, ends]])
    codes = words.filter(some).dictionary_encode()
    return codes.indices.to_numpy(), codes.dictionary.cast(pa.large_binary()).to_numpy(zero_copy_only=False).tolist(), sizes


def tokenise(docs: DataFrame, tokenizer: Broadcast, most_held: int = 500_000, most_bytes: int = 1 << 22) -> DataFrame:
    """Rows (doc_id, held_out, ids) for the documents and rows (word, n) that count words of training documents; a
    word is given by its ids, as is the end. ids are 16-bit numbers. A table in the shared folder."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, begins = load_tokenizer(tokenizer.value), word_starts(tokenizer.value)
        pieces, counts = Pieces(encoding, begins), np.zeros(0, np.int64)
        names, none = ["doc_id", "held_out", "ids", "word", "n"], lambda n, t: pa.nulls(n, t)
        id_type = None

        def flush() -> pa.RecordBatch:
            used = np.flatnonzero(counts)
            words = _binary(pieces.ids(used), pieces.sizes[used]).cast(pa.binary())
            return pa.RecordBatch.from_arrays([none(len(used), id_type), none(len(used), pa.bool_()), none(len(used), pa.binary()), words, pa.array(counts[used])], names)

        for batch in batches:
            id_type = batch.column("doc_id").type
            for at, end in _parts(batch.column("text"), most_bytes):
                part = batch.slice(at, end - at)
                places, words, many = split_words(part.column("text"))
                numbers = pieces.numbers([END, *words])
                pieces.settle()
                flat = np.insert(numbers[1:][places], np.cumsum(many), numbers[0])
                trains = np.repeat(~np.asarray(part.column("held_out").to_numpy(zero_copy_only=False), bool), many + 1)
                counts = np.r_[counts, np.zeros(len(pieces) - len(counts), np.int64)]
                counts += np.bincount(flat[trains], minlength=len(counts))
                sizes = np.add.reduceat(pieces.sizes[flat], np.cumsum(many + 1) - many - 1)
                n = len(part)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), _binary(pieces.ids(flat), sizes).cast(pa.binary()), none(n, pa.binary()), none(n, pa.int64())], names)
                if len(pieces) > most_held:
                    yield flush()
                    pieces, counts = Pieces(encoding, begins), np.zeros(0, np.int64)
        if counts.any():
            yield flush()

    return write_table(docs.mapInArrow(run, f"doc_id {kind}, held_out boolean, ids binary, word binary, n long"), "lm-tokens")


def subword_counts(of_words: DataFrame) -> np.ndarray:
    """How often each subword id stands in the counted words; one number an id reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(IDS)
        for batch in batches:
            column = batch.column("word").cast(pa.large_binary())
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 2
            ids = np.frombuffer(column.buffers()[2], np.uint16)[offsets[0] : offsets[-1]]
            sums += np.bincount(ids, np.repeat(batch.column("n").to_numpy(), np.diff(offsets)), IDS)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(sums[some])], ["id", "n"])

    found = of_words.mapInArrow(run, "id long, n double").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(IDS)
    out[found["id"]] = found["n"]
    return out


def word_starts(ranks: bytes) -> np.ndarray:
    """For each subword id whether it begins a word: its bytes begin with a space, or it is the end."""
    out = np.zeros(IDS, bool)
    out[END_ID] = True
    for a, b in map(bytes.split, ranks.splitlines()):
        out[int(b)] = base64.b64decode(a).startswith(b" ")
    return out


def _groups(batch: pa.RecordBatch, most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The documents of a batch in groups of about `most` ids: (place of the first, ids, ids of each)."""
    column = batch.column("ids").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] // 2
    ids = np.frombuffer(column.buffers()[2], np.uint16)
    group = (offsets[:-1] - offsets[0]) // most
    for a, b in zip(cuts := np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), [*cuts[1:], len(column)], strict=True):
        yield int(a), ids[offsets[a] : offsets[b]], np.diff(offsets[a : b + 1])


def train(ids: DataFrame, vocabulary: Vocabulary, rounds: int = 2, batch: int = 64, rate: float = 0.2) -> dict[str, np.ndarray]:
    """Local training with averaging: in each round every task runs AdaGrad over the windows of its part of a rounds-th
    of the documents, another one each round, so that all are learned from once; parameters and sums of squared
    gradients are averaged by windows seen.

    What is learned from grows with the corpus; what reaches the driver is one set of parameters a round.
    """
    params = new_parameters(vocabulary)
    state = [params, {k: np.zeros_like(v) for k, v in params.items()}]
    shapes = [(which, name, params[name].shape) for which in (0, 1) for name in sorted(params)]
    for turn in range(rounds):
        sent = ids.sparkSession.sparkContext.broadcast((state, vocabulary))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            state, vocabulary = sent.value
            params, sums = ({k: v.copy() for k, v in part.items()} for part in state)
            end, seen, held = vocabulary.rows[END_ID], 0, []

            def take() -> None:
                nonlocal seen
                x, y, w = (np.concatenate(z) for z in zip(*held, strict=True))
                held.clear()
                for at in np.array_split(np.random.default_rng(seen).permutation(len(x)), -(-len(x) // batch)):
                    _, kept = forward(params, vocabulary, x[at], y[at], keep=True, scored=w[at])
                    learn(params, sums, backward(params, kept, w[at]), rate)
                seen += len(x)

            for rows in batches:
                for _, flat, sizes in _groups(rows):
                    held.append(windows(vocabulary.rows[flat], sizes, end)[:3])
                    if sum(len(h[0]) for h in held) >= 64 * batch:
                        take()
            if held:
                take()
            if seen:
                values = np.concatenate([(params, sums)[which][name].ravel() for which, name, _ in shapes]).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values * seen), pa.array(np.full(len(values), float(seen)))], ["place", "value", "seen"])

        part = ids.where(F.pmod(F.xxhash64(F.lit("lm"), "doc_id", "ids"), F.lit(rounds)) == turn).select("ids")
        mean = part.mapInArrow(run, "place int, value double, seen double").groupBy("place").agg((F.sum("value") / F.sum("seen")).alias("value")).toPandas().sort_values("place")
        sent.unpersist()
        if len(mean):
            flat, at = mean["value"].to_numpy(np.float32), 0
            state = [{}, {}]
            for which, name, shape in shapes:
                size = int(np.prod(shape))
                state[which][name], at = flat[at : at + size].reshape(shape), at + size
    return state[0]


def log10_probability(p: dict[str, np.ndarray], vocabulary: Vocabulary, ids: np.ndarray, sizes: np.ndarray, at_once: int = 128) -> np.ndarray:
    """The log10 probability of each text's ids: of their rows by the model, and of ids in the last row by their share."""
    x, y, scored, text = windows(vocabulary.rows[ids], sizes, vocabulary.rows[END_ID])
    out = np.empty(len(x))
    for k in range(0, len(x), at_once):
        part = slice(k, k + at_once)
        out[part] = forward(p, vocabulary, x[part], y[part], scored=scored[part])[0].sum(axis=1, dtype=np.float64)
    inside = np.add.reduceat(vocabulary.inside[ids], np.cumsum(sizes) - sizes) if len(sizes) else 0
    return (np.bincount(text, out, len(sizes)) + inside) / np.log(10)


class Known:
    """Counts of the most frequent words, found by two 64-bit hashes of their ids."""

    def __init__(self, words: list[bytes], counts: np.ndarray, starts: np.ndarray):
        """starts[i] tells whether subword i begins a word."""
        self.starts = starts
        rng = np.random.default_rng(7)
        self.marks = rng.integers(0, 1 << 63, (2, IDS), np.uint64) * np.uint64(2) + np.uint64(1)
        flat = np.frombuffer(b"".join(words), np.uint16)
        sizes = np.array([len(w) // 2 for w in words], np.int64)
        h = self.hashes(flat, sizes)
        self.bits = max(10, int(len(words)).bit_length() + 2)
        self.counts, self.first, self.second = np.r_[counts, 0], np.r_[h[0], 0], np.r_[h[1], 0]
        self.table = np.full(1 << self.bits, len(words), np.int32)
        left, step = np.arange(len(words)), 0
        while len(left):
            slot = self._slot(h[0][left], step)
            free = self.table[slot] == len(words)
            self.table[slot[free]] = left[free]
            left, step = left[self.table[slot] != left], step + 1

    def _slot(self, h: np.ndarray, step: int) -> np.ndarray:
        return ((h >> np.uint64(64 - self.bits)) + np.uint64(step)) & np.uint64((1 << self.bits) - 1)

    def hashes(self, flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if not len(sizes):
            return np.zeros((2, 0), np.uint64)
        at = np.cumsum(sizes) - sizes
        power = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))[np.arange(len(flat)) - np.repeat(at, sizes)]
        return np.array([np.add.reduceat(marks[flat] * power, at) for marks in self.marks])

    def find(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, known) for each word."""
        h = self.hashes(flat, sizes)
        none = len(self.counts) - 1
        place, left, step = np.full(len(sizes), none), np.arange(len(sizes)), 0
        while len(left):
            slot = self.table[self._slot(h[0][left], step)]
            hit = (self.first[slot] == h[0][left]) & (self.second[slot] == h[1][left]) & (slot < none)
            place[left[hit]] = slot[hit]
            left, step = left[~hit & (slot < none)], step + 1
        return self.counts[place], place < none


def score(docs: DataFrame, frequent: int = 400_000) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document.

    Words are what ASCII white space divides, A-Z in lower case, then one end. base_score uses exact counts of all
    training documents, those whose crc32(doc_id) mod 7 is not 2 (a null id trains). The `frequent` most frequent
    words are broadcast; a document's other words are joined with the count table by their ids. score is the attention
    model's log10 probability of the text's subwords and end. A null text is empty: its one token is the end. With
    nothing to learn from, all counts are 0. Texts are tokenised once; later passes read their ids.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer_of(spark)
    out_of = F.coalesce(crc_rest(F.col("doc_id"), 7) == 2, F.lit(False))
    tokens = tokenise(docs.select("doc_id", out_of.alias("held_out"), "text"), tokenizer)
    texts = tokens.where("ids is not null").select("doc_id", "held_out", "ids")
    of_words = write_table(tokens.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")
    total, distinct = of_words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, distinct = int(total), int(distinct)
    vocabulary = Vocabulary.of(subword_counts(of_words))
    params = train(texts.where(~F.col("held_out")), vocabulary)
    head = most_frequent(of_words, "n", frequent).toPandas().sort_values("word")
    known = Known([bytes(w) for w in head["word"]], head["n"].to_numpy(np.int64), word_starts(tokenizer.value))
    sent = spark.sparkContext.broadcast((params, vocabulary, known))
    size = total + distinct + 1
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, row long, n_tokens long, n_known long, base double, score double, words array<binary>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, vocabulary, known = sent.value
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, ids, sizes in _groups(batch):
                n = len(sizes)
                begins = np.flatnonzero(known.starts[ids])
                text = np.searchsorted(np.cumsum(sizes), begins, side="right")
                lengths = np.diff(np.r_[begins, len(ids)])
                count, hit = known.find(ids, lengths)
                base = np.bincount(text[hit], np.log10((count[hit] + 1) / size), n)
                rare = np.flatnonzero(~hit)
                flat = ids[np.repeat(begins[rare] - np.cumsum(lengths[rare]) + lengths[rare], lengths[rare]) + np.arange(lengths[rare].sum())]
                offsets = pa.array(np.searchsorted(text[rare], np.arange(n + 1)).astype(np.int32))
                words = pa.ListArray.from_arrays(offsets, _binary(flat, lengths[rare]).cast(pa.binary()))
                columns = [batch.column(c).slice(first, n) for c in ("doc_id", "held_out")]
                columns += [pa.array(row + np.arange(n)), pa.array(np.bincount(text, minlength=n)), pa.array(np.bincount(text[hit], minlength=n)), pa.array(base), pa.array(log10_probability(params, vocabulary, ids, sizes)), words]
                row += n
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    scored = write_table(texts.mapInArrow(run, schema), "lm-scored")
    rare = scored.select("row", F.explode("words").alias("word"))
    rare = rare.join(of_words, "word", "left").groupBy("row").agg(F.sum(F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(size)))).alias("more"), F.count("n").alias("also"))
    joined = scored.drop("words").join(rare, "row", "left")
    return joined.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("also", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score")
