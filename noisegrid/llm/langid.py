"""Language identification: word log frequencies first, shorter and shorter character n-grams for unseen words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noisegrid.llm._common import held_out, most_frequent, write_table

LONGEST = 4
_WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def letters(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    return _WORD.findall((text or "").lower())


def grams(word: str, n: int) -> list[str]:
    padded = f"_{word}_"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


@dataclass
class Model:
    """Languages in order, and a row of per-language log frequencies for each word and each n-gram."""

    languages: list[str]
    words: dict[str, int]
    grams: list[dict[str, int]]
    rows: np.ndarray

    def of_unseen(self, word: str) -> np.ndarray:
        """The mean over the word's n-grams of the greatest length of which any is known; zero if none is."""
        for n in range(LONGEST, 0, -1):
            known = self.grams[n]
            found = [known[g] for g in grams(word, n) if g in known]
            if found:
                return self.rows[found].mean(axis=0)
        return np.zeros(self.rows.shape[1], np.float32)


def counts(rows: DataFrame, most_held: int = 400_000) -> DataFrame:
    """(text, lang) -> (lang, length, gram, n): words have length 0. Tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            more: Counter = Counter()
            for (lang, word), n in held.items():
                for k in range(1, LONGEST + 1):
                    for g in grams(word, k):
                        more[lang, k, g] += n
            cols = [(lang, 0, w, n) for (lang, w), n in held.items()] + [(*k, n) for k, n in more.items()]
            held.clear()
            lists = list(zip(*cols, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(lists[0], pa.string()), pa.array(lists[1], pa.int32()), pa.array(lists[2], pa.string()), pa.array(lists[3], pa.int64())], ["lang", "length", "gram", "n"])

        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang"), strict=True):
                lang = lang.as_py()
                held.update((lang, w) for w in letters(text.as_py()))
                if len(held) > most_held:
                    yield flush()
        yield flush()

    return rows.select("text", "lang").mapInArrow(run, "lang string, length int, gram string, n long").groupBy("lang", "length", "gram").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, most_docs: int = 16_000, most_words: int = 120_000, most_grams: int = 60_000) -> Model:
    """A model from about most_docs documents at most, chosen by a hash of the id.

    Only text and lang of documents whose crc32(doc_id) mod 4 is not 2 teach; rows without a text or lang are left
    out. The most frequent words and n-grams that occur twice or more are kept, most_words and most_grams of them.
    """
    usable = docs.where(~held_out(F.col("doc_id"), 4) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = usable.count()
    if n > most_docs:
        usable = usable.where(F.pmod(F.xxhash64(F.lit("lang"), "doc_id"), F.lit(1 << 20)) < int((1 << 20) * most_docs / n))
    found = write_table(counts(usable).where("n > 1 or length = 1"), "lang-counts")
    table = most_frequent(found.where("length = 0"), "n", most_words).union(most_frequent(found.where("length > 0"), "n", most_grams))
    table = table.toPandas().sort_values(["length", "gram", "lang"])
    languages = sorted(table["lang"].unique())
    place = {x: i for i, x in enumerate(languages)}
    totals = np.zeros((LONGEST + 1, max(1, len(languages))))
    index: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
    size = 0
    for k, g in zip(table["length"], table["gram"], strict=True):
        if g not in index[k]:
            index[k][g] = size
            size += 1
    rows = np.full((size, max(1, len(languages))), 0.5)
    kind = np.zeros(size, np.int64)
    for lang, k, g, n in zip(table["lang"], table["length"], table["gram"], table["n"], strict=True):
        rows[index[k][g], place[lang]] += n
        kind[index[k][g]] = k
    for k in range(LONGEST + 1):
        totals[k] = rows[kind == k].sum(axis=0) if (kind == k).any() else 1
    return Model(languages, index[0], index, np.log(rows / totals[kind]).astype(np.float32))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document, by its whole text.

    score is the language's share of the likelihood. A null text, one without a letter, and any text if nothing was
    learned give `und` and score 0; ties go to the first language in order.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        base, most = len(model.rows), 100_000
        rows = np.vstack([model.rows, np.zeros((most + 1, model.rows.shape[1]), np.float32)])
        lettered = np.ones(len(rows), bool)

        class Places(dict):
            """Rows of words; unseen words get one of their own, until there are too many."""

            def __missing__(self, word: str) -> int:
                at = base + len(self) - known
                rows[at] = model.of_unseen(word)
                lettered[at] = any(c.isalpha() for c in word)
                if not lettered[at]:
                    rows[at] = 0
                self[word] = at
                return at

        known, places = len(model.words), Places(model.words)
        for batch in batches:
            preds, scores = [], []
            for text in batch.column("text"):
                found = letters(text.as_py())
                total, any_letter = np.zeros(rows.shape[1]), False
                for k in range(0, len(found), 50_000):
                    if len(places) - known > most - 50_000:
                        places = Places(model.words)
                    i = np.fromiter(map(places.__getitem__, found[k : k + 50_000]), np.int64)
                    total += rows[i].sum(axis=0, dtype=np.float64)
                    any_letter |= bool(lettered[i].any())
                if not any_letter or not model.languages:
                    preds.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                best = int(np.argmax(total))
                preds.append(model.languages[best])
                scores.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
