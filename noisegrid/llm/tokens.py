"""Token counts of whole texts: proven whole tokens are counted as they stand, only the other pre-tokens are merged.

A byte-level BPE vocabulary has strings that, standing alone as a pre-token, merge into one token. Which ones is proven
once, on the driver, by merging every string of the vocabulary; most pre-tokens of a text are among them and cost one
look-up. What is left is merged pair by pair, and each task keeps what it has merged.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The vocabulary file of the default.
BYTE_BPE = "byte_bpe_50k.json"
LIMIT = 512
#: Fixed value: the pattern by which byte-level vocabularies cut a text into pre-tokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens of longer texts are taken one by one, not as a list.
LONG_TEXT = 1_000_000


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a vocabulary: itself if it can be printed, else one from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(shown)]
    return [chr(b if b in shown else 256 + others.index(b)) for b in range(256)]


def merge_count(piece: str, ranks: dict[tuple[str, str], int]) -> int:
    """How many tokens a pre-token has, in vocabulary characters: the pair of least rank merges first, the leftmost of
    equal ones. Pairs wait in a heap, so that a pre-token of n bytes takes n log n steps."""
    parts: list[str | None] = list(piece)
    n = left = len(parts)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    waiting = [(rank, i) for i in range(n - 1) if (rank := ranks.get((parts[i], parts[i + 1]))) is not None]
    heapify(waiting)
    while waiting:
        rank, i = heappop(waiting)
        j = after[i]
        if parts[i] is None or j >= n or ranks.get((parts[i], parts[j])) != rank:
            continue
        parts[i], parts[j] = parts[i] + parts[j], None
        left -= 1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for a, b in ((before[i], i), (i, after[i])):
            if a >= 0 and b < n and (again := ranks.get((parts[a], parts[b]))) is not None:
                heappush(waiting, (again, a))
    return left


@dataclass
class Vocabulary:
    """What tasks need of a vocabulary file; it is sent once to each executor and is as large as the file."""

    source: str
    ranks: dict[tuple[str, str], int]
    special: list[str]
    whole: frozenset[str] = field(default_factory=frozenset)


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """Read a tokenizer's JSON file on the driver and prove which of its strings are whole tokens.

    A file that isn't byte-level BPE with the pattern above and plain merges is refused.
    """
    with open(path, encoding="utf-8") as f:
        source = f.read()
    spec = json.loads(source)
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    level = cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space")
    strict = not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if not (plain and level and strict and spec["normalizer"] is None):
        raise ValueError(f"{path} is not plain byte-level BPE")
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
    special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
    return Vocabulary(source, ranks, special, prove_whole(model["vocab"], ranks))


def prove_whole(strings, ranks: dict[tuple[str, str], int]) -> frozenset[str]:
    """Of a vocabulary's strings those that are UTF-8 and, alone in a pre-token, merge into one token, as text."""
    bytes_of = {c: b for b, c in enumerate(byte_alphabet())}
    out = set()
    for s in strings:
        if all(c in bytes_of for c in s) and merge_count(s, ranks) == 1:
            try:
                out.add(bytes(bytes_of[c] for c in s).decode())
            except UnicodeDecodeError:
                pass
    return frozenset(out)


class Merged(dict):
    """Pre-token -> its number of tokens, for those that are no whole tokens. When `most` are held they become the older
    half, from which what is met again comes back; the older half before them is let go."""

    most, longest = 400_000, 100

    def __init__(self, ranks: dict[tuple[str, str], int]):
        self.ranks, self.chars, self.older = ranks, byte_alphabet(), {}

    def __missing__(self, piece: str) -> int:
        n = self.older.get(piece) or merge_count("".join([self.chars[b] for b in piece.encode()]), self.ranks)
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = n
        return n


class Counter:
    """Counts a text's pre-tokens, whole tokens and tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.merged = vocabulary, Merged(vocabulary.ranks)
        self.pieces = regex.compile(PATTERN)
        self.special = re.compile("|".join(map(re.escape, vocabulary.special)) or r"(?!)")
        self.library = None
        self.known_chars: set[str] = set()

    def count(self, text: str) -> tuple[int, int, int]:
        """(pre-tokens, those that are whole tokens, tokens). A special string is one of each."""
        if not text.isascii() and self.has_new_chars(text):
            return self.by_library(text)
        parts = self.special.split(text)
        n = whole = tokens = len(parts) - 1
        known, merged = self.vocabulary.whole, self.merged
        for part in parts:
            if len(part) > LONG_TEXT:
                for m in self.pieces.finditer(part):
                    n += 1
                    if m.group() in known:
                        whole += 1
                        tokens += 1
                    else:
                        tokens += merged[m.group()]
            else:
                found = self.pieces.findall(part)
                rest = [p for p in found if p not in known]
                n += len(found)
                whole += len(found) - len(rest)
                tokens += len(found) - len(rest) + sum(map(merged.__getitem__, rest))
        return n, whole, tokens

    def has_new_chars(self, text: str) -> bool:
        """Whether a character has no category in this Python: libraries of another age may take it for a letter or not."""
        fresh = {c for c in set(text) - self.known_chars if unicodedata.category(c) != "Cn"}
        self.known_chars |= fresh
        return not self.known_chars.issuperset(text)

    def by_library(self, text: str) -> tuple[int, int, int]:
        """A text with characters that are newer than this Python, as the library itself cuts it."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.vocabulary.source)
            self.library.no_truncation()
            self.library.no_padding()
        words = self.library.encode(text, add_special_tokens=False).word_ids
        return len(set(words)), 0, len(words)


def counter_of(vocabulary: Vocabulary) -> Counter:
    """The counter of a vocabulary in this process, with what earlier tasks have merged."""
    if not hasattr(vocabulary, "counter"):
        vocabulary.counter = Counter(vocabulary)
    return vocabulary.counter


def counts(text: Column, vocabulary: Vocabulary, session) -> Column:
    """struct(n_pieces, n_whole, n_tokens) of a text, null as empty. The vocabulary is broadcast: it is as large as its
    file, whatever the number of texts."""
    sent = session.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("n_pieces long, n_whole long, n_tokens long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = counter_of(sent.value)
        for texts in batches:
            yield pd.DataFrame([counter.count(t) for t in texts], columns=["n_pieces", "n_whole", "n_tokens"], dtype="int64")

    return run(F.coalesce(text, F.lit("")))


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_pieces, n_whole) for every document's whole text.

    `path` names the vocabulary file, by default that of the installed package. A null text is empty: no bytes, no
    tokens. Rows that repeat an id are counted one by one, rows without an id too; an empty table gives no rows; other
    columns are left out. Special strings inside texts are one token each. Nothing is shuffled; a task holds one batch
    and at most twice `Merged.most` merged pre-tokens.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(BYTE_BPE)
    rows = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), counts(F.col("text"), load(str(path)), docs.sparkSession).alias("c"))
    return rows.select("doc_id", "n_bytes", F.col("c.n_tokens"), (F.col("c.n_tokens") > limit).alias("over_limit"), F.col("c.n_pieces"), F.col("c.n_whole"))
