"""Merkle manifest, conversation repair and token counts against brute force, the library and their edge cases."""

import hashlib
import itertools
import random
import re
import sys
import unicodedata
import zlib

import pytest

from noisegrid.llm import conversations, manifest, queries, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
TALK = "conv_id long, turn long, role string, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# 11. Manifest


def leaf(row):
    return sha(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in ("doc_id", "source", "lang", "n_chars", "text")])


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def path_of(levels, i):
    out = []
    for level in levels[:-1]:
        start = i - i % 3
        out.append(("".join(level[start:i]), "".join(level[i + 1 : start + 3])))
        i //= 3
    return out


def brute_manifest(rows):
    by = {}
    for r in rows:
        by.setdefault(r["source"], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[s] = levels_of([leaf(r) for r in by[s]])
    top = levels_of([trees[s][-1][0] for s in sources])
    root, out = top[-1][0] if sources else None, []
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            path = path_of(trees[s], i) + path_of(top, k)
            changed = dict(r)
            if r["text"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0:
                changed["text"] = r["text"].replace("\n", "")
            at = leaf(changed)
            for left, right in path:
                at = sha(left, at, right)
            out.append((r["doc_id"], leaf(r), trees[s][-1][0], root, sha(*[a + b for a, b in path]), at, at == root))
    return sorted(out, key=str)


def same_manifest(docs):
    assert sorted(map(tuple, manifest.verify(docs).collect()), key=str) == brute_manifest([r.asDict() for r in docs.collect()])


def test_manifest_equals_brute_force(spark, sf):
    same_manifest(spark.read.parquet(f"{sf}/documents.parquet"))


def test_manifest_of_odd_rows(spark):
    """Null, negative, extreme and repeated ids, equal rows, null and empty sources, a source of one row, long texts."""
    rnd = random.Random(3)
    ids = [None, -5, 7, 7, 3, 2**62, -(2**63), 2**63 - 1, 511, 512]
    rows = [(rnd.choice([*ids, rnd.randrange(10**6)]), rnd.choice([None, "", "a\nb\n", "x" * 5000]), "en", rnd.choice([None, "", "-", "s", "é"]), rnd.choice([None, 3])) for _ in range(300)]
    rows.append((1, "alone\n", None, "single", 6))
    docs = spark.createDataFrame(rows, DOCS)
    same_manifest(docs)
    same_manifest(docs.where("source = 'single'"))
    same_manifest(spark.createDataFrame([(k, "t", "en", "s", 1) for k in range(28)], DOCS))
    assert manifest.verify(docs.limit(0)).count() == 0
    clash = docs.where("source = 'single'").selectExpr("*", "1 AS key", "2 AS i", "3 AS total", "4 AS hash", "5 AS chunk", "6 AS leaf")
    assert [r.verified for r in manifest.verify(clash).collect()] == [r[-1] for r in brute_manifest([r.asDict() for r in docs.where("source = 'single'").collect()])]


def test_places_without_a_window_over_a_group(spark, monkeypatch):
    """Sparse ids of 64 bits take several rounds of ranges; a source of most rows and an id of most rows are ranked too."""
    monkeypatch.setattr(manifest, "DIGIT_BITS", 3)
    rnd = random.Random(4)
    rows = [(rnd.randrange(-(2**63), 2**63), str(k), "en", "big" if k % 5 else "small", 1) for k in range(400)]
    rows += [(77, str(k), "en", "big", 1) for k in range(200)] + [(78, "same", "en", "big", 1)] * 100
    same_manifest(spark.createDataFrame(rows, DOCS))


def test_roots_tell_what_changed(spark):
    rows = [(k, f"t{k}", "en", f"s{k % 3}", 2) for k in range(50)]
    one = {r.source: r for r in manifest.roots(spark.createDataFrame(rows, DOCS)).collect()}
    rows[4] = (4, "other", "en", "s1", 2)
    two = {r.source: r for r in manifest.roots(spark.createDataFrame(rows[::-1], DOCS)).collect()}
    assert [s for s in sorted(one) if one[s].subroot != two[s].subroot] == ["s1"] and one["s0"].root != two["s0"].root
    assert sum(r.n for r in one.values()) == 50


# 12. Conversations


def cheapest(rows):
    """The least (cost, edits) over all edits, state by state."""
    best = {0: (0, "")}
    for row in [None, *rows]:
        if row is not None:
            initial, must_go, cut = row
            new = {}
            for s, (c, e) in best.items():
                ways = [(s, c + 4, e + "D")]
                if not must_go:
                    stay, to = 3 * cut, 3 if s == 2 else 2
                    ways += [(1, c + stay, e + "K")] if initial == "s" and s == 0 else []
                    ways += [(to, c + stay, e + "K")] if initial == "ua"[to - 2] else []
                    ways.append((to, c + stay + 3, e + "R"))
                for t, *way in ways:
                    new[t] = min(new.get(t, (10**9, "")), tuple(way))
            best = new
        for _ in range(4):
            for s, (c, e) in list(best.items()):
                t = 3 if s == 2 else 2
                best[t] = min(best.get(t, (10**9, "")), (c + 3, e + "I"))
    return min(v for s, v in best.items() if s in (0, 3))


def enumerated(rows):
    """The least (cost, edits) of all edit sequences that give legal initials, written out one by one."""
    best = (10**9, "")

    def go(k, cost, edits, said, inserts):
        nonlocal best
        if k == len(rows) and re.fullmatch("(s?(ua)+)?", said):
            best = min(best, (cost, edits))
        if inserts < 2:
            for letter in "ua":
                go(k, cost + 3, edits + "I", said + letter, inserts + 1)
        if k < len(rows):
            initial, must_go, cut = rows[k]
            go(k + 1, cost + 4, edits + "D", said, 0)
            if not must_go:
                go(k + 1, cost + 3 * cut, edits + "K", said + initial, 0)
                for letter in "ua":
                    go(k + 1, cost + 3 + 3 * cut, edits + "R", said + letter, 0)

    go(0, 0, "", "", 0)
    return best


def searched(rows):
    survivors = conversations.Survivors()
    for r in rows:
        survivors.step(*r)
    return survivors.finish()


def test_survivors_find_the_cheapest_edits():
    rnd = random.Random(5)
    kinds = [(i, m, c) for i in "suat" for m, c in ((False, False), (True, False), (False, True))]
    for n in (0, 1, 2):
        for rows in itertools.product(kinds, repeat=n):
            assert searched(rows) == enumerated(rows) == cheapest(rows)
    for _ in range(3000):
        letters = rnd.choice(["sua", "ua", "u", "suat", "ssu", "a", "uuuaaas"])
        rows = [(rnd.choice(letters), rnd.random() < 0.2, rnd.random() < 0.3) for _ in range(rnd.randrange(3, 25))]
        assert searched(rows) == cheapest(rows)


def test_survivors_stay_few():
    """The tree has as many runs as survivors need, however long the conversation, and lets go of what is settled."""
    rnd = random.Random(6)
    for letters in ("ua", "suat", "u"):
        survivors = conversations.Survivors()
        for _ in range(3000):
            survivors.step(rnd.choice(letters), rnd.random() < 0.1, rnd.random() < 0.2)
            count, todo = 0, [survivors.root]
            while todo:
                node = todo.pop()
                count += 1
                todo += node.kids
            assert count <= 9
        assert len(survivors.done) + max(len(survivors._edits(n)) for _, n in survivors.best.values()) >= 3000


def crc(text):
    return zlib.crc32(text.encode())


def brute_repair(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, [])
        kind = crc(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}") % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        by[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, said in by.items():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
        faults = []
        for k, (_, role, text) in enumerate(said):
            seen = text.strip(" \t\n\v\f\r")
            faults.append("blank" if not seen else "duplicate" if (role, text) in [r[1:] for r in said[:k]] else "truncated" if seen[-1] not in ".!?" else None)
        cost, edits = cheapest([(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(said, faults, strict=True)])
        lines, state, left = [], "", list(said)
        for e in edits:
            want = "assistant" if state == "u" else "user"
            role, text = ("", "") if e == "I" else left.pop(0)[1:]
            if e != "D":
                role = role if e == "K" else want
                lines.append(f"{role}:{text}")
                state = role[0]
        turns = {r[0] for r in said} - {None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, edits, sha("\n".join(lines))))
    return sorted(out, key=str)


def same_repair(frame):
    assert sorted(map(tuple, conversations.repair(frame).collect()), key=str) == brute_repair([tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()])


def test_repair_equals_brute_force(spark, sf):
    same_repair(spark.read.parquet(f"{sf}/conversations.parquet"))
    same_repair(spark.read.parquet(f"{sf.replace('0.001', '0.01')}/conversations.parquet"))


def test_repair_of_odd_rows(spark):
    """Nulls anywhere, repeated rows and turns, unknown roles, gaps, conversations that lose all rows, a very long one."""
    rnd = random.Random(8)
    roles, texts = ["user", "assistant", "system", "tool", "User", "", None], ["Hi.", "hi", None, "", " \n", "What?", "été!", "same.", "x." * 9000]
    rows = [(rnd.choice([None, 1, 2, 3, *range(4, 90)]), rnd.choice([None, 0, 1, 2, 5, 9, -3]), rnd.choice(roles), rnd.choice(texts)) for _ in range(700)]
    rows += [(1000 + k, 0, "user", "gone?") for k in range(80)]
    rows += [(5000, k, rnd.choice(["user", "user", "assistant", "system"]), rnd.choice(["a.", "b", f"{k}.", ""])) for k in range(1500)]
    same_repair(spark.createDataFrame(rows, TALK))
    empty = spark.createDataFrame([], TALK)
    assert conversations.repair(empty).count() == 0
    clash = spark.createDataFrame(rows[:50], TALK).selectExpr("*", "1 AS kind", "2 AS audit", "3 AS digest", "4 AS faults", "5 AS c", "6 AS dropped", "7 AS copy")
    same_repair(clash)
    gone = [r for r in conversations.repair(spark.createDataFrame(rows, TALK)).collect() if (r.conv_id or 0) >= 1000 and r.audit == ""]
    assert gone and all(r.repaired_sha256 == sha("") and r.cost == 0 for r in gone)


def test_repaired_rows_are_legal(spark, sf):
    rows = conversations.damaged(spark.read.parquet(f"{sf}/conversations.parquet"))
    found = conversations.audits(conversations.with_faults(rows))
    by = {}
    for r in conversations.repaired(rows, found).collect():
        by.setdefault(r.conv_id, []).append(r)
    digests = {r.conv_id: r.repaired_sha256 for r in conversations.digests(rows, found).collect()}
    for conv, said in by.items():
        said.sort(key=lambda r: r.turn)
        assert re.fullmatch("s?(ua)+", "".join(r.role[0] for r in said))
        assert digests[conv] == sha("\n".join(f"{r.role}:{r.text}" for r in said))


# 13. Token counts


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(public_tokenizers.path(tokens.BYTE_BPE)))


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return tokens.load(str(public_tokenizers.path(tokens.BYTE_BPE)))


def by_library(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


ODD_TEXTS = [
    "", " ", "  \n\t x  ", "<|endoftext|>", "a <|endoftext|>\n\n b <|endoftext", "'s'S don't I'LL we'll'", "é" * 3000, "ab" * 20000, "\x1c\x1d \x85　 a",
    "日本語テキスト 123½ ²", "\x00\x01", " " * 50000, "՘ ꟎ x\U0003fc3b", "a\U0001fae9b", "Ġ Ċ", "x\r\n\r\ny", "👩‍👩‍👧", "<|endoftext|><|endoftext|>",
]


def test_counts_equal_the_library(spark, sf, library, monkeypatch):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ODD_TEXTS
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, None), (1, texts[1])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, c int, n_tokens int")
    got = sorted(tuple(r)[:4] for r in tokens.count_tokens(frame).collect() if r.doc_id is not None)
    want = sorted((k, len(t.encode()), n := by_library(library, t), n > 512) for k, t in rows if t is not None)
    assert got == want
    (null,) = [r for r in tokens.count_tokens(frame).collect() if r.doc_id is None]
    assert (null.n_bytes, null.n_tokens, null.over_limit) == (0, 0, False)
    assert tokens.count_tokens(frame.limit(0)).count() == 0


def test_long_texts_are_taken_piece_by_piece(vocabulary, monkeypatch):
    whole = [tokens.Counter(vocabulary).count(t) for t in ODD_TEXTS]
    monkeypatch.setattr(tokens, "LONG_TEXT", 3)
    monkeypatch.setattr(tokens.Merged, "most", 2)
    assert [tokens.Counter(vocabulary).count(t) for t in ODD_TEXTS] == whole


def test_whole_tokens_are_proven(vocabulary, library):
    strings = random.Random(1).sample(sorted(vocabulary.whole), 3000)
    for s in strings:
        encoded = library.model.tokenize("".join(tokens.byte_alphabet()[b] for b in s.encode()))
        assert len(encoded) == 1
    assert len(vocabulary.whole) > 45_000
    n, whole, count = tokens.Counter(vocabulary).count("the quick brown fox, zxqvj")
    assert (n, whole) == (6, 5) and count == by_library(library, "the quick brown fox, zxqvj")


def test_character_classes_are_those_of_the_library(vocabulary, library):
    """All characters that this Python knows, each between letters, digits, signs and spaces."""
    counter = tokens.Counter(vocabulary)
    known = [chr(c) for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) not in ("Cn", "Cs", "Co")]
    for k in range(0, len(known), 20_000):
        text = "".join(f"a{c}1{c}.{c} {c}{c}b" for c in known[k : k + 20_000])
        ends = [e for _, (_, e) in library.pre_tokenizer.pre_tokenize_str(text)]
        assert [m.end() for m in counter.pieces.finditer(text)] == ends


def test_other_vocabularies_are_refused():
    import public_tokenizers

    with pytest.raises(ValueError, match="byte-level"):
        tokens.load(str(public_tokenizers.path("word_bpe_49k.json")))


@pytest.mark.parametrize("name", ["op11_manifest", "op12_conversations"])
def test_sql_agrees(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(tuple, got.select(names).collect()), key=str) == sorted(want.fetchall(), key=str)
