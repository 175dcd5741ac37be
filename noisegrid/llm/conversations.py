"""Repair the structure of conversations: the cheapest edits that give role initials `(s?(ua)+)?`.

A Viterbi search over four states (nothing yet, after s, after u, after a) reads a conversation's rows as a stream. Its
survivors form a tree of backpointers with reference counts; as soon as all survivors share an ancestor, the edits up to
it are final and leave the tree. What is unresolved is kept at one byte an edit, so that equally cheap survivors are
compared over their whole unresolved suffixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noisegrid.llm._common import BLANKS, write_table

#: Costs of the edits; a truncated row that stays adds TRUNCATED.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: The states from which a user's or an assistant's turn may follow, and the role that follows each state.
BEFORE = {"u": (START, SYSTEM, ASSISTANT), "a": (USER,)}
EXPECTED = {START: "user", SYSTEM: "user", ASSISTANT: "user", USER: "assistant"}
LEGAL_PAIRS = {"su", "ua", "au"}
#: Faults as bits.
DROPPED, BLANK, DUPLICATE, CUT = 1, 2, 4, 8


class Node:
    """A run of edits between two forks of the survivors' tree."""

    __slots__ = ("edits", "held", "kids", "parent")

    def __init__(self, parent: Node | None, edits: bytes):
        self.parent, self.edits = parent, bytearray(edits)
        self.kids: list[Node] = []
        self.held = False
        if parent is not None:
            parent.kids.append(self)


class Survivors:
    """The best way to each state; ties go to the edits that are least in ASCII order."""

    def __init__(self):
        self.done = bytearray()
        self.root = Node(None, b"")
        start = Node(self.root, b"")
        start.held = True
        self.best: dict[int, tuple[int, Node]] = {START: (0, start)}
        self._insert()
        self._settle()

    def step(self, initial: str, must_go: bool, truncated: bool) -> None:
        """Read one row: its role's initial, whether it has to be deleted, and whether staying costs more."""
        ways: dict[int, tuple[int, Node, bytes]] = {}

        def offer(state: int, cost: int, node: Node, edit: bytes) -> None:
            known = ways.get(state)
            if known is None or cost < known[0] or (cost == known[0] and self._less(node, edit, known[1], known[2])):
                ways[state] = (cost, node, edit)

        stay = TRUNCATED if truncated else 0
        for state, (cost, node) in self.best.items():
            offer(state, cost + DELETE, node, b"D")
            if must_go:
                continue
            if initial == "s" and state == START:
                offer(SYSTEM, cost + stay, node, b"K")
            for to, letter in ((USER, "u"), (ASSISTANT, "a")):
                if state in BEFORE[letter]:
                    offer(to, cost + stay + (0 if initial == letter else REROLE), node, b"K" if initial == letter else b"R")
        before = [node for _, node in self.best.values()]
        self.best = {}
        for state, (cost, node, edit) in ways.items():
            kid = Node(node, edit)
            kid.held = True
            self.best[state] = (cost, kid)
        for node in before:
            node.held = False
            self._free(node)
        self._insert()
        self._drop_hopeless()
        self._settle()

    def finish(self) -> tuple[int, str]:
        """The cost and the edits of the best accepted way."""
        _, (cost, node) = min(((s, self.best[s]) for s in (START, ASSISTANT) if s in self.best), key=lambda way: (way[1][0], self._edits(way[1][1])))
        return cost, (self.done + self._edits(node)).decode()

    def _insert(self) -> None:
        """Turns inserted after the last row: a user's first, then an assistant's, as two of each never pay."""
        for to, letter in ((USER, "u"), (ASSISTANT, "a")):
            for state in BEFORE[letter]:
                if state in self.best:
                    cost, node = self.best[state][0] + INSERT, self.best[state][1]
                    known = self.best.get(to)
                    if known is None or cost < known[0] or (cost == known[0] and self._less(node, b"I", known[1], b"")):
                        kid = Node(node, b"I")
                        kid.held = True
                        self.best[to] = (cost, kid)
                        if known is not None:
                            known[1].held = False
                            self._free(known[1])

    def _drop_hopeless(self) -> None:
        """From ASSISTANT all goes on that goes on from SYSTEM, and from START for DELETE more at most: a state that
        costs more than that can't win any longer."""
        if ASSISTANT in self.best:
            least = self.best[ASSISTANT][0]
            for state, more in ((START, DELETE), (SYSTEM, 0)):
                if state in self.best and self.best[state][0] > least + more:
                    node = self.best.pop(state)[1]
                    node.held = False
                    self._free(node)

    def _free(self, node: Node) -> None:
        """Let go of a node that nothing refers to, and of its ancestors as far as that frees them."""
        while node is not self.root and not node.held and not node.kids:
            node.parent.kids.remove(node)
            node = node.parent

    def _settle(self) -> None:
        """Join runs that don't fork, and move what all survivors share out of the tree."""
        for _, node in self.best.values():
            while (up := node.parent) is not self.root and not up.held and len(up.kids) == 1:
                up.edits += node.edits
                node.edits, node.parent = up.edits, up.parent
                up.parent.kids[up.parent.kids.index(up)] = node
            self._settle_above(node.parent)
        while len(self.root.kids) == 1:
            only = self.root.kids[0]
            self.done += only.edits
            only.edits = bytearray()
            if only.held:
                break
            self.root, only.parent = only, None

    def _settle_above(self, node: Node | None) -> None:
        while node is not None and node is not self.root:
            up = node.parent
            if up is not self.root and not up.held and len(up.kids) == 1:
                up.edits += node.edits
                node.edits, node.parent = up.edits, up.parent
                up.parent.kids[up.parent.kids.index(up)] = node
            else:
                node = up

    def _chain(self, node: Node) -> list[Node]:
        out = []
        while node is not None:
            out.append(node)
            node = node.parent
        return out[::-1]

    def _edits(self, node: Node) -> bytes:
        return b"".join(bytes(n.edits) for n in self._chain(node))

    def _less(self, a: Node, a_edit: bytes, b: Node, b_edit: bytes) -> bool:
        """Whether the edits to a, then a_edit, come before those to b, then b_edit. Below the last shared node the
        first edits differ, as a state and an edit give one next state; so runs are seldom read further."""
        left, right = self._chain(a), self._chain(b)
        k = 0
        while k < min(len(left), len(right)) and left[k] is right[k]:
            k += 1
        heads = [next((n.edits[:1] for n in rest if n.edits), edit[:1]) for rest, edit in ((left[k:], a_edit), (right[k:], b_edit))]
        if heads[0] != heads[1]:
            return heads[0] < heads[1]
        return b"".join([*(bytes(n.edits) for n in left[k:]), a_edit]) < b"".join([*(bytes(n.edits) for n in right[k:]), b_edit])


# Rows and their faults


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped) after the damage that crc32(`conv_id:turn`) mod 20 deals: 0 drops a row, 1
    empties its text, 2 removes `[.!?]`, 3 repeats it, 4 sets role user. Null roles, texts and parts of the key are one
    space. Dropped rows stay as marks, so that no conversation is lost."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", space)
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", space)).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("dropped"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def identity() -> Column:
    """A digest by which rows of equal role and text are known."""
    return F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, faults): faults has the bits of a row's first fault, without copies within a turn.

    The first turn of what a conversation says more than once is found by a grouped minimum before the shuffle; rows
    join only what is repeated, and leave their texts behind.
    """
    seen = F.rtrim("text", F.lit(BLANKS))
    own = F.when(F.col("dropped"), DROPPED).when(seen == "", BLANK).when(~F.right(seen, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(0)
    rows = rows.select("conv_id", "turn", "role", F.unhex(identity()).alias("digest"), own.cast("int").alias("own"))
    at = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))
    said = rows.where(F.col("own") != DROPPED).groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(said, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    again = F.col("own").isin(0, CUT) & F.coalesce(F.col("first") < at, F.lit(False))
    return rows.select("conv_id", "turn", "role", "digest", F.when(again, DUPLICATE).otherwise(F.col("own")).cast("int").alias("faults"))


def in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Each conversation's rows next to each other, by turn (null first); rows of one turn by role and text digest."""
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", *first, "turn", "role", "digest")]
    return rows.repartition("conv_id").sortWithinPartitions(*order)


# Streams


class Audit:
    """One conversation read row by row."""

    def __init__(self):
        self.survivors = Survivors()
        self.counts = {BLANK: 0, DUPLICATE: 0, CUT: 0}
        self.illegal = self.turns = 0
        self.first = self.last = self.initial = self.same = None

    def read(self, turn: int | None, role: str, digest: bytes, faults: int) -> None:
        if faults == DROPPED:
            return
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn
        if (turn, role, digest) == self.same and faults != BLANK:
            faults = DUPLICATE
        self.same = (turn, role, digest)
        if faults:
            self.counts[faults] += 1
        if self.initial is not None and self.initial + role[:1] not in LEGAL_PAIRS:
            self.illegal += 1
        self.initial = role[:1]
        self.survivors.step(role[:1], faults in (BLANK, DUPLICATE), faults == CUT)

    def result(self) -> tuple:
        gaps = self.last - self.first + 1 - self.turns if self.turns else 0
        cost, edits = self.survivors.finish()
        return gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[CUT], self.illegal, cost, edits


AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(faulty: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) for every conversation of with_faults()."""
    schema = f"conv_id {faulty.schema['conv_id'].dataType.simpleString()}, {AUDIT}"
    names = ["conv_id", *[f.split()[0] for f in AUDIT.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, out = None, None, []

        def flush(found: list) -> pa.RecordBatch:
            types = [conv_type, *[pa.int64()] * 6, pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for c, turn, role, digest, faults in zip(*[batch.column(k).to_pylist() for k in range(5)], strict=True):
                if audit is None or c != conv:
                    if audit is not None:
                        out.append((conv, *audit.result()))
                    conv, audit = c, Audit()
                audit.read(turn, role, digest, faults)
            if out:
                yield flush(out)
                out = []
        if audit is not None:
            yield flush([(conv, *audit.result())])

    return in_order(faulty).mapInArrow(run, schema)


class Repair:
    """Applies one conversation's edits to its rows; what is repaired goes to `emit` as (role, text), turn by turn."""

    def __init__(self, edits: str, emit):
        self.edits, self.at, self.state, self.emit = edits, 0, START, emit

    def _inserted(self) -> None:
        while self.edits[self.at : self.at + 1] == "I":
            self.at += 1
            self._go(EXPECTED[self.state], "")

    def _go(self, role: str, text: str) -> None:
        self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
        self.emit(role, text)

    def read(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.edits[self.at]
        self.at += 1
        if edit != "D":
            self._go(role if edit == "K" else EXPECTED[self.state], text)

    def finish(self) -> None:
        self._inserted()


class Digest:
    """SHA-256 of `role:text` lines as they come."""

    def __init__(self):
        self.hash, self.some = hashlib.sha256(), False

    def __call__(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
        self.some = True


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows in order."""
    rows = rows.where(~F.col("dropped")).select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.unhex(identity()).alias("digest"), "text", F.lit(None).cast("string").alias("audit"))
    heads = found.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.unhex(F.lit("")).alias("digest"), F.lit("").alias("text"), "audit")
    return in_order(heads.unionByName(rows), "kind")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the digest of each repaired conversation. A task reads its rows as a stream and holds
    one batch and one conversation's edits; a digest can't be split, so a conversation's repaired text passes one task."""
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, repair, digest = None, None, None

        def end() -> tuple:
            repair.finish()
            return conv, digest.hash.hexdigest()

        def flush(out: list, conv_type) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], conv_type), pa.array([o[1] for o in out], pa.string())], ["conv_id", "repaired_sha256"])

        for batch in batches:
            out, conv_type = [], batch.schema.field("conv_id").type
            for c, kind, role, text, audit in zip(*[batch.column(k).to_pylist() for k in ("conv_id", "kind", "role", "text", "audit")], strict=True):
                if kind == 0:
                    if repair is not None:
                        out.append(end())
                    digest = Digest()
                    conv, repair = c, Repair(audit, digest)
                else:
                    repair.read(role, text)
            if out:
                yield flush(out, conv_type)
        if repair is not None:
            yield flush([end()], conv_type)

    return _with_audits(rows, found).mapInArrow(run, schema)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the repaired conversations themselves, turns numbered anew from 0."""
    schema = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, turn long, role string, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, repair, turn, out, conv_type = None, None, 0, [], None

        def emit(role: str, text: str) -> None:
            nonlocal turn
            out.append((conv, turn, role, text))
            turn += 1

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (conv_type, pa.int64(), pa.string(), pa.string()), strict=True)], ["conv_id", "turn", "role", "text"])

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for c, kind, role, text, audit in zip(*[batch.column(k).to_pylist() for k in ("conv_id", "kind", "role", "text", "audit")], strict=True):
                if kind == 0:
                    if repair is not None:
                        repair.finish()
                    conv, repair, turn = c, Repair(audit, emit), 0
                else:
                    repair.read(role, text)
            if out:
                yield flush()
        if repair is not None:
            repair.finish()
            if out:
                yield flush()

    return _with_audits(rows, found).mapInArrow(run, schema)


def repair(conversations: DataFrame) -> DataFrame:
    """Damage, audit and repair (conv_id, turn, role, text): a row for every conv_id of the input.

    Of a row's faults the first counts: blank, duplicate (role and text seen earlier in the conversation), truncated.
    Edits cost: Keep 0, Rerole 3, Delete 4 (blank and duplicate rows must go), Insert 3, and 3 more for a truncated row
    that stays; `audit` has the initials of the cheapest edits, the ASCII-least of equally cheap ones.

    Null conv_ids are one conversation, null turns come first, null roles and texts are one space. Rows of one turn
    stand by role, then by a digest of their text; repeated rows are duplicates. A role without an initial or with
    another one than s, u and a can't be kept as it is. An empty table gives no rows; other columns are left out.
    """
    rows = damaged(conversations)
    found = write_table(audits(with_faults(rows)), "conversation-audits")
    texts = digests(rows, found).withColumnRenamed("conv_id", "of")
    return found.join(texts, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
