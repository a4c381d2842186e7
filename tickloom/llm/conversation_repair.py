"""Conversation structure repair by cheapest audited edits.

A conversation's rows, in order of turn, are mended so that their roles read: nothing, or an optional system row and then
user and assistant rows in alternation, ending with the assistant. Edits of a row: Keep (0), Rerole to user or assistant (3),
Delete (4; blank and duplicate rows must go); anywhere an empty user or assistant row may be Inserted (3). A truncated row
that isn't deleted adds 3. The audit is the string of the initials of the cheapest edits, the least of those that cost the
same; it determines the repaired rows.

The search goes row by row over four states (nothing yet, after system, after user, after assistant) and keeps for each state
the cheapest edits so far. Edits so far are nodes of a tree linked to the edit before: a common beginning is held once. Each node
has links to its 1st, 2nd, 4th, ... ancestor and a rolling hash of its whole string. Equal costs are told apart by the
longest common prefix, found by descending the links on hashes, and the edit after it. A hash leads to one node only: a new
node whose hash is taken by another string (its edit or its parent differ) moves on to the next free number, so equal
hashes are equal strings. Two strings for the same rows and state with one cost are never prefixes of each other (the rest
would be insertions, which cost), so the lesser prefix stays the lesser whatever follows.

Rows are dealt by ranges of (conversation, turn), and a conversation that spans several ranges or more than BLOCK_ROWS rows is
searched in blocks: each block gives the best edits from every state to every state, and blocks are then joined in order. Only
edits, costs and counts of a block travel there. What a single task holds of one conversation is its audit, which is also
one cell of the result. Texts stay with their ranges and meet their edits by row number; only the digest reads them in order.

Defined cases: null role and text are one space; a null turn comes first and counts in no gap; rows of one turn are ordered by
role and text (the first 64 characters of both, then the rest); rows that repeat are duplicates; an empty role fits nowhere;
null conv_id is a conversation like any other; a gap beyond 2^63 - 1 is that number; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import stage

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
BLOCK_ROWS = 8192
#: Characters of role and text by which rows of one turn are dealt to ranges.
ORDERED_BY = 64

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ENDS = (START, ASSISTANT)
#: The state after the next user or assistant row that fits, and after a kept row by its initial.
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = ("su", "ua", "au")
ROLES = {USER: "user", ASSISTANT: "assistant"}

BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
FAULTS = (BLANK, DUPLICATE, TRUNCATED)
_VISIBLE = r"[^\x20\x09-\x0D]"
_MOST = (1 << 63) - 1


# Strings of edits ----------------------------------------------------------------------------------------------------


class Edits:
    """Strings of edits as nodes of one tree. Node 0 is the empty string; equal strings are one node."""

    PRIME = (1 << 61) - 1
    BASE = 0x1F3A5C7E9B2D4F61 % PRIME

    def __init__(self, hashed: Callable[[int, str], int] | None = None):
        self.hashed = hashed or (lambda before, edit: (before * self.BASE + ord(edit)) % self.PRIME)
        self.parent, self.edit, self.depth, self.hash = [0], [""], [0], [1]
        self.up: list[list[int]] = [[]]  # 1st, 2nd, 4th, ... ancestor as far as there are any
        self.place = {1: 0}

    def add(self, parent: int, edit: str) -> int:
        number = self.hashed(self.hash[parent], edit)
        while (at := self.place.get(number)) is not None:
            if self.parent[at] == parent and self.edit[at] == edit:
                return at
            number += 1  # taken by another string
        node = self.place[number] = len(self.parent)
        self.parent.append(parent), self.edit.append(edit), self.depth.append(self.depth[parent] + 1), self.hash.append(number)
        up, k = [parent], 0
        while k < len(self.up[up[k]]):
            up.append(self.up[up[k]][k])
            k += 1
        self.up.append(up)
        return node

    def _ancestor(self, node: int, depth: int) -> int:
        more = self.depth[node] - depth
        while more:
            k = more.bit_length() - 1
            node, more = self.up[node][k], more - (1 << k)
        return node

    def less(self, x: int, y: int) -> bool:
        """Whether the string of x comes before that of y."""
        depth = min(self.depth[x], self.depth[y])
        a, b = self._ancestor(x, depth), self._ancestor(y, depth)
        if self.hash[a] == self.hash[b]:
            return self.depth[x] < self.depth[y]
        for k in range(len(self.up[a]) - 1, -1, -1):
            if k < len(self.up[a]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                a, b = self.up[a][k], self.up[b][k]
        return self.edit[a] < self.edit[b]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.parent[node]
        return "".join(reversed(out))


class Search:
    """Cheapest edits from one state to each state, over the rows given so far."""

    def __init__(self, entry: int, edits: Edits):
        self.edits = edits
        self.best: dict[int, tuple[int, int]] = {entry: (0, 0)}

    def _offer(self, best: dict, state: int, cost: int, node: int, edit: str) -> None:
        now = best.get(state)
        if now is None or cost < now[0]:
            best[state] = (cost, self.edits.add(node, edit))
        elif cost == now[0]:
            other = self.edits.add(node, edit)
            if self.edits.less(other, now[1]):
                best[state] = (cost, other)

    def insertions(self) -> None:
        """At most two rows inserted; three lead nowhere that one does not."""
        best = dict(self.best)
        for state, (cost, node) in self.best.items():
            once = NEXT[state]
            self._offer(best, once, cost + INSERT_COST, node, INSERT)
            self._offer(best, NEXT[once], cost + 2 * INSERT_COST, self.edits.add(node, INSERT), INSERT)
        self.best = best

    def row(self, initial: str, fault: str) -> None:
        self.insertions()
        best: dict[int, tuple[int, int]] = {}
        more = TRUNCATED_COST if fault == TRUNCATED else 0
        kept = KEPT.get(initial, {})
        for state, (cost, node) in self.best.items():
            self._offer(best, state, cost + DELETE_COST, node, DELETE)
            if fault not in (BLANK, DUPLICATE):
                self._offer(best, NEXT[state], cost + REROLE_COST + more, node, REROLE)
                if state in kept:
                    self._offer(best, kept[state], cost + more, node, KEEP)
        self.best = best


# Blocks of a conversation -----------------------------------------------------------------------------------------------


class _Block:
    def __init__(self, key: int | None, at: int, entries):
        self.key, self.at, self.rows = key, at, 0
        self.counts = dict.fromkeys(FAULTS, 0)
        self.illegal = self.turns = 0
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None
        self.edits = Edits()
        self.searches = {entry: Search(entry, self.edits) for entry in entries}

    def add(self, turn: int | None, initial: str, fault: str) -> None:
        if self.rows:
            self.illegal += self.last_initial + initial not in LEGAL
        else:
            self.first_initial = initial
        self.last_initial, self.rows = initial, self.rows + 1
        if turn is not None:
            self.turns += turn != self.last_turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if fault:
            self.counts[fault] += 1
        for search in self.searches.values():
            search.row(initial, fault)

    def result(self) -> dict:
        ways = [(entry, state, cost, self.edits.text(node)) for entry, s in self.searches.items() for state, (cost, node) in s.best.items()]
        entry, state, cost, audit = zip(*ways)
        names = ("illegal", "turns", "first_turn", "last_turn", "first_initial", "last_initial")
        return {"conv_id": self.key, "at": self.at} | self.counts | {n: getattr(self, n) for n in names} | {"entry": entry, "exit": state, "cost": cost, "audit": audit}


def _schema(text: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in text.split(", "))])


BLOCK = (
    "conv_id long, at long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn long, last_turn long, "
    "first_initial string, last_initial string, entry array<long>, exit array<long>, cost array<long>, audit array<string>"
)
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
EDIT = "conv_id long, seq long, row long, role string, edit string"
DIGEST = "conv_id long, repaired_sha256 string"
_SENT_ROWS = 1024


def _sent(rows: Iterator[dict], schema: str) -> Iterator[pa.RecordBatch]:
    held, arrow = [], _schema(schema)
    for row in rows:
        held.append(row)
        if len(held) == _SENT_ROWS:
            yield pa.RecordBatch.from_pylist(held, arrow)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, arrow)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _emit_blocks(block_rows: int) -> Callable:
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        now, dealt_to = None, None
        for key, part, row, turn, initial, fault in _rows(batches):
            if now is None or (key, part) != (now.key, dealt_to):
                if now:
                    yield now.result()
                # a conversation that begins inside a range has no rows before; one at a range's edge may have
                now, dealt_to = _Block(key, row, STATES if row == part << 33 else (START,)), part
            elif now.rows == block_rows:
                yield now.result()
                now = _Block(key, row, STATES)
            now.add(turn, initial, fault)
        if now:
            yield now.result()

    return lambda batches: _sent(blocks(batches), BLOCK)


class _Joined:
    """The blocks of a conversation so far."""

    def __init__(self, key: int | None):
        self.key, self.best, self.counts = key, {START: (0, "")}, dict.fromkeys((*FAULTS, "illegal", "turns"), 0)
        self.first_turn = self.last_turn = self.last_initial = None

    def add(self, block: dict) -> None:
        for name in self.counts:
            self.counts[name] += block[name]
        if self.last_initial is not None:
            self.counts["illegal"] += self.last_initial + block["first_initial"] not in LEGAL
        self.last_initial = block["last_initial"]
        if block["first_turn"] is not None:
            self.counts["turns"] -= block["first_turn"] == self.last_turn
            self.first_turn = block["first_turn"] if self.first_turn is None else self.first_turn
            self.last_turn = block["last_turn"]
        best: dict[int, tuple[int, str]] = {}
        for entry, state, cost, audit in zip(block["entry"], block["exit"], block["cost"], block["audit"]):
            if entry in self.best:
                way = (self.best[entry][0] + cost, self.best[entry][1] + audit)
                best[state] = min(best.get(state, way), way)
        self.best = best

    def row(self) -> dict:
        ends = []
        for state, (cost, audit) in self.best.items():
            while state not in ENDS:
                state, cost, audit = NEXT[state], cost + INSERT_COST, audit + INSERT
            ends.append((cost, audit))
        cost, audit = min(ends)
        gaps = 0 if self.first_turn is None else min(self.last_turn - self.first_turn + 1 - self.counts["turns"], _MOST)
        return {"conv_id": self.key, "gaps": gaps, "illegal": self.counts["illegal"], "cost": cost, "audit": audit} | {f: self.counts[f] for f in FAULTS}


def _join_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def summaries() -> Iterator[dict]:
        now = None
        for batch in batches:
            for i in range(batch.num_rows):
                block = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                if now is None or now.key != block["conv_id"]:
                    if now:
                        yield now.row()
                    now = _Joined(block["conv_id"])
                now.add(block)
        if now:
            yield now.row()

    return _sent(summaries(), SUMMARY)


def _emit_edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of each conversation after its audit: the repaired rows with where they come from."""

    def edits() -> Iterator[dict]:
        key, audit, last, at, seq, state = None, "", 0, 0, 0, START

        def step(edit: str, row: int | None, initial: str) -> dict | None:
            nonlocal at, seq, state
            at += 1
            if edit == DELETE:
                return None
            state = KEPT[initial][state] if edit == KEEP else NEXT[state]
            seq += 1
            return {"conv_id": key, "seq": seq - 1, "row": row, "role": None if edit == KEEP else ROLES[state], "edit": edit}

        def inserted() -> Iterator[dict]:
            while audit[at : at + 1] == INSERT:
                yield step(INSERT, None, "")

        for conv_id, row, initial, text in _rows(batches):
            if text is not None:
                key, audit, last, at, seq, state = conv_id, text, len(text.rstrip(INSERT)), 0, 0, START
                continue
            yield from inserted()
            if (out := step(audit[at], row, initial)) is not None:
                yield out
            if at == last:  # no rows are left
                yield from inserted()

    return _sent(edits(), EDIT)


# On Spark -----------------------------------------------------------------------------------------------------------------


def damage(turns: DataFrame) -> DataFrame:
    """Rows with faults put in by a hash of conversation and turn: some go, some lose their text or its sentence ends, some
    stand twice, some change to the user's role."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), F.pmod(F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))), F.lit(20)).alias("kind"))
    return rows.where("kind <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def numbered(turns: DataFrame) -> DataFrame:
    """Staged rows in the order of conversations and turns: conv_id, row (ascending in this order), turn, role, text.

    A conversation of any size is dealt to as many ranges as its rows need; the upper bits of ``row`` name the range.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), text("role"), text("text"), F.monotonically_increasing_id().alias("given"))
    short = [F.substring("role", 1, ORDERED_BY), F.substring("text", 1, ORDERED_BY)]
    dealt = rows.repartitionByRange("conv_id", "turn", *short, "given")
    order = ["conv_id", "turn", *short, "role", "text"]
    return stage(dealt.sortWithinPartitions(*order).select("conv_id", F.monotonically_increasing_id().alias("row"), "turn", "role", "text"), "numbered-turns")


def _fault(duplicate: Column) -> Column:
    return F.when(F.col("blank"), BLANK).when(duplicate, DUPLICATE).when(F.col("truncated"), TRUNCATED)


def faults(rows: DataFrame) -> DataFrame:
    """Staged conv_id, row, turn, initial and fault (null: none) of numbered rows; no texts."""
    narrow = rows.select(
        "conv_id", "row", "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest"),
        (~F.col("text").rlike(_VISIBLE)).alias("blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"),
    )
    firsts = narrow.where("not blank").groupBy("conv_id", "role", "digest").agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select(*[F.col(c).alias(f"other_{c}") for c in ("conv_id", "role", "digest")], "first")
    same = F.col("conv_id").eqNullSafe(F.col("other_conv_id")) & (F.col("role") == F.col("other_role")) & (F.col("digest") == F.col("other_digest"))
    marked = narrow.join(firsts, same, "left")
    duplicate = F.coalesce(F.col("row") > F.col("first"), F.lit(False))
    return stage(marked.select("conv_id", "row", "turn", F.substring("role", 1, 1).alias("initial"), _fault(duplicate).alias("fault")), "turn-faults")


def audits(marked: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """gaps, faults, illegal neighbours, cost and audit of each conversation, from :func:`faults`."""
    part = F.shiftright("row", 33)
    rows = marked.select("conv_id", part.alias("part"), "row", "turn", "initial", "fault")
    blocks = rows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "row").mapInArrow(_emit_blocks(block_rows), BLOCK)
    return stage(blocks.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_join_blocks, SUMMARY), "audits")


def repaired_rows(rows: DataFrame, marked: DataFrame, audited: DataFrame) -> DataFrame:
    """conv_id, seq, role, text and edit of the repaired conversations."""
    narrow = marked.select("conv_id", "row", "initial", F.lit(None).cast("string").alias("audit"))
    heads = audited.select("conv_id", F.lit(-1).cast("long").alias("row"), F.lit("").alias("initial"), "audit")
    edits = narrow.union(heads).repartition("conv_id").sortWithinPartitions("conv_id", "row").mapInArrow(_emit_edits, EDIT)
    edits = edits.select("conv_id", "seq", "row", F.col("role").alias("new_role"), "edit")
    texts = rows.select("row", "role", "text")
    taken = edits.where("row is not null").join(texts, "row").select("conv_id", "seq", F.coalesce("new_role", "role").alias("role"), "text", "edit")
    made = edits.where("row is null").select("conv_id", "seq", F.col("new_role").alias("role"), F.lit("").alias("text"), "edit")
    return taken.union(made)


def repair(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """Audits (one row per conversation) and repaired rows of ``turns`` (conv_id, turn, role, text)."""
    rows = numbered(turns)
    marked = faults(rows)
    audited = audits(marked, block_rows)
    return audited, repaired_rows(rows, marked, audited)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def digests() -> Iterator[dict]:
        now, key = None, None
        for conv_id, role, text in _rows(batches):
            if now is None or conv_id != key:
                if now:
                    yield {"conv_id": key, "repaired_sha256": now.hexdigest()}
                now, key = hashlib.sha256(), conv_id
            else:
                now.update(b"\n")
            now.update(f"{role}:{text}".encode())
        if now:
            yield {"conv_id": key, "repaired_sha256": now.hexdigest()}

    return _sent(digests(), DIGEST)


def report(turns: DataFrame, conversations: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The audit and a digest of the repaired text of every ``conv_id`` in ``conversations``, whether or not it has ``turns``."""
    audited, repaired = repair(turns, block_rows)
    digests = repaired.select("conv_id", "seq", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "seq").drop("seq").mapInArrow(_digest, DIGEST)
    parts = audited.unionByName(digests, allowMissingColumns=True).unionByName(conversations.select("conv_id").distinct(), allowMissingColumns=True)
    numbers = ("gaps", *FAULTS, "illegal", "cost")
    return parts.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in numbers], F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(b""), 256)).alias("repaired_sha256"),
    )
