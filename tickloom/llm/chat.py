"""Chat formatting from event logs.

A conversation is a log of events (conv_id, seq, event, message, role, text), in any order in the table:

* ``create``: the message begins, with this text; ``delta``: text streamed to its end;
* ``edit``: its text so far is replaced; ``regenerate``: its text so far is dropped, and deltas follow.

Logs are partitioned by message, not by conversation, so that a conversation of any length spreads over tasks. Within a
message events sort by (seq, event, text); the last event that sets the text opens the final one, and what follows is
appended. Messages stand in the order of their first events. Each is rendered to one block:

    ### Role:\\n <text> </turn>\\n

in which the text's own control strings are escaped: a backslash goes before every backslash and before every ``###`` and
``</turn>``. So no text can look like a mark, and removing one backslash before each of these restores it. (In a role,
backslashes and line feeds are written ``\\\\`` and ``\\n``.) The blocks of a
conversation, in order, are its formatted text; the loss mask of a block is the range of its escaped text if the role
is the assistant's. Reading back takes blocks apart by the marks alone.

Defined cases: null text is empty, null role is the role ``""``; null conv_id, seq and message are values like any
other and sort first; events that repeat are applied as often as they stand; messages with equal first seq sort by
block text; rows of a plain table that repeat are messages of their own; events of unknown kinds count as deltas; a message
whose only events are deltas starts empty; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import stage

END = "</turn>"
LOSS_ROLE = "assistant"
#: Code points of one delta when a plain table is replayed as a log.
DELTA = 512
BLOCK = re.compile(r"### ([^\n]*):\n (.*) </turn>\n\Z", re.DOTALL)
_EVENT_ORDER = {"create": 0, "edit": 1, "regenerate": 2, "delta": 3}
EVENTS = "conv_id long, seq long, event string, message long, role string, text string"


def turns_as_events(turns: DataFrame, delta: int = DELTA) -> DataFrame:
    """A plain table (conv_id, turn, role, text) as the log that would have streamed it.

    Every row is one message, created empty and filled by deltas of at most ``delta`` code points.
    """
    text = F.coalesce("text", F.lit(""))
    last = F.floor(F.greatest(F.length(text) - 1, F.lit(0)) / delta)
    deltas = F.when(
        F.length(text) > 0,
        F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: F.struct(F.lit("delta").alias("event"), text.substr((i * delta + 1).cast("int"), F.lit(delta)).alias("text"), (i + 1).alias("at"))),
    ).otherwise(F.array().cast("array<struct<event:string,text:string,at:bigint>>"))
    begin = F.array(F.struct(F.lit("create").alias("event"), F.lit("").alias("text"), F.lit(0).cast("long").alias("at")))
    rows = turns.select("conv_id", "turn", "role", F.monotonically_increasing_id().alias("message"), F.concat(begin, deltas).alias("events"))
    rows = rows.select("conv_id", "turn", "message", "role", F.explode("events").alias("e"))
    return rows.select("conv_id", F.col("turn").alias("seq"), F.col("e.event").alias("event"), "message", "role", F.col("e.text").alias("text"), F.col("e.at").alias("step"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, seq and role (of the first event), message, text.

    ``events`` may have a column ``step`` that orders events of one seq.
    """
    step = F.col("step") if "step" in events.columns else F.lit(0).cast("long")
    rank = F.create_map(*[x for k, v in _EVENT_ORDER.items() for x in (F.lit(k), F.lit(v))])
    rows = events.select(
        "conv_id", "seq", "message", F.coalesce("role", F.lit("")).alias("role"), step.alias("step"), rank[F.col("event")].alias("kind"), F.coalesce("text", F.lit("")).alias("text")
    )
    event = F.struct("seq", "step", "kind", F.when(F.col("kind") == _EVENT_ORDER["regenerate"], "").otherwise(F.col("text")).alias("text"), "role")
    log = rows.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("log"))
    opens = F.aggregate(F.col("log"), F.struct(F.lit(0).alias("i"), F.lit(1).alias("at")), lambda s, e: F.struct((s["i"] + 1).alias("i"), F.when(e["kind"] < 3, s["i"] + 1).otherwise(s["at"]).alias("at")))
    text = F.array_join(F.transform(F.expr("slice(log, opens.at, size(log))"), lambda e: e["text"]), "")
    return log.withColumn("opens", opens).select("conv_id", F.col("log")[0]["seq"].alias("seq"), "message", F.col("log")[0]["role"].alias("role"), text.alias("text"))


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(\\|###|</turn>)", r"\\$1")


def unescape_text(text: str) -> str:
    return re.sub(r"\\(\\|###|</turn>)", r"\1", text)


def render(messages: DataFrame) -> DataFrame:
    """Blocks: conv_id, seq, message, block, loss_start and loss_end (code points in the block; equal if masked out)."""
    role = F.replace(F.replace("role", F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    head, body = F.concat(F.lit("### "), role, F.lit(":\n ")), escape(F.col("text"))
    start = F.length(head)
    end = F.when(F.col("role") == LOSS_ROLE, start + F.length(body)).otherwise(start)
    return messages.select(
        "conv_id", "seq", "message", F.concat(head, body, F.lit(f" {END}\n")).alias("block"), start.alias("loss_start"), end.alias("loss_end")
    )


def format_log(events: DataFrame) -> DataFrame:
    """The formatted conversations of a log, one row per block, written to the shared folder and read back."""
    return stage(render(fold(events)), "formatted-blocks")


class _Conversation:
    def __init__(self, key: int | None):
        self.key, self.turns, self.chars, self.loss_chars = key, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, block: str, start: int, end: int) -> None:
        role, body = BLOCK.match(block).groups()
        role, masked = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role), unescape_text(block[start:end])
        self.turns, self.chars, self.loss_chars = self.turns + 1, self.chars + len(block), self.loss_chars + len(masked)
        self.all.update(f"{role}\n{unescape_text(body)}\n".encode())
        self.loss.update(masked.encode())

    def row(self) -> dict:
        return {
            "conv_id": self.key, "n_turns": self.turns, "turns_sha256": self.all.hexdigest(), "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars,
        }


SUMMARY = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks in order of conversations; one is held only as its running digests."""
    now = None
    for batch in batches:
        done = []
        for key, block, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "loss_start", "loss_end"))):
            if now is None or now.key != key:
                done += [now.row()] if now else []
                now = _Conversation(key)
            now.add(block, start, end)
        yield pa.RecordBatch.from_pylist(done, _ARROW)
    if now:
        yield pa.RecordBatch.from_pylist([now.row()], _ARROW)


def summarize(blocks: DataFrame) -> DataFrame:
    """What the formatted text says about each conversation, by parsing it."""
    rows = blocks.select("conv_id", "seq", "message", "block", "loss_start", "loss_end")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "block", "message").drop("seq", "message").mapInArrow(_read_back, SUMMARY)
