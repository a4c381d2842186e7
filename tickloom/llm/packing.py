"""Best-fit packing of tokenized documents under several capacities.

A sequence has room for tokens, for documents and for attention cost (the sum of squared lengths). Pieces of equal
length are alike under all three, so a histogram of lengths (at most ``max_tokens`` rows at any corpus size) holds the
whole packing problem. Lengths go in from the longest down; all open sequences in the same state are handled together.
For each length the open state with the best score takes the next pieces: the largest dot product of need and residual,
weighted by how scarce each capacity is (``dot``), or the least norm of what would remain (``norm``). No state may go
below zero in any capacity; pieces that fit nowhere open new sequences. The outcome is a table of runs: "the i-th to
j-th piece of this length go to sequences k to k+j-i at that offset". Spark ranks the pieces within their length, in
salted groups, and joins them to the runs by range.

Defined cases: a null text is an empty document (its end id alone); pieces are told apart by (doc_id, piece, start), and
rows that repeat are packed once each; an empty table gives an empty packing. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.tokens import SLICE_BYTES, worker_encoder
from tickloom.llm.words import slices
from tickloom.session import stage

MAX_TOKENS = 1024
END_ID = 2
VOCABULARY = "byte_bpe_50k.json"
#: Pieces of one length that one group ranks.
RANKED_TOGETHER = 1_000
#: Ranks of one cell of the range join.
CELL_RANKS = 50_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: all full but the first."""
    head = n % most or min(n, most)
    return [(0, head)] + [(i, most) for i in range(head, n, most)] if n else []


def _emit_pieces(vocabulary: str, end_id: int, most: int, with_ids: bool) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(vocabulary)
        for batch in batches:
            for part in slices(batch, limit=SLICE_BYTES):
                ids, begin = encoder.encode(part.column("text"), end_id)
                doc, piece, start, length, crc, raw = [], [], [], [], [], []
                for i, n in enumerate(np.diff(begin).tolist()):
                    for k, (s, m) in enumerate(cut(n, most)):
                        own = ids[begin[i] + s : begin[i] + s + m]
                        doc.append(i), piece.append(k), start.append(s), length.append(m)
                        crc.append(zlib.crc32(own.astype("<u4", copy=False)))
                        if with_ids:
                            raw.append(own.astype("<u4").tobytes())
                columns = {
                    "doc_id": part.column("doc_id").take(pa.array(doc, pa.int64())), "piece": pa.array(piece, pa.int32()),
                    "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(raw, pa.binary())} if with_ids else {}))
        encoder.forget()

    return emit


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, max_tokens: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """Token pieces of whole documents; ``ids`` (little-endian unsigned 32-bit) on request."""
    schema = PIECES + ", ids binary" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_emit_pieces(vocabulary, end_id, max_tokens, with_ids), schema)


def plan_runs(
    histogram: dict[int, int], max_tokens: int, max_docs: int, max_cost: int, score: str = "dot"
) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, pieces, first sequence, offset) that place every piece of the histogram.

    The i-th piece of a run goes to the i-th of its sequences. Work and result depend on the number of distinct
    lengths, not on the number of pieces.
    """
    if max_docs < 1 or any(n > max_tokens or n * n > max_cost for n in histogram):
        raise ValueError("a piece exceeds the capacities of an empty sequence")
    full = np.array([max_tokens, max_docs, max_cost], dtype=np.float64)
    demand = np.array([sum(n * c for n, c in histogram.items()), sum(histogram.values()), sum(n * n * c for n, c in histogram.items())], dtype=np.float64)
    weight = demand / full  # scarcity: what all pieces need, in sequences' worth
    weight = weight / weight.max() if weight.max() else weight
    # open sequences in one state: residual tokens, documents, cost -> ranges (first sequence, how many)
    open_: dict[tuple[int, int, int], list[tuple[int, int]]] = {}
    runs, next_sequence = [], 0
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        left, rank = histogram[length], 0
        need = (length, 1, length * length)
        while left:
            states = np.array([s for s in open_ if all(r >= d for r, d in zip(s, need))], dtype=np.float64).reshape(-1, 3)
            if len(states):
                after = (states - need) / full
                if score == "norm":
                    best = np.lexsort((-after[:, 1], (weight * after**2).sum(axis=1)))[0]
                else:  # the need points where little is left: most used capacity along the need, in shares
                    used = (full - states) / full
                    best = np.lexsort((after[:, 0], -(used * weight * (np.array(need) / full)).sum(axis=1)))[0]
                state = tuple(int(x) for x in states[best])
                first, many = open_[state].pop()
                if not open_[state]:
                    del open_[state]
                take = min(many, left)
                if take < many:
                    open_.setdefault(state, []).append((first + take, many - take))
                many = take
            else:
                state, first = (max_tokens, max_docs, max_cost), next_sequence
                each = min(max_tokens // length, max_docs, max_cost // (length * length)) if length else max_docs
                many = -(-left // each)
                next_sequence += many
            # equal pieces go on into the same sequences as long as they fit
            while left and all(r >= d for r, d in zip(state, need)):
                take = min(many, left)
                runs.append((length, rank, take, first, max_tokens - state[0]))
                if take < many:
                    open_.setdefault(state, []).append((first + take, many - take))
                    many = take
                rank, left = rank + take, left - take
                state = tuple(r - d for r, d in zip(state, need))
            open_.setdefault(state, []).append((first, many))
    return runs


def place(
    items: DataFrame, max_tokens: int = MAX_TOKENS, max_docs: int = MAX_TOKENS, max_cost: int = MAX_TOKENS**2, score: str = "dot"
) -> DataFrame:
    """``items`` (doc_id, piece, start, length, ...) with sequence_id and offset. ``items`` is read twice: stage it."""
    counts = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= max_tokens rows
    spark = items.sparkSession
    runs = spark.createDataFrame(
        plan_runs(counts, max_tokens, max_docs, max_cost, score), "length long, run_first long, run_pieces long, first_sequence long, offset long"
    )
    salts = max(1, max(counts.values(), default=0) // RANKED_TOGETHER + 1)
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)))
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("in_group", F.row_number().over(within) - 1).join(groups, ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("in_group")).drop("base", "in_group", "salt")
    # the runs of a length tile its ranks, so a piece meets its run through the cells of CELL_RANKS ranks they cover
    cell = lambda c: F.floor(c / F.lit(CELL_RANKS))
    runs = runs.withColumn(
        "cell", F.explode(F.sequence(cell(F.col("run_first")), cell(F.col("run_first") + F.col("run_pieces") - 1)))
    )
    placed = ranked.withColumn("cell", cell(F.col("rank"))).join(runs, ["length", "cell"])
    placed = placed.where("rank >= run_first and rank < run_first + run_pieces")
    return placed.select(*items.columns, (F.col("first_sequence") + F.col("rank") - F.col("run_first")).alias("sequence_id"), "offset")


def pack(
    docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID, max_tokens: int = MAX_TOKENS, with_ids: bool = False, **limits
) -> DataFrame:
    """Every piece of every document with its sequence and offset."""
    items = stage(pieces(docs, vocabulary, end_id, max_tokens, with_ids), "token-pieces")
    return place(items, max_tokens, **({"max_docs": max_tokens, "max_cost": max_tokens**2} | limits))
