"""Substring deduplication by minimizer buckets, in place of De Bruijn compaction (see README).

Every stretch of ``window`` consecutive words is an edge. Edges aren't shuffled one by one. Each is named by its least
k-word node, a minimizer (``ANCHOR_WORDS`` words, least by hash, leftmost on ties), and consecutive edges of a document
under the same node form one path: as nothing inside it is chosen anew, equal paths are one row of (node, path hash).
No graph is built and no paths are joined to longer ones. Spark then works on paths:

1. group by node: a node seen once has no repeated edge; where all its paths are equal, every occurrence but those in
   the smallest document is a repeat as a whole;
2. where a node has several paths, equal paths compact again by (node, path); only their first occurrences are cut into edges,
   which meet by 128-bit identity (node hash, edge hash; independent polynomials), and coordinates decide;
3. repeated spans return to their documents by one join; repeats within one document are found on the spot.

Nodes and edges are compared by hash (64 bits for a word, 128 for an edge), coordinates exactly.

Defined cases: a null text has no words; a null doc_id is smaller than all others; rows that share a doc_id are
documents of equal rank, so none of them is earlier than the other; documents below ``window`` words stay whole.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.words import OTHER_BASE, Rolling, Words, mix, signed, slices, sliding_min
from tickloom.session import stage

WINDOW = 20
ANCHOR_WORDS = 6
PLACE_BITS = np.uint64((1 << 28) - 1)
LEAST_ID = "-9223372036854775808L"


def _anchor_words(window: int) -> int:
    return max(1, min(ANCHOR_WORDS, window - 1))


def _nodes(hashes: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and place of the least node of the windows that start at ``at``."""
    k = _anchor_words(window)
    grams = np.arange(max(len(hashes) - k + 1, 0))
    node = Rolling(hashes).of(grams, grams + k)
    keyed = (node & ~PLACE_BITS) | (grams.astype(np.uint64) & PLACE_BITS)
    place = (sliding_min(keyed, window - k + 1)[at] & PLACE_BITS).astype(np.int64)
    place = at + ((place - at) & int(PLACE_BITS))
    return node[place], place


def _later(keys: np.ndarray) -> np.ndarray:
    """Whether an equal key stands before."""
    late = np.zeros(len(keys), dtype=bool)
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        some = np.flatnonzero(np.isin(keys, twice))
        late[some] = True
        late[some[np.unique(keys[some], return_index=True)[1]]] = False
    return late


def _paths(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """node hash, path hash, document index, first window's place, windows; equal paths of a document once."""
    at = words.windows(window)
    if not len(at):
        none = np.zeros(0, dtype=np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    hashes = words.hashes()
    node, place = _nodes(hashes, at, window)
    new = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    start, n = at[new], np.diff(np.r_[new, len(at)])
    path = Rolling(hashes, OTHER_BASE).of(start, start + n - 1 + window)
    path = mix(path ^ (place[new] - start).astype(np.uint64))
    node, doc = node[new], np.searchsorted(words.first, start, side="right") - 1
    keep = ~_later(mix(path ^ mix(node ^ mix(doc.astype(np.uint64)))))
    return node[keep], path[keep], doc[keep], start[keep] - words.first[doc[keep]], n[keep]


def _emit_paths(window: int, with_place: bool) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                node, path, doc, start, n = _paths(Words(part.column("text")), window)
                columns = {"node": signed(node), "path": signed(path), "id": part.column("id").to_numpy()[doc]}
                if with_place:
                    columns |= {"tag": part.column("tag").to_numpy()[doc], "start": start.astype(np.int32), "n": n.astype(np.int32)}
                yield pa.RecordBatch.from_pydict(columns)

    return emit


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All integers of the ranges, one range after the other."""
    total = int(lengths.sum())
    return np.arange(total) + np.repeat(starts - np.r_[0, np.cumsum(lengths)[:-1]], lengths) if total else np.zeros(0, dtype=np.int64)


def _listed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row index, start and n of a column of lists of (start, n)."""
    rows = np.repeat(np.arange(len(column)), np.asarray(pc.fill_null(pc.list_value_length(column), 0)))
    flat = column.flatten()
    return rows, np.asarray(flat.field("start"), dtype=np.int64), np.asarray(flat.field("n"), dtype=np.int64)


def _emit_edges(window: int) -> Callable:
    """Cut the asked-for paths into edges."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                rows, start, n = _listed(part.column("paths"))
                at = _ranges(start + words.first[rows], n)
                hashes = words.hashes()
                node, _ = _nodes(hashes, at, window)
                edge = Rolling(hashes, OTHER_BASE).of(at, at + window)
                doc = np.repeat(rows, n)
                yield pa.RecordBatch.from_pydict({
                    "node": signed(node), "edge": signed(edge), "id": part.column("id").to_numpy()[doc],
                    "tag": part.column("tag").to_numpy()[doc], "start": (at - words.first[doc]).astype(np.int32),
                })

    return emit


def _emit_kept(window: int, with_text: bool) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = Words(part.column("text"))
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                rows, start, n = _listed(part.column("paths"))
                at = words.windows(window)
                if len(at):
                    edge = Rolling(words.hashes(), OTHER_BASE).of(at, at + window)
                    doc = np.searchsorted(words.first, at, side="right") - 1
                    own = at[_later(mix(edge ^ mix(doc.astype(np.uint64))))]
                    np.add.at(gone, own, 1)
                    np.add.at(gone, own + window, -1)
                start = start + words.first[rows]
                np.add.at(gone, start, 1)
                np.add.at(gone, start + n - 1 + window, -1)
                removed = np.cumsum(gone)[:-1] > 0
                before = np.r_[0, np.cumsum(removed)]
                data, texts, hashes = words.data.tobytes(), [], []
                for a, z in zip(words.first[:-1], words.first[1:]):
                    kept = np.flatnonzero(~removed[a:z]) + a
                    text = b" ".join([data[s:e] for s, e in zip(words.starts[kept].tolist(), words.ends[kept].tolist())])
                    hashes.append(hashlib.sha256(text).hexdigest())
                    if with_text:
                        texts.append(text.decode("utf-8", "replace"))
                columns = {
                    "doc_id": part.column("doc_id"), "n_words": words.counts().astype(np.int64),
                    "n_removed": before[words.first[1:]] - before[words.first[:-1]], "kept_sha256": pa.array(hashes, pa.string()),
                }
                yield pa.RecordBatch.from_pydict(columns | ({"kept_text": pa.array(texts, pa.string())} if with_text else {}))

    return emit


def repeated_paths(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document with repeats from other documents: id, tag, paths (start, n).

    (start, n) says that the n windows from word ``start`` on are repeats of windows of a smaller document.
    """
    rows = _keyed(docs)
    nodes = (
        rows.mapInArrow(_emit_paths(window, False), "node long, path long, id long")
        .groupBy("node")
        .agg(F.count("*").alias("seen"), F.min("path").alias("p0"), F.max("path").alias("p1"), F.min("id").alias("lo"))
        .where("seen > 1")
        .select("node", (F.col("p0") != F.col("p1")).alias("branches"), "lo")
    )
    nodes = stage(nodes, "repeated-nodes")
    found = (
        rows.mapInArrow(_emit_paths(window, True), "node long, path long, id long, tag int, start int, n int")
        .join(nodes, "node")
        .where("branches or id > lo")
    )
    found = stage(found, "repeated-paths")
    plain = found.where("not branches").select("id", "tag", "start", "n")
    branching = found.where("branches").select("node", "path", "id", "tag", "start", "n")
    firsts = branching.groupBy("node", "path").agg(F.min("id").alias("lo"))
    branching = branching.join(firsts, ["node", "path"])
    copies = branching.where("id > lo").select("id", "tag", "start", "n")
    wanted = branching.where("id = lo").groupBy("id", "tag").agg(F.collect_list(F.struct("start", "n")).alias("paths"))
    # the same columns as in remove_repeats, so that Spark deals the texts out once for this join and that one
    edges = rows.join(stage(wanted, "paths-to-cut"), ["id", "tag"]).select("id", "tag", "doc_id", "text", "paths")
    edges = edges.mapInArrow(_emit_edges(window), "node long, edge long, id long, tag int, start int")
    firsts = edges.groupBy("node", "edge").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").drop("hi")
    cut = edges.join(firsts, ["node", "edge"]).where("id > lo").select("id", "tag", "start", F.lit(1).alias("n"))
    spans = plain.unionByName(copies).unionByName(cut)
    return spans.groupBy("id", "tag").agg(F.collect_list(F.struct("start", "n")).alias("paths"))


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a non-null id and a tag that tells rows of one id apart."""
    return docs.select(
        "doc_id", "text", F.coalesce("doc_id", F.expr(LEAST_ID)).alias("id"), F.hash(F.coalesce("text", F.lit(""))).alias("tag")
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (and kept_text on request).

    A word goes if a window that covers it has the same words as a window of a smaller document, or as an earlier
    one of its own. Kept words are joined by one space.
    """
    spans = repeated_paths(docs, window)
    rows = _keyed(docs).join(spans, ["id", "tag"], "left").select("doc_id", "text", "paths")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return rows.mapInArrow(_emit_kept(window, with_text), schema)
