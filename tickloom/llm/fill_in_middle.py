"""Fill-in-the-middle transformation over memoized chunks of text.

A text is a sequence of units (code points, words or lines); two of its unit boundaries, drawn from a hash of the document's
id, cut it into prefix, middle and suffix. To find a boundary without counting through every text:

* a rolling hash over the last WINDOW bytes cuts texts into chunks where its low bits are zero, so equal passages give equal
  chunks in whatever document they stand (longer stretches without a cut are cut every MOST_BYTES);
* a chunk's boundary summary is worked out once and kept: unit starts behind its first byte, whether its first byte
  can start a unit, whether its last byte lets the next one start, and its code points. Cached chunks are found by their
  bytes, so that only equal content shares a summary. The cache belongs to a task and holds two generations of
  CACHE_BYTES;
* summaries of neighbours combine by addition, with one more start where the edge between them allows it. Running sums over
  a document's chunks give its number of units and lead to the chunk of a boundary; that chunk alone is looked into.

A boundary after k of n units lies where unit k starts, after 0 at the beginning and after n at the end of the text.

Every document is cut on its own, so nothing is shuffled. A text is held whole, with some 30 bytes for each of its bytes.

Defined cases: null text is empty, has no units and stays plain; a null doc_id is hashed as the empty string; rows that
repeat are transformed each, alike for one id; texts that hold a sentinel stay plain; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.words import WHITE, Words, mix, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Of a hundred documents, those that are cut, and of a hundred cut ones those with the suffix in front.
CUT_PERCENT = 90
SPM_PERCENT = 20

WINDOW = 32
#: One place in so many ends a chunk.
MEAN_BYTES = 1024
MOST_BYTES = 8192
CACHE_BYTES = 16 << 20

_GEAR = mix(np.arange(1, 257, dtype=np.uint64))
_LEAD = (np.arange(256) & 0xC0) != 0x80
_ANY = np.ones(256, dtype=bool)
_LINE_FEED = np.arange(256) == 0x0A
#: For each kind of unit: bytes that can start one, and bytes after which one can start. Both start at a text's beginning.
UNITS = {"chars": (_LEAD, _ANY), "words": (WHITE, ~WHITE), "lines": (_ANY, _LINE_FEED)}

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def chunk_ends(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past last byte of all chunks of documents that lie one after the other in ``data``."""
    rolling, width = _GEAR[data], 1
    while width < WINDOW:
        more = rolling[:-width] << np.uint64(width) if width < len(rolling) else rolling[:0]
        rolling = np.r_[rolling[:width], rolling[width:] + more]
        width *= 2
    # the hash after byte i depends on the WINDOW bytes up to i; bits below WINDOW - 1 don't depend on all of them
    cut = (rolling >> np.uint64(WINDOW)) % np.uint64(MEAN_BYTES) == 0
    reach = np.zeros(len(data) + 1, dtype=np.int64)
    np.add.at(reach, starts, 1)
    np.add.at(reach, np.minimum(starts + WINDOW - 1, ends), -1)
    cut &= np.cumsum(reach[:-1]) == 0  # not where the window reaches into the document before
    cut[ends - 1] = True
    last = np.flatnonzero(cut) + 1
    first = np.r_[0, last[:-1]]
    pieces = -(-(last - first) // MOST_BYTES)
    within = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(first, pieces) + within * MOST_BYTES
    return begin, np.minimum(begin + MOST_BYTES, np.repeat(last, pieces))


class Summaries:
    """Boundary summaries of chunks: starts behind the first byte, first byte can start, last byte lets start, code points."""

    def __init__(self, unit: str):
        self.starting, self.letting = UNITS[unit]
        self.young: dict[bytes, tuple[int, int, int, int]] = {}
        self.old: dict[bytes, tuple[int, int, int, int]] = {}
        self.held = 0

    def inner_starts(self, raw: np.ndarray) -> np.ndarray:
        return self.starting[raw[1:]] & self.letting[raw[:-1]]

    def _work_out(self, chunks: list[bytes]) -> list[tuple[int, int, int, int]]:
        raw = np.frombuffer(b"".join(chunks), dtype=np.uint8)
        end = np.cumsum([len(c) for c in chunks])
        begin = np.r_[0, end[:-1]]
        inner = np.r_[0, 0, np.cumsum(self.inner_starts(raw))]  # starts among the bytes before each place, but the first
        points = np.r_[0, np.cumsum(_LEAD[raw])]
        rows = inner[end] - inner[begin + 1], self.starting[raw[begin]], self.letting[raw[end - 1]], points[end] - points[begin]
        return list(zip(*(x.astype(np.int64).tolist() for x in rows)))

    def of(self, chunks: list[bytes]) -> np.ndarray:
        """One row per chunk; what isn't known yet is worked out together."""
        known = {c: self.young.get(c) or self.old.get(c) for c in dict.fromkeys(chunks)}
        new = [c for c, row in known.items() if row is None]
        if new:
            known.update(zip(new, self._work_out(new)))
        table = np.array([known[c] for c in chunks], dtype=np.int64).reshape(-1, 4)
        for c, row in known.items():
            if c not in self.young:
                self.young[c] = row
                self.held += len(c)
                if self.held > CACHE_BYTES:
                    self.young, self.old, self.held = {}, self.young, 0
        return table


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    text = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(text[i : i + 8], 16) for i in (0, 8, 16, 24))


class _Document:
    """The chunks of one text with running sums of their summaries."""

    def __init__(self, raw: bytes, edges: np.ndarray, table: np.ndarray, summaries: Summaries):
        self.raw, self.edges, self.summaries = raw, edges, summaries
        self.opens = table[:, 1] & np.r_[1, table[:-1, 2]]  # whether a unit starts at the chunk's first byte
        self.units = np.r_[0, np.cumsum(table[:, 0] + self.opens)]
        self.points = np.r_[0, np.cumsum(table[:, 3])]

    def boundary(self, k: int) -> tuple[int, int]:
        """Bytes and code points before the end of the first k units."""
        if k == 0:
            return 0, 0
        if k == self.units[-1]:
            return len(self.raw), int(self.points[-1])
        at = int(np.searchsorted(self.units, k, side="right")) - 1  # the chunk in which unit k starts
        chunk = np.frombuffer(self.raw, dtype=np.uint8)[self.edges[at] : self.edges[at + 1]]
        inside = np.r_[bool(self.opens[at]), self.summaries.inner_starts(chunk)]
        place = int(np.flatnonzero(inside)[k - self.units[at]])
        return int(self.edges[at]) + place, int(self.points[at]) + int(np.count_nonzero(_LEAD[chunk[:place]]))


def _emit(unit: str, seed: int, cut_percent: int, spm_percent: int) -> Callable:
    sentinels = [s.encode() for s in (PREFIX, SUFFIX, MIDDLE)]

    def rows(part: pa.RecordBatch, summaries: Summaries) -> Iterator[tuple]:
        entire = Words(part.column("text"), _ANY)  # each text that isn't empty is one stretch of bytes
        begin, end = chunk_ends(entire.data, entire.starts, entire.ends) if len(entire) else (entire.starts, entire.ends)
        buffer = entire.data.tobytes()
        chunks = [buffer[a:b] for a, b in zip(begin.tolist(), end.tolist())]
        table = summaries.of(chunks)
        first = np.searchsorted(begin, entire.starts)
        last = np.searchsorted(begin, entire.ends)
        at = np.cumsum(entire.counts()) - 1
        p, s, m = sentinels
        for i, (doc_id, some) in enumerate(zip(part.column("doc_id").to_pylist(), entire.counts().tolist())):
            if not some:
                yield doc_id, 0, "plain", None, None, b""
                continue
            a, b = first[at[i]], last[at[i]]
            offset = entire.starts[at[i]]
            raw = buffer[offset : entire.ends[at[i]]]
            doc = _Document(raw, np.r_[begin[a:b], end[b - 1]] - offset, table[a:b], summaries)
            n = int(doc.units[-1])
            h1, h2, h3, h4 = draws(doc_id, seed)
            if h3 % 100 >= cut_percent or any(x in raw for x in sentinels):
                yield doc_id, n, "plain", None, None, raw
                continue
            (one, one_chars), (two, two_chars) = (doc.boundary(k) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
            prefix, middle, suffix = raw[:one], raw[one:two], raw[two:]
            spm = h4 % 100 < spm_percent
            parts = [s, suffix, p, prefix, m, middle] if spm else [p, prefix, s, suffix, m, middle]
            yield doc_id, n, "spm" if spm else "psm", one_chars, two_chars - one_chars, b"".join(parts)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summaries = Summaries(unit)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        for batch in batches:
            for part in slices(batch):
                columns = [pa.array(x, kind) for x, kind in zip(zip(*rows(part, summaries)), kinds)]
                yield pa.RecordBatch.from_arrays([*columns[:5], columns[5].cast(pa.string())], names)

    return emit


def transform(docs: DataFrame, unit: str = "chars", seed: int = SEED, cut_percent: int = CUT_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """Every document with its number of units, form (``plain``, ``psm``, ``spm``), code points of prefix and middle, and output."""
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}, got {unit!r}")
    return docs.select("doc_id", "text").mapInArrow(_emit(unit, seed, cut_percent, spm_percent), SCHEMA)


def restore(output: Column, form: Column) -> Column:
    """The text an output was made of. A sentinel stands in an output once, as texts that hold one stay plain."""
    between = lambda a, b: F.substring_index(F.substring_index(output, a, -1), b, 1)
    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def with_digests(transformed: DataFrame) -> DataFrame:
    """The digests of output and restored text in place of the output."""
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    restored = restore(F.col("output"), F.col("form"))
    return transformed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored).alias("restored_sha256")
    )
