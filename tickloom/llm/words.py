"""Vectorised words, word hashes and window hashes over Arrow string columns.

A batch is cut into slices of bounded bytes; within one slice all documents are handled at once with numpy.
Hashes are polynomials over the ring of 64-bit integers, taken from prefix sums, then mixed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
WORD_BASE = np.uint64(0xD1B54A32D192ED03)
OTHER_BASE = np.uint64(0x8CB92BA72F3D8DD7)
SLICE_BYTES = 2 << 20
#: For work that takes some hundred bytes of arrays a byte of text: workers keep the most they ever took, and arrays that
#: stay in the processor's cache are faster.
SMALL_SLICE_BYTES = 1 << 19
#: Words of so many bytes are hashed by a digest: in the ring of 64-bit integers there are words of 1024 bytes whose
#: polynomials agree for every odd base.
LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


class Rolling:
    """Hashes of any stretch of a sequence of integers, equal for equal stretches wherever they stand."""

    def __init__(self, values: np.ndarray, base: np.uint64 = WORD_BASE):
        n = len(values)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values.astype(np.uint64, copy=False) * _powers(base, n), out=self.sums[1:])
        self.back = _powers(_inverse(base), n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64))


def separator_table(separators: bytes) -> np.ndarray:
    """For each byte, whether it belongs to a word."""
    table = np.ones(256, dtype=bool)
    table[list(separators)] = False
    return table


WHITE = separator_table(bytes([0x20, *range(0x09, 0x0E)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class Words:
    """The words of a slice of documents.

    ``data``: the bytes of all documents; ``starts``/``ends``: byte range of each word; ``first``: index of each
    document's first word, with one more entry at the end.
    """

    def __init__(self, texts: pa.Array, inside: np.ndarray = WHITE, lower: bool = False):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
        data = data[offsets[0] : offsets[-1]]
        bounds = offsets - offsets[0]
        self.data = LOWER[data] if lower else data
        n = len(data)
        word = inside[data]
        before = np.zeros(n, dtype=bool)
        before[1:] = word[:-1]
        before[bounds[:-1][bounds[:-1] < n]] = False
        after = np.zeros(n, dtype=bool)
        after[:-1] = word[1:]
        inner = bounds[1:][bounds[1:] > 0]
        after[inner - 1] = False
        self.starts = np.flatnonzero(word & ~before)
        self.ends = np.flatnonzero(word & ~after) + 1
        self.first = np.searchsorted(self.starts, bounds)

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def documents(self) -> np.ndarray:
        """Index of the document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A number for each word. Polynomials of long words can be forced to agree, so these get a keyed digest."""
        out = Rolling(self.data, BYTE_BASE).of(self.starts, self.ends)
        for i in np.flatnonzero(self.ends - self.starts >= LONG_WORD).tolist():
            word = self.data[self.starts[i] : self.ends[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=b"words").digest(), "little")
        return out

    def windows(self, size: int) -> np.ndarray:
        """First words of all windows of ``size`` words inside one document, in order."""
        last = np.repeat(self.first[1:], self.counts())
        at = np.arange(len(self.starts))
        return at[at + size <= last]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``limit`` bytes of text; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at, total = 0, 0
    for i, size in enumerate(sizes):
        if i > at and total + size > limit:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += size
    if len(sizes) > at:
        yield batch.slice(at, len(sizes) - at)


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names like ``names`` that aren't among ``taken``, in upper or lower case."""
    used = {t.lower() for t in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """out[i] = min(x[i : i + size]); the last size - 1 entries cover what is left."""
    out, width = x.copy(), 1
    while width < size:
        step = min(width, size - width)
        out[: len(out) - step] = np.minimum(out[: len(out) - step], out[step:])
        width += step
    return out
