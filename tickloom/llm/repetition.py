"""Quality rules by repetition coverage.

Words are stretches without white space; lines are split at ``\\n``. For each n-gram length the operator marks every word
that lies in an n-gram which stands twice or more in its text (the first time included) and measures the share of word
characters marked; for lines, the share of word characters in lines that equal an earlier one. A document fails if a
share passes its limit, or if it holds too many symbols for its words. n-grams of a slice of documents are found together
in numpy: words get exact numbers, rolling hashes of the numbers bring candidates side by side, and candidates are
compared word by word. Should a hash have put unequal n-grams side by side, the slice is numbered exactly by pairs instead.

Every document is judged on its own, so nothing is shuffled. A text is held whole with some 60 bytes a word.

Defined cases: null and empty texts have no words and fail the base rule; rows that repeat are judged each on its own; a
null doc_id is a value like any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.words import Rolling, Words, mix, separator_table, slices

BASE_WINDOW = 8
FEWEST_WORDS = 20
#: Percent of the words that may lie in repeated windows of BASE_WINDOW words.
MOST_REPEATED = 30
#: Fixed values, the published repetition limits for web text: percent of characters inside repeated n-grams, by length.
LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Percent of characters inside lines that stand earlier in the text.
LINE_LIMIT = 20
SYMBOLS = b"#*$%&|<>"
#: Symbols for a hundred words, the published limit for marks that take the place of prose.
SYMBOL_LIMIT = 10

_NOT_LINE_FEED = separator_table(b"\n")
_SYMBOL = ~separator_table(SYMBOLS)


def numbered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each stretch of bytes, the same for equal stretches only."""
    lengths = ends - starts
    total = int(lengths.sum())
    places = np.arange(total) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int64)
    texts = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[places]))])
    return np.asarray(texts.dictionary_encode().indices).astype(np.int64)


def _exact_keys(ids: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the windows, word by word: equal numbers for equal windows only."""
    keys = ids[at]
    for k in range(1, size):
        keys = np.unique(np.c_[keys, ids[at + k]], axis=0, return_inverse=True)[1].reshape(-1)
    return keys


def repeated_words(ids: np.ndarray, doc: np.ndarray, at: np.ndarray, size: int, hashed: Callable = Rolling) -> np.ndarray:
    """Whether each word lies in a window of ``size`` words that its document holds twice or more.

    ``at``: first words of all windows, each inside one document.
    """
    keys = hashed(mix(ids.astype(np.uint64))).of(at, at + size)
    order = np.lexsort((keys, doc[at]))
    near = (keys[order][1:] == keys[order][:-1]) & (doc[at][order][1:] == doc[at][order][:-1])
    a, b = at[order[:-1][near]], at[order[1:][near]]
    same = np.ones(len(a), dtype=bool)
    for k in range(size):
        same &= ids[a + k] == ids[b + k]
    if not same.all():
        keys = _exact_keys(ids, at, size)
        order = np.lexsort((keys, doc[at]))
        near = (keys[order][1:] == keys[order][:-1]) & (doc[at][order][1:] == doc[at][order][:-1])
        a, b = at[order[:-1][near]], at[order[1:][near]]
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    hit = np.unique(np.r_[a, b])
    edge[hit] += 1
    edge[hit + size] -= 1
    return np.cumsum(edge[:-1]) > 0


def _counter(flags: np.ndarray) -> np.ndarray:
    return np.r_[0, np.cumsum(flags, dtype=np.int64)]


def measure(texts: pa.Array, sizes: list[int]) -> dict[str, np.ndarray]:
    """Counts per document: words and their characters, symbols, repeated lines, words and characters in repeated windows."""
    words = Words(texts)
    n = len(words.first) - 1
    doc, data = words.documents(), words.data
    entire = Words(texts, np.ones(256, dtype=bool))  # each document that isn't empty is one stretch
    held = np.flatnonzero(entire.counts() > 0)
    points = _counter((data & 0xC0) != 0x80)
    chars = points[words.ends] - points[words.starts]
    symbols = _counter(_SYMBOL[data])
    n_symbols = np.zeros(n, dtype=np.int64)
    n_symbols[held] = symbols[entire.ends] - symbols[entire.starts]

    lines = Words(texts, _NOT_LINE_FEED)
    before = np.searchsorted(words.starts, lines.starts), np.searchsorted(words.starts, lines.ends)
    some = before[1] > before[0]
    line, line_doc = numbered(data, lines.starts[some], lines.ends[some]), lines.documents()[some]
    in_words = _counter(chars) if len(chars) else np.zeros(1, dtype=np.int64)
    line_chars = (in_words[before[1]] - in_words[before[0]])[some]
    order = np.lexsort((np.arange(len(line)), line, line_doc))
    again = np.zeros(len(line), dtype=bool)
    again[order[1:]] = (line[order][1:] == line[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])

    count = lambda where, weights=None: np.bincount(where, weights, minlength=n).astype(np.int64)
    out = {
        "n_words": words.counts().astype(np.int64), "word_chars": count(doc, chars), "n_symbols": n_symbols,
        "n_dup_lines": count(line_doc[again]), "dup_line_chars": count(line_doc[again], line_chars[again]),
    }
    ids = numbered(data, words.starts, words.ends)
    for size in sizes:
        marked = repeated_words(ids, doc, words.windows(size), size)
        out[f"repeat_words_{size}"] = count(doc[marked])
        out[f"repeat_chars_{size}"] = count(doc[marked], chars[marked])
    return out


def _judge(limits: dict[int, int], line_limit: int, symbol_limit: int, base_window: int, fewest: int, most: int, names: list[str]) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = measure(part.column("text"), sorted({base_window, *limits}))
                found["n_repeat_words"] = found[f"repeat_words_{base_window}"]
                failed = (found["n_words"] < fewest) | (100 * found["n_repeat_words"] > most * found["n_words"])
                covered = 100 * found["dup_line_chars"] > line_limit * found["word_chars"]
                covered |= 100 * found["n_symbols"] > symbol_limit * found["n_words"]
                for size, limit in limits.items():
                    covered |= 100 * found[f"repeat_chars_{size}"] > limit * found["word_chars"]
                found |= {"base_failed": failed, "kept": ~failed & ~covered, "doc_id": part.column("doc_id")}
                yield pa.RecordBatch.from_pydict({name: found[name] for name in names})

    return emit


def judge(
    docs: DataFrame, limits: dict[int, int] = LIMITS, line_limit: int = LINE_LIMIT, symbol_limit: int = SYMBOL_LIMIT,
    base_window: int = BASE_WINDOW, fewest: int = FEWEST_WORDS, most: int = MOST_REPEATED,
) -> DataFrame:
    """The counts of every document, and whether it is kept: ``limits`` are percents of characters by n-gram length."""
    if min([base_window, *limits]) < 1:
        raise ValueError("n-grams have at least one word")
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *[f"repeat_chars_{s}" for s in sorted(limits)]]
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean"
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(_judge(limits, line_limit, symbol_limit, base_window, fewest, most, ["doc_id", *counts, "base_failed", "kept"]), schema)
