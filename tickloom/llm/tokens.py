"""Token ids of whole texts by a tokenizer file, encoding each distinct piece of a slice once.

Text is cut only where no token of the vocabulary's pre-tokenizer can lie across: at single spaces and line feeds
after a visible character, and between a letter and closing punctuation. Texts with other white space, or vocabularies
of other kinds, are encoded whole. Results equal the library's own on the whole text.
"""

from __future__ import annotations

import contextlib
import gc
import itertools
import json
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 8 << 20
#: Known pieces are forgotten beyond so many (some 200 bytes each), between two slices.
CACHE_PIECES = 300_000
_CLOSING = frozenset(".,!?|%&#$*;:")
_CLOSED = re.compile(r"(?s)(.*[^\W\d_])([.,!?|%&#$*;:]+)")
_PLAIN = re.compile(r"\n?\S+")
#: Pieces that any pre-tokenizer of the two kinds below takes as one unit, and whose normal form is their lower case.
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")


def tokenizer_path(name: str) -> str:
    """A file path as it is; a bare file name is one of the installed public vocabularies."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _visible_bytes() -> dict[int, str]:
    """The character that byte-level vocabularies write for each byte: itself if printable, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _closes(letter: str) -> bool:
    """Whether nothing of a letter joins the sign after it: some become a letter and a mark when normalised."""
    return unicodedata.category(unicodedata.normalize("NFC", letter.lower())[-1])[0] == "L"


@contextlib.contextmanager
def _no_cycles() -> Iterator[None]:
    """Python's search for cycles is paused: a slice makes some hundred thousand lists and tuples, and none is in one."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class PieceEncoder:
    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.kind = self._kind(spec)
        self.visible = _visible_bytes()
        self.forget()

    def forget(self) -> None:
        """Drop the known pieces; to be called at the end of a task, as the encoder lasts as long as the worker."""
        self.places: tuple[dict[str, int], dict[str, int]] = ({}, {})  # pieces after a space, and at a text's start
        self.flat = np.zeros(1 << 20, dtype=np.uint32)
        self.begin = np.zeros(1 << 16, dtype=np.int64)  # where each known piece begins in ``flat``, with the end
        self.odd = np.zeros(1 << 16, dtype=bool)
        self.known = 0

    @staticmethod
    def _kind(spec: dict) -> str:
        """``spaced``: a space belongs to the word after it; ``dropped``: white space gives no token; else ``whole``."""
        before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if spec["model"]["type"] != "BPE" or any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in spec["added_tokens"]):
            return "whole"
        if before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and norm is None:
            return "spaced"
        inner = before.get("pretokenizers") or [{}]
        split = inner[0].get("pattern", {}).get("Regex", "")
        if inner[0].get("type") == "Split" and inner[0].get("invert") and inner[0].get("behavior") == "Removed" and r"[^\s\p{L}\p{N}]+" in split and " ?" not in split:
            if {n["type"] for n in (norm or {}).get("normalizers", [])} <= {"NFC", "Replace", "Lowercase"}:
                return "dropped"
        return "whole"

    def _encode(self, texts: list[str]) -> list[list[int]]:
        out = []
        for i in range(0, len(texts), 4096):
            out += [x.ids for x in self.whole.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)]
        return out

    def _units(self, texts: list[str]) -> list[list[int]]:
        """Ids of short pieces; one word of letters goes straight to the vocabulary's merges."""
        merge, lower = self.whole.model.tokenize, self.kind == "dropped"
        out: list = [None] * len(texts)
        rest = []
        for i, text in enumerate(texts):
            word = text if lower or text[:1] != " " else text[1:]
            if word.isascii() and word.isalpha():
                text = word.lower() if lower else word if word is text else "\u0120" + word
            elif _LETTERS.fullmatch(word):
                text = (text.lower() if lower else text).encode().decode("latin-1").translate(self.visible)
            else:
                rest.append(i)
                continue
            out[i] = [t.id for t in merge(text)]
        for i, ids in zip(rest, self._encode([texts[i] for i in rest])):
            out[i] = ids
        return out

    def _append(self, ids: list[list[int]], odd: list[bool]) -> int:
        """Add pieces to the table; the place of the first."""
        n, first = len(ids), self.known
        ends = self.begin[first] + np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=n))
        used, total = int(self.begin[first]), int(ends[-1]) if n else int(self.begin[first])
        while total > len(self.flat):
            self.flat = np.r_[self.flat, np.zeros_like(self.flat)]
        while first + n + 1 > len(self.begin):
            self.begin, self.odd = np.r_[self.begin, np.zeros_like(self.begin)], np.r_[self.odd, np.zeros_like(self.odd)]
        self.flat[used:total] = np.fromiter(itertools.chain.from_iterable(ids), dtype=np.uint32, count=total - used)
        self.begin[first + 1 : first + n + 1] = ends
        self.odd[first : first + n] = odd
        self.known += n
        return first

    def _look_up(self, pieces: list[str], first: bool) -> np.ndarray:
        """Places of pieces in the table of known ones, encoding the new."""
        places, space, spaced = self.places[first], "" if first or self.kind == "dropped" else " ", self.kind == "spaced"
        new = [p for p in pieces if p not in places]
        if new:
            parts: list[tuple[str, ...]] = []
            for p in new:
                full = p if p[:1] == "\n" else space + p
                closed = _CLOSED.fullmatch(full) if full[-1:] in _CLOSING else None
                parts.append(closed.groups() if closed and _closes(closed[1][-1]) else (full,))
            units = [*dict.fromkeys(itertools.chain.from_iterable(parts))]
            ids = dict(zip(units, self._units(units)))
            odd = [not _PLAIN.fullmatch(p) for p in new] if spaced else [False] * len(new)
            at = self._append([ids[x[0]] if len(x) == 1 else ids[x[0]] + ids[x[1]] for x in parts], odd)
            places.update(zip(new, range(at, at + len(new))))
        return np.fromiter(map(places.__getitem__, pieces), dtype=np.int64, count=len(pieces))

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text begins, with the end. Null: an empty text."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(texts)
        if self.known > CACHE_PIECES:
            self.forget()
        with _no_cycles():
            at, doc = self._cut(texts) if self.kind != "whole" else self._entire(texts, np.arange(n))
        begin = self.begin[at]
        lengths = self.begin[at + 1] - begin
        total = int(lengths.sum())
        source = np.arange(total) + np.repeat(begin - (np.cumsum(lengths) - lengths), lengths)
        counts = np.bincount(doc, weights=lengths, minlength=n).astype(np.int64)
        if end_id is None:
            return self.flat[source], np.r_[0, np.cumsum(counts)]
        ids = np.full(total + n, end_id, dtype=np.uint32)
        ids[np.arange(total) + np.repeat(np.arange(n), counts)] = self.flat[source]
        return ids, np.r_[0, np.cumsum(counts + 1)]

    def _entire(self, texts: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whole texts as table entries that no piece refers to."""
        ids = self._encode(texts.take(pa.array(rows)).to_pylist())
        return self._append(ids, [False] * len(ids)) + np.arange(len(ids)), rows

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each piece in order, its place in the table of known pieces, and its text."""
        spaced = self.kind == "spaced"
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n" if spaced else " "), " ")
        bounds = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
        pieces = lists.flatten()
        coded = pieces.dictionary_encode()
        at = self._look_up(coded.dictionary.to_pylist(), False)[np.asarray(coded.indices)]
        if not spaced:
            return at, doc
        odd = np.zeros(len(texts), dtype=bool)
        odd[doc[self.odd[at]]] = True
        first = pieces.take(pa.array(bounds[:-1])).dictionary_encode()  # no space stands before these
        at[bounds[:-1]] = self._look_up(first.dictionary.to_pylist(), True)[np.asarray(first.indices)]
        if odd.any():
            keep = ~odd[doc]
            whole, rows = self._entire(texts, np.flatnonzero(odd))
            at, doc = np.r_[at[keep], whole], np.r_[doc[keep], rows]
            order = np.argsort(doc, kind="stable")
            at, doc = at[order], doc[order]
        return at, doc


def worker_encoder(name: str) -> PieceEncoder:
    """The encoder of this Python worker. A task that ends should let it forget its pieces.

    Functions of this package reach workers by value, so that its own module variables end with a task; those of the
    tokenizer library last as long as the worker.
    """
    import tokenizers

    held = tokenizers.__dict__.setdefault("_encoders_of_this_worker", {})
    if name not in held:
        held[name] = PieceEncoder(name)
    return held[name]
