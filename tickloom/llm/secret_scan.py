"""Secret scan with multipart credential linking.

One pass over whole texts finds spans that stand on their own (``assign``, ``access``, ``hex``) and weak parts that
mean nothing alone: user names and account ids (``ident``), mixed tokens of 20 or more characters (``value``: whole
runs, dotted ones too, after ``=`` or ``:`` and before a full stop as well), and service addresses (``endpoint``). A part
is an interval; its scope reaches SCOPE code points beyond both of its ends. The interval join finds, for each weak part,
whether a complementary part touches its scope: parts are summed up by the cells of SCOPE code points that they cover, to
the least start and the greatest end, and a weak part looks at the cells of its scope: any part decides in an inner cell,
the greatest end in the first and the least start in the last. That decides exactly, without listing pairs. Reported weak
parts:

* ``value``: with an identifier (``access`` or ``ident``) in scope;
* ``ident`` and ``endpoint``: with a secret (``assign``, ``hex``, or a ``value`` that has its identifier) in scope.

Defined cases: a null text is empty, a null doc_id stays null; rows that share a doc_id, equal or not, get a row each,
as they are told apart by a hash of the text and equal rows have equal results. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.rows import parted, same
from tickloom.llm.words import fresh, slices
from tickloom.operators.prefilter import likely_in
from tickloom.session import stage

SCOPE = 256
#: Order of spans that start at the same place.
KINDS = ["assign", "access", "hex", "value", "ident", "endpoint"]
SECRETS, IDENTIFIERS = ["assign", "hex"], ["access", "ident"]

_ASSIGN = re.compile(
    r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a run of 32 or more, whole, as matching begins at its start
_IDENT = re.compile(r"\b((?ai:user(?:name)?|login|client_?id|account(?:_?id)?))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9_.@-]{3,})")
# a whole run, dots inside it included, as in KEY=VALUE, before a full stop, and of any length; see values() for the rest
_VALUE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_.-]{20})[A-Za-z0-9+/_-]+(?:\.[A-Za-z0-9+/_-]+)*(?:={1,2}(?![A-Za-z0-9+/_=-]))?")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
_ENDPOINT = re.compile(r"\b(?:https?|wss?|postgres(?:ql)?|mysql|mongodb|redis|amqps?)://[^\s\"'<>]+")
# what a text must hold, in lower case, before a pattern is worth running
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_NAMES = ("user", "login", "client", "account")
_LONG = re.compile(r"[A-Za-z0-9+/_.-]{20}")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points of the spans that stand on their own, by start, then kind as listed."""
    out, low = [], text.lower()
    if any(w in low for w in _WORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    if _LONG.search(text):
        out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def values(text: str) -> list[tuple[int, int]]:
    """Places of mixed tokens: 20 or more characters, with a letter and a digit, but not the host of an address."""
    out = []
    for m in _VALUE.finditer(text):
        token = m[0].rstrip("=")
        host = token.startswith("//") and m.start() > 0 and text[m.start() - 1] == ":" and "." in token
        if len(token) >= 20 and not host and _DIGIT.search(token) and _LETTER.search(token):
            out.append(m.span())
    return out


def weak_parts(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Parts that only count beside others; parts inside a base span are left out."""
    out, low = [], text.lower()
    if any(w in low for w in _NAMES):
        out += [("ident", *m.span()) for m in _IDENT.finditer(text)]
    if "://" in text:
        out += [("endpoint", *m.span()) for m in _ENDPOINT.finditer(text)]
    if _LONG.search(text):
        out += [("value", *x) for x in values(text)]
    ordered, kept, at = sorted(base, key=lambda x: x[1]), [], 0
    reach = -1  # furthest end of the base spans that start before the part
    for kind, start, end in sorted(out, key=lambda x: (x[1], x[2])):
        while at < len(ordered) and ordered[at][1] <= start:
            reach, at = max(reach, ordered[at][2]), at + 1
        if start >= reach and not (at < len(ordered) and ordered[at][1] < end):
            kept.append((kind, start, end))
    return kept


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for rows in slices(batch):
            found, weak = [], []
            for text in rows.column("text").to_pylist():
                spans = base_spans(text or "")
                found.append(spans)
                weak.append(weak_parts(text or "", spans))
            lists = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found]
            more = [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in weak]
            count = lambda kind: pa.array([sum(k == kind for k, _, _ in x) for x in found], pa.int64())
            yield pa.RecordBatch.from_pydict({
                "doc_id": rows.column("doc_id"), "tag": rows.column("tag"),
                "n_assign": count("assign"), "n_access": count("access"), "n_hex": count("hex"),
                "base_sha256": pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in found]),
                "base": pa.array(lists, part), "weak": pa.array(more, part),
            })


_PARTS = "array<struct<kind:string,start:bigint,end:bigint>>"
SCHEMA = f"doc_id long, tag long, n_assign long, n_access long, n_hex long, base_sha256 string, base {_PARTS}, weak {_PARTS}"


def _near(weak: DataFrame, partners: DataFrame, scope: int) -> DataFrame:
    """Rows of ``weak`` with a row of ``partners`` that ends or begins at most ``scope`` code points away, or overlaps."""
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / scope), F.floor(high / scope))).alias("cell")
    start, end = F.col("start"), F.col("end")
    extremes = partners.select("doc", "tag", "start", "end", cells(start, end)).groupBy("doc", "tag", "cell").agg(F.min("start").alias("lo"), F.max("end").alias("hi"))
    # a scope covers three cells or more, so its first and its last are two
    looks = weak.select("*", cells(start - scope, end + scope)).join(extremes, ["doc", "tag", "cell"])
    inside = (F.col("hi") >= start - scope) & (F.col("lo") <= end + scope)
    return looks.where(inside).select(weak.columns).distinct()


def linked_parts(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The reported weak parts: doc, tag, kind, start, end."""
    key = F.struct("doc_id")  # groups null ids as well

    def parts(column: str) -> DataFrame:
        rows = found.where(F.size(column) > 0).select(F.to_json(key).alias("doc"), "tag", F.explode(column).alias("p"))
        return rows.select("doc", "tag", "p.kind", "p.start", "p.end")

    base, weak = parts("base"), parts("weak")
    every = base.union(weak)
    values = stage(_near(weak.where("kind = 'value'"), every.where(F.col("kind").isin(IDENTIFIERS)), scope), "linked-values")
    secrets = base.where(F.col("kind").isin(SECRETS)).union(values)
    others = _near(weak.where("kind in ('ident', 'endpoint')"), secrets, scope)
    return values.union(others)


def find(docs: DataFrame) -> DataFrame:
    """All spans of whole texts: doc_id, tag, counts, base_sha256, base and weak parts. One row per row of ``docs``."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), "text")
    return rows.mapInArrow(_emit, SCHEMA)


def with_links(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``find`` staged, with ``added``: the reported weak parts of each row."""
    found = stage(find(docs), "secret-parts")
    added = linked_parts(found, scope).groupBy("doc", "tag").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    return found.withColumn("doc", F.to_json(F.struct("doc_id"))).join(added, ["doc", "tag"], "left").drop("doc", "weak")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256 and all spans, joined."""
    rank = F.create_map(*[x for i, k in enumerate(KINDS) for x in (F.lit(k), F.lit(i))])
    every = F.concat("base", F.coalesce("added", F.array().cast(_PARTS)))
    ordered = F.array_sort(F.transform(every, lambda p: F.struct(p["start"].alias("s"), rank[p["kind"]].alias("k"), p["end"].alias("e"), p["kind"].alias("kind"))))
    text = F.transform(ordered, lambda p: F.concat_ws(":", p["kind"], p["s"].cast("string"), p["e"].cast("string")))
    return with_links(docs, scope).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(text, ",").alias("spans")
    )


def _mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
            out, at = [], 0
            for span in sorted(spans, key=lambda x: (x["start"], -x["end"])):
                if span["start"] >= at:
                    out += [text[at : span["start"]], f"[{span['kind']}]"]
                at = max(at, span["end"])
            texts.append("".join(out) + text[at:])
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tag"), pa.array(texts, pa.string())], ["doc", "tag", "masked"])


def mask(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported span replaced by its kind in brackets; texts without spans stay as they are.

    All columns are kept; ``n_chars``, where there is one, follows the text.
    """
    spans = with_links(docs, scope).select(
        F.to_json(F.struct("doc_id")).alias("doc"), "tag", F.concat("base", F.coalesce("added", F.array().cast(_PARTS))).alias("spans")
    )
    spans = stage(spans.where(F.size("spans") > 0).dropDuplicates(["doc", "tag"]), "secret-spans")
    keyed = docs.select(F.to_json(F.struct("doc_id")).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), "text")
    masked = likely_in(keyed, spans, ["doc", "tag"]).join(spans, ["doc", "tag"]).select("doc", "tag", "text", "spans").mapInArrow(_mask, "doc string, tag long, masked string")
    doc, tag, new = fresh(docs.columns, "masked_doc", "masked_tag", "masked_text")
    masked = stage(masked.dropDuplicates(["doc", "tag"]), "masked-texts").withColumnsRenamed({"doc": doc, "tag": tag, "masked": new})
    at = [F.to_json(F.struct(docs["doc_id"])), F.xxhash64(F.coalesce(docs["text"], F.lit("")))]
    maybe, rest = parted(docs, masked.select(doc, tag), at)
    text = F.coalesce(F.col(new), docs["text"])
    changes = {"text": text} | ({"n_chars": F.when(F.col(new).isNotNull(), F.length(new).cast("long")).otherwise(docs["n_chars"])} if "n_chars" in docs.columns else {})
    joined = maybe.join(masked, same(masked, at), "left")
    return rest.union(joined.select(*[changes.get(c, docs[c]).alias(c) for c in docs.columns]))
