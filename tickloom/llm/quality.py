"""Quality selection by importance resampling.

Bag-of-n-gram models over hashed features are estimated for target text and for raw text. A document's importance
weight is the ratio of the likelihoods; its logarithm is a sum of per-feature terms

    log((c_target + PRIOR) / (expected + PRIOR)),   expected = c_raw * n_target / n_raw

for each occurrence of the feature, where c counts the documents that hold it (so one document's favourite words prove
nothing) and n all documents of the model. A term is 0 unless c_target and expected differ by SIGNIFICANT standard
deviations; else documents that happen to be labelled would score better than the like of them. Two ratios are taken:

* quality: trusted documents (labelled good and not toxic) against the whole corpus. Features are token unigrams,
  token bigrams (a token after itself is one shared feature), pairs of token shapes, and loops: stretches that repeat
  at a distance of one to four tokens, whatever the tokens;
* safety: documents labelled not toxic against those labelled toxic, by their tokens.

Each ratio is taken relative to the cut that best parts its labelled documents (see TRUSTED_WEIGHT), and
the lesser of the two is the document's log-weight: it must be plausible as good and as safe. Resampling without
replacement is Gumbel top-k: add independent Gumbel noise, scaled by a temperature, and take the k largest, k being the
number of documents with a log-weight of 0 or more. The noise is a hash of the document, so results repeat.

Raw counts and scores cover all documents; at most LABELLED labelled documents of each kind are fitted, chosen by a
hash of their id. The model has a fixed number of rows at any corpus size.

Defined cases: null and empty texts have no features and both ratios 0; a null doc_id matches no label; rows that share
a doc_id, equal or not, are scored each on its own, equal rows alike; of conflicting labels of one id the worst counts;
null labels are ignored; a ratio without labels of both kinds has the cut 0. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.rows import without
from tickloom.llm.words import BYTE_BASE, LOWER, SMALL_SLICE_BYTES, Rolling, Words, fresh, mix, slices
from tickloom.session import stage

BUCKET_BITS = 16
TOKEN_BITS = 18
PRIOR = 5.0
SIGNIFICANT = 2.5
#: A trusted document lost weighs as much as so many untrusted ones kept.
TRUSTED_WEIGHT = 5.0
LABELLED = 20_000
#: 1 is plain importance resampling; lower values let less chance in.
TEMPERATURE = 0.1
SEED = 11

# byte classes: 0 white space, 1 letter (all non-ASCII bytes), 2 digit, 3 other
_KIND = np.full(256, 3, dtype=np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_UPPER = np.zeros(256, dtype=bool)
_UPPER[ord("A") : ord("Z") + 1] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document index and bucket of every feature; document index and bucket of every token."""
    all_bytes = Words(texts, np.ones(256, dtype=bool))  # each document one stretch of bytes
    data = all_bytes.data
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[1:-1] = kind[1:] != kind[:-1]
    edge[all_bytes.starts] = True
    edge[all_bytes.ends] = True
    cut = np.flatnonzero(edge)
    start, end = cut[:-1], cut[1:]
    use = kind[start] > 0 if len(start) else np.zeros(0, dtype=bool)
    start, end = start[use], end[use]
    doc = np.searchsorted(all_bytes.starts, start, side="right") - 1
    doc = np.flatnonzero(all_bytes.counts() > 0)[doc] if len(doc) else doc
    token = Rolling(LOWER[data], BYTE_BASE).of(start, end)
    what = kind[start]
    token = np.where(what == 2, np.uint64(2), token)
    uppers = np.r_[0, np.cumsum(_UPPER[data])]
    capitals = uppers[end] - uppers[start]
    shape = np.where(capitals == 0, 0, np.where((capitals == 1) & _UPPER[data[start]], 1, 2)) + 3
    shape = np.where(what == 1, shape.astype(np.uint64), token)
    same = doc[1:] == doc[:-1]
    a, b = token[:-1][same], token[1:][same]
    pair = np.where((a == b) & (what[1:][same] == 1), np.uint64(7), mix(a * np.uint64(3) + b))
    shapes = mix(shape[:-1][same] * np.uint64(5) + shape[1:][same] + np.uint64(1))
    keys = [mix(token ^ np.uint64(0x1F)), mix(pair ^ np.uint64(0x2F)), mix(shapes ^ np.uint64(0x3F))]
    docs = [doc, doc[1:][same], doc[1:][same]]
    for gap, back in ((1, 1), (2, 1), (3, 1), (4, 1), (1, 2)):
        # the token gap places before again, and the same holds for the token ``back`` places before
        reach = gap + back
        if len(token) > reach:
            now, then = slice(reach, None), slice(back, len(token) - gap)
            loop = (token[now] == token[then]) & (token[reach - back : len(token) - back] == token[: len(token) - reach]) & (doc[now] == doc[: len(token) - reach])
            loop &= what[now] == 1
            keys.append(np.full(np.count_nonzero(loop), mix(np.uint64([gap * 8 + back]))[0]))
            docs.append(doc[now][loop])
    keys, docs = np.concatenate(keys), np.concatenate(docs)
    tokens = mix(token ^ np.uint64(0x4F)) >> np.uint64(64 - TOKEN_BITS)
    return docs, (keys >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), doc, tokens.astype(np.int64)


def _emit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, bucket, raw, target) documents; kind 0 quality, 1 safety, 2 all documents of safety (0) and quality (1)."""
    quality = np.zeros((2, 1 << BUCKET_BITS), dtype=np.int64)
    safety = np.zeros((2, 1 << TOKEN_BITS), dtype=np.int64)
    seen = np.zeros((2, 2), dtype=np.int64)
    for batch in batches:
        for part in slices(batch, limit=SMALL_SLICE_BYTES):
            docs, bucket, token_docs, tokens = features(part.column("text"))
            good = np.asarray(part.column("good").fill_null(0)) == 1
            toxic = np.asarray(part.column("toxic").fill_null(-1))
            held = np.unique((docs << BUCKET_BITS) | bucket)
            bucket = held & ((1 << BUCKET_BITS) - 1)
            quality[0] += np.bincount(bucket, minlength=1 << BUCKET_BITS)
            quality[1] += np.bincount(bucket[good[held >> BUCKET_BITS]], minlength=1 << BUCKET_BITS)
            for row, kind in ((0, 1), (1, 0)):
                some = (toxic == kind)[token_docs]
                held = np.unique((token_docs[some] << TOKEN_BITS) | tokens[some]) & ((1 << TOKEN_BITS) - 1)
                safety[row] += np.bincount(held, minlength=1 << TOKEN_BITS)
                seen[row, 0] += np.count_nonzero(toxic == kind)
            seen[:, 1] += part.num_rows, np.count_nonzero(good)
    for kind, (raw, target) in enumerate((quality, safety, seen)):
        some = np.flatnonzero(raw + target)
        yield pa.RecordBatch.from_pydict({"kind": np.full(len(some), kind), "bucket": some, "raw": raw[some], "target": target[some]})


def model_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Feature counts (kind, bucket, raw, target) over all of ``docs`` and the documents of ``labels``."""
    rows = docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id", "left")  # at most 3 * LABELLED rows
    counts = rows.select("text", "good", "toxic").mapInArrow(_emit_counts, "kind long, bucket long, raw long, target long")
    return counts.groupBy("kind", "bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def labelled(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """doc_id, good, junk and toxic (0 or 1): at most ``most`` documents of each kind, chosen by a hash of the id."""
    known = labels.where("doc_id is not null and quality is not null and toxic is not null")
    kinds = known.groupBy("doc_id").agg(F.max((F.col("quality") != 1).cast("int")).alias("junk"), F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    kinds = kinds.withColumn("good", ((F.col("junk") == 0) & (F.col("toxic") == 0)).cast("int"))
    pick = lambda kind: kinds.where(kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return pick("good = 1").union(pick("toxic = 1")).union(pick("junk = 1 and toxic = 0"))


def log_ratios(counts: DataFrame, prior: float = PRIOR) -> tuple[np.ndarray, np.ndarray]:
    """The models: one number per feature bucket, one per token bucket."""
    table = counts.toArrow()  # at most 2**BUCKET_BITS + 2**TOKEN_BITS + 2 rows
    kind, bucket, raws, targets = (table.column(c).to_numpy() for c in ("kind", "bucket", "raw", "target"))

    def spread(k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        raw, target = np.zeros(size), np.zeros(size)
        raw[bucket[kind == k]], target[bucket[kind == k]] = raws[kind == k], targets[kind == k]
        return raw, target

    (n_toxic, n_all), (n_safe, n_good) = spread(2, 2)
    raw, target = spread(0, 1 << BUCKET_BITS)
    share = n_good / n_all if n_all else 0.0
    quality = _terms(raw * share, target, np.sqrt(raw * share * (1 - share) + 1), prior)
    toxic, safe = spread(1, 1 << TOKEN_BITS)
    times = n_safe / n_toxic if n_toxic and n_safe else 0.0
    safety = _terms(toxic * times, safe, np.sqrt(times**2 * toxic + safe + 1), prior) * (times > 0)
    return quality.astype(np.float32), safety.astype(np.float32)


def _terms(expected: np.ndarray, target: np.ndarray, deviation: np.ndarray, prior: float) -> np.ndarray:
    term = np.log((target + prior) / (expected + prior))
    return np.where(np.abs(target - expected) < SIGNIFICANT * deviation, 0.0, term)


def _emit_scores(models) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        quality, safety = (m.astype(np.float64) for m in models.value)
        for batch in batches:
            for part in slices(batch, limit=SMALL_SLICE_BYTES):
                docs, bucket, token_docs, tokens = features(part.column("text"))
                n = part.num_rows
                # without any feature bincount gives integers
                sums = [np.bincount(at, weights=w, minlength=n).astype(np.float64) for at, w in ((docs, quality[bucket]), (token_docs, safety[tokens]))]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "tag": part.column("tag"), "n_tokens": np.bincount(token_docs, minlength=n).astype(np.int64),
                    "quality_ratio": np.round(sums[0], 6), "safety_ratio": np.round(sums[1], 6),
                })

    return emit


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The cut with the least TRUSTED_WEIGHT * share of good below it + share of bad at or above it; the least on ties."""
    if not len(good) or not len(bad):
        return 0.0
    values = np.unique(np.r_[good, bad])
    below = np.searchsorted(np.sort(good), values) / len(good)
    above = 1 - np.searchsorted(np.sort(bad), values) / len(bad)
    cost = TRUSTED_WEIGHT * below + above
    at = np.flatnonzero(np.isclose(cost, cost.min()))[0]
    return float((values[at - 1] + values[at]) / 2) if at else float(values[at])


def weigh(docs: DataFrame, labels: DataFrame, prior: float = PRIOR, most: int = LABELLED) -> DataFrame:
    """Staged doc_id, tag (hash of the text), n_tokens, quality_ratio, safety_ratio and log_weight of each row of ``docs``."""
    known = stage(labelled(labels, most), "labelled")
    models = docs.sparkSession.sparkContext.broadcast(log_ratios(model_counts(docs, known), prior))
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), "text")
    schema = "doc_id long, tag long, n_tokens long, quality_ratio double, safety_ratio double"
    scored = stage(rows.mapInArrow(_emit_scores(models), schema), "ratios")
    seen = scored.join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(
        *[F.min(c).alias(c) for c in ("quality_ratio", "safety_ratio")], *[F.max(c).alias(c) for c in ("junk", "toxic")]
    ).toArrow()  # at most 3 * LABELLED rows
    junk, toxic, quality, safety = (seen.column(c).to_numpy() for c in ("junk", "toxic", "quality_ratio", "safety_ratio"))
    cuts = best_cut(quality[junk == 0], quality[junk == 1]), best_cut(safety[toxic == 0], safety[toxic == 1])
    weight = F.least(F.col("quality_ratio") - cuts[0], F.col("safety_ratio") - cuts[1])
    return scored.withColumn("log_weight", F.round(weight, 6))


def gumbel(seed: int) -> Column:
    """Standard Gumbel noise of a row, from a hash of its doc_id and tag."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "tag"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def resample(docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE, seed: int = SEED, **fit) -> DataFrame:
    """doc_id, tag, n_tokens, both ratios, log_weight, gumbel_key and selected for every row of ``docs``."""
    scored = weigh(docs, labels, **fit)
    keyed = scored.withColumn("gumbel_key", F.round(F.col("log_weight") + temperature * gumbel(seed), 6))
    k = scored.where("log_weight >= 0").count()
    return select_top(keyed, k)


def select_top(keyed: DataFrame, k: int) -> DataFrame:
    """``keyed`` with ``selected``: whether the row is among the k largest by (gumbel_key, doc_id, tag).

    No global sort: the key of rank k is found by counting keys in ever finer cells, each step one aggregate of at
    most CELLS rows; rows that tie with it are ranked among themselves.
    """
    keyed = stage(keyed, "gumbel-keys")
    lo, hi = keyed.agg(F.min("gumbel_key"), F.max("gumbel_key")).first()
    if k <= 0 or lo is None:
        return keyed.withColumn("selected", F.lit(False))
    cells, above = 4096, 0  # rows above hi
    while True:
        width = (hi - lo) / cells
        if width < 1e-6:
            break
        inside = keyed.where((F.col("gumbel_key") >= lo) & (F.col("gumbel_key") <= hi))
        cell = F.least(F.floor((F.col("gumbel_key") - lo) / width), F.lit(cells - 1))
        table = sorted(((r["c"], r["n"], r["lo"], r["hi"]) for r in inside.groupBy(cell.alias("c")).agg(F.count("*").alias("n"), F.min("gumbel_key").alias("lo"), F.max("gumbel_key").alias("hi")).collect()), reverse=True)
        for _, n, cell_lo, cell_hi in table:
            if above + n >= k:
                lo, hi = cell_lo, cell_hi
                break
            above += n
        else:
            return keyed.withColumn("selected", F.lit(True))
        if lo == hi or len(table) == 1:
            break
    edge = keyed.where((F.col("gumbel_key") >= lo) & (F.col("gumbel_key") <= hi))
    counts, last, seen = edge.groupBy("gumbel_key").agg(F.count("*").alias("n")), None, F.lit(True)
    while last is None:
        ties = counts.where(seen).orderBy(F.desc("gumbel_key")).limit(cells).collect()
        if not ties:
            return keyed.withColumn("selected", F.col("gumbel_key") >= lo)
        for row in ties:
            if above + row["n"] >= k:
                last = row["gumbel_key"]
                break
            above += row["n"]
        seen = F.col("gumbel_key") < ties[-1]["gumbel_key"]
    among = keyed.where(F.col("gumbel_key") == last).select("doc_id", "tag").distinct().orderBy("doc_id", "tag").limit(max(k - above, 0))
    tied = keyed.where(F.col("gumbel_key") == last).count()
    if above + tied <= k:
        return keyed.withColumn("selected", F.col("gumbel_key") >= last)
    picked = among.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), F.lit(True).alias("_in"))
    out = keyed.join(picked, keyed["doc_id"].eqNullSafe(F.col("_id")) & (keyed["tag"] == F.col("_tag")), "left")
    chosen = (F.col("gumbel_key") > last) | ((F.col("gumbel_key") == last) & F.coalesce("_in", F.lit(False)))
    return out.select(*[keyed[c] for c in keyed.columns], chosen.alias("selected"))


def keep_selected(docs: DataFrame, labels: DataFrame, temperature: float = TEMPERATURE, **fit) -> DataFrame:
    """The selected rows of ``docs``, all columns."""
    id_, tag = fresh(docs.columns, "left_id", "left_tag")
    left = resample(docs, labels, temperature, **fit).where("not selected").select(F.col("doc_id").alias(id_), F.col("tag").alias(tag)).distinct()
    return without(docs, stage(left, "rejected-rows"), [docs["doc_id"], F.xxhash64(F.coalesce(docs["text"], F.lit("")))])
