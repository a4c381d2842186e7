"""Benchmark decontamination by a broadcast hash set of n-grams, in DataFrame functions only.

Both sides are normalised to words: A-Z become lower case, then runs of characters other than ASCII separators. The
windows of a benchmark item are its ``size`` consecutive words; a shorter item is one window of all its words. Documents
are read once: each gives a marker row and a row for every window, all of which probe the set of benchmark windows.
Windows are compared as text, so a hit needs no further proof. The set is broadcast where its row count is below
``BROADCAST_WINDOWS``; a larger benchmark is joined by shuffle, with the same result.

Defined cases: a null text has no words, a null doc_id stays null; rows that share a doc_id, equal or not, are scored
each on its own; items without words have no window; without items nothing is hit. Items are counted by item_id: rows
of one id are one item, a null id counts as no item but its windows hit. Other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.rows import without
from tickloom.llm.words import fresh
from tickloom.session import stage

SIZE = 10
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows of about 100 bytes: some 100 MB on each executor at the most.
BROADCAST_WINDOWS = 1_000_000


def words(text: Column) -> Column:
    low = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(low, SEPARATORS), "")


def _windows(size: int, array: str = "words") -> Column:
    """The windows of ``size`` words of an array column, as text."""
    return F.expr(
        f"case when size({array}) >= {size} then transform(sequence(1, size({array}) - {size - 1}), "
        f"i -> concat_ws(' ', slice({array}, i, {size}))) else cast(array() as array<string>) end"
    )


def benchmark_windows(benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """Distinct windows: gram, length in words, items (distinct item ids)."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    whole = F.array(F.concat_ws(" ", "words"))
    grams = F.when(F.size("words") < size, whole).otherwise(_windows(size))
    rows = items.select("item_id", F.least(F.size("words"), F.lit(size)).alias("length"), F.explode(grams).alias("gram"))
    return rows.groupBy("gram", "length").agg(F.collect_set("item_id").alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """One row for each row of ``docs`` (start null) and one for each of its windows that occurs in the benchmark.

    Columns: row (tells rows of ``docs`` apart), doc_id, tag (hash of the text), n_words, start, length, items.
    """
    known = stage(benchmark_windows(benchmark, size), "benchmark-windows")
    sizes = [r["length"] for r in known.select("length").distinct().orderBy(F.desc("length")).collect()]  # at most ``size`` rows
    few = known.count() <= BROADCAST_WINDOWS
    split = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("tag"), words(F.col("text")).alias("words")
    )
    marker = F.array(F.concat(F.lit("#"), F.col("row").cast("string")))
    grams = F.concat(marker, *[_windows(n) for n in sizes])
    probes = split.select("row", "doc_id", "tag", F.size("words").alias("n_words"), F.posexplode(grams).alias("at", "gram"))
    found = probes.join(F.broadcast(known) if few else known, "gram", "left").where("length is not null or at = 0")
    start, before = F.lit(None).cast("int"), F.lit(1)
    for n in sizes:
        start = F.when(F.col("length") == n, F.col("at") - before).otherwise(start)
        before = before + F.greatest(F.col("n_words") - (n - 1), F.lit(0))
    return found.select("row", "doc_id", "tag", "n_words", start.alias("start"), "length", "items")


def score(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and items (their ids as text)."""
    before = Window.partitionBy("row").orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("length")
    found = hits(docs, benchmark, size)
    found = found.withColumn("covered", F.coalesce(F.max(end).over(before), F.lit(0)))
    found = found.withColumn("new", F.greatest(end - F.greatest("start", "covered"), F.lit(0)))
    out = found.groupBy("row", "doc_id", "n_words").agg(
        F.coalesce(F.sum("new"), F.lit(0)).alias("n_hit"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
    )
    ids = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return out.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), ids.alias("items"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """The rows of ``docs``, all columns, without those in which a benchmark window occurs."""
    id_, tag = fresh(docs.columns, "bad_id", "bad_tag")
    bad = hits(docs, benchmark, size).where("start is not null").select(F.col("doc_id").alias(id_), F.col("tag").alias(tag)).distinct()
    return without(docs, stage(bad, "leaking-rows"), [docs["doc_id"], F.xxhash64(F.coalesce(docs["text"], F.lit("")))])


def cut_spans(docs: DataFrame, benchmark: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_words, kept_text: the normalised words of each row outside all hits, joined by one space."""
    docs = docs.select("doc_id", "text")
    spans = hits(docs, benchmark, size).where("start is not null")
    spans = spans.groupBy(F.col("doc_id").alias("bad_id"), F.col("tag").alias("bad_tag")).agg(F.collect_set(F.struct("start", "length")).alias("spans"))
    same = (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == F.col("bad_tag")) & docs["doc_id"].eqNullSafe(F.col("bad_id"))
    rows = docs.join(spans, same, "left").select(docs["doc_id"], words(docs["text"]).alias("words"), "spans")
    kept = "filter(words, (w, i) -> not exists(coalesce(spans, array()), s -> i >= s.start and i < s.start + s.length))"
    return rows.select("doc_id", F.size("words").alias("n_words"), F.expr(f"array_join({kept}, ' ')").alias("kept_text"))
