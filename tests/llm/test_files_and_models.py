"""Packing, token files, chat, quality and the pipeline: exact round trips, optimal bounds, held-out labels."""

from __future__ import annotations

import random
import sys
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.test_operators import frame
from tickloom.llm import chat, packing, quality, token_files
from tickloom.llm.tokens import PieceEncoder, tokenizer_path

ODD = [
    "", "  ", "a  b", "\n", "\na\n\nb\n", " x", "x ", "   x y", "tab\tx  y\n \nz", "a\x1c b", None, "a\r\nb c\n\n\n\nd   e",
    "don't. we'll, it's'. x_y. 3,4. <|endoftext|>. <|startoftext|> b<|endoftext|>c", "É È é. ́a b ́c W̊ T̈",
    "Σας ΣΑΣ. ΑΣ", "a\xa0 b\xa0  c d", "%%%&& foo%%%. bar&.&", "中文。 字. 한국어. १२३. x²! ½.", "\U0001F600.😀 !", "a\x85 b\x85c  \x0b d",
]


def reference_ids(name, texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path(name))
    return [whole.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_encode_like_the_library(name):
    rng = random.Random(1)
    made = ["".join(rng.choice("aB é.,'\n \t%|1_-#") for _ in range(rng.randrange(80))) for _ in range(400)]
    texts = ODD + made + made[:20]
    encoder = PieceEncoder(name)
    for _ in range(2):  # the second time from the table of known pieces
        ids, begin = encoder.encode(pa.array(texts), 2)
        assert [ids[a:z].tolist() for a, z in zip(begin[:-1], begin[1:])] == reference_ids(name, texts)


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "Delta."]) for _ in range(rng.randrange(1, 60)))) for i in range(150)]
    return rows + [(200, "long " * 3000), (201, None), (202, ""), (203, "x " * 1023), (None, "null id"), (5, "another of five"), (7, rows[7][1])]


def check_packing(found, texts, most):
    ids = Counter()
    expected = Counter((d, crc(x), len(x)) for (d, _), x in zip(texts, reference_ids("byte_bpe_50k.json", [t for _, t in texts])))
    by_doc = {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
    assert sum(r["length"] for r in found) == sum(n * c for (_, _, n), c in expected.items())
    for doc, n in Counter(d for d, _ in texts).items():
        own = sorted(by_doc[doc], key=lambda r: r["piece"])
        if n == 1:
            at = 0
            for k, r in enumerate(own):
                assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == most)
                at += r["length"]
        assert all(0 < r["length"] <= most for r in own)
        if n == 1 and len(own) == 1:
            ids[(doc, own[0]["ids_crc32"], own[0]["length"])] += 1
    assert not ids - expected
    places = {}
    for r in found:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= most
    return places


@pytest.mark.parametrize("most", [1024, 50])
def test_packing(spark, texts, most):
    found = packing.pack(frame(spark, texts), max_tokens=most).collect()
    places = check_packing(found, texts, most)
    bound = -(-sum(r["length"] for r in found) // most)
    assert len(places) <= bound * 1.1 + 1


def test_packing_keeps_every_capacity(spark, texts):
    for score in ("dot", "norm"):
        found = packing.pack(frame(spark, texts), max_tokens=256, max_docs=3, max_cost=256 * 256 // 2 + 40_000, score=score).collect()
        places = check_packing(found, texts, 256)
        assert max(len(s) for s in places.values()) <= 3
        assert max(sum(n * n for _, n in s) for s in places.values()) <= 256 * 256 // 2 + 40_000


def least_bins(histogram, most):
    """A lower bound: pieces over most - k stand apart from those of k or more, for each k."""
    best = 0
    for k in range(most // 2 + 1):
        apart = sum(c for n, c in histogram.items() if n > most - k)
        large = {n: c for n, c in histogram.items() if most // 2 < n <= most - k}
        small = sum(n * c for n, c in histogram.items() if k <= n <= most // 2)
        room = sum((most - n) * c for n, c in large.items())
        best = max(best, apart + sum(large.values()) + max(0, -(-(small - room) // most)))
    return best


def test_runs_place_every_piece_once():
    rng = random.Random(9)
    for score in ("dot", "norm"):
        histogram = {n: rng.randrange(1, 400) for n in rng.sample(range(1, 1025), 200)}
        bins, ranks = {}, Counter()
        for length, first, many, sequence, offset in packing.plan_runs(histogram, 1024, 1024, 1024**2, score):
            assert first == ranks[length]
            ranks[length] += many
            for i in range(many):
                assert bins.get(sequence + i, 0) == offset
                bins[sequence + i] = offset + length
        assert dict(ranks) == histogram and max(bins.values()) <= 1024
        assert len(bins) <= 1.02 * least_bins(histogram, 1024) + 1
    with pytest.raises(ValueError):
        packing.plan_runs({2000: 1}, 1024, 10, 10**9)


def test_packing_of_nothing(spark):
    assert packing.pack(frame(spark, [])).count() == 0


@pytest.mark.parametrize("shard_tokens", [1 << 18, 500])
def test_token_files(spark, texts, tmp_path, shard_tokens):
    path = str(tmp_path / "ids")
    token_files.write(frame(spark, texts), path, shard_tokens=shard_tokens)
    found = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r["start"])
    ids = reference_ids("word_bpe_49k.json", [t for _, t in texts])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == Counter((d, len(x), crc(x)) for (d, _), x in zip(texts, ids))
    at = 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
    keys = [r["doc_id"] for r in found]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in token_files.read_keys(spark, path, [3, 5, 7, 200, 12345, -1]).collect())
    assert got == Counter((d, tuple(x)) for (d, _), x in zip(texts, ids) if d in (3, 5, 7, 200))


def test_token_files_of_nothing(spark, tmp_path):
    token_files.write(frame(spark, []), str(tmp_path / "none"))
    assert token_files.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_perfect_hash_is_a_bijection_and_rejects_other_keys():
    rng = np.random.default_rng(1)
    for n in [*range(1, 40), 500, 5000]:
        keys = np.unique(rng.integers(-(10**15), 10**15, n))
        displacements, slots = token_files.perfect_hash(keys)
        assert sorted(slots) == list(range(len(keys)))
        assert (token_files.find_slots(keys, displacements, len(keys)) == slots).all()


CONVERSATIONS = "conv_id long, turn long, role string, text string, seq long, message string"


def turns_by_hand(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        out.setdefault(conv, []).append((role or "", text or ""))
    return {
        c: (len(t), brute.sha("".join(f"{r}\n{x}\n" for r, x in t)), sum(len(x) for r, x in t if r == "assistant"), brute.sha("".join(x for r, x in t if r == "assistant")))
        for c, t in out.items()
    }


def test_chat_round_trip(spark):
    rng = random.Random(6)
    bits = ["###", "</turn>", "\\", "### assistant:\n ", " </turn>\n", "é😀", "\n", " ", "word", "#", "</tur", "\\\\###"]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\\n\nrole"]), "".join(rng.choice(bits) for _ in range(rng.randrange(30)))) for c in range(20) for t in range(rng.randrange(1, 9))]
    rows += [(50, 0, "user", None), (50, 1, "assistant", ""), (None, 0, "assistant", "null id"), (51, None, "user", "no turn"), (52, 0, "assistant", "é" * 20_000)]
    rows += [(53, 0, "user", "same"), (53, 0, "user", "same"), (53, 1, "assistant", "a")]
    turns = spark.createDataFrame([(*r, 9, "x") for r in rows], CONVERSATIONS)
    found = {r["conv_id"]: tuple(r)[1:5] for r in chat.summarize(chat.format_log(chat.turns_as_events(turns))).collect()}
    assert found == turns_by_hand(rows)
    assert chat.summarize(chat.format_log(chat.turns_as_events(turns.limit(0)))).count() == 0


def test_logs_fold_deltas_edits_and_regenerations(spark):
    log = [
        (1, 0, "create", 10, "user", "Hel"), (1, 1, "delta", 10, None, "lo"), (1, 2, "create", 11, "assistant", ""),
        (1, 3, "delta", 11, None, "bad"), (1, 4, "regenerate", 11, None, "ignored"), (1, 6, "delta", 11, None, "better"),
        (1, 5, "delta", 11, None, "much "), (1, 7, "edit", 10, None, "Hi"), (1, 8, "delta", 10, None, "!"), (2, 0, "delta", 1, "user", None),
    ]
    random.Random(2).shuffle(log)
    events = spark.createDataFrame(log, chat.EVENTS)
    folded = {(r["conv_id"], r["message"]): (r["seq"], r["role"], r["text"]) for r in chat.fold(events).collect()}
    assert folded == {(1, 10): (0, "user", "Hi!"), (1, 11): (2, "assistant", "much better"), (2, 1): (0, "user", "")}
    blocks = chat.render(chat.fold(events)).orderBy("conv_id", "seq").collect()
    assert "".join(b["block"] for b in blocks[:2]) == "### user:\n Hi! </turn>\n### assistant:\n much better </turn>\n"
    assert blocks[1]["block"][blocks[1]["loss_start"] : blocks[1]["loss_end"]] == "much better"
    assert blocks[0]["loss_start"] == blocks[0]["loss_end"]


SF = "/root/testdata/sf0.01"


def test_quality_on_held_out_labels(spark):
    """Half of the labels are fitted, the other half judged."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    fitted = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    rows = quality.resample(docs, fitted).join(labels.join(fitted, "doc_id", "left_anti"), "doc_id").collect()
    kept = lambda ok: np.mean([r["selected"] for r in rows if ok(r)])
    assert kept(lambda r: r["quality"] == 1 and r["toxic"] == 0) > 0.97
    assert kept(lambda r: r["quality"] == 0) < 0.1
    assert kept(lambda r: r["toxic"] == 1) < 0.5


def test_scores_are_the_ratios_of_the_models(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    known = {r["doc_id"]: r for r in labels.collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    raw, target, toxic, safe, n = Counter(), Counter(), Counter(), Counter(), Counter()
    seen = {}
    for doc, text in rows:
        _, bucket, _, token = quality.features(pa.array([text]))
        seen[doc], label = (bucket.tolist(), token.tolist()), known.get(doc)
        raw.update(set(bucket.tolist()))
        n["all"] += 1
        if label:
            (toxic if label["toxic"] else safe).update(set(token.tolist()))
            n["toxic" if label["toxic"] else "safe"] += 1
            if label["quality"] and not label["toxic"]:
                target.update(set(bucket.tolist()))
                n["good"] += 1

    def term(expected, got, deviation):
        return np.log((got + quality.PRIOR) / (expected + quality.PRIOR)) if abs(got - expected) >= quality.SIGNIFICANT * deviation else 0.0

    f, times = n["good"] / n["all"], n["safe"] / n["toxic"]
    for r in quality.weigh(docs, labels).where("doc_id % 20 = 0").collect():
        bucket, token = seen[r["doc_id"]]
        assert r["quality_ratio"] == pytest.approx(sum(term(raw[b] * f, target[b], (raw[b] * f * (1 - f) + 1) ** 0.5) for b in bucket), abs=1e-3)
        assert r["safety_ratio"] == pytest.approx(sum(term(toxic[b] * times, safe[b], (times**2 * toxic[b] + safe[b] + 1) ** 0.5) for b in token), abs=1e-3)
        assert r["n_tokens"] == len(token)


def test_quality_of_odd_rows(spark):
    rows = [(1, "good words here"), (2, "bad bad bad ###"), (3, None), (4, ""), (1, "twin"), (None, "no id"), (2, "bad bad bad ###")]
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (4, None, 0), (None, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.resample(frame(spark, rows), labels).collect()
    assert len(found) == len(rows)
    assert quality.resample(frame(spark, []), labels).count() == 0
    assert quality.resample(frame(spark, rows), labels.limit(0)).count() == len(rows)
    kept = quality.keep_selected(frame(spark, rows), labels)
    assert kept.columns == frame(spark, rows).columns


@pytest.mark.parametrize("k", [0, 1, 7, 500, 999, 1000, 5000])
def test_top_k_without_a_sort(spark, k):
    keys = np.round(np.random.default_rng(3).normal(size=1000) * 50, 1).tolist()
    rows = spark.createDataFrame([(i, i * 7 % 13, x) for i, x in enumerate(keys)], "doc_id long, tag long, gumbel_key double")
    chosen = [(r["gumbel_key"], r["doc_id"]) for r in quality.select_top(rows, k).collect() if r["selected"]]
    best = sorted(((x, i) for i, x in enumerate(keys)), key=lambda p: (-p[0], p[1]))[:k]
    assert sorted(chosen) == sorted(best)


def test_gumbel_noise_follows_the_weights(spark):
    """At temperature 1, taking one of two documents picks each in proportion to its weight."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit(5).cast("long").alias("tag"))
    noise = np.array([r[0] for r in rows.orderBy("doc_id").select(quality.gumbel(3)).collect()])
    assert noise.mean() == pytest.approx(np.euler_gamma, abs=0.03) and noise.var() == pytest.approx(np.pi**2 / 6, rel=0.05)
    for weight in (0.5, 1.0, 2.0):
        share = np.mean(weight + noise[::2] > noise[1::2])
        assert share == pytest.approx(np.exp(weight) / (1 + np.exp(weight)), abs=0.02)


def test_pipeline_against_its_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]
    kept = cp.quality_classifier(spark, docs, SF)
    selected = quality.resample(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("selected")
    assert kept.columns == docs.columns and {r[0] for r in kept.select("doc_id").collect()} == {r["doc_id"] for r in selected.collect()}
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    near = [(d, t) for (d, t), (_, _, c) in zip(rows, brute.jaccard_components(rows, 5, 80)) if d == c]
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [(d, t) for (d, t), r in zip(near, brute.decontamination(near, bench)) if not r[5]]
    out = cp.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == {d for d, _ in clean}
    untouched = {d: t for d, t in clean if not brute.base_spans(t)}
    ids = dict(zip(untouched, reference_ids("byte_bpe_50k.json", untouched.values())))
    lengths = Counter()
    for r in out:
        lengths[r["doc_id"]] += r["length"]
    assert all(lengths[d] == len(x) for d, x in ids.items())


def test_queries_run_without_the_package_on_the_workers_path(tmp_path):
    """Functions reach Python workers by value: a session started elsewhere, with an empty PYTHONPATH."""
    import os
    import subprocess

    code = (
        "import sys; sys.path.insert(0, sys.argv[1])\nimport __spark_entry__ as e\nfrom pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()\n"
        "print('ROWS', e.queries()['op6_secret_scan'](s, '/root/testdata/sf0.001').count())\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 200" in said.stdout, said.stderr[-2000:]


def test_encoding_starts_no_search_for_cycles():
    import gc

    encoder = PieceEncoder("word_bpe_49k.json")
    texts = pa.array([" ".join(f"w{k}x" for k in range(n, n + 20_000)) for n in (0, 20_000)])
    runs = []
    watch = lambda phase, info: runs.append(phase)
    gc.callbacks.append(watch)
    try:
        encoder.encode(texts, 2)
        found = len(runs)
    finally:
        gc.callbacks.remove(watch)
    assert found == 0 and gc.isenabled()


def test_workers_take_little_memory_for_large_batches():
    import tracemalloc

    from tickloom.llm import jaccard_join

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(words, k=400)) for _ in range(2000)]  # some 4 MB
    n = len(texts)
    batch = pa.RecordBatch.from_pydict({
        "doc_id": pa.array(range(n), pa.int64()), "id": pa.array(range(n), pa.int64()), "tag": pa.array([0] * n, pa.int32()),
        "text": texts, "good": pa.array([1] * n, pa.int32()), "toxic": pa.array([0] * n, pa.int32()),
    })
    for emit in (quality._emit_counts, jaccard_join._emit_sets(5), jaccard_join._emit_lanes(5, 80)):
        tracemalloc.start()
        for _ in emit(iter([batch])):
            pass
        _, peak = tracemalloc.get_traced_memory()
        tracemalloc.stop()
        assert peak < 48 << 20
