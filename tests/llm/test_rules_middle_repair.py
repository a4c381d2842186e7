"""Repetition rules, fill-in-the-middle and conversation repair against brute force over odd rows."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import brute
from tests.llm.test_operators import DOCS, corpus, frame, prose, repeated, same  # noqa: F401
from tickloom.llm import conversation_repair, fill_in_middle, repetition
from tickloom.llm.words import Rolling

# repetition rules ---------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def loops():
    rng = random.Random(3)
    phrase = prose(rng, 12)
    return [
        (1, phrase + " " + phrase), (2, (phrase + "\n") * 3 + "  \n\n" + phrase + " \n" + prose(rng, 50)), (3, "a " * 500), (4, "x|y " * 30),
        (5, "é è " + prose(rng, 40) + " é è"), (6, "one\ntwo\none\r\none\n\n\n"), (7, prose(rng, 19)), (8, prose(rng, 20)), (9, prose(rng, 300, 3)), (10, "#$%" * 9),
        (11, "w " * 7), (12, "\n \t\n"), (13, phrase + "\x0b" + phrase.replace(" ", " ")),
    ]


def judged(text):
    n_words, chars, symbols, _, words, line_chars, *covered = found = brute.repetition(text)
    failed = n_words < 20 or 100 * words > 30 * n_words
    over = any(100 * c > limit * chars for c, limit in zip(covered, (15, 14, 13, 12, 11, 10)))
    return *found, failed, not (failed or over or 100 * line_chars > 20 * chars or 100 * symbols > 10 * n_words)


def test_repetition(spark, corpus, loops):  # noqa: F811
    rows = repeated(corpus) + loops
    found = repetition.judge(frame(spark, rows).repartition(3))
    same([tuple(r) for r in found.collect()], [(d, *judged(t)) for d, t in rows])


def test_other_limits_and_empty_table(spark, loops):
    found = repetition.judge(frame(spark, loops), {2: 50}, base_window=3, fewest=1, most=100, symbol_limit=10_000, line_limit=100)
    want = []
    for d, t in loops:
        words, chars, _, _, _, _, two = brute.repetition(t, (2,), 3)
        want.append((d, words >= 1 and 100 * two <= 50 * chars))
    same([(r["doc_id"], r["kept"]) for r in found.collect()], want)
    assert repetition.judge(spark.createDataFrame([], DOCS)).collect() == []
    with pytest.raises(ValueError):
        repetition.judge(frame(spark, loops), {0: 5})


class Weak(Rolling):
    """Hashes of three values only."""

    def of(self, starts, ends):
        return super().of(starts, ends) % np.uint64(3)


def test_windows_are_told_apart_when_hashes_collide():
    rng = np.random.default_rng(1)
    ids, doc = rng.integers(0, 6, 400), np.repeat([0, 1], 200)
    at = np.flatnonzero(np.r_[doc[3:] == doc[:-3], [False] * 3])
    assert (repetition.repeated_words(ids, doc, at, 4, Weak) == repetition.repeated_words(ids, doc, at, 4)).all()
    places = {}
    for i in at:
        places.setdefault((doc[i], *ids[i : i + 4]), []).append(i)
    want = {p for x in places.values() if len(x) > 1 for i in x for p in range(i, i + 4)}
    assert set(np.flatnonzero(repetition.repeated_words(ids, doc, at, 4, Weak))) == want


def test_long_text_of_repetitions(spark):
    text = "one two three " * 200_000
    row = repetition.judge(frame(spark, [(1, text)])).first()
    assert row["n_words"] == row["n_repeat_words"] == 600_000 and row["base_failed"] and not row["kept"]


# fill in the middle -----------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def scripts():
    rng = random.Random(9)
    passage = prose(rng, 4_000) + "\n"
    return [
        (20, passage + "end"), (21, "start " + passage), (22, "ñ" * 30_000), (23, "語\n" * 9_000), (24, "a<P>b"), (25, "<S"), (26, "x <M> " * 3), (27, "<" * 50),
        (28, "😀 é́\n\n b" * 700), (29, "\n"), (30, " "), (31, "\n\nlast\n"), (32, "<P" + ">"), (33, passage * 5), (34, "a" * 100_000), (-5, passage[:5000]),
    ]


@pytest.mark.parametrize("unit", ["chars", "words", "lines"])
def test_fill_in_middle(spark, corpus, scripts, unit):  # noqa: F811
    rows = repeated(corpus) + scripts + [(i + 1000, t) for i, t in scripts] + [(i + 2000, t) for i, t in scripts]
    found = fill_in_middle.transform(frame(spark, rows).repartition(2), unit)
    want = [brute.middle(d, t, unit) for d, t in rows]
    same([tuple(r) for r in found.collect()], want)
    assert {w[2] for w in want} == {"plain", "psm", "spm"}
    digests = fill_in_middle.with_digests(found).collect()
    same([tuple(r) for r in digests], [(*w[:5], brute.sha(w[5]), brute.sha(t or "")) for w, (_, t) in zip(want, rows)])


def test_fill_in_middle_of_an_empty_table_and_unknown_units(spark):
    assert fill_in_middle.transform(spark.createDataFrame([], DOCS)).collect() == []
    with pytest.raises(ValueError):
        fill_in_middle.transform(spark.createDataFrame([], DOCS), "tokens")


def test_chunks_depend_on_content_and_summaries_are_shared(scripts):
    passage = scripts[-1][1].encode()
    texts = [b"some other beginning of a text " + passage, passage, passage + b"z" * 40_000]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    begin, end = fill_in_middle.chunk_ends(data, np.r_[0, ends[:-1]], ends)
    assert (begin[1:] == end[:-1]).all() and begin[0] == 0 and end[-1] == len(data) and set(ends) <= set(end)
    assert (end - begin).max() <= fill_in_middle.MOST_BYTES
    chunks = [data[a:b].tobytes() for a, b in zip(begin, end)]
    assert len(set(chunks)) < 0.6 * len(chunks)
    summaries = fill_in_middle.Summaries("words")
    first = summaries.of(chunks)
    summaries._work_out = None  # all are known now
    assert (summaries.of(chunks) == first).all()
    alone = np.concatenate([fill_in_middle.Summaries("words").of([c]) for c in chunks])
    assert (alone == first).all()


def test_cache_keeps_its_size():
    summaries = fill_in_middle.Summaries("chars")
    for i in range(40):
        summaries.of([bytes([i]) * (1 << 20), b"x"])
    assert sum(map(len, summaries.young)) + sum(map(len, summaries.old)) <= 2 * fill_in_middle.CACHE_BYTES + (2 << 20)
    assert summaries.of([b"x"]).tolist() == [[0, 1, 1, 1]]


# conversation repair ----------------------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, row long, audit string, part int"


def talk(rng, conv, n):
    roles = ["user", "assistant", "system", "User", "", "tool", "sage", None]
    texts = ["Yes.", "No", "", None, "  \t", "Go on! ", "a\nb?", "Yes.", "é…", "so it is.\x0b"]
    weights = [6, 6, 2, 1, 1, 1, 1, 1]
    return [(conv, rng.choice([None, i, i, i, i // 2, i + 3]), rng.choices(roles, weights)[0], rng.choice(texts) if rng.random() < 0.6 else f"line {rng.randrange(99)}.") for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS)


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(7)
    rows = [r for conv in range(60) for r in talk(rng, conv, rng.randrange(1, 14))]
    rows += [(100, i, ["user", "assistant"][i % 2], f"turn {i}.") for i in range(60)] + [(101, i, "tool", f"t {i}") for i in range(70)]
    rows += [(102, 0, "system", "Only."), (103, 0, "system", "Cut"), (None, 1, "user", "Null conversation."), (None, None, "assistant", "Same.")]
    rows += [(104, 5, "user", "same row.")] * 9 + [(105, -(1 << 63), "user", "far."), (105, (1 << 63) - 1, "assistant", "off.")]
    rows += [(106, 1, "assistant", "long " * 20_000 + "."), (106, 0, "u" * 100, "long role.")]
    return rows


def expected(rows, all_ids):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = []
    for conv in all_ids:
        *numbers, audit, text = brute.repair(by[conv]) if conv in by else (0, 0, 0, 0, 0, 0, "", "")
        out.append((conv, min(numbers[0], (1 << 63) - 1), *numbers[1:], audit, brute.sha(text)))
    return out


@pytest.mark.parametrize("block_rows", [8192, 3, 1])
def test_repair(spark, talks, block_rows):
    ids = {r[0] for r in talks} | {777}
    conversations = spark.createDataFrame([(i,) for i in ids], "conv_id long")
    found = conversation_repair.report(table(spark, talks), conversations, block_rows)
    same([tuple(r) for r in found.collect()], expected(talks, ids))


def test_damage_and_repair(spark, talks):
    damaged = conversation_repair.damage(table(spark, talks))
    same([tuple(r) for r in damaged.collect()], brute.damaged(talks))
    found = conversation_repair.report(damaged, table(spark, talks))
    same([tuple(r) for r in found.collect()], expected(brute.damaged(talks), {r[0] for r in talks}))


def test_repaired_rows(spark, talks):
    _, repaired = conversation_repair.repair(table(spark, talks), 5)
    by = {}
    for r in repaired.orderBy("conv_id", "seq").collect():
        by.setdefault(r["conv_id"], []).append(r)
    for conv, rows in by.items():
        assert [r["seq"] for r in rows] == list(range(len(rows)))
        own = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in talks if c == conv]
        assert "\n".join(f"{r['role']}:{r['text']}" for r in rows) == brute.repair(own)[-1]


def test_repair_of_an_empty_table(spark):
    none = spark.createDataFrame([], TURNS)
    assert conversation_repair.report(none, none).collect() == []
    audited, repaired = conversation_repair.repair(none)
    assert audited.collect() == [] and repaired.collect() == []


@pytest.mark.parametrize("hashed", [None, lambda before, edit: ord(edit) % 3, lambda before, edit: 1])
def test_edit_strings_are_told_apart_when_hashes_collide(hashed):
    rng, edits, known = random.Random(2), conversation_repair.Edits(hashed), {"": 0}
    for _ in range(400):
        before = rng.choice([*known][-40:])
        edit = rng.choice("DIKR")
        node = edits.add(known[before], edit)
        assert known.setdefault(before + edit, node) == node and edits.text(node) == before + edit
    names = rng.sample([*known], 60)
    for a in names:
        for b in names:
            assert edits.less(known[a], known[b]) == (a < b)
    assert len(set(edits.hash)) == len(edits.hash)


def test_conversation_over_several_ranges(spark):
    rng = random.Random(11)
    rows = [(1, i, rng.choice(["user", "assistant", "tool"]), f"row {i}" + "." * (i % 3)) for i in range(3_000)] + [(2, 0, "user", "a."), (0, 0, "user", "b.")]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = conversation_repair.report(table(spark, rows), table(spark, rows), 256).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    same([tuple(r) for r in found], expected(rows, {0, 1, 2}))
