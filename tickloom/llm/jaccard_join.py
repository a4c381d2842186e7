"""N-gram Jaccard join by parity sketches.

The set of a document's shingles is dealt by hash into m segments, and the hashes of each segment are XORed: a sketch
of m 64-bit lanes. An element that two sets don't share disturbs one lane, so the number of differing lanes is a lower
bound of the symmetric difference. Two sets of sizes a and b that reach the threshold differ in at most D elements (D
follows from a + b), so of m = D + 1 + spare lanes at least spare + 1 are equal: pigeonhole. Sizes fall into bands;
a set sketches for its own band and, where its size can still meet the band below, for that one too. Empty lanes, which
would match by chance, are left out: of the equal lanes of a pair at most ``spare`` are empty if one of the two has no more
empty lanes than that. A set that has more (one in some hundred) sketches again with its elements dealt anew, as does any
other set like it, up to LAYERS times; so the first layer in which one of a pair has few empty lanes holds both, and the
pair is found there. Only in the last layer empty lanes stay in.

Equal lanes make groups of candidates. Most lanes belong to one set alone: one row of each set sends the first 46 bits of
its lanes, four bytes each in lists by bucket, and only lanes whose bits come twice are sent whole, with their set. So
bits that agree by chance cost a row and no link is lost. In the groups no pairs are listed at first:

1. sets that are equal count once, whatever the number of their documents;
2. each set meets the least set of its groups; a 1024-bit parity sketch (Hamming distance against D) screens the pair,
   whole texts verify it, and verified links give components;
3. in groups that still hold several components, one set of each meets one of the main component (that of the least
   label); the links found merge most of what belongs together, at a cost of one pair for each component;
4. only groups that then still hold several components are looked into: what isn't in a group's main component meets the
   rest, screened and verified as before. Pairs inside a component need no look.

Defined cases: texts without words (null ones too) have an empty set and link with nothing; a text with fewer words
than a shingle is one shingle; a null doc_id is smaller than all others, as -2^63; rows that share a doc_id are handled
as documents of their own, told apart by a hash of their text; rows that repeat give a row each. Other columns are
ignored. Sets and shingles are compared by 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.rows import parted, same, without
from tickloom.llm.substring_dedup import LEAST_ID
from tickloom.llm.words import SMALL_SLICE_BYTES, Rolling, Words, fresh, mix, signed, slices
from tickloom.operators.prefilter import likely_in, may_be_in
from tickloom.session import stage

SHINGLE = 4
PERCENT = 85
BAND_RATIO = 1.35
SKETCH_LONGS = 16
#: Lanes of each set that help to name a pair once.
FEW_LANES = 8
#: Sketches of a set, each made where the one before has too many empty lanes.
LAYERS = 8
#: Lanes are first counted by their leading bits, which go to the count in lists, one for each bucket.
BUCKET_BITS, START_BITS = 14, 32
PACKED_LANES = 1 << 20
#: Shingles whose lanes one task counts.
COUNTED_SHINGLES = 2_000_000
_LANE = np.uint64(0xA24BAED4963EE407)
_SEGMENT = np.uint64(0x5851F42D4C957F2D)


def most_different(total: int, percent: int) -> int:
    """The largest symmetric difference of two sets of ``total`` elements together whose Jaccard index is enough."""
    return (total * (100 - percent)) // (100 + percent)


def bands(largest: int, percent: int, ratio: float = BAND_RATIO) -> dict[str, np.ndarray]:
    """Size bands up to ``largest``: least size, largest partner, lanes and spare lanes."""
    low, partner, lanes, spare = [], [], [], []
    ratio, at = max(ratio, 100 / percent), 1  # so that partners lie in the same band or the next
    while at <= largest:
        after = max(at + 1, int(at * ratio))
        big = (after - 1) * 100 // percent
        differ = most_different(after - 1 + big, percent)
        expected = (differ + 1) * np.exp(-at / (differ + 1.0))
        extra = int(np.ceil(expected + 2 * np.sqrt(expected))) if differ else 0
        low.append(at), partner.append(big), lanes.append(differ + 1 + extra), spare.append(extra)
        at = after
    return {k: np.array(v, dtype=np.int64) for k, v in (("low", low), ("partner", partner), ("lanes", lanes), ("spare", spare))}


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Document index and hash of the distinct shingles, by document."""
    hashes, counts = words.hashes(), words.counts()
    at = words.windows(size)
    short = np.flatnonzero((counts > 0) & (counts < size))
    start = np.r_[at, words.first[short]]
    end = np.r_[at + size, words.first[short + 1]]
    shingle = Rolling(hashes).of(start, end)
    doc = np.searchsorted(words.first, start, side="right") - 1
    order = np.argsort(doc, kind="stable") if len(short) else np.arange(len(doc))
    doc, shingle = doc[order], shingle[order]
    keys = mix(shingle ^ mix(doc.astype(np.uint64)))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        some = np.flatnonzero(np.isin(keys, twice))
        keep = np.ones(len(keys), dtype=bool)
        keep[some] = False
        keep[some[np.unique(keys[some], return_index=True)[1]]] = True
        doc, shingle = doc[keep], shingle[keep]
    return doc, shingle


def _xor_by(group: np.ndarray, values: np.ndarray, groups: int) -> np.ndarray:
    out = np.zeros(groups, dtype=np.uint64)
    np.bitwise_xor.at(out, group, values)
    return out


def _set_ids(doc: np.ndarray, shingle: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes and identities of the sets: equal for equal sets."""
    sizes = np.bincount(doc, minlength=docs)
    return sizes, mix(_xor_by(doc, mix(shingle ^ _LANE), docs) ^ mix(sizes.astype(np.uint64)))


def _emit_sets(size: int) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SMALL_SLICE_BYTES):
                n = part.num_rows
                doc, shingle = shingle_sets(Words(part.column("text"), lower=True), size)
                sizes, own = _set_ids(doc, shingle, n)
                bit = (mix(shingle) % np.uint64(64 * SKETCH_LONGS)).astype(np.int64)
                sketch = _xor_by(doc * SKETCH_LONGS + bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64), n * SKETCH_LONGS)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * SKETCH_LONGS), pa.array(signed(sketch)))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"), "id": part.column("id"), "tag": part.column("tag"),
                    "n": sizes.astype(np.int64), "s": signed(own), "sketch": lists,
                })

    return emit


def lane_keys(doc: np.ndarray, shingle: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Document index and key of every sketch lane that takes part."""
    table = bands(int(sizes.max(initial=0)), percent)
    own = np.searchsorted(table["low"], sizes, side="right") - 1
    keys, docs = [], []
    for below in (0, 1):
        level = own - below
        use = (sizes > 0) & (level >= 0)
        use[use] &= sizes[use] <= table["partner"][level[use]]
        for layer in range(LAYERS):
            if not use.any():
                break
            lanes = np.where(use, table["lanes"][np.maximum(level, 0)], 0)
            begin = np.r_[0, np.cumsum(lanes)]
            some = use[doc]
            d = doc[some]
            where = mix(shingle[some] ^ mix(_SEGMENT + np.uint64([layer]))) >> np.uint64(32)
            lane = (where * lanes[d].astype(np.uint64)) >> np.uint64(32)
            group = begin[d] + lane.astype(np.int64)
            total = int(begin[-1])
            value, filled = _xor_by(group, shingle[some], total), np.bincount(group, minlength=total) > 0
            owner = np.repeat(np.arange(len(sizes)), lanes)
            empty = lanes - np.bincount(owner[filled], minlength=len(sizes))
            sparse = use & (empty > np.where(use, table["spare"][np.maximum(level, 0)], 0))
            keep = filled | (sparse[owner] if layer == LAYERS - 1 else False)
            number = np.arange(total) - begin[owner]
            name = mix((level[owner].astype(np.uint64) << np.uint64(40)) + (np.uint64(layer) << np.uint64(36)) + number.astype(np.uint64) + _LANE)
            keys.append(mix(value ^ name)[keep]), docs.append(owner[keep])
            use = sparse
    if not keys:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(docs), np.concatenate(keys)


def _lanes(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Key of every lane and identity of its set, slice by slice."""
    seen: set[int] = set()  # equal sets of one task go out once; forgetting some costs only repeats
    for batch in batches:
        for part in slices(batch, limit=SMALL_SLICE_BYTES):
            doc, shingle = shingle_sets(Words(part.column("text"), lower=True), size)
            sizes, own = _set_ids(doc, shingle, part.num_rows)
            if len(seen) > 500_000:
                seen.clear()
            for i, s in enumerate(own.tolist()):
                if s in seen:
                    sizes[i] = 0
                seen.add(s)
            some = sizes[doc] > 0
            owner, key = lane_keys(doc[some], shingle[some], sizes, percent)
            yield key, own[owner]


def packed_starts(keys: np.ndarray) -> pa.RecordBatch:
    """The first bits of lane keys, by bucket: BUCKET_BITS name the bucket, START_BITS more a lane of it. Each at most twice."""
    heads = np.sort(keys >> np.uint64(64 - BUCKET_BITS - START_BITS))
    third = np.zeros(len(heads), dtype=bool)
    third[2:] = heads[2:] == heads[:-2]
    heads = heads[~third]
    bucket, start = (heads >> np.uint64(START_BITS)).astype(np.int32), heads.astype(np.uint32).view(np.int32)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(heads) else np.zeros(0, dtype=np.int64)
    lists = pa.ListArray.from_arrays(np.r_[first, len(heads)].astype(np.int32), pa.array(start))
    return pa.RecordBatch.from_arrays([pa.array(bucket[first]), lists], ["bucket", "starts"])


def _emit_starts(size: int, percent: int) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for key, _ in _lanes(batches, size, percent):
            held.append(key)
            n += len(key)
            if n >= PACKED_LANES:
                yield packed_starts(np.concatenate(held))
                held, n = [], 0
        if n:
            yield packed_starts(np.concatenate(held))

    return emit


def _emit_lanes(size: int, percent: int) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, s in _lanes(batches, size, percent):
            yield pa.RecordBatch.from_pydict({"lane": signed(key), "s": signed(s)})

    return emit


def _emit_links(size: int, percent: int) -> Callable:
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text_a", SMALL_SLICE_BYTES):
                n = part.num_rows
                a, x = shingle_sets(Words(part.column("text_a"), lower=True), size)
                b, y = shingle_sets(Words(part.column("text_b"), lower=True), size)
                both = np.sort(np.r_[mix(x ^ mix(a.astype(np.uint64))), mix(y ^ mix(b.astype(np.uint64)))])
                pair = np.r_[a, b]
                keys = np.r_[mix(x ^ mix(a.astype(np.uint64))), mix(y ^ mix(b.astype(np.uint64)))]
                shared = np.isin(keys, both[1:][both[1:] == both[:-1]])
                common = np.bincount(pair[shared], minlength=n) // 2
                union = np.bincount(pair, minlength=n) - common
                link = (100 * common >= percent * union) & (union > 0)
                yield pa.RecordBatch.from_arrays([part.column("a").filter(pa.array(link)), part.column("b").filter(pa.array(link))], ["a", "b"])

    return emit


def screen(a: str, b: str, percent: int):
    """Whether sizes and sketches of two sets allow a link."""
    small, large = F.least(f"n_{a}", f"n_{b}"), F.greatest(f"n_{a}", f"n_{b}")
    differ = F.aggregate(
        F.zip_with(f"sketch_{a}", f"sketch_{b}", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda total, v: total + v
    )
    most = F.floor((F.col(f"n_{a}") + F.col(f"n_{b}")) * (100 - percent) / (100 + percent))
    return (small * 100 >= large * percent) & (differ <= most)


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node that links reach, for every node of ``edges`` (a, b).

    Alternating stars: each node's larger neighbours, then its smaller ones, move to its least neighbour, until every
    edge leads to the least node of its component.
    """
    edges = stage(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct(), "edges")
    while not _is_stars(edges):
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()
        large = stage(large, "large-star")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select("m", F.explode(F.array("hi", "lo")).alias("x"))
        edges = stage(small.select(F.col("m").alias("lo"), F.col("x").alias("hi")).where("lo < hi").distinct(), "small-star")
    roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots)


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node is either only a smaller end, or a larger end of one edge."""
    ends = edges.select(F.col("hi").alias("u"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("lo", F.lit(0), F.lit(1))).groupBy("u").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return ends.where("up > 1 or (up = 1 and down > 0)").isEmpty()


def _verified(pairs: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b: sets; rep_a, rep_b: a document of each) whose texts link."""
    ends = stage(pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("rep")).select("rep.id", "rep.tag").distinct(), "pair-ends")
    texts = likely_in(rows.select("id", "tag", "text"), ends, ["id", "tag"])
    left = pairs.select("a", "b", "rep_a", F.col("rep_b.id").alias("id"), F.col("rep_b.tag").alias("tag")).join(texts, ["id", "tag"])
    left = left.select("a", "b", F.col("rep_a.id").alias("id"), F.col("rep_a.tag").alias("tag"), F.col("text").alias("text_b"))
    both = left.join(texts, ["id", "tag"]).select("a", "b", F.col("text").alias("text_a"), "text_b")
    return both.mapInArrow(_emit_links(size, percent), "a long, b long")


def as_links(found: DataFrame) -> DataFrame:
    """Components as links to their least nodes, from which further ones are found in a few rounds."""
    return found.select(F.col("component").alias("a"), F.col("node").alias("b")).where("a < b")


def without_copies(rows: DataFrame, sets: DataFrame, known: DataFrame) -> DataFrame:
    """``rows`` without those whose set another row stands for."""
    many = known.where("rows > 1").select("s", "rep")
    is_copy = F.coalesce(F.struct("id", "tag") != F.col("rep"), F.lit(False))
    marked = sets.where("n > 0").select("id", "tag", "s").join(many, "s", "left").groupBy("id", "tag").agg(F.bool_and(is_copy).alias("copy"))
    copies = stage(marked.where("copy").select(F.col("id").alias("copy_id"), F.col("tag").alias("copy_tag")), "copies")
    return without(rows, copies, [rows["id"], rows["tag"]])


def repeated_heads(packed: DataFrame, tasks: int) -> DataFrame:
    """Leading bits that lanes of ``packed`` (bucket, starts) have twice or more."""
    each = packed.repartition(tasks, "bucket").select("bucket", F.explode("starts").alias("start"))
    counted = each.groupBy("bucket", "start").agg(F.count("*").alias("n")).where("n > 1")
    start = F.col("start").cast("long").bitwiseAND((1 << START_BITS) - 1)
    return counted.select((F.shiftleft(F.col("bucket").cast("long"), START_BITS) + start).alias("head"))


def linked_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, tag (hash of its text), n_shingles, component_id (the smallest doc_id links reach)."""
    rows = docs.select(
        "doc_id", "text", F.coalesce("doc_id", F.expr(LEAST_ID)).alias("id"), F.hash(F.coalesce("text", F.lit(""))).alias("tag")
    )
    sets = stage(
        rows.mapInArrow(_emit_sets(size), "doc_id long, id long, tag int, n long, s long, sketch array<long>"), "shingle-sets"
    )
    known = sets.where("n > 0").groupBy("s").agg(F.min(F.struct("id", "tag", "n", "sketch")).alias("k"), F.count("*").alias("rows"))
    known = stage(known.select("s", F.struct("k.id", "k.tag").alias("rep"), "k.n", "k.sketch", "rows"), "set-classes")
    once = without_copies(rows, sets, known)
    # most lanes belong to one set alone, so all are counted by 46 bits, and those that may be shared go on whole
    tasks = 1 + (known.agg(F.sum("n")).first()[0] or 0) // COUNTED_SHINGLES
    packed = once.mapInArrow(_emit_starts(size, percent), "bucket int, starts array<int>")
    twice = stage(repeated_heads(packed, tasks), "lane-heads")
    lanes = once.mapInArrow(_emit_lanes(size, percent), "lane long, s long")
    head = F.shiftrightunsigned("lane", 64 - BUCKET_BITS - START_BITS)
    shared = stage(lanes.where(may_be_in(twice, ["head"], [head])), "shared-lanes")
    groups = shared.groupBy("lane").agg(F.min("s").alias("hub"), F.max("s").alias("other")).where("hub < other").drop("other")
    members = stage(shared.join(groups, "lane").select("lane", "hub", "s"), "lane-members")

    def about(name: str) -> DataFrame:
        return known.select(F.col("s").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("rep", "n", "sketch")])

    # every set meets one hub: the links are a forest in which parents are smaller
    stars = members.where("s <> hub").select(F.col("hub").alias("a"), F.col("s").alias("b")).distinct()
    stars = stars.join(about("b"), "b").join(about("a"), "a").where(screen("a", "b", percent))
    stars = stage(stars.groupBy("b").agg(F.min(F.struct("a", "rep_a", "rep_b")).alias("p")).select("b", "p.a", "p.rep_a", "p.rep_b"), "star-pairs")
    links = stage(_verified(stars, rows, size, percent).distinct(), "star-links")

    def mixed_members(found: DataFrame) -> DataFrame:
        """lane, main, s and component c of groups that hold several components; main is the least."""
        of = members.join(found.withColumnRenamed("node", "s"), "s", "left")
        of = of.select("lane", "s", F.coalesce("component", "s").alias("c"))
        mixed = of.groupBy("lane").agg(F.min("c").alias("main"), F.max("c").alias("last")).where("main < last").drop("last")
        return stage(of.join(mixed, "lane").distinct(), "mixed-groups")

    # one set of each other component of a group meets one of the main component, and what links is merged
    found = stage(components(links), "components")
    mixed = mixed_members(found)
    order = F.xxhash64("s", F.lit(1))  # not the hubs again
    ones = stage(mixed.groupBy("lane", "main", "c").agg(F.min_by("s", order).alias("s")), "group-components")
    first = ones.where("c = main").select("lane", F.col("s").alias("other"))
    meet = ones.where("c <> main").join(first, "lane").select(F.least("s", "other").alias("a"), F.greatest("s", "other").alias("b")).distinct()
    meet = stage(meet.join(about("b"), "b").join(about("a"), "a").where(screen("a", "b", percent)).select("a", "b", "rep_a", "rep_b"), "meeting-pairs")
    more = stage(_verified(meet, rows, size, percent).distinct(), "meeting-links")
    if not more.isEmpty():
        found = stage(components(as_links(found).union(more)), "components")
        mixed = mixed_members(found)
    few = F.slice(F.sort_array(F.collect_set("lane")), 1, FEW_LANES)
    held = stage(mixed.groupBy("s").agg(few.alias("lanes")).join(known, "s"), "mixed-sets")

    def side(name: str) -> DataFrame:
        own = held.select(F.col("s").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in ("rep", "n", "sketch", "lanes")])
        return mixed.select("lane", "main", F.col("s").alias(name), F.col("c").alias(f"c_{name}")).join(own, name)

    across = (F.col("c_a") != F.col("c_b")) & ((F.col("c_b") == F.col("main")) | (F.col("a") < F.col("b")))
    # two sets may share many lanes: the least one that both hold among their few least makes the pair, if there is one
    common = F.array_intersect("lanes_a", "lanes_b")
    once = (F.size(common) == 0) | (F.col("lane") == F.array_min(common))
    rest = side("a").where("c_a <> main").join(side("b").drop("main"), "lane").where(across & screen("a", "b", percent) & once)
    rest = stage(rest.select("a", "b", "rep_a", "rep_b").distinct(), "rest-pairs")
    last = rest if rest.isEmpty() else stage(_verified(rest, rows, size, percent), "rest-links")
    if not last.isEmpty():
        found = stage(components(as_links(found).union(last)), "components")

    least = known.join(found.withColumnRenamed("node", "s"), "s", "left").select("s", F.coalesce("component", "s").alias("c"), F.col("rep.id").alias("id"))
    least = stage(least, "class-components")
    smallest = least.groupBy("c").agg(F.min("id").alias("component_id"))
    of_set = least.select("s", "c").join(smallest, "c").select("s", "component_id")
    out = sets.select("doc_id", "id", "tag", "n", "s").join(of_set, "s", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select("doc_id", "tag", F.col("n").alias("n_shingles"), component.alias("component_id"))


def linked_documents(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    return linked_components(docs, size, percent).drop("tag")


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs``, all columns, with one row of each component: the smallest (doc_id, hash of the text).

    Rows without words are all kept. Of rows with equal id and text one stays, whichever.
    """
    id_, tag, many = fresh(docs.columns, "row_id", "row_tag", "row_count")
    found = linked_components(docs, size, percent).where("n_shingles > 0")
    found = stage(found.groupBy("component_id", F.coalesce("doc_id", F.expr(LEAST_ID)).alias(id_), F.col("tag").alias(tag)).agg(F.count("*").alias(many)), "linked-rows")
    least = found.groupBy("component_id").agg(F.min(F.struct(id_, tag)).alias("least"))
    ranked = found.join(least, "component_id")
    gone = F.struct(id_, tag) != F.col("least")
    marked = stage(ranked.where(gone | (F.col(many) > 1)).select(id_, tag, gone.alias(many)), "marked-rows")
    keys, at = marked.select(id_, tag), [F.coalesce(docs["doc_id"], F.expr(LEAST_ID)), F.hash(F.coalesce(docs["text"], F.lit("")))]
    maybe, rest = parted(docs, keys, at)
    met = maybe.join(marked, same(marked.select(id_, tag), at), "left").where(F.coalesce(~F.col(many), F.lit(True)))
    singles = met.where(F.col(many).isNull()).select(docs.columns)
    repeats = met.where(F.col(many).isNotNull()).dropDuplicates([id_, tag]).select(docs.columns)
    return rest.union(singles).union(repeats)
