"""Token-id files with a minimal perfect hash index.

A file set is a folder of Parquet rows, readable from any store Spark reads. One row is one shard: a run of documents
in ascending doc_id order, their ids as one raw payload of little-endian unsigned 32-bit integers, and an index. The
index maps each key of the shard to a slot by hash and displace: keys fall into buckets of about four; from the largest
bucket down, each gets the first displacement that sends all its keys to free slots. A slot holds a fingerprint of its
key and the offset and length of its ids, so a lookup costs two hashes, one comparison and one slice. Shards know their
first and last key and, through the small ``bases`` table, how many ids lie before them.

Defined cases: a null text is an empty document (its end id alone); a null doc_id sorts first and has the key
-2^63; rows that share a doc_id stand next to each other (by text hash), and their key finds the first of them and how
many there are; an empty table gives an empty file set. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.tokens import SLICE_BYTES, worker_encoder
from tickloom.llm.words import mix, slices
from tickloom.session import staging_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
SHARD_TOKENS = 1 << 18
BUCKET_KEYS = 4
LEAST_ID = -(1 << 63)
SHARD = (
    "part int, shard int, first_key long, last_key long, n_tokens long, tokens_before long, keys binary, "
    "displacements binary, fingerprints binary, rows binary, begins binary, payload binary"
)


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return mix(mix(keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) ^ np.uint64(seed))


def _displaced(base: np.ndarray, displacement: np.ndarray, n: int) -> np.ndarray:
    return (mix(base + displacement * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(n)).astype(np.int64)


def perfect_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Displacements per bucket, and each key's slot: a bijection of the distinct keys onto range(len(keys))."""
    n = len(keys)
    buckets = max(1, -(-n // BUCKET_KEYS))
    bucket = (_hash(keys, 1) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    begin = np.searchsorted(bucket[order], np.arange(buckets + 1))
    second = _hash(keys, 2)
    taken, displacement, slot = np.zeros(n, dtype=bool), np.zeros(buckets, dtype=np.int64), np.zeros(n, dtype=np.int64)
    sizes = np.diff(begin)
    for b in np.argsort(-sizes, kind="stable")[: np.count_nonzero(sizes > 1)].tolist():
        own = order[begin[b] : begin[b + 1]]
        base, d = second[own], 0
        while True:
            tries = _displaced(base, np.arange(d, d + 64, dtype=np.uint64)[:, None], n)
            free = ~taken[tries].any(axis=1)
            for i in np.flatnonzero(free):
                if len(np.unique(tries[i])) == len(own):
                    break
            else:
                d += 64
                continue
            displacement[b], slot[own] = d + i, tries[i]
            taken[tries[i]] = True
            break
    # what is left are buckets of one key: the free slots themselves, as negative displacements
    single = np.flatnonzero(sizes == 1)
    free = np.flatnonzero(~taken)
    displacement[single], slot[order[begin[single]]] = -1 - free, free
    return displacement, slot


def find_slots(keys: np.ndarray, displacements: np.ndarray, n: int) -> np.ndarray:
    d = displacements[(_hash(keys, 1) % np.uint64(len(displacements))).astype(np.int64)]
    return np.where(d < 0, -1 - d, _displaced(_hash(keys, 2), np.maximum(d, 0).astype(np.uint64), n))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 4) >> np.uint64(32)).astype("<u4")


class _Shard:
    """Documents gathered for one row of the file set."""

    def __init__(self):
        self.keys, self.ids, self.lengths, self.tokens = [], [], [], 0

    def add(self, keys: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        self.keys.append(keys), self.ids.append(ids), self.lengths.append(lengths)
        self.tokens += len(ids)

    def row(self, part: int, shard: int, before: int) -> dict:
        keys, lengths = np.concatenate(self.keys), np.concatenate(self.lengths)
        begins = np.r_[0, np.cumsum(lengths)].astype("<i8")
        distinct, first, many = np.unique(keys, return_index=True, return_counts=True)
        displacements, slot = perfect_hash(distinct)
        marks, rows = np.zeros(len(distinct), dtype="<u4"), np.zeros((len(distinct), 2), dtype="<i4")
        marks[slot] = fingerprint(distinct)
        rows[slot] = np.stack([first, many], axis=1)
        return {
            "part": part, "shard": shard, "first_key": int(keys[0]), "last_key": int(keys[-1]), "n_tokens": self.tokens,
            "tokens_before": before, "keys": keys.astype("<i8").tobytes(), "displacements": displacements.astype("<i8").tobytes(),
            "fingerprints": marks.tobytes(), "rows": rows.tobytes(), "begins": begins.tobytes(),
            "payload": np.concatenate(self.ids).astype("<u4").tobytes(),
        }


def _emit_shards(vocabulary: str, end_id: int, shard_tokens: int, schema: pa.Schema):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part = worker_encoder(vocabulary), TaskContext.get().partitionId()
        shard, number, before = _Shard(), 0, 0
        for batch in batches:
            for rows in slices(batch, limit=SLICE_BYTES):
                ids, begin = encoder.encode(rows.column("text"), end_id)
                keys = rows.column("id").to_numpy(zero_copy_only=False)
                # close a shard at the first document that reaches its size
                a = 0
                while a < len(keys):
                    z = min(int(np.searchsorted(begin, begin[a] + max(1, shard_tokens - shard.tokens))), len(keys))
                    shard.add(keys[a:z], ids[begin[a] : begin[z]], np.diff(begin[a : z + 1]))
                    if shard.tokens >= shard_tokens:
                        yield pa.RecordBatch.from_pylist([shard.row(part, number, before)], schema)
                        number, before, shard = number + 1, before + shard.tokens, _Shard()
                    a = z
        encoder.forget()
        if shard.keys:
            yield pa.RecordBatch.from_pylist([shard.row(part, number, before)], schema)

    return emit


def write(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, partitions: int | None = None) -> None:
    """Write all documents to ``path``/shards and the running totals to ``path``/bases."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce("doc_id", F.expr(f"{LEAST_ID}L")).alias("id"), "text")
    rows = rows.repartitionByRange(partitions, "id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    schema = to_arrow_schema(spark.createDataFrame([], SHARD).schema)
    shards = rows.mapInArrow(_emit_shards(vocabulary, end_id, shard_tokens, schema), SHARD)
    shards.write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(f"{path}/shards")
    totals = spark.read.schema(SHARD).parquet(f"{path}/shards").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per writing task
    totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")).write.parquet(f"{path}/bases")


def shards(spark: SparkSession, path: str) -> DataFrame:
    bases = spark.read.schema("part int, base long").parquet(f"{path}/bases")
    return spark.read.schema(SHARD).parquet(f"{path}/shards").join(F.broadcast(bases), "part")  # a row per writing task


def open_shard(row: dict) -> dict:
    """A shard's arrays, from the raw bytes."""
    kinds = {"keys": "<i8", "displacements": "<i8", "fingerprints": "<u4", "rows": "<i4", "begins": "<i8", "payload": "<u4"}
    out = {k: np.frombuffer(row[k], dtype=t) for k, t in kinds.items()}
    return out | {"rows": out["rows"].reshape(-1, 2)}


def lookup(shard: dict, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each key is stored, its first document in the shard and how many documents have it."""
    slots = find_slots(keys, shard["displacements"], len(shard["fingerprints"]))
    hit = shard["fingerprints"][slots] == fingerprint(keys)
    row = shard["rows"][slots]
    hit &= shard["keys"][np.where(hit, row[:, 0], 0)] == keys  # a fingerprint of another key may agree
    return hit, row[:, 0], row[:, 1]


def _per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            shard = open_shard(row)
            keys, again = shard["keys"], np.arange(len(shard["keys"]))
            hit, first, _ = lookup(shard, keys)
            if not hit.all():
                raise ValueError(f"shard {row['part']}/{row['shard']}: a key is missing from its index")
            place = first + (again - np.searchsorted(keys, keys))  # the n-th document of a repeated key
            begins, payload = shard["begins"], shard["payload"]
            base = row["base"] + row["tokens_before"]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(keys, mask=keys == LEAST_ID), "start": base + begins[place],
                "n_tokens": begins[place + 1] - begins[place],
                "ids_crc32": pa.array([zlib.crc32(payload[begins[p] : begins[p + 1]]) for p in place.tolist()], pa.int64()),
            })


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, found through the index."""
    return shards(spark, path).mapInArrow(_per_document, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _for_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            shard, keys = open_shard(row), np.array(row["wanted"], dtype=np.int64)
            hit, first, many = lookup(shard, keys)
            for key, f, n in zip(keys[hit].tolist(), first[hit].tolist(), many[hit].tolist()):
                begins = shard["begins"][f : f + n + 1]
                ids = [shard["payload"][a:z].tolist() for a, z in zip(begins[:-1], begins[1:])]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([key] * n, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int64()))})


def read_keys(spark: SparkSession, path: str, keys: list[int]) -> DataFrame:
    """doc_id and ids of the given keys; only shards whose key range holds one are opened."""
    wanted = F.array(*[F.lit(k).cast("long") for k in keys]) if keys else F.array().cast("array<long>")
    within = F.filter(wanted, lambda k: (k >= F.col("first_key")) & (k <= F.col("last_key")))
    rows = shards(spark, path).withColumn("wanted", within).where(F.size("wanted") > 0)
    return rows.mapInArrow(_for_keys, "doc_id long, ids array<long>")


def new_path(spark: SparkSession) -> str:
    """A path in the folder of the current run's staged tables."""
    return staging_path(spark, "token-files")
