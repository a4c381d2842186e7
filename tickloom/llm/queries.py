"""The registered queries of this package: each operator over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import chat, conversation_repair, decontamination, fill_in_middle, jaccard_join, licenses, packing, quality, repetition, search, secret_scan, substring_dedup, token_files
from tickloom.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_substring_dedup(spark, sf_dir):
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op2_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op10_token_files(spark, sf_dir):
    path = token_files.new_path(spark)
    token_files.write(table(spark, sf_dir, "documents"), path)
    return token_files.read_documents(spark, path)


@query
def op9_parity_sketch_join(spark, sf_dir):
    return jaccard_join.linked_documents(table(spark, sf_dir, "documents"))


@query
def op4_decontamination(spark, sf_dir):
    scored = decontamination.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return scored.drop("items")


@query
def op7_license_digests(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op6_secret_scan(spark, sf_dir):
    return secret_scan.scan(table(spark, sf_dir, "documents"))


@query
def op8_importance_resampling(spark, sf_dir):
    return quality.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_chat_formatting(spark, sf_dir):
    text = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return chat.summarize(chat.format_log(chat.turns_as_events(turns)))


@query
def op5_block_max_wand(spark, sf_dir):
    return search.search(table(spark, sf_dir, "documents"), F.col("doc_id") % 50 == 0).drop("query_tag", "tag")


@query
def op11_repetition_coverage(spark, sf_dir):
    return repetition.judge(table(spark, sf_dir, "documents"))


@query
def op12_fill_in_middle(spark, sf_dir):
    return fill_in_middle.with_digests(fill_in_middle.transform(table(spark, sf_dir, "documents")))


@query
def op13_conversation_repair(spark, sf_dir):
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.report(conversation_repair.damage(conversations), conversations)
