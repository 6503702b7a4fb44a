"""The queries of this subpackage: each takes (spark, folder of tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from importlib.util import find_spec
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import cut, spread, table
from . import containers, leakage, neardup, quota, spam, terms, truncation
from .messages import distinct_messages
from .sql import SQL


def _contents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return distinct_messages(table(spark, folder, "messages"), *columns)


def _terms(spark: SparkSession, folder: str) -> DataFrame:
    contents = _contents(spark, folder, "content")
    return terms.mark_terms(terms.term_frequency(contents, "message_id", "content"), table(spark, folder, "messages").where("message_id is not null").select("message_id").distinct())


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder).where("mark is not null").select("term", "mark")


def p1_term_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return _terms(spark, folder).select("term", "occurrences", F.col("records").alias("messages"), F.col("last_record").alias("last_message_id"), "mark")


_PACKAGE = find_spec("public_tokenizers")
#: Rank file of the public tokenizer, from the installed package; every executor reads it at this path.
VOCABULARY = str(Path(_PACKAGE.origin).parent / "byte_bpe_50k.tiktoken") if _PACKAGE and _PACKAGE.origin else "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Turns of at least 30 words; sets of word triples; half of the union in common.
TURNS = neardup.NearDuplicates(shingle=3, threshold=0.5, least_words=30, bands=128, rows=5)


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    return _contents(spark, folder, "content", "role").where("role in ('user', 'assistant')").select("message_id", "content")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = neardup.near_duplicate_pairs(_turns(spark, folder), "message_id", "content", TURNS)
    return pairs.select(F.col("a").alias("message_id_a"), F.col("b").alias("message_id_b"))


def p2_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicate_groups(_turns(spark, folder), "message_id", "content", TURNS).withColumnRenamed("id", "message_id")


def p2_class_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicate_classes(_turns(spark, folder), "message_id", "content", TURNS).withColumnRenamed("a", "class_a").withColumnRenamed("b", "class_b")


def _allocation(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    index, config, mix, concepts = (table(spark, folder, t) for t in ("sample_index", "schedule_config", "target_mix", "concepts"))
    members = cut(quota.distinct_members(index))
    return quota.allocate(mix, config, concepts, members, take_back=True), members


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return _allocation(spark, folder)[0].where("not met").select("config_name", "node_id")


def p3_allocation(spark: SparkSession, folder: str) -> DataFrame:
    return _allocation(spark, folder)[0].drop("node")


def p3_sample(spark: SparkSession, folder: str) -> DataFrame:
    allocation, members = _allocation(spark, folder)
    return quota.draw(cut(allocation), members)


def _truncated(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncated(_contents(spark, folder, "content", "source"), "message_id", "source", "content")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return _truncated(spark, folder).where("truncated").select(F.col("id").alias("message_id"))


def p4_rates(spark: SparkSession, folder: str) -> DataFrame:
    return truncation.truncation_rates(_truncated(spark, folder))


def _documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text", *columns).where("doc_id is not null"))


def _sizes(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    documents = _documents(spark, folder, "source")
    specs = table(spark, folder, "pack_specs").select(F.col("source").alias("grp"), F.col("max_tokens").alias("capacity"))
    return containers.token_counts(documents, "doc_id", "text", VOCABULARY, "source"), specs


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_containers(spark, folder).where("part = 1").select("doc_id")


def p5_containers(spark: SparkSession, folder: str) -> DataFrame:
    packed = containers.pack(*_sizes(spark, folder))
    return packed.select(F.col("id").alias("doc_id"), "part", F.col("grp").alias("source"), "container", "size", F.col("capacity").alias("max_tokens"))


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(_documents(spark, folder), "doc_id", "text", table(spark, folder, "eval_items"), "item_id", "item_text")


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).where("exact_windows > 0").select("doc_id", "item_id")


def p6_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_scores(spark, folder).where("spam").select("doc_id")


def p7_scores(spark: SparkSession, folder: str) -> DataFrame:
    return spam.spam_scores(_documents(spark, folder), "doc_id", "text").withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k[0] == "p" and k[1].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
