"""The sample catalogue: index, enrichment, and memberships that are the same on every run."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..context import cut, small
from ..functions.hashing import draw_of, priority
from ..plans.filter_language import where

#: Fixed value: what a number looks like, an infinite one too; anything else is no score.
NUMBER = r"(?i)^\s*[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf(inity)?)\s*$"


def first_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row per key, the first in the given order; null keys go. Rows that tie in it are told apart by all columns.

    An aggregate and no window: the least row is found on the map side, so a key with a third of all rows is no burden.
    """
    columns = rows.columns
    rank = F.struct(*[F.col(c).isNull().alias(f"n{i}") if half == 0 else F.col(c).alias(f"v{i}") for i, c in enumerate(order) for half in (0, 1)], F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("tie"))
    least = rows.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), rank.alias("_rank"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"))
    return least.groupBy("_key").agg(F.min_by("_row", "_rank").alias("_row")).select(*[F.col(f"_row.`{c}`").alias(c) for c in columns])


def index(samples: DataFrame, key: str, shard: str) -> DataFrame:
    """(sample_key, tar_path, priority, draw): each key once, in its first shard."""
    once = samples.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("sample_key")).agg(F.min(shard).alias("tar_path"))
    p = priority(F.col("sample_key"))
    return once.select("sample_key", "tar_path", p.alias("priority"), draw_of(p).alias("draw"))


def score(text: Column) -> Column:
    """Text as a number; text that is none, and null, is null."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double")).when(F.lower(F.trim(text)) == "nan", F.lit(float("nan")))


def enrich(catalog: DataFrame, scores: DataFrame, columns: list[str], *order: str, key: str = "sample_key") -> DataFrame:
    """Left join of score columns, replacing those the catalogue has already. Of repeated keys the last in order wins."""
    latest = scores.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.max_by(F.struct(*[score(F.col(c).cast("string")).alias(c) for c in columns]), F.struct(*[F.col(c) for c in order])).alias("_s")
    )
    kept = catalog.drop(*columns)
    return kept.join(small(latest), key, "left").select(*[kept[c] for c in kept.columns], *[F.col(f"_s.{c}").alias(c) for c in columns])


def flag(catalog: DataFrame, subset: DataFrame, name: str, key: str = "sample_key") -> DataFrame:
    """A boolean column: is the key in the subset?"""
    keys = subset.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn("_in", F.lit(True))
    return catalog.drop(name).join(small(keys), key, "left").withColumn(name, F.coalesce("_in", F.lit(False))).drop("_in")


def select_first(catalog: DataFrame, expression: str | None, k: int) -> DataFrame:
    """Filter, then the first k by priority."""
    return where(catalog, expression).orderBy("priority", "sample_key").limit(k)


def scan_first(catalog: DataFrame, expression: str | None, k: int) -> DataFrame:
    """The first k by priority, then the filter."""
    return where(catalog.orderBy("priority", "sample_key").limit(k), expression)


def materialise(catalog: DataFrame, expression: str | None, k: int, mode: str = "select") -> DataFrame:
    if mode not in ("select", "scan"):
        raise ValueError(f"mode must be select or scan, not {mode!r}")
    return (select_first if mode == "select" else scan_first)(catalog, expression, k)


def shards(members: DataFrame) -> DataFrame:
    return members.where("tar_path is not null").select("tar_path").distinct()


def membership_hash(members: DataFrame, line: Column, *order: str) -> str:
    """First 16 hex digits of SHA-256 over the lines in order, each with a line end: the same for the same membership.

    Rows are sorted by the cluster and stream through the driver; it holds one partition at a time.
    """
    digest = hashlib.sha256()
    once = cut(members.select(line.cast("string").alias("_line"), *order))  # sorting reads its input twice
    for (text,) in once.orderBy(*order).select("_line").toLocalIterator(prefetchPartitions=True):
        digest.update(text.encode() + b"\n")
    return digest.hexdigest()[:16]


def steps(samples: int, global_batch: int) -> int:
    return samples // global_batch
