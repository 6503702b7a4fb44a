"""Judgements as columns. -1 stands for a judge that failed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def flipped(key: Column, seed: int = 0) -> Column:
    """Whether a pair is shown in reverse, by a hash bit of its key."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(2)) == 1


def unflipped(rank: Column, was_flipped: Column) -> Column:
    """A winner in the order of the input; a failure stays a failure."""
    return F.when(rank < 0, rank).when(was_flipped, 1 - rank).otherwise(rank)


def soft_winner(probability: Column) -> Column:
    return F.when(probability > 0.5, 0).otherwise(1)


def all_true(verdicts: Column) -> Column:
    """1 if all binary verdicts are 1, -1 if any failed, else 0; another value is an error."""
    bad = F.exists(verdicts, lambda v: ~v.isin(-1, 0, 1))
    return (
        F.when(bad, F.raise_error(F.lit("verdicts must be 0, 1 or -1")).cast("int"))
        .when(F.array_contains(verdicts, -1), -1)
        .when(F.forall(verdicts, lambda v: v == 1), 1)
        .otherwise(0)
    )


def win_rate(rows: DataFrame, winner: str, probability: str | None = None) -> DataFrame:
    """One row: share of winner 1 (failures count among all), and 1 - mean probability of the reference."""
    columns = [F.count(F.lit(1)).alias("n"), F.avg((F.col(winner) == 1).cast("double")).alias("win_rate")]
    return rows.agg(*columns, *([(1 - F.avg(probability)).alias("win_probability")] if probability else []))


def pick_pair(rows: DataFrame, prompt: str, place: str, score: str, item: str) -> DataFrame:
    """(prompt, chosen, rejected) of two candidates per prompt, places 0 and 1: the first is chosen if it scores at least as
    high. A prompt with one candidate gives no row."""
    at = lambda i, c: F.max(F.when(F.col(place) == i, F.col(c)))
    both = rows.groupBy(prompt).agg(at(0, score).alias("s0"), at(1, score).alias("s1"), at(0, item).alias("i0"), at(1, item).alias("i1"))
    first = F.col("s0") >= F.col("s1")
    return both.where("s0 is not null and s1 is not null").select(prompt, F.when(first, F.col("i0")).otherwise(F.col("i1")).alias("chosen"), F.when(first, F.col("i1")).otherwise(F.col("i0")).alias("rejected"))


def pairwise(rows: DataFrame, key: str, first: str, second: str, judge: Callable[[Column, Column], Column], name: str = "winner", shuffled: bool = True) -> DataFrame:
    """Adds the winner (0 or 1, -1 if the judge failed) of two answers. `judge` gets the two as shown, which is in reverse
    for half of the keys if `shuffled`, against a bias for a place; a null verdict is a failure."""
    reverse = flipped(F.col(key)) if shuffled else F.lit(False)
    shown = [F.when(reverse, F.col(b)).otherwise(F.col(a)) for a, b in ((first, second), (second, first))]
    return rows.withColumn(name, unflipped(F.coalesce(judge(*shown).cast("int"), F.lit(-1)), reverse))


def rank(rows: DataFrame, answers: str, score: Callable[[Column], Column], name: str = "ranks") -> DataFrame:
    """Adds the places (from 0, best first) of an array of answers by a score; ties go by position, null scores come last."""
    scored = F.transform(answers, lambda a, i: F.struct(F.coalesce(-score(a), F.lit(float("inf"))).alias("s"), i.alias("i")))
    order = F.transform(F.array_sort(scored), lambda x: x["i"])
    return rows.withColumn("_order", order).withColumn(name, F.transform(answers, lambda a, i: (F.array_position("_order", i) - 1).cast("int"))).drop("_order")
