"""Stateful statistics, over streams and in batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

#: Fixed value: the weight of the prior (mean 0, variance 1) the running moments begin with.
PRIOR = 1e-24


def merged(state: tuple[float, float, float], batch: tuple[float, float, float]) -> tuple[float, float, float]:
    """(count, mean, variance) of two samples taken together."""
    (n, mean, var), (m, other, spread) = state, batch
    total = n + m
    gap = other - mean
    return total, mean + gap * m / total, (var * n + spread * m + gap * gap * n * m / total) / total


def running_moments(rows: DataFrame, step: str, value: str) -> DataFrame:
    """(step, n, mean, var): population moments of all values up to and with each step.

    Steps are reduced to count, sum and sum of squares of the values' distance from their overall mean, so that large means
    cost no digits: the window sees one row per step. Null values don't count; a step of none repeats the one before.
    """
    pivot = F.coalesce(rows.agg(F.avg(value).alias("p")).scalar(), F.lit(0.0))
    x = F.col(value) - pivot
    per = rows.groupBy(step).agg(F.count(value).alias("_c"), F.coalesce(F.sum(x), F.lit(0.0)).alias("_s"), F.coalesce(F.sum(x * x), F.lit(0.0)).alias("_q"))
    w = W.orderBy(step).rowsBetween(W.unboundedPreceding, 0)
    sums = per.select(step, F.sum("_c").over(w).alias("n"), F.sum("_s").over(w).alias("_s"), F.sum("_q").over(w).alias("_q"))
    mean = F.col("_s") / F.nullif("n", F.lit(0))
    return sums.select(step, "n", (mean + pivot).alias("mean"), (F.col("_q") / F.nullif("n", F.lit(0)) - mean * mean).alias("var"))


def stream_running_moments(stream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, count, mean, var) after each micro-batch, per key, the state kept by the engine and restored on restart."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else (PRIOR, 0.0, 1.0)
        for pdf in parts:
            x = pdf[value].dropna()
            if len(x):
                now = merged(now, (float(len(x)), float(x.mean()), float(x.var(ddof=0))))
        state.update(now)
        yield pd.DataFrame({key: [k[0]], "count": [now[0]], "mean": [now[1]], "var": [now[2]]})

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, count double, mean double, var double", "count double, mean double, var double", "update", GroupStateTimeout.NoTimeout)


def tracked_advantages(rows: DataFrame, prompt: str, step: str, value: str, item: str, buffer: int, least: int) -> DataFrame:
    """Adds advantage: value against the last `buffer` values of its prompt, those of its whole step included, or against
    all values of the step while the prompt has fewer than `least`. Population deviation + 1e-6.

    Per prompt and step the step's own values are known as a list; a prompt's history is cut to the buffer as it goes, by a
    window over steps and not over rows.
    """
    batch = rows.groupBy(step).agg(F.avg(value).alias("_bm"), F.stddev_pop(value).alias("_bs"))
    item_value = F.struct(F.col(item).alias("i"), F.col(value).alias("v"))
    # no more than a buffer of a step can matter, however hot the prompt: the rank limit is applied before rows move
    newest = F.row_number().over(W.partitionBy(prompt, step).orderBy(F.desc(item)))
    lists = rows.select(prompt, step, item, value).withColumn("_k", newest).where(F.col("_k") <= buffer).groupBy(prompt, step).agg(F.transform(F.sort_array(F.collect_list(item_value)), lambda s: s["v"]).alias("_l"))
    history = F.flatten(F.collect_list("_l").over(W.partitionBy(prompt).orderBy(step).rowsBetween(1 - buffer, 0)))
    kept = lists.withColumn("_h", history).withColumn("_h", F.when(F.size("_h") > buffer, F.slice("_h", -buffer, buffer)).otherwise(F.col("_h"))).drop("_l")
    n = F.size("_h")
    mean = F.aggregate("_h", F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate("_h", F.lit(0.0), lambda a, x: a + (x - F.col("_pm")) * (x - F.col("_pm"))) / n
    stats = kept.withColumn("_pm", mean).withColumn("_ps", F.sqrt(var)).withColumn("_n", n).drop("_h")
    joined = rows.join(stats, [prompt, step]).join(batch, step)
    own = F.col("_n") >= least
    advantage = (F.col(value) - F.when(own, F.col("_pm")).otherwise(F.col("_bm"))) / (F.when(own, F.col("_ps")).otherwise(F.col("_bs")) + 1e-6)
    return joined.withColumn("advantage", advantage).drop("_bm", "_bs", "_pm", "_ps", "_n")


def stream_prompt_tracker(stream: DataFrame, prompt: str, value: str, buffer: int) -> DataFrame:
    """(prompt, n, mean, std) of each prompt's last `buffer` values after each micro-batch."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        for pdf in parts:
            held = (held + pdf[value].dropna().tolist())[-buffer:]
        state.update((held,))
        x = pd.Series(held, dtype=float)
        yield pd.DataFrame({prompt: [k[0]], "n": [len(x)], "mean": [x.mean()], "std": [x.std(ddof=0)]})

    kind = dict(stream.dtypes)[prompt]
    return stream.groupBy(prompt).applyInPandasWithState(run, f"{prompt} {kind}, n long, mean double, std double", "held array<double>", "update", GroupStateTimeout.NoTimeout)


def last_rows(rows: DataFrame, n: int, *order: str) -> DataFrame:
    """The bounded log buffer: the last n rows in order."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)
