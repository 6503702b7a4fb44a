"""Rewards, advantages and their statistics. A reward that does not apply is null."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import clipped
from . import sampling
from .sampling import quantiles


def total_reward(weights: Mapping[str, float]) -> Column:
    """Weighted sum of reward columns; null and NaN count 0."""
    terms = [F.lit(float(w)) * F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for c, w in weights.items()]
    return sum(terms[1:], terms[0])


def _with_stats(rows: DataFrame, group: str, **stats: Column) -> DataFrame:
    """Group statistics beside each row: an aggregate that combines on the map side, joined back. A window would sort each
    group in one task; the join is split by adaptive execution where a group is hot."""
    return rows.join(rows.groupBy(group).agg(*[c.alias(k) for k, c in stats.items()]), group)


def group_relative(rows: DataFrame, group: str, reward: str, scale: bool = True) -> DataFrame:
    """Adds advantage: reward minus its group's mean, over its sample deviation + 1e-4 if scaled (a group of one has 0).
    Null groups form no group and give no row."""
    stats = _with_stats(rows, group, _mean=F.avg(reward), _std=F.stddev_samp(reward))
    a = F.col(reward) - F.col("_mean")
    return stats.withColumn("advantage", a / (F.coalesce("_std", F.lit(0.0)) + 1e-4) if scale else a).drop("_mean", "_std")


def flat_groups(rows: DataFrame, group: str, reward: str) -> DataFrame:
    """One row (frac_zero_std): share of groups of two or more whose rewards are all the same."""
    std = rows.groupBy(group).agg(F.stddev_samp(reward).alias("s")).where("s is not null")
    return std.agg(F.avg((F.abs("s") <= 1e-8).cast("double")).alias("frac_zero_std"))


def leave_one_out(rows: DataFrame, group: str, reward: str, normalise: bool = False) -> DataFrame:
    """Adds advantage: reward minus the mean of the others in its group; null in a group of one."""
    stats = _with_stats(rows, group, _sum=F.sum(reward), _n=F.count(reward))
    out = stats.withColumn("advantage", F.col(reward) - (F.col("_sum") - F.col(reward)) / F.nullif(F.col("_n") - 1, F.lit(0))).drop("_sum", "_n")
    if not normalise:
        return out
    mean, std = out.agg(F.avg("advantage"), F.stddev_samp("advantage")).first()
    return out.withColumn("advantage", (F.col("advantage") - F.lit(mean)) / (F.lit(std) + 1e-8))


def normalised_rewards(rows: DataFrame, reward: str, clip: float | None = None) -> DataFrame:
    mean, std = rows.agg(F.avg(reward), F.stddev_samp(reward)).first()
    z = (F.col(reward) - F.lit(mean)) / (F.lit(std) + 1e-8)
    return rows.withColumn("normalised", z if clip is None else clipped(z, -clip, clip))


def reward_statistics(rows: DataFrame, *columns: str) -> DataFrame:
    """(reward, n, mean, std, least, most, median) of each column over the rows where it applies."""
    names = F.explode(F.array(*[F.struct(F.lit(c).alias("reward"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("x")) for c in columns]))
    long = rows.select(names.alias("r")).select("r.reward", "r.x")
    medians = quantiles(long, "x", 0.5, "reward").withColumnRenamed("quantile", "median")  # a row per column
    return long.groupBy("reward").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("least"), F.max("x").alias("most")).join(F.broadcast(medians), "reward")


def length_statistics(rows: DataFrame, length: str, terminated: str) -> DataFrame:
    """One row: lengths of all and of terminated completions (0 if none), and the share that was clipped."""
    n, done = F.col(length), F.col(terminated)
    ended = F.when(done, n)
    return rows.agg(
        F.avg(n).alias("mean_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"),
        (1 - F.count_if(done) / F.count(F.lit(1))).alias("clipped_ratio"),
        F.coalesce(F.avg(ended), F.lit(0.0)).alias("mean_terminated"), F.coalesce(F.min(ended), F.lit(0)).alias("min_terminated"), F.coalesce(F.max(ended), F.lit(0)).alias("max_terminated"),
    )


def masked_statistics(rows: DataFrame, value: str, mask: str) -> tuple[float | None, float | None]:
    """Mean and unbiased variance where the mask is 1."""
    x = F.when(F.col(mask) == 1, F.col(value))
    return tuple(rows.agg(F.avg(x), F.var_samp(x)).first())


def whitened(rows: DataFrame, value: str, mask: str, shift_mean: bool = True) -> DataFrame:
    mean, var = masked_statistics(rows, value, mask)
    white = (F.col(value) - F.lit(mean)) / F.sqrt(F.lit(var) + 1e-8)
    return rows.withColumn("white", white if shift_mean else white + F.lit(mean))


def label_balance(rows: DataFrame, label: str, desirable: float = 1.0, undesirable: float = 1.0) -> DataFrame:
    """One row: counts (at least 1) and the bounds between which the weights balance the labels; halves round to even."""
    n = F.greatest(F.count_if(F.col(label)), F.lit(1))
    rest = F.greatest(F.count(F.lit(1)) - n, F.lit(1))
    sums = rows.agg(n.alias("desirable"), rest.alias("undesirable"))
    d, u = F.col("undesirable") * undesirable / F.col("desirable"), F.col("desirable") * desirable / F.col("undesirable")
    return sums.select(
        "desirable", "undesirable", F.bround(d, 2).alias("desirable_low"), F.bround(d * 1.33, 2).alias("desirable_high"), F.bround(u / 1.33, 2).alias("undesirable_low"), F.bround(u, 2).alias("undesirable_high")
    )


def pairwise_accuracy(rows: DataFrame, chosen: str, rejected: str) -> DataFrame:
    """One row (accuracy, ties): share of pairs that aren't ties in which the chosen side scores higher."""
    c, r = F.col(chosen), F.col(rejected)
    return rows.agg(F.avg(F.when(c != r, (c > r).cast("double"))).alias("accuracy"), F.count_if(c == r).alias("ties"))


def rolling_mean(rows: DataFrame, order: str, value: str, window: int = 100, block: int = 50_000) -> DataFrame:
    """Adds rolling: mean of the last `window` values in order, null until there are so many.

    Rows get their global place first; then each block of places is one window, with the rows just before it as a margin, so
    that a series of any length is averaged in parallel. The order must be total.
    """
    from .sampling import ranked

    placed = ranked(rows, order, name="_place")
    own = F.floor(F.col("_place") / block)
    last = (own + 1) * block - F.col("_place") < window  # also needed by the next block
    spread = placed.withColumn("_block", F.explode(F.when(last, F.array(own, own + 1)).otherwise(F.array(own)))).withColumn("_own", F.col("_block") == own)
    w = W.partitionBy("_block").orderBy("_place").rowsBetween(1 - window, 0)
    mean = F.when(F.count(F.lit(1)).over(w) == window, F.avg(value).over(w))
    return spread.withColumn("rolling", mean).where("_own").drop("_place", "_block", "_own")


def nucleus(rows: DataFrame, group: str, token: str, logit: str, top_k: int = 0, top_p: float = 1.0) -> DataFrame:
    """The rows top-k and nucleus filtering keep: logits at or above the k-th (ties stay), then tokens while what comes
    before them holds no more than top_p. Groups are vocabularies, of bounded size."""
    w = W.partitionBy(group)
    if top_k:
        rows = rows.withColumn("_rank", F.rank().over(w.orderBy(F.desc(logit)))).where(F.col("_rank") <= top_k).drop("_rank")
    e = F.exp(F.col(logit) - F.max(logit).over(w))
    before = F.coalesce(F.sum("_p").over(w.orderBy(F.desc(logit), token).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return rows.withColumn("_e", e).withColumn("_p", F.col("_e") / F.sum("_e").over(w)).withColumn("_b", before).where(F.col("_b") <= top_p).withColumnRenamed("_p", "probability").drop("_e", "_b")


def high_entropy(rows: DataFrame, entropy: str, mask: str, quantile: float) -> DataFrame:
    """Adds high: valid tokens at or above the quantile (linear between neighbours) of all valid tokens."""
    least = F.lit(sampling.quantile(rows.where(F.col(mask) == 1), entropy, quantile))
    return rows.withColumn("high", (F.col(mask) == 1) & F.coalesce(F.col(entropy) >= least, F.lit(False)))


def best_of(rows: DataFrame, group: str, score: str, item: str, n: int = 1) -> DataFrame:
    """The n highest scores of each group, ties by item; null scores lose. For n = 1 it is an aggregate."""
    if n == 1:
        return _best_one(rows, group, score, item)
    w = W.partitionBy(group).orderBy(F.desc_nulls_last(score), item)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def _best_one(rows: DataFrame, group: str, score: str, item: str) -> DataFrame:
    order = F.struct(F.col(score).isNull().alias("a"), (-F.col(score)).alias("b"), F.col(item).alias("c"))
    return rows.groupBy(group).agg(F.min_by(F.struct(*[F.col(c) for c in rows.columns if c != group]), order).alias("_b")).select(group, "_b.*")


def sorted_gap(rows: DataFrame, one: str, two: str) -> DataFrame:
    """(place, gap): both columns sorted on their own and subtracted place by place."""
    from .sampling import ranked

    a = ranked(rows.select(F.col(one).alias("a")).where("a is not null"), "a")
    b = ranked(rows.select(F.col(two).alias("b")).where("b is not null"), "b")
    return a.join(b, "place").select("place", (F.col("a") - F.col("b")).alias("gap"))


def characters_per_token(rows: DataFrame, text: str, tokens: str, order: str, first: int = 400) -> DataFrame:
    """One row (ratio) over the first rows in order."""
    head = rows.orderBy(order).limit(first)
    return head.agg((F.sum(F.length(text)) / F.nullif(F.sum(tokens), F.lit(0))).alias("ratio"))


def model_summary(rows: DataFrame, model: str, value: str) -> DataFrame:
    """(model, any, mean, std, median) per model: whether it has a value at all, and its values' mean, population deviation
    and median."""
    stats = rows.groupBy(model).agg(F.avg(value).isNotNull().alias("any"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    middle = quantiles(rows, value, 0.5, model).select(F.col(model).alias("_m"), F.col("quantile").alias("median"))
    return stats.join(middle, F.col(model).eqNullSafe(F.col("_m")), "left").drop("_m")


def maximum(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, most): the largest value of each key; null and NaN don't count."""
    return rows.groupBy(key).agg(F.max(F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))).alias("most"))


def average(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean): null and NaN don't count; a key of nothing else has a null mean."""
    known = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    return rows.groupBy(key).agg(F.count(known).alias("n"), F.avg(known).alias("mean"))


def token_accuracy(rows: DataFrame, predictions: str, labels: str, ignore: int = -100) -> DataFrame:
    """One row (accuracy, tokens): the share of tokens predicted, those whose label is ignored left out. Arrays of a row are
    compared place by place up to the shorter one."""
    counted = F.filter(F.zip_with(F.col(predictions), F.col(labels), lambda p, x: F.when(x != ignore, (p == x).cast("int"))), lambda v: v.isNotNull())
    each = rows.select(F.size(counted).alias("n"), F.aggregate(counted, F.lit(0), lambda a, v: a + v).alias("hit"))
    n = F.sum(F.greatest("n", F.lit(0)))
    return each.agg((F.sum("hit") / F.nullif(n, F.lit(0))).alias("accuracy"), F.coalesce(n, F.lit(0)).alias("tokens"))


def first_per_prompt(rows: DataFrame, prompt: str, *order: str) -> DataFrame:
    from .catalog import first_wins

    return first_wins(rows, prompt, *order)
