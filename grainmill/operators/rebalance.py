"""From links to copies: concept frequencies, multiplicities, and whole copies per sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..context import cut, listed, small
from ..functions.hashing import draw
from ..functions.schedule import Schedule, concept_multiplicity, realise
from .linking import base_name
from .sampling import quantile


def concept_counts(links: DataFrame) -> DataFrame:
    """(node_id, N_c): samples of each concept. Links must be distinct (linking.distinct_links)."""
    return links.groupBy("node_id").agg(F.count(F.lit(1)).alias("N_c"))


def node_multiplicity(counts: DataFrame, s: Schedule) -> DataFrame:
    return counts.withColumn("m_c", concept_multiplicity(F.col("N_c"), s))


def _with_unlinked(reduced: DataFrame, universe: DataFrame | None, value: Column, name: str) -> DataFrame:
    """Adds the samples of the universe that have no link."""
    if universe is None:
        return reduced
    bare = universe.select("sample_key").where("sample_key is not null").distinct().join(reduced.select("sample_key"), "sample_key", "left_anti")
    return reduced.unionByName(bare.withColumn(name, value))


def rarest_wins(links: DataFrame, nodes: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """(sample_key, m): the largest multiplicity of a sample's concepts, 1 without any; concepts not in `nodes` count 0."""
    m = links.join(listed(nodes.select("node_id", "m_c")), "node_id", "left").groupBy("sample_key").agg(F.max(F.coalesce("m_c", F.lit(0.0))).alias("m"))
    return _with_unlinked(m, universe, F.lit(1.0), "m")


def geometric_mean(links: DataFrame, nodes: DataFrame, universe: DataFrame | None = None, m_max: float = 4.0, m_floor: float = 0.0) -> DataFrame:
    """(sample_key, m): geometric mean weighted by |ln m|, so that concepts at 1 have no say; any m <= 0 makes it 0.

    Between m_floor and m_max; 1 where all are at 1.
    """
    joined = links.join(listed(nodes.select("node_id", "m_c")), "node_id", "left").withColumn("m_c", F.coalesce("m_c", F.lit(0.0)))
    log = F.log(F.when(F.col("m_c") > 0, F.col("m_c")))
    sums = joined.groupBy("sample_key").agg(F.sum(F.abs(log) * log).alias("top"), F.sum(F.abs(log)).alias("weight"), F.min("m_c").alias("least"))
    mean = F.when(F.col("least") <= 0, 0.0).when(F.coalesce("weight", F.lit(0.0)) == 0, 1.0).otherwise(F.exp(F.col("top") / F.col("weight")))
    m = sums.select("sample_key", F.greatest(F.least(mean, F.lit(float(m_max))), F.lit(float(m_floor))).alias("m"))
    return _with_unlinked(m, universe, F.lit(1.0), "m")


def mean_inverse(links: DataFrame, counts: DataFrame, universe: DataFrame | None = None, alpha: float = 0.5, excluded: DataFrame | None = None) -> DataFrame:
    """(sample_key, w): mean of N^-alpha over a sample's concepts. Excluded concepts add 0 and still count in the mean; a
    concept without a count has N 1. Samples without concepts get the median of the positive weights."""
    nodes = counts.select("node_id", F.pow(F.greatest(F.col("N_c"), F.lit(1)), F.lit(-float(alpha))).alias("v"))
    if excluded is not None:
        gone = excluded.select("node_id").distinct().withColumn("gone", F.lit(True))
        nodes = nodes.join(gone, "node_id", "left").select("node_id", F.when(F.col("gone"), 0.0).otherwise(F.col("v")).alias("v"))
    w = links.join(listed(nodes), "node_id", "left").groupBy("sample_key").agg(F.avg(F.coalesce("v", F.lit(1.0))).alias("w"))
    if universe is None:
        return w
    w = cut(w)
    median = quantile(w.where("w > 0"), "w", 0.5)
    return _with_unlinked(w, universe, F.lit(1.0 if median is None else median), "w")


def to_budget(weights: DataFrame, budget: float | None = None, cap: float | None = 16.0) -> DataFrame:
    """(sample_key, m): m = min(cap, lambda * w) with the sum at the budget (by default the number of samples).

    With the k heaviest at the cap, lambda = (budget - k cap) / (rest of the weight), for the least k whose next weight stays
    below the cap. k is reached from below by a few aggregates of two numbers each; nothing is sorted.
    If the cap leaves no room for the budget all are at the cap. Negative and null weights count as 0.
    """
    rows = cut(weights.select("sample_key", F.greatest(F.coalesce("w", F.lit(0.0)), F.lit(0.0)).alias("w")))
    n, total = rows.agg(F.count(F.lit(1)), F.sum("w")).first()
    target = float(n if budget is None else budget)
    if not n or not total:
        return rows.select("sample_key", F.lit(0.0).alias("m"))
    if not cap or cap <= 0:
        return rows.select("sample_key", (F.col("w") * F.lit(target / total)).alias("m"))
    # each step caps what is above and spreads the rest: k only grows, and each pass is one aggregate of two numbers
    k, capped, lam = 0, 0.0, target / total
    while True:
        over = rows.where(F.col("w") * F.lit(lam) > cap).agg(F.count(F.lit(1)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
        if over[0] <= k:
            break
        k, capped = over
        rest, room = total - capped, target - k * cap
        if rest <= 1e-12 * total or room <= 0:
            lam = float("inf") if room > 0 else 0.0
            break
        lam = room / rest
    if lam == float("inf"):
        return rows.select("sample_key", F.when(F.col("w") > 0, F.lit(float(cap))).otherwise(0.0).alias("m"))
    return rows.select("sample_key", F.least(F.lit(float(cap)), F.col("w") * F.lit(lam)).alias("m"))


def membership(multiplicities: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(sample_key, count[, tar_path]) of the samples with a copy or more; keys the index lacks go."""
    kept = multiplicities.select("sample_key", realise(F.col("m"), draw(F.col("sample_key"))).alias("count")).where("count > 0")
    return kept if index is None else kept.join(index.select("sample_key", "tar_path"), "sample_key")


def expand(members: DataFrame, seed: int = 42) -> DataFrame:
    """(sample_key, copy, place): each sample `count` times, in a pseudo-random order that disperses copies."""
    copies = members.where("count > 0").select("sample_key", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("copy"))
    return copies.withColumn("place", F.xxhash64("sample_key", "copy", F.lit(seed)))


def split_forms(counts: DataFrame, n_low: int = 1000) -> DataFrame:
    """(node_id, N_c, node_name, base): rare nodes whose base name another node has often: one thing under two names."""
    based = counts.where("node_name is not null").withColumn("base", base_name(F.col("node_name")))
    groups = based.groupBy("base").agg(F.count(F.lit(1)).alias("forms"), F.max("N_c").alias("most")).where((F.col("forms") > 1) & (F.col("most") >= n_low))
    return based.where((F.col("N_c") > 0) & (F.col("N_c") < n_low)).join(small(groups), "base").select("node_id", "N_c", "node_name", "base")


#: Nodes that were reviewed and found to be linked wrongly.
CONFIRMED_MISLINKS = ["n02076196", "n09213434", "n10435988"]


def excluded_nodes(counts: DataFrame, n_low: int = 1000, drop_split_forms: bool = True) -> DataFrame:
    """(node_id, reason): nodes reviewed and found to be linked wrongly, and rare forms of a frequent name."""
    mislinks = counts.where(F.col("node_id").isin(CONFIRMED_MISLINKS)).select("node_id", F.lit("mislink").alias("reason"))
    return mislinks.unionByName(split_forms(counts, n_low).select("node_id", F.lit("split form").alias("reason"))) if drop_split_forms else mislinks


def guard_audit(counts: DataFrame, n_low: int = 1000, suspects: tuple[str, ...] = ()) -> DataFrame:
    """One row: nodes, tail nodes, split forms, their links and share, and tail nodes with a suspect name."""
    split = split_forms(counts, n_low).agg(F.count(F.lit(1)).alias("split_nodes"), F.coalesce(F.sum("N_c"), F.lit(0)).alias("split_links"))
    tail = (F.col("N_c") > 0) & (F.col("N_c") < n_low)
    named = F.lower(F.coalesce("node_name", F.lit(""))).isin(list(suspects)) if suspects else F.lit(False)
    alls = counts.agg(
        F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("N_c"), F.lit(0)).alias("links"), F.count_if(tail).alias("tail_nodes"), F.count_if(tail & named).alias("suspect_nodes")
    )
    n, links = split.select("split_nodes").scalar(), split.select("split_links").scalar()
    return alls.withColumns({"split_nodes": n, "split_links": links}).withColumn("split_share", F.col("split_links") / F.nullif("links", F.lit(0)))
