"""Stratified selection with running de-duplication, concepts in ascending (N_c, node_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..context import cut
from ..functions.hashing import priority
from ..functions.schedule import keep_rate, stratum_quota

#: Priorities are counted in so many equal ranges per group before any are ranked.
RANGES = 1024


def first_by_priority(rows: DataFrame, group: str, need: str) -> DataFrame:
    """Of each group the first `need` rows by (priority, sample_key), however large the group.

    Counts per priority range come first; whole ranges below the boundary are taken, and only the range it falls in is
    ranked. Rows need columns group, need, priority, sample_key.
    """
    ranged = rows.where(F.col(need) > 0).withColumn("_r", F.expr(f"priority div {2**63 // RANGES}"))
    counts = ranged.groupBy(group, "_r").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(W.partitionBy(group).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = ranged.join(before.withColumnRenamed("_r", "_r2").withColumnRenamed(group, "_g2"), (F.col(group) == F.col("_g2")) & (F.col("_r") == F.col("_r2")))
    whole = placed.where(F.col("_before") + F.col("_c") <= F.col(need))
    edge = placed.where((F.col("_before") < F.col(need)) & (F.col("_before") + F.col("_c") > F.col(need)))
    ranked = edge.withColumn("_n", F.row_number().over(W.partitionBy(group, "_r").orderBy("priority", "sample_key")))
    return whole.select(*rows.columns).unionByName(ranked.where(F.col("_before") + F.col("_n") <= F.col(need)).select(*rows.columns))


def quotas(counts: DataFrame, n_head: float, a_head: float, r_min: float, base: str = "log10") -> DataFrame:
    """(node_id, N_c, rate, quota, place): place is the concept's turn."""
    rated = counts.withColumn("rate", keep_rate(F.col("N_c"), n_head, a_head, r_min, base)).withColumn("quota", stratum_quota(F.col("N_c"), F.col("rate")))
    return rated.withColumn("place", F.struct("N_c", "node_id"))


def select(links: DataFrame, limits: DataFrame) -> DataFrame:
    """(sample_key, node_id): the selected samples, each with the concept that selected it.

    A concept counts what earlier concepts selected toward its quota and fills the rest by (priority, sample_key). Each
    round all concepts choose at once, given what the round before says earlier ones chose. A concept's choice hangs on
    earlier concepts only, so the rounds settle, on the very result of going through the concepts one by one. Concepts
    whose quota is all they have need no order and are right from the start. Links must be distinct.
    """
    rows = links.join(limits.select("node_id", "quota", "N_c", "place"), "node_id").withColumn("priority", priority(F.col("sample_key")))
    rows = cut(rows.select("sample_key", "node_id", "priority", "quota", "N_c", "place"))
    chosen = cut(rows.where("quota >= N_c").groupBy("sample_key").agg(F.min("place").alias("by")))
    seen = None
    while True:  # at most as many rounds as concepts
        known = rows.join(chosen, "sample_key", "left")
        done = F.coalesce(F.col("by") < F.col("place"), F.lit(False))
        have = known.groupBy("node_id").agg(F.count_if(done).alias("have"))
        open_rows = known.where(~done).join(have, "node_id").withColumn("need", F.col("quota") - F.col("have"))
        picks = first_by_priority(open_rows.select("sample_key", "node_id", "priority", "place", "need"), "node_id", "need")
        chosen = cut(picks.groupBy("sample_key").agg(F.min("place").alias("by")))
        state = chosen.agg(F.count(F.lit(1)), F.sum(F.xxhash64("sample_key", "by").cast("decimal(38,0)"))).first()
        if state == seen:
            return chosen.select("sample_key", F.col("by.node_id").alias("node_id"))
        seen = state
