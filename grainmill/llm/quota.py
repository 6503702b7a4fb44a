"""Samples that follow target shares of a category tree: top-down allocation, and a draw by permuted dense rank.

The tree has three levels: all categories, families, categories. A category's family is the head word of its name without
the part in brackets; categories without a name form a family of their own each. A target that can't be met passes what
is left over first to its siblings (same family), then to its cousins (rest of the tree), in proportion to their room. So
does one that must keep more than it wants: siblings, then cousins, give back what it has too much.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..context import cut, listed, small

#: Rows ranked by one window partition. A category larger than this is ranked in hash ranges whose counts are added up.
RANK_ROWS = 20_000


def category(column: Column) -> Column:
    """Categories are compared trimmed and in lower case; an empty one is none."""
    return F.nullif(F.lower(F.trim(column)), F.lit(""))


def valid_arms(config: DataFrame) -> DataFrame:
    """Arms with 0 < n_low <= n_high, 0 <= r_min <= 1 and m_max >= 1; null or NaN in one of them makes an arm invalid."""
    named = config.where("config_name is not null").select("config_name", "n_high", "n_low", "r_min", "m_max", "sample_fraction")
    ok = "n_low > 0 and n_low <= n_high and r_min between 0 and 1 and m_max >= 1"
    return named.where(ok).where("not (isnan(n_low) or isnan(n_high) or isnan(r_min) or isnan(m_max))")


def family(name: Column, node: Column) -> Column:
    words = F.split(F.trim(F.regexp_replace(F.lower(name), r"\s*\(.*$", "")), r"\s+")
    return F.coalesce(F.nullif(F.element_at(words, -1), F.lit("")), node)


def distinct_members(index: DataFrame) -> DataFrame:
    """(sample_key, node): each key once per category it was ever given, null categories included."""
    return index.where("sample_key is not null").select("sample_key", category(F.col("primary_node")).alias("node")).distinct()


def allocate(targets: DataFrame, config: DataFrame, concepts: DataFrame, members: DataFrame, take_back: bool = False) -> DataFrame:
    """One row per target with a share, of a valid arm.

    n: distinct samples; wanted: share * fraction * all samples; least and most: the bounds; met: whether wanted lies
    within them. quota: whole copies allotted in the end, with what siblings and cousins took over; unplaced: what the
    arm could place nowhere (the same in all its rows). Null shares, unknown arms and null nodes give no row. Of an
    empty index nothing is wanted, so all targets are met. Repeated targets are kept as they are.

    take_back: whether categories that must keep more than they want are balanced by others too, so that an arm's quotas add
    up to what it wants, but for rounding, wherever its bounds allow that; unplaced is then negative where its least copies
    alone are too many. Without it only what is short is passed on, and such an arm draws more than it wants.
    """
    supply = members.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    total = members.agg(F.count_distinct("sample_key").alias("t")).scalar()
    names = concepts.where("node_id is not null").groupBy(category(F.col("node_id")).alias("node")).agg(F.min("node_name").alias("name"))
    rows = (
        targets.where("target_share is not null and not isnan(target_share) and node_id is not null")
        .select("config_name", "node_id", "target_share", category(F.col("node_id")).alias("node"))
        .join(small(valid_arms(config)), "config_name")
        .join(supply, "node", "left")
        .join(names, "node", "left")
        .withColumn("n", F.coalesce("n", F.lit(0)))
        .withColumn("wanted", F.col("target_share") * F.col("sample_fraction") * total)
        .withColumn("most", F.col("m_max") * F.col("n"))
        .withColumn("least", F.expr("case when n < n_low then double(n) when n >= n_high then r_min * n else 0D end"))
        .withColumn("met", F.expr("wanted <= most and wanted >= least"))
        .withColumn("family", family(F.col("name"), F.col("node")))
        .withColumn("given", F.expr("least(greatest(wanted, least), most)"))
        .select("config_name", "node_id", "node", "family", "n", "target_share", "wanted", "least", "most", "met", "given")
    )
    # what a row has too few (or, negative, too many) of
    rows = cut(rows.withColumn("lack", F.expr("wanted - given" if take_back else "greatest(wanted - given, 0)")))
    for level in (["config_name", "family"], ["config_name"]):
        # sums of the level, not windows: they combine on the map side, however many categories an arm has
        up, down = F.col("most") - F.col("given"), F.col("given") - F.col("least")
        sums = rows.groupBy(*level).agg(F.sum("lack").alias("net"), F.sum(up).alias("up"), F.sum(down).alias("down"), F.count(F.lit(1)).alias("rows"))
        share = F.when(F.col("net") > 0, F.when(F.col("up") > 0, F.least(F.col("net"), F.col("up")) * up / F.col("up"))).otherwise(
            F.when(F.col("down") > 0, -F.least(-F.col("net"), F.col("down")) * down / F.col("down"))
        )
        # what the level can't place goes on to the next, in whichever of its rows
        left = F.expr("case when net > 0 then greatest(net - up, 0) else least(net + down, 0) end / rows")
        rows = rows.join(sums, level).withColumns({"given": F.col("given") + F.coalesce(share, F.lit(0.0)), "lack": left}).drop("net", "up", "down", "rows")
    unplaced = rows.groupBy("config_name").agg(F.sum("lack").alias("unplaced"))
    # whole copies: floors, which can't pass a bound from above; then the nearest whole number inside the bounds
    return (
        rows.join(unplaced, "config_name")
        .withColumn("quota", F.expr("bigint(greatest(ceil(least - 1e-9), least(round(given), floor(most + 1e-9))))"))
        .drop("lack")
    )


def permuted_rank(members: DataFrame, seed: int = 0) -> DataFrame:
    """(sample_key, node, n, rank): each sample's dense rank, from 0, in a pseudo-random order within its category.

    A category of any size is ranked in parallel: it is cut into hash ranges of about RANK_ROWS rows, and a row's rank is
    the count of the ranges before its own, plus its place there. Ties of the hash are broken by the key.
    """
    placed = members.where("node is not null").select("sample_key", "node", F.pmod(F.xxhash64("sample_key", F.lit(seed)), F.lit(1 << 32)).alias("h"))
    sizes = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    ranged = placed.join(listed(sizes), "node").withColumn("range", F.expr(f"h div (4294967296 div least(4194304, n div {RANK_ROWS} + 1))"))
    ranged = cut(ranged)
    counts = ranged.groupBy("node", "range").agg(F.count(F.lit(1)).alias("c"))
    before = counts.withColumn("before", F.sum("c").over(W.partitionBy("node").orderBy("range").rowsBetween(W.unboundedPreceding, -1)))
    place = F.row_number().over(W.partitionBy("node", "range").orderBy("h", "sample_key")) - 1
    return (
        ranged.withColumn("place", place)
        .join(before.select("node", "range", F.coalesce("before", F.lit(0)).alias("before")), ["node", "range"])
        .select("sample_key", "node", "n", (F.col("before") + F.col("place")).alias("rank"))
    )


def draw(allocation: DataFrame, members: DataFrame, seed: int = 0) -> DataFrame:
    """(config_name, sample_key, node_id, copies): the sample of each arm.

    A quota of q copies over n samples is q div n copies of each, and one more of the q mod n samples that come first in
    permuted rank: arms with larger quotas hold the samples of smaller ones. Targets of one category in an arm add up.
    """
    quotas = allocation.groupBy("config_name", "node").agg(F.min("node_id").alias("node_id"), F.sum("quota").alias("quota")).where("quota > 0")
    return (
        permuted_rank(members, seed)
        .join(listed(quotas), "node")
        .withColumn("copies", F.expr("int(quota div n + if(rank < quota % n, 1, 0))"))
        .where("copies > 0")
        .select("config_name", "sample_key", "node_id", "copies")
    )
