"""How even a distribution is, and what a membership did to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..context import small
from ..functions.schedule import Schedule, band
from .linking import base_name


def _levels(values: DataFrame, column: str) -> DataFrame:
    """Distinct positive values with counts. Frequencies that add up to T have at most sqrt(2 T) distinct values, so a
    window over the levels is small however many values there are."""
    return values.where(F.col(column) > 0).groupBy(F.col(column).alias("x")).agg(F.count(F.lit(1)).alias("c"))


def gini(values: DataFrame, column: str) -> DataFrame:
    """One row (gini): 2 sum(i x_i) / (n sum x) - (n + 1) / n over positive values in order; 0 if there are none."""
    up = W.orderBy("x").rowsBetween(W.unboundedPreceding, -1)
    levels = _levels(values, column).withColumn("before", F.coalesce(F.sum("c").over(up), F.lit(0)))
    x = F.col("x").cast("double")
    sums = levels.agg(F.sum(x * (F.col("c") * F.col("before") + F.col("c") * (F.col("c") + 1) / 2)).alias("ranked"), F.sum(x * F.col("c")).alias("total"), F.sum("c").alias("n"))
    return sums.select(F.coalesce(2 * F.col("ranked") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n"), F.lit(0.0)).alias("gini"))


def top_share(values: DataFrame, column: str, fraction: float = 0.02) -> DataFrame:
    """One row (top_share): what the largest max(1, fraction * n rounded half to even) values hold of the sum."""
    down = W.orderBy(F.desc("x")).rowsBetween(W.unboundedPreceding, -1)
    levels = _levels(values, column)
    n = levels.agg(F.sum("c").alias("n")).scalar()
    k = F.greatest(F.lit(1.0), F.rint(F.lit(fraction) * n))
    taken = levels.withColumn("before", F.coalesce(F.sum("c").over(down), F.lit(0))).withColumn("t", F.greatest(F.lit(0.0), F.least(F.col("c").cast("double"), k - F.col("before"))))
    return taken.agg(F.coalesce(F.sum(F.col("x") * F.col("t")) / F.sum(F.col("x") * F.col("c")), F.lit(0.0)).alias("top_share"))


def realised(links: DataFrame, members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, N_c, m_c, mass, rate, ratio): links a concept has with copies counted, their rate, and rate over intent."""
    mass = links.join(members.select("sample_key", "count"), "sample_key", "left").groupBy("node_id").agg(F.sum(F.coalesce("count", F.lit(0))).cast("long").alias("mass"))
    rate = F.col("mass") / F.col("N_c")
    return nodes.select("node_id", "N_c", "m_c").join(mass, "node_id").withColumn("rate", rate).withColumn("ratio", F.when(F.col("m_c") > 0, rate / F.col("m_c")).otherwise(F.lit(float("inf"))))


def offenders(realised_rows: DataFrame, top: int = 25) -> tuple[DataFrame, DataFrame]:
    """Concepts meant to shrink that grew most beyond intent, and concepts meant to grow that fell shortest."""
    down = realised_rows.where("m_c < 1").orderBy(F.desc("ratio"), "node_id").limit(top)
    up = realised_rows.where("m_c > 1").orderBy("ratio", "node_id").limit(top)
    return down, up


def bands(nodes: DataFrame, s: Schedule) -> DataFrame:
    return nodes.groupBy(band(F.col("N_c"), s).alias("band")).agg(F.count(F.lit(1)).alias("nodes"), F.sum("N_c").alias("links"))


def sample_bands(multiplicities: DataFrame) -> DataFrame:
    """One row: samples dropped, thinned, kept, repeated, and the expected size."""
    m = F.col("m")
    return multiplicities.agg(
        F.count_if(m <= 0).alias("dropped"), F.count_if((m > 0) & (m < 1)).alias("thinned"), F.count_if(m == 1).alias("kept"), F.count_if(m > 1).alias("repeated"), F.sum(m).alias("expected")
    )


def bucket_samples(links: DataFrame, buckets: DataFrame) -> DataFrame:
    """(bucket, samples): distinct samples with a node of the bucket; 0 for buckets without any."""
    hit = links.join(small(buckets), "node_id").select("bucket", "sample_key").distinct().groupBy("bucket").agg(F.count(F.lit(1)).alias("samples"))
    return buckets.select("bucket").distinct().join(hit, "bucket", "left").select("bucket", F.coalesce("samples", F.lit(0)).alias("samples"))


def composition(links: DataFrame, concepts: DataFrame) -> DataFrame:
    """(head, node_id, links, level): links by the last word of the concept's name, by concept, and in all (a rollup)."""
    head = F.coalesce(F.nullif(F.element_at(F.split(base_name(F.col("node_name")), r"\s+"), -1), F.lit("")), F.lit("(none)"))
    named = links.join(small(concepts.select("node_id", head.alias("head"))), "node_id")
    return named.rollup("head", "node_id").agg(F.count(F.lit(1)).alias("links"), F.grouping_id().alias("level"))


def top_concepts(counts: DataFrame, concepts: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent concepts with their names, or ids where there is none."""
    best = counts.orderBy(F.desc("N_c"), "node_id").limit(k)
    return best.join(concepts.select("node_id", "node_name"), "node_id", "left").select("node_id", "N_c", F.coalesce("node_name", "node_id").alias("name"))


def group_composition(counts: DataFrame, groups: DataFrame, fraction: float = 0.02) -> DataFrame:
    """(grp, nodes, links, share, top_share, gini) of the groups (node_id, grp) of concepts: share of all links, and within
    the group what its most frequent concepts hold (max(1, fraction * n rounded half to even) of them) and the Gini index.

    Concepts without a group form the group (none). Windows see distinct frequencies of a group, not concepts.
    """
    named = counts.where("N_c > 0").join(small(groups.select("node_id", "grp")), "node_id", "left").select(F.coalesce("grp", F.lit("(none)")).alias("grp"), F.col("N_c").alias("x"))
    levels = named.groupBy("grp", "x").agg(F.count(F.lit(1)).alias("c"))
    w = W.partitionBy("grp")
    before = lambda order: F.coalesce(F.sum("c").over(w.orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = levels.withColumns({"up": before(F.asc("x")), "down": before(F.desc("x")), "n": F.sum("c").over(w)})
    x, c = F.col("x").cast("double"), F.col("c")
    taken = F.greatest(F.lit(0.0), F.least(c.cast("double"), F.greatest(F.lit(1.0), F.rint(F.lit(fraction) * F.col("n"))) - F.col("down")))
    sums = placed.groupBy("grp").agg(F.sum("c").alias("nodes"), F.sum(F.col("x") * c).alias("links"), F.sum(x * taken).alias("top"), F.sum(x * (c * F.col("up") + c * (c + 1) / 2)).alias("ranked"))
    total = sums.agg(F.sum("links")).scalar()
    n, links = F.col("nodes"), F.col("links")
    return sums.select("grp", "nodes", "links", (links / total).alias("share"), (F.col("top") / links).alias("top_share"), (2 * F.col("ranked") / (n * links) - (n + 1) / n).alias("gini"))


def nodes_per_sample(links: DataFrame) -> DataFrame:
    """One row (samples, median): how many samples have links, and the upper median of their numbers of links. The window
    sees one row per number. No links give 0 and null."""
    numbers = links.groupBy("sample_key").agg(F.count(F.lit(1)).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    upto = numbers.withColumns({"upto": F.sum("c").over(W.orderBy("k").rowsBetween(W.unboundedPreceding, 0)), "n": F.sum("c").over(W.partitionBy(F.lit(0)))})
    return upto.agg(F.coalesce(F.max("n"), F.lit(0)).alias("samples"), F.min(F.when(F.col("upto") > F.floor(F.col("n") / 2), F.col("k"))).alias("median"))
