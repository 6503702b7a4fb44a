"""Order, splits and repetition of rows, from hashes of a key: the same on every run and in any partitioning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..context import cut


def ranked(rows: DataFrame, *order: str | Column, name: str = "place", ranges: int = 0) -> DataFrame:
    """Adds each row's 0-based place in the order, without one task that sees all rows: rows are range-partitioned and
    sorted, ranges counted, and a row's place is the count of the ranges before its own plus its place in it.

    The order must be total, or ties fall either way. The sorted rows are written to the shared folder first, so that both
    passes see the same ranges.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(rows.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row per range
    inside = placed.withColumn("_i", F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1)
    return inside.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_i")).drop("_p", "_c", "_before", "_i")


def quantiles(rows: DataFrame, value: str, q: float, *groups: str) -> DataFrame:
    """(groups, quantile): of each group's values, linear between neighbours; exact, and no task sees a whole group.

    Equal values are counted first, on the map side; the distinct ones are range-partitioned, and a value's rank is what the
    ranges before its own hold of its group and what stands before it there. Nulls and NaN don't count; a group of nothing
    else has null. Without groups it is one row, null for no values.
    """
    keys = [F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)] or [F.lit(0).alias("_g0")]
    names = [f"_g{i}" for i in range(len(keys))]
    known = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    values = rows.select(*keys, known.alias("_v"))
    counts = values.where("_v is not null").groupBy(*names, "_v").agg(F.count(F.lit(1)).alias("_c"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(counts.repartitionByRange(n, *names, "_v").withColumn("_p", F.spark_partition_id()))
    theirs = [f"_r{i}" for i in range(len(names))]
    ranges = placed.groupBy(*[F.col(k).alias(r) for k, r in zip(names, theirs)], F.col("_p").alias("_q")).agg(F.sum("_c").alias("_s"))
    of_group = W.partitionBy(*theirs)  # a row per range
    before = F.coalesce(F.sum("_s").over(of_group.orderBy("_q").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumns({"_before": before, "_n": F.sum("_s").over(of_group)})
    upto = F.col("_before") + F.sum("_c").over(W.partitionBy("_p", *names).orderBy("_v"))
    same = [F.col("_p") == F.col("_q"), *[F.col(k).eqNullSafe(F.col(r)) for k, r in zip(names, theirs)]]
    ranked = placed.join(ranges, same).withColumn("_upto", upto)
    at = (F.col("_n") - 1) * F.lit(float(q))
    holds = lambda r: F.max(F.when((r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_c")), F.col("_v")))
    found = ranked.groupBy(*names).agg(holds(F.floor(at)).alias("_lo"), holds(F.ceil(at)).alias("_hi"), F.max(at - F.floor(at)).alias("_f"))
    exact = found.select(*names, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(F.col("_lo") + F.col("_f") * (F.col("_hi") - F.col("_lo"))).alias("quantile"))
    if not groups:
        return exact.agg(F.max("quantile").alias("quantile"))
    every = values.select(*[F.col(k).alias(r) for k, r in zip(names, theirs)]).distinct()
    out = every.join(exact, [F.col(k).eqNullSafe(F.col(r)) for k, r in zip(names, theirs)], "left")
    return out.select(*[F.col(r).alias(g) for r, g in zip(theirs, groups)], "quantile")


#: Values of a narrowed range that are fetched and sorted on the driver, and bins a range is counted in.
FETCHED, BINS = 10_000, 1024


def quantile(rows: DataFrame, value: str, q: float) -> float | None:
    """quantiles() of all rows as a number, without a sort: the range that holds the rank is counted in bins and narrowed to
    one of them, until it has few values or is one value. Each step is an aggregate of BINS rows at most."""
    known = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    x = rows.select(known.alias("x")).where("x is not null")
    n, least, most = x.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
    if not n:
        return None

    def at(rank: int) -> float:
        low, high, inside = least, most, n
        while low < high:
            part = x.where(F.col("x").between(low, high))
            width = high - low
            if inside <= FETCHED or not 0 < width < float("inf"):
                if inside > FETCHED:  # bounds too far apart to be counted in bins
                    return quantiles(part, "x", rank / (inside - 1)).first()[0]
                return sorted(r.x for r in part.collect())[rank]
            b = F.least(F.floor((F.col("x") - low) / width * BINS), F.lit(BINS - 1))
            for r in part.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("b").collect():
                if rank < r.c:
                    low, high, inside = r.lo, r.hi, r.c
                    break
                rank -= r.c
        return low

    place = (n - 1) * q
    one = at(int(place))
    two = one if place == int(place) else at(int(place) + 1)
    return one if one == two else one + (place - int(place)) * (two - one)


def shuffle(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Adds `place` in a pseudo-random order of distinct keys."""
    return ranked(rows.withColumn("_h", F.xxhash64(key, F.lit(seed))), "_h", key).drop("_h")


def exact_split(rows: DataFrame, key: str, test: float | int, seed: int = 42) -> DataFrame:
    """Adds `split`: exactly `test` rows, or that share of all rounded up, are test."""
    n = rows.count()
    size = -(-int(round(test * n * 1e9)) // 10**9) if isinstance(test, float) else test
    if not 0 <= size <= n:
        raise ValueError(f"cannot hold out {size} of {n} rows")
    return shuffle(rows, key, seed).withColumn("split", F.when(F.col("place") < size, "test").otherwise("train")).drop("place")


def hold_out_last(rows: DataFrame, key: str, n: int) -> DataFrame:
    total = rows.count()
    return ranked(rows, key).withColumn("split", F.when(F.col("place") >= total - n, "test").otherwise("train")).drop("place")


def sample_rows(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement: those whose hashes are least."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def repeat_plan(rows: DataFrame, key: str, batch: int, mini_repeat: int = 1, repeat: int = 1, seed: int = 42) -> DataFrame:
    """(position, key): a permutation in batches of distinct keys; an incomplete batch goes; each batch comes `repeat` times,
    each key in it `mini_repeat` times in a row."""
    n = rows.count()
    placed = shuffle(rows.select(key), key, seed).where(F.col("place") < n // batch * batch)
    chunk, inside = F.floor(F.col("place") / batch), F.col("place") % batch
    one = placed.select(key, chunk.alias("chunk"), inside.alias("inside"), F.explode(F.sequence(F.lit(0), F.lit(repeat - 1))).alias("r"))
    two = one.select(key, "chunk", "inside", "r", F.explode(F.sequence(F.lit(0), F.lit(mini_repeat - 1))).alias("m"))
    return two.select((((F.col("chunk") * repeat + F.col("r")) * batch + F.col("inside")) * mini_repeat + F.col("m")).alias("position"), key)


def _even_split(world: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "id"], ascending=[False, True], kind="stable")
        room = -(-len(pdf) // world)
        total, count, where = [0] * world, [0] * world, []
        for n in pdf["length"]:
            k = min((k for k in range(world) if count[k] < room), key=lambda k: (total[k], k))
            where.append(k)
            total[k] += n
            count[k] += 1
        return pdf.assign(chunk=where)[["megabatch", "chunk", "id", "length"]]

    return run


def length_grouped(rows: DataFrame, key: str, length: str, batch: int, world: int, seed: int = 42) -> DataFrame:
    """(megabatch, chunk, id, length): random megabatches of batch * world rows; in each, longest first, every row to the
    worker with the least total that has room."""
    placed = shuffle(rows.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("length")), "id", seed)
    mega = placed.select(F.floor(F.col("place") / (batch * world)).alias("megabatch"), "id", "length")
    return mega.groupBy("megabatch").applyInPandas(_even_split(world), "megabatch long, chunk int, id long, length long")


def random_length(key: Column, low: int, high: int, seed: int = 42) -> Column:
    """A pseudo-random whole number in [low, high)."""
    return (F.lit(low) + F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(high - low))).cast("int")


def round_robin(place: Column, n: int) -> Column:
    return F.pmod(place, F.lit(n))


def first_k(rows: DataFrame, k: int, *order: Column | str) -> DataFrame:
    return rows.orderBy(*order).limit(k)


def head_fraction(rows: DataFrame, fraction: float, *order: Column | str) -> DataFrame:
    """The first rows in order, that share of all rounded down."""
    return rows.orderBy(*order).limit(int(rows.count() * fraction))


def sample_with_replacement(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """(draw, rows' columns): n draws, each of one row by a hash of the draw's number. No rows give no draws."""
    total = rows.count()
    if not total:
        return rows.withColumn("draw", F.lit(0).cast("long")).limit(0)
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(total)).alias("_place"))
    return ranked(rows, key, name="_place").join(draws, "_place").drop("_place")


def modality_grouped(rows: DataFrame, key: str, length: str, batch: int, world: int, seed: int = 42) -> DataFrame:
    """length_grouped() of rows whose length's sign tells their modality: megabatches hold one modality each, but for a last
    one of what either leaves over; lengths come out without their sign. Rows of length 0 or null count as positive."""
    size = batch * world
    signed = rows.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(length), F.lit(0)).cast("long").alias("length")).withColumn("text", F.col("length") < 0).withColumn("length", F.abs("length"))
    sides = [shuffle(signed.where("text" if text else "not text"), "id", seed + text) for text in (False, True)]
    counts = [s.count() for s in sides]
    whole = [c // size for c in counts]
    parts = [s.select(F.when(F.col("place") < w * size, F.floor(F.col("place") / size) + at).otherwise(F.lit(sum(whole)) + F.floor((F.col("place") - w * size + skip) / size)).cast("long").alias("megabatch"), "id", "length") for s, w, at, skip in zip(sides, whole, (0, whole[0]), (0, counts[0] % size))]
    return parts[0].unionByName(parts[1]).groupBy("megabatch").applyInPandas(_even_split(world), "megabatch long, chunk int, id long, length long")
