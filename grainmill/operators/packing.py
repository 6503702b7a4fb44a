"""Token sequences into fixed lengths: best-fit decreasing, wrapped, padded batches."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.sequences import padded, round_up


def _best_fit_decreasing(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(n=[min(len(x), length) for x in pdf["tokens"]]).sort_values(["n", "id"], ascending=[False, True], kind="stable")
        room: list[int] = []  # open spaces in order; bins of one space in the order in which they reached it
        bins: dict[int, list[int]] = {}
        out: list[list[int]] = []
        for row, n in enumerate(pdf["n"]):
            at = bisect_left(room, n)
            if n and at < len(room):
                space = room[at]
                queue = bins[space]
                k = queue.pop(0)
                if not queue:
                    room.pop(at)
                    del bins[space]
            else:
                space, k = length, len(out)
                out.append([])
            out[k].append(row)
            left = space - n
            if left:
                if left not in bins:
                    bins[left] = []
                    room.insert(bisect_left(room, left), left)
                bins[left].append(k)
        tokens = pdf["tokens"].tolist()
        return pd.DataFrame(
            {
                "pack_group": pdf["pack_group"].iloc[0],
                "bin": range(len(out)),
                "tokens": [[t for r in b for t in list(tokens[r])[:length]] for b in out],
                "seq_lengths": [[min(len(tokens[r]), length) for r in b] for b in out],
            }
        )

    return run


def pack_best_fit(rows: DataFrame, length: int) -> DataFrame:
    """(pack_group, bin, tokens, seq_lengths) from (pack_group, id, tokens). Sequences are cut to the length, taken longest
    first (ties by id), and put where they fit best, the bin waiting longest first. A group is one task's work: give it a
    bounded number of rows (pack_groups does). Null tokens count as empty; an empty sequence opens a bin of its own."""
    clean = rows.select(F.col("pack_group").cast("long"), F.col("id").cast("long"), F.coalesce("tokens", F.expr("cast(array() as array<int>)")).cast("array<int>").alias("tokens"))
    return clean.groupBy("pack_group").applyInPandas(_best_fit_decreasing(length), "pack_group long, bin long, tokens array<int>, seq_lengths array<int>")


def pack_groups(rows: DataFrame, id_column: str, total: int, size: int = 1000) -> DataFrame:
    """Adds pack_group: hash groups of about so many rows."""
    return rows.withColumn("pack_group", F.pmod(F.xxhash64(id_column), F.lit(max(1, -(-total // size)))))


def pack_wrapped(rows: DataFrame, length: int) -> DataFrame:
    """(pack_group, piece, tokens): a group's sequences in order of id, end to end, cut every `length` tokens; the last
    piece may be shorter. Groups are bounded, as for best fit; offsets come from running sums of lengths, so that tokens
    move once, to the piece they belong to."""
    placed = rows.where(F.size("tokens") > 0).withColumn("start", F.coalesce(F.sum(F.size("tokens")).over(W.partitionBy("pack_group").orderBy("id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    end = F.col("start") + F.size("tokens") - 1
    cuts = placed.withColumn("piece", F.explode(F.sequence(F.floor(F.col("start") / length), F.floor(end / length))))
    lo = F.greatest(F.col("piece") * length - F.col("start"), F.lit(0))
    hi = F.least((F.col("piece") + 1) * length - F.col("start"), F.size("tokens"))
    part = cuts.select("pack_group", "piece", "start", F.slice("tokens", (lo + 1).cast("int"), (hi - lo).cast("int")).alias("t"))
    gathered = part.groupBy("pack_group", "piece").agg(F.sort_array(F.collect_list(F.struct("start", "t"))).alias("p"))
    return gathered.select("pack_group", "piece", F.flatten(F.transform("p", lambda x: x["t"])).alias("tokens"))


def pad_batches(rows: DataFrame, batch: str, column: str, pad: int = 0, side: str = "right", multiple: int = 1) -> DataFrame:
    """Sequences of a batch filled to its longest, rounded up to a multiple; adds `<column>_mask`."""
    longest = rows.groupBy(batch).agg(F.max(F.size(column)).alias("_n"))
    wide = rows.join(longest, batch)
    n = round_up(F.col("_n"), multiple)
    ones = F.transform(F.col(column), lambda _: F.lit(1))
    return wide.withColumns({f"{column}_mask": padded(ones, n, 0, side), column: padded(F.col(column), n, pad, side)}).drop("_n")
