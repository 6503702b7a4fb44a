"""Texts into containers of fixed capacity: a grouping genetic algorithm on islands with elite migration.

Each capacity group is cut into blocks of bounded size by a hash, so a group that holds a third of all rows is spread over
the cluster. Every block is packed by best fit first; one above its lower bound evolves on several islands, and between epochs each island hands its best packing to the next one. A
block whose packing reaches the lower bound ceil(sum / capacity) is optimal and evolves no further. Last, the least filled
containers of all blocks of a group are dissolved and packed once more in new blocks, so that nearly all of what stays half
empty is one container for each of those few blocks.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from random import Random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..context import cut, listed, small


@dataclass(frozen=True)
class Packing:
    block: int = 1000
    islands: int = 2
    epochs: int = 2
    population: int = 6
    generations: int = 30
    #: Share of a block's containers, the least filled ones, that are dissolved and packed again with those of other blocks.
    dissolve: float = 0.05
    seed: int = 11


def token_counts(documents: DataFrame, id_column: str, text: str, vocabulary: str, group: str | None = None) -> DataFrame:
    """(id, grp, size): tokens of the whole text as stored, without special tokens. Null text has size 0.

    `vocabulary` is the path of a byte-level rank file that every executor can read; nothing is copied or trained.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(sizes, pa.int64())], names=["id", "grp", "size"])

    grp = (F.col(group) if group else F.lit(None)).cast("string")
    return documents.select(F.col(id_column).cast("long"), grp.alias("grp"), F.col(text).alias("text")).mapInArrow(count, "id long, grp string, size long")


Bins = list[list[int]]


def best_fit(items: list[int], size: np.ndarray, capacity: int, bins: Bins) -> Bins:
    """Puts items, largest first, into the fullest container that still has room; opens a container where none has."""
    room = sorted((capacity - int(sum(size[i] for i in b)), k) for k, b in enumerate(bins))
    bins = [list(b) for b in bins]
    for i in sorted(items, key=lambda i: (-size[i], i)):
        s = int(size[i])
        at = bisect_left(room, (s, -1))
        if at == len(room):
            bins.append([i])
            insort(room, (capacity - s, len(bins) - 1))
        else:
            free, k = room.pop(at)
            bins[k].append(i)
            insort(room, (free - s, k))
    return bins


def completed(items: list[int], size: np.ndarray, capacity: int) -> Bins:
    """Container by container: the largest item left, then, while something fits, the one or two items that fill best."""
    left = sorted((int(size[i]), i) for i in items)
    bins = []
    while left:
        s, i = left.pop()
        room, held = capacity - s, [i]
        while left and left[0][0] <= room:
            at = bisect_left(left, (room + 1, -1)) - 1
            low, high, best, take = 0, at, left[at][0], (at,)
            while low < high and best < room:
                both = left[low][0] + left[high][0]
                if both > room:
                    high -= 1
                    continue
                if both > best:
                    best, take = both, (high, low)
                low += 1
            for k in take:
                held.append(left.pop(k)[1])
            room -= best
        bins.append(held)
    return bins


def fitness(bins: Bins, size: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer containers first; among equals, rather full ones and near-empty ones than all half full."""
    return -len(bins), sum((float(sum(size[i] for i in b)) / capacity) ** 2 for b in bins)


def crossover(one: Bins, two: Bins, size: np.ndarray, capacity: int, rng: Random) -> Bins:
    """Whole well-filled containers of `one` go into `two`; containers of `two` that hold any of their items are dissolved,
    and the items that lost their place are put back by best fit."""
    fullest = sorted(one, key=lambda b: -int(sum(size[i] for i in b)))
    cut_at = max(1, int(len(fullest) * rng.uniform(0.2, 0.6)))
    inject = fullest[:cut_at]
    placed = {i for b in inject for i in b}
    keep, lost = [], []
    for b in two:
        if placed.isdisjoint(b):
            keep.append(b)
        else:
            lost += [i for i in b if i not in placed]
    return best_fit(lost, size, capacity, inject + keep)


def mutate(bins: Bins, size: np.ndarray, capacity: int, rng: Random) -> Bins:
    """Dissolves the emptiest containers and some others, and fills new ones with their items one after the other."""
    order = sorted(range(len(bins)), key=lambda k: int(sum(size[i] for i in bins[k])))
    out = {*order[: max(1, len(bins) // 20)], *(rng.randrange(len(bins)) for _ in range(max(2, len(bins) // 10)))}
    return [b for k, b in enumerate(bins) if k not in out] + completed([i for k in sorted(out) for i in bins[k]], size, capacity)


def evolve(size: np.ndarray, capacity: int, p: Packing, rng: Random, elites: list[Bins]) -> Bins:
    """The best packing of one island after an epoch that begins with the given elites."""
    items = list(range(len(size)))
    bound = -(-int(size.sum()) // capacity)
    population = [*elites, best_fit(items, size, capacity, [])]
    if min(len(b) for b in population) <= bound:
        return min(population, key=len)
    population.append(completed(items, size, capacity))
    while len(population) < p.population:  # the rest begin with a random part placed first
        rng.shuffle(items)
        population.append(best_fit(items[len(items) // 3 :], size, capacity, best_fit(items[: len(items) // 3], size, capacity, [])))
    scored = [(fitness(b, size, capacity), k, b) for k, b in enumerate(population)]
    serial = len(scored)
    for _ in range(p.generations):
        for _ in range(p.population // 2):
            one, two = (max(rng.sample(scored, min(2, len(scored))))[2] for _ in range(2))
            child = crossover(one, two, size, capacity, rng)
            if rng.random() < 0.5:
                child = mutate(child, size, capacity, rng)
            scored.append((fitness(child, size, capacity), serial, child))
            serial += 1
        scored = sorted(scored, reverse=True)[: p.population]
        if -scored[0][0][0] <= bound:
            break
    return scored[0][2]


def _epoch(p: Packing, epoch: int):
    """One island of one block: its items, and the packing each elite proposes for them."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        grp, block, island = key
        pdf = pdf.sort_values(["id", "part"], kind="stable").reset_index(drop=True)
        size, capacity = pdf["size"].to_numpy(), int(pdf["capacity"].iloc[0])
        elites = []
        for c in ("own", "other"):
            if c in pdf and pdf[c].iloc[0] >= 0:
                by: dict[int, list[int]] = {}
                for i, b in enumerate(pdf[c]):
                    by.setdefault(int(b), []).append(i)
                elites.append(list(by.values()))
        best = evolve(size, capacity, p, Random(hash((p.seed, epoch, int(block), int(island)))), elites)
        bin_of = np.empty(len(size), np.int64)
        for k, b in enumerate(sorted(best, key=min)):
            bin_of[b] = k
        return pd.DataFrame({"grp": grp, "block": block, "island": island, "id": pdf["id"], "part": pdf["part"], "size": size, "capacity": capacity, "bin": bin_of})

    return run


_PACKED = "grp string, block long, island int, id long, part int, size long, capacity long, bin long"


def _islands(items: DataFrame, p: Packing) -> DataFrame:
    """items (grp, block, id, part, size, capacity) with the best packing found: plus bin, numbered within its block."""
    start = items.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(p.islands - 1))))
    now = cut(start.groupBy("grp", "block", "island").applyInPandas(_epoch(p, 0), _PACKED))
    key = ["grp", "block"]

    def bins(df: DataFrame) -> DataFrame:
        return df.groupBy(*key, "island").agg(F.max("bin").alias("bins"), F.sum("size").alias("total"), F.max("capacity").alias("capacity"))

    for epoch in range(1, p.epochs):
        # blocks that reached their lower bound are done
        open_blocks = bins(now).groupBy(*key).agg(F.min("bins").alias("b"), F.max("total").alias("t"), F.max("capacity").alias("c")).where("b + 1 > ceil(t / c)").select(*key)
        evolving = now.join(open_blocks, key)
        elite = evolving.select(*key, F.pmod(F.col("island") + 1, F.lit(p.islands)).cast("int").alias("island"), "id", "part", F.col("bin").alias("other"))
        both = evolving.withColumnRenamed("bin", "own").join(elite, [*key, "island", "id", "part"])
        now = cut(now.join(open_blocks, key, "left_anti").unionByName(both.groupBy("grp", "block", "island").applyInPandas(_epoch(p, epoch), _PACKED)))
    best = bins(now).groupBy(*key).agg(F.min(F.struct("bins", "island")).alias("m")).select(*key, F.col("m.island").alias("island"))
    return now.join(best, [*key, "island"]).drop("island")


def pack(sizes: DataFrame, capacities: DataFrame, p: Packing = Packing()) -> DataFrame:
    """(id, part, grp, container, size, capacity): every item with its container or containers.

    `sizes` has id, grp, size; `capacities` has grp, capacity. An item larger than the capacity is split into full pieces,
    each a container of its own, and a remainder that is packed like any item; parts count from 0. All other items are
    whole. A null group, or one without a positive capacity, has container null, as nothing says how large it may be. Null
    sizes count as 0. Of repeated capacities of a group the smallest holds; ids must be unique.
    """
    known = capacities.where("grp is not null and capacity > 0").groupBy("grp").agg(F.min(F.col("capacity").cast("long")).alias("capacity"))
    items = sizes.select("id", "grp", F.coalesce("size", F.lit(0)).cast("long").alias("size")).join(small(known), "grp", "left")
    items = cut(items)
    homeless = items.where("capacity is null").select("id", F.lit(0).alias("part"), "grp", F.lit(None).cast("string").alias("container"), "size", "capacity")
    pieces = items.where("capacity is not null").select(
        "id", "grp", "capacity", "size", F.expr("int(if(size > capacity, size div capacity, 0))").alias("full")
    )
    whole = pieces.where("full > 0").select(
        "id", F.explode(F.expr("sequence(0, full - 1)")).alias("part"), "grp", "capacity"
    ).select("id", "part", "grp", F.concat_ws("/", "grp", F.lit("full"), "id", "part").alias("container"), F.col("capacity").alias("size"), "capacity")
    rest = pieces.where("full = 0 or size % capacity > 0").select("grp", "id", F.col("full").alias("part"), F.expr("if(full > 0, size % capacity, size)").alias("size"), "capacity")

    counts = rest.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    blocked = rest.join(listed(counts), "grp").withColumn(
        "block", F.pmod(F.xxhash64("id", "part"), F.expr(f"n div {p.block} + 1"))
    )
    done = []
    current = blocked.select("grp", "block", "id", "part", "size", "capacity")
    packed = cut(_islands(current, p))
    fill = packed.groupBy("grp", "block", "bin").agg(F.sum("size").alias("filled"), F.max("capacity").alias("capacity"))
    # each block keeps its well-filled containers; the rest of all blocks of a group is packed once more together
    loose = fill.where(F.col("filled") < (1 - p.dissolve) * F.col("capacity")).select("grp", "block", "bin")
    kept = packed.join(loose, ["grp", "block", "bin"], "left_anti")
    done.append(kept.withColumn("level", F.lit(0)))
    again = packed.join(loose, ["grp", "block", "bin"]).select("grp", "id", "part", "size", "capacity")
    again = cut(again)
    n = again.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    second = again.join(listed(n), "grp").withColumn("block", F.pmod(F.xxhash64("id", "part", F.lit(1)), F.expr(f"n div {p.block} + 1")))
    done.append(_islands(second.select("grp", "block", "id", "part", "size", "capacity"), p).withColumn("level", F.lit(1)))
    tidy = [d.select("id", "part", "grp", F.concat_ws("/", "grp", "level", "block", "bin").alias("container"), "size", "capacity") for d in done]
    return homeless.unionByName(whole).unionByName(tidy[0]).unionByName(tidy[1])
