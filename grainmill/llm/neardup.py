"""Near-duplicate texts: universal-hash minima with banding, signature check, exact check, connected components.

The steps, all over whole texts and all rows:

1. Each text becomes the set of its word shingles, as sorted 64-bit hashes. Texts with equal sets form a class of copies;
   one row per class goes on.
2. `bands * rows` minima of universal hash functions; each band of minima is a key. Classes that share a key in some band
   are candidates.
3. A key shared by many classes is a hot bucket. Its pairs aren't emitted; its members are keyed again by their
   least-frequent shingles (prefix filter), which loses no pair at or above the threshold.
4. Candidates of a bucket are checked there by their signatures, one bit of each of 256 minima: a pair goes on if its bits
   agree as often as those of a pair at the threshold would but for five standard deviations. What is left is checked
   exactly, on whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..context import cut, listed
from .components import connected_components
from .words import words


@dataclass(frozen=True)
class NearDuplicates:
    """Parameters. With five rows in each of 128 bands a pair at a similarity of 0.5 is found with probability 0.983,
    at 0.55 with 0.9988 and at 0.6 with 0.99997; for a threshold of 0.8 far fewer bands do."""

    shingle: int = 5
    threshold: float = 0.8
    least_words: int = 5
    bands: int = 26
    rows: int = 5
    seed: int = 20240229
    #: A bucket of more classes than this is keyed again rather than paired.
    hot_bucket: int = 64
    #: Byte-equal copies of one text are written out pair by pair up to so many pairs; beyond that as a star.
    expand_pairs: int = 4096
    #: Members of a class, or texts of one, that a task joins at a time.
    salted: int = 2048
    #: Minima of which one bit is kept for the signature check, in words of 64 bits.
    checked: int = 256

    @property
    def sketch(self) -> int:
        return min(self.checked, self.bands * self.rows) // 64

    @property
    def most_unequal(self) -> int:
        """Of the kept bits, how many may differ: a pair at similarity t agrees in each with probability (1 + t) / 2."""
        k, q = 64 * self.sketch, (1 - self.threshold) / 2
        return int(k * q + 5 * (k * q * (1 - q)) ** 0.5)


def shingle_hashes(tokens: list[str], n: int, known: dict[str, int]) -> np.ndarray:
    """The distinct hashed n-word shingles, sorted. A text of fewer words than n is one shingle."""
    if len(known) > 1_000_000:
        known.clear()
    codes = np.empty(len(tokens), np.uint64)
    for i, w in enumerate(tokens):
        c = known.get(w)
        if c is None:
            c = known[w] = xxhash.xxh64_intdigest(w)
        codes[i] = c
    n = min(n, len(tokens))
    h = np.zeros(len(tokens) - n + 1, np.uint64)
    for i in range(n):
        h = (h ^ codes[i : len(tokens) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def _hash_family(p: NearDuplicates) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-shift: x -> (a x + b mod 2^64) >> 32 with odd a, a universal family on 64-bit keys."""
    rng = np.random.Generator(np.random.PCG64(p.seed))
    k = p.bands * p.rows
    a = rng.integers(0, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, k, dtype=np.uint64)


def _shingle_sets(p: NearDuplicates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            ids, sets, keys, same = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text)
                if len(w) >= max(1, p.least_words):
                    s = shingle_hashes(w, p.shingle, known)
                    ids.append(i)
                    sets.append(s)
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    same.append(xxhash.xxh3_64_intdigest(text.encode(errors="surrogatepass")) - (1 << 63))
            if ids:
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                arrays = [pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets))), pa.array(same, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=["id", "key", "shingles", "same"])

    return run


def _sign(p: NearDuplicates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _hash_family(p)
        weight = np.random.Generator(np.random.PCG64(p.seed + 1)).integers(0, 1 << 63, p.rows, dtype=np.uint64) | np.uint64(1)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 256):
                part = column.slice(at, 256)
                x = part.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                starts = np.concatenate([[0], np.cumsum(part.value_lengths().to_numpy(zero_copy_only=False))[:-1]]).astype(np.int64)
                minima = np.empty((len(part), len(a)), np.uint64)
                for j in range(len(a)):
                    minima[:, j] = np.minimum.reduceat((x * a[j] + b[j]) >> np.uint64(32), starts)
                banded = minima.reshape(len(part), p.bands, p.rows)
                keys = np.zeros((len(part), p.bands), np.uint64)
                for r in range(p.rows):
                    keys = (keys ^ banded[:, :, r]) * weight[r]
                    keys ^= keys >> np.uint64(31)
                keys = (keys ^ np.arange(p.bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
                step = np.arange(len(part) + 1, dtype=np.int32)
                bits = np.packbits((minima[:, : 64 * p.sketch] & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, 256),
                        pa.ListArray.from_arrays(pa.array(step * p.bands), pa.array(keys.ravel())),
                        pa.ListArray.from_arrays(pa.array(step * p.sketch), pa.array(bits.ravel())),
                    ],
                    names=["rep", "keys", "sketch"],
                )

    return run


def _exact(p: NearDuplicates):
    """Of each candidate: does the similarity of the whole sets reach the threshold?"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))])

        for batch in batches:
            if not batch.num_rows:
                continue
            (xa, oa), (xb, ob) = rows(batch.column(2)), rows(batch.column(3))
            sim = np.full(batch.num_rows, -1.0)
            for i in range(batch.num_rows):
                s, t = xa[oa[i] : oa[i + 1]], xb[ob[i] : ob[i + 1]]
                both = len(np.intersect1d(s, t, assume_unique=True))
                sim[i] = both / (len(s) + len(t) - both)
            keep = np.flatnonzero(sim >= p.threshold)
            if len(keep):
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), batch.column(1).take(pa.array(keep)), pa.array(sim[keep])], names=["a", "b", "similarity"])

    return run


def shingle_classes(texts: DataFrame, id_column: str, text: str, p: NearDuplicates) -> tuple[DataFrame, DataFrame]:
    """(members: id, rep, same) and (classes: rep, shingles, copies); a class holds the texts of one shingle set, those of
    equal `same` are equal byte by byte.

    Null texts and texts below `least_words` are in no class. Sizes are aggregated on the map side, so that a third of all
    rows may be one text; only digests and ids move for that. The sets stay where they were written, and a class is the row
    of its least id.
    """
    sets = texts.where(F.col(id_column).isNotNull() & F.col(text).isNotNull()).select(F.col(id_column).cast("long"), F.col(text)).mapInArrow(
        _shingle_sets(p), "id long, key binary, shingles array<long>, same long"
    )
    sets = cut(sets)
    sizes = sets.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    copied = listed(sizes)
    # a class of one is its own member: only copies need the join
    placed = sets.join(copied, "key", "left").withColumns({"rep": F.coalesce("rep", "id"), "copies": F.coalesce("copies", F.lit(1).cast("long"))})
    return placed.select("id", "rep", "same"), placed.where("id = rep").select("rep", "shingles", "copies")


def _hot_pairs(hot: DataFrame, classes: DataFrame, p: NearDuplicates) -> DataFrame:
    """Candidate pairs among the members of hot buckets, without pairing a bucket.

    Of two sets with similarity t or more, each holds one of the other's first |s| - ceil(t |s|) + 1 shingles in any common
    order. In the order rare first, that prefix key is shared by few; the order needs the counts of the hot members only.
    """
    sets = hot.select("rep").distinct().join(classes.select("rep", "shingles"), "rep").select("rep", F.explode("shingles").alias("s"), F.size("shingles").alias("n"))
    df = sets.groupBy("s").agg(F.count(F.lit(1)).alias("f"))
    ranked = sets.join(df, "s").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("f", "s"))).alias("order"))
    first = F.col("n") - F.ceil(F.col("n") * p.threshold - 1e-9).cast("int") + 1
    keyed = ranked.select("rep", "n", F.explode(F.slice("order", F.lit(1), F.greatest(first, F.lit(1)))).alias("o")).select("rep", "n", F.col("o.s").alias("s"))
    other = keyed.select(F.col("rep").alias("b"), F.col("n").alias("nb"), "s")
    return (
        keyed.join(other, "s")
        .where((F.col("rep") < F.col("b")) & (F.least("n", "nb") >= p.threshold * F.greatest("n", "nb")))
        .select(F.col("rep").alias("a"), "b")
        .distinct()
    )


def similar_classes(classes: DataFrame, p: NearDuplicates) -> DataFrame:
    """(a, b, similarity), a < b: pairs of class representatives at or above the threshold."""
    signed = cut(classes.select("rep", "shingles").mapInArrow(_sign(p), "rep long, keys array<long>, sketch array<long>"))
    keyed = signed.select("rep", F.explode("keys").alias("key"))
    # most keys are of one class and end here, and those of two or three classes are told in full by what one aggregate keeps
    buckets = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.bit_xor("rep").alias("x")).where("n > 1"))
    third = F.col("x").bitwiseXOR(F.col("lo")).bitwiseXOR(F.col("hi"))
    pair = lambda one, two: F.struct(one.alias("a"), two.alias("b"))
    lo, hi = F.col("lo"), F.col("hi")
    told = F.when(F.col("n") == 2, F.array(pair(lo, hi))).otherwise(F.array(pair(lo, hi), pair(lo, third), pair(third, hi)))
    small_buckets = buckets.where("n <= 3").select(F.explode(told).alias("p")).select("p.a", "p.b")
    members = cut(keyed.join(listed(buckets.where("n > 3").select("key", "n"), 1_000_000), "key"))
    few = members.where(F.col("n") <= p.hot_bucket).select("key", "rep")
    large_buckets = few.withColumnRenamed("rep", "a").join(few.withColumnRenamed("rep", "b"), "key").where("a < b").select("a", "b")
    pairs = small_buckets.unionByName(large_buckets).distinct()
    bits = lambda side: signed.select(F.col("rep").alias(side), F.col("sketch").alias(f"bits_{side}"))
    unequal = sum((F.bit_count(F.get("bits_a", F.lit(k)).bitwiseXOR(F.get("bits_b", F.lit(k)))) for k in range(p.sketch)), F.lit(0))
    likely = pairs.join(bits("a"), "a").join(bits("b"), "b").where(unequal <= p.most_unequal).select("a", "b")
    hot = members.where(F.col("n") > p.hot_bucket)
    candidates = likely.unionByName(_hot_pairs(hot, classes, p)).distinct()
    # sets no larger than the threshold allows the pair to differ; then the sets themselves
    left = classes.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = classes.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    sized = candidates.join(left, "a").join(right, "b").where(F.least(F.size("sa"), F.size("sb")) >= p.threshold * F.greatest(F.size("sa"), F.size("sb")))
    return sized.select("a", "b", "sa", "sb").mapInArrow(_exact(p), "a long, b long, similarity double")


def _spread(links: DataFrame, groups: DataFrame, p: NearDuplicates) -> DataFrame:
    """(a, b, similarity) of all members of linked groups: links (a, b, na, nb, similarity) name groups and their sizes, groups
    (grp, size, id) the members of groups of more than one; one of one is its own member. Large groups are salted."""
    salts = lambda n: F.ceil(F.col(n) / p.salted).cast("int")
    held = groups.select("grp", F.pmod(F.xxhash64("id"), salts("size")).cast("int").alias("salt"), "id")
    for side in ("a", "b"):
        salted = links.withColumn("salt", F.explode(F.sequence(F.lit(0), salts(f"n{side}") - 1)))
        met = salted.join(held.withColumnsRenamed({"grp": side, "id": "member"}), [side, "salt"], "left").where(F.col("member").isNotNull() | (F.col(f"n{side}") == 1))
        links = met.withColumn(side, F.coalesce("member", side)).drop("member", "salt")
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")


def near_duplicate_pairs(texts: DataFrame, id_column: str, text: str, p: NearDuplicates = NearDuplicates()) -> DataFrame:
    """(a, b, similarity), a < b, of texts at or above the threshold.

    All pairs of different texts are written out, be they of one class (equal shingle sets) or of two. Byte-equal copies of
    one text are written out in full while they stay under `expand_pairs` pairs; more of them are a star around the least id.
    Ids must be unique; null ids and texts give no row. Ties don't matter: all pairs at the threshold are in.
    """
    members, classes = shingle_classes(texts, id_column, text, p)
    members = cut(members)
    links = similar_classes(classes, p)
    copies = classes.select("rep", "copies")
    many = cut(members.join(copies.where("copies > 1"), "rep"))
    # the byte-equal copies of a class, named by their least id
    equal = many.groupBy("rep", "same").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size"))
    equal = cut(equal)
    copied = many.select("rep", "same", "id").join(equal.where("size > 1"), ["rep", "same"]).select(F.col("first").alias("grp"), "size", "id")
    copied = cut(copied)
    bounded = copied.where(F.col("size") * F.col("size") <= p.expand_pairs)
    within = bounded.select("grp", F.col("id").alias("a")).join(bounded.select("grp", F.col("id").alias("b")), "grp").where("a < b").select("a", "b", F.lit(1.0).alias("similarity"))
    star = copied.where((F.col("size") * F.col("size") > p.expand_pairs) & (F.col("id") != F.col("grp"))).select(F.col("grp").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    # different texts of a class: first the texts, each named by its first, then their copies
    several = equal.groupBy("rep").agg(F.count(F.lit(1)).alias("na")).where("na > 1")
    of_class = equal.join(several, "rep").select(F.col("rep").alias("grp"), F.col("na").alias("size"), F.col("first").alias("id"))
    own = several.select(F.col("rep").alias("a"), F.col("rep").alias("b"), "na", F.col("na").alias("nb"), F.lit(1.0).alias("similarity"))
    different = _spread(own, of_class, p).where("a < b").distinct()
    size = lambda side: equal.select(F.col("first").alias(side), F.col("size").alias(f"n{side}"))
    different = _spread(different.join(size("a"), "a").join(size("b"), "b"), copied, p)
    sized = links.join(copies.select(F.col("rep").alias("a"), F.col("copies").alias("na")), "a").join(copies.select(F.col("rep").alias("b"), F.col("copies").alias("nb")), "b")
    sized = cut(sized)
    single = F.col("na") * F.col("nb") == 1
    spread = _spread(sized.where(~single), many.select(F.col("rep").alias("grp"), F.col("copies").alias("size"), "id"), p)
    return sized.where(single).select("a", "b", "similarity").unionByName(spread).unionByName(different).unionByName(within).unionByName(star)


def near_duplicate_classes(texts: DataFrame, id_column: str, text: str, p: NearDuplicates = NearDuplicates()) -> DataFrame:
    """(a, b, copies_a, copies_b, similarity), a < b: similar pairs of different classes, named by their least ids, and how
    many texts each class has. With the class ids of near_duplicate_groups() this is the whole result in one form at any
    size: no group of copies is written out, and no link between different shingle sets is missing."""
    _, classes = shingle_classes(texts, id_column, text, p)
    links = similar_classes(classes, p)
    for side in ("a", "b"):
        links = links.join(classes.select(F.col("rep").alias(side), F.col("copies").alias(f"copies_{side}")), side)
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), *[F.when(F.col("a") < F.col("b"), x).otherwise(y).alias(n) for n, x, y in (("copies_a", F.col("copies_a"), F.col("copies_b")), ("copies_b", F.col("copies_b"), F.col("copies_a")))], "similarity")


def near_duplicate_groups(texts: DataFrame, id_column: str, text: str, p: NearDuplicates = NearDuplicates()) -> DataFrame:
    """(id, group_id, class_id, links) of every text with a near-duplicate or copy: group is the connected component, class
    the set of copies, both named by their least id; links is the number of other classes that are similar to its own."""
    members, classes = shingle_classes(texts, id_column, text, p)
    links = cut(similar_classes(classes, p))
    parts = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    degree = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    of_class = (
        classes.select("rep", "copies")
        .join(parts.select(F.col("node").alias("rep"), "component"), "rep", "left")
        .join(degree, "rep", "left")
        .where("copies > 1 or links > 0")
        .select("rep", F.coalesce("component", "rep").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
    )
    return members.join(of_class, "rep").select("id", "group_id", F.col("rep").alias("class_id"), "links")
