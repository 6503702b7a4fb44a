"""Keyword-stuffed and link-list pages, by the mean pointwise mutual information of neighbouring words.

Counts are of documents, each neighbouring pair once per distinct text, and a page is judged without its own share of them,
so it can't vouch for its own repetitions, and copies of a page count once. They are kept in a count-min sketch whose size
follows the corpus up to a bound; what an average cell holds of other pairs is taken off and smoothed over.

A pair scores the logarithm of how often it occurs against how often its words would meet by chance, both smoothed by one
text; a pair no other text has is worth the corpus' own share of such pairs (Good and Turing), so that small corpora, where
much is new, don't count it against a page. A few texts that share a pair are enough, whatever share of the corpus they are.
Pairs a page repeats far beyond the corpus' rate score the floor; the words of an address count as one word,
so that a list of links is a repeated pair. Sentences score well above nought; word salad, tag lists
and link lists don't. A word stands in spam if the mean around it is below the corpus' typical text by `below`, and a page is
spam if more than half of its words do.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..context import cut
from .words import words

_FORMAT = regex.compile(r"\p{Cf}+")
_U = np.uint64


@dataclass(frozen=True)
class Salad:
    #: Cells of a row of the sketch of pairs, as a power of two: as many as the pairs expected, within these bounds. The
    #: sketches of left and right words have an eighth.
    least_bits: int = 16
    most_bits: int = 22
    rows: int = 2
    floor: float = -4.0
    ceiling: float = 3.0
    #: A pair is excessive from so many times in a text, if that is also this share of its pairs, and this many times what
    #: the corpus' rate of the pair makes expected.
    excessive: int = 4
    excessive_share: float = 0.03
    excessive_times: float = 8.0
    #: Pairs on both sides of a word whose mean decides.
    reach: int = 30
    #: Pairs' worth of the typical score that every mean starts with: a short text gives little evidence.
    prior: float = 5.0
    #: How far below the typical text's score spam begins. Chosen on the 10,000 documents of the test table at 0.1, of which 427 score so.
    below: float = 1.25
    least_words: int = 8
    #: Broadcast a list of copies up to so many ids, else shuffle.
    broadcast_ids: int = 1_000_000


#: Attributes whose values are words of a page, as addresses and hidden keywords are; formatting isn't.
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_SAYS = re.compile(r"(?i)\b(?:href|src|content|alt|title)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")


def _said(tag: re.Match) -> str:
    return f" {' '.join(_SAYS.findall(tag.group()))} " if "=" in tag.group() else ""


def clean(text: str) -> str:
    """Tags replaced by what they say, character references resolved, compatibility forms unified, invisible characters
    dropped. Formatting within a sentence would else part words that belong together."""
    if "<" in text:
        text = _TAG.sub(_said, text)
    if "&" in text:
        text = html.unescape(text)
    return text if text.isascii() else _FORMAT.sub("", unicodedata.normalize("NFKC", text))


#: An address: with a scheme, or a host and a path.
_LINK = re.compile(r"(?:https?://|www\.)[^\s\"'<>()\[\]]+|\b[\w-]+(?:\.[\w-]+)+/[^\s\"'<>()\[\]]*")


def _link(found: re.Match) -> str:
    return " linkpart" * len(words(found.group())) + " "


def tokens(text: str) -> list[str]:
    """The words of a page. Those of an address are as many of one word: hosts and paths follow no language, and what a list
    of links repeats is addresses."""
    text = clean(text)
    return words(_LINK.sub(_link, text) if "/" in text or "www." in text else text)


class _Codes:
    """64-bit codes of words, remembered up to a bound."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, tokens: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > 500_000:
            known.clear()
        for w in set(tokens).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


def _pairs(codes: np.ndarray) -> np.ndarray:
    x = (codes[:-1] * _U(0x9E3779B97F4A7C15)) ^ (codes[1:] + _U(0x7F4A7C159E3779B9))
    x *= _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _cells(x: np.ndarray, row: int, bits: int) -> np.ndarray:
    a = (0x9E3779B97F4A7C15 * (2 * row + 3) * 0x2545F4914F6CDD1D) % (1 << 64) | 1
    return ((x * _U(a)) >> _U(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Layout:
    """Rows of the sketch as (kind, row, bits): pairs, left words, right words."""

    rows: tuple[tuple[int, int, int], ...]

    @staticmethod
    def of(p: Salad, pairs: float) -> Layout:
        bits = min(p.most_bits, max(p.least_bits, int(np.ceil(np.log2(max(pairs, 1))))))
        return Layout(tuple((kind, row, bits if kind == 0 else bits - 3) for kind in range(3) for row in range(p.rows)))


#: Cells of a row that travel together.
SLICE = 1 << 18
#: Tables that one task adds up.
MERGED = 64


def _packed(cells: np.ndarray) -> bytes:
    """Counts in the least type that holds them, compressed; its first byte names the type."""
    top = int(cells.max()) if len(cells) else 0
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + zlib.compress(cells.astype(kind).tobytes(), 1)


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b[1:]), np.dtype(f"u{b[0]}")).astype(np.uint64)


def _sketch(p: Salad, layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [np.zeros(1 << bits, np.uint32) for _, _, bits in layout.rows]
        texts, pairs_seen, places, code = 0, 0, 0, _Codes()

        def add(parts: list[list[np.ndarray]]) -> None:
            if parts[0]:
                joined = [np.concatenate(x) for x in parts]
                for cells, (kind, row, bits) in zip(rows, layout.rows):
                    cells += np.bincount(_cells(joined[kind], row, bits), minlength=1 << bits).astype(np.uint32)

        for batch in batches:
            parts: list[list[np.ndarray]] = [[], [], []]
            held = 0
            for text in batch.column(0).to_pylist():
                w = tokens(text)
                texts += 1
                if len(w) < 2:
                    continue
                codes = code(w)
                pairs, first = np.unique(_pairs(codes), return_index=True)
                for x, y in zip(parts, (pairs, codes[first], codes[first + 1])):
                    x.append(y)
                held += len(pairs)
                pairs_seen += len(pairs)
                places += len(w) - 1
                if held > 2_000_000:
                    add(parts)
                    parts, held = [[], [], []], 0
            add(parts)
        if texts:
            yield _rows([(-1, 0, _packed(np.array([texts, pairs_seen, places], np.uint64)))])
            for k, cells in enumerate(rows):
                for at in range(0, len(cells), SLICE):
                    if cells[at : at + SLICE].any():
                        yield _rows([(k, at, _packed(cells[at : at + SLICE]))])

    return run


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    part, at, cells = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(at, pa.int64()), pa.array(cells, pa.binary())], names=["part", "at", "cells"])


def _add(table: pa.Table) -> pa.Table:
    total: np.ndarray | None = None
    for b in table.column("cells"):
        x = _unpacked(b.as_py())
        total = x if total is None else total + x
    return pa.Table.from_batches([_rows([(table.column("part")[0].as_py(), table.column("at")[0].as_py(), _packed(total))])])


def pair_statistics(texts: DataFrame, text: str, layout: Layout, p: Salad = Salad()) -> dict[int, np.ndarray]:
    """The sketch over all rows. A task sends its table in slices; MERGED tables at a time are added up, in as many levels as
    the number of tasks needs, and what reaches the driver is the one table of bounded size."""
    parts = texts.where(F.col(text).isNotNull()).select(text).mapInArrow(_sketch(p, layout), "part int, at long, cells binary")
    parts = cut(parts.withColumn("task", F.spark_partition_id()))
    tasks = 1 + (parts.agg(F.max("task")).first()[0] or 0)
    while True:
        tasks = -(-tasks // MERGED)
        grouped = parts.withColumn("task", F.pmod("task", F.lit(tasks))).groupBy("part", "at", "task")
        if tasks == 1:
            break
        added = grouped.applyInArrow(lambda key, t: _add(t).append_column("task", pa.array([key[2].as_py()], pa.int32())), "part int, at long, cells binary, task int")
        parts = cut(added)
    sketch = {k: np.zeros(1 << bits, np.float32) for k, (_, _, bits) in enumerate(layout.rows)} | {-1: np.zeros(3)}
    for r in grouped.applyInArrow(_add, "part int, at long, cells binary").toLocalIterator():
        x = _unpacked(r.cells)
        sketch[r.part][r["at"] : r["at"] + len(x)] = x
    return sketch


def _judge(p: Salad, layout: Layout, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, code = model.value, _Codes()
        total = float(sketch[-1][1])
        noise = total / (1 << layout.rows[0][2])
        # how often a text repeats a pair on average
        repeats = float(sketch[-1][2]) / total if total else 1.0
        # the share of pairs that no other text has, as far as the sketch tells
        new = sketch[0][sketch[0] <= noise + 1.5].sum(dtype=np.float64) / total if total else 1.0
        smooth = 1 + 2 * noise**0.5

        def count(x: np.ndarray, kind: int) -> np.ndarray:
            """Other texts that have it: the least cell, less what an average cell holds of other entries, less this text."""
            rows = [sketch[k][_cells(x, row, bits)] - total / (1 << bits) for k, (of, row, bits) in enumerate(layout.rows) if of == kind]
            return np.maximum(np.minimum.reduce(rows) - 1, 0.0)

        for batch in batches:
            ids, out = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = tokens(text)
                n = len(w)
                ids.append(i)
                if n < max(2, p.least_words) or not total:
                    out.append((n, None, None, None, None))
                    continue
                codes = code(w)
                pairs = _pairs(codes)
                _, place, own = np.unique(pairs, return_inverse=True, return_counts=True)
                seen = count(pairs, 0)
                chance = count(codes[:-1], 1) * count(codes[1:], 2) / total
                value = np.clip(np.log((seen + smooth * new) / (chance + smooth)), p.floor, p.ceiling)
                many = own[place]
                stuffed = (many >= max(p.excessive, p.excessive_share * (n - 1))) & (many > p.excessive_times * (n - 1) * seen / total * repeats)
                value[stuffed] = p.floor
                sums = np.concatenate([[0.0], np.cumsum(value)])
                k = np.arange(n)
                lo = np.maximum(0, np.minimum(k - p.reach, n - 1 - 2 * p.reach))
                hi = np.minimum(n - 1, np.maximum(k + p.reach, 2 * p.reach))
                # half of the words are around means of at most this; all windows of a text are of one size
                out.append((n, float(value.mean()), float(stuffed.mean()), float(np.median((sums[hi] - sums[lo]) / (hi - lo))), int(hi[0] - lo[0])))
            kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *[pa.array([x[k] for x in out], t) for k, t in enumerate(kinds)]],
                names=["id", "n_words", "mean_pmi", "repeated_share", "middle_pmi", "window"],
            )

    return run


def first_of_copies(documents: DataFrame, id_column: str, text: str, p: Salad) -> DataFrame:
    """All rows but those whose letters, in lower case, an earlier id has too: pages that differ in numbers, punctuation and
    case count once. Only hashes are shuffled, and the list of copies is broadcast below a checked length."""
    rows = documents.where(F.col(text).isNotNull() & F.col(id_column).isNotNull())
    letters = F.lower(F.regexp_replace(text, r"[^\p{L}]+", " "))
    hashed = rows.select(F.col(id_column).alias("id"), F.xxhash64(letters).alias("h"), F.length(letters).alias("n"))
    groups = hashed.groupBy("h", "n").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1")
    copies = cut(hashed.join(groups, ["h", "n"]).where("id > first").select(F.col("id").alias(id_column)))
    return rows.join(F.broadcast(copies) if copies.count() <= p.broadcast_ids else copies, id_column, "left_anti")


def typical(scores: DataFrame) -> float:
    """The median of middle_pmi over distinct texts, to a hundredth: counted in bins, whose number is fixed by the score's
    bounds. Texts of equal scores and length are taken for copies."""
    once = scores.where("middle_pmi is not null").select("n_words", "mean_pmi", "middle_pmi").distinct()
    bins = once.groupBy(F.round("middle_pmi", 2).alias("b")).agg(F.count(F.lit(1)).alias("c")).orderBy("b").collect()
    half, before = sum(r.c for r in bins) / 2, 0
    for r in bins:
        before += r.c
        if before >= half:
            return float(r.b)
    return 0.0


def spam_scores(documents: DataFrame, id_column: str, text: str, p: Salad = Salad()) -> DataFrame:
    """(id, n_words, mean_pmi, repeated_share, middle_pmi, below_typical, spam) of every row with an id and a text.

    mean_pmi: over the text's pairs; middle_pmi: the median over its words of the mean around each; below_typical: how far
    that is, drawn to the typical score by `prior`, below the median of all distinct texts; spam: whether farther than
    `below`. Most distinct texts of the corpus must be sentences. Texts below `least_words` words, empty ones too, have
    null scores and aren't spam. Null texts give no row.
    """
    rows = documents.where(F.col(text).isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    # a word and the space after it take some six characters
    layout = Layout.of(p, (rows.agg(F.sum(F.length("text"))).first()[0] or 0) / 6)
    statistics = pair_statistics(first_of_copies(rows, "id", "text", p), "text", layout, p)
    model = documents.sparkSession.sparkContext.broadcast(statistics)
    scored = cut(rows.mapInArrow(_judge(p, layout, model), "id long, n_words long, mean_pmi double, repeated_share double, middle_pmi double, window long"))
    level = typical(scored)
    below = (F.lit(level) - F.col("middle_pmi")) * F.col("window") / (F.col("window") + p.prior)
    return scored.withColumn("below_typical", below).withColumn("spam", F.coalesce(F.col("below_typical") > p.below, F.lit(False))).drop("window")
