"""Frequency of every distinct term, by last-seen counters."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import words

#: A task's counters go downstream when it holds this many terms, which bounds its memory at any vocabulary.
MAX_COUNTERS = 400_000


class LastSeenCounters:
    """Per term: occurrences, records, and the last record it was seen in. No set of records is kept.

    Records must come one after another, which they do in any scan; a record's number is compared with the last one seen.
    """

    def __init__(self) -> None:
        self.of: dict[str, list[int]] = {}

    def see(self, record: int, terms: list[str]) -> None:
        of = self.of
        for term in terms:
            c = of.get(term)
            if c is None:
                of[term] = [1, 1, record]
            else:
                c[0] += 1
                if c[2] != record:
                    c[1] += 1
                    c[2] = record

    def flush(self) -> pa.RecordBatch:
        terms, counts = list(self.of), list(self.of.values())
        self.of = {}
        return pa.RecordBatch.from_arrays(
            [pa.array(terms, pa.string()), *[pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]],
            names=["term", "occurrences", "records", "last_record"],
        )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counters = LastSeenCounters()
    for batch in batches:
        for record, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counters.see(record, words(text))
            if len(counters.of) >= MAX_COUNTERS:
                yield counters.flush()  # between two records, so that no record is counted twice
    if counters.of:
        yield counters.flush()


def term_frequency(records: DataFrame, record: str, text: str) -> DataFrame:
    """(term, occurrences, records, last_record) of every word of `text`, over all rows.

    `record` must be unique: then each record is counted in one task, partial counts of a term have no record in common,
    and they can simply be added. A term that is in every record reaches the shuffle once per task and not once per record.
    Null and empty texts have no terms; an empty table gives no rows; other columns are ignored.
    """
    parts = records.where(F.col(text).isNotNull()).select(F.col(record).cast("long"), F.col(text)).mapInArrow(
        _count, "term string, occurrences long, records long, last_record long"
    )
    return parts.groupBy("term").agg(
        F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"), F.max("last_record").alias("last_record")
    )


def mark_terms(frequency: DataFrame, records: DataFrame, rare_below: int = 3, common_share: float = 0.05) -> DataFrame:
    """Adds `mark`: rare below so many records, common above that share of all records, else null.

    `records` is whatever table has one row per record, also those without text: they count in the total. A term that is
    both (in a tiny collection) is called rare.
    """
    total = records.agg(F.count(F.lit(1)).alias("total")).scalar()
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > common_share * total, "common")
    return frequency.withColumn("mark", mark)
