"""Shared reading of the messages table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_messages(messages: DataFrame, *columns: str) -> DataFrame:
    """One row per message_id. Of several deliveries the first ingested one with content counts.

    Rows without message_id can't be told apart and are left out. The rest of the row travels with the delivery that was
    kept. min_by aggregates on the map side, so a message delivered a million times doesn't gather in one task.
    """
    keep = F.struct(F.col("content").isNull().alias("empty"), F.col("ingested_at").alias("at"), F.col("content").alias("text"))
    row = F.struct(*[F.col(c) for c in columns])
    return (
        messages.where(F.col("message_id").isNotNull())
        .select("message_id", keep.alias("_order"), row.alias("_row"))
        .groupBy("message_id")
        .agg(F.min_by("_row", "_order").alias("_row"))
        .select("message_id", *[F.col(f"_row.{c}").alias(c) for c in columns])
    )
