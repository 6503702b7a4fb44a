"""What every operator needs from the session: tables, the shared folder, bounded broadcasts."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in estimated bytes, that is ever hinted as a broadcast.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder all executors see; a local one only where the session names none and runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if named is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="grainmill-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and forget the lineage, so a lost executor costs a read and not a recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def planned_bytes(df: DataFrame) -> int:
    """The optimizer's upper estimate of a plan's size; huge where it knows nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the optimizer bounds the size below the limit; otherwise leave the join to shuffle."""
    return F.broadcast(df) if planned_bytes(df) <= limit else df


def spread(scan: DataFrame) -> DataFrame:
    """A table whose files make fewer tasks than there are cores, dealt out to all of them; a larger one as it is.

    For plain scans ahead of costly Python work: of other plans the number of tasks isn't known before they run.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def listed(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Materialise a table that should be small, count it, and hint a broadcast if it is."""
    kept = cut(df)
    return F.broadcast(kept) if kept.count() <= rows else kept


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns and no others: extra input columns never reach an operator, whatever they are called."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
