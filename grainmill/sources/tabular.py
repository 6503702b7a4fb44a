"""Tables, lists, logs and configurations as sources; memberships and reports as sinks."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_columns(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """Only these columns are read from the files."""
    return spark.read.parquet(path).select(*columns)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A header and nothing but text: no pass over the data to guess types."""
    return spark.read.option("header", True).csv(path)


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """(sample_key): the distinct non-blank lines."""
    return spark.read.text(path).select(F.trim("value").alias("sample_key")).where("sample_key <> ''").distinct()


def read_splits(spark: SparkSession, files: Mapping[str, str], schema: str | None = None) -> dict[str, DataFrame]:
    """JSON lines, one table per split."""
    reader = spark.read.schema(schema) if schema else spark.read
    return {split: reader.json(path) for split, path in files.items()}


def read_prefixed(spark: SparkSession, path: str, prefix: str = "webdataset-", suffix: str = ".parquet") -> DataFrame:
    """The files of a cache folder whose names begin right; others are left alone."""
    return spark.read.option("pathGlobFilter", f"{prefix}*{suffix}").parquet(path)


def read_log(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(file, line, place, value): all numbers a pattern's first group finds, in order. A line's number is its offset rank
    within its file, found by a scan that keeps each file whole."""
    lines = spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    found = lines.select("file", F.posexplode(F.regexp_extract_all("value", F.lit(pattern), F.lit(1))).alias("place", "text"))
    return found.select("file", "place", F.col("text").try_cast("double").alias("value"))


def read_files(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, content) of binary files."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder).select("path", "content")


def rows(spark: SparkSession, values: Mapping[str, Sequence]) -> DataFrame:
    names = list(values)
    return spark.createDataFrame(list(zip(*values.values())), names)


def stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def parse_config(text: str) -> dict[str, object]:
    """`name: value` lines of an experiment, JSON objects, and nested YAML where its package is installed. Values of flat lines
    are numbers, booleans, null or text."""
    if text.lstrip().startswith("{"):
        return json.loads(text)
    if any(x[:1] in " \t-" and x.strip() and not x.startswith("---") for x in text.splitlines()):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("nested YAML needs the yaml package; JSON or flat lines don't") from e
        return yaml.safe_load(text)
    out: dict[str, object] = {}
    for line in text.splitlines():
        line = line.split(" #")[0].strip()
        if line and not line.startswith("#"):
            name, _, value = line.partition(":")
            value = value.strip()
            try:
                out[name.strip()] = {"true": True, "false": False, "null": None, "~": None, "": None}[value.lower()]
            except KeyError:
                try:
                    out[name.strip()] = json.loads(value)
                except ValueError:
                    out[name.strip()] = value.strip("'\"")
    return out


def write_ordered_lines(df: DataFrame, line: Column, path: str, *order: str) -> None:
    """Text in order over as many files as the rows need; their names sort as the lines do."""
    df.orderBy(*order).select(line.cast("string").alias("value")).write.mode("overwrite").text(path)


def write_membership(members: DataFrame, folder: str, config: Mapping[str, object]) -> None:
    """membership.parquet in order of key, shardlist, and config.json."""
    members.select("sample_key", "count").orderBy("sample_key").write.mode("overwrite").parquet(f"{folder}/membership.parquet")
    members.select("tar_path").distinct().orderBy("tar_path").write.mode("overwrite").text(f"{folder}/shardlist")
    write_report(config, f"{folder}/config.json", members.sparkSession)


def write_report(report: Mapping[str, object], path: str, spark: SparkSession) -> None:
    spark.createDataFrame([(json.dumps(report, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_cache(df: DataFrame, path: str, files: int, workers: int = 1, drop: Sequence[str] = ()) -> None:
    """So many files, rounded up to a multiple of the workers."""
    df.drop(*drop).repartition(-(-files // workers) * workers).write.mode("overwrite").parquet(path)


def write_csv_summary(df: DataFrame, group: str, value: str, path: str) -> None:
    summary = df.groupBy(group).agg(F.avg(value).alias(f"mean_{value}"), F.stddev_pop(value).alias(f"std_{value}"))
    summary.write.mode("overwrite").option("header", True).csv(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a stage's output is complete, so that a rerun may skip it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def quarantine(rows: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that are valid, and all others, those where it can't be told among them: nothing is drawn in their place."""
    told = F.coalesce(valid, F.lit(False))
    return rows.where(told), rows.where(~told)


def local_report(report: Mapping[str, object], path: str) -> None:
    Path(path).write_text(json.dumps(report, indent=1, sort_keys=True))
