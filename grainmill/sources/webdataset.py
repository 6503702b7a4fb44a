"""Tar shards as a Spark data source: one partition per shard, members read in one streaming pass."""

from __future__ import annotations

import os
import tarfile
import warnings
from collections.abc import Iterator, Sequence
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "tar_path string, member string, stem string, extension string, position long, payload binary"


class _Shard(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> Sequence[InputPartition]:
        return [_Shard(p) for p in discover(self.options.get("path"), self.options.get("list"), int(self.options.get("maxShards", 0)) or None)] or [_Shard("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        """Members in order. A broken archive gives what could be read before the break, and a warning."""
        if not partition.path:
            return
        payload = self.options.get("payload", "false").lower() == "true"
        wanted = {x for x in self.options.get("extensions", "").split(",") if x}
        try:
            with _open(partition.path) as file, tarfile.open(fileobj=file, mode="r|*") as tar:
                for position, member in enumerate(tar):
                    stem, extension = os.path.splitext(member.name)
                    extension = extension[1:]
                    if member.isfile() and (not wanted or extension in wanted):
                        data = tar.extractfile(member).read() if payload else None
                        yield partition.path, member.name, stem, extension, position, data
        except (tarfile.TarError, EOFError, OSError) as e:
            warnings.warn(f"{partition.path}: {e}", stacklevel=1)


class WebDataset(DataSource):
    """Options: path (a folder, searched in depth) or list (a file of paths); payload; extensions; maxShards."""

    @classmethod
    def name(cls) -> str:
        return "webdataset"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def discover(folder: str | None = None, listed: str | None = None, most: int | None = None) -> list[str]:
    """Sorted tars below a folder, or the non-blank lines of a list file."""
    if listed:
        with _open(listed) as f:
            found = [x.strip() for x in f.read().decode().splitlines() if x.strip()]
    elif "://" in folder:
        files, root = fs.FileSystem.from_uri(folder)
        scheme = folder.split("://")[0] + "://"
        host = "" if scheme == "file://" else folder[len(scheme) :].split("/")[0] if root.startswith("/") else ""
        found = sorted(f"{scheme}{host}{x.path}" for x in files.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and x.path.endswith(".tar"))
    else:
        found = sorted(str(p) for p in Path(folder).rglob("*.tar"))
    return found[:most]


def _open(path: str):
    """A shard or list for reading, on the machine or on any file system Arrow knows by its scheme (hdfs, s3, gs, file)."""
    if "://" not in path:
        return open(path, "rb")
    files, name = fs.FileSystem.from_uri(path)
    return files.open_input_stream(name)


def members(spark: SparkSession, folder: str | None = None, **options: str) -> DataFrame:
    spark.dataSource.register(WebDataset)
    reader = spark.read.format("webdataset").options(**options)
    return reader.load(folder) if folder else reader.load()


def sample_keys(rows: DataFrame, strip_folders: bool = False) -> DataFrame:
    """(sample_key, tar_path), once per sample and shard; folders stay in the key unless stripped."""
    key = F.regexp_replace("stem", r"^.*/", "") if strip_folders else F.col("stem")
    return rows.select(key.alias("sample_key"), "tar_path").distinct()


def samples(rows: DataFrame) -> DataFrame:
    """(__key__, __url__, image, txt, json) of members read with payload; image is jpg, or png where there is no jpg."""
    one = lambda e: F.first(F.when(F.col("extension") == e, F.col("payload")), ignorenulls=True)
    grouped = rows.groupBy(F.col("stem").alias("__key__"), F.col("tar_path").alias("__url__")).agg(
        one("jpg").alias("jpg"), one("png").alias("png"), F.decode(one("txt"), "UTF-8").alias("txt"), F.decode(one("json"), "UTF-8").alias("json")
    )
    return grouped.select("__key__", "__url__", F.coalesce("jpg", "png").alias("image"), "txt", "json")


def sidecars(rows: DataFrame, key: str = "tagging_caption") -> DataFrame:
    """(sample_key, caption) of json members: key without folders, broken JSON skipped, a null or absent caption empty."""
    text = F.decode("payload", "UTF-8")
    fields = F.from_json(text, "map<string,string>")
    name = F.regexp_replace("stem", r"^.*/", "")
    return rows.where("extension = 'json'").select(name.alias("sample_key"), fields.alias("f")).where("f is not null").select("sample_key", F.coalesce(F.col("f")[key], F.lit("")).alias("caption"))
