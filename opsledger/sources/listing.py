"""Complete file listings: hidden, underscored and empty files too, which Spark's own file sources leave out."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "root string, path string, name string, length bigint, modified timestamp, is_dir boolean, error string"


class Branch(InputPartition):
    """A folder to list, with all below it or not."""

    def __init__(self, root: str, folder: str, deep: bool):
        self.root, self.folder, self.deep = root, folder, deep


class ListingReader(DataSourceReader):
    """One task for each sub-folder of a root, so that large trees are walked in parallel."""

    def __init__(self, options: dict):
        self.roots = [p for p in options["paths"].split("\n") if p] if "paths" in options else [options["path"]]
        self.deep = options.get("recursive", "true").lower() == "true"

    def partitions(self) -> list[InputPartition]:
        found: list[InputPartition] = []
        for root in self.roots:
            found.append(Branch(root, root, False))
            if self.deep:
                try:
                    found += [Branch(root, e.path, True) for e in os.scandir(root) if e.is_dir(follow_symlinks=False)]
                except OSError:  # the task that lists the root reports it
                    continue
        return found

    def read(self, partition: Branch) -> Iterator[tuple]:
        yield from _entries(partition.root, partition.folder, partition.deep)


def _entries(root: str, folder: str, deep: bool) -> Iterator[tuple]:
    try:
        with os.scandir(folder) as found:
            entries = sorted(found, key=lambda e: e.name)
    except OSError as e:
        yield root, folder, os.path.basename(folder), 0, None, True, str(e)
        return
    for e in entries:
        try:
            info = e.stat(follow_symlinks=False)
        except OSError as why:
            yield root, e.path, e.name, 0, None, False, str(why)
            continue
        is_dir = stat.S_ISDIR(info.st_mode)
        yield root, e.path, e.name, 0 if is_dir else info.st_size, datetime.fromtimestamp(info.st_mtime, timezone.utc), is_dir, None
        if deep and is_dir:
            yield from _entries(root, e.path, True)


class FileListing(DataSource):
    """Format file_listing: options path, or paths (one a line), and recursive (true). Errors are rows, not failures."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


def list_files(spark: SparkSession, *roots: str, recursive: bool = True) -> DataFrame:
    """Entries below roots that every executor sees; one level with recursive=False."""
    spark.dataSource.register(FileListing)
    return spark.read.format("file_listing").option("paths", "\n".join(roots)).option("recursive", str(recursive).lower()).load()


def copy_manifest(listing: DataFrame, target: str) -> DataFrame:
    """(path, target_path, length, is_dir, status): what copying a tree would do, each entry's failure kept apart."""
    below = F.expr("substring(path, length(root) + 1)")
    return listing.select("path", F.concat(F.lit(target.rstrip("/")), below).alias("target_path"), "length", "is_dir", F.when(F.col("error").isNull(), "planned").otherwise(F.concat(F.lit("unreadable: "), F.col("error"))).alias("status"))


def deletion_candidates(listing: DataFrame, keep: list[str]) -> DataFrame:
    """Entries whose names hold none of keep. Nothing is ever deleted here."""
    kept = F.lit(False)
    for word in keep:
        kept = kept | F.col("name").contains(word)
    return listing.where(~kept)
