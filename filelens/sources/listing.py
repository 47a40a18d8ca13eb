"""File listings as a Spark data source.

``spark.read.format("file_listing").option("path", root)`` gives path, size and
mtime of every regular file, hidden and empty ones included. What can't be read is a
row with an error. A partition is a directory ``depth`` levels below the root with all
below it, or the own files of one above that.

The tree must be mounted at the same place on the driver and on every executor; a
task that doesn't find its directory fails.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from filelens.functions.paths import basename, dirname

LISTING = "path string, size bigint, mtime double, error string"


class FolderPart(InputPartition):
    def __init__(self, folder: str, deep: bool):
        self.folder, self.deep = folder, deep


class ListingReader(DataSourceReader):
    def __init__(self, root: str, depth: int):
        self.root, self.depth = root.rstrip("/") or "/", depth

    def partitions(self) -> list[FolderPart]:
        parts, level = [], [self.root]
        for _ in range(self.depth):
            below = []
            for folder in level:
                parts.append(FolderPart(folder, False))
                try:
                    with os.scandir(folder) as found:
                        below += sorted(e.path for e in found if e.is_dir(follow_symlinks=False))
                except PermissionError:
                    pass  # its own part tells
            level = below
        return parts + [FolderPart(p, True) for p in level]

    def read(self, partition: FolderPart) -> Iterator[tuple]:
        if not os.path.isdir(partition.folder):
            raise FileNotFoundError(f"{partition.folder} is not there on this machine")
        errors: list[OSError] = []
        for folder, below, names in os.walk(partition.folder, onerror=errors.append):
            if not partition.deep:
                below.clear()
            for name in names:
                path = os.path.join(folder, name)
                try:
                    info = os.lstat(path)
                except OSError as e:
                    yield path, None, None, f"{type(e).__name__}: {e}"[:200]
                    continue
                if stat.S_ISREG(info.st_mode):
                    yield path, info.st_size, info.st_mtime, None
        for e in errors:
            yield e.filename, None, None, f"{type(e).__name__}: {e}"[:200]


class FileListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"], int(self.options.get("depth", "1")))


def list_files(spark: SparkSession, root: str, depth: int = 1) -> DataFrame:
    spark.dataSource.register(FileListing)
    return spark.read.format("file_listing").option("path", root).option("depth", depth).load()


def outside(path: Column, excluded: list[str]) -> Column:
    """False for excluded folders and all below them."""
    keep = F.lit(True)
    for e in excluded:
        keep = keep & (path != e) & ~F.startswith(path, F.lit(e.rstrip("/") + "/"))
    return keep


def in_walk_order(files: DataFrame) -> DataFrame:
    """A directory's own files by name, then its sub-directories in order."""
    return files.orderBy(F.split(dirname(F.col("path")), "/"), basename(F.col("path")))


def beside(media: DataFrame, listing: DataFrame) -> DataFrame:
    """The sidecar next to each media file: the full form of its name before the short one."""
    forms = F.posexplode(F.array(F.concat("path", F.lit(".supplemental-metadata.json")), F.concat("path", F.lit(".json")))).alias("prio", "sidecar")
    found = media.select("path", forms).join(listing.select(F.col("path").alias("sidecar")), "sidecar")
    return found.groupBy("path").agg(F.min_by("sidecar", "prio").alias("sidecar"))
