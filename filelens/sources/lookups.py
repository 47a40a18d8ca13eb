"""Looking up catalog rows. Each is a filter that the Parquet scan can use; a list of keys is a semi-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_by_path(files: DataFrame, path: str) -> DataFrame:
    return files.filter(F.col("path") == path)


def files_by_size(files: DataFrame, size: int) -> DataFrame:
    return files.filter(F.col("size") == size)


def files_by_head(files: DataFrame, digest: str) -> DataFrame:
    return files.filter(F.col("digest_head") == digest)


def files_by_digest(files: DataFrame, digest: str) -> DataFrame:
    return files.filter(F.col("digest_full") == digest)


def archive_by_path(archives: DataFrame, path: str) -> DataFrame:
    return archives.filter(F.col("path") == path)


def all_by(files: DataFrame, wanted: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is among the wanted ones."""
    return files.join(wanted.select(column).distinct(), column, "left_semi")
