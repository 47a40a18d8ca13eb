"""SQL functions for sessions that query the catalog in SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from filelens.functions.paths import VOLUME_PATTERN


def register(spark: SparkSession) -> None:
    """volume_root(path), file_suffix(name) and is_legal_offset(seconds), inlined by the optimizer."""
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION volume_root(path STRING) RETURNS STRING RETURN nullif(regexp_extract(path, r'{VOLUME_PATTERN}', 1), '')")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION file_suffix(name STRING) RETURNS STRING RETURN regexp_extract(name, r'^.+(\.[^.]+)$', 1)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION is_legal_offset(s DOUBLE) RETURNS BOOLEAN RETURN abs(s) <= 50400 AND abs(s - bround(s / 900) * 900) <= 60")
