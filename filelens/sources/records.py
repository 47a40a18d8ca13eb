"""Records read from text: provenance CSV and sidecar JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filelens.functions.documents import parse_object, sidecar_payload

PROVENANCE = "path string, name string, container string, width string, height string, make string, model string, software string, exposure string, gps string"


def provenance_csv(spark: SparkSession, path: str) -> DataFrame:
    """Typed records; blanks are null, and gps is true for the text True alone."""
    rows = spark.read.schema(PROVENANCE).option("header", True).csv(path)
    return rows.withColumns({"width": F.col("width").try_cast("int"), "height": F.col("height").try_cast("int"), "exposure": F.col("exposure").try_cast("double"), "gps": F.coalesce(F.col("gps") == "True", F.lit(False))})


def sidecar_records(entries: DataFrame) -> DataFrame:
    """entries (..., content) with the payload; bytes that are no UTF-8 JSON object are ``unparseable``."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    rows = entries.withColumn("payload", sidecar_payload(text))
    bad = F.coalesce(parse_object(text).isNull(), F.lit(True))
    return rows.withColumn("reason", F.when(bad, "unparseable")).drop("content")
