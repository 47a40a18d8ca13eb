"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and all tasks run on this machine."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _own:
        _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="spark-filelens-", dir="/tmp")
    return _own[context.applicationId]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: ``df`` as a table written once and read again.

    A lost executor then costs the tasks it ran, not what led to this table, and the
    planner knows the table's true size.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def put_text(spark: SparkSession, path: str, text: str, overwrite: bool = False) -> bool:
    """Write a small file where the cluster keeps its tables; False if it was there and isn't to be overwritten.

    The file is created by its name, so of several writers of one name one succeeds.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        out = store.create(place, overwrite)
    except Py4JJavaError as e:
        if store.exists(place):
            return False
        raise e
    out.write(bytearray(text.encode()))
    out.close()
    return True


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
