"""Sharding by fixed virtual slots, with DataFrame functions only.

A record's key is hashed into one of ``slots`` virtual slots, which never change. Which
shard holds a slot stands in a map, a table of one row a slot that is kept in versions
below a folder. Versions are written once and never altered: shards are added (``grown``)
and loads are evened out (``rebalanced``, by the bytes that ``slot_bytes`` sums up) by
publishing an edited map, and only the records of edited slots move. So the key and the
number of shards decide where a record is, until a rebalanced map says otherwise.

The numbers of a shard's records are given by a sort over ranges of (shard, slot, key,
...): a shard or a hot key is spread over as many tasks as its rows need, and a task
knows only how many rows of each shard come before it.

Odd rows: a null text counts as an empty one; a null key is hashed as an empty text, and
all such rows share one slot, as all rows of one key do. Rows that are equal in all
columns get numbers one after another. Columns other than the id and the text aren't
read, so their names can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from filelens.llm.common import materialize, new_path


@dataclass(frozen=True)
class ShardConfig:
    shards: int = 40
    slots: int = 8192
    row_bytes: int = 16  # a record's size beside its text
    tolerance_pct: int = 1  # a shard's bytes beyond the mean that a rebalance leaves alone


def slot_of(key: Column, slots: int) -> Column:
    """The virtual slot of a key: the first 32 bits of its text's md5, modulo the number of slots."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % slots).cast("int")


def first_map(spark: SparkSession, config: ShardConfig) -> DataFrame:
    """(slot, shard): slots are dealt in turn."""
    return spark.range(config.slots, numPartitions=1).select(F.col("id").cast("int").alias("slot"), (F.col("id") % config.shards).cast("int").alias("shard"))


def grown(slot_map: DataFrame, shards: int, slots: int) -> DataFrame:
    """The map for one shard more than ``shards``: the new one takes its even part of the slots, nothing else moves.

    Slots are taken one after another from the shard that has most, the first of those, each
    time its last slot. The map has a fixed number of rows, so its windows are one small task.
    """
    of_shard = Window.partitionBy("shard")
    left = F.count("*").over(of_shard) - F.row_number().over(of_shard.orderBy(F.desc("slot"))) + 1  # what the shard has when this slot's turn comes
    turn = F.row_number().over(Window.orderBy(F.desc("left"), "shard"))
    taken = turn <= slots // (shards + 1)
    return slot_map.withColumn("left", left).select("slot", F.when(taken, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


def slot_bytes(sizes: DataFrame) -> DataFrame:
    """(slot, bytes) of records (slot, size): summed where the rows are, then by slot."""
    return sizes.groupBy("slot").agg(F.sum("size").alias("bytes"))


def rebalanced(slot_map: DataFrame, loads: DataFrame, shards: int, config: ShardConfig) -> DataFrame:
    """The map with the shards' bytes evened out.

    A shard that has more than the mean and its tolerance keeps its slots, in order, up to the
    mean. The other slots of all such shards, in order of shard and slot, fill up the shards
    below the mean, in order: each goes where the bytes before it fall. No shard ends up beyond
    the mean by more than one slot and the tolerance. A row a slot, so one small task.
    """
    rows = slot_map.join(loads, "slot", "left").na.fill(0, ["bytes"])
    own = Window.partitionBy("shard")
    whole = Window.partitionBy()
    rows = rows.withColumns(
        {
            "of_shard": F.sum("bytes").over(own),
            "mean": F.expr(f"(sum(bytes) OVER ()) div {shards}"),
            "through": F.sum("bytes").over(own.orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)),
        }
    )
    over = F.col("of_shard") * 100 > F.col("mean") * (100 + config.tolerance_pct)
    rows = rows.withColumn("moves", over & (F.col("through") > F.col("mean")))
    in_order = Window.partitionBy("moves").orderBy("shard", "slot").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("bytes").over(in_order), F.lit(0)))
    every = slot_map.sparkSession.range(shards, numPartitions=1).select(F.col("id").cast("int").alias("room_of"))
    held = rows.filter("NOT moves").groupBy(F.col("shard").alias("room_of")).agg(F.sum("bytes").alias("held"))
    mean = rows.agg(F.coalesce(F.max("mean"), F.lit(0)).alias("to_have"))  # one row
    rooms = every.join(held, "room_of", "left").crossJoin(mean).withColumn("room", F.col("to_have") - F.coalesce("held", F.lit(0))).filter("room > 0")
    up_to = F.sum("room").over(Window.orderBy("room_of").rowsBetween(Window.unboundedPreceding, 0))
    rooms = rooms.withColumn("high", up_to).select("room_of", "high", (F.col("high") - F.col("room")).alias("low"), F.max("room_of").over(whole).alias("last_room"))
    # Beyond all rooms, by the remainder of the mean, the last room takes what is left.
    fits = (F.col("before") >= F.col("low")) & ((F.col("before") < F.col("high")) | (F.col("room_of") == F.col("last_room")))
    moved = rows.filter("moves").select("slot", "before").join(F.broadcast(rooms), fits)  # a row a shard at most
    moved = moved.groupBy("slot").agg(F.min("room_of").alias("to"))
    return rows.select("slot", "shard").join(moved, "slot", "left").select("slot", F.coalesce("to", "shard").cast("int").alias("shard"))


class SlotMaps:
    """The versions of one map below a folder: ``version=n`` is written once, by whoever publishes n first."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def publish(self, slot_map: DataFrame, version: int) -> DataFrame:
        """Write a version; an error if it is there already, so of two editors of one map one has to read again."""
        slot_map.coalesce(1).write.mode("error").parquet(f"{self.folder}/version={version}")
        return self.at(version)

    def at(self, version: int) -> DataFrame:
        return self.spark.read.schema("slot int, shard int").parquet(f"{self.folder}/version={version}")

    def versions(self) -> DataFrame:
        """(slot, shard, version) of all versions: what moved, and when."""
        return self.spark.read.schema("slot int, shard int, version int").parquet(self.folder)


def numbered(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``rows`` with ``number``: from 0 without gaps within each value of ``by``, in ``order``.

    Rows are sorted over ranges and written, a file a range; a row's number is its place in
    its file and the rows of its group in the files before. No group is one task's.
    """
    ranged = rows.withColumn("tie", F.monotonically_increasing_id())
    keys = [by, *order, "tie"]
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = new_path(spark, "numbered")
    ranged.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.parquet(path)
    read = spark.read.schema(ranged.schema).parquet(path).select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    # A file's parts of groups: some rows a file, two beside those of whole groups.
    parts = read.groupBy(by, "file").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.min("tie").alias("least"), F.min(F.struct(*keys)).alias("lowest"))
    before = F.sum("n").over(Window.partitionBy(by).orderBy("lowest").rowsBetween(Window.unboundedPreceding, -1))
    parts = materialize(parts.select(by, "file", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("add")), "number-parts")
    return read.join(parts, [by, "file"]).withColumn("number", F.col("place") + F.col("add")).drop("file", "place", "tie", "add")


def shard_documents(docs: DataFrame, config: ShardConfig = ShardConfig(), folder: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row, and virtual_slot and balanced_shard.

    ``slot`` is the row's number in its shard, ``virtual_slot`` the hash slot of its id. Three
    versions of the map are published below ``folder``: 1 for the shards there are, 2 with one
    more (grown_shard), and 3, version 1 rebalanced by the bytes of its slots (balanced_shard).
    """
    spark = docs.sparkSession
    text = F.coalesce(docs["text"], F.lit(""))
    doc_id = docs["doc_id"].cast("long")
    rows = docs.select(
        doc_id.alias("doc_id"), (F.octet_length(text) + config.row_bytes).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), slot_of(doc_id, config.slots).alias("virtual_slot")
    )
    rows = materialize(rows, "records")  # texts are read once
    maps = SlotMaps(spark, folder or new_path(spark, "slot-map"))
    now = maps.publish(first_map(spark, config), 1)
    more = maps.publish(grown(now, config.shards, config.slots), 2)
    loads = materialize(slot_bytes(rows.select(F.col("virtual_slot").alias("slot"), "size")), "slot-bytes")
    even = maps.publish(rebalanced(now, loads, config.shards, config), 3)
    # The maps side by side: a row a slot, a fixed number.
    places = now.join(more.withColumnRenamed("shard", "grown_shard"), "slot").join(even.withColumnRenamed("shard", "balanced_shard"), "slot")
    placed = rows.join(F.broadcast(places.withColumnRenamed("slot", "virtual_slot")), "virtual_slot")
    done = numbered(placed, "shard", ["virtual_slot", "doc_id", "text_crc32", "size"])
    return done.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("number").cast("long").alias("slot"), "grown_shard", "virtual_slot", "balanced_shard")
