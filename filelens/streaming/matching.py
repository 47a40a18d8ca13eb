"""Matching of arriving entries by all tiers: directories are held until they are whole.

Which media file a sidecar names can hang on every other name of its directory (names that
fold alike, cut names that several files begin with), so entries of either kind are kept
as state by (archive, directory) and released together: when the directory's end marker comes,
or by a timer when none does. What is released is matched by the same operator as in a batch,
so both give the same results, in whatever order entries came.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from filelens.functions.paths import dirname
from filelens.operators import match
from filelens.storage import stored

RELEASED = "archive_id long, kind string, entry_path string, number long"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class HeldDirectory(StatefulProcessor):
    """Keeps the entries of one directory until its end marker or, that long after its first entries, its timer."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", "kind string, entry_path string, number long")

    def _release(self, key) -> Iterator[Row]:
        for kind, path, number in self.entries.get():
            yield Row(archive_id=key[0], kind=kind, entry_path=path, number=number)
        self.entries.clear()
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        first, ended, latest = not self.entries.exists(), False, 0
        for r in rows:
            ended = ended or r.kind == "end"
            latest = max(latest, int(r.at.timestamp() * 1000))
            if r.kind != "end":
                self.entries.appendValue((r.kind, r.entry_path, r.number))
        if ended:
            yield from self._release(key)
        elif first:
            self.handle.registerTimer(latest + self.wait_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from self._release(key)

    def close(self) -> None:
        pass


def released_directories(sidecars: DataFrame, media: DataFrame, ends: DataFrame, wait_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """archive_id, kind, entry_path, number of whole directories.

    Streams sidecars (archive_id, entry_path, seq, at), media (archive_id, entry_path, pos, at)
    and ends (archive_id, dir, at): a directory ends when its archive was listed. One
    without a marker is released ``wait_seconds`` of event time after its first entries; what
    comes later is a directory of its own.
    """
    sidecars.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    place = dirname(F.col("entry_path")).alias("dir")
    rows = sidecars.select("archive_id", place, F.lit("sidecar").alias("kind"), "entry_path", F.col("seq").alias("number"), "at")
    rows = rows.unionByName(media.select("archive_id", place, F.lit("media").alias("kind"), "entry_path", F.col("pos").alias("number"), "at"))
    rows = rows.unionByName(ends.select("archive_id", "dir", F.lit("end").alias("kind"), F.lit(None).cast("string").alias("entry_path"), F.lit(None).cast("long").alias("number"), "at"))
    grouped = rows.withWatermark("at", late).groupBy("archive_id", "dir")
    return grouped.transformWithState(HeldDirectory(wait_seconds * 1000), RELEASED, "Append", "EventTime")


def match_arrivals(released: DataFrame, on_matched: Callable[[DataFrame, int], None], checkpoint: str):
    """Match what ``released_directories`` releases; ``on_matched`` gets the rows of match_in_archives of each batch that has any."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = stored(rows, "released")  # the state moves on once a batch
        if rows.isEmpty():
            return
        side = rows.filter("kind = 'sidecar'").select(F.col("number").alias("seq"), "archive_id", "entry_path")
        media = rows.filter("kind = 'media'").select("archive_id", "entry_path", F.col("number").alias("pos"))
        on_matched(match.match_in_archives(side, media), number)

    return released.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
