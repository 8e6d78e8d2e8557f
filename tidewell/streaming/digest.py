"""The scheduled digest as a stream: each micro-batch is the current open set; what was added or removed since the last
delivered snapshot goes to the sink, and only then does the snapshot move on.

The first batch sets the baseline and sends nothing. A batch that fails leaves the snapshot where it was, so its changes are sent
with the next one; a batch that is replayed after its delivery finds its id in the log and does nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.diff import changes


class Digest:
    """State below one folder: versions of the snapshot (snapshot/v=<batch id>) and the change log (changes/batch=<batch id>)."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], send: Callable[[DataFrame, int], None]):
        self.spark, self.folder, self.keys, self.send = spark, folder, keys, send

    def _version(self) -> int | None:
        files = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/snapshot")
        fs = files.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(files):
            return None
        done = [s.getPath() for s in fs.listStatus(files) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max((int(p.getName().partition("=")[2]) for p in done), default=None)

    def snapshot(self) -> DataFrame | None:
        v = self._version()
        return None if v is None else self.spark.read.parquet(f"{self.folder}/snapshot/v={v}")

    def batch(self, current: DataFrame, batch_id: int) -> str:
        """foreachBatch body; says what it did."""
        last = self._version()
        if last is not None and batch_id <= last:
            return "Already Delivered"
        open_now = current.dropDuplicates(self.keys)
        if last is None:
            open_now.write.mode("overwrite").parquet(f"{self.folder}/snapshot/v={batch_id}")
            return "Baseline"
        found = changes(open_now, self.spark.read.parquet(f"{self.folder}/snapshot/v={last}"), self.keys).persist()
        try:
            if found.isEmpty():
                open_now.write.mode("overwrite").parquet(f"{self.folder}/snapshot/v={batch_id}")
                return "Skipped - No Changes"
            self.send(found, batch_id)  # raises if the delivery fails: nothing below runs
            found.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{self.folder}/changes/batch={batch_id}")
            open_now.write.mode("overwrite").parquet(f"{self.folder}/snapshot/v={batch_id}")
            return "Sent"
        finally:
            found.unpersist()

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        return stream.writeStream.foreachBatch(lambda df, i: self.batch(df, i)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def first_seen(events: DataFrame, key: str, ts: str, delay: str = "7 days") -> DataFrame:
    """Streaming or batch: the first time each key was seen, once a key within the watermark."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.groupBy(key).agg(F.min(ts).alias(ts))
