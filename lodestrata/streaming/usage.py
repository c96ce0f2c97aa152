"""Streams: folder ingestion without repeats, usage by month, and the request limit as a stateful operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from ..session import ship
from ..sources.documents import routed, text_pages

FILES = "path string, modificationTime timestamp, length long, content binary"
#: The store that keeps state by key with expiry and timers.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def once(stream: DataFrame, remember: str = "365 days") -> DataFrame:
    """A stream of files without those whose content came before: the state is the hashes of what has come, each for ``remember`` after it came; the store is never read.

    Files count by when they are seen, not by their own times, so that an old file is not late.
    """
    return routed(stream).withColumn("seen_at", F.current_timestamp()).withWatermark("seen_at", remember).dropDuplicatesWithinWatermark(["file_hash"])


def watch(spark: SparkSession, folder: str, store: str, checkpoint: str, seconds: int | None = None, remember: str = "365 days"):
    """New files of a folder are read as text pages and appended to the store, each content once. Without ``seconds`` it stops when it has caught up.

    A repeated run goes on from the checkpoint: files, hashes and written parts are all in it, so a lost executor or driver repeats nothing.
    """
    stream = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").load(folder)
    pages = text_pages(once(stream.filter(F.lower("path").rlike(r"\.(?:md|txt|csv|tsv|rtf)$")), remember))
    writer = pages.writeStream.format("parquet").outputMode("append").option("path", store).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def monthly(events: DataFrame, lateness: str = "7 days") -> DataFrame:
    """Usage by organisation and day with a watermark; months are sums of days in the batch view."""
    return events.withWatermark("created_at", lateness).groupBy("org_id", F.window("created_at", "1 day").alias("w")).agg(F.count("*").alias("actions"), F.sum("page_count").alias("pages")).select("org_id", F.col("w.start").alias("day"), "actions", "pages")


class RateLimit(StatefulProcessor):
    """Requests of an organisation: the state is when those of the last window were let through, ``most`` times at most; a timer clears it once all of them are over."""

    def __init__(self, seconds: int, most: int):
        self.seconds, self.most = seconds, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", "times array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        recent = list(self.recent.get()[0]) if self.recent.exists() else []
        batch = pd.concat([r[["event_id", "created_at"]] for r in rows]).sort_values(["created_at", "event_id"])
        allowed = []
        for at in batch["created_at"]:
            now = at.timestamp()
            recent = [x for x in recent if x > now - self.seconds]
            allowed.append(len(recent) < self.most)
            if allowed[-1]:
                recent.append(now)
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        if recent:
            self.recent.update((recent,))
            self.handle.registerTimer(int((recent[-1] + self.seconds) * 1000))
        else:
            self.recent.clear()
        yield pd.DataFrame({"org_id": key[0], "event_id": batch["event_id"].to_numpy(), "allowed": allowed})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.recent.clear()
        return iter([])

    def close(self) -> None:
        pass


def limited(events: DataFrame, seconds: int = 60, most: int = 30, lateness: str = "10 minutes") -> DataFrame:
    """Whether each request is let through; refused ones don't count. Requests later than ``lateness`` are dropped; an organisation that is silent for a window after it holds no state."""
    spark = events.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = events.select("org_id", "event_id", "created_at").withWatermark("created_at", lateness)
    return rows.groupBy("org_id").transformWithStateInPandas(RateLimit(seconds, most), outputStructType="org_id long, event_id long, allowed boolean", outputMode="append", timeMode="EventTime")
