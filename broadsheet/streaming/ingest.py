"""Structured Streaming forms: repeated items, editorial days, near times, and what readers viewed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from broadsheet.functions import constants as K
from broadsheet.operators.reader import remembered

#: How long a key is remembered after it was last kept.
KEY_LIFE = timedelta(days=90)


class FirstSeen(StatefulProcessor):
    """Keeps an item unless one of its keys is remembered. Each key is an entry of its own in the state store and expires by
    itself, so neither a source's state nor a batch's work grows with all that was ever seen."""

    def __init__(self, life: timedelta):
        self.life = life

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "key string", "kept boolean", ttlDurationMs=int(self.life.total_seconds() * 1000))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("item_ordinal")
        kept = []
        for keys in batch["keys"]:
            fresh = not any(self.seen.containsKey((k,)) for k in keys)
            if fresh:
                for k in keys:
                    self.seen.updateValue((k,), (True,))
            kept.append(fresh)
        yield pd.DataFrame({"source_id": batch["source_id"], "item_ordinal": batch["item_ordinal"], "kept": kept})

    def close(self) -> None:
        pass


def first_seen(items: DataFrame, life: timedelta = KEY_LIFE) -> DataFrame:
    """Items (source_id, item_ordinal, keys array<string>) with kept: greedy as in the batch form, over all batches so far.

    Items of one batch go in their order. Keys are forgotten after `life`. The session must use the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass).
    """
    schema = "source_id string, item_ordinal long, kept boolean"
    return items.groupBy("source_id").transformWithStateInPandas(FirstSeen(life), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime")


def day_counts(events: DataFrame, kind: str = "event_type", delay: str = "72 hours") -> DataFrame:
    """Events by the editorial day in India (midnight there is 18:30 UTC) and kind, with a watermark on ts."""
    day = F.window("ts", "1 day", "1 day", "18 hours 30 minutes")
    return events.withWatermark("ts", delay).groupBy(day, kind).agg(F.count("*").alias("n")).select(F.to_date(F.from_utc_timestamp(F.col("window.start"), K.EDITORIAL_ZONE)).alias("day"), kind, "n")


def near_in_time(items: DataFrame, others: DataFrame, hours: int = K.NEAR_HOURS) -> DataFrame:
    """Pairs of two streams (node, word, published_at) that share a word within the window; both are watermarked.

    Items without a time meet nothing here, as no watermark would ever let go of them; the batch form pairs them.
    """
    a = items.filter("published_at IS NOT NULL").withWatermark("published_at", f"{hours} hours").alias("a")
    b = others.filter("published_at IS NOT NULL").withWatermark("published_at", f"{hours} hours").alias("b")
    within = F.expr(f"a.word = b.word AND b.published_at BETWEEN a.published_at - INTERVAL {hours} HOURS AND a.published_at + INTERVAL {hours} HOURS")
    return a.join(b, within).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.word").alias("word"))


def stale_sources(items: DataFrame, hours: int = K.STALE_HOURS) -> DataFrame:
    """Items (source_id, published_at) -> source_id, last_at: sources that sent nothing for some hours of event time.

    A session ends when nothing came for so long, which the watermark tells without any later item of that source.
    """
    gap = F.session_window("published_at", f"{hours} hours")
    return items.withWatermark("published_at", "0 seconds").groupBy("source_id", gap).agg(F.max("published_at").alias("last_at")).select("source_id", "last_at")


def view_memory(folder: str, keep: int = K.KEPT_EDITIONS) -> Callable[[DataFrame, int], None]:
    """A merge for remember_views: the newest `keep` editions of each reader, as a table folder/<batch>.

    A batch reads the table of the one before and writes its own anew, so a batch that is run again changes nothing.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        views = batch.select("reader_id", "date", "story_id")
        if batch_id > 0:
            before = batch.sparkSession.read.parquet(f"{folder}/{batch_id - 1}")
            views = views.unionByName(before.select("reader_id", "date", F.explode("stories").alias("story_id")))
        remembered(views, keep=keep).write.mode("overwrite").parquet(f"{folder}/{batch_id}")

    return merge


def remember_views(views: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Views of readers, merged batch by batch into a table that merge keeps (adding a story twice changes nothing)."""
    return views.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append")
