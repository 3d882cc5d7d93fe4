"""File events as a stream: the last event of each path, debounced, into jobs."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corvane.operators.lexical import PostingsIndex

RESCAN = r"^\.git/(HEAD$|index$|refs(/|$))"
STATE = r"^(\.git|\.venv|__pycache__)(/|$)"


def relevant(events: DataFrame) -> DataFrame:
    """Events (kind, path, ts), without those of state directories; a change of the checkout becomes `rescan` of the path ''."""
    again = F.rlike("path", F.lit(RESCAN))
    kept = events.filter(again | ~F.rlike("path", F.lit(STATE)))
    return kept.withColumn("kind", F.when(again, "rescan").otherwise(F.col("kind"))).withColumn("path", F.when(again, "").otherwise(F.col("path")))


def debounced(events: DataFrame, gap: str, lateness: str | None = None, key: str = "path") -> DataFrame:
    """(key, kind, n, started, quiet_at): the last event of each burst, once a path has been quiet for the gap.

    On a stream, `lateness` bounds the state: events later than that are dropped, and a burst is emitted when the watermark passes its end.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if lateness is not None:
        timed = timed.withWatermark("ts", lateness)
    bursts = timed.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.max_by("kind", "ts").alias("kind"), F.count(F.lit(1)).alias("n"))
    return bursts.select(key, "kind", "n", F.col("w.start").alias("started"), F.col("w.end").alias("quiet_at"))


def jobs(events: DataFrame) -> DataFrame:
    """(parse, remove, full): what a batch of debounced events asks for; a rescan supersedes the rest."""
    gone = F.col("kind").isin("deleted")
    moved = F.col("old_path").isNotNull() if "old_path" in events.columns else F.lit(False)
    found = events.agg(
        F.collect_set(F.when(~gone & (F.col("kind") != "rescan"), F.col("path"))).alias("parse"),
        F.array_union(F.collect_set(F.when(gone, F.col("path"))), F.collect_set(F.when(moved, F.col("old_path") if "old_path" in events.columns else F.lit(None).cast("string")))).alias("remove"),
        F.coalesce(F.bool_or(F.col("kind") == "rescan"), F.lit(False)).alias("full"),
    )
    return found.select(F.array_sort("parse").alias("parse"), F.array_sort(F.array_except("remove", "parse")).alias("remove"), "full")


def job_rows(events: DataFrame) -> DataFrame:
    """(path, action) of a batch of any size, one row a path: parse or remove; what `jobs` says, not gathered into one row."""
    gone = F.col("kind") == "deleted"
    own = events.filter("kind <> 'rescan'").select("path", F.when(gone, "remove").otherwise("parse").alias("action"))
    if "old_path" in events.columns:
        own = own.unionByName(events.filter("old_path is not null").select(F.col("old_path").alias("path"), F.lit("remove").alias("action")))
    # a path that is parsed isn't removed: "parse" comes first
    return own.groupBy("path").agg(F.min("action").alias("action"))


def maintain(stream: DataFrame, apply, checkpoint: str):
    """Runs `apply(batch, id)` over each micro-batch of what is there and ends; the caller's sink must take a batch again without harm."""
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(apply).start()


EVENT = "kind string, path string, old_path string, ts timestamp"


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """File events (created, modified, deleted, moved) as a stream of JSON lines that a watcher appends files of."""
    return spark.readStream.schema(EVENT).json(folder)


def apply_to_indexes(batch: DataFrame, contents: DataFrame, index: PostingsIndex, id: str = "path") -> None:
    """One micro-batch of debounced events (path, kind): the postings of deleted paths go, those of the others are made again from `contents`.

    Taking a batch again makes the same index, as a path's latest generation counts.
    """
    paths = batch.filter("kind <> 'rescan'").select("path", (F.col("kind") == "deleted").alias("gone")).distinct()
    changed = contents.join(paths.filter("not gone").select("path"), "path", "left_semi")
    removed = paths.join(contents.select("path"), "path", "left_anti").select(F.col("path").alias("id")).unionByName(paths.filter("gone").select(F.col("path").alias("id"))).distinct()
    index.update(changed, id, removed.join(changed.select(F.col("path").alias("id")), "id", "left_anti"))


class IndexJob:
    """One background run at a time of a stream into an index; it can be cancelled, and begins again from its checkpoint after a failure."""

    def __init__(self, start: Callable[[], StreamingQuery]) -> None:
        self.start, self.query = start, None

    def run(self) -> None:
        if self.query is None or not self.query.isActive:
            self.query = self.start()

    def wait(self, attempts: int = 2) -> None:
        """Until all that is there is done; a run that fails is begun again, as often as `attempts` allows."""
        for n in range(attempts):
            self.run()
            try:
                self.query.awaitTermination()
                return
            except StreamingQueryException:
                if n + 1 == attempts:
                    raise

    def cancel(self) -> None:
        """Any number of times, also when nothing runs."""
        if self.query is not None and self.query.isActive:
            self.query.stop()


def refresh_seconds(changes: Iterable[Callable[[], None]], refresh: Callable[[], object], fresh: Callable[[], object]) -> dict[str, float]:
    """Median and 95th percentile of the seconds that a refresh takes after each change; each must equal a fresh scan."""
    seconds = []
    for change in changes:
        change()
        began = time.perf_counter()
        got = refresh()
        seconds.append(time.perf_counter() - began)
        if got != fresh():
            raise AssertionError("a refresh differs from a fresh scan")
    p50, p95 = np.quantile(seconds, [0.5, 0.95])
    return {"n": len(seconds), "p50": float(p50), "p95": float(p95)}
