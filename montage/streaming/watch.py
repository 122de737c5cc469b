"""Streams: files that arrive in a folder, their ledger, delivery after each batch, and the rate limit as keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..params import DEFAULTS

SUFFIXES = ("wav", "mp3", "m4a", "flac", "ogg", "aac", "opus")


def watch_folder(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = SUFFIXES, prefix: str = "", archive: str | None = None) -> DataFrame:
    """New files of a folder: path, name, bytes, modified. The backlog comes first; a file counts once by its base name.

    The source expects files to be moved into place; stable() below is for writers that do not.
    """
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    reader = reader.option("pathGlobFilter", f"{prefix}*.{{{','.join(suffixes)}}}").option("fileNameOnly", "true").option("maxFilesPerTrigger", 1000)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    files = reader.load(folder)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def first_arrivals(files: DataFrame) -> DataFrame:
    """Files once by name without regard to case, over the life of the stream's checkpoint; empty files are left out."""
    return files.where("bytes > 0").withColumn("key", F.lower("name")).dropDuplicates(["key"])


def _since(seen: Column, size: Column) -> Column:
    """The first of a file's polls (seen_at, bytes) after the last with another size. That time is bound once, by an array of one: named in a lambda, it would be worked out anew for each poll."""
    changed = F.array_max(F.transform(F.filter(seen, lambda s: s["bytes"] != size), lambda s: s["seen_at"]))
    first = lambda c: F.array_min(F.transform(F.filter(seen, lambda s: c.isNull() | (s["seen_at"] > c)), lambda s: s["seen_at"]))
    return F.element_at(F.transform(F.array(changed), first), 1)


def stable(observations: DataFrame, quiet_s: float = 3.0) -> DataFrame:
    """path, bytes, seen_at (a poll's observations) -> files whose size has stayed the same, and not zero, for quiet_s.

    In a batch each size's last poll tells a file's size and when it last had another; a join finds the first poll after that, and no list of polls is made.
    A stream in update mode cannot aggregate twice or join what it has aggregated: there one grouped aggregate keeps a file's polls.
    """
    quiet = lambda before: F.unix_millis(F.col("seen_at").cast("timestamp")) - F.unix_millis(F.col(before).cast("timestamp")) >= quiet_s * 1000
    polls = observations.where("path IS NOT NULL").select("path", "bytes", "seen_at")
    if observations.isStreaming:
        size = F.max_by("bytes", F.when(F.col("bytes").isNotNull(), F.col("seen_at")))
        kept = polls.groupBy("path").agg(size.alias("bytes"), F.max("seen_at").alias("seen_at"), F.collect_set(F.struct("seen_at", "bytes")).alias("seen"))
        return kept.withColumn("since", _since(F.col("seen"), F.col("bytes"))).where((F.col("bytes") > 0) & quiet("since")).select("path", "bytes", "since")
    sizes = polls.groupBy("path", "bytes").agg(F.max("seen_at").alias("last"))
    files = sizes.groupBy("path").agg(F.max(F.when(F.col("bytes").isNotNull(), F.struct("last", "bytes")))["bytes"].alias("size"), F.max("last").alias("seen_at")).where("size > 0")
    changed = F.max(F.when(F.col("bytes") != F.col("size"), F.col("last"))).alias("changed")
    files = files.join(sizes, "path").groupBy("path", "size", "seen_at").agg(changed).where(F.col("changed").isNull() | quiet("changed"))
    after = polls.select("path", F.col("seen_at").alias("at")).join(files, "path").where("changed IS NULL OR at > changed")
    return after.groupBy("path", F.col("size").alias("bytes"), "seen_at").agg(F.min("at").alias("since")).where(quiet("since")).select("path", "bytes", "since")


def deliver(stream: DataFrame, checkpoint: str, action: Callable[[DataFrame, int], None], seconds: int | None = None) -> StreamingQuery:
    """Runs action on each batch; it must be idempotent, as a batch may be run again after a failure."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(action)
    return (writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")).start()


def limit_hosts(requests: DataFrame) -> DataFrame:
    """host, at_ms, refused -> host, at_ms, wait_ms as a stream: a host's next allowed time and penalty are its state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        allowed, factor = state.get if state.exists else (0, 1.0)
        for batch in batches:
            waits = []
            for at, refused in batch.sort_values("at_ms")[["at_ms", "refused"]].itertuples(index=False):
                waits.append((key[0], at, max(0, allowed - at)))
                allowed = max(at, allowed) + int(1000 * DEFAULTS.host_delay_s * factor)
                factor = min(DEFAULTS.host_penalty_cap, factor * 2) if refused else factor
            yield pd.DataFrame(waits, columns=["host", "at_ms", "wait_ms"])
        state.update((allowed, factor))

    return requests.groupBy("host").applyInPandasWithState(run, "host string, at_ms long, wait_ms long", "allowed long, factor double", "append", GroupStateTimeout.NoTimeout)


class Heartbeat(StreamingQueryListener):
    """Calls beat(name, batch, rows) whenever a stream makes progress or finds nothing to do, and beat(name, None, None) when it ends."""

    def __init__(self, beat: Callable[[str | None, int | None, int | None], None]):
        self.beat, self.names = beat, {}

    def onQueryStarted(self, event) -> None:
        self.names[str(event.id)] = event.name

    def onQueryProgress(self, event) -> None:
        self.beat(event.progress.name, event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        self.beat(self.names.get(str(event.id)), None, 0)

    def onQueryTerminated(self, event) -> None:
        self.beat(self.names.pop(str(event.id), None), None, None)
