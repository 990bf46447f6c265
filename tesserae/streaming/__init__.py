"""Structured Streaming: tailing the commit log, ingest once by id, retention and windowed event counts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..store.files import Files
from ..store.log import CommitLog
from ..store.log import _schema as commit_schema


def tail_changes(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    """A stream of the commit log's envelopes; each commit file comes once."""
    return spark.readStream.schema(commit_schema()).option("maxFilesPerTrigger", files_per_trigger).json(f"{root}/_commits")


def once_by_id(stream: DataFrame, key: list[str], event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each event once; with an event time the state of ids is given up after the delay."""
    if event_time:
        return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key)
    return stream.dropDuplicates(key)


def ingest(spark: SparkSession, target: str, conflicts: str, key: str, content: Column) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: new ids are appended to target; ids that are there with other content go to conflicts.
    A batch that is replayed adds nothing: its ids are there with equal content, and its conflicts are noted already."""

    def held(path: str) -> DataFrame | None:
        try:
            return spark.read.parquet(path)
        except Exception as e:  # nothing has been written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            return None

    def run(batch: DataFrame, batch_id: int) -> None:
        own = batch.withColumn("digest", content).dropDuplicates([key, "digest"])
        first = own.groupBy(key).agg(F.min("digest").alias("digest"))
        own = own.join(first.withColumn("first", F.lit(True)), [key, "digest"], "left")
        there, noted = held(target), held(conflicts)
        known = there.select(key, F.col("digest").alias("known")) if there is not None else None
        joined = own.join(known, key, "left") if known is not None else own.withColumn("known", F.lit(None).cast("string"))
        joined = joined.persist()
        odd = joined.where((F.col("known") != F.col("digest")) | F.col("known").isNull() & F.col("first").isNull()).drop("known", "first")
        if noted is not None:
            odd = odd.join(noted.select(key, "digest"), [key, "digest"], "left_anti")
        odd.write.mode("append").parquet(conflicts)  # first, so that what a replay finds in target doesn't hide a conflict within the batch
        joined.where(F.col("known").isNull() & F.col("first")).drop("known", "first").write.mode("append").parquet(target)
        joined.unpersist()

    return run


def maintain_postings(spark: SparkSession, root: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for `tail_changes`: the stored index takes in the commits of each batch. A replayed batch changes nothing."""
    from ..store.postings import Postings

    def run(batch: DataFrame, batch_id: int) -> None:
        last = batch.agg(F.max("commit_sequence")).first()[0]
        if last is not None:
            Postings(CommitLog(spark, root)).update(last)

    return run


CHECKPOINT = "session_id string, sequence long, digest string"


class Journal:
    """Events of sessions, each once by (session, event id), with a checkpoint of how far a session has been taken in."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)
        self.files.make("checkpoints")

    def take(self, events: DataFrame) -> int:
        """Appends events (session_id, sequence, event_id, body) beyond each session's checkpoint; a gap in a session's numbers is an error."""
        marks = self.checkpoints().select("session_id", F.col("sequence").alias("done"))
        fresh = events.dropDuplicates(["session_id", "event_id"]).join(marks, "session_id", "left").where(F.col("sequence") > F.coalesce("done", F.lit(0)))
        spans = fresh.groupBy("session_id").agg(F.min("sequence").alias("first"), F.max("sequence").alias("sequence"), F.count_distinct("sequence").alias("n"), F.max(F.coalesce("done", F.lit(0))).alias("done"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("event_id"))), 256).alias("digest"))
        if not spans.where((F.col("first") != F.col("done") + 1) | (F.col("n") != F.col("sequence") - F.col("done"))).isEmpty():
            raise ValueError("a session's events have a gap")
        n = max([0, *self.files.numbers("checkpoints")]) + 1
        name = uuid.uuid4().hex
        fresh.drop("done").write.parquet(f"{self.root}/events/{name}")
        spans.select("session_id", "sequence", "digest").write.parquet(f"{self.root}/marks/{name}")
        self.files.publish(f"checkpoints/{n}", name.encode())  # only now does the batch count
        return n

    def _taken(self, what: str, schema: str) -> DataFrame:
        names = [self.files.read(f"checkpoints/{n}").decode() for n in self.files.numbers("checkpoints")]
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{what}/{x}" for x in names]) if names else self.spark.createDataFrame([], schema)

    def events(self) -> DataFrame:
        return self._taken("events", "session_id string, sequence long, event_id string, body string")

    def checkpoints(self) -> DataFrame:
        """The last event taken in of each session."""
        return self._taken("marks", CHECKPOINT).groupBy("session_id").agg(F.max_by("digest", "sequence").alias("digest"), F.max("sequence").alias("sequence")).select("session_id", "sequence", "digest")


def unread_windows(windows: DataFrame, acknowledged: DataFrame, key: str) -> DataFrame:
    """Windows that haven't been acknowledged, in order: where reading goes on. An acknowledgement names a window and its bounds; one of
    other bounds (the text has changed) doesn't count."""
    return windows.join(acknowledged.select(key, "window", "first", "last").distinct(), [key, "window", "first", "last"], "left_anti").orderBy(key, "window")


def coverage(windows: DataFrame, acknowledged: DataFrame, key: str) -> DataFrame:
    """For each key the windows and nodes there are and those that were read, and whether all were."""
    read = acknowledged.select(key, "window", "first", "last").distinct().withColumn("read", F.lit(True))
    both = windows.join(read, [key, "window", "first", "last"], "left")
    return both.groupBy(key).agg(F.count("*").alias("n_windows"), F.count("read").alias("n_read"), F.sum("n_nodes").alias("n_nodes"), F.coalesce(F.sum(F.when(F.col("read"), F.col("n_nodes"))), F.lit(0)).alias("n_nodes_read")).withColumn("complete", F.col("n_windows") == F.col("n_read"))


def retained(traces: DataFrame, now: Column) -> DataFrame:
    """Traces that haven't expired."""
    return traces.where(F.col("expires_at") > now)


def windowed_counts(stream: DataFrame, event_time: str, key: str, window: str, delay: str, slide: str | None = None) -> DataFrame:
    """Extension: counts by tumbling or sliding windows, late events beyond the delay dropped."""
    when = F.window(event_time, window, slide) if slide else F.window(event_time, window)
    return stream.withWatermark(event_time, delay).groupBy(when, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def session_counts(stream: DataFrame, event_time: str, key: str, gap: str, delay: str) -> DataFrame:
    """Extension: counts by sessions of a key."""
    return stream.withWatermark(event_time, delay).groupBy(F.session_window(event_time, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def chain_breaks(journal: DataFrame) -> DataFrame:
    """Entries of a hash-chained journal (job_id, seq, previous, hash) whose link to the entry before is wrong."""
    before = journal.select("job_id", (F.col("seq") + 1).alias("seq"), F.col("hash").alias("expected"))
    return journal.join(before, ["job_id", "seq"], "left").where(~F.coalesce(F.col("previous") == F.col("expected"), (F.col("seq") == 0) & F.col("previous").isNull()))
