"""Reads over an append-only log of row versions: row_id, revision, commit_sequence, row_state and values.

Current and as-of rows come from one grouped aggregation with map-side combination (`max_by` of the whole row),
never from a window over a row's versions, so a row with many versions is folded where it lies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str = "row_id", order: str = "revision") -> DataFrame:
    """The newest version of each key."""
    rest = [c for c in log.columns if c != key]
    newest = log.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("__v"))
    return newest.select(key, *[F.col("__v")[c].alias(c) for c in rest]).select(*log.columns)


def current_rows(log: DataFrame, snapshot: int | None = None) -> DataFrame:
    """Newest versions up to the snapshot that are live."""
    seen = log if snapshot is None else log.where(F.col("commit_sequence") <= snapshot)
    return latest(seen).where("row_state = 'live'")


def hidden_ids(log: DataFrame) -> DataFrame:
    """Ids of rows whose current state is deleted: their history and old versions can't be read."""
    return log.groupBy("row_id").agg(F.max_by("row_state", "revision").alias("s")).where("s = 'deleted'").select("row_id")


def as_of_revision(log: DataFrame, row_id, revision: int) -> DataFrame:
    """One row's version by revision, unless the row is deleted now."""
    own = log.where(F.col("row_id") == row_id)
    return own.where(F.col("revision") == revision).join(hidden_ids(own), "row_id", "left_anti")


def as_of_commit(log: DataFrame, commit: int, snapshot: int | None = None) -> DataFrame:
    """Newest versions up to a commit (no later than the snapshot) of rows that aren't deleted now; live ones."""
    upto = commit if snapshot is None else min(commit, snapshot)
    return latest(log.where(F.col("commit_sequence") <= upto)).where("row_state = 'live'").join(hidden_ids(log), "row_id", "left_anti")


def history(log: DataFrame, row_id, limit: int, after: int = 0) -> DataFrame:
    """A page of one row's versions in order, values left out."""
    own = log.where(F.col("row_id") == row_id)
    kept = [c for c in ("row_id", "revision", "commit_sequence", "schema_version", "operation", "row_state", "actor", "source", "source_kind", "reason", "updated_at") if c in log.columns]
    return own.where(F.col("revision") > after).join(hidden_ids(own), "row_id", "left_anti").select(*kept).orderBy("revision").limit(limit)


def scan_order(row_id: str = "row_id"):
    """Clustered order: by length of the id, then bytes."""
    return [F.octet_length(row_id), F.col(row_id)]


def bounded_scan(rows: DataFrame, order: list, condition, scan: int, limit: int) -> DataFrame:
    """The first `scan` rows in order are looked at, the first `limit` of those that meet the condition come out."""
    return rows.orderBy(*order).limit(scan).where(condition).orderBy(*order).limit(limit)


def key_range(rows: DataFrame, key: str, start, end, limit: int, after=None) -> DataFrame:
    """Rows with keys from `start` up to but not including `end`, in order, after the key that the page before ended with."""
    for bound, test in ((start, F.col(key) >= F.lit(start)), (end, F.col(key) < F.lit(end)), (after, F.col(key) > F.lit(after))):
        rows = rows if bound is None else rows.where(test)
    return rows.orderBy(key).limit(limit)


def windowed_rows(log: DataFrame, scan: int) -> DataFrame:
    """Live rows among the first `scan` keys in scan order: rows that are gone use up the window, too."""
    return latest(log).orderBy(*scan_order()).limit(scan).where("row_state = 'live'")


def restore(log: DataFrame, row_id, revision: int, commit: int) -> DataFrame:
    """The log with a further version of the row that has an old revision's values."""
    head = log.where(F.col("row_id") == row_id).agg(F.max("revision").alias("r"))
    old = as_of_revision(log, row_id, revision).join(F.broadcast(head), F.lit(True))
    new = old.withColumn("revision", (F.col("r") + 1).cast(log.schema["revision"].dataType)).withColumn("commit_sequence", F.lit(commit).cast(log.schema["commit_sequence"].dataType)).withColumn("row_state", F.lit("live"))
    return log.unionByName(new.select(*log.columns))
