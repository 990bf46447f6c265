"""Route traces: what a search through a route tree tried, kept until it expires.

A trace is recorded once by its id; the same id with other content is a conflict. Pruning deletes what has expired and raises the
retention epoch, after which cursors of earlier listings are refused.
"""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..language.errors import StatementError
from .files import Files

STEP = "ordinal long, operation string, parent_route_id string, candidate_route_ids array<string>, selected_route_id string, locators array<struct<row_id string, revision long>>, outcome string, elapsed_ms long, remaining_budget long"
SCHEMA = f"trace_id string, trace_sequence long, recorded_at string, expires_at string, actor string, database_id string, table_id string, status string, steps array<struct<{STEP}>>, checksum string"
NEEDED = ("trace_id", "recorded_at", "expires_at", "actor", "database_id", "table_id", "status", "steps")
STATUSES = ("succeeded", "failed", "cancelled", "exhausted")


def _instant(text: str) -> datetime:
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return at if at.tzinfo else at.replace(tzinfo=timezone.utc)


class Traces:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/") + "/_traces"
        self.files = Files(spark, self.root)
        for folder in ("bodies", "claims", "epochs"):
            self.files.make(folder)

    def high_water(self) -> int:
        return max([0, *self.files.numbers("claims")])

    def epoch(self) -> int:
        return max([0, *self.files.numbers("epochs")])

    def record(self, trace: dict) -> dict:
        """Returns the trace with its sequence and checksum; recorded again with equal content, the one that is there."""
        if any(trace.get(k) in (None, "") for k in NEEDED) or "/" in trace["trace_id"] or trace["status"] not in STATUSES:
            raise StatementError("validation_error", "a trace needs " + ", ".join(NEEDED))
        steps = trace["steps"]
        if not isinstance(steps, list) or [s.get("ordinal") for s in steps] != list(range(1, len(steps) + 1)):
            raise StatementError("validation_error", "steps are numbered from 1")
        if _instant(trace["expires_at"]) <= _instant(trace["recorded_at"]):
            raise StatementError("validation_error", "a trace expires after it is recorded")
        body = {k: trace[k] for k in NEEDED}
        checksum = hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
        name = f"bodies/{trace['trace_id']}.json"
        if not self.files.exists(name):
            sequence = self.high_water() + 1
            try:
                self.files.publish(f"claims/{sequence}", trace["trace_id"].encode())
                done = body | {"trace_sequence": sequence, "checksum": checksum}
                self.files.publish(name, (json.dumps(done, sort_keys=True, ensure_ascii=False) + "\n").encode())
                return done
            except FileExistsError as e:
                raise StatementError("write_conflict", "another trace was recorded") from e
        held = self.files.read_json(name)
        if held["checksum"] != checksum:
            raise StatementError("already_exists", f"trace {trace['trace_id']} has other content")
        return held

    def frame(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).json(f"{self.root}/bodies")

    def timeline(self, high: int, after: int = 0, database_id: str | None = None) -> DataFrame:
        """Traces after a sequence up to the high-water mark, in order."""
        own = self.frame().where((F.col("trace_sequence") > after) & (F.col("trace_sequence") <= high))
        own = own if database_id is None else own.where(F.col("database_id") == database_id)
        return own.withColumn("step_count", F.size("steps").cast("long")).drop("steps").orderBy("trace_sequence")

    def prune(self, now: str) -> int:
        """Deletes traces that expire by `now`; raises the epoch if any went. Returns how many."""
        gone = [r[0] for r in self.frame().where(F.to_timestamp("expires_at") <= F.to_timestamp(F.lit(now))).select("trace_id").collect()]
        for i in gone:
            self.files.delete(f"bodies/{i}.json")
        if gone:
            self.files.publish(f"epochs/{self.epoch() + 1}", b"")
        return len(gone)
