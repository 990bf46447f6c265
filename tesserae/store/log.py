"""Commit log on any Hadoop file system.

A commit is one JSON line in `_commits/<sequence>.json` that holds versions of objects; its file appears whole, or not at all. Readers take all
commits up to a snapshot. There is one writer at a time: who comes second to a sequence number gets a write conflict.

`compact` folds the commits that are new since the last time into Parquet: versions partitioned by kind and table and sorted by object id,
so that a read of one row prunes folders and row groups, and envelopes sorted by sequence. A marker names the folded folders;
reads take these and parse the JSON of later commits alone. After `MERGE` foldings all are merged into one folder.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..language.errors import StatementError
from .files import Files

ENTRY = "kind string, database_id string, table_id string, object_id string, revision long, state string, operation string, schema_version long, body string"
META = "commit_sequence long, transaction_id string, committed_at string, actor string, source string, source_kind string, reason string, source_receipt_id string, source_locator string, source_content_hash string, checksum string"
PROVENANCE = ("actor", "source", "source_kind", "reason", "source_receipt_id", "source_locator", "source_content_hash")
MOST_ENTRIES, MERGE = 4096, 8
_NAMES = [f.split()[0] for f in ENTRY.split(", ")]
_PROVENANCE = ["commit_sequence", "updated_at", "actor", "source", "source_kind", "reason"]


def _schema() -> str:
    fields = ",".join(":".join(x.split()) for x in ENTRY.split(", "))
    return f"{META}, entries array<struct<{fields}>>"


def _exploded(commits: DataFrame) -> DataFrame:
    """One version a row, with its commit's provenance."""
    out = commits.select("commit_sequence", F.to_timestamp("committed_at").alias("updated_at"), "actor", "source", "source_kind", "reason", F.explode("entries").alias("e"))
    return out.select("e.*", *_PROVENANCE)


class CommitLog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.files = Files(spark, self.root)
        self.files.make("_commits")

    def _folded(self) -> tuple[int, list[str]]:
        """Last sequence folded and the folders."""
        numbers = self.files.numbers("_folded", ".done")
        return (numbers[-1], self.files.read_json(f"_folded/{numbers[-1]:020d}.done")) if numbers else (0, [])

    def high_water(self) -> int:
        return max([0, *self.files.numbers("_commits", ".json"), *self.files.numbers("_folded", ".done")])

    def read(self, sequence: int) -> dict:
        return self.files.read_json(f"_commits/{sequence:020d}.json")

    def commit(self, entries: list[dict], expected: int, **meta: Any) -> dict:
        """Writes the next commit. `expected` is the high-water mark that the writer has seen."""
        if not entries:
            raise StatementError("validation_error", "nothing to commit")
        if len(entries) > MOST_ENTRIES:
            raise StatementError("constraint_violation", f"more than {MOST_ENTRIES} entries")
        entries = sorted(entries, key=lambda e: (e["kind"], e.get("table_id") or "", e["object_id"], e["revision"]))
        body = {"commit_sequence": expected + 1, "committed_at": datetime.now(timezone.utc).strftime("%Y-%m-%d %H:%M:%S.%f"), **{k: meta.get(k) for k in PROVENANCE}, "entries": entries}
        checksum = hashlib.sha256(json.dumps(body, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
        body |= {"transaction_id": f"txn_{checksum[:32]}", "checksum": checksum}
        try:
            self.files.publish(f"_commits/{expected + 1:020d}.json", (json.dumps(body, sort_keys=True, ensure_ascii=False) + "\n").encode())
        except FileExistsError as e:
            raise StatementError("write_conflict", f"commit {expected + 1} exists") from e
        return body

    def _tail(self, after: int, snapshot: int | None = None) -> DataFrame | None:
        """JSON commits beyond a sequence, read by name."""
        numbers = [n for n in self.files.numbers("_commits", ".json") if n > after and (snapshot is None or n <= snapshot)]
        if not numbers:
            return None
        return self.spark.read.schema(_schema()).json([f"{self.root}/_commits/{n:020d}.json" for n in numbers])

    def commits(self, snapshot: int | None = None, after: int = 0) -> DataFrame:
        """Envelopes after a sequence, up to the snapshot."""
        last, folders = self._folded()
        parts = [self.spark.read.schema(_schema()).parquet(*[f"{self.root}/{f}/envelopes" for f in folders])] if folders and after < last else []
        tail = self._tail(max(last, after), snapshot)
        parts += [tail] if tail is not None else []
        if not parts:
            return self.spark.createDataFrame([], _schema())
        out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        if after:
            out = out.where(F.col("commit_sequence") > after)
        return out if snapshot is None else out.where(F.col("commit_sequence") <= snapshot)

    def versions(self, kind: str | list[str], snapshot: int | None = None, table_id: str | None = None, object_id: str | None = None, after: int = 0) -> DataFrame:
        """Versions of one kind of object, or of several, with their commit's provenance; of one table or object alone if it is named."""
        last, folders = self._folded()
        parts = [self.spark.read.schema(_VERSIONS).parquet(f"{self.root}/{f}/versions").select(*_NAMES, *_PROVENANCE) for f in folders] if after < last else []
        tail = self._tail(max(last, after), snapshot)
        parts += [_exploded(tail)] if tail is not None else []
        if not parts:
            parts = [_exploded(self.spark.createDataFrame([], _schema()))]
        kinds = [kind] if isinstance(kind, str) else kind
        wanted = F.col("kind").isin(kinds)
        for c, v in (("table_id", table_id), ("object_id", object_id)):
            wanted = wanted if v is None else wanted & (F.col(c) == v)
        if after:
            wanted &= F.col("commit_sequence") > after
        if snapshot is not None:
            wanted &= F.col("commit_sequence") <= snapshot
        out = parts[0].where(wanted)
        for p in parts[1:]:
            out = out.unionByName(p.where(wanted))
        return out

    def compact(self) -> int:
        """Folds commits into Parquet; returns the last sequence folded."""
        last, folders = self._folded()
        high = self.high_water()
        if high <= last:
            return last
        merge = len(folders) + 1 >= MERGE
        fresh = self.commits(high) if merge else self.commits(high, last)
        folder = f"folded/{high:020d}-{uuid.uuid4().hex[:8]}"
        fresh.repartitionByRange("commit_sequence").sortWithinPartitions("commit_sequence").write.parquet(f"{self.root}/{folder}/envelopes")
        order = ["kind", "table_id", "object_id", "revision"]
        _exploded(fresh).repartitionByRange(*order[:3]).sortWithinPartitions(*order).write.partitionBy("kind", "table_id").parquet(f"{self.root}/{folder}/versions")
        self.files.make("_folded")
        try:
            self.files.publish(f"_folded/{high:020d}.done", json.dumps([folder] if merge else [*folders, folder]).encode())
        except FileExistsError:  # another one has folded as far
            self.files.delete(folder)
        return high

    def verify(self, snapshot: int | None = None) -> list[int]:
        """Sequences of JSON commits whose checksum doesn't match."""
        bad = []
        for n in self.files.numbers("_commits", ".json"):
            if snapshot is None or n <= snapshot:
                body = self.read(n)
                own = {k: v for k, v in body.items() if k not in ("checksum", "transaction_id")}
                if hashlib.sha256(json.dumps(own, sort_keys=True, ensure_ascii=False).encode()).hexdigest() != body["checksum"]:
                    bad.append(n)
        return bad


_VERSIONS = f"{ENTRY}, commit_sequence long, updated_at timestamp, actor string, source string, source_kind string, reason string"
