"""An append-only audit log: numbered entries, each with the hash of the one before."""

from __future__ import annotations

import hashlib
import json
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import Files

SCHEMA = "sequence long, at string, actor string, action string, subject string, outcome string, previous string, hash string"


class Audit:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/") + "/_audit"
        self.files = Files(spark, self.root)
        self.files.make("")

    def append(self, actor: str, action: str, subject: str, outcome: str) -> dict:
        last = max([0, *self.files.numbers("", ".json")])
        previous = self.files.read_json(f"{last:020d}.json")["hash"] if last else None
        entry: dict[str, Any] = {"sequence": last + 1, "at": datetime.now(timezone.utc).isoformat(), "actor": actor, "action": action, "subject": subject, "outcome": outcome, "previous": previous}
        entry["hash"] = entry_hash(entry)
        self.files.publish(f"{last + 1:020d}.json", (json.dumps(entry, sort_keys=True) + "\n").encode())
        return entry

    def scan(self, after: int = 0, limit: int = 1000) -> DataFrame:
        return self.spark.read.schema(SCHEMA).json(self.root).where(F.col("sequence") > after).orderBy("sequence").limit(limit)

    def verify(self) -> list[int]:
        """Sequences of entries that were changed, or whose entry before is another one or missing."""
        rows = self.spark.read.schema(SCHEMA).json(self.root)
        before = rows.select((F.col("sequence") + 1).alias("sequence"), F.col("hash").alias("expected"))
        joined = rows.join(before, "sequence", "left")
        broken = joined.where((F.col("sequence") > 1) & ~F.col("previous").eqNullSafe(F.col("expected"))).select("sequence")
        fields = [c.split()[0] for c in SCHEMA.split(", ") if c.split()[0] != "hash"]
        text = F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"})
        changed = rows.where(F.sha2(text, 256) != F.col("hash")).select("sequence")
        return sorted(r[0] for r in broken.union(changed).distinct().collect())


def entry_hash(entry: dict) -> str:
    own = {k: v for k, v in entry.items() if k != "hash"}
    return hashlib.sha256(json.dumps(own, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
