"""Vector generations: immutable Parquet folders with a manifest, and a marker that names the current one.

A generation holds route_id, database_id, table_id, route_revision, surface (digest of what the route shows) and vector. It is
stale for a route whose surface digest differs now.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..language.errors import StatementError
from ..operators.retrieval import norm_violations

MOST_DIMENSIONS = 4096


class Generations:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/") + "/_vectors"
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _markers(self, space: str) -> list[int]:
        folder = self._path(f"{self.root}/{space}/markers")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def publish(self, space: str, vectors: DataFrame, model: dict, expected: int | None = None) -> int:
        """Checks and writes a generation, then its marker, created exclusively; returns its number."""
        sizes = vectors.agg(F.min(F.size("vector")).alias("a"), F.max(F.size("vector")).alias("b"), F.count("*").alias("n")).first()
        if not sizes["n"] or sizes["a"] != sizes["b"] or not 1 <= sizes["a"] <= MOST_DIMENSIONS:
            raise StatementError("validation_error", "vectors need one length of 1 to 4096")
        if not norm_violations(vectors, embedding="vector").isEmpty():
            raise StatementError("validation_error", "vectors need unit length")
        if not vectors.groupBy("route_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            raise StatementError("validation_error", "a route has several vectors")
        number = max([0, *self._markers(space)]) + 1
        if expected is not None and expected != number - 1:
            raise StatementError("revision_conflict", "another generation was published")
        name = uuid.uuid4().hex
        vectors.write.parquet(f"{self.root}/{space}/{name}")
        try:
            out = self._fs.create(self._path(f"{self.root}/{space}/markers/{number}"), False)
        except Exception as e:
            raise StatementError("write_conflict", "another generation was published") from e
        out.write(bytearray(json.dumps({"folder": name, "dimensions": sizes["a"], "rows": sizes["n"], "model": model}, sort_keys=True).encode()))
        out.close()
        return number

    def manifest(self, space: str, number: int | None = None) -> dict:
        known = self._markers(space)
        if not known or number is not None and number not in known:
            raise StatementError("not_found", f"no generation of {space}")
        stream = self._fs.open(self._path(f"{self.root}/{space}/markers/{number or known[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def open(self, space: str, number: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{space}/{self.manifest(space, number)['folder']}")

    def reclaim(self, space: str, keep: int = 2) -> int:
        """Deletes all but the newest generations; returns how many went."""
        old = self._markers(space)[:-keep]
        for n in old:
            self._fs.delete(self._path(f"{self.root}/{space}/{self.manifest(space, n)['folder']}"), True)
            self._fs.delete(self._path(f"{self.root}/{space}/markers/{n}"), False)
        return len(old)
