"""A stored inverted index over the commit log, kept up by the commits that are new since its last generation.

A generation adds one folder of postings (term frequencies of every object version in these commits, in `PARTS` partitions by hash of the term and sorted
by term, so a query reads a few row groups) and one of heads (revision and state of these versions). A marker names a
generation's folders and the last commit that it covers. Postings of versions that aren't an object's newest live one are left out
when they are read. After `MERGE` generations the folders are written anew as one, without what is out of date.
"""

from __future__ import annotations

import json
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import retrieval
from .files import Files
from .log import CommitLog

PARTS, MERGE = 64, 16
KEYS = ["database_id", "table_id", "kind", "object_id", "revision"]
KINDS = ["database", "table", "column", "route", "row"]
#: Fields of catalog objects that are found by words; rows are found by all their values.
CATALOG_FIELDS = {"database": ("name", "purpose", "scope", "anti_scope"), "table": ("name", "purpose", "row_semantics"), "column": ("name", "type", "purpose", "role"), "route": ("name", "path", "purpose", "synopsis")}
_POSTINGS = "database_id string, table_id string, kind string, object_id string, revision long, field_id string, term string, frequency long, part int"
_HEADS = "database_id string, table_id string, kind string, object_id string, revision long, state string"


def fields_of(versions: DataFrame) -> DataFrame:
    """KEYS, field_id and value of what versions of objects say of themselves; nulls and blank values have no fields."""
    live = versions.where("state = 'live'")
    body = F.from_json("body", "map<string,string>")
    rows = live.where("kind = 'row'").select(*KEYS, F.explode(body).alias("field_id", "value"))
    wanted = F.coalesce(*[F.when(F.col("kind") == k, F.array(*map(F.lit, f))) for k, f in CATALOG_FIELDS.items()])
    catalog = live.where("kind <> 'row'")
    named = catalog.select(*KEYS, F.explode(F.map_filter(body, lambda k, _: F.array_contains(wanted, k))).alias("field_id", "value"))
    aliases = catalog.select(*KEYS, F.lit("aliases").alias("field_id"), F.explode(F.from_json(F.get_json_object("body", "$.aliases"), "array<string>")).alias("value"))
    return rows.unionByName(named).unionByName(aliases).where("value is not null and trim(value) <> ''")


class Postings:
    def __init__(self, log: CommitLog) -> None:
        self.log, self.spark = log, log.spark
        self.root = f"{log.root}/_postings"
        self.files = Files(log.spark, self.root)

    def _current(self) -> tuple[int, list[str]]:
        numbers = self.files.numbers("markers")
        return (numbers[-1], self.files.read_json(f"markers/{numbers[-1]:020d}")) if numbers else (0, [])

    def _parts(self, folders: list[str], what: str, schema: str) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], schema)
        out = None
        for f in folders:  # partitioned folders are read one by one
            part = self.spark.read.schema(schema).parquet(f"{self.root}/{f}/{what}")
            out = part if out is None else out.unionByName(part)
        return out

    def _write(self, folder: str, postings: DataFrame, heads: DataFrame) -> None:
        postings.repartition("part").sortWithinPartitions("part", "term", "object_id").write.partitionBy("part").parquet(f"{self.root}/{folder}/postings")
        heads.repartitionByRange("kind", "object_id").sortWithinPartitions("kind", "object_id").write.parquet(f"{self.root}/{folder}/heads")

    def update(self, high: int | None = None) -> int:
        """Takes in commits up to a sequence; returns the last one covered."""
        last, folders = self._current()
        high = self.log.high_water() if high is None else high
        if high <= last:
            return last
        fresh = self.log.versions(KINDS, high, after=last)
        found = retrieval.postings(fields_of(fresh), KEYS).withColumn("part", (F.crc32(F.col("term").cast("binary")) % PARTS).cast("int"))
        folder = f"g{high:020d}-{uuid.uuid4().hex[:8]}"
        self._write(folder, found, fresh.select(*KEYS[:4], "revision", "state"))
        folders = [*folders, folder]
        if len(folders) >= MERGE:
            folder += "m"
            heads = self._newest(self._parts(folders, "heads", _HEADS))
            live = heads.where("state = 'live'").select("kind", "object_id", "revision")
            self._write(folder, self._parts(folders, "postings", _POSTINGS).join(live, ["kind", "object_id", "revision"], "left_semi"), heads)
            folders = [folder]
        self.files.make("markers")
        try:
            self.files.publish(f"markers/{high:020d}", json.dumps(folders).encode())
        except FileExistsError:  # another one has come as far
            self.files.delete(folder)
        return high

    @staticmethod
    def _newest(heads: DataFrame) -> DataFrame:
        """The newest version of each object."""
        newest = heads.groupBy("kind", "object_id").agg(F.max_by(F.struct("database_id", "table_id", "revision", "state"), "revision").alias("h"))
        return newest.select("h.database_id", "h.table_id", "kind", "object_id", "h.revision", "h.state")

    def lookup(self, terms: list[str]) -> DataFrame:
        """Postings of terms for newest live versions: KEYS, field_id, term, frequency."""
        _, folders = self._current()
        parts = sorted({zlib.crc32(t.encode()) % PARTS for t in terms})
        hits = self._parts(folders, "postings", _POSTINGS).where(F.col("part").isin(parts) & F.col("term").isin(terms)).drop("part")
        objects = hits.select("kind", "object_id").distinct()
        heads = self._newest(self._parts(folders, "heads", _HEADS).join(objects, ["kind", "object_id"], "left_semi"))
        return hits.join(heads.where("state = 'live'").select("kind", "object_id", "revision"), ["kind", "object_id", "revision"], "left_semi")

    def digest(self) -> dict:
        """Number of live postings and an order-free digest of them."""
        _, folders = self._current()
        live = self._newest(self._parts(folders, "heads", _HEADS)).where("state = 'live'").select("kind", "object_id", "revision")
        found = self._parts(folders, "postings", _POSTINGS).join(live, ["kind", "object_id", "revision"], "left_semi")
        return digest_of(found)

    def rebuild(self) -> dict:
        """Writes the index anew from the log; returns its digest and whether the one before had the same."""
        last, folders = self._current()
        high = self.log.high_water()
        old = digest_of(self.spark.createDataFrame([], _POSTINGS))
        if last:
            self.update(high)
            old = self.digest()
        fresh = self.log.versions(KINDS, high)
        heads = self._newest(fresh.select(*KEYS[:4], "revision", "state"))
        live = fresh.join(heads.where("state = 'live'").select("kind", "object_id", "revision"), ["kind", "object_id", "revision"], "left_semi")
        found = retrieval.postings(fields_of(live), KEYS).withColumn("part", (F.crc32(F.col("term").cast("binary")) % PARTS).cast("int"))
        folder = f"g{high:020d}-{uuid.uuid4().hex[:8]}r"
        self._write(folder, found, heads)
        self.files.make("markers")
        self.files.delete(f"markers/{high:020d}")
        self.files.publish(f"markers/{high:020d}", json.dumps([folder]).encode())
        new = self.digest()
        return new | {"parity": not last or new == old}


def digest_of(postings: DataFrame) -> dict:
    r = postings.agg(F.count("*").alias("postings"), F.coalesce(F.sum(F.xxhash64("kind", "object_id", "revision", "field_id", "term", "frequency").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest")).first()
    return r.asDict()
