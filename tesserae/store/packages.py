"""Packages: one database's latest objects as JSON lines with a manifest that carries digests and, with a key, a signature.

A package can be opened read-only, as frames, or installed into a store in commits of bounded size under its own ids.
"""

from __future__ import annotations

import hashlib
import hmac
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..language.errors import StatementError
from ..operators.health import three_way_merge
from ..operators.versions import latest
from ..sources.snapshots import frame_digest
from .log import CommitLog

FORMAT = "tesserae-package/1"
KINDS = ("database", "table", "column", "route", "row", "relation", "membership")
SCHEMA = "kind string, database_id string, table_id string, object_id string, revision long, state string, operation string, schema_version long, body string"
BATCH = 4000


def _signature(manifest: dict, key: bytes) -> str:
    return hmac.new(key, json.dumps({k: v for k, v in manifest.items() if k != "signature"}, sort_keys=True).encode(), hashlib.sha256).hexdigest()


def pack(log: CommitLog, database_id: str, path: str, key: bytes | None = None, author: str | None = None, base: dict | None = None) -> dict:
    """Writes the newest live versions of a database's objects."""
    out = None
    for kind in KINDS:
        own = latest(log.versions(kind).where(F.col("database_id") == database_id), "object_id").where("state = 'live'").select(*[f.split()[0] for f in SCHEMA.split(", ")])
        out = own if out is None else out.unionByName(own)
    out.write.mode("errorifexists").json(f"{path}/objects")
    objects = log.spark.read.schema(SCHEMA).json(f"{path}/objects")
    manifest = {"format": FORMAT, "database_id": database_id, "author": author, "base": base, **frame_digest(objects)}
    if not manifest["rows"]:
        raise StatementError("not_found", f"no database {database_id}")
    if key:
        manifest["signature"] = _signature(manifest, key)
    log.spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def open_package(spark: SparkSession, path: str, key: bytes | None = None) -> tuple[dict, DataFrame]:
    """Manifest and objects; a wrong digest or signature is an error."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if manifest.get("format") != FORMAT:
        raise StatementError("invalid_request", "this is no package")
    if key and not hmac.compare_digest(manifest.get("signature", ""), _signature(manifest, key)):
        raise StatementError("permission_denied", "the signature is wrong")
    objects = spark.read.schema(SCHEMA).json(f"{path}/objects")
    if frame_digest(objects) != {k: manifest[k] for k in ("rows", "digest")}:
        raise StatementError("constraint_violation", "the package differs from its manifest")
    return manifest, objects


def install(log: CommitLog, path: str, key: bytes | None = None, actor: str = "install") -> int:
    """Commits a package's objects, containers last, so that nothing of it can be reached before all is there; a run that was cut short is
    done again, and takes in only what is missing. Returns the last sequence. The database mustn't be there."""
    manifest, objects = open_package(log.spark, path, key)
    if manifest["digest"] in revoked(log):
        raise StatementError("permission_denied", "this package was revoked")
    if not log.versions("database").where(F.col("object_id") == manifest["database_id"]).isEmpty():
        raise StatementError("already_exists", manifest["database_id"])
    here = log.versions(list(KINDS)).select("kind", "object_id", "revision")
    _commit(log, objects.join(here, ["kind", "object_id", "revision"], "left_anti"), "INSTALL", actor)
    return log.high_water()


def _commit(log: CommitLog, objects: DataFrame, operation: str, actor: str) -> None:
    order = F.coalesce(*[F.when(F.col("kind") == k, -i) for i, k in enumerate(KINDS)])
    batch: list[dict] = []
    for r in objects.select(*[f.split()[0] for f in SCHEMA.split(", ")]).orderBy(order, "table_id", "object_id").toLocalIterator():
        batch.append(r.asDict() | {"operation": operation})
        if len(batch) == BATCH:
            log.commit(batch, log.high_water(), actor=actor)
            batch = []
    if batch:
        log.commit(batch, log.high_water(), actor=actor)


def fork(log: CommitLog, path: str, to: str, key: bytes | None = None, author: str | None = None) -> dict:
    """A package of one's own that remembers which one it comes from."""
    manifest, objects = open_package(log.spark, path, key)
    objects.write.mode("errorifexists").json(f"{to}/objects")
    out = {"format": FORMAT, "database_id": manifest["database_id"], "author": author, "base": {"digest": manifest["digest"], "author": manifest.get("author")}, **frame_digest(log.spark.read.schema(SCHEMA).json(f"{to}/objects"))}
    if key:
        out["signature"] = _signature(out, key)
    log.spark.createDataFrame([(json.dumps(out, sort_keys=True),)], "value string").coalesce(1).write.text(f"{to}/manifest")
    return out


def _keyed(objects: DataFrame) -> DataFrame:
    return objects.select(F.concat_ws("/", "kind", "object_id").alias("key"), F.to_json(F.struct("state", "body")).alias("value"), *objects.columns)


def merge(log: CommitLog, base: str, incoming: str, key: bytes | None = None, actor: str = "merge") -> dict:
    """Three-way merge of a package's new edition into the installed database. Any conflict, and nothing is merged: the result lists them."""
    manifest, old = open_package(log.spark, base, key)
    again, new = open_package(log.spark, incoming, key)
    if again["database_id"] != manifest["database_id"]:
        raise StatementError("validation_error", "the packages hold different databases")
    mine = latest(log.versions(list(KINDS)).where(F.col("database_id") == manifest["database_id"]).withColumn("key", F.concat_ws("/", "kind", "object_id")), "key")
    live = mine.where("state = 'live'").select("key", F.to_json(F.struct("state", "body")).alias("value"))
    merged = three_way_merge(_keyed(old).select("key", "value"), live, _keyed(new).select("key", "value"), "key", "value")
    conflicts = [r[0] for r in merged.where("action = 'conflict'").orderBy("key").limit(100).select("key").collect()]
    if conflicts:
        return {"merged": 0, "conflicts": conflicts}
    taken = merged.where("action = 'incoming'").select("key", "merged")
    heads = mine.select("key", F.col("revision").alias("head"), *[F.col(c).alias(f"h_{c}") for c in ("kind", "database_id", "table_id", "object_id", "schema_version", "body")])
    out = taken.join(_keyed(new).drop("value"), "key", "left").join(heads, "key", "left")
    pick = lambda c: F.coalesce(F.col(c), F.col(f"h_{c}")).alias(c)
    out = out.select(pick("kind"), pick("database_id"), pick("table_id"), pick("object_id"), (F.coalesce("head", F.lit(0)) + 1).alias("revision"), F.when(F.col("merged").isNull(), "deleted").otherwise(F.col("state")).alias("state"), F.lit("MERGE").alias("operation"), pick("schema_version"), pick("body"))
    n = out.count()
    if n:
        _commit(log, out, "MERGE", actor)
    return {"merged": n, "conflicts": []}


def upgrade(log: CommitLog, installed: str, newer: str, key: bytes | None = None, actor: str = "upgrade") -> dict:
    """Takes a newer edition over an installed one; local changes stay unless both changed the same object, which is a conflict."""
    manifest, _ = open_package(log.spark, newer, key)
    if manifest["digest"] in revoked(log):
        raise StatementError("permission_denied", "this package was revoked")
    return merge(log, installed, newer, key, actor)


def revoke(log: CommitLog, digest: str, reason: str) -> None:
    """A package of this digest can't be installed or taken as an upgrade any more."""
    log.files.make("_revoked")
    try:
        log.files.publish(f"_revoked/{digest.replace('-', 'm')}", json.dumps({"digest": digest, "reason": reason}).encode())
    except FileExistsError as e:
        raise StatementError("already_exists", "this package was revoked") from e


def revoked(log: CommitLog) -> set[str]:
    return {log.files.read_json(f"_revoked/{n}")["digest"] for n in log.files.names("_revoked")}
