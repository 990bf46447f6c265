"""Logical snapshots of frames as JSON lines, with a manifest that carries row counts and a digest; and Parquet backups.

Unknown fields of a snapshot are kept: each line's whole object stays in `extra`.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = "tesserae-snapshot/1"


def frame_digest(df: DataFrame) -> dict:
    """Row count and an order-free digest of all columns."""
    r = df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct(*sorted(df.columns)))).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest")).first()
    return {"rows": r["rows"], "digest": r["digest"]}


def export_snapshot(frames: dict[str, DataFrame], path: str) -> dict:
    """Writes <path>/<name> as JSON lines and <path>/manifest; returns the manifest."""
    manifest = {"format": FORMAT, "frames": {}}
    for name, df in frames.items():
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{name}")
        manifest["frames"][name] = {"schema": df.schema.simpleString(), **frame_digest(df)}
    spark = next(iter(frames.values())).sparkSession
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def import_snapshot(spark: SparkSession, path: str, verify: bool = True) -> dict[str, DataFrame]:
    """Frames of a snapshot by name; a digest that differs is an error."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    if manifest.get("format") != FORMAT:
        raise ValueError(f"not a {FORMAT} snapshot")
    out = {}
    for name, m in manifest["frames"].items():
        df = spark.read.schema(m["schema"].removeprefix("struct<").removesuffix(">").replace(":", " ") if "<" not in m["schema"][7:] else _schema(m["schema"])).json(f"{path}/{name}")
        if verify and frame_digest(df) != {k: m[k] for k in ("rows", "digest")}:
            raise ValueError(f"{name} differs from its manifest")
        out[name] = df
    return out


def _schema(text: str):
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(text)


def with_unknown_fields(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a schema, with every field that it doesn't name as JSON in `extra`."""
    known = _schema(schema).fieldNames() if not schema.startswith("struct") else _schema(schema).fieldNames()
    lines = spark.read.text(path)
    parsed = lines.select(F.from_json("value", schema).alias("v"), F.from_json("value", "map<string,string>").alias("m"))
    return parsed.select("v.*", F.to_json(F.map_filter("m", lambda k, _: ~k.isin(*known))).alias("extra"))


def backup(frames: dict[str, DataFrame], path: str) -> dict:
    """Parquet copies with digests."""
    out = {}
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        out[name] = frame_digest(df)
    return out


def verify_backup(spark: SparkSession, path: str, digests: dict) -> list[str]:
    return [name for name, d in digests.items() if frame_digest(spark.read.parquet(f"{path}/{name}")) != d]


def restore_backup(spark: SparkSession, path: str, digests: dict) -> dict[str, DataFrame]:
    """The frames of a backup; one that differs from its digest is an error, and none is given."""
    bad = verify_backup(spark, path, digests)
    if bad:
        raise ValueError(f"{', '.join(bad)} differ from the backup's digests")
    return {name: spark.read.parquet(f"{path}/{name}") for name in digests}


def migrate(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Items of a document of the former format (one JSON object with `version` 0 and `items`) as rows; what the schema doesn't name stays in `extra`."""
    whole = spark.read.text(path, wholetext=True)
    known = _schema(schema).fieldNames()
    held = whole.select(F.get_json_object("value", "$.version").alias("version"), F.explode(F.from_json(F.get_json_object("value", "$.items"), "array<string>")).alias("item"))
    if not held.where("version <> '0' or version is null").isEmpty():
        raise ValueError("not a document of version 0")
    rows = held.select(F.from_json("item", schema).alias("v"), F.from_json("item", "map<string,string>").alias("m"))
    return rows.select("v.*", F.to_json(F.map_filter("m", lambda k, _: ~k.isin(*known))).alias("extra"))
