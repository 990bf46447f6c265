"""Wiki pages of rows and their relations, written by content: a page whose digest hasn't changed isn't written again."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import relation_pages
from ..store.files import Files


def render(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """row_id, page, digest. rows: row_id, title, body; edges: source_id, relation_type, target_id."""
    links = relation_pages(edges, rows).groupBy("row_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("- "), "direction", F.lit(" "), "relation_type", F.lit(" [["), "other_id", F.lit("]]")))).alias("links"))
    out = rows.join(links, "row_id", "left")
    text = F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), F.coalesce("body", F.lit("")), F.lit("\n"), F.when(F.size("links") > 0, F.concat(F.lit("\n## Relations\n\n"), F.array_join("links", "\n"), F.lit("\n"))).otherwise(""))
    return out.select("row_id", text.alias("page")).withColumn("digest", F.sha2("page", 256))


def changed(pages: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """Pages that are new or differ from the manifest (row_id, digest)."""
    return pages if manifest is None else pages.join(manifest, ["row_id", "digest"], "left_anti")


def removed(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    return manifest.join(pages, "row_id", "left_anti").select("row_id")


def file_name(row_id: Column) -> Column:
    """Letters, digits, dots and dashes stay; other characters are written by their number."""
    safe = lambda c: F.when(c.rlike("[A-Za-z0-9.-]"), c).otherwise(F.concat(F.lit("_"), F.hex(c.cast("binary")), F.lit("_")))
    return F.concat(F.lit("p-"), F.array_join(F.transform(F.split(row_id, ""), safe), ""), F.lit(".md"))


def sync(spark: SparkSession, pages: DataFrame, path: str) -> dict:
    """Brings a folder in line with the pages: one Markdown file a row, written where its digest differs from the manifest's, and deleted where
    the row is gone. Tasks write through Hadoop's file system by Spark's own writer: each page is a partition's only file, then renamed
    by the driver, which moves as many files as there are changed pages. The manifest is written last, so a run that
    was cut short is done again."""
    files = Files(spark, path)
    files.make("")
    old = spark.read.schema("row_id string, digest string, file string").json(f"{path}/_manifest") if files.exists("_manifest") else None
    now = pages.withColumn("file", file_name(F.col("row_id")))
    fresh = now if old is None else now.join(old.select("row_id", "digest"), ["row_id", "digest"], "left_anti")
    gone = [] if old is None else [r[0] for r in old.join(now, "row_id", "left_anti").select("file").collect()]
    fresh.select("file", F.col("page").alias("value")).write.mode("overwrite").partitionBy("file").option("lineSep", "\n").text(f"{path}/_new")
    written = 0
    for folder in files.names("_new"):
        if folder.startswith("file="):
            name = unquote(folder.removeprefix("file="))
            part = next(n for n in files.names(f"_new/{folder}") if n.startswith("part-"))
            files.delete(name)
            files.move(f"_new/{folder}/{part}", name)
            written += 1
    files.delete("_new")
    for name in gone:
        files.delete(name)
    now.select("row_id", "digest", "file").coalesce(1).write.mode("overwrite").json(f"{path}/_manifest_new")
    files.delete("_manifest")
    files.move("_manifest_new", "_manifest")
    return {"pages": now.count(), "written": written, "removed": len(gone)}
