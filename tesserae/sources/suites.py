"""Retrieval suites: topics and relevance judgements from tab-separated files and JSON lines, strict JSON runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _unique(df: DataFrame, keys: list[str], what: str) -> DataFrame:
    again = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if again:
        raise ValueError(f"{what} repeats {tuple(again[0][k] for k in keys)}")
    return df


def topics_tsv(spark: SparkSession, path: str, group: str = "all") -> DataFrame:
    """query_id, group, text of headerless topics."""
    return _unique(spark.read.csv(path, sep="\t", quote="", schema="query_id string, text string"), ["query_id"], "topics").withColumn("group", F.lit(group))


def qrels_trec(spark: SparkSession, path: str) -> DataFrame:
    """query_id, document_id, relevance of judgements in four columns without header."""
    rows = spark.read.csv(path, sep="\t", quote="", schema="query_id string, iteration string, document_id string, relevance int", mode="FAILFAST")
    return _unique(rows.drop("iteration"), ["query_id", "document_id"], "judgements")


def qrels_header_tsv(spark: SparkSession, path: str) -> DataFrame:
    """The same of files with the header query-id, corpus-id, score."""
    rows = spark.read.csv(path, sep="\t", quote="", header=True)
    rows = rows.select(F.col("query-id").alias("query_id"), F.col("corpus-id").alias("document_id"), F.col("score").cast("int").alias("relevance"))
    return _unique(rows, ["query_id", "document_id"], "judgements")


def queries_jsonl(spark: SparkSession, path: str, group: str = "all") -> DataFrame:
    rows = spark.read.schema("_id string, text string").json(path, mode="FAILFAST").withColumnRenamed("_id", "query_id")
    return _unique(rows, ["query_id"], "queries").withColumn("group", F.lit(group))


RUN = "run_id string, arm string, query_id string, status string, candidates array<string>, input_tokens long, output_tokens long, tool_calls long, model_calls long, context_characters long, end_to_end_microseconds long"


MOST_BYTES = 128 * 1024 * 1024


def run_json(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Strict results of runs: files that are too large, malformed lines, unknown fields, repeated results, repeated candidates and candidates of failed
    queries are errors."""
    files = spark.read.format("binaryFile").load(path).select("length")  # contents aren't read
    if not files.where(F.col("length") > most_bytes).isEmpty():
        raise ValueError(f"a file is larger than {most_bytes} bytes")
    known = [c.split()[0] for c in RUN.split(", ")]
    fields = spark.read.text(path).select(F.explode(F.json_object_keys("value")).alias("field"))
    odd = fields.where(~F.col("field").isin(*known)).limit(1).collect()
    if odd:
        raise ValueError(f"unknown field {odd[0][0]}")
    rows = _unique(spark.read.schema(RUN).json(path, mode="FAILFAST"), ["run_id", "query_id"], "results")
    bad = rows.where((F.size(F.array_distinct("candidates")) < F.size("candidates")) | (F.col("status") == "failed") & (F.size("candidates") > 0) | ~F.col("status").isin("completed", "failed"))
    if not bad.isEmpty():
        raise ValueError("a result has repeated candidates, candidates though it failed, or an unknown status")
    return rows


def verified(spark: SparkSession, path: str, digests: dict[str, str]) -> DataFrame:
    """file, state (good, changed, missing or unexpected) of a data set's files by their SHA-256."""
    found = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("digest"))
    known = spark.createDataFrame(sorted(digests.items()), "file string, wanted string")
    state = F.when(F.col("wanted").isNull(), "unexpected").when(F.col("digest").isNull(), "missing").when(F.col("digest") == F.col("wanted"), "good").otherwise("changed")
    return found.join(known, "file", "full").select("file", state.alias("state"))
