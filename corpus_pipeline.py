"""Corpus pipeline: toxic documents go, one of each group of near-duplicates stays, contaminated documents go, personal
data is replaced, and what is left is packed. Each stage works on all that its predecessor kept; results are written to the
shared folder between stages. STAGES' functions take (spark, docs, sf_dir), sf_dir being the folder of the other tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tesserae.llm import decontam, minhash, packing, pii, toxicity
from tesserae.llm.common import crc_mod, made, new_path, remove, remove_made, table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go. The classifier learns from the labelled documents of sf_dir, held-out ones apart."""
    model = toxicity.train(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    return toxicity.remove_toxic(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) stays."""
    return minhash.deduplicate(docs)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more lie in windows of benchmark items go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that give it away are replaced; n_chars is counted anew."""
    return pii.sanitise(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", remove_toxic), ("near_dedup", near_dedup), ("decontamination", remove_contaminated), ("pii", sanitise), ("packing", pack)]

#: Trained models, estimates and tokenizers have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, old = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        since = made()
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = new_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
            remove_made(spark, since, path)  # what the stage left on the way
            if old:
                remove(spark, old)
            old = path
    return docs
