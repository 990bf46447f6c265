import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = docs.cache()
    for name, stage in corpus_pipeline.STAGES[:4]:
        before = {r["doc_id"]: r["text"] for r in held.collect()}
        out = stage(spark, held, SF).cache()
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert out.columns == docs.columns and set(after) <= set(before)
        if name == "toxicity":
            gone = set(before) - set(after)
            assert all(labels.get(i, 1) == 1 for i in gone)
        elif name == "near_dedup":
            want = brute.near_duplicates(list(before.items()), 5)
            assert set(after) == {i for i, (_, _, kept) in want.items() if kept}
        elif name == "decontamination":
            assert set(after) == {i for i, t in before.items() if not brute.contamination(t, items)[4]}
        else:
            assert set(after) == set(before)
            for i, t in before.items():
                assert any(brute.personal(t).values()) <= (after[i] != t)
        held = out
    pieces = corpus_pipeline.STAGES[4][1](spark, held, SF)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == set(after)


def test_near_dedup_unnamed_partner(spark):
    """Five-word shingles: a document goes whose only link leads to a group's member that nobody names as the likeliest partner."""
    rows, want = brute.one_link_clusters(5), {}
    for at in range(0, len(rows), 102):  # clusters share no word
        want |= brute.near_duplicates(rows[at : at + 102], 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted(map(tuple, got)) == [(i, t) for i, t in rows if want[i][2]]


def test_near_dedup_short(spark):
    """Five-word shingles: of two texts of eight and nine words with a similarity of 0.8 one goes, wherever their few registers lie."""
    rows = brute.short_pairs(5)
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(map(tuple, got)) == rows[::2]


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_odd_rows(spark):
    """Null ids and texts, repeated rows and ids, long texts and columns named like those that stages use: rows that are clean stay as they are."""
    from pyspark.sql import functions as F

    long = " ".join(f"word{i} of a long text" for i in range(4000))
    rows = [(1, "one two three four five six seven"), (1, "one two three four five six seven"), (1, "another text under the same id"), (2, None), (2, None), (None, "no id here"), (None, None), (3, ""), (4, long), (5, "write to me@example.com or +49 30 1234567")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("lang", "source", "key", "marks", "term", "hits", "n_words", "items", "spans", "score", "maybe", "odd", "own", "fp", "id"):
        docs = docs.withColumn(c, F.lit(c))
    docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    held = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        held = stage(spark, held, SF).cache()
        assert held.columns == docs.columns, name
        assert all(r["key"] == "key" and r["hits"] == "hits" for r in held.collect()), name
    got = sorted((str(r["doc_id"]), str(r["text"])) for r in held.collect())
    want = [("1", "another text under the same id"), ("1", "one two three four five six seven"), ("2", "None"), ("3", ""), ("4", long), ("5", "write to [EMAIL] or [PHONE]"), ("None", "None"), ("None", "no id here")]
    assert got == sorted(want)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in held.collect())
    assert corpus_pipeline.STAGES[4][1](spark, held, SF).select("doc_id").distinct().count() == 6


def test_run(spark):
    from tesserae.llm import common

    rows = corpus_pipeline.run(spark, SF)
    ids = {r["doc_id"] for r in rows.select("doc_id").distinct().collect()}
    assert ids and ids <= {r["doc_id"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len([p for p in common._MADE if "/pipeline-" in p]) <= 4
