from collections import Counter

from pyspark.sql import functions as F

from tesserae import functions as X
from tesserae.operators import retrieval

from test_functions import naive_terms


def ended_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def counted(rows):
    found = Counter()
    for key, field, value in rows:
        found.update((key, field, t) for t in naive_terms(value or ""))
    return found


def test_postings_over_rows(spark):
    """Keys that come once, several times, with another field, or not at all; texts without terms, and Han ones."""
    rows = [(1, "f", "b a B c-a"), (1, "g", "a"), (2, "f", "x y"), (2, "f", "y z"), (None, "f", "n"), (None, "f", "n n"), (3, None, "q q"), (4, "f", None), (5, "f", " .- "), (6, "f", "中文字中文 a"), (7, "f", "a"), (8, "f", "")]
    df = spark.createDataFrame(rows, "k long, field_id string, value string")
    got = retrieval.postings(df, ["k"])
    assert got.dtypes == [("k", "bigint"), ("field_id", "string"), ("term", "string"), ("frequency", "bigint")]
    got = [tuple(r) for r in got.collect()]
    assert len({r[:3] for r in got}) == len(got)
    assert {r[:3]: r[3] for r in got} == counted(rows)


def test_postings_of_keys_in_one_bucket(spark, monkeypatch):
    """Keys that only share a bucket with one of several rows are counted all the same."""
    monkeypatch.setattr(retrieval, "BUCKETS", 1)
    rows = [(i, "f", f"w{i} a w{i}") for i in range(20)] + [(3, "f", "a a")]
    got = retrieval.postings(spark.createDataFrame(rows, "k long, field_id string, value string"), ["k"]).collect()
    assert len(got) == 40 and {tuple(r)[:3]: r["frequency"] for r in got} == counted(rows)


def test_postings_of_single_rows_are_not_shuffled(spark):
    """Terms of a key that comes once stay in its task: what is exchanged are keys' hashes and buckets alone."""
    df = spark.range(500).select(F.col("id").alias("k"), F.lit("f").alias("field_id"), F.concat(F.lit("a b a w"), "id").alias("value"))
    plan = ended_plan(retrieval.postings(df, ["k"]))
    exchanges = [line for line in plan.splitlines() if "hashpartitioning" in line]
    assert "posexplode" in plan and not [line for line in exchanges if "term#" in line]
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_lowered_and_han(spark):
    """Every character, alone and in words, as by the plain forms of the two functions."""
    every = spark.range(0x110000).where("id not between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    plain = F.lower(F.translate("c", "Σİ", "σi"))
    assert every.where(X.lowered(F.col("c")) != plain).count() == 0
    assert every.where(F.col("c").rlike(X.ANY_HAN) != F.col("c").rlike(r"\p{IsHan}")).count() == 0
    assert every.where(F.col("c").rlike(X.ANY_HAN)).count() > 90_000
    words = spark.createDataFrame([("ΟΔΟΣ ΑΣ İI Σ",)], "c string")
    assert words.select(X.lowered(F.col("c"))).first()[0] == words.select(plain).first()[0] == "οδοσ ασ ii σ"
