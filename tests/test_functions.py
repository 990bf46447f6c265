import random

import pytest
from pyspark.sql import functions as F

from tesserae import functions as X


def naive_terms(text):
    out, word, han = [], "", ""

    def is_han(c):
        return "一" <= c <= "鿿"

    def flush():
        nonlocal word, han
        if word:
            out.append(word.lower())
        if han:
            out.extend([han] if len(han) == 1 else [han[i : i + 2] for i in range(len(han) - 1)])
        word = han = ""

    for c in text:
        if is_han(c):
            if word:
                flush()
            han += c
        elif c.isalpha() or c.isdecimal():
            if han:
                flush()
            word += c
        else:
            flush()
    flush()
    return out


def test_terms(spark):
    rng = random.Random(5)
    texts = ["", "Ab1 cd-EF", "中文字 x中y", "中", "a中b文字", "é.È 12,3"] + ["".join(rng.choice("aB1 中文é-") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", X.terms(F.col("t")).alias("x"), X.unique_terms(F.col("t")).alias("u")).collect():
        assert r["x"] == naive_terms(r["t"])
        assert r["u"] == list(dict.fromkeys(r["x"]))


@pytest.mark.parametrize("a, b", [(7, 2), (-7, 2), (7, -2), (-7, -2), ((1 << 63) - 1, -1), (-(1 << 63), 3)])
def test_division(spark, a, b):
    q, r = spark.createDataFrame([(a, b)], "a long, b long").select(X.int_divide(F.col("a"), F.col("b")), X.int_remainder(F.col("a"), F.col("b"))).first()
    assert q == abs(a) // abs(b) * (1 if (a < 0) == (b < 0) else -1)
    assert q * b + r == a


@pytest.mark.parametrize("f", [X.int_divide, X.int_remainder])
@pytest.mark.parametrize("b", [0, -1])
def test_division_errors(spark, f, b):
    with pytest.raises(Exception, match="(?i)zero|overflow"):
        spark.createDataFrame([(-(1 << 63), b)], "a long, b long").select(f(F.col("a"), F.col("b"))).collect()


def test_small_functions(spark):
    row = spark.createDataFrame([(" Ab ", "x-3.5% +2", None)], "a string, n string, z boolean").select(
        X.canonical(F.col("a")), X.numeric_tokens(F.col("n")), X.two_valued(F.col("z") == F.lit(True)), X.normalize_words(F.lit("The, BIG  cat!")), X.join_path(F.lit("/"), F.lit("a")), X.join_path(F.lit("/a"), F.lit("b"))
    )
    assert list(row.first()) == ["ab", ["-3.5%", "+2"], False, "the big cat", "/a", "/a/b"]
