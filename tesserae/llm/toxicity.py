"""Toxicity classifier with counterfactual regularisation.

Features of a text are its distinct lower-cased words and the words' beginnings of three to six letters. A bounded sample
of labelled rows (`per_class` of each label, by hash of the id) trains it: features are counted by label over the cluster, the
`n_features` with the highest G statistic are kept, and identity terms besides. Every sentence of a training text that has identity
terms is repeated with each term exchanged for another of its group; logistic loss plus `weight` times the squared change
of the logit between text and counterfactual is minimised with an L1 penalty (accelerated proximal gradient), so that mention of a group
moves no score by itself.

Scores see the text alone. Null and empty texts get the score of no features. Labels: repeated ids count once with their
largest label, null labels not at all; an empty sample gives the score 0.5 to all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, released, small_batches, stored

# Identity terms by group. Terms of a group stand for one another.
IDENTITY = {
    "gender": "woman women man men girl girls boy boys female male transgender nonbinary frau frauen mann mädchen femme femmes homme hommes fille mujer mujeres hombre hombres niña niño".split(),
    "religion": "muslim muslims christian christians jewish jews hindu hindus buddhist buddhists atheist atheists catholic catholics protestant sikh muslime christen juden musulman chrétien juif musulmán cristiano judío".split(),
    "origin": "black white asian african european american mexican arab latino indian chinese immigrant immigrants refugee refugees foreigner foreigners ausländer flüchtling étranger réfugié extranjero inmigrante".split(),
    "orientation": "gay lesbian bisexual straight heterosexual homosexual queer schwul lesbisch lesbienne lesbiana".split(),
    "condition": "disabled blind deaf autistic elderly old young behindert handicapé discapacitado".split(),
}
_OTHER = {w: (group, k) for group in IDENTITY.values() for k, w in enumerate(group)}
PER_CLASS, N_FEATURES, WEIGHT, L1, STEPS = 6_000, 2_000, 1.0, 3e-4, 400
THRESHOLD = 0.7
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def parts(word: str) -> list[str]:
    return [word, *(word[:n] + "-" for n in range(3, min(7, len(word))))]


def features(words: set[str]) -> set[str]:
    return {f for w in words for f in parts(w)}


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def counterfactual(text: str) -> set[str] | None:
    """Words of the text with each sentence's identity terms exchanged; None without any."""
    out, changed = set(), False
    for sentence in _SENTENCE.findall(text.lower()):
        turn = xxhash.xxh32_intdigest(sentence.encode())
        for w in _WORD.findall(sentence):
            if w in _OTHER:
                group, k = _OTHER[w]
                w = group[(k + 1 + turn % (len(group) - 1)) % len(group)]
                changed = True
            out.add(w)
    return out if changed else None


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            found = [sorted(features(words_of(t))) for t in part.column(1).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(found, pa.list_(pa.string()))], names=["label", "f"])


def _indexed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            x, c = [], []
            for t in batch.column(1).to_pylist():
                x.append(sorted({index[f] for f in features(words_of(t)) if f in index}))
                other = counterfactual(t) if t else None
                c.append(None if other is None else sorted({index[f] for f in features(other) if f in index}))
            yield pa.record_batch([batch.column(0), pa.array(x, pa.list_(pa.int32())), pa.array(c, pa.list_(pa.int32()))], names=["label", "x", "c"])

    return run


def _matrix(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = [len(r) for r in rows]
    return np.repeat(np.arange(len(rows)), sizes), np.array([i for r in rows for i in r], np.int64)


def fit_logistic(x: list[list[int]], y: np.ndarray, pairs: list[tuple[list[int], list[int]]], n: int, weight: float = WEIGHT, l1: float = L1, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and intercept minimising mean logistic loss + weight * mean squared logit change over pairs + l1 * |w|."""
    rows, cols = _matrix(x)
    ra, ca = _matrix([a for a, _ in pairs])
    rb, cb = _matrix([b for _, b in pairs])
    m, k = len(y), max(1, len(pairs))
    u, ub, bound = np.cos(np.arange(n) * 2.4), 1.0, 1.0
    for _ in range(30):  # power iteration: the largest curvature bounds the step
        z = (np.bincount(rows, u[cols], m) + ub) / m / 4
        d = np.bincount(ra, u[ca], len(pairs)) - np.bincount(rb, u[cb], len(pairs))
        h = np.bincount(cols, z[rows], n) + 2 * weight / k * (np.bincount(ca, d[ra], n) - np.bincount(cb, d[rb], n))
        hb = float(z.sum())
        bound = max(1e-3, float(np.sqrt(h @ h + hb * hb)))
        u, ub = h / bound, hb / bound
    step = 1 / (1.2 * bound)
    w, b = np.zeros(n), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    v, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, v[cols], m) + vb, -30, 30)))
        g = np.bincount(cols, ((p - y) / m)[rows], n)
        gb = float((p - y).mean())
        if pairs:
            d = np.bincount(ra, v[ca], len(pairs)) - np.bincount(rb, v[cb], len(pairs))
            g += 2 * weight / k * (np.bincount(ca, d[ra], n) - np.bincount(cb, d[rb], n))
        new = v - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        nb, nt = vb - step * gb, (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, vb = new + (t - 1) / nt * (new - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = new, nb, nt
    return w, b


class Model:
    def __init__(self, weights: dict[str, float], intercept: float) -> None:
        self.weights, self.intercept = weights, intercept

    def score(self, text: str | None) -> float:
        return self.of(words_of(text), {})

    def of(self, words: set[str], cache: dict) -> float:
        found = set()
        for w in words:
            hits = cache.get(w)
            if hits is None:
                hits = cache[w] = tuple(f for f in parts(w) if f in self.weights)
            if hits:
                found.update(hits)
        z = self.intercept + sum(self.weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def sample(labels: DataFrame, label: str, usable: Column, per_class: int) -> DataFrame:
    """(doc_id, label): at most `per_class` rows of each label, by hash of the id."""
    rows = labels.where(usable & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    part = lambda k: rows.where(F.col("label") == k).orderBy(F.xxhash64("__id"), "__id").limit(per_class)
    return part(0).union(part(1))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int) -> DataFrame:
    """(label, text) of the sample, whose size is bounded, so it is broadcast."""
    chosen, _ = stored(sample(labels, label, usable, per_class), "sample")
    own = docs.select(F.col("doc_id").cast("long").alias("__id"), F.col("text").cast("string").alias("text"))
    rows = own.join(F.broadcast(chosen), "__id").select("label", "text")
    return stored(rows, "training")[0]


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", per_class: int = PER_CLASS, n_features: int = N_FEATURES, weight: float = WEIGHT) -> Model:
    spark = docs.sparkSession
    rows = training_rows(docs, labels, label, usable, per_class)
    totals = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    if not n0 or not n1:
        return Model({}, 0.0 if n0 == n1 else (20.0 if n1 else -20.0))
    counted = rows.mapInArrow(_listed, "label int, f array<string>").select("label", F.explode("f").alias("f")).groupBy("f").agg(F.sum("label").alias("a"), F.count("*").alias("n")).where("n >= 3")
    a, n, share = F.col("a"), F.col("n"), n1 / (n0 + n1)
    g = 2 * (F.when(a > 0, a * F.log(a / (n * share))).otherwise(0.0) + F.when(n > a, (n - a) * F.log((n - a) / (n * (1 - share)))).otherwise(0.0))
    best, _ = stored(counted.select("f", g.alias("g")).orderBy(F.desc("g"), "f").limit(n_features), "features")  # else each partition sends the driver as many
    kept = [r["f"] for r in best.collect()]
    names = sorted({*kept, *features(set(_OTHER))})
    shared = spark.sparkContext.broadcast({f: k for k, f in enumerate(names)})
    found = rows.mapInArrow(_indexed(shared), "label int, x array<int>, c array<int>").orderBy("label", F.xxhash64("x")).toPandas()
    x = [list(r) for r in found["x"]]
    pairs = [(a, list(c)) for a, c in zip(x, found["c"], strict=True) if c is not None]
    w, b = fit_logistic(x, found["label"].to_numpy(np.float64), pairs, len(names), weight)
    return Model({f: float(v) for f, v in zip(names, w, strict=True) if v}, b)


CACHE = 50_000


def _score(shared, at: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = shared.value, {}
        for batch in batches:
            scores = []
            for t in batch.column(at).to_pylist():
                scores.append(model.of(words_of(t), cache))
                if len(cache) > CACHE:
                    cache.clear()
            yield pa.record_batch([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, name])
        cache.clear()
        released()

    return run


def scored(docs: DataFrame, model: Model, name: str = "__score") -> DataFrame:
    """The rows with all their columns and `name`, which they mustn't have yet."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{name}` double"
    return docs.mapInArrow(_score(shared, docs.columns.index("text"), name), schema)


def remove_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold, unchanged."""
    name = fresh(docs, "score")
    return scored(docs, model, name).where(F.col(name) < threshold).drop(name)
