"""Document quality from a linear-chain conditional random field over lines.

Every line has categorical features (length, shares of symbols, capitals and digits, bars, repeated words, repeats of earlier
lines and so on) and the same of the lines before and after it. The field has two labels, bad and good, weights for each
feature value, and weights for each pair of neighbouring labels. It is fitted on all lines of a bounded sample of labelled rows
(`per_class` of each label, by hash of the id; the driver holds 16 bytes a line of them); a document's label stands for
all of its lines. A document's quality is the mean of its lines' marginals from the forward-backward recursion, weighted
by their lengths; two more weights, fitted on the same sample, map it to a probability.

Scores read whole texts and nothing else. Null and empty texts are one empty line. Labels: repeated ids count once with their
largest label, null labels not at all; without both labels in the sample all scores are 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts
from .toxicity import training_rows

PER_CLASS, STEPS, L2 = 3_000, 150, 1e-3
RUN, SLICE = 64, 100_000
THRESHOLD = 0.3
_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_LETTER = bytes(c for c in range(256) if not (chr(c).isalpha() and c < 128 or c >= 128))
_DIGIT = bytes(c for c in range(256) if not 48 <= c <= 57)
_SYMBOL = bytes(c for c in range(256) if chr(c) not in "#$%&*^~|<>=+_@\\/{}[]!")
_LENGTHS = (1, 10, 25, 60, 120, 240, 600, 2000)
_WORDS = (1, 2, 4, 8, 16, 40, 120, 400)
_SHARES = (0.001, 0.01, 0.03, 0.06, 0.1, 0.2, 0.3, 0.5, 0.8)
#: Values of each feature, in the order of `line_features`.
SIZES = (9, 9, 10, 10, 10, 10, 10, 10, 3, 3, 3, 8)
OWN = len(SIZES)
_FIRST = np.concatenate(([0], np.cumsum(SIZES)))
N_OWN = int(_FIRST[-1])
N_FEATURES = 3 * N_OWN + 3


def _bin(x: float, edges: tuple) -> int:
    k = 0
    for e in edges:
        if x < e:
            break
        k += 1
    return k


def line_features(line: bytes, seen: dict[bytes, int]) -> list[int]:
    n = max(1, len(line))
    words = line.split()
    m = max(1, len(words))
    letters = max(1, len(line.translate(None, _LETTER)))
    symbols = len(line.translate(None, _SYMBOL)) / n
    adjacent = sum(map(bytes.__eq__, words, words[1:])) / m if m > 1 else 0.0
    times = seen.get(line, 0)
    seen[line] = times + 1
    end = line[-1:]
    return [
        _bin(len(line), _LENGTHS), _bin(len(words), _WORDS), _bin(symbols, _SHARES), _bin(len(line.translate(None, _UPPER)) / letters, _SHARES), _bin(len(line.translate(None, _DIGIT)) / n, _SHARES),
        _bin(1 - len(set(words)) / m, _SHARES), _bin(adjacent, _SHARES), _bin(line.count(b"|") / m, _SHARES), min(2, line.count(b"!!")), min(2, times), 0 if end in b".!?\"" and end else 1 if end.isalnum() else 2, min(7, int(len(line) / m / 2)),
    ]


def document_features(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """(values of each line's own features, lengths)."""
    lines = (text or b"").split(b"\n")
    seen: dict[bytes, int] = {}
    return np.array([line_features(x, seen) for x in lines], np.uint8), np.array([len(x) + 1 for x in lines], np.float32)


class Lines:
    """Lines of documents one after another."""

    def __init__(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> None:
        self.sizes = np.array([len(n) for _, n in docs], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)[:-1]))
        self.own = np.concatenate([x for x, _ in docs])
        self.lengths = np.concatenate([n for _, n in docs]).astype(np.float64)
        self.first = np.zeros(len(self.own), bool)
        self.first[self.starts] = True
        self.last = np.append(self.first[1:], True)

    def emission(self, w: np.ndarray) -> np.ndarray:
        """Log odds of good by line, from the line's features, its neighbours' and its place."""
        own, before, after = (np.empty(len(self.own)) for _ in range(3))
        for at in range(0, len(self.own), SLICE):
            part = slice(at, at + SLICE)
            index = self.own[part] + _FIRST[:-1]
            for k, out in enumerate((own, before, after)):
                out[part] = w[index + k * N_OWN].sum(axis=1)
        out = own + np.where(self.first, 0, np.roll(before, 1)) + np.where(self.last, 0, np.roll(after, -1))
        return out + self.places() @ w[3 * N_OWN :]

    def places(self) -> np.ndarray:
        return np.stack([self.first & ~self.last, self.last & ~self.first, self.first & self.last], axis=1).astype(np.float64)

    def gradient(self, r: np.ndarray) -> np.ndarray:
        """Sums of r, one number a line, by feature."""
        out = np.zeros(N_FEATURES)
        left = np.where(self.last, 0, np.roll(r, -1))  # a line's features count for the line after it
        right = np.where(self.first, 0, np.roll(r, 1))
        for at in range(0, len(r), SLICE):
            index = (self.own[at : at + SLICE] + _FIRST[:-1]).ravel()
            for k, x in enumerate((r, left, right)):
                out[k * N_OWN : (k + 1) * N_OWN] += np.bincount(index, np.repeat(x[at : at + SLICE], OWN), N_OWN)
        out[3 * N_OWN :] = r @ self.places()
        return out


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices (00, 01, 10, 11), scaled to a largest element of 1."""
    out = np.stack([a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]])
    return out / out.max(axis=0)


def _running(m: np.ndarray) -> np.ndarray:
    """Running products of matrices: within runs of `RUN` side by side, then of the runs, so that one long document takes few steps."""
    n = m.shape[1]
    if n <= RUN:
        m = m.copy()
        for k in range(1, n):
            m[:, k] = _times(m[:, k - 1], m[:, k])
        return m
    blocks = -(-n // RUN)
    x = np.zeros((4, blocks * RUN))
    x[:, :n], x[0, n:], x[3, n:] = m, 1.0, 1.0
    x = x.reshape(4, blocks, RUN)
    for k in range(1, RUN):
        x[:, :, k] = _times(x[:, :, k - 1], x[:, :, k])
    x[:, 1:] = _times(_running(x[:, :, -1])[:, :-1, None], x[:, 1:])
    return x.reshape(4, -1)[:, :n]


def marginals(emission: np.ndarray, sizes: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of documents one after another in `emission` (log odds of good by line): log odds of good given all lines,
    and the expected number of each label pair. A document's first matrix has equal rows, so nothing passes from one to the next."""
    first = np.zeros(len(emission), bool)
    first[np.concatenate(([0], np.cumsum(sizes)[:-1]))] = True
    last = np.append(first[1:], True)
    pair, emission = np.clip(pair, -30, 30), np.clip(emission, -30, 30)
    e, t = np.exp(emission), np.exp(pair)
    one = np.ones_like(e)
    forward = np.stack([np.where(first, 1, t[0, 0] * one), np.where(first, e, t[0, 1] * e), np.where(first, 1, t[1, 0] * one), np.where(first, e, t[1, 1] * e)])
    p = _running(forward / forward.max(axis=0))
    after = np.roll(e, -1)
    back = np.stack([np.where(last, 1, t[0, 0] * one), np.where(last, 1, t[1, 0] * one), np.where(last, 1, t[0, 1] * after), np.where(last, 1, t[1, 1] * after)])
    q = _running((back / back.max(axis=0))[:, ::-1])[:, ::-1]
    a, b = (np.log(np.maximum(x[1] + x[3], 1e-300)) - np.log(np.maximum(x[0] + x[2], 1e-300)) for x in (p, q))
    expected = np.zeros((2, 2))
    i = np.flatnonzero(~first)
    if len(i):
        joint = np.stack([np.full(len(i), pair[0, 0]), pair[0, 1] + emission[i] + b[i], a[i - 1] + pair[1, 0], a[i - 1] + pair[1, 1] + emission[i] + b[i]])
        joint = np.exp(joint - joint.max(axis=0))
        joint /= joint.sum(axis=0)
        expected = joint.sum(axis=1).reshape(2, 2)
    return a + b, expected


class Model:
    def __init__(self, weights: np.ndarray, pair: np.ndarray, slope: float = 1.0, shift: float = 0.0) -> None:
        self.weights, self.pair, self.slope, self.shift = weights, pair, slope, shift

    def raw(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Log odds of the length-weighted mean marginal of each document."""
        if not docs:
            return np.zeros(0)
        lines = Lines(docs)
        odds, _ = marginals(lines.emission(self.weights), lines.sizes, self.pair)
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        mean = (np.add.reduceat(p * lines.lengths, lines.starts) / np.add.reduceat(lines.lengths, lines.starts)).clip(1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean))

    def scores(self, docs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(docs) + self.shift, -30, 30)))


def fit(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, share: float, steps: int = STEPS, l2: float = L2) -> Model:
    """Maximum likelihood of constant label chains (Adam), classes weighted alike, then the map to probabilities with the true `share` of good."""
    lines = Lines(docs)
    y = np.repeat(labels, lines.sizes)
    scale = np.repeat(1 / lines.sizes, lines.sizes) / len(docs)  # each document counts once
    inner = ~lines.first
    n_inner = max(1, inner.sum())
    same = np.array([[((1 - y)[inner]).sum(), 0.0], [0.0, y[inner].sum()]])
    theta = np.zeros(N_FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, pair = theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2)
        odds, expected = marginals(lines.emission(w), lines.sizes, pair)
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        grad = np.concatenate([lines.gradient((p - y) * scale) + l2 * w, ((expected - same) / n_inner + 0.3 * pair).ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    model = Model(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2))
    halves = [(labels == k) for k in (0.0, 1.0)]
    z = model.raw(docs)
    slope, shift = 1.0, 0.0
    weight = np.where(labels == 1, share / max(1, halves[1].sum()), (1 - share) / max(1, halves[0].sum()))
    for _ in range(50):  # Newton steps, damped
        p = 1 / (1 + np.exp(-np.clip(slope * z + shift, -30, 30)))
        r, h = weight * (p - labels), weight * p * (1 - p) + 1e-9
        a = np.array([[(h * z * z).sum() + 1e-4, (h * z).sum()], [(h * z).sum(), h.sum() + 1e-4]])
        d = np.linalg.solve(a, np.array([(r * z).sum() + 1e-4 * (slope - 1), r.sum()]))
        d *= min(1.0, 2.0 / max(1e-9, np.abs(d).max()))
        slope, shift = slope - d[0], shift - d[1]
    model.slope, model.shift = max(float(slope), 1e-3), float(shift)
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", per_class: int = PER_CLASS) -> Model | None:
    rows = training_rows(docs, labels, label, usable, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [document_features(t) for t in texts(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array([f.tobytes() for f, _ in found], pa.binary()), pa.array([n.tobytes() for _, n in found], pa.binary())], names=["label", "x", "n"])

    got = rows.mapInArrow(run, "label int, x binary, n binary").orderBy("label", F.xxhash64("x", "n")).toPandas()
    y = got["label"].to_numpy(np.float64)
    if not len(y) or y.min() == y.max():
        return None
    found = [(np.frombuffer(x, np.uint8).reshape(-1, OWN), np.frombuffer(n, np.float32)) for x, n in zip(got["x"], got["n"], strict=True)]
    share = labels.where(usable).agg(F.avg(F.col(label).cast("double"))).first()[0]
    return fit(found, y, float(share))


def _score(shared, at: int, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                scores = model.scores([document_features(t) for t in texts(part.column(at))]) if model else np.full(part.num_rows, 0.5)
                yield pa.record_batch([*part.columns, pa.array(scores, pa.float64())], names=[*part.schema.names, name])

    return run


def scored(docs: DataFrame, model: Model | None, name: str = "__score") -> DataFrame:
    """The rows with all their columns and `name`, which they mustn't have yet."""
    docs = docs.withColumn("text", F.col("text").cast("string"))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{name}` double"
    return docs.mapInArrow(_score(shared, docs.columns.index("text"), name), schema)
