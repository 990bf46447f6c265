"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Words are runs of ASCII letters, digits and non-ASCII characters; A-Z are lower-cased. Every `window` consecutive
item words are a window (an item of fewer words is one window, an item without words has none). The automaton's
patterns are the short items and, of the others, every run of (window + 1) / 2 words that starts at a multiple of that:
each window holds one of these whole, so the automaton's nodes are one to three for each word of the items. A text is read once; where a run occurs, the words beside it tell whether it lies in a window of an item.
Runs with the same words beside them are one entry, so items made from one template cost no more. Word numbers are mapped
back to code points of the original text.

The items' texts are broadcast, at most `MOST_BYTES` of them for one automaton (some 20 times that in a worker, which builds it
once). A larger benchmark is dealt into several automata, through which the documents pass one after the other, each adding its hits.

Null text: no words, never contaminated. Null or wordless items: no windows. Repeated item ids count once,
their windows together; null item ids take no part. Repeated document rows are judged one by one.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, released, small_batches, texts

WINDOW = 13
MOST_BYTES = 32_000_000
MOST_LETTERS = 400  # children of a node are searched one after the other
_SPACES = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
HITS = {"n_words": "long", "hits": "array<int>", "items": "array<long>", "spans": "array<struct<start:int,end:int>>"}
_TYPES = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_SPACES).split() if text else []


class Machine:
    """The automaton of (item id, text) rows. A word is written as `digits` letters from separate ranges, so that matches keep to
    word borders and a node has few children."""

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW) -> None:
        self.window, self.run = window, (window + 1) // 2
        side = window - self.run
        numbers: dict[bytes, int] = {}
        flat, ends, owners = array("i", [0] * window), [], []  # all items' words, with gaps that no window bridges
        for item, text in items:
            flat.extend(numbers.setdefault(w, len(numbers) + 1) for w in words_of(text))
            ends.append(len(flat))
            owners.append(item)
            flat.extend([0] * window)
        words = self.flat = np.frombuffer(flat, np.int32)
        starts = np.concatenate(([0], np.array(ends[:-1], np.int64))) + window if ends else np.zeros(0, np.int64)
        sizes = np.array(ends, np.int64) - starts
        self.digits = next(d for d in range(1, 9) if (MOST_LETTERS**d) > len(numbers))
        base = 1
        while base**self.digits <= len(numbers):
            base += 1
        code = lambda n: "".join(chr(1 + k * base + n // base**k % base) for k in range(self.digits))
        self.codes = {w: code(n) for w, n in numbers.items()}
        letters = [code(n) for n in range(len(numbers) + 1)]
        self.unknown = chr(0) * self.digits
        runs = np.concatenate([np.arange(s, s + n - self.run + 1, self.run) for s, n in zip(starts, sizes, strict=True) if n >= window] or [np.zeros(0, np.int64)])
        short = np.flatnonzero((sizes > 0) & (sizes < window))
        # occurrences of patterns with equal words beside them are one entry with several items
        owner = np.searchsorted(np.array(ends, np.int64), runs, "right")
        groups: dict[bytes, list[int]] = {}
        for at, k in zip(runs.tolist(), owner.tolist(), strict=True):
            groups.setdefault(words[at - side : at + self.run + side].tobytes(), []).append(k)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.entries: list[list[tuple[int, tuple, tuple, list[int]]]] = []  # by pattern: (words, words before, words behind, items)

        def add(own: np.ndarray, before: tuple, behind: tuple, ids: list[int]) -> None:
            key = "".join([letters[n] for n in own.tolist()])
            at = self.automaton.get(key, -1)
            if at < 0:
                at = len(self.entries)
                self.automaton.add_word(key, at)
                self.entries.append([])
            self.entries[at].append((len(own), before, behind, ids))

        for key, mine in groups.items():
            around = np.frombuffer(key, np.int32)
            add(around[side : side + self.run], tuple(around[:side][::-1].tolist()), tuple(around[side + self.run :].tolist()), sorted({owners[k] for k in mine}))
        for k in short.tolist():
            add(words[starts[k] : ends[k]], (), (), [owners[k]])
        self.numbers = numbers
        if self.entries:
            self.automaton.make_automaton()

    def scan(self, text: bytes | None) -> tuple[int, list[int], list[int]]:
        """Number of words, sorted numbers of hit words, sorted item ids."""
        words = words_of(text)
        if not words or not self.entries:
            return len(words), [], []
        step, items = None, set()
        for end, at in self.automaton.iter("".join(map(self.codes.get, words, repeat(self.unknown)))):
            last = (end + 1) // self.digits
            for n, before, behind, ids in self.entries[at]:
                left, right = last - n, last
                for x in before:
                    if not left or self.numbers.get(words[left - 1], -1) != x:
                        break
                    left -= 1
                for x in behind:
                    if right == len(words) or self.numbers.get(words[right], -1) != x:
                        break
                    right += 1
                if not behind or right - left >= self.window:  # a short item has nothing beside it
                    if step is None:
                        step = np.zeros(len(words) + 1, np.int64)
                    step[left] += 1
                    step[right] -= 1
                    items.update(ids)
        if step is None:
            return len(words), [], []
        return len(words), np.flatnonzero(np.cumsum(step[:-1]) > 0).tolist(), sorted(items)


def spans_of(text: str, hits: list[int]) -> list[dict]:
    """Runs of hit words as code points of the original text, end exclusive."""
    places = [m.span() for m in _WORD.finditer(text.translate(_LOWER))]
    out: list[dict] = []
    for k, word in enumerate(hits):
        if k and hits[k - 1] == word - 1:
            out[-1]["end"] = places[word][1]
        else:
            out.append({"start": places[word][0], "end": places[word][1]})
    return out


_HELD: dict[str, Machine] = {}


def _machine(key: str, shared, window: int) -> Machine:
    """Built once a worker, which keeps the one it used last."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Machine(shared.value, window)
    return _HELD[key]


def _scanner(shared, window: int, text_at: int, names: list[str], first: bool, with_spans: bool):
    """Adds the hits of one block of items in the last four columns."""
    width, key = len(names) - len(HITS), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(key, shared, window)
        for batch in batches:
            raw = texts(batch.column(text_at))
            found = [machine.scan(t) for t in raw]
            if not first:
                old = zip(batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist(), strict=True)
                found = [(n, sorted({*h, *a}), sorted({*i, *b})) for (n, h, i), (a, b) in zip(found, old, strict=True)]
            spans = [spans_of(t.decode("utf-8"), h) if with_spans and h else [] for t, (_, h, _) in zip(raw, found, strict=True)]
            new = [*map(list, zip(*found, strict=True)), spans] if found else [[]] * 4
            yield pa.record_batch([*batch.columns[:width], *map(pa.array, new, _TYPES)], names=names)
        released()

    return run


def _blocks(benchmark: DataFrame, window: int, most_bytes: int) -> list:
    """Broadcast items, in as many blocks as their bytes ask for."""
    spark = benchmark.sparkSession
    small_batches(spark)
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // most_bytes))
    out = []
    for k in range(parts):
        block = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        out.append(spark.sparkContext.broadcast(sorted((r[0], r[1].encode()) for r in block.toLocalIterator())))
    return out


def with_hits(docs: DataFrame, benchmark: DataFrame, names: dict[str, str], window: int = WINDOW, most_bytes: int = MOST_BYTES, with_spans: bool = True) -> DataFrame:
    """The rows with all their columns and those of HITS, by the names given for them."""
    out = docs.withColumn("text", F.col("text").cast("string"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in out.dtypes), *(f"`{names[c]}` {t}" for c, t in HITS.items())])
    blocks = _blocks(benchmark, window, most_bytes)
    for k, shared in enumerate(blocks):
        out = out.mapInArrow(_scanner(shared, window, docs.columns.index("text"), [*docs.columns, *(names[c] for c in HITS)], k == 0, with_spans and k == len(blocks) - 1), schema)
    return out


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id and text of every row with n_words, hits (word numbers), items (item ids) and spans of the original text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_hits(docs, benchmark, {c: c for c in HITS}, window, most_bytes)


CONTAMINATED = "size(hits) > 0 and 20 * size(hits) >= n_words"


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows whose hit words are less than a twentieth of their words, unchanged and with all their columns."""
    names = {c: fresh(docs, c) for c in HITS}
    out = with_hits(docs, benchmark, names, window, most_bytes, with_spans=False)
    n_hit = F.size(names["hits"])
    return out.where((n_hit == 0) | (20 * n_hit < F.col(names["n_words"]))).select(*docs.columns)
