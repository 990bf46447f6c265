"""Bounded-space online packing of token pieces into windows.

Each partition reads its documents in the order of its files. A document that is longer than a window is
cut into full windows and a rest. A rest goes to the open window that it fills best; if it fits into none
and all of the `open_windows` are in use, the fullest one is emitted: what its gap holds is cut
from the rest to fill it up. At most `open_windows` windows of pieces (not ids) are held at any time.
What is still open at a partition's end goes on to a merge: the pieces of `MERGE` partitions, the longest first, fill
window after window, and the last window goes to the next level, until one group is left, so no task sees more
than a bounded number of pieces and only the very last window is padded. Decisions depend only on the rows' order in their files, so a task that runs again decides alike.

Null text: a document of the end id alone. Repeated rows are packed one by one. Sequence ids are unique but not dense.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, texts
from .tokens import SMALL_CACHE, VOCABULARY, _path, encoder

LENGTH, OPEN, MERGE = 4096, 64, 16
FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean"


class Packer:
    """Open windows by used length. A piece is (doc_id, start, ids as bytes, doc_tokens)."""

    def __init__(self, length: int, most: int) -> None:
        self.length, self.most = length, most
        self.used: list[tuple[int, int]] = []  # (used length, number), sorted
        self.windows: dict[int, list[tuple]] = {}
        self.next = 0
        self.ready: list[tuple[int, list[tuple]]] = []

    def add(self, doc_id: int | None, ids: bytes, start: int = 0, total: int | None = None) -> None:
        total = len(ids) // 4 if total is None else total
        full = 4 * self.length
        while len(ids) >= full:
            self.close([(doc_id, start, ids[:full], total)])
            ids, start = ids[full:], start + self.length
        while ids:
            n = len(ids) // 4
            at = bisect.bisect_right(self.used, (self.length - n, 1 << 62)) - 1  # the fullest that still holds it
            if at >= 0:
                size, k = self.used.pop(at)
                self.windows[k].append((doc_id, start, ids, total))
                if size + n == self.length:
                    self.close(self.windows.pop(k))
                else:
                    bisect.insort(self.used, (size + n, k))
                return
            if len(self.used) < self.most:
                self.windows[self.next] = [(doc_id, start, ids, total)]
                bisect.insort(self.used, (n, self.next))
                self.next += 1
                return
            size, k = self.used.pop()
            gap = self.length - size
            self.close([*self.windows.pop(k), (doc_id, start, ids[: 4 * gap], total)])
            ids, start = ids[4 * gap :], start + gap

    def close(self, pieces: list[tuple]) -> None:
        self.ready.append((self.next, pieces))
        self.next += 1

    def take(self) -> list[tuple[int, list[tuple]]]:
        out, self.ready = self.ready, []
        return out

    def rest(self) -> list[tuple[int, list[tuple]]]:
        return [(k, self.windows[k]) for _, k in self.used]


def _rows(windows: list[tuple[int, list[tuple]]], base: int, is_open: bool, with_ids: bool) -> pa.RecordBatch:
    columns: list[list] = [[] for _ in range(9)]
    for k, pieces in windows:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            for c, v in zip(columns, (doc_id, start, n, zlib.crc32(ids), total, base + k, offset, is_open, ids if with_ids else None), strict=True):
                c.append(v)
            offset += n
    types = [pa.int64()] * 7 + [pa.bool_(), pa.binary()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[*FIELDS, "sequence_id", "offset", "open", "ids"])


def _pack(path: str, end: int, length: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, last, packer = encoder(path, SMALL_CACHE), np.array([end], "<u4").tobytes(), Packer(length, most)
        base = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for doc_id, text in zip(part.column(0).to_pylist(), texts(part.column(1)), strict=True):
                    packer.add(doc_id, own.ids(text) + last)
                yield _rows(packer.take(), base, False, False)
        yield _rows(packer.rest(), base, True, True)

    return run


def _merge(level: int, length: int, final: bool):
    def run(key: tuple, group: pa.Table) -> pa.Table:
        rows = group.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
        packer = Packer(length, 1)  # one window at a time is filled to the end
        for r in sorted(rows, key=lambda r: -r["length"]):  # stable
            packer.add(r["doc_id"], r["ids"], r["start"], r["doc_tokens"])
        base = (level << 56) | (key[0].as_py() << 32)
        parts = [_rows(packer.take(), base, False, False), _rows(packer.rest(), base, not final, not final)]
        return pa.Table.from_batches(parts)

    return run


def pack(docs: DataFrame, end: int = 2, length: int = LENGTH, open_windows: int = OPEN, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small_batches(docs.sparkSession)
    schema = SCHEMA + ", ids binary"
    first, _ = stored(docs.mapInArrow(_pack(_path(vocabulary), end, length, open_windows), schema), "packed")
    done = [first.where("not open").drop("open", "ids")]
    left, level = first.where("open"), 1
    groups = 1 + ((left.agg(F.max("sequence_id")).first()[0] or 0) >> 32)
    while True:
        groups = -(-groups // MERGE)
        final = groups == 1
        number = F.expr("cast(((sequence_id & 72057594037927935) >> 32) div {} as int)".format(MERGE))
        merged = left.groupBy(number.alias("g")).applyInArrow(_merge(level, length, final), schema)
        merged, _ = stored(merged, "merged")
        done.append(merged.where("not open").drop("open", "ids"))
        if final:
            break
        left, level = merged.where("open"), level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out
