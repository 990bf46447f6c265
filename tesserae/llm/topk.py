"""Exact top-k by inner product of scaled integer vectors, by distributed histogram selection.

Queries are taken in blocks of bounded bytes, each broadcast by itself; every candidate is scored against the block
where it lies, in each pass, an Arrow batch of candidates and a part of the block at a time. A pass counts scores of every query in a
histogram of `BINS` equal bins over the query's current range; of a batch only the bins down to its own k-th score are handed
on, since the k-th of all can't be lower. The counts are summed over the cluster and the bin with the k-th highest score becomes
the next range, until it is one value. The first range is what the Cauchy-Schwarz inequality allows, from the largest
candidate norm. Then scores above the k-th value are kept, and of those equal to it the smallest ids that are
needed, cut to that number in each task already, so a vector that repeats without end costs no more.

Scores are exact: products are summed in double precision where the largest possible score is below 2^53, else in whole
numbers of any size; only a score that itself doesn't fit into 64 bits raises an error. Vectors that are null, empty or hold null or non-finite components take no
part, nor do null ids; vectors of different lengths have no score. Candidates with the query's own id are the query itself.
A repeated query id asks once, with its smallest vector; repeated candidates are ranked one by one, as equals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import remove, small_batches, stored

SCALE, BINS, BLOCK_BYTES, CELLS, PART = 1024, 1024, 16_000_000, 1_000_000, 1000
MOST = (1 << 63) - 1


def scaled(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, v: whole numbers as doubles, norm2) of the vectors that take part."""
    v = F.col(embedding).cast("array<double>")
    usable = F.col(vec_id).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    out = vectors.where(usable).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda x: F.call_function("floor", x * F.lit(float(SCALE))).cast("double")).alias("v"))
    return out.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))


class Block:
    """Queries of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors


def _tiles(batch: pa.RecordBatch, blocks: dict[int, Block]) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    """(length, part of the block's queries, candidate ids, vectors)."""
    lists = batch.column(1)
    offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    ids, sizes = batch.column(0).to_numpy(), np.diff(offsets)
    for d in np.unique(sizes):
        if int(d) in blocks:
            rows = np.flatnonzero(sizes == d)
            matrix = values[offsets[rows][:, None] + np.arange(d)]
            for at in range(0, len(blocks[int(d)].ids), PART):
                yield int(d), slice(at, at + PART), ids[rows], matrix


def _scores(asking: np.ndarray, queries: np.ndarray, ids: np.ndarray, matrix: np.ndarray, exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(candidate ids, scores by query and candidate), a bounded number at a time."""
    step = max(1, CELLS // len(queries))
    for at in range(0, len(ids), step):
        part = matrix[at : at + step]
        if exact:
            s = queries @ part.T
        else:
            s = np.array([[sum(int(a) * int(b) for a, b in zip(q, m, strict=True)) for m in part] for q in queries], dtype=object)
            s[ids[None, at : at + step] == asking[:, None]] = 0  # a query's score with itself isn't asked for
            if s.size and max(abs(s.min()), abs(s.max())) > MOST:
                raise OverflowError("a score doesn't fit into 64 bits")
        yield ids[at : at + step], s.astype(np.int64)


def _count(shared, exact: bool, bins: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, bounds = shared.value
        for batch in batches:
            for d, part, ids, matrix in _tiles(batch, blocks):
                own = blocks[d].ids[part]
                low, width, high = (bounds[d][part, c : c + 1] for c in range(3))
                n = len(own)
                counts = np.zeros((n, bins + 1), np.int64)
                for some, s in _scores(own, blocks[d].vectors[part], ids, matrix, exact):
                    place = np.minimum((s.astype(np.uint64) - low.astype(np.uint64)) // width.astype(np.uint64), bins - 1).astype(np.int64)
                    place = np.where(s > high, bins, place)
                    place[(some[None, :] == own[:, None]) | (s < low)] = -1
                    flat = (place + np.arange(n)[:, None] * (bins + 1))[place >= 0]
                    counts += np.bincount(flat, minlength=n * (bins + 1)).reshape(n, bins + 1)
                above = counts[:, ::-1].cumsum(axis=1)[:, ::-1] - counts
                counts[above >= k] = 0
                q, b = np.nonzero(counts)
                yield pa.record_batch([pa.array(own[q]), pa.array(b.astype(np.int32)), pa.array(counts[q, b])], names=["query_id", "bin", "n"])

    return run


def _select(shared, exact: bool):
    """Scores over the k-th, and of those equal to it the needed number of smallest ids in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, bounds = shared.value
        ties: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for d, part, ids, matrix in _tiles(batch, blocks):
                asking = blocks[d].ids[part]
                kth, need = bounds[d][part, 0], bounds[d][part, 1]
                for some, s in _scores(asking, blocks[d].vectors[part], ids, matrix, exact):
                    own = some[None, :] == asking[:, None]
                    q, c = np.nonzero((s > kth[:, None]) & ~own)
                    yield pa.record_batch([pa.array(asking[q]), pa.array(some[c]), pa.array(s[q, c])], names=["query_id", "vec_id", "score"])
                    equal = (s == kth[:, None]) & ~own & (need > 0)[:, None]
                    for j in np.flatnonzero(equal.any(axis=1)):
                        at = (d, part.start + int(j))
                        ties[at] = np.sort(np.concatenate([ties.get(at, some[:0]), some[equal[j]]]))[: need[j]]
        for (d, j), found in ties.items():
            n = len(found)
            yield pa.record_batch([pa.array(np.full(n, blocks[d].ids[j])), pa.array(found), pa.array(np.full(n, bounds[d][j, 0]))], names=["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of every query, ties to the smaller vec_id."""
    spark = vectors.sparkSession
    small_batches(spark)
    rows, rows_path = stored(scaled(vectors), "vectors")
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    longest = rows.agg(F.max("norm2").alias("n"), F.max(F.size("v")).alias("d")).first()
    if longest["n"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    asked, asked_path = stored(asked, "queries")
    count = asked.count()
    parts = max(1, -(-count * longest["d"] * 8 // block_bytes))
    exact = longest["n"] < 2.0**53  # no score is larger than the largest squared norm
    out = None
    for part in range(parts):
        own = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == part)
        groups: dict[int, list] = {}
        for r in own.orderBy("vec_id").toLocalIterator():
            groups.setdefault(len(r["v"]), []).append(r)
        if not groups:
            continue
        found = _block(rows, {d: Block(np.array([r["vec_id"] for r in x]), np.array([r["v"] for r in x])) for d, x in groups.items()}, k, longest["n"], exact)
        found, _ = stored(found, "top")
        out = found if out is None else out.unionByName(found)
    remove(spark, rows_path, asked_path)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return out


def _block(rows: DataFrame, blocks: dict[int, Block], k: int, norm2: float, exact: bool) -> DataFrame:
    spark = rows.sparkSession
    rows = rows.select("vec_id", "v")
    bounds: dict[int, np.ndarray] = {}
    for d, b in blocks.items():
        most = [int(x) if x < float(MOST >> 1) else MOST - 1 for x in (np.sqrt(np.einsum("ij,ij->i", b.vectors, b.vectors)) * np.sqrt(norm2) * (1 + 1e-9)).tolist()]
        width = [-(-(2 * (x + 1) + 1) // BINS) for x in most]
        bounds[d] = np.array([(-x - 1, w, min(MOST, -x - 2 + w * BINS)) for x, w in zip(most, width, strict=True)], np.int64)  # low, width, high
    final = {d: np.zeros((len(b.ids), 2), np.int64) for d, b in blocks.items()}
    settled = {d: np.zeros(len(b.ids), bool) for d, b in blocks.items()}
    place = {int(i): (d, j) for d, b in blocks.items() for j, i in enumerate(b.ids)}
    while not all(x.all() for x in settled.values()):
        shared = spark.sparkContext.broadcast((blocks, bounds))
        counted = rows.mapInArrow(_count(shared, exact, BINS, k), "query_id long, bin int, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        above = F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("bin")))
        # of each query the bin that holds the k-th score, or the lowest one where there are fewer scores
        reached = counted.withColumn("upto", above).where((F.col("upto") >= k) | (F.col("bin") >= 0)).groupBy("query_id").agg(
            F.max(F.when(F.col("upto") >= k, F.struct("bin", "upto", "n"))).alias("hit"), F.max("upto").alias("all")
        ).collect()  # one row a query of this block
        seen = set()
        for r in reached:
            d, j = place[r["query_id"]]
            seen.add((d, j))
            if settled[d][j]:
                continue
            low, width, _ = (int(x) for x in bounds[d][j])
            if r["hit"] is None:  # fewer than k candidates: all are kept
                final[d][j] = (-MOST - 1, 0)
                settled[d][j] = True
                continue
            at, upto, n = r["hit"]["bin"], r["hit"]["upto"], r["hit"]["n"]
            if width == 1:
                final[d][j] = (low + at, k - (upto - n))
                settled[d][j] = True
            else:
                first = low + at * width
                step = max(1, -(-width // BINS))
                bounds[d][j] = (first, step, min(MOST, first + width - 1))
        for d, done in settled.items():
            for j in np.flatnonzero(~done):
                if (d, j) not in seen:  # no candidate at all
                    final[d][j] = (-MOST - 1, 0)
                    done[j] = True
        shared.unpersist()
    shared = spark.sparkContext.broadcast((blocks, final))
    found = rows.mapInArrow(_select(shared, exact), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
