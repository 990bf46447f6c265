"""Near-duplicate grouping with HyperMinHash sketches.

A document's set is its distinct k-word shingles as 64-bit hashes (fewer than k words: the whole
sequence is one shingle). The sketch has 128 buckets, chosen by the top bits of the hash; a bucket
keeps the smallest remaining value as its leading-zero count (6 bits) and the 10 bits after the
leading one. Equal sets are folded into one class first, so copies cost one row.

Candidates: all registers are banded four at a time, so that every set that isn't empty has a band. Two sets with
Jaccard >= 0.8 agree on many bands, so each class keeps only its rarest band keys (prefix filter): with nb non-empty bands of
which at least t must be shared, nb - t + 1 keys suffice. A set of n shingles differs from a partner in at
most n / 4 elements and one element spoils one band at most, hence t >= nb - n // 4, which is exact where
it is above 0; else t = 1 (no equal band of 32 has a chance of 5e-8 at 0.8; four shingles in one band, which a fifth spoils, one of 1e-6).

Within a bucket pairs aren't listed. Buckets are dealt into pairs of blocks of at most `BLOCK` members, in which a task compares
sketches in memory: m members that aren't linked to each other cost m^2 / BLOCK rows of sketches and m^2 comparisons, so
buckets that have become one component leave early. First every member is compared with `PIVOTS` others: of the smallest members of its
buckets those that stand in most of them; then every member that isn't in its bucket's largest component names its likeliest partner in another one, and all members with any likely partner in another one are noted,
named or not; at last all likely pairs of different components among those that were noted come out, each in one
bucket only, after their smallest 512 values (the whole set of most documents) have been compared as well.
After each step links are confirmed and joined to components by a few rounds, and buckets that have become one
component, or have the same members as another one, are left alone. Nothing is capped.

Pairs are first estimated from registers with the expected number of chance collisions taken off,
then confirmed on full sets. Links become components by alternating stars.

Nulls and texts without words: empty set, linked with nothing, component is the row's own doc_id.
Repeated doc_ids: every row is kept and grouped by its own text. Null doc_id: kept is false.
Other columns are ignored here; `deduplicate` returns the input's columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_test, driver_released, fresh, released, remove, small_batches, stored, texts

BUCKETS, MANTISSA, ROWS = 128, 10, 4
BANDS = BUCKETS // ROWS
#: An estimate below MAYBE can't belong to 0.8: its deviation is 0.036 there.
MAYBE = 0.62
BLOCK, PAIRS = 4096, 50_000
SMALLEST, MOST_BITS = 512, 23
STEPS, ROUNDS, PIVOTS = ("star", "best", "all"), 2, 3
WORD_CACHE = 100_000

_BOUNDS = np.arange(BUCKETS, dtype=np.uint64) << np.uint64(57)
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(text: bytes | None, k: int, words: _Words) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, found), np.uint64, len(found))
    if len(h) < k:
        out = np.uint64(len(h))
        for i, x in enumerate(h):
            out = np.uint64((int(out) + int(x) * int(_STEPS[i % 8])) & 0xFFFFFFFFFFFFFFFF)
        return _mix(np.array([out], np.uint64))
    n = len(h) - k + 1
    x = h[:n] * _STEPS[0]
    for i in range(1, k):
        x += h[i : i + n] * (_STEPS[i % 8] + np.uint64(2 * (i // 8)))
    x = _mix(x)
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if n > 1 else x


def sketch(values: np.ndarray) -> np.ndarray:
    """Registers of a sorted set; 0 marks an empty bucket."""
    out = np.zeros(BUCKETS, np.uint16)
    if not len(values):
        return out
    at = np.searchsorted(values, _BOUNDS)
    first = values[np.minimum(at, len(values) - 1)]
    full = (at < len(values)) & ((first >> np.uint64(57)) == np.arange(BUCKETS, dtype=np.uint64))
    v = first[full] & np.uint64((1 << 57) - 1)
    bits = np.frexp(v.astype(np.float64))[1].astype(np.int64)
    v = v << (57 - bits).clip(0, 57).astype(np.uint64)
    mantissa = (v >> np.uint64(56 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    out[full] = ((58 - bits).astype(np.uint64).clip(1, 63) << np.uint64(MANTISSA)) | mantissa
    return out


def _sketches(k: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp", pa.binary()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            n, fp, sk = [], [], []
            for text in texts(batch.column(1)):
                s = shingle_set(text, k, words)
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sk.append(sketch(s).tobytes() if len(s) else None)
                if len(words) > WORD_CACHE:
                    words.clear()
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sk, pa.binary())], schema=schema)
        words.clear()
        released()

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    salt = _mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            regs = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16).reshape(-1, BANDS, ROWS).astype(np.uint64)
            full = regs.any(axis=2)
            keys = _mix(((regs[:, :, 0] << np.uint64(48)) | (regs[:, :, 1] << np.uint64(32)) | (regs[:, :, 2] << np.uint64(16)) | regs[:, :, 3]) ^ salt)
            doc, band = np.nonzero(full)
            nb = full.sum(axis=1)
            yield pa.record_batch([part.column(0).take(pa.array(doc)), pa.array(keys[doc, band].astype(np.int64)), pa.array(nb[doc].astype(np.int8))], names=["id", "key", "nb"])


def _chance(na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Expected number of registers that agree by chance, by sizes rounded to a twelfth of an octave (it is a small part of one register)."""
    grid = np.rint(np.log2(np.maximum(np.stack([na, nb]), 1)) * 12).astype(np.int64)
    codes, inverse = np.unique(grid[0] * 4096 + grid[1], return_inverse=True)
    la, lb = 2.0 ** (codes // 4096 / 12) / BUCKETS, 2.0 ** (codes % 4096 / 12) / BUCKETS
    level = np.arange(1, 58)
    low, high = 0.5**level, 0.5 ** (level - 1)
    both = (la + lb)[:, None]
    return (BUCKETS * ((0.5 ** (level + MANTISSA)) * (la * lb / (la + lb))[:, None] * (np.exp(-both * low) - np.exp(-both * high))).sum(axis=1))[inverse]


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimates of register rows, with expected chance collisions taken off."""
    used = ((a | b) > 0).sum(axis=1)
    equal = ((a == b) & (a > 0)).sum(axis=1)
    chance = np.minimum(_chance(na, nb), used * 0.5)
    return np.maximum(0, (equal - chance) / np.maximum(used - chance, 1))


def _group_pairs(start: int, end: int, one_block: bool, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers to be compared in one group, a bounded number at a time."""
    rows = np.arange(start, end)
    left, right = (rows, rows) if one_block else (rows[first[start:end]], rows[~first[start:end]])
    height = max(1, PAIRS // max(1, len(right)))
    for at in range(0, len(left), height):
        part = left[at : at + height]
        i, o = np.repeat(part, len(right)), np.tile(right, len(part))
        yield (i[i < o], o[i < o]) if one_block else (i, o)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs with both sketches and sizes, those whose estimate doesn't rule a link out."""
    for batch in batches:
        regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS) for c in (2, 4)]
        n = [batch.column(c).to_numpy().astype(np.float64) for c in (3, 5)]
        ok = (100 * np.minimum(*n) >= 80 * np.maximum(*n)) & (estimate(*regs, *n) >= MAYBE) if batch.num_rows else np.zeros(0, bool)
        yield pa.record_batch([batch.column(0), batch.column(1)], names=["p", "id"]).filter(pa.array(ok, pa.bool_()))


def _likely(step: str):
    """For rows sorted by (key, b1, b2): pairs of different components in one group whose estimate doesn't rule a link out. Step "best": a few
    of them, and (id, id) for every member of any."""

    def judged(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        ids, root = t.column("id").to_numpy(), t.column("root").to_numpy()
        regs = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        n = t.column("n").to_numpy().astype(np.float64)
        first = t.column("first").to_numpy()
        key, b1, b2 = (t.column(c).to_numpy() for c in ("key", "b1", "b2"))
        edges = np.flatnonzero((key[1:] != key[:-1]) | (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1])) + 1
        keys = t.column("keys").to_pylist() if step == "all" else None
        small = [np.frombuffer(x, np.uint32) for x in t.column("small").to_pylist()] if step == "all" else None
        found: set[tuple[int, int]] = set()
        best: dict[int, tuple[float, int]] = {}
        apart = np.ones(len(ids), bool)  # not in the largest component of the group
        noted = np.zeros(len(ids), bool)  # with a likely partner, whoever names it
        waiting: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> None:
            if not waiting:
                return
            i, o = (np.concatenate([w[k] for w in waiting]) for k in (0, 1))
            waiting.clear()
            j = estimate(regs[i], regs[o], n[i], n[o])
            i, o, j = i[j >= MAYBE], o[j >= MAYBE], j[j >= MAYBE]
            noted[i] = noted[o] = True
            i, o, j = i.tolist(), o.tolist(), j.tolist()
            if step == "best":
                for x, y, z in zip(i, o, j, strict=True):
                    if apart[y]:
                        best[y] = max(best.get(y, (0, 0)), (z, x))
                    if apart[x]:
                        best[x] = max(best.get(x, (0, 0)), (z, y))
                return
            if step == "all":
                by: dict[int, list[int]] = {}
                for x, y in zip(i, o, strict=True):
                    if min(set(keys[x]).intersection(keys[y])) == key[x]:
                        by.setdefault(x, []).append(y)
                i, o = [], []
                for x, ys in by.items():
                    ys = _close(small, n, x, ys)
                    i += [x] * len(ys)
                    o += ys
            found.update((min(ids[x], ids[y]), max(ids[x], ids[y])) for x, y in zip(i, o, strict=True))

        size = 0
        for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)], strict=True):
            if end - start < 2:
                continue
            if step == "best":
                roots, n_of = np.unique(root[start:end], return_counts=True)
                apart[start:end] = root[start:end] != roots[np.argmax(n_of)]
            for i, o in _group_pairs(start, end, b1[start] == b2[start], first):
                ok = (root[i] != root[o]) & (100 * np.minimum(n[i], n[o]) >= 80 * np.maximum(n[i], n[o]))
                waiting.append((i[ok], o[ok]))
                size += int(ok.sum())
                if size >= PAIRS:
                    flush()
                    size = 0
        flush()
        if step == "best":
            found.update((min(ids[x], ids[y]), max(ids[x], ids[y])) for x, (_, y) in best.items())
            found.update((x, x) for x in ids[noted])
        pairs = sorted(found)
        return pa.record_batch([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["p", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 2 * BLOCK):
                part = batch.slice(at, 2 * BLOCK)
                key, b1, b2 = (part.column(c).to_numpy() for c in ("key", "b1", "b2"))
                same = (key == key[-1]) & (b1 == b1[-1]) & (b2 == b2[-1])
                cut = int(np.argmax(same))  # the last group may go on
                if held and cut == 0 and held[-1].column("key")[-1].as_py() == key[0] and held[-1].column("b1")[-1].as_py() == b1[0] and held[-1].column("b2")[-1].as_py() == b2[0]:
                    held.append(part)
                    continue
                done = pa.Table.from_batches([*held, part.slice(0, cut)], schema=part.schema)
                held = [part.slice(cut)]
                if done.num_rows > 1:
                    yield judged(done)
        if held:
            yield judged(pa.Table.from_batches(held))
        held.clear()
        released()

    return run


def _close(small: list[np.ndarray], n: np.ndarray, i: int, others: list[int]) -> list[int]:
    """Those whose smallest values don't rule a Jaccard of 0.8 out; whole sets decide but for collisions of 32 bits."""
    a, out = small[i], []
    if n[i] <= SMALLEST and (whole := [o for o in others if n[o] <= SMALLEST]):
        sizes = np.array([len(small[o]) for o in whole])
        values = np.concatenate([small[o] for o in whole])
        both = np.add.reduceat(a[np.minimum(np.searchsorted(a, values), len(a) - 1)] == values, np.concatenate(([0], np.cumsum(sizes)[:-1])), dtype=np.int64)
        out = [o for o, yes in zip(whole, both >= 0.798 * (len(a) + sizes - both), strict=True) if yes]
        others = [o for o in others if n[o] > SMALLEST]
    for o in others:
        b = small[o]
        end = min(x[-1] for x, m in ((a, n[i]), (b, n[o])) if m > SMALLEST)
        x, y = a[: np.searchsorted(a, end, "right")], b[: np.searchsorted(b, end, "right")]
        both = len(np.intersect1d(x, y, assume_unique=True))
        union = len(x) + len(y) - both
        if both >= (0.8 - 5 * (0.16 / union) ** 0.5) * union:
            out.append(o)
    return out


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, last, pivot = _Words(), None, None
        for batch in batches:
            keep = []
            rows = (r for at in range(0, batch.num_rows, 200) for part in [batch.slice(at, 200)] for r in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts(part.column(2)), texts(part.column(3)), strict=True))
            for p, _, tp, t in rows:
                if p != last or tp != text:
                    last, text, pivot = p, tp, shingle_set(tp, k, words)
                other = shingle_set(t, k, words)
                both = len(np.intersect1d(pivot, other, assume_unique=True))
                keep.append(100 * both >= percent * (len(pivot) + len(other) - both))
                if len(words) > WORD_CACHE:
                    words.clear()
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["p", "id"])
        words.clear()
        released()

    return run


def stars(links: DataFrame, rounds: int | None = None) -> tuple[DataFrame, str]:
    """Alternating large and small stars over links (a, b): edges (node, smaller node) that join the same nodes, and their folder. Until
    every component is one star around its smallest node, or for a number of rounds. Each round is written out."""
    edges, path = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges", few=True)
    spark, before = links.sparkSession, None
    while rounds is None or rounds > 0:
        both = edges.union(edges.select("b", "a"))
        root = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(root, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges, new = stored(small, "edges", few=True)
        remove(spark, path)
        path = new
        if rounds is None:
            now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
            if now == before:
                break
            before = now
        else:
            rounds -= 1
    return edges, path


def roots_of(edges: DataFrame) -> DataFrame:
    """(node, root). Nodes with one root are joined; those that are joined share one once all rounds are done."""
    return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id of the group), kept."""
    spark, paths = docs.sparkSession, []
    small_batches(spark)
    driver_released(spark)  # long jobs shouldn't wait for chance

    def keep(df: DataFrame, name: str) -> DataFrame:
        df, path = stored(df, name, few=name in ("near", "links", "wanted"))
        paths.append(path)
        return df

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows, _ = stored(docs.mapInArrow(_sketches(k), "doc_id long, n_shingles long, fp binary, sketch binary"), "sketches")
    sets = rows.where("fp is not null")
    copied = keep(sets.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "copied")
    sets = sets.withColumn("copied", _among(copied, "fp")("fp"))  # only these have to meet
    folded = sets.where("copied").groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_rows"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    single = sets.where("not copied").select("fp", F.col("doc_id").alias("rep"), F.lit(1).cast("long").alias("n_rows"), F.col("n_shingles").alias("n"), "sketch")
    classes = keep(folded.union(single).withColumn("id", F.monotonically_increasing_id()), "classes")  # written once, so ids stay

    keys = keep(classes.select("id", "sketch").mapInArrow(_bands, "id long, key long, nb byte"), "keys")
    often = keys.groupBy("key").agg(F.count("*").alias("df")).where("df > 1")
    shared = keys.join(often, "key").join(classes.select("id", "n"), "id")
    own = Window.partitionBy("id")
    shared = shared.withColumn("r", F.row_number().over(own.orderBy("df", "key"))).withColumn("s", F.count("*").over(own))
    least = F.greatest(F.col("nb") - F.floor(F.col("n") / 4), F.lit(1))  # bands that partners share
    members = keep(shared.where(F.col("nb") - F.col("s") + F.col("r") <= F.col("nb") - least + 1).select("key", "id", F.floor(F.log("n") / F.log(F.lit(1.26))).cast("int").alias("c")), "members")
    # sizes of partners differ by a factor of 1.25 at most, so by one class: members without a size in their own or a neighbouring class leave
    near_sizes = members.groupBy("key", "c").agg(F.count("*").alias("m")).select("key", "m", F.explode(F.array(F.col("c") - 1, F.col("c"), F.col("c") + 1)).alias("c"))
    near_sizes = near_sizes.groupBy("key", "c").agg(F.sum("m").alias("m")).where("m > 1").select("key", "c")
    members = keep(members.join(near_sizes, ["key", "c"], "left_semi").select("key", "id"), "members")

    driver_released(spark)
    reps = keep(classes.where(_among(members, "id")("id")).select("id", "fp", "rep", "sketch", "n"), "reps")
    again = not rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null").isEmpty()

    def fetched(ids: DataFrame) -> DataFrame:
        """Text and smallest values of classes."""
        some = keep(ids.join(reps, "id").select("id", "fp", F.col("rep").alias("doc_id")), "wanted")
        held = docs.where(_among(some, "doc_id")("doc_id")).join(some, "doc_id")
        held = held.select("id", "fp", "text").mapInArrow(_own_text(k), "id long, text string, small binary")
        if again:  # else a class has one row with its id
            held = held.groupBy("id").agg(F.first("text").alias("text"), F.first("small").alias("small"))
        return keep(held, "texts")

    edges = held = noted = None
    for step in STEPS:
        members = members.select("key", "id")
        if step == "all":  # components only grow: who had no likely partner in another one in the step before has none now
            members = members.join(noted, "id", "left_semi")
        if edges is None:
            members = members.withColumn("root", F.col("id"))
        else:
            members = members.join(roots_of(edges).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        # buckets of one component have nothing to tell, and of buckets with the same members one is enough
        sizes = members.groupBy("key").agg(F.count("*").alias("size"), F.min("root").alias("r1"), F.max("root").alias("r2"), *[F.bit_xor(F.xxhash64("id", F.lit(x))).alias(f"x{x}") for x in (1, 2)]).where("r1 <> r2")
        sizes = sizes.groupBy("size", "x1", "x2").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
        members = keep(members.join(sizes, "key"), "members")
        if members.isEmpty():
            break
        if step == "star":
            pivots = members.groupBy("key").agg(F.min("id").alias("p"))
            met = members.join(pivots, "key").where("id <> p").groupBy("id", "p").agg(F.count("*").alias("n"))
            rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "p"))
            met = met.withColumn("rank", rank).where(F.col("rank") <= PIVOTS).select("id", "p")  # a few pairs a class
            one, two = reps.select("id", "sketch", "n").alias("one"), reps.select("id", "sketch", "n").alias("two")
            met = met.alias("met").join(one, F.col("met.id") == F.col("one.id")).join(two, F.col("met.p") == F.col("two.id"))
            near = met.select("met.p", "met.id", F.col("two.sketch").alias("s1"), F.col("two.n").alias("n1"), F.col("one.sketch").alias("s2"), F.col("one.n").alias("n2")).mapInArrow(_alike, "p long, id long")
            near = keep(near, "near")
        else:
            rest = members.join(reps.select("id", "sketch", "n"), "id").withColumn("own", F.pmod(F.xxhash64("id", "key"), "blocks").cast("int"))
            rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            rest = rest.withColumn("b1", F.least("own", "other")).withColumn("b2", F.greatest("own", "other")).withColumn("first", F.col("own") <= F.col("other"))
            if step == "all":
                missing = keep(members.select("id").distinct().join(held.select("id"), "id", "left_anti"), "wanted")
                if not missing.isEmpty():
                    held = held.union(fetched(missing))
                rest = rest.join(members.groupBy("id").agg(F.collect_list("key").alias("keys")), "id").join(held.select("id", "small"), "id")
            else:
                rest = rest.withColumn("keys", F.lit(None).cast("array<long>")).withColumn("small", F.lit(None).cast("binary"))
            near = rest.select("key", "b1", "b2", "first", "id", "root", "sketch", "n", "keys", "small").repartition("key", "b1", "b2").sortWithinPartitions("key", "b1", "b2").mapInArrow(_likely(step), "p long, id long")
            near = keep(near.distinct(), "near")
            if step == "best":
                noted, near = near.where("p = id").select("id"), near.where("p <> id")
        driver_released(spark)
        if near.isEmpty():
            if step == "best":
                break  # nobody has a likely partner elsewhere
            continue
        if step != "all":
            held = fetched(near.select("id").union(near.select("p")).distinct())
        one, two = held.select("id", "text").alias("one"), held.select("id", "text").alias("two")  # one exchange for both
        texted = near.alias("near").join(one, F.col("near.id") == F.col("one.id")).join(two, F.col("near.p") == F.col("two.id"))
        texted = texted.select("near.p", "near.id", F.col("two.text").alias("t_p"), F.col("one.text").alias("t_id"))
        links = keep(texted.mapInArrow(_confirm(k, percent), "p long, id long"), "links").select(F.col("p").alias("a"), F.col("id").alias("b"))
        edges, path = stars(links if edges is None else edges.union(links), ROUNDS)
        paths.append(path)

    groups = classes.select("id", "fp", "rep", "n_rows")
    if edges is None:
        groups = groups.where("n_rows > 1").select("fp", F.col("rep").alias("component"))
    else:
        edges, path = stars(edges)
        paths.append(path)
        roots = roots_of(edges)
        roots = roots.union(roots.select("root", "root").distinct())
        groups = groups.join(roots, groups["id"] == roots["node"], "left").withColumn("root", F.coalesce("root", "id"))
        least = groups.where("node is not null").groupBy("root").agg(F.min("rep").alias("least"))
        groups = groups.where("node is not null or n_rows > 1").join(least, "root", "left").select("fp", F.coalesce("least", "rep").alias("component"))
    groups, _ = stored(groups, "groups")
    remove(spark, *paths)
    driver_released(spark)
    out = rows.select("doc_id", "n_shingles", "fp").join(groups, "fp", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def _own_text(k: int):
    """Rows of a repeated doc_id whose text isn't the class's own go. Adds the smallest values of the set, cut to 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in batches:
            keep, small = [], []
            for fp, t in zip(batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                values = shingle_set(t, k, words)
                keep.append(xxhash.xxh3_128_digest(values.tobytes()) == fp)
                small.append(np.unique((values[:SMALLEST] >> np.uint64(32)).astype(np.uint32)).tobytes())
                if len(words) > WORD_CACHE:
                    words.clear()
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(small, pa.binary())], names=["id", "text", "small"]).filter(pa.array(keep, pa.bool_()))
        words.clear()
        released()

    return run


def _among(rows: DataFrame, key: str):
    """A test whether a value may be among the keys of `rows`."""
    test = bit_test(F.col(key), rows.where(F.col(key).isNotNull()), MOST_BITS)

    def asked(value) -> Column:
        value = F.col(value) if isinstance(value, str) else value
        return F.lit(False) if test is None else F.coalesce(test(value), F.lit(False))

    return asked


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows whose doc_id is the smallest of its group, unchanged. Of rows that repeat both doc_id and text one stays.
    Where a doc_id has several texts, its rows stay if it is the smallest of any of their groups. Rows without doc_id stay.
    Only rows whose id may be among those that go, or come again, are shuffled."""
    spark = docs.sparkSession
    found, path = stored(near_duplicates(docs, k, percent), "found")
    ids = found.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    odd, odd_path = stored(ids.where("not kept or n > 1").select(F.col("doc_id").alias("__odd"), "kept"), "odd")
    remove(spark, path)
    maybe = fresh(docs, "maybe")
    marked = docs.withColumn(maybe, _among(odd, "__odd")(F.col("doc_id").cast("long")))
    others = marked.where(~F.col(maybe)).drop(maybe)
    some = marked.where(maybe).drop(maybe)
    single = some.join(odd, some["doc_id"] == odd["__odd"], "left_anti")
    again = odd.where("kept").select("__odd")
    if again.isEmpty():
        return others.unionByName(single)
    once = some.join(again, some["doc_id"] == again["__odd"], "left_semi").dropDuplicates(["doc_id", "text"])
    return others.unionByName(single).unionByName(once)
