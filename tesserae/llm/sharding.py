"""K-d tree sharding by bytes over document metadata.

Each document is a point: logarithm of its size, source and language (by hash), each dimension stretched to 0 .. 2^20 - 1 over the
corpus. A node is split at the weighted median (bytes) along its widest dimension (of equals: size, then source, then
language), until leaves reach the target bytes, which is the total over the number of shards. The text's checksum only
orders what is equal in that dimension. Rows of equal texts share one point (source and language of the smallest doc_id),
ordered by (dimension, checksum), so a group of equal texts falls apart, by a hash of its rows' ids and places, only where
the median would lie inside it and moving the cut to its nearer border would cost more than `slack` of a leaf.

Medians are exact to one key: histograms of 1024 bins of the order's 52 bits, summed over the cluster for all nodes of
a level at once, are refined until a bin is one value. The driver holds bins and nodes, never rows.

Null text: no bytes, size 1. Null source or language: a value of their own. Repeated rows are placed one by one, so
many rows with one id and one text are split like any others; ids, if null, come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import remove, stored

BITS = 20
SLACK = 0.005
DIMENSIONS = ("d_size", "d_source", "d_lang")
HOT = 1000  # a group with a thousandth of all rows is joined by broadcast: there are 1000 of them at most


def points(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the row's own dimensions, a hash of the text and one of the row; no text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    column = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    hashed = lambda c: F.pmod(F.xxhash64(column(c)), F.lit(1 << BITS)).cast("double")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("b"), F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("group"), hashed("source").alias("d_source"), hashed("lang").alias("d_lang"))
    out = out.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id()), F.lit(1 << 20)))
    return out.select("doc_id", (F.col("b") + 1).alias("size"), "text_crc32", "group", F.log2(F.col("b") + 1.0).alias("d_size"), "d_source", "d_lang", "salt")


def shared_points(rows: DataFrame) -> tuple[DataFrame, str]:
    """Dimensions over their spread in the corpus, source and language of a group's smallest doc_id for all its rows. Large groups
    aren't joined by a shuffle, which would bring each into one task."""
    groups = rows.groupBy("group", "text_crc32").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "d_source", "d_lang")).alias("f")).where("n > 1")
    groups, path = stored(groups, "groups", few=True)
    total = rows.agg(F.count("*").alias("rows"), *[f(d).alias(f"{d}_{k}") for d in DIMENSIONS for k, f in (("low", F.min), ("high", F.max))]).first()
    hot = F.broadcast(groups.where(F.col("n") * HOT >= total["rows"]).select("group", "text_crc32", F.col("f").alias("g")))
    rest = groups.where(F.col("n") * HOT < total["rows"]).select("group", "text_crc32", "f")
    marked = rows.join(hot, ["group", "text_crc32"], "left")
    large = marked.where("g is not null").withColumnRenamed("g", "f")
    small = marked.where("g is null").drop("g").join(rest, ["group", "text_crc32"], "left")
    out = large.unionByName(small).withColumns({d: F.coalesce(F.col(f"f.{d}"), F.col(d)) for d in ("d_source", "d_lang")}).drop("group", "f")

    def stretched(d: str) -> Column:
        low, high = total[f"{d}_low"] or 0.0, total[f"{d}_high"] or 0.0
        return F.round((F.col(d) - low) * (((1 << BITS) - 1) / (high - low) if high > low else 0.0)).cast("long")

    out, new = stored(out.withColumns({d: stretched(d) for d in DIMENSIONS}).withColumn("node", F.lit(0)), "points")
    remove(rows.sparkSession, path)
    return out, new


def _order(dimension: Column) -> Column:
    """The group's place along the dimension, in 52 bits."""
    return F.shiftleft(dimension, 32) + F.col("text_crc32")


def split_points(rows: DataFrame, key: str, width: int, goal: dict[int, float]) -> dict[int, tuple[int, int, int]]:
    """For each node the value v of `key`, under 2^width, with weight(key < v) <= goal < weight(key <= v): (v, weight below, weight at v)."""
    low = {n: 0 for n in goal}
    below = {n: 0 for n in goal}
    shift = width
    at: dict[int, int] = {}
    while shift > 0:
        step = max(0, shift - 10)
        bounds = F.create_map(*[F.lit(x) for n in goal for x in (n, low[n])])
        place = F.shiftright(F.col(key) - F.element_at(bounds, F.col("node")), step)
        inside = (F.col(key) >= F.element_at(bounds, F.col("node"))) & (place < (1 << (shift - step)))
        counted = rows.where(F.col("node").isin(list(goal)) & inside).groupBy("node", place.cast("int").alias("bin")).agg(F.sum("size").alias("w")).collect()
        by: dict[int, list] = {}
        for r in counted:
            by.setdefault(r["node"], []).append((r["bin"], r["w"]))
        for n, bins in by.items():
            for b, w in sorted(bins):
                if below[n] + w > goal[n] or b == max(x for x, _ in bins):
                    low[n], at[n] = low[n] + (b << step), w
                    break
                below[n] += w
        shift = step
    return {n: (low[n], below[n], at.get(n, 0)) for n in goal}


def kd_shards(docs: DataFrame, shards: int = 16, slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, shard (0 .. shards - 1) and slot (from 0 without gaps) of every row."""
    rows, old = stored(points(docs), "points")
    rows, path = shared_points(rows)
    remove(docs.sparkSession, old)
    total = rows.agg(F.sum("size")).first()[0] or 0
    leaves = {0: (0, shards)}  # node -> first shard and number of shards
    while any(n > 1 for _, n in leaves.values()):
        open_ = {k: v for k, v in leaves.items() if v[1] > 1}
        spread = rows.where(F.col("node").isin(list(open_))).groupBy("node").agg(F.sum("size").alias("w"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMENSIONS]).collect()
        if not spread:
            break
        widest = {r["node"]: max(DIMENSIONS, key=lambda d, r=r: r[d]) for r in spread}
        goal = {r["node"]: r["w"] * (open_[r["node"]][1] // 2) / open_[r["node"]][1] for r in spread}
        chosen = F.coalesce(*[F.when(F.col("node").isin([n for n, d in widest.items() if d == dim]), F.col(dim)) for dim in set(widest.values())], F.lit(0))
        keyed = rows.withColumn("key", _order(chosen))
        cuts = split_points(keyed, "key", BITS + 32, goal)
        leaf = total / shards
        inner: dict[int, tuple[int, float]] = {}
        right: dict[int, int] = {}
        for n, (v, below, at) in cuts.items():
            if min(goal[n] - below, below + at - goal[n]) <= slack * leaf:
                right[n] = v + (below + at - goal[n] < goal[n] - below)  # the group at the median stays whole
            else:
                inner[n] = (v, goal[n] - below)
        salts: dict[int, int] = {}
        if inner:
            values = F.create_map(*[F.lit(x) for n, (v, _) in inner.items() for x in (n, v)])
            group = keyed.where(F.col("node").isin(list(inner)) & (F.col("key") == F.element_at(values, F.col("node"))))
            for n, (salt, below, at) in split_points(group, "salt", 20, {n: g for n, (_, g) in inner.items()}).items():
                right[n], salts[n] = inner[n][0], salt + (below + at - inner[n][1] < inner[n][1] - below)
        cut = F.create_map(*[F.lit(x) for n, v in right.items() for x in (n, v)])
        salt = F.create_map(*[F.lit(x) for n in right for x in (n, salts.get(n, 0))])
        node = F.col("node")
        # right of the cut: larger keys, and of a group that is split the rows from its salt up
        goes = (F.col("key") > F.element_at(cut, node)) | (F.col("key") == F.element_at(cut, node)) & (F.col("salt") >= F.element_at(salt, node))
        rows = keyed.withColumn("node", F.when(node.isin(list(right)), node * 2 + 1 + F.when(goes, 1).otherwise(0)).otherwise(node)).drop("key")
        rows, new = stored(rows, "points")
        remove(docs.sparkSession, path)
        path = new
        for n in right:
            first, count = leaves.pop(n)
            leaves[2 * n + 1], leaves[2 * n + 2] = (first, count // 2), (first + count // 2, count - count // 2)
        for n in set(open_) - set(right):
            leaves[n] = (leaves[n][0], 1)  # an empty node
    shard = F.create_map(*[F.lit(x) for n, (first, _) in leaves.items() for x in (n, first)])
    out = rows.select("doc_id", "size", "text_crc32", "salt", F.element_at(shard, F.col("node")).cast("int").alias("shard"))
    return with_slots(out)


def with_slots(rows: DataFrame) -> DataFrame:
    """Slots by (part, doc_id) within a shard, where parts are numerous enough that none is large: offsets of parts come from counts."""
    parts = max(16, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.withColumn("part", (F.col("salt") * parts / (1 << 20)).cast("int"))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    counts = counts.withColumn("first", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("salt", "doc_id", "text_crc32"))
    return rows.withColumn("own", own).join(counts, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("own") - 1).cast("long").alias("slot"))
