"""Text and vector retrieval: postings, ranked locations, route candidates, exact dot-product search, byte budgets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dot, terms, unique_terms

#: Rank of kinds among equal matches.
KIND_RANK = {"row": 5, "route": 4, "column": 3, "table": 2, "database": 1}
#: The more specific kind comes first among candidates of one score.
SPECIFIC = {"route": 3, "table": 2, "database": 1}
#: Keys that come in several rows are told by a remainder of their hash, so that what is broadcast has at most so many rows.
BUCKETS = 1 << 18
LIMITS = {"characters": 256, "terms": 32, "rows": 64, "least_bytes": 256, "most_bytes": 65_536}


def documents_to_fields(rows: DataFrame, object_id: str, fields: list[str]) -> DataFrame:
    """object_id, field_id, value for each field that isn't null or blank."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_id"), F.col(f).cast("string").alias("value")) for f in fields])
    return rows.select(F.col(object_id).alias("object_id"), F.explode(pairs).alias("f")).select("object_id", "f.field_id", "f.value").where("value is not null and trim(value) <> ''")


def postings(fields: DataFrame, keys: list[str], wanted: list[str] | None = None) -> DataFrame:
    """Term frequency for each key and field: keys, field_id, term, frequency; of the wanted terms alone if there are any named.
    A row whose key and field no other row has is counted by itself, so that its terms are neither shuffled nor held in a table of groups."""
    own = [*keys, "field_id"]
    if not keys or wanted is not None:
        return _grouped(fields, own, wanted)
    key = F.xxhash64(*own)
    bucket = lambda h: F.pmod(h, F.lit(BUCKETS))
    repeated = fields.groupBy(key.alias("key")).count().where("count > 1").select(bucket(F.col("key")).alias("bucket")).distinct()
    rows = fields.select(*own, "value", bucket(key).alias("bucket"))
    alone, others = (rows.join(F.broadcast(repeated), "bucket", how) for how in ("left_anti", "left_semi"))
    return _counted(alone, own).unionByName(_grouped(others, own))


def _grouped(fields: DataFrame, own: list[str], wanted: list[str] | None = None) -> DataFrame:
    """Term frequencies over rows."""
    words = terms(F.col("value"))
    words = words if wanted is None else F.filter(words, lambda t: t.isin(wanted))
    return fields.select(*own, F.explode(words).alias("term")).groupBy(*own, "term").agg(F.count("*").alias("frequency"))


def _counted(fields: DataFrame, own: list[str]) -> DataFrame:
    """Term frequencies within each row: lengths of the runs of its sorted terms. An inner explode would have its input computed twice, for a filter on its size."""
    words = F.col("words")
    ends = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: (i > 0) & ~F.get(words, i - 1).eqNullSafe(F.get(words, i)))
    runs = fields.select(*own, F.sort_array(terms(F.col("value"))).alias("words")).withColumn("ends", ends)
    runs = runs.select("*", F.posexplode_outer("ends").alias("pos", "end")).where("end is not null")
    length = F.col("end") - F.coalesce(F.get("ends", F.col("pos") - 1), F.lit(0))
    return runs.select(*own, F.get(words, F.col("end") - 1).alias("term"), length.cast("long").alias("frequency"))


def lexical_locations(found: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Objects by matched terms, matched fields and frequency. `wanted` holds a query's terms (32 at most), so it is broadcast."""
    hits = found.join(F.broadcast(wanted.select("term").distinct().limit(LIMITS["terms"])), "term", "left_semi")
    return hits.groupBy(*keys).agg(F.count_distinct("term").alias("matched_term_count"), F.count_distinct("field_id").alias("matched_field_count"), F.sum("frequency").alias("frequency"), F.array_sort(F.collect_set("field_id")).alias("matched_field_ids"))


def rank_order(locations: DataFrame, keys: list[str]) -> list[Column]:
    """More terms, fields and occurrences first, then the kind's rank, then the keys."""
    rank = [F.desc("matched_term_count"), F.desc("matched_field_count"), F.desc("frequency")]
    if "kind" in locations.columns:
        rank.append(_ranked(KIND_RANK).desc())
    return [*rank, *map(F.col, keys)]


def _ranked(ranks: dict[str, int]) -> Column:
    return F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in ranks.items()], F.lit(0))


def ranked(locations: DataFrame, keys: list[str], limit: int) -> DataFrame:
    return locations.orderBy(*rank_order(locations, keys)).limit(limit)


def route_candidates(fields: DataFrame, wanted: Column, keys: list[str], limit: int) -> DataFrame:
    """Objects by the sum over fields of distinct matching terms. Where they have a kind, the more specific one comes first among equals."""
    score = F.size(F.array_intersect(unique_terms(F.col("value")), wanted)).cast("long")
    out = fields.groupBy(*keys).agg(F.sum(score).alias("score")).where("score > 0")
    return out.orderBy(*_specific(out, keys)).limit(limit)


def route_scores(found: DataFrame, limit: int) -> DataFrame:
    """The same from postings: KEYS without the revision, and the score."""
    keys = ["kind", "database_id", "table_id", "object_id"]
    out = found.select(*keys, "field_id", "term").distinct().groupBy(*keys).agg(F.count("*").alias("score"))
    return out.orderBy(*_specific(out, keys)).limit(limit)


def _specific(out: DataFrame, keys: list[str]) -> list[Column]:
    kind = [_ranked(SPECIFIC).desc()] if "kind" in out.columns else []
    return [F.desc("score"), *kind, *(F.col(k) for k in keys if k != "kind")]


def _nearest(query: list[float], limit: int, key: str):
    """Of each batch the rows that can be among the first, by a matrix product with room for its rounding, and their products summed in order."""
    q = np.array(query, np.float64)

    def product(v: list) -> float | None:
        total = 0.0
        for x, y in zip(v, query, strict=True):
            if x is None:
                return None
            total += x * y
        return total

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            if len(lists) > limit and lists.flatten().null_count == 0:
                matrix = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), len(q)).astype(np.float64)
                s = matrix @ q
                if np.isfinite(s).all():
                    least = np.partition(s, len(s) - limit)[len(s) - limit]
                    batch = batch.filter(pa.array(s >= least - 1e-9 * (1 + np.abs(s).max())))
            yield pa.record_batch([batch.column(0), pa.array([product(v) for v in batch.column(1).to_pylist()], pa.float64())], names=[key, "score"])

    return run


def vector_candidates(vectors: DataFrame, query: list[float], limit: int, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Exact dot products in double precision, highest first, ties to the smaller key. Each batch hands on the few rows that can be among the first."""
    own = vectors.where(F.size(embedding) == len(query)).select(key, embedding)
    scored = own.mapInArrow(_nearest([float(x) for x in query], limit, key), f"`{key}` {dict(own.dtypes)[key]}, score double")
    return scored.orderBy(F.desc("score"), key).limit(limit)


def norm_violations(vectors: DataFrame, tolerance: float = 1e-4, embedding: str = "embedding") -> DataFrame:
    """Vectors that aren't finite or not of unit length."""
    square = dot(F.col(embedding), F.col(embedding))
    return vectors.where(square.isNull() | F.isnan(square) | (F.abs(square - 1) > tolerance))


def byte_budget(rows: DataFrame, json: Column, order: list, budget: int, part: list | None = None) -> DataFrame:
    """The rows whose JSON list stays within the budget: two bytes of brackets and one for each comma. The page is
    bounded by its LIMIT before this, so the running sum is over few rows."""
    own = Window.partitionBy(*(part or [F.lit(0)])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("bytes_so_far", F.sum(F.octet_length(json) + 1).over(own) + 1).where(F.col("bytes_so_far") <= budget)


def surface_digest(*parts: Column) -> Column:
    """Digest of what a route shows of itself; a vector made from another surface is stale."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]), 256)


def discovery_frame(batches: DataFrame, order: list, most: int, budget: int, json: Column) -> DataFrame:
    """Candidates of all predictors in order while both the number and the bytes hold; the first that doesn't fit ends the list."""
    own = Window.partitionBy(F.lit(0)).orderBy(*order)
    head = batches.orderBy(*order).limit(most + 1)  # bounded, so one task may number it
    out = head.withColumns({"place": F.row_number().over(own), "bytes_so_far": F.sum(F.octet_length(json) + 1).over(own.rowsBetween(Window.unboundedPreceding, 0)) + 1})
    return out.where((F.col("place") <= most) & (F.col("bytes_so_far") <= budget))
