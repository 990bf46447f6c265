"""Relations (one-hop edges), route trees, memberships and the change feed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut


def relations(edges: DataFrame, endpoint: dict, direction: str, limit: int, order: list[str]) -> DataFrame:
    """Live edges that leave (OUTGOING) or reach (INCOMING) an endpoint."""
    side = {"OUTGOING": "source", "INCOMING": "target"}[direction.upper()]
    for name, value in endpoint.items():
        edges = edges.where(F.col(f"{side}_{name}") == value)
    return edges.orderBy(*order).limit(limit)


def relation_pages(edges: DataFrame, live: DataFrame) -> DataFrame:
    """Every live row's edges in both directions, as a page shows them: row_id, direction, relation_type, other_id."""
    out = edges.select(F.col("source_id").alias("row_id"), F.lit("out").alias("direction"), "relation_type", F.col("target_id").alias("other_id"))
    back = edges.select(F.col("target_id").alias("row_id"), F.lit("in").alias("direction"), "relation_type", F.col("source_id").alias("other_id"))
    return out.unionByName(back).join(live.select("row_id"), "row_id", "left_semi").join(live.select(F.col("row_id").alias("other_id")), "other_id", "left_semi")


def deduplicated_edges(edges: DataFrame) -> DataFrame:
    """Edges after a merge: equal signatures once, loops not at all."""
    return edges.where("source_id <> target_id").dropDuplicates(["source_id", "relation_type", "target_id", "description"])


def children(routes: DataFrame, parent_id) -> DataFrame:
    """Live children of a node by name, then id."""
    return routes.where((F.col("parent_id") == parent_id) & ~F.col("deleted")).orderBy("name", "route_id")


def children_at_root(routes: DataFrame, table_id) -> DataFrame:
    roots = routes.where((F.col("table_id") == table_id) & (F.col("kind") == "root") & ~F.col("deleted")).select(F.col("route_id").alias("parent_id"))
    return routes.where(~F.col("deleted")).join(roots, "parent_id", "left_semi").orderBy("name", "route_id")


def paths(routes: DataFrame, root: str | None = None) -> DataFrame:
    """route_id, path and depth of every live node below each root (or one node). One join a level, each level written out, so neither
    the number of nodes nor the depth is limited; a cycle isn't reached from a root."""
    live = routes.where(~F.col("deleted")).select("route_id", "parent_id", "name")
    level = live.where(F.col("parent_id").isNull() if root is None else F.col("route_id") == root).select("route_id", F.lit("/").alias("path"), F.lit(0).alias("depth"))
    out = level = cut(level)
    while not level.isEmpty():
        path = F.when(F.col("path") == "/", F.concat(F.lit("/"), "name")).otherwise(F.concat("path", F.lit("/"), "name"))
        parents = level.withColumnRenamed("route_id", "parent_id")
        level = cut(live.join(parents, "parent_id").select("route_id", path.alias("path"), (F.col("depth") + 1).alias("depth")))
        out = out.unionByName(level)
    return out


def fanout_violations(routes: DataFrame, most: int) -> DataFrame:
    """Parents with `most` children or more."""
    return routes.where(~F.col("deleted") & F.col("parent_id").isNotNull()).groupBy("parent_id").agg(F.count("*").alias("n_children")).where(F.col("n_children") >= most)


def open_route(memberships: DataFrame, leaf_id, limit: int) -> DataFrame:
    return memberships.where((F.col("leaf_id") == leaf_id) & ~F.col("deleted")).select("database_id", "table_id", "row_id", "revision").orderBy("row_id").limit(limit)


def route_paths_of_rows(rows: DataFrame, memberships: DataFrame, routes: DataFrame) -> DataFrame:
    """Rows with the sorted paths of the leaves they belong to; an empty list without any."""
    found = memberships.where("not deleted").join(routes.where("not deleted").select(F.col("route_id").alias("leaf_id"), "path"), "leaf_id").groupBy("row_id").agg(F.array_sort(F.collect_set("path")).alias("route_paths"))
    return rows.join(found, "row_id", "left").withColumn("route_paths", F.coalesce("route_paths", F.array().cast("array<string>")))


def membership_diff(current: DataFrame, desired: DataFrame) -> DataFrame:
    """What a replacement adds and removes: leaf_id, row_id, change."""
    c, d = current.select("leaf_id", "row_id").withColumn("c", F.lit(1)), desired.select("leaf_id", "row_id").withColumn("d", F.lit(1))
    both = c.join(d, ["leaf_id", "row_id"], "full")
    return both.where("c is null or d is null").select("leaf_id", "row_id", F.when(F.col("c").isNull(), "add").otherwise("remove").alias("change"))


def change_feed(changes: DataFrame, after: int, high_water: int, limit: int) -> DataFrame:
    """Envelopes after a sequence up to the pinned high-water mark, in order."""
    return changes.where((F.col("commit_sequence") > after) & (F.col("commit_sequence") <= high_water)).orderBy("commit_sequence").limit(limit)


def change_entries(changes: DataFrame, database_id=None) -> DataFrame:
    """Entries of envelopes, one a row, perhaps of one database alone."""
    out = changes.select("commit_sequence", F.explode("entries").alias("e")).select("commit_sequence", "e.*")
    return out if database_id is None else out.where(F.col("database_id") == database_id)


def scoped_counts(changes: DataFrame, databases: list) -> DataFrame:
    """Per envelope the number of entries in the given databases."""
    allowed = F.array(*[F.lit(x) for x in databases])
    return changes.withColumn("entry_count", F.size(F.filter("entries", lambda e: F.array_contains(allowed, e["database_id"]))).cast("long"))
