"""Structural health scans, three-way merge, field differences, numeric evidence and read windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import canonical, numeric_tokens

MOST_ISSUES = 512


def duplicate_groups(rows: DataFrame, value: Column, row_id: str) -> DataFrame:
    """Values that several live rows share: digest, n_rows and smallest id."""
    return rows.groupBy(F.sha2(value.cast("binary"), 256).alias("digest")).agg(F.count("*").alias("n_rows"), F.min(row_id).alias("first_id")).where("n_rows > 1")


def ambiguous_siblings(routes: DataFrame) -> DataFrame:
    """Names or aliases that several children of one parent answer to."""
    names = routes.where(~F.col("deleted")).select("parent_id", "route_id", F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), canonical))).alias("name"))
    return names.groupBy("parent_id", "name").agg(F.count_distinct("route_id").alias("n_routes")).where("n_routes > 1")


def orphan_memberships(memberships: DataFrame, rows: DataFrame) -> DataFrame:
    return memberships.where(~F.col("deleted")).join(rows.select("row_id"), "row_id", "left_anti")


def stale_memberships(memberships: DataFrame, rows: DataFrame) -> DataFrame:
    """Memberships that point at an older revision than the row's."""
    return memberships.where(~F.col("deleted")).join(rows.select("row_id", F.col("revision").alias("current")), "row_id").where("revision < current")


def unrouted_rows(rows: DataFrame, memberships: DataFrame) -> DataFrame:
    return rows.join(memberships.where(~F.col("deleted")).select("row_id"), "row_id", "left_anti")


def crowded_leaves(memberships: DataFrame) -> DataFrame:
    return memberships.where(~F.col("deleted")).groupBy("leaf_id").agg(F.count_distinct("row_id").alias("n_rows")).where("n_rows > 1")


def synonymous_columns(columns: DataFrame) -> DataFrame:
    from ..functions import normalize_words

    return columns.groupBy("table_id", "type", "nullable", normalize_words(F.col("purpose")).alias("purpose")).agg(F.count("*").alias("n_columns"), F.array_sort(F.collect_list("name")).alias("names")).where("n_columns > 1")


def stale_descriptions(tables: DataFrame, rows: DataFrame, days: int = 30) -> DataFrame:
    """Tables whose rows changed more than `days` after the description."""
    newest = rows.groupBy("table_id").agg(F.max("updated_at").alias("newest"))
    return tables.join(newest, "table_id").where(F.col("newest") > F.col("updated_at") + F.expr(f"INTERVAL {days} DAYS"))


def issue_report(issues: list[DataFrame], most: int = MOST_ISSUES) -> DataFrame:
    """kind, object_id and detail of all issues in fixed order, at most `most`."""
    out = issues[0]
    for x in issues[1:]:
        out = out.unionByName(x)
    return out.orderBy("kind", "object_id", "detail").limit(most)


def route_structure(routes: DataFrame, tables: DataFrame) -> DataFrame:
    """Tables that haven't exactly one root, and routes whose parent is missing, is a leaf, or belongs to another table: kind, object_id, detail."""
    live = routes.where(~F.col("deleted"))
    roots = tables.select("table_id").join(live.where("kind = 'root' and parent_id is null").groupBy("table_id").agg(F.count("*").alias("n")), "table_id", "left")
    wrong = roots.where(F.coalesce("n", F.lit(0)) != 1).select(F.lit("invalid_route_structure").alias("kind"), F.col("table_id").alias("object_id"), F.concat(F.coalesce("n", F.lit(0)).cast("string"), F.lit(" roots")).alias("detail"))
    parents = live.select(F.col("route_id").alias("p_id"), F.col("table_id").alias("p_table"), F.col("kind").alias("p_kind"))
    joined = live.join(parents, live["parent_id"] == parents["p_id"], "left")
    fine = F.when(F.col("kind") == "root", F.col("parent_id").isNull()).otherwise(F.coalesce((F.col("p_table") == F.col("table_id")) & (F.col("p_kind") != "leaf"), F.lit(False)))
    known = joined.join(tables.select(F.col("table_id").alias("t_id")), joined["table_id"] == F.col("t_id"), "left")
    odd = known.where(~fine | F.col("t_id").isNull()).select(F.lit("invalid_route_structure").alias("kind"), F.col("route_id").alias("object_id"), F.lit("parent").alias("detail"))
    return wrong.unionByName(odd)


def foreign_memberships(memberships: DataFrame, routes: DataFrame) -> DataFrame:
    """Memberships whose row belongs to another table than the leaf."""
    leaves = routes.where(~F.col("deleted")).select(F.col("route_id").alias("leaf_id"), F.col("table_id").alias("leaf_table"))
    return memberships.where(~F.col("deleted")).join(leaves, "leaf_id").where(F.col("table_id") != F.col("leaf_table")).drop("leaf_table")


def unrouted_of_complete(rows: DataFrame, memberships: DataFrame, incomplete: DataFrame) -> DataFrame:
    """Rows without a leaf, of tables whose scan is complete alone: `incomplete` names the others."""
    return unrouted_rows(rows, memberships).join(incomplete.select("table_id"), "table_id", "left_anti")


def report_hash(report: DataFrame) -> DataFrame:
    """status, issue_count and hash of a bounded report: SHA-256 of its lines in their order."""
    line = F.concat_ws("\u0001", "kind", "object_id", "detail")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("kind", "object_id", "detail", line.alias("line")))), lambda x: x["line"])
    out = report.agg(F.count("*").alias("issue_count"), F.sha2(F.array_join(lines, "\n"), 256).alias("hash"))
    return out.withColumn("status", F.when(F.col("issue_count") > 0, "attention").otherwise("healthy"))


def three_way_merge(base: DataFrame, local: DataFrame, incoming: DataFrame, key: str, value: str) -> DataFrame:
    """key, action (local, incoming or conflict) and merged value; absence counts as a value."""
    side = lambda df, name: df.select(key, F.struct(F.col(value).alias("v")).alias(name))
    both = side(base, "b").join(side(local, "l"), key, "full").join(side(incoming, "i"), key, "full")
    b, l, i = (F.col(x) for x in ("b", "l", "i"))  # noqa: E741
    action = F.when(l.eqNullSafe(i) | i.eqNullSafe(b), "local").when(l.eqNullSafe(b), "incoming").otherwise("conflict")
    return both.select(key, action.alias("action"), F.when(action == "local", F.col("l.v")).when(action == "incoming", F.col("i.v")).alias("merged"))


def field_differences(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, field, left and right of the fields whose presence or JSON differs."""
    def unpivoted(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.to_json(F.struct(F.col(f).alias("v"))).alias(name)) for f in fields])).alias("e")).select(key, "e.*")

    both = unpivoted(left, "left").join(unpivoted(right, "right"), [key, "field"], "full")
    return both.where(~F.col("left").eqNullSafe(F.col("right")))


def numeric_evidence(rows: DataFrame, key: str, text: Column) -> DataFrame:
    """Numbers of a text with how often each stands there."""
    return rows.select(key, F.explode(numeric_tokens(text)).alias("number")).groupBy(key, "number").agg(F.count("*").alias("n"))


def read_windows(nodes: DataFrame, key: str, order: str, text: str, most_nodes: int, most_bytes: int) -> DataFrame:
    """Greedy windows of consecutive nodes within both bounds: key, window, first, last, n_nodes, n_bytes. A node that is
    larger than a window has one to itself. A key's nodes are read in sorted batches, so none is held whole."""
    sized = nodes.select(key, F.col(order).alias("o"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("b")).repartition(key).sortWithinPartitions(key, "o")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, done = None, []
        for frame in frames:
            for k, o, b in zip(frame[key], frame["o"], frame["b"], strict=True):
                if at is None or at[0] != k:
                    if at:
                        done.append(tuple(at))
                    at = [k, 0, o, o, 1, b]
                elif at[4] >= most_nodes or at[5] + b > most_bytes:
                    done.append(tuple(at))
                    at = [k, at[1] + 1, o, o, 1, b]
                else:
                    at[3], at[4], at[5] = o, at[4] + 1, at[5] + b
            yield pd.DataFrame(done, columns=[key, "window", "first", "last", "n_nodes", "n_bytes"])
            done = []
        if at:
            yield pd.DataFrame([tuple(at)], columns=[key, "window", "first", "last", "n_nodes", "n_bytes"])

    kinds = dict(nodes.dtypes)
    return sized.mapInPandas(run, f"{key} {kinds[key]}, window long, first {kinds[order]}, last {kinds[order]}, n_nodes long, n_bytes long")
