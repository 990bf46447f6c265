"""Engine queries by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..language.session import Session
from ..functions import int_divide, int_remainder, numeric_tokens, two_valued, unique_terms
from ..operators import graph, health, metrics, retrieval, versions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def version_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as versions of their order, numbered by line; a last line returned ('R') marks a deletion.
    Commits are numbered by order and revision (orders have far fewer than 64 lines), so no global sort is needed."""
    line = table(spark, sf_dir, "lineitem")
    own = Window.partitionBy("l_orderkey")
    revision = F.row_number().over(own.orderBy(*_LINE_ORDER)).cast("long")
    line = line.withColumns({"revision": revision, "n": F.count("*").over(own)})
    return line.select(
        F.col("l_orderkey").alias("row_id"), "revision", (F.col("l_orderkey") * 64 + F.col("revision")).alias("commit_sequence"),
        F.when((F.col("n") == F.col("revision")) & (F.col("l_returnflag") == "R"), "deleted").otherwise("live").alias("row_state"), "l_partkey", "l_quantity",
    )


LOG = f"""line AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_LINE_ORDER)}) AS revision, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
  log AS (SELECT l_orderkey AS row_id, revision, l_orderkey * 64 + revision AS commit_sequence, CASE WHEN n = revision AND l_returnflag = 'R' THEN 'deleted' ELSE 'live' END AS row_state, l_partkey, l_quantity FROM line),
  hidden AS (SELECT row_id FROM log GROUP BY row_id HAVING arg_max(row_state, revision) = 'deleted')"""


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 30 AND l_discount < 0.05 ORDER BY l_orderkey, l_linenumber LIMIT 1000")
def scan_filter_limit(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").where("l_quantity >= 30 and l_discount < 0.05").select("l_orderkey", "l_linenumber", "l_quantity").orderBy("l_orderkey", "l_linenumber").limit(1000)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS row_id, CAST(1 AS BIGINT) AS revision, CAST(0 AS BIGINT) AS commit_sequence, 'live' AS row_state, CAST(1 AS BIGINT) AS schema_version, CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def star_projection(spark, sf_dir):
    s = Session(spark)
    s.attach("tpch", "nation", table(spark, sf_dir, "nation"), row_id="n_nationkey")
    return s.plan("SELECT * FROM tpch.nation", bounded=False)


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7")
def point_get(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey = 7").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""SELECT c_custkey, o_orderkey, coalesce(o_orderstatus = 'F', false) AS is_f, coalesce(o_orderstatus <> 'F', false) AS not_f, NOT coalesce(o_orderkey = NULL, false) AS not_null_eq
  FROM customer LEFT JOIN orders ON c_custkey = o_custkey""")
def two_valued_null(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", "o_orderkey", two_valued(F.col("o_orderstatus") == "F").alias("is_f"), two_valued(F.col("o_orderstatus") != "F").alias("not_f"), (~two_valued(F.col("o_orderkey") == F.lit(None))).alias("not_null_eq"))


@query("""SELECT l_orderkey, l_linenumber, l_orderkey * l_partkey + l_suppkey AS mixed, CAST((l_partkey - 1000) // l_linenumber AS BIGINT) AS quotient, CAST((l_partkey - 1000) % l_linenumber AS BIGINT) AS remainder, -l_partkey AS negated FROM lineitem""")
def checked_arith(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").withColumn("n", F.col("l_linenumber").cast("long"))
    a = F.col("l_partkey") - 1000
    return line.select("l_orderkey", "l_linenumber", (F.col("l_orderkey") * F.col("l_partkey") + F.col("l_suppkey")).alias("mixed"), int_divide(a, F.col("n")).alias("quotient"), int_remainder(a, F.col("n")).alias("remainder"), (-F.col("l_partkey")).alias("negated"))


@query("SELECT * FROM (SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 1000) WHERE user_id % 7 = 0 ORDER BY event_id LIMIT 50")
def bounded_scan_window(spark, sf_dir):
    return versions.bounded_scan(table(spark, sf_dir, "events").select("event_id", "user_id"), ["event_id"], "user_id % 7 = 0", 1000, 50)


@query(f"WITH {LOG} SELECT row_id, revision, commit_sequence, row_state, l_partkey, l_quantity FROM log WHERE row_id = 2 AND revision = 1 AND row_id NOT IN (SELECT row_id FROM hidden)")
def asof_revision(spark, sf_dir):
    return versions.as_of_revision(version_log(spark, sf_dir), 2, 1)


@query(f"""WITH {LOG} SELECT row_id, revision, commit_sequence, row_state, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY revision DESC) AS r FROM log WHERE commit_sequence <= 320003)
  WHERE r = 1 AND row_state = 'live' AND row_id NOT IN (SELECT row_id FROM hidden)""")
def asof_commit(spark, sf_dir):
    return versions.as_of_commit(version_log(spark, sf_dir), 320003)


@query(f"WITH {LOG} SELECT row_id, revision, commit_sequence, row_state, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY revision DESC) AS r FROM log) WHERE r = 1 AND row_state = 'live'")
def current_rows(spark, sf_dir):
    return versions.current_rows(version_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT row_id FROM hidden")
def deleted_hidden(spark, sf_dir):
    return versions.hidden_ids(version_log(spark, sf_dir))


@query(f"WITH {LOG} SELECT row_id, revision, commit_sequence, row_state FROM log WHERE row_id = 2 AND row_id NOT IN (SELECT row_id FROM hidden) ORDER BY revision LIMIT 5")
def history_page(spark, sf_dir):
    return versions.history(version_log(spark, sf_dir), 2, 5)


@query(f"""WITH {LOG}, old AS (SELECT * FROM log WHERE row_id IN (1, 2, 3, 5, 6, 7, 8, 36, 40, 41, 42, 43) AND revision = 1 AND row_id NOT IN (SELECT row_id FROM hidden)),
  head AS (SELECT row_id, max(revision) AS r FROM log GROUP BY row_id) SELECT old.row_id, r + 1 AS revision, old.l_partkey, old.l_quantity FROM old JOIN head USING (row_id)""")
def restored_rows(spark, sf_dir):
    log, out = version_log(spark, sf_dir), None
    for row_id in (1, 2, 3, 5, 6, 7, 8, 36, 40, 41, 42, 43):
        own = log.where(F.col("row_id") == row_id)
        done = versions.restore(own, row_id, 1, 1_000_000_000).where("commit_sequence = 1000000000")
        out = done if out is None else out.unionByName(done)
    return out.select("row_id", "revision", "l_partkey", "l_quantity")


def change_log(spark, sf_dir) -> DataFrame:
    """Events as change envelopes of one to three entries."""
    entry = lambda k: F.struct(F.col("event_type").alias("object_kind"), (F.col("user_id") % 5 + k).alias("database_id"), (F.col("event_id") * 10 + k).alias("object_id"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("commit_sequence"), F.col("user_id").alias("actor"), F.slice(F.array(entry(0), entry(1), entry(2)), F.lit(1), (F.col("event_id") % 3 + 1).cast("int")).alias("entries"))


ENTRIES = "entries AS (SELECT event_id AS commit_sequence, user_id AS actor, event_type AS object_kind, user_id % 5 + k AS database_id, event_id * 10 + k AS object_id FROM events, (SELECT unnest([0, 1, 2]) AS k) WHERE k <= event_id % 3)"


@query("SELECT event_id AS commit_sequence, user_id AS actor, CAST(event_id % 3 + 1 AS BIGINT) AS n_entries FROM events WHERE event_id > 100 AND event_id <= 900 ORDER BY event_id LIMIT 256")
def change_feed_after(spark, sf_dir):
    return graph.change_feed(change_log(spark, sf_dir), 100, 900, 256).select("commit_sequence", "actor", F.size("entries").cast("long").alias("n_entries"))


@query(f"WITH {ENTRIES} SELECT commit_sequence, object_kind, database_id, object_id FROM entries WHERE database_id = 3")
def change_entries_exploded(spark, sf_dir):
    return graph.change_entries(change_log(spark, sf_dir), 3)


@query(f"WITH {ENTRIES} SELECT commit_sequence, CAST(sum(CASE WHEN database_id IN (1, 2) THEN 1 ELSE 0 END) AS BIGINT) AS entry_count FROM entries GROUP BY commit_sequence")
def change_scoped_counts(spark, sf_dir):
    return graph.scoped_counts(change_log(spark, sf_dir), [1, 2]).select("commit_sequence", "entry_count")


def edges(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source_id"), F.col("l_returnflag").alias("relation_type"), F.col("l_suppkey").alias("target_id"), F.col("l_linestatus").alias("description"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"))


for _direction, _column in (("outgoing", "l_partkey"), ("incoming", "l_suppkey")):

    def _relations(spark, sf_dir, direction=_direction):
        side = "source" if direction == "outgoing" else "target"
        return graph.relations(edges(spark, sf_dir), {"id": 5}, direction, 100, ["o", "n"]).select("source_id", "relation_type", "target_id", "o", "n")

    _relations.__name__ = f"relations_{_direction}"
    query(f"SELECT l_partkey AS source_id, l_returnflag AS relation_type, l_suppkey AS target_id, l_orderkey AS o, l_linenumber AS n FROM lineitem WHERE {_column} = 5 ORDER BY o, n LIMIT 100")(_relations)


@query("SELECT DISTINCT l_partkey AS source_id, l_returnflag AS relation_type, l_suppkey AS target_id, l_linestatus AS description FROM lineitem WHERE l_partkey <> l_suppkey")
def relations_deduplicated(spark, sf_dir):
    return graph.deduplicated_edges(edges(spark, sf_dir)).select("source_id", "relation_type", "target_id", "description")


def routes(spark, sf_dir) -> DataFrame:
    """Regions, nations and customers as a tree below one root."""
    node = lambda df, i, p, n, kind: df.select(i.alias("route_id"), p.alias("parent_id"), F.col(n).alias("name"), F.lit(kind).alias("kind"), F.array(F.substr(F.col(n), F.lit(1), F.lit(3))).alias("aliases"), F.lit(False).alias("deleted"))
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    root = spark.range(1).select(F.lit("root").alias("route_id"), F.lit(None).cast("string").alias("parent_id"), F.lit("").alias("name"), F.lit("root").alias("kind"), F.array().cast("array<string>").alias("aliases"), F.lit(False).alias("deleted"))
    out = root.unionByName(node(table(spark, sf_dir, "region"), text("r", "r_regionkey"), F.lit("root"), "r_name", "branch"))
    out = out.unionByName(node(table(spark, sf_dir, "nation"), text("n", "n_nationkey"), text("r", "n_regionkey"), "n_name", "branch"))
    return out.unionByName(node(table(spark, sf_dir, "customer"), text("c", "c_custkey"), text("n", "c_nationkey"), "c_name", "leaf"))


ROUTES = """routes AS (SELECT 'root' AS route_id, NULL AS parent_id, '' AS name UNION ALL SELECT concat('r', r_regionkey), 'root', r_name FROM region
  UNION ALL SELECT concat('n', n_nationkey), concat('r', n_regionkey), n_name FROM nation UNION ALL SELECT concat('c', c_custkey), concat('n', c_nationkey), c_name FROM customer)"""
TREE = """tree AS (SELECT route_id, '/' AS path, 0 AS depth FROM routes WHERE {start} UNION ALL
  SELECT r.route_id, CASE WHEN t.path = '/' THEN concat('/', r.name) ELSE concat(t.path, '/', r.name) END, t.depth + 1 FROM routes r JOIN tree t ON r.parent_id = t.route_id)"""


@query(f"WITH {ROUTES} SELECT route_id, parent_id, name FROM routes WHERE parent_id = 'r1'")
def route_children(spark, sf_dir):
    return graph.children(routes(spark, sf_dir), "r1").select("route_id", "parent_id", "name")


@query(f"WITH RECURSIVE {ROUTES}, {TREE.format(start='parent_id IS NULL')} SELECT route_id, path, CAST(depth AS INTEGER) AS depth FROM tree")
def route_paths(spark, sf_dir):
    return graph.paths(routes(spark, sf_dir))


@query(f"WITH RECURSIVE {ROUTES}, {TREE.format(start=chr(39).join(['route_id = ', 'r2', '']))} SELECT route_id, path, CAST(depth AS INTEGER) AS depth FROM tree WHERE depth > 0")
def route_descendants(spark, sf_dir):
    return graph.paths(routes(spark, sf_dir), "r2").where("depth > 0")


@query(f"WITH {ROUTES} SELECT parent_id, count(*) AS n_children FROM routes WHERE parent_id IS NOT NULL GROUP BY parent_id HAVING count(*) >= 12")
def fanout_violations(spark, sf_dir):
    return graph.fanout_violations(routes(spark, sf_dir), 12)


@query("""SELECT c_custkey AS row_id, list_sort(list_distinct(list(concat('/', n_name)))) AS route_paths FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY c_custkey""")
def row_route_paths(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"))
    members = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_nationkey").alias("leaf_id"), F.lit(False).alias("deleted"))
    leaves = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("route_id"), F.concat(F.lit("/"), "n_name").alias("path"), F.lit(False).alias("deleted"))
    return graph.route_paths_of_rows(rows, members, leaves)


@query("""SELECT coalesce(a.l_orderkey, b.l_orderkey) AS row_id, coalesce(a.k, b.k) AS leaf_id, CASE WHEN a.k IS NULL THEN 'add' ELSE 'remove' END AS change
  FROM (SELECT DISTINCT l_orderkey, l_suppkey AS k FROM lineitem WHERE l_linenumber <= 3) a FULL JOIN (SELECT DISTINCT l_orderkey, l_suppkey AS k FROM lineitem WHERE l_linenumber >= 2) b ON a.l_orderkey = b.l_orderkey AND a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def membership_replacement(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_suppkey").alias("leaf_id"), "l_linenumber")
    part = lambda condition: line.where(condition).select("leaf_id", "row_id").distinct()
    return graph.membership_diff(part("l_linenumber <= 3"), part("l_linenumber >= 2")).select("row_id", "leaf_id", "change")


TERMS = r"list_transform(regexp_extract_all(regexp_replace({0}, '(\p{{Han}}+)', ' \1 ', 'g'), '[\p{{L}}\p{{Nd}}]+'), lambda w: lower(w))"


@query(f"SELECT term, count(*) AS n FROM (SELECT unnest({TERMS.format('text')}) AS term FROM documents) GROUP BY term")
def terms_tf(spark, sf_dir):
    return retrieval.postings(table(spark, sf_dir, "documents").select("text").withColumnRenamed("text", "value").withColumn("field_id", F.lit("text")), []).select("term", F.col("frequency").alias("n"))


@query(f"SELECT doc_id AS object_id, 'text' AS field_id, term, count(*) AS frequency FROM (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents) GROUP BY doc_id, term")
def postings(spark, sf_dir):
    return retrieval.postings(retrieval.documents_to_fields(table(spark, sf_dir, "documents"), "doc_id", ["text"]), ["object_id"])


FIELDS = "fields AS (SELECT p_partkey AS object_id, unnest([{'f': 'p_name', 'v': p_name}, {'f': 'p_brand', 'v': p_brand}, {'f': 'p_type', 'v': p_type}]) AS x FROM part)"


@query(f"""WITH d AS (SELECT doc_id AS object_id, 'text' AS field_id, unnest({TERMS.format('text')}) AS term FROM documents UNION ALL SELECT doc_id, 'lang', unnest({TERMS.format('lang')}) FROM documents)
  SELECT object_id, count(DISTINCT term) AS matched_term_count, count(DISTINCT field_id) AS matched_field_count, count(*) AS frequency FROM d WHERE term IN ('the', 'en', 'with', 'fr', 'der')
  GROUP BY object_id ORDER BY matched_term_count DESC, matched_field_count DESC, frequency DESC, object_id LIMIT 64""")
def lexical_locations(spark, sf_dir):
    words = ["the", "en", "with", "fr", "der"]
    wanted = spark.createDataFrame([(w,) for w in words], "term string")
    found = retrieval.postings(retrieval.documents_to_fields(table(spark, sf_dir, "documents"), "doc_id", ["text", "lang"]), ["object_id"], words)
    return retrieval.ranked(retrieval.lexical_locations(found, wanted, ["object_id"]), ["object_id"], 64).drop("matched_field_ids")


@query(f"""WITH {FIELDS}, s AS (SELECT object_id, len(list_intersect(list_distinct({TERMS.format("x.v")}), ['brand', '1', 'small', 'steel', 'part'])) AS n FROM fields)
  SELECT object_id, CAST(sum(n) AS BIGINT) AS score FROM s GROUP BY object_id HAVING sum(n) > 0 ORDER BY score DESC, object_id LIMIT 64""")
def route_candidates_lexical(spark, sf_dir):
    fields = retrieval.documents_to_fields(table(spark, sf_dir, "part"), "p_partkey", ["p_name", "p_brand", "p_type"])
    return retrieval.route_candidates(fields, F.array(*[F.lit(w) for w in ("brand", "1", "small", "steel", "part")]), ["object_id"], 64)


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, list_sum(list_transform(list_zip(embedding, q.e), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) AS s FROM embeddings, q) ORDER BY s DESC, vec_id LIMIT 16""")
def vector_topk_dot(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    first = vectors.where("vec_id = 0").select("embedding").first()[0]
    return retrieval.vector_candidates(vectors, first, 16).withColumn("score", F.round("score", 6))


@query("SELECT vec_id FROM embeddings WHERE abs(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) - 1) > 1e-7")
def vector_norm_check(spark, sf_dir):
    return retrieval.norm_violations(table(spark, sf_dir, "embeddings"), 1e-7).select("vec_id")


@query("""SELECT n_nationkey, n_name, bytes_so_far FROM (SELECT n_nationkey, n_name, CAST(sum(strlen(n_name) + 3) OVER (ORDER BY n_nationkey) + 1 AS BIGINT) AS bytes_so_far FROM nation) WHERE bytes_so_far <= 128""")
def byte_budget_page(spark, sf_dir):
    page = table(spark, sf_dir, "nation").orderBy("n_nationkey").limit(64)
    return retrieval.byte_budget(page, F.concat(F.lit('"'), "n_name", F.lit('"')), ["n_nationkey"], 128).select("n_nationkey", "n_name", F.col("bytes_so_far").cast("long").alias("bytes_so_far"))


def retrieval_run(spark, sf_dir):
    """Languages ask for good documents of sources; each run lists a source's labelled documents by length, one run backwards."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality")), "doc_id")
    queries = docs.select(F.col("source").alias("query_id"), F.concat(F.lit("g"), F.char_length("source").cast("string")).alias("group")).distinct()
    qrels = docs.select(F.col("source").alias("query_id"), F.col("doc_id").alias("document_id"), F.col("quality").alias("relevance"))
    by = docs.groupBy(F.col("source").alias("query_id"))
    up = by.agg(F.transform(F.array_sort(F.collect_list(F.struct("n_chars", "doc_id"))), lambda x: x["doc_id"]).alias("candidates")).withColumn("run_id", F.lit("up"))
    down = up.withColumn("candidates", F.reverse("candidates")).withColumn("run_id", F.lit("down"))
    return queries, qrels, up.unionByName(down).withColumn("status", F.when(F.col("query_id") == "src3", "failed").otherwise("completed"))


RETRIEVAL = """l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id), d AS (SELECT doc_id, source, n_chars, quality FROM documents JOIN l USING (doc_id)),
  r AS (SELECT 'up' AS run_id, *, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) - 1 AS pos FROM d UNION ALL SELECT 'down', *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id DESC) - 1 FROM d),
  s AS (SELECT run_id, source AS query_id, concat('g', length(source)) AS "group", CASE WHEN source = 'src3' THEN 0.0 ELSE coalesce(sum(CASE WHEN pos < 5 AND quality > 0 THEN 1.0 ELSE 0.0 END) / nullif(sum(CASE WHEN quality > 0 THEN 1.0 ELSE 0.0 END), 0), 0.0) END AS recall,
   CASE WHEN source <> 'src3' AND bool_or(pos < 5 AND quality > 0) THEN 1.0 ELSE 0.0 END AS hit, CASE WHEN source = 'src3' THEN 0.0 ELSE coalesce(1.0 / (min(CASE WHEN quality > 0 THEN pos END) + 1), 0.0) END AS reciprocal_rank FROM r GROUP BY run_id, source)"""


@query(f"WITH {RETRIEVAL} SELECT run_id, query_id, \"group\", CAST(round(recall, 6) AS DOUBLE) AS recall, CAST(hit AS DOUBLE) AS hit, CAST(round(reciprocal_rank, 6) AS DOUBLE) AS reciprocal_rank FROM s")
def retrieval_metrics(spark, sf_dir):
    return metrics.retrieval_scores(*retrieval_run(spark, sf_dir), 5).withColumns({c: F.round(c, 6) for c in ("recall", "reciprocal_rank")})


@query(f"""WITH {RETRIEVAL} SELECT run_id, "group", count(*) AS n_queries, round(avg(CAST(recall AS DOUBLE)), 6) AS recall, round(avg(CAST(hit AS DOUBLE)), 6) AS hit_rate, round(avg(CAST(reciprocal_rank AS DOUBLE)), 6) AS mrr
  FROM s GROUP BY GROUPING SETS ((run_id), (run_id, "group"))""")
def retrieval_by_group(spark, sf_dir):
    return metrics.macro_means(metrics.retrieval_scores(*retrieval_run(spark, sf_dir), 5)).withColumns({c: F.round(c, 6) for c in ("recall", "hit_rate", "mrr")})


@query("""WITH t AS (SELECT event_type, round(sum(value), 4) AS cost FROM events GROUP BY event_type) SELECT a.event_type, round((b.cost - a.cost) / nullif(b.cost, 0), 6) AS reduction FROM t a, t b WHERE b.event_type = 'view'""")
def cost_reduction(spark, sf_dir):
    totals = table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("cost"))
    base = totals.where("event_type = 'view'").select(F.col("cost").alias("base"))
    return totals.join(F.broadcast(base), F.lit(True)).select("event_type", F.round(metrics.cost_reduction(F.col("base"), F.col("cost")), 6).alias("reduction"))


REPORT = """SELECT event_type, {0} count(*) AS n_runs, count_if(value > 50) AS n_success, round(sum(value), 3) AS cost, max(value) AS max_latency, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM e GROUP BY {1}"""


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("bucket", F.col("user_id") % 4).withColumn("tier", F.col("user_id") % 3)


@query("WITH e AS (SELECT *, user_id % 4 AS bucket, user_id % 3 AS tier FROM events) " + REPORT.format("bucket, tier,", "GROUPING SETS ((event_type), (event_type, bucket), (event_type, tier))"))
def capability_grouping_sets(spark, sf_dir):
    report = metrics.capability_report(_events(spark, sf_dir), "event_type", ["bucket", "tier"], F.col("value") > 50, F.col("value"), "value")
    return report.drop("low", "high").withColumn("cost", F.round("cost", 3))


@query("""WITH c AS (SELECT event_type, count(*) AS n, count_if(value > 50) AS k FROM events GROUP BY event_type), w AS (SELECT *, k / CAST(n AS DOUBLE) AS p, 1.959963984540054 AS z FROM c)
  SELECT event_type, round(greatest(0, ((p + z * z / (2 * n)) - z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 6) AS low, round(least(1, ((p + z * z / (2 * n)) + z * sqrt(p * (1 - p) / n + z * z / (4.0 * n * n))) / (1 + z * z / n)), 6) AS high FROM w""")
def wilson_interval(spark, sf_dir):
    report = metrics.capability_report(_events(spark, sf_dir), "event_type", [], F.col("value") > 50, F.col("value"), "value")
    return report.select("event_type", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return metrics.capability_report(_events(spark, sf_dir), "event_type", [], F.lit(True), F.col("value"), "value").select("event_type", "p50", "p95")


@query("""WITH r AS (SELECT event_type, user_id % 4 AS bucket, count(*) AS n FROM events GROUP BY ALL) SELECT a.event_type, a.bucket, a.n AS n_runs, a.n - b.n AS delta FROM r a LEFT JOIN r b ON a.bucket = b.bucket AND b.event_type = 'view'""")
def baseline_deltas(spark, sf_dir):
    report = _events(spark, sf_dir).groupBy("event_type", "bucket").agg(F.count("*").alias("n_runs"))
    return metrics.deltas_to_baseline(report, "event_type", "view", ["bucket"], "n_runs")


@query("SELECT user_id, count(*) AS n_events, round(sum(value), 3) AS total, count_if(event_type = 'error') AS n_error FROM events GROUP BY user_id")
def trace_rollup(spark, sf_dir):
    out = metrics.trace_rollup(table(spark, sf_dir, "events"), ["user_id"], "event_type", F.col("value"))
    return out.select("user_id", "n_events", F.round("total", 3).alias("total"), F.coalesce(F.try_element_at("by_status", F.lit("error")), F.lit(0)).cast("long").alias("n_error"))


@query("SELECT DISTINCT conv_id, turn FROM conversations")
def trace_dedup(spark, sf_dir):
    twice = table(spark, sf_dir, "conversations")
    return metrics.deduplicated_events(twice.unionByName(twice), ["conv_id", "turn"], F.sha2("text", 256))[0].select("conv_id", "turn")


@query("SELECT role, count(DISTINCT text) AS n_contents FROM conversations GROUP BY role HAVING count(DISTINCT text) > 1")
def trace_conflicts(spark, sf_dir):
    return metrics.deduplicated_events(table(spark, sf_dir, "conversations"), ["role"], F.sha2("text", 256))[1]


@query("""WITH g AS (SELECT s_suppkey, s_nationkey, s_acctbal, max(s_acctbal) OVER (PARTITION BY s_nationkey) - s_acctbal AS delta FROM supplier), p AS (SELECT *, s_acctbal >= 1000 AND delta <= 2000 AS passes FROM g)
  SELECT s_suppkey, round(delta, 4) AS delta, passes, passes AND row_number() OVER (PARTITION BY s_nationkey ORDER BY passes DESC, s_acctbal DESC, s_suppkey) = 1 AS chosen FROM p""")
def release_gate(spark, sf_dir):
    out = metrics.release_gate(table(spark, sf_dir, "supplier"), ["s_nationkey"], "s_acctbal", ["s_suppkey"], 1000, 2000)
    return out.select("s_suppkey", F.round("delta", 4).alias("delta"), "passes", "chosen")


@query("""WITH b AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders), l AS (SELECT k, CASE WHEN k % 5 = 0 THEN 'L' ELSE v END AS v FROM b WHERE k % 11 <> 0), i AS (SELECT k, CASE WHEN k % 7 = 0 THEN 'I' ELSE v END AS v FROM b WHERE k % 13 <> 0),
  j AS (SELECT b.k AS k, b.v AS bv, l.k AS lk, l.v AS lv, i.k AS ik, i.v AS iv FROM b LEFT JOIN l ON b.k = l.k LEFT JOIN i ON b.k = i.k),
  a AS (SELECT *, CASE WHEN (lk IS NOT DISTINCT FROM ik AND lv IS NOT DISTINCT FROM iv) OR (ik IS NOT NULL AND iv IS NOT DISTINCT FROM bv) THEN 'local' WHEN lk IS NOT NULL AND lv IS NOT DISTINCT FROM bv THEN 'incoming' ELSE 'conflict' END AS action FROM j)
  SELECT k, action, CASE action WHEN 'local' THEN lv WHEN 'incoming' THEN iv END AS merged FROM a""")
def three_way_merge(spark, sf_dir):
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    local = base.where("k % 11 <> 0").withColumn("v", F.when(F.col("k") % 5 == 0, "L").otherwise(F.col("v")))
    incoming = base.where("k % 13 <> 0").withColumn("v", F.when(F.col("k") % 7 == 0, "I").otherwise(F.col("v")))
    return health.three_way_merge(base, local, incoming, "k", "v")


@query("""WITH a AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p FROM orders), b AS (SELECT k, CASE WHEN k % 9 = 0 THEN 'X' ELSE s END AS s, CASE WHEN k % 10 = 0 THEN NULL ELSE p END AS p FROM a)
  SELECT k, 's' AS field FROM a JOIN b USING (k) WHERE a.s IS DISTINCT FROM b.s UNION ALL SELECT k, 'p' FROM a JOIN b USING (k) WHERE a.p IS DISTINCT FROM b.p""")
def field_diff(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    right = left.withColumn("s", F.when(F.col("k") % 9 == 0, "X").otherwise(F.col("s"))).withColumn("p", F.when(F.col("k") % 10 != 0, F.col("p")))
    return health.field_differences(left, right, "k", ["s", "p"]).select("k", "field")


@query("SELECT sha256(text) AS digest, count(*) AS n_rows, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_rows(spark, sf_dir):
    return health.duplicate_groups(table(spark, sf_dir, "documents"), F.col("text"), "doc_id")


@query("""WITH n AS (SELECT n_regionkey AS parent_id, n_nationkey AS id, lower(trim(unnest([n_name, substr(n_name, 1, 1)]))) AS name FROM nation) SELECT parent_id, name, count(DISTINCT id) AS n_routes FROM n GROUP BY ALL HAVING count(DISTINCT id) > 1""")
def ambiguous_siblings(spark, sf_dir):
    nodes = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("parent_id"), F.col("n_nationkey").alias("route_id"), F.col("n_name").alias("name"), F.array(F.substr("n_name", F.lit(1), F.lit(1))).alias("aliases"), F.lit(False).alias("deleted"))
    return health.ambiguous_siblings(nodes)


def _members(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("leaf_id"), F.col("l_orderkey").alias("row_id"), F.col("l_linenumber").alias("revision"), F.lit(False).alias("deleted"))


@query("SELECT l_orderkey AS row_id, l_suppkey AS leaf_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0)")
def orphan_membership(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("row_id"))
    return health.orphan_memberships(_members(spark, sf_dir), rows).select("row_id", "leaf_id")


@query("SELECT c_custkey AS row_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0)")
def unrouted_rows(spark, sf_dir):
    members = table(spark, sf_dir, "orders").where("o_orderkey % 7 = 0").select(F.col("o_custkey").alias("row_id"), F.lit(False).alias("deleted"))
    return health.unrouted_rows(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id")), members)


@query("SELECT l_suppkey AS leaf_id, count(DISTINCT l_orderkey) AS n_rows FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_orderkey) > 1")
def crowded_leaves(spark, sf_dir):
    return health.crowded_leaves(_members(spark, sf_dir))


@query(r"SELECT page_id, number, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '[-+]?[0-9]+(?:\.[0-9]+)?%?')) AS number FROM pages) GROUP BY ALL")
def numeric_evidence(spark, sf_dir):
    return health.numeric_evidence(table(spark, sf_dir, "pages"), "page_id", F.col("html"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey - 3 >= 100 AND o_orderstatus <> 'F' OR o_custkey % 50 = 7")
def statement_select(spark, sf_dir):
    """The same rows through the statement language, unbounded scan."""
    from ..language.session import Session

    session = Session(spark)
    session.attach("trade", "orders", table(spark, sf_dir, "orders"), row_id="o_orderkey")
    return session.plan("SELECT o_orderkey, o_custkey, o_orderstatus FROM trade.orders WHERE o_custkey - 3 >= 100 AND o_orderstatus != 'F' OR o_custkey % 50 = 7", bounded=False)


@query("SELECT o_orderkey, o_custkey FROM (SELECT * FROM orders ORDER BY strlen(CAST(o_orderkey AS VARCHAR)), CAST(o_orderkey AS VARCHAR) LIMIT 1000) WHERE o_custkey > 700 ORDER BY strlen(CAST(o_orderkey AS VARCHAR)), CAST(o_orderkey AS VARCHAR) LIMIT 20")
def statement_bounded(spark, sf_dir):
    """Scan and row budgets: of the first 1000 rows in scan order the first 20 that match."""
    from ..language.session import Session

    session = Session(spark)
    session.attach("trade", "orders", table(spark, sf_dir, "orders"), row_id="o_orderkey")
    return session.plan("SELECT o_orderkey, o_custkey FROM trade.orders WHERE o_custkey > :c LIMIT 20", {"c": 700})


@query("SELECT e.event_id, e.user_id, e.event_type, o.o_orderkey FROM events e JOIN orders o ON e.user_id = o.o_custkey WHERE e.event_type = 'purchase'")
def ext_join(spark, sf_dir):
    """Extension: joins, which statements don't have."""
    events = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "user_id", "event_type")
    return events.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("user_id") == F.col("o_custkey")).select("event_id", "user_id", "event_type", "o_orderkey")


@query("""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n_events, min(event_id) AS first_event FROM s GROUP BY user_id, session""")
def ext_sessions(spark, sf_dir):
    """Extension: sessions of events with gaps of at most six hours."""
    own = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.lag("ts").over(own)
    rows = table(spark, sf_dir, "events").withColumn("n", F.when(gap.isNull() | (F.col("ts") - gap > F.expr("INTERVAL 6 HOURS")), 1).otherwise(0))
    rows = rows.withColumn("session", F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.min("event_id").alias("first_event"))


@query("SELECT o_custkey, o_orderkey, r FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS r FROM orders) WHERE r <= 3")
def ext_window_topn(spark, sf_dir):
    """Extension: each customer's three largest orders."""
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, sf_dir, "orders").withColumn("r", r).where("r <= 3").select("o_custkey", "o_orderkey", "r")


@query("""SELECT event_type, count(*) AS n, count_if(user_id % 3 = 0) AS n_completed, count_if(user_id % 3 = 1) AS n_failed, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(avg(value), 6) AS value FROM events GROUP BY event_type""")
def answer_evaluation(spark, sf_dir):
    answers = table(spark, sf_dir, "events").withColumn("status", F.when(F.col("user_id") % 3 == 0, "completed").when(F.col("user_id") % 3 == 1, "failed").otherwise("open"))
    return metrics.answer_evaluation(answers, ["event_type"], "status", "value", ["value"]).withColumn("value", F.round("value", 6))


@query("""WITH g AS (SELECT count(*) AS n, count_if(value > 60) AS n_baseline, count_if(value > 40) AS n_candidate, round(avg(user_id - value), 6) AS latency_change FROM events)
  SELECT *, CAST((n_candidate - n_baseline) * 10000 // n AS BIGINT) AS gain, CASE WHEN (n_candidate - n_baseline) * 10000 // n < 500 THEN 'keep' WHEN latency_change > 100 THEN 'too_slow' ELSE 'adopt' END AS decision FROM g""")
def evidence_gate(spark, sf_dir):
    samples = table(spark, sf_dir, "events").select((F.col("value") > 60).alias("a"), (F.col("value") > 40).alias("b"), F.col("value").alias("ma"), F.col("user_id").alias("mb"))
    return metrics.evidence_gate(samples, "a", "b", "ma", "mb", 500, 100.0).withColumn("latency_change", F.round("latency_change", 6))


@query("""SELECT l_linestatus, count(*) AS n_runs, round(sum(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) / CAST(sum(l_linenumber) AS DOUBLE), 6) AS level_top1, round(count_if(l_discount > 0.05) / CAST(count(*) AS DOUBLE), 6) AS exact_path, round(count_if(l_tax > 0.02) / CAST(count(*) AS DOUBLE), 6) AS row_found FROM lineitem GROUP BY l_linestatus""")
def route_benchmark(spark, sf_dir):
    runs = table(spark, sf_dir, "lineitem").select("l_linestatus", "l_linenumber", F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("c"), (F.col("l_discount") > 0.05).alias("e"), (F.col("l_tax") > 0.02).alias("f"))
    return metrics.route_benchmark(runs, ["l_linestatus"], "l_linenumber", "c", "e", "f").withColumns({c: F.round(c, 6) for c in ("level_top1", "exact_path", "row_found")})


@query("SELECT p_partkey, sha256(concat(p_name, chr(1), p_brand, chr(1), p_type)) AS digest FROM part")
def surface_digests(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", retrieval.surface_digest(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("digest"))


@query("""SELECT p_partkey, bytes_so_far FROM (SELECT p_partkey, CAST(row_number() OVER w AS BIGINT) AS place, CAST(sum(strlen(p_name) + 1) OVER (ORDER BY p_retailprice DESC, p_partkey ROWS UNBOUNDED PRECEDING) + 1 AS BIGINT) AS bytes_so_far FROM part WINDOW w AS (ORDER BY p_retailprice DESC, p_partkey)) WHERE place <= 64 AND bytes_so_far <= 700""")
def discovery_frame(spark, sf_dir):
    out = retrieval.discovery_frame(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), [F.desc("p_retailprice"), "p_partkey"], 64, 700, F.col("p_name"))
    return out.select("p_partkey", F.col("bytes_so_far").cast("long").alias("bytes_so_far"))


@query("SELECT l_suppkey AS leaf_id, l_orderkey AS row_id, l_linenumber AS revision, current FROM lineitem JOIN (SELECT l_orderkey AS k, max(l_linenumber) AS current FROM lineitem GROUP BY l_orderkey) ON l_orderkey = k WHERE l_linenumber < current")
def stale_membership(spark, sf_dir):
    members = _members(spark, sf_dir)
    return health.stale_memberships(members, members.groupBy("row_id").agg(F.max("revision").alias("revision"))).select("leaf_id", "row_id", "revision", "current")


@query("""SELECT p_brand AS table_id, p_size AS type, lower(regexp_replace(p_type, '[^A-Za-z0-9]+', ' ', 'g')) AS purpose, count(*) AS n_columns FROM part GROUP BY ALL HAVING count(*) > 1""")
def synonymous_columns(spark, sf_dir):
    columns = table(spark, sf_dir, "part").select(F.col("p_brand").alias("table_id"), F.col("p_size").alias("type"), F.lit(True).alias("nullable"), F.col("p_type").alias("purpose"), F.col("p_name").alias("name"))
    return health.synonymous_columns(columns).select("table_id", "type", "purpose", "n_columns")


@query("SELECT o_custkey AS table_id FROM orders GROUP BY o_custkey HAVING max(o_orderdate) > min(o_orderdate) + INTERVAL 30 DAY")
def stale_description(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("table_id"), F.col("o_orderdate").alias("updated_at"))
    return health.stale_descriptions(rows.groupBy("table_id").agg(F.min("updated_at").alias("updated_at")), rows).select("table_id")


@query("SELECT 'crowded' AS kind, CAST(l_suppkey AS VARCHAR) AS object_id, CAST(count(DISTINCT l_orderkey) AS VARCHAR) AS detail FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_orderkey) > 1 UNION ALL SELECT 'unrouted', CAST(c_custkey AS VARCHAR), 'row' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 7 = 0) ORDER BY kind, object_id, detail LIMIT 512")
def health_report(spark, sf_dir):
    crowded = health.crowded_leaves(_members(spark, sf_dir)).select(F.lit("crowded").alias("kind"), F.col("leaf_id").cast("string").alias("object_id"), F.col("n_rows").cast("string").alias("detail"))
    unrouted = QUERIES["unrouted_rows"](spark, sf_dir).select(F.lit("unrouted").alias("kind"), F.col("row_id").cast("string").alias("object_id"), F.lit("row").alias("detail"))
    return health.issue_report([crowded, unrouted])


@query("SELECT event_id FROM events WHERE ts + INTERVAL 30 DAY > TIMESTAMP '2024-02-15'")
def trace_retention(spark, sf_dir):
    from ..streaming import retained

    traces = table(spark, sf_dir, "events").select("event_id", (F.col("ts") + F.expr("INTERVAL 30 DAYS")).alias("expires_at"))
    return retained(traces, F.expr("TIMESTAMP_NTZ '2024-02-15 00:00:00'")).select("event_id")


@query("WITH j AS (SELECT user_id AS job_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, event_id FROM events) SELECT job_id, seq FROM j WHERE seq > 0 AND event_id % 50 = 0")
def journal_breaks(spark, sf_dir):
    """A hash chain in which every fiftieth event was put in wrongly."""
    from ..streaming import chain_breaks

    own = Window.partitionBy("user_id").orderBy("event_id")
    journal = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), (F.row_number().over(own) - 1).cast("long").alias("seq"), F.sha2(F.col("event_id").cast("string"), 256).alias("hash"), "event_id", "user_id")
    journal = journal.withColumn("previous", F.when(F.col("event_id") % 50 == 0, F.when(F.col("seq") > 0, "wrong")).otherwise(F.lag("hash").over(own)))
    return chain_breaks(journal).select("job_id", "seq")
