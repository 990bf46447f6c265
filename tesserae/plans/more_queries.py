"""Queries of sources, sinks, reports and streams that read and write files made from the test tables."""

from __future__ import annotations

import hashlib
import io
import json
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import streaming
from ..functions import terms
from ..operators import health, metrics
from ..sources import documents, pages, snapshots, suites
from ..store.files import Files
from .queries import query, table
from .store_queries import fresh, listed, new_root

# --- sources and sinks


def files_of(spark: SparkSession, name: str, contents: dict[str, bytes]) -> str:
    root = new_root(spark, name)
    files = Files(spark, root)
    files.make("")
    for k, v in contents.items():
        files.publish(k, v)
    return root


def _zipped(members: dict[str, str]) -> bytes:
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for k, v in members.items():
            z.writestr(k, v)
    return data.getvalue()


def _pdf(lines: list[str]) -> bytes:
    """A page for each line, the streams deflated."""
    objects = ["<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(f'{4 + 2 * k} 0 R' for k in range(len(lines)))}] /Count {len(lines)} >>", "<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    out = b"%PDF-1.4\n"
    bodies: list[bytes] = [o.encode() for o in objects]
    for k, line in enumerate(lines):
        raw = zlib.compress(f"BT /F1 12 Tf 72 700 Td ({line}) Tj 0 -14 Td [(nu) -50 (mber) -400 ({k})] TJ ET".encode("cp1252"))
        bodies.append(f"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents {5 + 2 * k} 0 R >>".encode())
        bodies.append(f"<< /Length {len(raw)} /Filter /FlateDecode >>\nstream\n".encode() + raw + b"\nendstream")
    for n, body in enumerate(bodies):
        out += f"{n + 1} 0 obj\n".encode() + body + b"\nendobj\n"
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


@query("""WITH n AS (SELECT r_regionkey, r_name, n_name, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS k FROM region JOIN nation ON n_regionkey = r_regionkey)
  SELECT 'epub' AS format, 'contents' AS kind, 'c' || r_regionkey || '.xhtml' AS label, r_name AS text, NULL AS parent FROM region
  UNION ALL SELECT 'epub', 'heading', '1', r_name, NULL FROM region UNION ALL SELECT 'epub', CASE WHEN k = 1 THEN 'paragraph' ELSE 'item' END, NULL, n_name, r_name FROM n
  UNION ALL SELECT 'docx', 'heading', '1', r_name, NULL FROM region UNION ALL SELECT 'docx', 'row', NULL, k || chr(9) || n_name, r_name FROM n
  UNION ALL SELECT 'pdf', 'page', CAST(r_regionkey + 1 AS VARCHAR), r_name || chr(10) || 'number ' || r_regionkey, NULL FROM region""")
def document_nodes(spark, sf_dir):
    """Regions as chapters of an EPUB, headings of a DOCX and pages of a PDF, nations below them."""
    regions = {r["r_regionkey"]: r["r_name"] for r in table(spark, sf_dir, "region").collect()}
    below: dict[int, list[str]] = {}
    for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect():
        below.setdefault(r["n_regionkey"], []).append(r["n_name"])
    keys = sorted(regions)
    chapter = lambda k: f"<html><head><title>no</title></head><body><h1 id='h'>{regions[k]}</h1>{below[k][0]}<ul>{''.join(f'<li><p>{n}</p></li>' for n in below[k][1:])}</ul><script>no</script></body></html>"
    nav = "<html><body><nav><ol>" + "".join(f"<li><a href='c{k}.xhtml'>{regions[k]}</a></li>" for k in keys) + "</ol></nav></body></html>"
    package = '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="nav" href="nav.xhtml" properties="nav"/>' + "".join(f'<item id="c{k}" href="c{k}.xhtml"/>' for k in keys) + "</manifest><spine>" + "".join(f'<itemref idref="c{k}"/>' for k in keys) + "</spine></package>"
    epub = _zipped({"META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>', "o/p.opf": package, "o/nav.xhtml": nav} | {f"o/c{k}.xhtml": chapter(k) for k in keys})
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    part = lambda k: f'<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>{regions[k]}</w:t></w:r></w:p><w:tbl>' + "".join(f"<w:tr><w:tc><w:p><w:r><w:t>{n + 1}</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>{x}</w:t></w:r></w:p></w:tc></w:tr>" for n, x in enumerate(below[k])) + "</w:tbl>"
    docx = _zipped({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{"".join(map(part, keys))}</w:body></w:document>'})
    path = files_of(spark, "books", {"a.epub": epub, "b.docx": docx, "c.pdf": _pdf([regions[k] for k in keys])})
    nodes = documents.read_documents(spark, path)
    parents = nodes.select("document_id", F.col("node_id").alias("parent_id"), F.col("text").alias("parent"))
    return nodes.join(parents, ["document_id", "parent_id"], "left").select(F.regexp_extract("document_id", r"\.(\w+)$", 1).alias("format"), "kind", "label", "text", "parent")


@query("SELECT CAST(doc_id AS VARCHAR) AS query_id, 'all' AS \"group\", 'text ' || doc_id AS text, CAST(quality AS INTEGER) AS relevance FROM (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL AND doc_id < 100 GROUP BY doc_id)")
def suite_files(spark, sf_dir):
    """Labels as topics and judgements in tab-separated files, with and without header, and JSON lines; read back and compared."""
    rows = table(spark, sf_dir, "labels").where("quality is not null and doc_id < 100").groupBy("doc_id").agg(F.max("quality").alias("q")).collect()
    text = lambda lines: ("\n".join(lines) + "\n").encode()
    path = files_of(spark, "suite", {
        "topics.tsv": text(f"{r['doc_id']}\ttext {r['doc_id']}" for r in rows), "qrels.tsv": text(f"{r['doc_id']}\tQ0\t{r['doc_id']}\t{r['q']}" for r in rows),
        "head.tsv": text(["query-id\tcorpus-id\tscore", *(f"{r['doc_id']}\t{r['doc_id']}\t{r['q']}" for r in rows)]), "queries.jsonl": text(json.dumps({"_id": str(r["doc_id"]), "text": f"text {r['doc_id']}"}) for r in rows),
    })
    topics, qrels = suites.topics_tsv(spark, f"{path}/topics.tsv"), suites.qrels_trec(spark, f"{path}/qrels.tsv")
    assert qrels.exceptAll(suites.qrels_header_tsv(spark, f"{path}/head.tsv")).isEmpty() and topics.exceptAll(suites.queries_jsonl(spark, f"{path}/queries.jsonl").select(*topics.columns)).isEmpty()
    return topics.join(qrels, "query_id").select("query_id", "group", "text", "relevance")


@query("SELECT 'customer' AS name, CAST(c_custkey AS BIGINT) AS key, c_name AS text FROM customer UNION ALL SELECT 'nation', n_nationkey, n_name FROM nation UNION ALL SELECT 'unknown fields', 1, '{\"more\":\"kept\"}' UNION ALL SELECT 'old format', 2, 'b' UNION ALL SELECT 'damaged', 0, 'refused'")
def snapshot_round_trip(spark, sf_dir):
    """Frames as a logical snapshot and a backup, both read back; fields that nobody knows are kept; the former format is brought up to date."""
    frames = {n: table(spark, sf_dir, n) for n in ("customer", "nation")}
    path, copy = new_root(spark, "snapshot"), new_root(spark, "backup")
    snapshots.export_snapshot(frames, path)
    back = snapshots.import_snapshot(spark, path)
    held = snapshots.restore_backup(spark, copy, snapshots.backup(frames, copy))
    assert back["nation"].exceptAll(held["nation"].select(*back["nation"].columns)).isEmpty()
    raw = files_of(spark, "unknown", {"u.json": b'{"i": 1, "more": "kept"}\n', "old.json": json.dumps({"version": 0, "items": [{"id": 2, "text": "b"}]}).encode()})
    unknown = snapshots.with_unknown_fields(spark, f"{raw}/u.json", "i long")
    old = snapshots.migrate(spark, f"{raw}/old.json", "id long, text string")
    try:
        snapshots.restore_backup(spark, copy, {"nation": {"rows": 1, "digest": "0"}})
        damaged = "taken"
    except ValueError:
        damaged = "refused"
    out = back["customer"].select(F.lit("customer").alias("name"), F.col("c_custkey").cast("long").alias("key"), F.col("c_name").alias("text"))
    out = out.unionByName(held["nation"].select(F.lit("nation").alias("name"), F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("text")))
    out = out.unionByName(unknown.select(F.lit("unknown fields").alias("name"), F.col("i").alias("key"), F.col("extra").alias("text")))
    return out.unionByName(old.select(F.lit("old format").alias("name"), F.col("id").alias("key"), "text")).unionByName(listed(spark, [("damaged", 0, damaged)], "name string, key long, text string"))


@query("""SELECT CAST(r_regionkey AS VARCHAR) AS row_id, '# ' || r_name || chr(10) || chr(10) || chr(10) || chr(10) || '## Relations' || chr(10) || chr(10) || string_agg('- in lies in [[n' || n_nationkey || ']]', chr(10) ORDER BY '- in lies in [[n' || n_nationkey || ']]') || chr(10) AS page
  FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name
  UNION ALL SELECT 'n' || n_nationkey, '# ' || n_name || chr(10) || chr(10) || 'nation' || chr(10) || chr(10) || '## Relations' || chr(10) || chr(10) || '- out lies in [[' || n_regionkey || ']]' || chr(10) FROM nation""")
def wiki_pages(spark, sf_dir):
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    rows = region.select(F.col("r_regionkey").cast("string").alias("row_id"), F.col("r_name").alias("title"), F.lit(None).cast("string").alias("body"))
    rows = rows.unionByName(nation.select(F.concat(F.lit("n"), "n_nationkey").alias("row_id"), F.col("n_name").alias("title"), F.lit("nation").alias("body")))
    edges = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("source_id"), F.lit("lies in").alias("relation_type"), F.col("n_regionkey").cast("string").alias("target_id"))
    return pages.render(rows, edges).select("row_id", "page")


@query("SELECT * FROM (VALUES ('good', 'read'), ('unknown field', 'refused'), ('failed with candidates', 'refused'), ('not JSON', 'refused'), ('too large', 'refused')) AS v(test_case, outcome)")
def run_files(spark, sf_dir):
    good = {"run_id": "a", "arm": "x", "query_id": "q", "status": "completed", "candidates": ["d"], "input_tokens": 1, "output_tokens": 1, "tool_calls": 0, "model_calls": 1, "context_characters": 5, "end_to_end_microseconds": 9}
    contents = {"good": json.dumps(good), "unknown field": json.dumps(good | {"odd": 1}), "failed with candidates": json.dumps(good | {"status": "failed"}), "not JSON": "{", "too large": json.dumps(good)}
    path = files_of(spark, "runs", {f"{k.replace(' ', '_')}.json": (v + "\n").encode() for k, v in contents.items()})

    def outcome(k: str) -> str:
        try:
            suites.run_json(spark, f"{path}/{k.replace(' ', '_')}.json", most_bytes=10 if k == "too large" else suites.MOST_BYTES).collect()
            return "read"
        except Exception:
            return "refused"

    return listed(spark, [(k, outcome(k)) for k in contents], "test_case string, outcome string")


@query("SELECT r_name || '.txt' AS file, CASE r_regionkey WHEN 0 THEN 'changed' WHEN 1 THEN 'unexpected' ELSE 'good' END AS state FROM region UNION ALL SELECT 'none.txt', 'missing'")
def dataset_verified(spark, sf_dir):
    rows = table(spark, sf_dir, "region").collect()
    path = files_of(spark, "dataset", {f"{r['r_name']}.txt": r["r_name"].encode() for r in rows})
    sums = {f"{r['r_name']}.txt": hashlib.sha256((r["r_name"] + "x" * (r["r_regionkey"] == 0)).encode()).hexdigest() for r in rows if r["r_regionkey"] != 1}
    return suites.verified(spark, path, sums | {"none.txt": "0"})


# --- text

TEXTS = ["Alpha 東京都 beta", "ΟΔΟΣ ΣΟΦΟΣ", "İstanbul 7", "中", "a東b京", "日本 日本", "Größe, 3,5 m²", "x__y"]


@query("""SELECT * FROM (VALUES (0, 'alpha,東京,京都,beta'), (1, 'οδοσ,σοφοσ'), (2, 'istanbul,7'), (3, '中'), (4, 'a,東,b,京'), (5, '日本,日本'), (6, 'größe,3,5,m'), (7, 'x,y')) AS v(place, words)""")
def terms_of_scripts(spark, sf_dir):
    """Words in order: pairs of Han characters, other words lowered letter by letter."""
    return listed(spark, list(enumerate(TEXTS)), "place int, text string").select("place", F.array_join(terms(F.col("text")), ",").alias("words"))


# --- reports


def capability_runs(spark, sf_dir) -> DataFrame:
    """Events as runs: the type is the arm, the user bucket the scenario; each arm has a run a scenario at most."""
    e = table(spark, sf_dir, "events")
    arm = F.create_map(*[F.lit(x) for p in (("view", "router"), ("click", "hybrid_prefetch"), ("signup", "hybrid"), ("error", "vector"), ("purchase", "lexical")) for x in p])
    n = F.col("event_id")
    return e.where("user_id < 40").groupBy(F.element_at(arm, F.col("event_type")).alias("arm"), F.concat(F.lit("s"), "user_id").alias("scenario_id")).agg(F.min("event_id").alias("event_id")).select(
        "arm", "scenario_id", F.lit("h/m").alias("host_model"), F.lit("p").alias("provider"), F.when(n % 3 == 0, "m1").otherwise("m2").alias("model"),
        F.when(n % 11 == 0, "failed").when(n % 13 == 0, "cancelled").when(n % 17 == 0, "budget_exhausted").otherwise("completed").alias("status"), (n % 5 != 0).alias("exact_path_success"), (n % 4 != 0).alias("rowid_success"),
        (n % 2 == 0).alias("predictor_eligible"), (n % 6 == 0).alias("predictor_hit"), (n % 3 == 0).alias("prefetch_eligible"), (n % 9 == 0).alias("prefetch_hit"), (n % 4 + 1).alias("levels_expected"), (n % 2).alias("level_top1_correct"),
        *[(n % (3 + k)).alias(c) for k, c in enumerate(metrics.SUMS[2:10])], *[F.when(n % (19 + k) == 0, 1).otherwise(0).cast("long").alias(c) for k, c in enumerate(metrics.SAFETY)],
        *[(n % (7 + k)).alias(c) for k, c in enumerate(metrics.PEAKS)], *[(n % (100 + k)).alias(c) for k, c in enumerate(metrics.LATENCIES)],
    )


_RUNS = (
    "runs AS (SELECT CASE event_type WHEN 'view' THEN 'router' WHEN 'click' THEN 'hybrid_prefetch' WHEN 'signup' THEN 'hybrid' WHEN 'error' THEN 'vector' WHEN 'purchase' THEN 'lexical' END AS arm, 's' || user_id AS scenario_id, min(event_id) AS n FROM events WHERE user_id < 40 GROUP BY ALL), "
    "r AS (SELECT *, CASE WHEN n % 11 = 0 THEN 'failed' WHEN n % 13 = 0 THEN 'cancelled' WHEN n % 17 = 0 THEN 'budget_exhausted' ELSE 'completed' END AS status, (n % 19 = 0 OR n % 20 = 0 OR n % 21 = 0 OR n % 22 = 0) AS unsafe, CASE WHEN n % 3 = 0 THEN 'm1' ELSE 'm2' END AS model FROM runs)"
)


@query(f"""WITH {_RUNS} SELECT arm, count(*) AS runs, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'cancelled') AS cancelled, count(*) FILTER (status = 'budget_exhausted') AS budget_exhausted,
  CAST(sum(n % 4 + 1) AS BIGINT) AS levels_expected, CAST(sum(n % 2) AS BIGINT) AS level_top1_correct, CAST(sum(n % 4) AS BIGINT) AS model_calls, CAST(sum(n % 6) AS BIGINT) AS input_tokens, count(*) FILTER (n % 5 <> 0) AS exact_path_success, count(*) FILTER (n % 4 <> 0) AS rowid_success,
  count(*) FILTER (status <> 'completed' OR n % 5 = 0 OR n % 4 = 0 OR unsafe) AS failure_cells, max(n % 7) AS generation_bytes, CAST(quantile_disc(n % 104, 0.5) AS DOUBLE) AS end_to_end_ms_p50, CAST(quantile_disc(n % 104, 0.95) AS DOUBLE) AS end_to_end_ms_p95, count(*) FILTER (n % 6 = 0) * 1.0 / nullif(count(*) FILTER (n % 2 = 0), 0) AS predictor,
  CAST(CASE WHEN count(*) FILTER (model = 'm2') = 0 THEN sum((n % 6) * 2000000 // 1000000) END AS BIGINT) AS input_micros FROM r GROUP BY arm""")
def bucket_measures(spark, sf_dir):
    prices = listed(spark, [("p", "m1", 2_000_000, 3_000_000)], "provider string, model string, input_micros long, output_micros long")
    out = metrics.bucket_summary(capability_runs(spark, sf_dir), ["arm"], prices)
    return out.select("arm", "runs", *metrics.STATUSES, "levels_expected", "level_top1_correct", "model_calls", "input_tokens", "exact_path_success", "rowid_success", "failure_cells", "generation_bytes", "end_to_end_ms_p50", "end_to_end_ms_p95", "predictor", "input_micros")


@query(f"""WITH {_RUNS}, base AS (SELECT * FROM r WHERE arm = 'router'), arms AS (SELECT * FROM (VALUES ('hybrid_prefetch', 0), ('hybrid', 1), ('vector', 2), ('lexical', 3)) AS v(arm, place)),
  cells AS (SELECT a.arm, a.place, count(*) FILTER (c.n IS NULL) AS missing, count(*) FILTER (b.n % 4 <> 0 AND c.n % 4 = 0) AS lost, count(*) FILTER (c.status <> 'completed') AS unfinished, count(*) FILTER (c.unsafe) AS unsafe, count(*) AS n_base FROM arms a CROSS JOIN base b LEFT JOIN r c ON c.arm = a.arm AND c.scenario_id = b.scenario_id GROUP BY ALL),
  t AS (SELECT arm, count(*) AS n, count(*) FILTER (n % 5 <> 0) AS exact, sum(n % 4) AS calls, quantile_disc(n % 104, 0.95) AS p95 FROM r GROUP BY arm), j AS (SELECT c.*, t.n, t.exact, t.calls, t.p95, b.exact AS b_exact, b.calls AS b_calls, b.p95 AS b_p95 FROM cells c LEFT JOIN t USING (arm), (SELECT * FROM t WHERE arm = 'router') b),
  judged AS (SELECT arm, place, array_to_string(list_filter([CASE WHEN p95 > b_p95 THEN 'end_to_end_p95_regression' END, CASE WHEN exact < b_exact THEN 'exact_path_regression' END, CASE WHEN unfinished > 0 THEN 'incomplete_cells' END, CASE WHEN missing > 0 OR n <> n_base THEN 'incomplete_matrix' END, CASE WHEN lost > 0 THEN 'matched_rowid_regression' END,
    CASE WHEN coalesce((b_calls - calls) / nullif(b_calls, 0) < 0.05, true) THEN 'model_call_savings_below_5_percent' END, CASE WHEN unsafe > 0 THEN 'safety_failure' END], lambda x: x IS NOT NULL), ',') AS reasons FROM j)
  SELECT arm, CAST(place AS INTEGER) AS place, reasons, reasons = '' AS eligible, coalesce(place = (SELECT min(place) FROM judged WHERE reasons = ''), false) AS chosen FROM judged""")
def default_arms(spark, sf_dir):
    return metrics.default_arm(capability_runs(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", ","))


@query("""WITH e AS (SELECT user_id % 7 AS session, day(ts) % 3 AS turn, event_type, CAST(floor(value) AS BIGINT) AS v FROM events)
  SELECT session, NULL AS turn, count(*) AS n_events, CAST(sum(v) AS BIGINT) AS total, (SELECT string_agg(event_type || '=' || n, ',' ORDER BY event_type) FROM (SELECT event_type, count(*) AS n FROM e x WHERE x.session = e.session GROUP BY event_type)) AS by_type FROM e GROUP BY session
  UNION ALL SELECT session, turn, count(*), CAST(sum(v) AS BIGINT), (SELECT string_agg(event_type || '=' || n, ',' ORDER BY event_type) FROM (SELECT event_type, count(*) AS n FROM e x WHERE x.session = e.session AND x.turn = e.turn GROUP BY event_type)) FROM e GROUP BY session, turn""")
def trace_turns(spark, sf_dir):
    """Sessions and their turns with a map of counts by type."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("session"), (F.dayofmonth("ts") % 3).cast("long").alias("turn"), "event_type", F.call_function("floor", "value").cast("long").alias("v"))
    out = metrics.trace_levels(e, "session", "turn", ["event_type"], F.col("v"))
    shown = F.array_join(F.transform(F.map_entries("by_event_type"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    return out.select("session", "turn", "n_events", "total", shown.alias("by_type"))


@query("""WITH a AS (SELECT event_type AS arm, CASE WHEN event_id % 9 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN user_id % 2 = 0 THEN 'fact' ELSE 'list' END AS category, (event_id % 10) / 10.0 AS score, event_id % 100 AS tokens, event_id % 7 AS calls, event_id % 1000 AS latency FROM events),
  s AS (SELECT arm, count(*) AS n_cases, avg(CASE WHEN status = 'completed' THEN 1.0 ELSE 0.0 END) AS completed, avg(score) FILTER (status = 'completed') AS score, count(*) FILTER (status = 'failed' OR score < CASE category WHEN 'fact' THEN 0.3 ELSE 0 END) AS below_minimum, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(calls) AS BIGINT) AS calls, CAST(quantile_disc(latency, 0.95) AS DOUBLE) AS p95 FROM a GROUP BY arm),
  d AS (SELECT *, max(score) OVER () - score AS delta FROM s), p AS (SELECT *, completed >= 0.8 AND below_minimum < 0 AND delta <= 0.2 AS passes FROM d)
  SELECT arm, n_cases, round(completed, 9) AS completed, round(score, 9) AS score, below_minimum, tokens, calls, p95, round(delta, 9) AS delta, completed >= 0.8 AND below_minimum = 0 AND delta <= 0.2 AS passes, false AS chosen FROM p""")
def release_decisions(spark, sf_dir):
    e, n = table(spark, sf_dir, "events"), F.col("event_id")
    answers = e.select(F.col("event_type").alias("arm"), F.when(n % 9 == 0, "failed").otherwise("completed").alias("status"), F.when(F.col("user_id") % 2 == 0, "fact").otherwise("list").alias("category"), ((n % 10) / 10.0).alias("m"), (n % 100).alias("tokens"), (n % 7).alias("calls"), (n % 1000).alias("latency"))
    out = metrics.release_decision(answers, {"fact": 0.3}, 0.8, 0.2, "m")
    return out.select("arm", "n_cases", F.round("completed", 9).alias("completed"), F.round("score", 9).alias("score"), "below_minimum", "tokens", "calls", "p95", F.round("delta", 9).alias("delta"), "passes", "chosen")


@query("""SELECT 'r' || o_orderkey AS run_id, CAST(3 AS BIGINT) AS levels_expected, CAST(CASE WHEN o_orderkey % 4 = 0 THEN 3 WHEN o_orderkey % 4 = 1 THEN 2 WHEN o_orderkey % 4 = 2 THEN 0 ELSE 1 END AS BIGINT) AS level_top1_correct, o_orderkey % 4 = 0 AS exact_path_success, o_orderkey % 3 = 0 AS rowid_success, o_orderkey % 2 = 0 AS predictor_eligible, o_orderkey % 6 = 0 AS predictor_hit, false AS prefetch_eligible, false AS prefetch_hit,
  CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS irrelevant_locators FROM orders""")
def route_run_scores(spark, sf_dir):
    k = F.col("o_orderkey")
    path = F.when(k % 4 == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).when(k % 4 == 1, F.array(F.lit("a"), F.lit("b"), F.lit("x"))).when(k % 4 == 2, F.array(F.lit("x"), F.lit("b"), F.lit("c"))).otherwise(F.array(F.lit("a")))
    none = F.array().cast("array<long>")
    runs = table(spark, sf_dir, "orders").select(F.concat(F.lit("r"), k).alias("run_id"), F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("expected_path"), path.alias("chosen_path"), (k * 3).alias("expected_row"), F.array(F.when(k % 3 == 0, k * 3).otherwise(k * 3 + 1)).alias("rows_read"), F.when(k % 2 == 0, F.array(F.when(k % 3 == 0, k * 3).otherwise(F.lit(-1).cast("long")))).otherwise(none).alias("predicted"), none.alias("prefetched"))
    return metrics.route_run_scores(runs)


@query("""SELECT printf('f%02d-d%d', f, d) AS scenario_id, CAST(f AS INTEGER) AS fanout, CAST(d AS INTEGER) AS depth, CAST(f * d AS BIGINT) AS n_routes, array_to_string(list_transform(range(1, d + 1), lambda i: (f * 31 + d * 17 + i * 7) % f), '/') AS path FROM (SELECT unnest([4, 8, 12, 16, 24, 32]) AS f), (SELECT unnest([1, 2, 3, 4, 6]) AS d)""")
def benchmark_corpus(spark, sf_dir):
    out = metrics.benchmark_corpus(spark)
    return out.withColumn("path", F.array_join(F.transform("path", lambda x: x.cast("string")), "/"))


# --- health


def _tree(spark, sf_dir) -> DataFrame:
    """Customers as leaves below nations, a nation's table being its region; every 97th has a parent that isn't there, region 4 has no root."""
    nation, customer, region = (table(spark, sf_dir, n) for n in ("nation", "customer", "region"))
    t = lambda c: F.concat(F.lit("t"), c)
    roots = region.where("r_regionkey < 4").select(F.concat(F.lit("r"), "r_regionkey").alias("route_id"), F.lit(None).cast("string").alias("parent_id"), t("r_regionkey").alias("table_id"), F.lit("root").alias("kind"))
    branches = nation.where("n_regionkey < 4").select(F.concat(F.lit("n"), "n_nationkey").alias("route_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), t("n_regionkey").alias("table_id"), F.lit("branch").alias("kind"))
    leaves = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).where("n_regionkey < 4").select(F.concat(F.lit("c"), "c_custkey").alias("route_id"), F.when(F.col("c_custkey") % 97 == 0, "gone").otherwise(F.concat(F.lit("n"), "n_nationkey")).alias("parent_id"), t("n_regionkey").alias("table_id"), F.lit("leaf").alias("kind"))
    return roots.unionByName(branches).unionByName(leaves).withColumn("deleted", F.lit(False))


@query("SELECT 'invalid_route_structure' AS kind, 'c' || c_custkey AS object_id, 'parent' AS detail FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 4 AND c_custkey % 97 = 0 UNION ALL SELECT 'invalid_route_structure', 't4', '0 roots'")
def route_structure(spark, sf_dir):
    tables = table(spark, sf_dir, "region").select(F.concat(F.lit("t"), "r_regionkey").alias("table_id"))
    return health.route_structure(_tree(spark, sf_dir), tables)


@query("SELECT 'c' || c_custkey AS leaf_id, CAST(c_custkey AS BIGINT) AS row_id FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey < 4 AND n_regionkey <> c_custkey % 5")
def foreign_memberships(spark, sf_dir):
    """Rows of a table by customer key, on leaves of a table by region."""
    m = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("leaf_id"), F.col("c_custkey").cast("long").alias("row_id"), F.concat(F.lit("t"), F.col("c_custkey") % 5).alias("table_id"), F.lit(False).alias("deleted"))
    return health.foreign_memberships(m, _tree(spark, sf_dir)).select("leaf_id", "row_id")


@query("SELECT o_orderkey AS row_id FROM orders WHERE o_orderkey % 10 = 3 AND o_orderpriority <> '1-URGENT'")
def unrouted_of_complete(spark, sf_dir):
    """Orders without a leaf, of priorities whose scan is complete."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderpriority").alias("table_id"))
    memberships = rows.where("row_id % 10 <> 3").select("row_id").withColumn("deleted", F.lit(False))
    return health.unrouted_of_complete(rows, memberships, listed(spark, [("1-URGENT",)], "table_id string")).select("row_id")


@query("""WITH i AS (SELECT 'crowded' AS kind, CAST(l_orderkey AS VARCHAR) AS object_id, CAST(count(*) AS VARCHAR) AS detail FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 7), r AS (SELECT * FROM i ORDER BY kind, object_id, detail LIMIT 512)
  SELECT 'attention' AS status, count(*) AS issue_count, sha256(string_agg(kind || chr(1) || object_id || chr(1) || detail, chr(10) ORDER BY kind, object_id, detail)) AS hash FROM r""")
def report_hashes(spark, sf_dir):
    issues = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("object_id")).agg(F.count("*").alias("n")).where("n >= 7").select(F.lit("crowded").alias("kind"), "object_id", F.col("n").cast("string").alias("detail"))
    return health.report_hash(health.issue_report([issues]))


# --- streams


@query("SELECT event_type, count(*) AS n FROM events WHERE event_id < 500 GROUP BY event_type")
def stream_once(spark, sf_dir):
    """Events put into a folder twice come out of the stream once."""
    path, out = new_root(spark, "events"), new_root(spark, "out")
    events = table(spark, sf_dir, "events").where("event_id < 500").select("event_id", "event_type")
    for _ in range(2):
        events.write.mode("append").json(path)
    stream = streaming.once_by_id(spark.readStream.schema(events.schema).json(path), ["event_id"])
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", new_root(spark, "check")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('tail', 7), ('after more', 8), ('postings of the new row', 1)) AS v(test_case, n)")
def commit_tail(spark, sf_dir):
    """The commit log as a stream, resumed from its checkpoint; its batches keep the stored index up."""
    from ..store.postings import Postings

    s = fresh(spark, "INSERT INTO d.t (title) VALUES ('one')", "INSERT INTO d.t (title) VALUES ('two')", "CREATE DATABASE e PURPOSE 'p' SCOPE 's'", "CREATE DATABASE f PURPOSE 'p' SCOPE 's'", "CREATE DATABASE g PURPOSE 'p' SCOPE 's'")
    out, check = new_root(spark, "tail"), new_root(spark, "check")

    def drain() -> int:
        def batch(df, n):
            df.select("commit_sequence").write.mode("append").parquet(out)
            streaming.maintain_postings(spark, s.log.root)(df, n)

        streaming.tail_changes(spark, s.log.root).writeStream.foreachBatch(batch).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out).distinct().count()

    first = drain()
    s.execute("INSERT INTO d.t (title) VALUES ('bandicoot')")
    second = drain()
    return listed(spark, [("tail", first), ("after more", second), ("postings of the new row", Postings(s.log).lookup(["bandicoot"]).count())], "test_case string, n int")


@query("SELECT event_id, event_type AS body FROM events WHERE event_id < 300 UNION ALL SELECT -1, 'conflicts: 1' ")
def ingest_once(spark, sf_dir):
    """Batches that are replayed and one that brings other content for an id that is there."""
    events = table(spark, sf_dir, "events").where("event_id < 300").select("event_id", F.col("event_type").alias("body"))
    target, odd = new_root(spark, "target"), new_root(spark, "odd")
    run = streaming.ingest(spark, target, odd, "event_id", F.sha2("body", 256))
    other = events.where("event_id = 10").withColumn("body", F.lit("other"))
    for k, batch in enumerate((events.where("event_id < 200"), events.where("event_id < 200"), events.where("event_id >= 100").unionByName(other), events.where("event_id >= 100").unionByName(other))):
        run(batch, k)
    n = spark.read.parquet(odd).count()
    return spark.read.parquet(target).select("event_id", "body").unionByName(listed(spark, [(-1, f"conflicts: {n}")], "event_id long, body string"))


@query("SELECT 's' || conv_id AS session_id, CAST(count(*) AS BIGINT) AS sequence, count(*) AS n_events, 'gap refused' AS gap FROM conversations WHERE conv_id < 20 GROUP BY conv_id")
def session_journal(spark, sf_dir):
    """Conversations taken in by two batches, the second with what the first had; a batch with a gap is refused."""
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = table(spark, sf_dir, "conversations").where("conv_id < 20").withColumn("sequence", F.row_number().over(own).cast("long"))
    events = turns.select(F.concat(F.lit("s"), "conv_id").alias("session_id"), "sequence", F.concat("conv_id", F.lit("-"), "sequence").alias("event_id"), F.col("text").alias("body"))
    journal = streaming.Journal(spark, new_root(spark, "journal"))
    journal.take(events.where("sequence <= 2"))
    try:
        journal.take(events.where("sequence > 3"))
        gap = "gap taken"
    except ValueError:
        gap = "gap refused"
    journal.take(events)
    counts = journal.events().groupBy("session_id").agg(F.count("*").alias("n_events"))
    return journal.checkpoints().join(counts, "session_id").select("session_id", "sequence", "n_events", F.lit(gap).alias("gap"))


_WINDOWS = """nodes AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, turn, octet_length(encode(coalesce(text, ''))) AS b FROM conversations),
  w(conv_id, i, win, n, b) AS (SELECT conv_id, i, 0, 1, b FROM nodes WHERE i = 0 UNION ALL SELECT x.conv_id, x.i, CASE WHEN w.n >= 3 OR w.b + x.b > 600 THEN w.win + 1 ELSE w.win END, CASE WHEN w.n >= 3 OR w.b + x.b > 600 THEN 1 ELSE w.n + 1 END, CASE WHEN w.n >= 3 OR w.b + x.b > 600 THEN x.b ELSE w.b + x.b END FROM w JOIN nodes x ON x.conv_id = w.conv_id AND x.i = w.i + 1),
  wins AS (SELECT conv_id, win AS "window", min(turn) AS first, max(turn) AS last, count(*) AS n_nodes, CAST(max(w.b) AS BIGINT) AS n_bytes FROM w JOIN nodes USING (conv_id, i) GROUP BY conv_id, win)"""


def _windows(spark, sf_dir) -> DataFrame:
    return health.read_windows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn", "text", 3, 600)


@query(f"""WITH RECURSIVE {_WINDOWS} SELECT conv_id, CAST("window" AS BIGINT) AS "window", first, last, n_nodes, n_bytes FROM wins""")
def read_windows(spark, sf_dir):
    return _windows(spark, sf_dir)


@query(f"""WITH RECURSIVE {_WINDOWS} SELECT conv_id, count(*) AS n_windows, count(*) FILTER ("window" = 0 OR conv_id % 2 = 0) AS n_read, CAST(sum(n_nodes) AS BIGINT) AS n_nodes, CAST(coalesce(sum(n_nodes) FILTER ("window" = 0 OR conv_id % 2 = 0), 0) AS BIGINT) AS n_nodes_read, count(*) = count(*) FILTER ("window" = 0 OR conv_id % 2 = 0) AS complete FROM wins GROUP BY conv_id""")
def read_coverage(spark, sf_dir):
    """Windows acknowledged: the first of each conversation, all of every second one; acknowledgements of other bounds don't count."""
    windows = _windows(spark, sf_dir)
    done = windows.where("window = 0 or conv_id % 2 = 0").select("conv_id", "window", "first", "last")
    odd = windows.select("conv_id", "window", "first", (F.col("last") + 1).alias("last"))
    return streaming.coverage(windows, done.unionByName(odd).unionByName(done), "conv_id")


@query(f"""WITH RECURSIVE {_WINDOWS} SELECT conv_id, CAST("window" AS BIGINT) AS "window" FROM wins WHERE NOT ("window" = 0 OR conv_id % 2 = 0)""")
def unread_windows(spark, sf_dir):
    windows = _windows(spark, sf_dir)
    return streaming.unread_windows(windows, windows.where("window = 0 or conv_id % 2 = 0"), "conv_id").select("conv_id", "window")
