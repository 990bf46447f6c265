"""Retrieval metrics, capability reports, trace rollups and release gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import wilson


def retrieval_scores(queries: DataFrame, qrels: DataFrame, results: DataFrame, k: int) -> DataFrame:
    """Per run and query: recall at k, hit at k and reciprocal rank over the whole list. Queries without a completed
    result score 0. queries: query_id, group; qrels: query_id, document_id, relevance; results: run_id, query_id, status, candidates."""
    positive = qrels.where("relevance > 0").select("query_id", "document_id").distinct()
    wanted = positive.groupBy("query_id").agg(F.count("*").alias("n_positive"))
    listed = results.where("status = 'completed'").select("run_id", "query_id", F.posexplode("candidates").alias("pos", "document_id"))
    found = listed.join(positive, ["query_id", "document_id"]).groupBy("run_id", "query_id").agg(F.count_if(F.col("pos") < k).alias("n_hit"), F.min("pos").alias("first"))
    # every run answers every query: results name runs and queries, the suite completes each run
    every = results.select("run_id").distinct().join(queries.select("query_id", "group"), F.lit(True))
    out = every.join(wanted, "query_id", "left").join(found, ["run_id", "query_id"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select("run_id", "query_id", "group", F.coalesce(n_hit / F.col("n_positive"), F.lit(0.0)).alias("recall"), F.when(n_hit > 0, 1.0).otherwise(0.0).alias("hit"), F.coalesce(1 / (F.col("first") + 1), F.lit(0.0)).alias("reciprocal_rank"))


def macro_means(scores: DataFrame) -> DataFrame:
    """Means over all queries of a run and over each group; group is null in the overall row."""
    return scores.groupingSets([["run_id"], ["run_id", "group"]], "run_id", "group").agg(F.count("*").alias("n_queries"), F.avg("recall").alias("recall"), F.avg("hit").alias("hit_rate"), F.avg("reciprocal_rank").alias("mrr"))


def cost_reduction(base: Column, current: Column) -> Column:
    """(base - current) / base; null where base is 0."""
    return (base - current) / F.nullif(base, F.lit(0))


def capability_report(runs: DataFrame, arm: str, slices: list[str], success: Column, cost: Column, latency: str) -> DataFrame:
    """For each arm over all runs and over each slice: counts, Wilson interval, cost, nearest-rank percentiles."""
    sets = [[arm], *[[arm, s] for s in slices]]
    runs = runs.withColumn("__ok", success).withColumn("__cost", cost)
    out = runs.groupingSets(sets, arm, *slices).agg(
        F.count("*").alias("n_runs"), F.count_if("__ok").alias("n_success"), F.sum("__cost").alias("cost"), F.max(latency).alias("max_latency"),
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {latency})").alias("p50"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {latency})").alias("p95"),
    )
    low, high = wilson(F.col("n_success"), F.col("n_runs"))
    return out.withColumn("low", low).withColumn("high", high)


def deltas_to_baseline(report: DataFrame, arm: str, baseline: str, slices: list[str], measure: str) -> DataFrame:
    """Signed difference of a measure to the baseline arm of the same slice."""
    base = report.where(F.col(arm) == baseline).select(F.col(measure).alias("__base"), *[F.col(s).alias(f"__{s}") for s in slices])
    condition = F.lit(True)
    for s in slices:
        condition &= F.col(s).eqNullSafe(F.col(f"__{s}"))
    joined = report.join(base, condition, "left")
    return joined.select(*report.columns, (F.col(measure) - F.col("__base")).alias("delta"))


def deduplicated_events(events: DataFrame, key: list[str], content: Column) -> tuple[DataFrame, DataFrame]:
    """One event of each key, and the keys whose events differ (which a caller must refuse)."""
    seen = events.withColumn("__hash", content)
    conflicts = seen.groupBy(*key).agg(F.count_distinct("__hash").alias("n_contents")).where("n_contents > 1")
    return seen.dropDuplicates(key).drop("__hash"), conflicts


def trace_rollup(events: DataFrame, keys: list[str], status: str, measure: Column) -> DataFrame:
    """Counts, sums and a map of status counts for each key."""
    by = events.groupBy(*keys, status).agg(F.count("*").alias("n"), F.sum(measure).alias("m"))
    return by.groupBy(*keys).agg(F.sum("n").alias("n_events"), F.sum("m").alias("total"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(status), F.col("n"))))).alias("by_status"))


def release_gate(arms: DataFrame, partition: list[str], score: str, tie: list, least: float, most_delta: float) -> DataFrame:
    """Arms with delta to the best of their group, whether they pass, and the one chosen."""
    group = Window.partitionBy(*partition)
    out = arms.withColumn("delta", F.max(score).over(group) - F.col(score))
    out = out.withColumn("passes", (F.col(score) >= least) & (F.col("delta") <= most_delta))
    order = F.row_number().over(group.orderBy(F.desc("passes"), F.desc(score), *tie))
    return out.withColumn("chosen", F.col("passes") & (order == 1))


def answer_evaluation(answers: DataFrame, keys: list[str], status: str, latency: str, metrics: list[str]) -> DataFrame:
    """Counts by status, nearest-rank percentiles of latency and means of metrics for each key."""
    return answers.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(F.col(status) == "completed").alias("n_completed"), F.count_if(F.col(status) == "failed").alias("n_failed"),
        F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {latency})").alias("p50"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {latency})").alias("p95"),
        *[F.avg(m).alias(m) for m in metrics],
    )


def evidence_gate(samples: DataFrame, baseline: str, candidate: str, baseline_ms: str, candidate_ms: str, least_gain: int, most_ms: float) -> DataFrame:
    """One row: correct answers of both sides, gain in basis points (whole numbers), mean latency change and the decision."""
    n = F.count("*")
    out = samples.agg(n.alias("n"), F.count_if(baseline).alias("n_baseline"), F.count_if(candidate).alias("n_candidate"), F.avg(F.col(candidate_ms) - F.col(baseline_ms)).alias("latency_change"))
    gain = F.when(F.col("n") > 0, F.call_function("div", (F.col("n_candidate") - F.col("n_baseline")) * 10_000, F.col("n")))
    return out.withColumn("gain", gain).withColumn("decision", F.when(F.col("n") == 0, "no_evidence").when(F.col("gain") < least_gain, "keep").when(F.col("latency_change") > most_ms, "too_slow").otherwise("adopt"))


def route_benchmark(runs: DataFrame, keys: list[str], levels: str, correct: str, exact: str, found: str) -> DataFrame:
    """Ratios of levels whose first choice was right, of exact paths and of rows found."""
    ratio = lambda a, b: a / F.nullif(b, F.lit(0))
    return runs.groupBy(*keys).agg(F.count("*").alias("n_runs"), ratio(F.sum(correct), F.sum(levels)).alias("level_top1"), ratio(F.count_if(exact), F.count("*")).alias("exact_path"), ratio(F.count_if(found), F.count("*")).alias("row_found"))


# Statuses of a run, measures that are summed, and the order in which arms are tried.
STATUSES = ("completed", "failed", "cancelled", "budget_exhausted")
SUMS = ("levels_expected", "level_top1_correct", "fallback_calls", "model_calls", "tool_calls", "input_tokens", "output_tokens", "mispredict_tokens", "context_characters", "irrelevant_locators", "unauthorized_locators", "wrong_fact_reads", "permission_denials", "truncations")
FLAGS = ("exact_path_success", "rowid_success", "predictor_eligible", "predictor_hit", "prefetch_eligible", "prefetch_hit")
LATENCIES = ("query_embedding_ms", "cpu_scan_ms", "statement_ms", "model_ms", "end_to_end_ms")
PEAKS = ("generation_bytes", "rebuild_ms", "peak_memory_bytes")
ARMS = ("hybrid_prefetch", "hybrid", "vector", "lexical")
SAFETY = ("unauthorized_locators", "wrong_fact_reads", "permission_denials", "truncations")


def run_failed() -> Column:
    """A run that didn't end well, missed its path or row, or broke a rule."""
    unsafe = F.lit(False)
    for c in SAFETY:
        unsafe |= F.col(c) > 0
    return (F.col("status") != "completed") | ~F.col("exact_path_success") | ~F.col("rowid_success") | unsafe


def bucket_summary(runs: DataFrame, keys: list[str], prices: DataFrame | None = None) -> DataFrame:
    """All measures of a capability report for each key. `prices` (provider, model, input and output micro-dollars for a million tokens, few rows)
    gives costs where every run of a bucket has a price."""
    percentile = lambda q, c: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {c})").alias(f"{c}_p{round(q * 100)}")
    if prices is not None:
        priced = F.broadcast(prices.limit(1000).withColumnsRenamed({"input_micros": "__in", "output_micros": "__out"}))
        runs = runs.join(priced, ["provider", "model"], "left")
        million = F.lit(1_000_000)
        cost = [F.call_function("div", F.col(t) * F.col(r), million) for t, r in (("input_tokens", "__in"), ("output_tokens", "__out"))]
    else:
        cost = [F.lit(None).cast("long")] * 2
    out = runs.groupBy(*keys).agg(
        F.count("*").alias("runs"), *[F.count_if(F.col("status") == x).alias(x) for x in STATUSES], *[F.sum(c).cast("long").alias(c) for c in SUMS], *[F.count_if(F.col(c)).alias(c) for c in FLAGS],
        F.count_if(run_failed()).alias("failure_cells"), *[F.max(c).alias(c) for c in PEAKS], *[percentile(q, c) for c in LATENCIES for q in (0.5, 0.95)],
        F.when(F.count(cost[0]) == F.count("*"), F.sum(cost[0])).alias("input_micros"), F.when(F.count(cost[1]) == F.count("*"), F.sum(cost[1])).alias("output_micros"),
    )
    ratio = lambda a, b: (F.col(a) / F.nullif(F.col(b), F.lit(0)))
    out = out.withColumns({"level_top1": ratio("level_top1_correct", "levels_expected"), "exact_path": ratio("exact_path_success", "runs"), "row_found": ratio("rowid_success", "runs"), "predictor": ratio("predictor_hit", "predictor_eligible"), "prefetch": ratio("prefetch_hit", "prefetch_eligible")})
    low, high = wilson(F.col("rowid_success"), F.col("runs"))
    return out.withColumns({"row_found_low": low, "row_found_high": high, "total_micros": F.col("input_micros") + F.col("output_micros")})


def default_arm(runs: DataFrame, baseline: str = "router", arms: tuple[str, ...] = ARMS, least_saving: float = 0.05) -> DataFrame:
    """For each arm in the order of preference: whether it can replace the baseline, what speaks against it, and whether it is the one chosen (the
    first eligible one). A cell is a scenario with a host's model; arms are compared cell by cell with the baseline."""
    spark = runs.sparkSession
    cell = ["scenario_id", "host_model"]
    base = runs.where(F.col("arm") == baseline).select(*cell, F.col("rowid_success").alias("base_found"))
    offered = spark.createDataFrame([(a, k) for k, a in enumerate(arms)], "arm string, place int")
    tried = runs.where(F.col("arm").isin(*arms)).select("arm", *cell, "rowid_success", "status", *SAFETY)
    want = F.broadcast(offered).join(base, F.lit(True), "left")  # a few arms beside the baseline's cells
    both = want.join(tried.withColumn("there", F.lit(True)), ["arm", *cell], "left")
    unsafe = F.lit(False)
    for c in SAFETY:
        unsafe |= F.col(c) > 0
    cells = both.groupBy("arm", "place").agg(
        F.count_if(F.col("scenario_id").isNotNull() & F.col("there").isNull()).alias("missing"), F.count_if(F.col("there") & F.col("base_found") & ~F.col("rowid_success")).alias("lost"),
        F.count_if(F.col("there") & (F.col("status") != "completed")).alias("unfinished"), F.count_if(F.col("there") & unsafe).alias("unsafe"), F.count("scenario_id").alias("n_base"),
    )
    totals = runs.groupBy("arm").agg(F.count("*").alias("n"), F.count_if("exact_path_success").alias("exact"), F.sum("model_calls").alias("calls"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY end_to_end_ms)").alias("p95"))
    of_base = totals.where(F.col("arm") == baseline).select(F.col("exact").alias("b_exact"), F.col("calls").alias("b_calls"), F.col("p95").alias("b_p95"))
    joined = cells.join(totals, "arm", "left").join(F.broadcast(of_base), F.lit(True), "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    saved = (F.col("b_calls") - n("calls")) / F.nullif(F.col("b_calls"), F.lit(0))
    reasons = {
        "end_to_end_p95_regression": n("p95") > n("b_p95"), "exact_path_regression": n("exact") < n("b_exact"), "incomplete_cells": F.col("unfinished") > 0, "incomplete_matrix": (F.col("missing") > 0) | (n("n") != F.col("n_base")),
        "matched_rowid_regression": F.col("lost") > 0, "model_call_savings_below_5_percent": F.coalesce(saved < least_saving, F.lit(True)), "safety_failure": F.col("unsafe") > 0,
    }
    listed = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in reasons.items()]))
    out = joined.select("arm", "place", listed.alias("reasons")).withColumn("eligible", F.size("reasons") == 0)
    first = out.where("eligible").agg(F.min("place").alias("first"))
    return out.join(F.broadcast(first), F.lit(True), "left").select("arm", "place", "eligible", "reasons", F.coalesce(F.col("place") == F.col("first"), F.lit(False)).alias("chosen"))


def trace_levels(events: DataFrame, session: str, turn: str, counted: list[str], measure: Column) -> DataFrame:
    """Events of each session (turn is null) and of each of its turns: numbers, sums, and a map of counts for each of the `counted` columns.
    A sum beyond 64 bits is an error."""
    sets = [[session], [session, turn]]
    events = events.withColumn("__m", measure)
    out = events.groupingSets(sets, session, turn).agg(F.count("*").alias("n_events"), F.sum("__m").alias("total"), F.grouping(turn).alias("level"))
    for c in counted:
        by = events.where(F.col(c).isNotNull()).groupingSets([[session, c], [session, turn, c]], session, turn, c).agg(F.count("*").alias("n"), F.grouping(turn).alias("level"))
        maps = by.groupBy(session, turn, "level").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(c), F.col("n"))))).alias(f"by_{c}"))
        same = F.col(f"l.{session}").eqNullSafe(F.col(f"r.{session}")) & F.col(f"l.{turn}").eqNullSafe(F.col(f"r.{turn}")) & (F.col("l.level") == F.col("r.level"))
        out = out.alias("l").join(maps.alias("r"), same, "left").select("l.*", f"r.by_{c}")
    return out.where((F.col("level") == 1) | F.col(turn).isNotNull()).drop("level")


def release_decision(answers: DataFrame, minimums: dict[str, float], least_completed: float, most_delta: float, metric: str) -> DataFrame:
    """Arms of an answer evaluation: share completed, mean of the metric over completed cases, cases below their minimum, difference to the best arm,
    whether the arm passes, and the one chosen (of those that pass the best metric, then fewest tokens, calls, the lowest p95, the name)."""
    done = F.col("status") == "completed"
    least = F.coalesce(*[F.when(F.col("category") == k, F.lit(v)) for k, v in minimums.items()], F.lit(0.0))
    out = answers.groupBy("arm").agg(
        F.count("*").alias("n_cases"), F.avg(F.when(done, 1.0).otherwise(0.0)).alias("completed"), F.avg(F.when(done, F.col(metric))).alias("score"), F.count_if(~done | (F.col(metric) < least)).alias("below_minimum"),
        F.sum("tokens").alias("tokens"), F.sum("calls").alias("calls"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY latency)").alias("p95"),
    )
    best = out.agg(F.max("score").alias("best"))
    out = out.join(F.broadcast(best), F.lit(True)).withColumn("delta", F.col("best") - F.col("score")).drop("best")
    out = out.withColumn("passes", F.coalesce((F.col("completed") >= least_completed) & (F.col("below_minimum") == 0) & (F.col("delta") <= most_delta), F.lit(False)))
    order = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("passes"), F.desc_nulls_last("score"), "tokens", "calls", "p95", "arm"))  # one row an arm
    return out.withColumn("chosen", F.col("passes") & (order == 1))


def route_run_scores(runs: DataFrame) -> DataFrame:
    """Scores of single runs: expected and chosen path of route ids, expected row and rows read. A level counts if its first choice is the expected route and all
    before were; the path is exact if all levels count and no more were taken. Predicted and prefetched rows count where there were any."""
    levels = F.size("expected_path")
    hits = F.transform(F.arrays_zip("expected_path", "chosen_path"), lambda p: F.coalesce(p["expected_path"] == p["chosen_path"], F.lit(False)))
    led = F.aggregate(hits, F.struct(F.lit(0).alias("n"), F.lit(True).alias("ok")), lambda a, h: F.struct((a["n"] + F.when(a["ok"] & h, 1).otherwise(0)).alias("n"), (a["ok"] & h).alias("ok")), lambda a: a["n"])
    found = lambda c: F.array_contains(c, F.col("expected_row"))
    return runs.select(
        "run_id", levels.cast("long").alias("levels_expected"), led.cast("long").alias("level_top1_correct"), F.col("chosen_path").eqNullSafe(F.col("expected_path")).alias("exact_path_success"), F.coalesce(found("rows_read"), F.lit(False)).alias("rowid_success"),
        (F.size("predicted") > 0).alias("predictor_eligible"), F.coalesce(found("predicted"), F.lit(False)).alias("predictor_hit"), (F.size("prefetched") > 0).alias("prefetch_eligible"), F.coalesce(found("prefetched"), F.lit(False)).alias("prefetch_hit"),
        F.size(F.filter("rows_read", lambda r: r != F.col("expected_row"))).cast("long").alias("irrelevant_locators"),
    )


# Shapes of generated route trees.
FANOUTS, DEPTHS = (4, 8, 12, 16, 24, 32), (1, 2, 3, 4, 6)


def benchmark_corpus(spark, fanouts: tuple[int, ...] = FANOUTS, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """One scenario for each shape: the path that leads to its row (one route a level, the rest of a level's children are distractors), written as
    numbers of children by a rule, so that corpora of any size come out alike."""
    shapes = spark.createDataFrame([(f, d) for f in fanouts for d in depths], "fanout int, depth int")
    place = lambda i: F.pmod(F.col("fanout") * 31 + F.col("depth") * 17 + i * 7, F.col("fanout")).cast("int")
    path = F.transform(F.sequence(F.lit(1), F.col("depth")), place)
    return shapes.select(F.format_string("f%02d-d%d", "fanout", "depth").alias("scenario_id"), "fanout", "depth", path.alias("path"), (F.col("fanout") * F.col("depth")).cast("long").alias("n_routes"))
