"""Ledger, latency, health and export queries over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import analytics as A
from .joins import NOW_SQL, now_of
from .registry import query, table

EV = f"ev AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS secs, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k, {NOW_SQL} AS now FROM events)"


def events(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.unix_timestamp("ts").alias("at"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("k"))


def _ops(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("event_type").alias("op_name"), F.col("at").alias("started_at"), F.round(F.col("value") * 10).cast("long").alias("duration_ms"), F.when(F.col("user_id") % 10 == 0, "failed").alias("error"))


OPS = f"{EV}, ops AS (SELECT event_id AS id, event_type AS op_name, secs AS started_at, CAST(round(value * 10) AS BIGINT) AS duration_ms, CASE WHEN user_id % 10 = 0 THEN 'failed' END AS error, now FROM ev)"


@query(
    f"WITH {OPS}, r AS (SELECT op_name, list_sort(list(duration_ms)) AS v FROM ops WHERE started_at >= now - 86400 * 3 AND error IS NULL GROUP BY 1)"
    " SELECT op_name, CAST(len(v) AS BIGINT) AS n, v[CAST(floor((len(v) - 1) * 0.5 + 0.5) AS BIGINT) + 1] AS p50, v[CAST(floor((len(v) - 1) * 0.95 + 0.5) AS BIGINT) + 1] AS p95 FROM r"
)
def op_percentiles_p50_p95(spark, sf_dir):
    return A.latencies(_ops(spark, sf_dir), now_of(spark, sf_dir), 86400 * 3)


@query(f"WITH {OPS} SELECT op_name, arg_max(started_at, id) AS started_at, arg_max(duration_ms, id) AS duration_ms FROM ops GROUP BY 1")
def latest_op(spark, sf_dir):
    return A.latest(_ops(spark, sf_dir), "op_name", "id", "started_at", "duration_ms")


@query(f"WITH {OPS} SELECT op_name, CAST(count(*) AS BIGINT) AS n, list_sort(list(duration_ms))[count(*) // 2 + 1] AS median FROM ops WHERE duration_ms IS NOT NULL GROUP BY 1")
def upper_median(spark, sf_dir):
    return A.medians(_ops(spark, sf_dir), "op_name", "duration_ms")


@query(
    f"WITH {OPS}, p AS (SELECT *, last_value(CASE WHEN error IS NULL THEN duration_ms END IGNORE NULLS) OVER (PARTITION BY op_name ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_ms FROM ops)"
    " SELECT id, duration_ms, prior_ms, duration_ms - prior_ms AS delta_ms, round(CASE WHEN prior_ms = 0 THEN 0 ELSE (duration_ms - prior_ms) * 100.0 / prior_ms END, 6) AS delta_percent FROM p"
)
def run_over_run_delta(spark, sf_dir):
    rows = A.run_deltas(_ops(spark, sf_dir))
    return rows.select("id", "duration_ms", "prior_ms", "delta_ms", F.round("delta_percent", 6).alias("delta_percent"))


@query(
    f"WITH {EV}, w AS (SELECT unnest([1, 7, 30]) AS window_days), j AS (SELECT window_days, event_type, k, value FROM ev JOIN w ON secs >= now - window_days * 86400)"
    " SELECT CAST(window_days AS BIGINT) AS window_days, CAST(NULL AS VARCHAR) AS tool, count(*) AS n_events, CAST(coalesce(sum(k), 0) AS BIGINT) AS tokens, round(coalesce(sum(value), 0), 4) AS amount FROM j GROUP BY 1"
    " UNION ALL SELECT CAST(window_days AS BIGINT), event_type, count(*), CAST(coalesce(sum(k), 0) AS BIGINT), round(coalesce(sum(value), 0), 4) FROM j GROUP BY 1, 2"
)
def ledger_windows(spark, sf_dir):
    rows = A.ledger_windows(events(spark, sf_dir), "at", "event_type", {"tokens": F.col("k"), "amount": F.col("value")}, now_of(spark, sf_dir))
    return rows.select(F.col("window_days").cast("long").alias("window_days"), "tool", "n_events", "tokens", F.round("amount", 4).alias("amount"))


@query(f"WITH {EV} SELECT event_type AS tool, count(*) AS n_events, CAST(sum(k) AS BIGINT) AS tokens, min(secs) AS first_at, max(secs) AS last_at FROM ev WHERE secs >= now - 7 * 86400 GROUP BY 1")
def ledger_rollup_per_tool(spark, sf_dir):
    recent = events(spark, sf_dir).filter(F.col("at") >= now_of(spark, sf_dir) - 7 * 86400)
    return recent.groupBy(F.col("event_type").alias("tool")).agg(F.count(F.lit(1)).alias("n_events"), F.sum("k").alias("tokens"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


MODEL = "(VALUES ('view', 4000, 9000), ('click', 900, 2500), ('purchase', 0, 0), ('signup', 120, 300)) AS m(tool, p50, p95)"
MODEL_ROWS = [("view", 4000, 9000), ("click", 900, 2500), ("purchase", 0, 0), ("signup", 120, 300)]
FACTOR, OVERHEAD, EMPTY, RATE = 1.4, 250, 15, 3.0
_FLOOR = "greatest(p50, CAST(floor(result_tokens * 1.4 + 0.5) AS BIGINT) + 250)"
SAVED = f"CASE WHEN p50 = 0 THEN 0 WHEN returned = 0 THEN 15 ELSE {_FLOOR} - result_tokens END"
COST = f"CASE WHEN p50 = 0 THEN 0 WHEN returned = 0 THEN greatest(result_tokens + 15, 0) ELSE {_FLOOR} END"
CALLS = f"{EV}, calls AS (SELECT event_id AS id, event_type AS tool, k * 40 AS result_tokens, k % 5 AS returned, CAST(round(value) AS BIGINT) AS tokens_saved, user_id % 10 = 0 AS is_error FROM ev)"


def _calls(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("event_id").alias("id"), F.col("event_type").alias("tool"), (F.col("k") * 40).alias("result_tokens"), (F.col("k") % 5).alias("returned"), F.round("value").cast("long").alias("tokens_saved"), (F.col("user_id") % 10 == 0).alias("is_error"))


def _model(spark):
    return spark.createDataFrame(MODEL_ROWS, "tool string, p50 long, p95 long")


@query(f"WITH {CALLS} SELECT id, CAST({COST} AS BIGINT) AS p50_tokens, CAST(greatest(p95, {COST}, 0) AS BIGINT) AS p95_tokens, CAST({SAVED} AS BIGINT) AS saved, round(({SAVED}) / 1e6 * 3.0, 6) AS dollars FROM calls JOIN {MODEL} USING (tool)")
def savings_model(spark, sf_dir):
    rows = _calls(spark, sf_dir).join(F.broadcast(_model(spark)), "tool")
    cost, high, saved = N.savings(F.col("result_tokens"), F.col("returned"), F.col("p50"), F.col("p95"), FACTOR, OVERHEAD, EMPTY)
    return rows.select("id", cost.alias("p50_tokens"), high.alias("p95_tokens"), saved.alias("saved"), F.round(N.dollars(saved, F.lit(RATE)), 6).alias("dollars"))


_RESCORED = f"{CALLS}, r AS (SELECT id, c.tool, CASE WHEN is_error THEN 'error' WHEN p50 IS NULL THEN 'not_in_model' ELSE 'scored' END AS status, tokens_saved, {SAVED} AS s FROM calls c LEFT JOIN {MODEL} USING (tool))"


@query(
    f"WITH {_RESCORED} SELECT tool, status, count(*) AS n, CAST(sum(tokens_saved) AS BIGINT) AS old_saved, CAST(sum(CASE WHEN status = 'scored' THEN s END) AS BIGINT) AS new_saved, count(*) FILTER (WHERE status = 'scored' AND s <> tokens_saved) AS changed FROM r GROUP BY 1, 2"
)
def rescore_delta(spark, sf_dir):
    rows = A.rescored(_calls(spark, sf_dir), _model(spark), FACTOR, OVERHEAD, EMPTY, RATE)
    return rows.groupBy("tool", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("old_saved").alias("old_saved"), F.sum("new_saved").alias("new_saved"), F.count_if(F.coalesce(F.col("delta") != 0, F.lit(False))).alias("changed"))


@query(f"WITH {_RESCORED} SELECT id, tool, CAST(s - tokens_saved AS BIGINT) AS delta FROM r WHERE status = 'scored' ORDER BY abs(s - tokens_saved) DESC, id LIMIT 10")
def largest_corrections(spark, sf_dir):
    rows = A.rescored(_calls(spark, sf_dir), _model(spark), FACTOR, OVERHEAD, EMPTY, RATE).filter("status = 'scored'")
    return rows.orderBy(F.desc(F.abs("delta")), "id").limit(10).select("id", "tool", "delta")


@query(
    f"WITH {EV}, s AS (SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS own, count(*) AS calls FROM ev WHERE user_id % 3 = 0 OR event_type <> 'purchase' GROUP BY 1)"
    " SELECT count(*) AS sessions, CAST(sum(CASE WHEN own > 0 THEN 1 ELSE 0 END) AS BIGINT) AS sessions_with_own, CAST(sum(own) AS BIGINT) AS own_calls, CAST(sum(calls) AS BIGINT) AS retrieval_calls, round(sum(CASE WHEN own > 0 THEN 1 ELSE 0 END) * 1000.0 / count(*)) / 10 AS share FROM s"
)
def adoption_share(spark, sf_dir):
    rows = events(spark, sf_dir).filter((F.col("user_id") % 3 == 0) | (F.col("event_type") != "purchase"))
    return A.adoption(rows.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("own_calls"), F.count(F.lit(1)).alias("retrieval_calls")))


_BUCKET = lambda c: f"CASE WHEN {c} >= 65536 THEN '65536+' WHEN {c} >= 16384 THEN '16384-65535' WHEN {c} >= 4096 THEN '4096-16383' WHEN {c} >= 1024 THEN '1024-4095' WHEN {c} >= 512 THEN '512-1023' WHEN {c} >= 256 THEN '256-511' WHEN {c} >= 128 THEN '128-255' WHEN {c} >= 64 THEN '64-127' WHEN {c} >= 32 THEN '32-63' WHEN {c} >= 16 THEN '16-31' WHEN {c} >= 8 THEN '8-15' WHEN {c} >= 4 THEN '4-7' WHEN {c} >= 2 THEN '2-3' WHEN {c} >= 1 THEN '1' ELSE '0' END"


@query(
    f"WITH {EV} SELECT strftime(to_timestamp(secs) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, event_type IN ('view', 'click') AS known, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END AS tool, {_BUCKET('k')} AS query_len, {_BUCKET('CAST(floor(value * 100) AS BIGINT)')} AS wall_ms, count(*) AS n FROM ev WHERE secs >= now - 7 * 86400 GROUP BY ALL"
)
def scrub_bucket_export(spark, sf_dir):
    calls = events(spark, sf_dir).select(F.col("at").alias("ts"), F.col("event_type").alias("tool"), F.col("k").alias("query_len"), F.floor(F.col("value") * 100).cast("long").alias("wall_ms"), F.col("k").alias("returned"), F.lit("ok").alias("outcome"))
    rows = A.scrubbed(calls, ("view", "click"), ("ok", "error"), now_of(spark, sf_dir), 7)
    return rows.groupBy(F.col("day").cast("string").alias("day"), (F.col("tool") != "other").alias("known"), "tool", "query_len", "wall_ms").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT kind, count(*) AS n FROM (SELECT 'documents' AS kind FROM documents UNION ALL SELECT 'conversations' FROM conversations UNION ALL SELECT 'pages' FROM pages UNION ALL SELECT 'benchmark' FROM benchmark UNION ALL SELECT 'labels' FROM labels) GROUP BY 1")
def corpus_counts(spark, sf_dir):
    names = ("documents", "conversations", "pages", "benchmark", "labels")
    return A.corpus_probe({n: (table(spark, sf_dir, n), None) for n in names}).select(F.col("corpus").alias("kind"), F.col("n_rows").alias("n"))


@query("SELECT 'events' AS corpus, count(*) AS n_rows, CAST(floor(epoch(max(ts))) AS BIGINT) AS newest FROM events UNION ALL SELECT 'orders', count(*), CAST(epoch(max(o_orderdate)) AS BIGINT) FROM orders")
def corpus_probe(spark, sf_dir):
    return A.corpus_probe({"events": (events(spark, sf_dir), "at"), "orders": (table(spark, sf_dir, "orders").select(F.unix_timestamp("o_orderdate").alias("at")), "at")})


@query("SELECT 'labels' AS child, count(*) AS n_orphans FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) UNION ALL SELECT 'documents', count(*) FROM documents WHERE doc_id % 3 = 0")
def orphans_anti(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return A.orphans({"labels": table(spark, sf_dir, "labels").select("doc_id"), "documents": docs}, docs.filter(F.col("doc_id") % 3 != 0), "doc_id")


@query("SELECT folder, count(*) AS n_hits FROM (SELECT regexp_extract(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', ''), '^(.*)/[^/]*$', 1) AS folder FROM pages) GROUP BY 1 ORDER BY n_hits DESC, folder LIMIT 5")
def group_hits_by_location(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "^[a-z]+://", "")
    return A.locations(table(spark, sf_dir, "pages").select(path.alias("path")))


@query(f"WITH {EV} SELECT CASE WHEN event_type IN ('view', 'error') THEN event_type ELSE 'other' END AS outcome, count(*) AS n, count(*) FILTER (WHERE user_id % 2 = 0) AS n_scoped, CAST(sum(k) AS BIGINT) AS total_hits, min(secs) AS first_ts, max(secs) AS last_ts FROM ev GROUP BY 1")
def hook_outcome_stats(spark, sf_dir):
    log = events(spark, sf_dir).select(F.col("at").alias("ts"), F.col("event_type").alias("outcome"), (F.col("user_id") % 2 == 0).alias("scoped"), F.col("k").alias("hits"))
    return A.outcome_stats(log, ("view", "error"))


@query(
    f"WITH {EV}, l AS (SELECT event_id, now - secs AS s FROM ev) SELECT event_id, CASE WHEN s < 300 THEN 'index current' WHEN s < 86400 THEN 'index ' || (s // 3600) || 'h old' ELSE '⚠ index ' || (s // 86400) || ' days old — may predate recent work' END AS age,"
    " CASE WHEN s >= 86400 THEN (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h' WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' ELSE (s // 60) || 'm' END AS lasted FROM l"
)
def age_labels(spark, sf_dir):
    s = F.lit(now_of(spark, sf_dir)) - F.col("at")
    return events(spark, sf_dir).select("event_id", N.age_label(s).alias("age"), N.duration_label(s).alias("lasted"))


@query("SELECT doc_id, length(text) // 4 AS tokens, strftime(to_timestamp(doc_id * 86400 + 3661) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS stamp FROM documents")
def token_and_time_formats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", N.token_estimate(F.length("text")).alias("tokens"), N.iso_time(F.col("doc_id") * 86400 + 3661).alias("stamp"))


@query(
    "SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE (CASE WHEN regexp_matches(text[1:200], '\\s') AND strlen(regexp_extract(text[1:200], '(?s)^(.*)\\s', 1)) > 100 THEN regexp_extract(text[1:200], '(?s)^(.*)\\s', 1) ELSE text[1:200] END) || '…' END AS summary FROM documents"
)
def summaries(spark, sf_dir):
    from ..functions.text import summarize

    return table(spark, sf_dir, "documents").select("doc_id", summarize(F.col("text"), 200).alias("summary"))
