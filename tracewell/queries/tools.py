"""The tool surface, hook search, workspace and health operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..operators import analytics as A
from ..operators import etl, health, hooks, joins, merge, search, tools, workspace
from ..sources import sinks
from ..streaming import ingest
from .analytics import EV, events
from .joins import NOW_SQL, now_of
from .registry import query, table
from .search import CHUNKS, SNIPPETS, TOKENS_OF, chunk_frame, ranking_sql, stored

# Documents stand for commits, conversations for edits of sessions, benchmark items for notes.
_COMMITS = "commits AS (SELECT doc_id AS ref, doc_id AS commit_id, md5(CAST(doc_id AS VARCHAR)) AS commit_hash, source AS repo_path, (doc_id % 997) * 7200 AS authored_at, lang AS message_summary, text AS message_body FROM documents)"
_REPOS = "repos AS (SELECT DISTINCT source AS repo_path, length(source) = 5 AS is_shallow FROM documents WHERE source <> 'src3')"
_EDGES = "edges AS (SELECT conv_id * 1048576 + turn AS ref, conv_id AS session_id, conv_id % 400 * 3600 + turn AS edited_at, text AS rationale, conv_id * 7 + turn AS commit_id FROM conversations)"
_NOTES = "notes AS (SELECT item_id AS ref, item_id % 5 AS document_id, 'note ' || (item_id % 9) AS name, text AS body FROM benchmark), files AS (SELECT DISTINCT item_id % 5 AS document_id, '/n/' || (item_id % 5) || '.md' AS path FROM benchmark)"
_INDEX = (
    f"idx AS (SELECT 'commit_entries' AS source_table, doc_id AS ref, text AS body, {TOKENS_OF.format('text')} AS t FROM documents"
    f" UNION ALL SELECT 'session_edges', conv_id * 1048576 + turn, text, {TOKENS_OF.format('text')} FROM conversations"
    f" UNION ALL SELECT 'memory_entries', item_id, text, {TOKENS_OF.format('text')} FROM benchmark)"
)


def _ranked(words: list[str], condition: str) -> str:
    return ranking_sql(_INDEX, [f"t[i] = '{w}'" for w in words], condition, "", "source_table, ref, rank")


def _commits(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ref"), F.col("doc_id").alias("commit_id"), F.md5(F.col("doc_id").cast("string").cast("binary")).alias("commit_hash"), F.col("source").alias("repo_path"),
        ((F.col("doc_id") % 997) * 7200).alias("authored_at"), F.col("lang").alias("message_summary"), F.col("text").alias("message_body"),
    )


def _repos(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("repo_path")).distinct().filter("repo_path <> 'src3'").withColumn("is_shallow", F.length("repo_path") == 5)


def _edges(spark, sf_dir):
    at = F.col("conv_id") % 400 * 3600 + F.col("turn")
    return table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1048576 + F.col("turn")).alias("ref"), F.col("conv_id").alias("session_id"), at.alias("edited_at"), F.col("text").alias("rationale"), (F.col("conv_id") * 7 + F.col("turn")).alias("commit_id"))


def _notes(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")
    notes = rows.select(F.col("item_id").alias("ref"), (F.col("item_id") % 5).alias("document_id"), F.concat(F.lit("note "), (F.col("item_id") % 9).cast("string")).alias("name"), F.col("text").alias("body"))
    return notes, notes.select("document_id").distinct().withColumn("path", F.concat(F.lit("/n/"), F.col("document_id").cast("string"), F.lit(".md")))


def _index(spark, sf_dir):
    read = lambda name, ref, body: table(spark, sf_dir, name).select(ref.alias("ref"), F.col(body).alias("body"))
    return stored(spark, "tools", sf_dir, ("documents", "conversations", "benchmark"), lambda: search.index_of({"commit_entries": read("documents", F.col("doc_id"), "text"), "session_edges": read("conversations", F.col("conv_id") * 1048576 + F.col("turn"), "text"), "memory_entries": read("benchmark", F.col("item_id"), "text")}))


_TWO = "f0 > 0 AND f1 > 0 AND source_table = '{}'"
_FIND_COMMIT = f"WITH r AS ({_ranked(['license', 'version'], _TWO.format('commit_entries'))}), {_COMMITS}, {_REPOS}, b AS (SELECT c.*, r.rank, coalesce(p.is_shallow, false) AS shallow FROM r JOIN commits c USING (ref) LEFT JOIN repos p USING (repo_path) ORDER BY r.rank, authored_at DESC, commit_hash LIMIT 10)"


def _find_commit(spark, sf_dir):
    return tools.find_commit(_index(spark, sf_dir), _commits(spark, sf_dir), _repos(spark, sf_dir), "license version")


@query(_FIND_COMMIT + " SELECT commit_hash, shallow, round(rank, 6) AS rank FROM b")
def find_commit(spark, sf_dir):
    return _find_commit(spark, sf_dir).results.select("commit_hash", "shallow", F.round("rank", 6).alias("rank"))


@query(
    _FIND_COMMIT + f", n AS (SELECT count(*) AS total FROM ({_ranked(['license', 'version'], _TWO.format('commit_entries'))}))"
    " SELECT 'find_commit' AS tool, total AS total_matched, count(*) AS returned, false AS query_broadened, CAST(floor(sum(length(message_summary) + coalesce(length(message_body), 0)) / 4) AS BIGINT) AS returned_full_tokens, round(min(rank), 6) AS top_rank, round(max(rank) - min(rank), 6) AS rank_spread FROM b, n GROUP BY total"
)
def find_commit_envelope(spark, sf_dir):
    said = _find_commit(spark, sf_dir).summary.drop("corpus_empty", "corpus_indexed_through")
    return said.withColumn("top_rank", F.round("top_rank", 6)).withColumn("rank_spread", F.round("rank_spread", 6))


@query(f"WITH r AS ({_ranked(['the'], "f0 > 0 AND source_table = 'commit_entries'")}), {_COMMITS} SELECT commit_hash, round(rank, 6) AS rank FROM r JOIN commits USING (ref) WHERE contains(lower(repo_path), 'rc1') ORDER BY r.rank, authored_at DESC, commit_hash LIMIT 10")
def find_commit_in_repo(spark, sf_dir):
    found = tools.find_commit(_index(spark, sf_dir), _commits(spark, sf_dir), _repos(spark, sf_dir), "the", repo="RC1")
    return found.results.select("commit_hash", F.round("rank", 6).alias("rank"))


@query(f"WITH r AS ({_ranked(['the'], "f0 > 0 AND source_table = 'session_edges'")}), {_EDGES}, {_COMMITS} SELECT session_id, edited_at, commit_hash, round(rank, 6) AS rank FROM r JOIN edges e USING (ref) LEFT JOIN commits c ON c.commit_id = e.commit_id ORDER BY r.rank, edited_at DESC, e.ref LIMIT 20")
def find_session(spark, sf_dir):
    commits = _commits(spark, sf_dir).select("commit_id", "commit_hash", "message_summary")
    found = tools.find_session(_index(spark, sf_dir), _edges(spark, sf_dir), commits, "the", 20)
    return found.results.select("session_id", "edited_at", "commit_hash", F.round("rank", 6).alias("rank"))


@query(f"WITH r AS ({_ranked(['the'], "f0 > 0 AND source_table = 'memory_entries'")}), {_NOTES} SELECT name, path, round(rank, 6) AS rank FROM r JOIN notes n USING (ref) JOIN files f ON f.document_id = n.document_id ORDER BY r.rank, name, n.ref LIMIT 10")
def find_memory(spark, sf_dir):
    notes, files = _notes(spark, sf_dir)
    return tools.find_memory(_index(spark, sf_dir), notes, files, "the").results.select("name", "path", F.round("rank", 6).alias("rank"))


_CHUNK_INDEX = CHUNKS + f", idx AS (SELECT 'source_chunks' AS source_table, doc_id * 1048576 + line_start AS ref, chunk AS body, {TOKENS_OF.format('chunk')} AS t FROM chunks WHERE regexp_matches(chunk, '\\S'))"


def _page_sql(index: str, words: list[str], condition: str, path: str, most: int, body: int, budget: int) -> str:
    """SQL of a page of stretches: the best 40 rows with their snippets, the first of them shown within a budget."""
    ranked = ranking_sql(index, [f"t[i] = '{w}'" for w in words], condition, f"ORDER BY ranked.rank, {path}, ref % 1048576, ref LIMIT 40", "ref, body, t, rank").replace("SELECT source_table, ref, body, len(t) AS dl", "SELECT source_table, ref, body, t, len(t) AS dl").replace("SELECT source_table, ref, body, dl, 0", "SELECT source_table, ref, body, t, dl, 0")
    plain = SNIPPETS.replace("WORDS", str(words)).replace("RANKED", ranked)
    return (
        f"WITH {plain.rpartition('SELECT ref,')[0]}, shown_of AS (SELECT ref,{plain.rpartition('SELECT ref,')[2]}),"
        f" placed AS (SELECT r.ref, r.rank, body, snippet, row_number() OVER (ORDER BY r.rank, {path.replace('ref', 'r.ref')}, r.ref % 1048576, r.ref) AS pos FROM r JOIN shown_of USING (ref)),"
        f" budgeted AS (SELECT *, coalesce(sum(length(snippet)) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < {budget} AS shown FROM placed WHERE pos <= {most} AND length(snippet) <= {body}),"
        " cut AS (SELECT *, replace(snippet, '…', '') AS plain FROM budgeted)"
        " SELECT ref, CAST(pos AS INT) AS pos, CAST(length(snippet) AS BIGINT) AS shown_chars, shown, (CASE WHEN shown THEN length(snippet) ELSE 0 END) < length(body) AS body_truncated, md5(CASE WHEN shown THEN snippet ELSE '' END) AS digest,"
        " FIRST + length(body[1 : instr(body, plain) - 1]) - length(replace(body[1 : instr(body, plain) - 1], chr(10), '')) AS match_line FROM cut"
    )


def _shown_page(found) -> DataFrame:
    return found.results.select("ref", "pos", "shown_chars", "shown", "body_truncated", F.md5(F.col("body").cast("binary")).alias("digest"), F.col("match_line").cast("long").alias("match_line"))


@query(_page_sql(_CHUNK_INDEX, ["license"], "f0 > 0", "CAST(ref // 1048576 AS VARCHAR)", 12, 2000, 20000).replace("FIRST", "ref % 1048576"))
def find_code_page(spark, sf_dir):
    chunks = chunk_frame(spark, sf_dir).select((F.col("doc_id") * 1048576 + F.col("line_start")).alias("ref"), F.col("doc_id").cast("string").alias("path"), "line_start", "line_end", F.col("chunk").alias("body"), F.col("source").alias("repo_path"))
    index = stored(spark, "chunks", sf_dir, ("documents",), lambda: search.index_of({"source_chunks": chunks.select("ref", "body")}))
    return _shown_page(tools.find_code(index, chunks, "license", 12))


_SECTIONS = f"idx AS (SELECT 'design_doc_sections' AS source_table, doc_id AS ref, text AS body, {TOKENS_OF.format('text')} AS t FROM documents)"


def _design_doc(spark, sf_dir, words):
    sections = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), F.lit("notes").alias("path"), F.col("lang").alias("heading_path"), F.lit(1).cast("long").alias("line_start"), F.lit(9).cast("long").alias("line_end"), F.col("text").alias("body"))
    index = stored(spark, "sections", sf_dir, ("documents",), lambda: search.index_of({"design_doc_sections": sections.select("ref", "body")}))
    return tools.find_design_doc(index, sections, words, 35)


@query(_page_sql(_SECTIONS, ["license", "version"], "f0 > 0 AND f1 > 0", "CAST(1 AS INTEGER)", 35, 1200, 16000).replace("FIRST", "1").replace("ref % 1048576, ", "").replace("r.ref % 1048576, ", "").replace("r.r.ref", "r.ref"))
def find_design_doc_page(spark, sf_dir):
    return _shown_page(_design_doc(spark, sf_dir, "license version"))


@query(f"WITH {_COMMITS}, {_REPOS} SELECT commit_hash, coalesce(is_shallow, false) AS shallow, authored_at FROM commits LEFT JOIN repos USING (repo_path) WHERE authored_at >= 7000000 - 30 * 86400 ORDER BY authored_at DESC, commit_hash LIMIT 50")
def recent_commits(spark, sf_dir):
    return tools.recent_commits(_commits(spark, sf_dir), _repos(spark, sf_dir), 7_000_000, limit=99).select("commit_hash", "shallow", "authored_at")


@query(f"WITH r AS ({_ranked(['license'], "f0 > 0 AND source_table = 'commit_entries'")}), {_COMMITS} SELECT commit_hash, authored_at, round(rank, 6) AS rank FROM r JOIN commits USING (ref) ORDER BY authored_at DESC, r.rank, commit_hash LIMIT 10")
def recent_commits_filtered(spark, sf_dir):
    found = tools.recent_commits(_commits(spark, sf_dir), _repos(spark, sf_dir), 7_000_000, 9999, index=_index(spark, sf_dir), filter_="license")
    return found.select("commit_hash", "authored_at", F.round("rank", 6).alias("rank"))


@query(f"WITH {_EDGES}, {_COMMITS}, n AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY edited_at DESC, ref DESC) AS k FROM edges WHERE edited_at >= 1440000 - 5 * 86400) SELECT session_id, edited_at, commit_hash FROM n LEFT JOIN commits c ON c.commit_id = n.commit_id WHERE k = 1 ORDER BY edited_at DESC, session_id LIMIT 25")
def recent_sessions(spark, sf_dir):
    return tools.recent_sessions(_edges(spark, sf_dir), _commits(spark, sf_dir).drop("ref"), 1_440_000, 5, 25).select("session_id", "edited_at", "commit_hash")


_HITS = "hits AS (SELECT doc_id AS ref, CASE WHEN doc_id % 3 = 0 THEN 'a/' ELSE '' END || source || '/' || lang || '.md' AS path, text AS body, doc_id % 50 AS rank FROM documents WHERE text IS NOT NULL)"
_SCOPED = "starts_with(path, 'src1') OR contains(path, '/src1') OR starts_with(path, 'x/en') OR contains(path, '/x/en') OR starts_with(path, 'en')"


def _hits(spark, sf_dir):
    path = F.concat(F.when(F.col("doc_id") % 3 == 0, "a/").otherwise(""), F.col("source"), F.lit("/"), F.col("lang"), F.lit(".md"))
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.col("doc_id").alias("ref"), path.alias("path"), F.col("text").alias("body"), (F.col("doc_id") % 50).alias("rank"))


@query(f"WITH {_HITS}, l AS (SELECT *, list_filter(string_split(body, chr(10)), lambda x: contains(lower(x), 'license'))[1] AS line FROM hits WHERE {_SCOPED}) SELECT path, md5(line) AS line, rank FROM l WHERE line IS NOT NULL ORDER BY rank, path, ref LIMIT 25")
def scoped_hook_hits(spark, sf_dir):
    found = spark.range(1).select(hooks.search_of(F.lit("cd x && grep -rne License src1/ ./x/en | head")).alias("s")).select("s.*").first()
    return hooks.hits_in_scope(_hits(spark, sf_dir), found.pattern, found.paths).select("path", F.md5("line").alias("line"), "rank")


#: Commands made of a row's columns, and what each of them searches for.
_COMMANDS = (
    ("'cd ' || source || ' && grep -rne \"' || coalesce(lang, 'x') || ' y\" ./' || source || '/ .'", "coalesce(lang, 'x') || ' y'", "'./' || source"),
    ("'rg -t py --regexp=' || source || ' a' || doc_id || '; ls'", "source", "'a' || doc_id"),
    ("'ls ' || source || ' | grep ' || source", "NULL", "''"),
    ("'sudo /usr/bin/ag -A 3 ' || source || ' b/ c' || doc_id || ' | head'", "source", "'b,c' || doc_id"),
    ("'ack ' || source || ' d -f list'", "source", "''"),
)
_CASE = lambda k: "CASE " + " ".join(f"WHEN doc_id % 5 = {n} THEN {c[k]}" for n, c in enumerate(_COMMANDS)) + " END"


@query(f"SELECT doc_id, {_CASE(1)} AS pattern, {_CASE(2)} AS paths FROM documents")
def searches_of_commands(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_CASE(0)).alias("command"))
    return rows.select("doc_id", hooks.search_of(F.col("command")).alias("s")).select("doc_id", "s.pattern", F.array_join("s.paths", ",").alias("paths"))


_PLACED = f"{_HITS}, placed AS (SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, ref AS pos FROM hits), top AS (SELECT folder, count(*) AS n_hits FROM placed GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)"


@query(f"WITH {_PLACED} SELECT folder, n_hits FROM top")
def hit_locations(spark, sf_dir):
    return hooks.by_location(_hits(spark, sf_dir).select("path", F.lit("").alias("line"), F.col("ref").alias("pos")))[0]


@query(f"WITH {_PLACED} SELECT path, pos FROM (SELECT path, CAST(pos AS VARCHAR) AS pos FROM placed WHERE folder = (SELECT folder FROM top ORDER BY n_hits DESC, folder LIMIT 1) ORDER BY placed.pos LIMIT 6)")
def largest_location_lines(spark, sf_dir):
    hits = _hits(spark, sf_dir).select("path", F.col("ref").cast("string").alias("line"), F.col("ref").alias("pos"))
    return hooks.by_location(hits)[1].select("path", F.col("line").alias("pos"))


def _log(spark, sf_dir):
    return events(spark, sf_dir).select(F.col("event_type").alias("outcome"), (F.col("user_id") % 3 == 0).alias("scoped"), F.col("k").alias("hits"), (F.col("event_id") % 11).alias("term_len"), F.concat(F.lit("db"), (F.col("user_id") % 2).cast("string")).alias("db"))


@query(
    f"WITH {EV}, l AS (SELECT CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END AS outcome, user_id % 3 = 0 AS scoped, k AS hits, event_id % 11 AS term_len FROM ev),"
    " m AS (SELECT outcome, list_sort(list(hits)) AS h, list_sort(list(term_len)) AS t, count(*) AS n, count(*) FILTER (WHERE scoped) AS n_scoped FROM l GROUP BY 1)"
    " SELECT outcome, n, n_scoped, round(n * 1000.0 / sum(n) OVER ()) / 10 AS share, h[n // 2 + 1] AS median_hits, t[n // 2 + 1] AS median_term_len FROM m"
)
def hook_outcome_shares(spark, sf_dir):
    return hooks.outcome_shares(_log(spark, sf_dir), ("view", "click")).select("outcome", "n", "n_scoped", "share", "median_hits", "median_term_len")


@query(f"WITH {EV} SELECT count(*) FILTER (WHERE event_type = 'view' AND user_id % 2 = 1) AS n FROM ev")
def delivered_count(spark, sf_dir):
    return hooks.delivered(_log(spark, sf_dir).withColumn("outcome", F.when(F.col("outcome") == "view", "served").otherwise(F.col("outcome"))), "db1")


@query(f"WITH {EV} SELECT min(secs) AS first_edit, max(secs) AS last_edit, (SELECT count(DISTINCT o_custkey) FROM orders) AS n_authors FROM ev")
def edit_window(spark, sf_dir):
    commits = table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("author_email"))
    return health.edit_window(events(spark, sf_dir).select(F.col("at").alias("edited_at")), commits)


_DELTAS = "d AS (SELECT (o_orderkey % 4001 - 2000) * 400 AS delta FROM orders)"


@query(f"WITH {_DELTAS}, s AS (SELECT abs(delta) AS a FROM d) SELECT count(*) FILTER (WHERE a < 3600) AS under_hour, count(*) FILTER (WHERE a >= 3600 AND a < 86400) AS under_day, count(*) FILTER (WHERE a >= 86400 AND a < 604800) AS under_week, count(*) FILTER (WHERE a >= 604800) AS week_or_more, count(*) AS n, list_sort(list(a))[count(*) // 2 + 1] AS median_delta FROM s")
def delta_summary(spark, sf_dir):
    return health.delta_summary(table(spark, sf_dir, "orders").select(((F.col("o_orderkey") % 4001 - 2000) * 400).alias("delta")), "delta")


@query(
    f"WITH {EV}, {NOW_SQL.replace('(SELECT', 'clock AS (SELECT', 1).replace(' FROM events)', ' AS now_ FROM events)')}, ops AS (SELECT event_id AS id, event_type AS op_name, secs AS started_at, k AS duration_ms, user_id % 10 = 0 AS err FROM ev),"
    " recent AS (SELECT op_name, list_sort(list(duration_ms)) AS l, count(*) AS n FROM ops, clock WHERE started_at >= now_ - 3600 AND NOT err GROUP BY 1),"
    " act AS (SELECT count(*) AS s, count(*) FILTER (WHERE own > 0) AS w FROM (SELECT user_id, count(*) FILTER (WHERE event_type = 'view') AS own FROM ev GROUP BY 1))"
    " SELECT 'indexer' AS section, 'documents.n_rows' AS name, CAST(count(*) AS DOUBLE) AS value FROM documents UNION ALL SELECT 'indexer', 'documents.newest', NULL"
    " UNION ALL SELECT 'indexer', 'events.n_rows', count(*) FROM ev UNION ALL SELECT 'indexer', 'events.newest', max(secs) FROM ev"
    " UNION ALL SELECT 'orphans', 'labels.n_orphans', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)"
    " UNION ALL SELECT 'repos', 'n_shallow', count(DISTINCT source) FROM documents WHERE length(source) = 5 AND source <> 'src3'"
    " UNION ALL SELECT 'perf', op_name || '.p50', l[CAST(floor((n - 1) * 0.5 + 0.5) AS BIGINT) + 1] FROM recent UNION ALL SELECT 'perf', op_name || '.p95', l[CAST(floor((n - 1) * 0.95 + 0.5) AS BIGINT) + 1] FROM recent"
    " UNION ALL SELECT 'last_run', op_name || '.duration_ms', arg_max(duration_ms, id) FROM ops WHERE NOT err GROUP BY op_name UNION ALL SELECT 'watcher', 'live', 1"
    " UNION ALL SELECT 'adoption', 'sessions', s FROM act UNION ALL SELECT 'adoption', 'sessions_with_own', w FROM act UNION ALL SELECT 'adoption', 'share', round(w * 1000.0 / s) / 10 FROM act"
)
def health_check(spark, sf_dir):
    rows, now = events(spark, sf_dir), now_of(spark, sf_dir)
    operations = rows.select(F.col("event_id").alias("id"), F.col("event_type").alias("op_name"), F.col("at").alias("started_at"), F.col("k").alias("duration_ms"), F.when(F.col("user_id") % 10 == 0, "failed").alias("error"))
    activity = rows.groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("own_calls"), F.count_if(F.col("event_type") == "click").alias("retrieval_calls"))
    docs = table(spark, sf_dir, "documents")
    return health.check({"documents": (docs, None), "events": (rows, "at")}, {"labels": table(spark, sf_dir, "labels")}, docs.filter("doc_id % 2 = 0"), "doc_id", _repos(spark, sf_dir), operations, activity, now - 30, now)


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '/known' WHEN doc_id % 3 = 0 THEN NULL ELSE '/r/' || source END AS repo_path FROM documents")
def backfilled_repo_paths(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    own = F.concat("lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md"))
    chunks = docs.select("doc_id", F.col("doc_id").alias("document_id"), F.when(F.col("doc_id") % 3 == 0, "elsewhere.md").otherwise(own).alias("path"), F.when(F.col("doc_id") % 2 == 0, "/known").alias("repo_path"))
    files = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("/r/"), F.col("source"), F.lit("/"), own).alias("path"))
    return merge.backfilled_repos(chunks, files).select("doc_id", "repo_path")


@query(f"WITH {EV}, c AS (SELECT CASE WHEN event_id % 10 <> 0 THEN secs END AS ts, event_type AS outcome, CASE WHEN user_id % 7 = 0 THEN 'x' END AS error, k - 40 AS saved FROM ev), w AS (SELECT *, ts IS NULL OR ts >= (SELECT max(secs) FROM ev) - 86400 AS inside FROM c) SELECT count(*) AS rows_total, count(*) FILTER (WHERE inside) AS rows_in_window, count(*) FILTER (WHERE ts IS NULL) AS rows_unparseable_ts, count(*) FILTER (WHERE inside AND (outcome = 'error' OR error IS NOT NULL)) AS error_rows, count(*) FILTER (WHERE inside AND saved < 0) AS loss_rows FROM w")
def export_counts(spark, sf_dir):
    calls = events(spark, sf_dir).select(F.when(F.col("event_id") % 10 != 0, F.col("at")).alias("ts"), F.col("event_type").alias("outcome"), F.when(F.col("user_id") % 7 == 0, "x").alias("error"), (F.col("k") - 40).alias("tokens_saved"))
    return sinks.export_counts(calls, now_of(spark, sf_dir) - 86400)


_STORED = "stored AS (SELECT doc_id AS path, md5(coalesce(text, '')) AS content_hash, 1 AS mtime, doc_id AS last_commit_id FROM documents), live AS (SELECT doc_id AS path, CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE md5(coalesce(text, '')) END AS content_hash, 2 AS mtime, CASE WHEN doc_id % 5 <> 0 THEN doc_id + 1 END AS last_commit_id FROM documents WHERE doc_id % 3 <> 0)"


@query(f"WITH {_STORED} SELECT s.path, CASE WHEN l.content_hash = s.content_hash THEN l.mtime ELSE s.mtime END AS mtime, CASE WHEN l.content_hash = s.content_hash THEN coalesce(l.last_commit_id, s.last_commit_id) ELSE s.last_commit_id END AS last_commit_id FROM stored s LEFT JOIN live l USING (path)")
def patched_in_place(spark, sf_dir):
    docs, digest = table(spark, sf_dir, "documents"), F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    stored = docs.select(F.col("doc_id").alias("path"), digest.alias("content_hash"), F.lit(1).alias("mtime"), F.col("doc_id").alias("last_commit_id"))
    live = docs.filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("path"), F.when(F.col("doc_id") % 4 == 0, "x").otherwise(digest).alias("content_hash"), F.lit(2).alias("mtime"), F.when(F.col("doc_id") % 5 != 0, F.col("doc_id") + 1).alias("last_commit_id"))
    return merge.patched(stored, live).select("path", "mtime", "last_commit_id")


@query("SELECT source_table, ref, md5(body) AS digest FROM (SELECT 'c' AS source_table, o_orderkey AS ref, CASE WHEN o_orderkey % 3 = 0 THEN 'new ' ELSE 'old ' END || o_orderstatus AS body FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0 UNION ALL SELECT 'd', o_orderkey, 'other' FROM orders WHERE o_orderkey % 5 = 0)")
def upserted_text_index(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("s"))
    old, new = orders.filter("id % 2 = 0").withColumn("s", F.concat(F.lit("old "), "s")), orders.filter("id % 3 = 0").withColumn("s", F.concat(F.lit("new "), "s"))
    index = old.select(F.lit("c").alias("source_table"), F.col("id").alias("ref"), F.col("s").alias("body")).unionByName(orders.filter("id % 5 = 0").select(F.lit("d").alias("source_table"), F.col("id").alias("ref"), F.lit("other").alias("body")))
    return merge.upsert_indexed(old, new, ["id"], index, "c", F.col("s"), "id")[1].select("source_table", "ref", F.md5(F.col("body").cast("binary")).alias("digest"))


@query("SELECT 'lines' AS kind, count(*) AS n FROM lineitem WHERE l_orderkey % 7 <> 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT 'index', count(*) FROM lineitem WHERE l_orderkey % 7 <> 0")
def delete_cascade(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("id"), "left_semi").select(F.col("l_orderkey").alias("document_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    index = lines.select(F.lit("lines").alias("source_table"), F.col("id").alias("ref"))
    left, children, swept = merge.delete_with_children(F.col("id") % 7 == 0, orders, {"lines": lines}, index)
    count = lambda rows, kind: rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(left, "orders").unionByName(count(children["lines"], "lines")).unionByName(count(swept, "index"))


@query("WITH b AS (SELECT conv_id AS session_id, turn, CASE WHEN conv_id % 3 = 0 AND turn < 4 THEN 'first' WHEN conv_id % 5 = 0 AND turn < 2 THEN 'second' END AS batch FROM conversations) SELECT session_id, turn, 'old' AS pass FROM b WHERE session_id % 3 <> 0 AND session_id % 5 <> 0 UNION ALL SELECT conv_id, turn, 'first' FROM conversations WHERE conv_id % 3 = 0 AND turn < 4 UNION ALL SELECT conv_id, turn, 'second' FROM conversations WHERE conv_id % 5 = 0 AND turn < 2")
def rebuilt_sessions(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn")
    told = lambda condition, name: rows.filter(condition).withColumn("pass", F.lit(name))
    return merge.rebuilt(told("true", "old"), [told("session_id % 3 = 0 AND turn < 4", "first"), told("session_id % 5 = 0 AND turn < 2", "second")])


@query(
    "WITH l AS (SELECT n_name AS path, n_nationkey % 5 <> 0 AS exists_, n_nationkey % 7 <> 3 AS is_dir, n_nationkey % 3 <> 0 AS is_repo FROM nation), u AS (SELECT 'f' || n_nationkey AS path FROM nation WHERE n_regionkey < 2), s AS (SELECT 'f' || n_nationkey AS path FROM nation WHERE n_nationkey % 2 = 0),"
    " c AS (SELECT 'c' || s_suppkey AS path, s_nationkey > 10 AS in_domain FROM supplier)"
    " SELECT CASE WHEN exists_ AND is_dir THEN 1 ELSE 0 END AS severity, CASE WHEN NOT exists_ THEN 'label-missing' WHEN NOT is_dir THEN 'label-is-a-file' ELSE 'label-not-a-repo' END AS kind, path FROM l WHERE NOT exists_ OR NOT is_dir OR NOT is_repo"
    " UNION ALL SELECT 2, 'subdir-unassigned', path FROM u WHERE path NOT IN (SELECT path FROM s) UNION ALL SELECT 2, 'subdir-undecided', path FROM s"
    " UNION ALL SELECT CASE WHEN in_domain THEN 1 ELSE 2 END, CASE WHEN in_domain THEN 'file-unindexed' ELSE 'root-file-unindexed' END, path FROM c WHERE path NOT IN (SELECT 'c' || s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)"
)
def audit_findings(spark, sf_dir):
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    key = F.col("n_nationkey")
    name = F.concat(F.lit("f"), key.cast("string"))
    labelled = nation.select(F.col("n_name").alias("path"), (key % 5 != 0).alias("exists"), (key % 7 != 3).alias("is_dir"), (key % 3 != 0).alias("is_repo"))
    file = F.concat(F.lit("c"), F.col("s_suppkey").cast("string"))
    content = supplier.select(file.alias("path"), (F.col("s_nationkey") > 10).alias("in_domain"))
    return workspace.audit(labelled, nation.filter("n_regionkey < 2").select(name.alias("path")), nation.filter(key % 2 == 0).select(name.alias("path")), content, supplier.filter("s_suppkey % 2 = 0").select(file.alias("path")))


_PATH = "regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"
_FOLDERS = f"full_ AS (SELECT DISTINCT string_split(rtrim({_PATH}, '/'), '/') AS l FROM pages), folders AS (SELECT DISTINCT array_to_string(l[1 : k], '/') AS path, k FROM full_, range(1, 4) AS g(k) WHERE k <= len(l) AND len(list_filter(l[1 : k], lambda p: starts_with(p, '.'))) = 0)"


@query(
    f"WITH {_FOLDERS}, labels AS (SELECT path AS entry, CASE WHEN contains(path, '/en') THEN NULL ELSE 'alpha' END AS owner FROM folders WHERE k = 1 AND length(path) % 3 = 0 OR k = 2 AND contains(path, '/en')),"
    " deepest AS (SELECT f.path, arg_max(owner IS NULL, length(entry)) AS out_ FROM folders f JOIN labels ON f.path = entry OR starts_with(f.path, entry || '/') GROUP BY 1),"
    " closed AS (SELECT path FROM folders LEFT JOIN deepest USING (path) WHERE coalesce(out_, true)) SELECT path FROM closed c WHERE NOT EXISTS (SELECT 1 FROM closed a WHERE starts_with(c.path, a.path || '/'))"
)
def unassigned_folders(spark, sf_dir):
    path = F.rtrim(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", ""), F.lit("/"))
    each = table(spark, sf_dir, "pages").select(F.explode(T.path_prefixes(path)).alias("path")).distinct()
    folders = each.withColumn("k", F.size(F.split("path", "/"))).filter("k <= 3")
    labels = folders.filter(((F.col("k") == 1) & (F.length("path") % 3 == 0)) | ((F.col("k") == 2) & F.col("path").contains("/en"))).select(F.col("path").alias("entry"), F.when(~F.col("path").contains("/en"), "alpha").alias("owner"))
    return workspace.unassigned(folders.select("path"), labels)


_WS = "e AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '/ws/p' WHEN 1 THEN '/ws' ELSE '/other' END AS cwd, CASE doc_id % 7 WHEN 0 THEN '/ws/p/../q/a.py' WHEN 1 THEN '/ws/../x.py' WHEN 2 THEN '/home/-ws/m.md' WHEN 3 THEN '/home/-ws-p/m.md' WHEN 4 THEN '/tmp/one.txt' WHEN 5 THEN '/tmp/a/b.txt' ELSE 'rel.py' END AS f FROM documents)"


@query(f"WITH {_WS} SELECT doc_id FROM e WHERE cwd <> '/other' AND (f IN ('/ws/p/../q/a.py', '/home/-ws/m.md', '/tmp/one.txt') OR f = '/home/-ws-p/m.md' AND cwd = '/ws/p')")
def edges_in_workspace(spark, sf_dir):
    n = F.col("doc_id")
    files = ["/ws/p/../q/a.py", "/ws/../x.py", "/home/-ws/m.md", "/home/-ws-p/m.md", "/tmp/one.txt", "/tmp/a/b.txt", "rel.py"]
    file = F.get(F.array(*map(F.lit, files)), (n % 7).cast("int"))
    cwd = F.get(F.array(F.lit("/ws/p"), F.lit("/ws"), F.lit("/other")), (n % 3).cast("int"))
    return workspace.in_scope(table(spark, sf_dir, "documents").select("doc_id", cwd.alias("cwd"), file.alias("file_path")), "/ws", "/home").select("doc_id")


@query(
    """WITH t AS (SELECT conv_id, turn, role, conv_id * 7 + turn AS n FROM conversations),
    p AS (SELECT *, CASE n % 5 WHEN 0 THEN '/ws/secret/a' WHEN 1 THEN '/ws/top.md' ELSE '/ws/alpha/a' END AS file, CASE WHEN n % 3 = 0 THEN '/ws/secret' ELSE '/ws/alpha' END AS cwd FROM t),
    g AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS change FROM p),
    r AS (SELECT *, sum(change) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM g),
    w AS (SELECT *, max(CASE WHEN file = '/ws/secret/a' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY run RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS withheld FROM r)
    SELECT conv_id AS session_id, turn AS ord, CASE WHEN cwd = '/ws/alpha' THEN 'r' END AS repo_path, CASE WHEN withheld THEN '[withheld]' ELSE 'why' END AS rationale FROM w WHERE file = '/ws/alpha/a'"""
)
def routed_edges(spark, sf_dir):
    n = F.col("conv_id") * 7 + F.col("turn")
    file = F.when(n % 5 == 0, "/ws/secret/a").when(n % 5 == 1, "/ws/top.md").otherwise("/ws/alpha/a")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("role").alias("group_id"), F.col("turn").alias("ord"), file.alias("file_path"), F.when(n % 3 == 0, "/ws/secret").otherwise("/ws/alpha").alias("cwd"), F.lit("r").alias("repo_path"), F.lit("b").alias("git_branch"), F.lit("why").alias("rationale"))
    labels = spark.createDataFrame([("/ws/alpha", "alpha"), ("/ws/secret", "beta")], "entry string, owner string")
    return workspace.routed(rows, labels, "alpha", "/ws", "/home/-ws").select("session_id", "ord", "repo_path", "rationale")


_SUBS = "subs AS (SELECT * FROM (VALUES (0, 'folder', '/d', 'design'), (1, 'folder', '/d/src1', 'memory'), (2, 'root', '/d/src2', 'root'), (3, 'refs', '/d/src3', 'commits'), (4, 'file', '/d/src4/en.md', 'session')) AS v(n, kind, root, corpus))"


@query(
    f"WITH ev_ AS (SELECT doc_id, '/d/' || source || '/' || CASE WHEN doc_id % 6 = 0 THEN '.git/HEAD' WHEN doc_id % 6 = 1 THEN 'x/' || lang || '.md' ELSE lang || '.md' END AS path FROM documents), {_SUBS},"
    " f AS (SELECT doc_id, corpus, row_number() OVER (PARTITION BY doc_id ORDER BY len(string_split(root, '/')) DESC, n DESC) AS k FROM ev_ JOIN subs ON CASE kind WHEN 'file' THEN path = root WHEN 'folder' THEN ends_with(path, '.md') AND starts_with(path, root || '/') WHEN 'root' THEN ends_with(path, '.md') AND regexp_extract(path, '^(.*)/[^/]*$', 1) = root ELSE path = root || '/.git/HEAD' END)"
    " SELECT doc_id, corpus FROM f WHERE k = 1"
)
def routed_notifications(spark, sf_dir):
    n, lang = F.col("doc_id") % 6, F.col("lang")
    tail = F.when(n == 0, ".git/HEAD").when(n == 1, F.concat(F.lit("x/"), lang, F.lit(".md"))).otherwise(F.concat(lang, F.lit(".md")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/d/"), "source", F.lit("/"), tail).alias("path"))
    subs = spark.createDataFrame([(0, "folder", "/d", "design"), (1, "folder", "/d/src1", "memory"), (2, "root", "/d/src2", "root"), (3, "refs", "/d/src3", "commits"), (4, "file", "/d/src4/en.md", "session")], "n int, kind string, root string, corpus string")
    return ingest.route(rows, subs).select("doc_id", "corpus")


@query(
    r"""WITH p AS (SELECT doc_id, source || '/' || lang || CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.md' WHEN 2 THEN '.toml' WHEN 3 THEN '/memory/x.txt' ELSE '' END AS path, md5(CAST(doc_id AS VARCHAR)) AS h, doc_id - 300 AS n FROM documents)
    SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'code' WHEN 1 THEN 'design' WHEN 2 THEN 'config' WHEN 3 THEN 'memory' ELSE 'other' END AS layer,
    CASE doc_id % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'markdown' WHEN 2 THEN 'toml' ELSE NULL END AS language, CASE doc_id % 5 WHEN 0 THEN 'py' WHEN 1 THEN 'md' WHEN 2 THEN 'toml' WHEN 3 THEN 'txt' ELSE '?' END AS author_lang,
    false AS owned, left(h, 7) AS short, regexp_full_match(path, '[a-z0-9_.]{1,64}') AS safe, path[length(source_) + 2 :] AS relative, CASE WHEN n >= 0 THEN '+' ELSE '-' END || format('{:,}', abs(n)) AS signed, length(h) >= 3 AND NOT regexp_matches(h, '[\\.+*?()|\[\]{}^$]') AS indexable
    FROM (SELECT p.*, d.source AS source_ FROM p JOIN documents d USING (doc_id))"""
)
def path_and_label_functions(spark, sf_dir):
    n = F.col("doc_id") % 5
    docs = table(spark, sf_dir, "documents")
    path = F.concat("source", F.lit("/"), "lang", F.when(n == 0, ".py").when(n == 1, ".md").when(n == 2, ".toml").when(n == 3, "/memory/x.txt").otherwise(""))
    rows = docs.select("doc_id", "source", path.alias("path"), F.md5(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    p = F.col("path")
    return rows.select("doc_id", T.layer_of(p).alias("layer"), T.language_of(p).alias("language"), T.author_language(p).alias("author_lang"), T.owned_by_other_corpus(p).alias("owned"), T.short_hash(F.col("h")).alias("short"), T.is_safe_key(p).alias("safe"), T.relative_to(p, F.col("source")).alias("relative"), N.signed(F.col("doc_id") - 300).alias("signed"), T.is_indexable(F.col("h")).alias("indexable"))


@query(
    """WITH c AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'Grep' WHEN 5 THEN 'mcp__engine__find' ELSE 'Bash' END AS name, CASE doc_id % 6 WHEN 1 THEN 'sudo grep x' WHEN 2 THEN 'ls; rg y | wc' WHEN 3 THEN 'cat z | grep x' WHEN 4 THEN 'make' END AS command FROM documents)
    SELECT doc_id, CASE doc_id % 6 WHEN 5 THEN 'own' WHEN 0 THEN 'retrieval' WHEN 1 THEN 'retrieval' WHEN 2 THEN 'retrieval' END AS class FROM c"""
)
def tool_call_classes(spark, sf_dir):
    n = F.col("doc_id") % 6
    command = F.when(n == 1, "sudo grep x").when(n == 2, "ls; rg y | wc").when(n == 3, "cat z | grep x").when(n == 4, "make")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(n == 0, "Grep").when(n == 5, "mcp__engine__find").otherwise("Bash").alias("name"), command.alias("command"))
    return rows.select("doc_id", etl.tool_class(F.col("name"), F.col("command"), "engine").alias("class"))


@query("SELECT doc_id, trim(string_split(text, chr(10))[1], ' ') AS summary, len(string_split(text, chr(10))) > 1 AND length(trim(array_to_string(string_split(text, chr(10))[2:], ''), ' ')) > 0 AS has_body FROM documents WHERE text IS NOT NULL")
def split_messages(spark, sf_dir):
    summary, body = T.split_message(F.col("text"))
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", summary.alias("summary"), body.isNotNull().alias("has_body"))


@query(f"WITH a AS (SELECT DISTINCT regexp_extract({_PATH}, '^([^/]+)', 1) AS root FROM pages) SELECT page_id, count(*) AS n_related FROM (SELECT page_id, rtrim({_PATH}, '/') AS path FROM pages) JOIN a ON path = root OR starts_with(path, root || '/') OR starts_with(root, path || '/') GROUP BY 1")
def related_folders(spark, sf_dir):
    path = F.rtrim(F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", ""), F.lit("/"))
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    roots = rows.select(F.regexp_extract("path", "^([^/]+)", 1).alias("root")).distinct()
    joined = rows.join(roots, F.regexp_extract("path", "^([^/]+)", 1) == F.col("root"))  # related folders have one first part
    return joined.filter(joins.related(F.col("path"), F.col("root"))).groupBy("page_id").agg(F.count(F.lit(1)).alias("n_related"))


@query("WITH p AS (SELECT doc_id % 50 AS term, min(doc_id) AS a FROM documents WHERE doc_id % 3 = 0 GROUP BY 1), e AS (SELECT doc_id % 50 AS term, min(doc_id) AS b FROM documents WHERE doc_id % 3 = 0 AND doc_id % 50 > 5 OR doc_id % 3 = 1 AND doc_id % 50 < 45 GROUP BY 1) SELECT term, coalesce(b < a, false) AS author_earlier, a IS NULL AND b IS NOT NULL AS gained, b - a AS shift FROM p FULL JOIN e USING (term)")
def compared_measurements(spark, sf_dir):
    from ..operators.provenance import compared

    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("term"), "doc_id")
    least = lambda condition: docs.filter(condition).groupBy("term").agg(F.min("doc_id").alias("author_at"))
    return compared(least("doc_id % 3 = 0"), least("doc_id % 3 = 0 AND term > 5 OR doc_id % 3 = 1 AND term < 45"))


@query(f"WITH {EV} SELECT event_type AS op_name, median_ FROM (SELECT event_type, list_sort(list(k))[count(*) // 2 + 1] AS median_ FROM ev GROUP BY 1)")
def op_medians(spark, sf_dir):
    return A.medians(events(spark, sf_dir), "event_type", "k").select(F.col("event_type").alias("op_name"), F.col("median").alias("median_"))
