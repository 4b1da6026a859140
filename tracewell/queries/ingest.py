"""Merge, relocation and streaming queries: halves of a table as the stored and the new state."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import etl, merge, relocate
from ..workers import ship_package
from .registry import query, removed, scratch, table


@query(
    "WITH e AS (SELECT user_id, event_type, event_id FROM events), old AS (SELECT user_id, event_type, min(event_id) AS event_id FROM e WHERE event_id % 2 = 0 GROUP BY 1, 2), new AS (SELECT user_id, event_type, min(event_id) AS event_id FROM e WHERE event_id % 2 = 1 GROUP BY 1, 2)"
    " SELECT * FROM old UNION ALL SELECT * FROM new WHERE (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM old)"
)
def insert_or_ignore_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    old = rows.filter("event_id % 2 = 0").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    return merge.insert_or_ignore(old, rows.filter("event_id % 2 = 1"), ["user_id", "event_type"], ["event_id"])


@query(
    "WITH old AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS commit_id FROM orders), found AS (SELECT l_orderkey AS o_orderkey, min(l_suppkey) AS c FROM lineitem WHERE l_linenumber = 1 GROUP BY 1)"
    " SELECT o_orderkey, o_custkey, coalesce(commit_id, c) AS commit_id FROM old LEFT JOIN found USING (o_orderkey)"
)
def late_binding(spark, sf_dir):
    old = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("commit_id"))
    found = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("commit_id"))
    return merge.late_binding(old, found, ["o_orderkey"], "commit_id")


@query(
    "WITH old AS (SELECT doc_id, source AS kind, n_chars FROM documents WHERE doc_id % 3 <> 0), new AS (SELECT doc_id, lang AS kind, n_chars * 2 AS n_chars FROM documents WHERE doc_id % 2 = 0)"
    " SELECT o.doc_id, o.kind, coalesce(n.n_chars, o.n_chars) AS n_chars FROM old o LEFT JOIN new n USING (doc_id) UNION ALL SELECT * FROM new WHERE doc_id NOT IN (SELECT doc_id FROM old)"
)
def upsert_latest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old = docs.filter("doc_id % 3 <> 0").select("doc_id", F.col("source").alias("kind"), "n_chars")
    new = docs.filter("doc_id % 2 = 0").select("doc_id", F.col("lang").alias("kind"), (F.col("n_chars") * 2).alias("n_chars"))
    return merge.upsert(old, new, ["doc_id"], ("kind",))


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def sweep_missing(spark, sf_dir):
    return merge.sweep(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels"), ["doc_id"])


@query(
    "WITH old AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 5 <> 0), new AS (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 4 <> 0)"
    " SELECT coalesce(o.doc_id, n.doc_id) AS doc_id, CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'gone' WHEN o.h = n.h THEN 'unchanged' ELSE 'changed' END AS status FROM old o FULL JOIN new n ON o.doc_id = n.doc_id"
)
def hash_skip_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    old = docs.filter("doc_id % 5 <> 0").select("doc_id", F.md5("text").alias("content_hash"))
    new = docs.filter("doc_id % 4 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"))
    return merge.by_content(old, new, "doc_id")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang NOT IN ('de', 'fr') UNION ALL SELECT doc_id, lang, -n_chars FROM documents WHERE lang IN ('de', 'fr') AND doc_id % 2 = 0")
def replace_by_document(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    new = docs.filter("lang IN ('de', 'fr') AND doc_id % 2 = 0").withColumn("n_chars", -F.col("n_chars"))
    return merge.replace_by(docs, new, "lang")


@query("SELECT CAST(user_id AS VARCHAR) AS session_id, min(CAST(floor(epoch(ts)) AS BIGINT)) AS first_seen, max(event_id % 17) AS retrieval_calls, max(event_id % 5) AS own_calls FROM events GROUP BY 1")
def activity_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("session_id"), F.unix_timestamp("ts").alias("first_seen"), (F.col("event_id") % 17).alias("retrieval_calls"), (F.col("event_id") % 5).alias("own_calls"), "event_id")
    old, new = rows.filter("event_id % 2 = 0").drop("event_id"), rows.filter("event_id % 2 = 1").drop("event_id")
    return merge.merge_activity(old, new)


@query("SELECT source AS name, arg_max(doc_id, doc_id) AS doc_id, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY 1")
def last_by_name(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("name"), "doc_id", "n_chars")
    return merge.last_by(rows, ["name"], ["doc_id"])


@query(
    """WITH have AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 3 = 0), s AS (SELECT user_id, event_type, event_id % 11 = 0 AS bad, event_id % 7 = 0 AS empty FROM events WHERE event_id % 3 <> 0)
    SELECT count(*) AS scanned, count(*) FILTER (WHERE bad) AS parse_errors, count(*) FILTER (WHERE NOT bad AND empty) AS skipped_no_layer2,
    (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM s WHERE NOT bad AND NOT empty AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM have))) AS inserted,
    count(*) FILTER (WHERE NOT bad AND NOT empty) - (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM s WHERE NOT bad AND NOT empty AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM have))) AS skipped_existing FROM s"""
)
def backfill_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("ts"), F.col("event_type").alias("tool"), "event_id")
    have = rows.filter("event_id % 3 = 0").groupBy("ts", "tool").agg(F.min("event_id").alias("result_tokens"))
    scanned = rows.filter("event_id % 3 <> 0").select("ts", "tool", F.when(F.col("event_id") % 7 != 0, F.col("event_id")).alias("result_tokens"), (F.col("event_id") % 11 == 0).alias("parse_error"))
    _, report = merge.backfill_report(have, scanned)
    return report


_DUMP = "(VALUES ('shop', 'public', 'Orders', 'table'), ('shop', 'audit', 'orders', 'view'), ('shop', 'public', 'Items', 'table')) AS o(db, schema_name, object_name, object_type)"


@query(f"SELECT db, schema_name, object_name, object_type FROM {_DUMP} WHERE lower(object_name) = lower('ORDERS') AND lower(schema_name) = lower('Public')")
def schema_lookup_nocase(spark, sf_dir):
    objects = spark.createDataFrame([("shop", "public", "Orders", "table"), ("shop", "audit", "orders", "view"), ("shop", "public", "Items", "table")], "db string, schema_name string, object_name string, object_type string")
    schema, name = T.split_qualified(F.lit('[Public]."ORDERS"'))
    return objects.filter((F.lower("object_name") == F.lower(name)) & (schema.isNull() | (F.lower("schema_name") == F.lower(schema))))


@query(
    "SELECT s_suppkey AS id, 'db.public.' || s_name || ' (table)' || chr(10) || '  id bigint NOT NULL' || chr(10) || '  note varchar(' || (s_nationkey + 1) || ') DEFAULT ''x''' AS body FROM supplier"
)
def render_schema(spark, sf_dir):
    column = lambda name, kind, nullable, length, default: F.struct(F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(nullable).alias("nullable"), length.cast("long").alias("max_len"), F.lit(default).cast("string").alias("default"))
    columns = F.array(column("id", "bigint", False, F.lit(None), None), column("note", "varchar", True, F.col("s_nationkey") + 1, "'x'"))
    body = etl.render_object(F.lit("db"), F.lit("public"), F.col("s_name"), F.lit("table"), columns, F.lit(None).cast("string"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), body.alias("body"))


@query(
    "SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'missing' WHEN doc_id % 2 = 0 OR doc_id % 3 <> 0 THEN 'fresh' ELSE 'changed' END AS state FROM documents"
)
def freshness_status(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.lit(1).alias("mtime"), F.md5("text").alias("content_hash"), "text")
    live = docs.filter("path % 10 <> 0").select("path", F.when(F.col("path") % 2 == 0, 1).otherwise(2).alias("mtime"), F.md5(F.when(F.col("path") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("content_hash"))
    return relocate.file_state(docs.drop("text"), live).select(F.col("path").alias("doc_id"), "state")


_LINES = "CASE WHEN {0} = '' THEN [] ELSE string_split(regexp_replace({0}, '\\n$', ''), chr(10)) END"


@query(
    f"""WITH own AS (SELECT doc_id, n, trim(l[n], chr(32) || chr(9) || chr(13) || chr(10)) AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, {_LINES.format('text')} AS l FROM documents))),
    file AS (SELECT doc_id, k, trim(l[k], chr(32) || chr(9) || chr(13) || chr(10)) AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, {_LINES.format("(repeat(chr(120) || chr(10), CAST(doc_id % 4 AS BIGINT)) || text)")} AS l FROM documents))),
    a AS (SELECT * FROM own WHERE strlen(line) >= 8 AND regexp_matches(line, '[\\p{{L}}\\p{{N}}]')), b AS (SELECT * FROM file WHERE strlen(line) >= 8 AND regexp_matches(line, '[\\p{{L}}\\p{{N}}]')),
    t AS (SELECT doc_id, count(*) AS n_distinctive FROM a GROUP BY 1), v AS (SELECT a.doc_id, k - n AS shift, count(*) AS n_votes FROM a JOIN b ON a.doc_id = b.doc_id AND a.line = b.line GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_votes DESC, abs(shift), shift) AS rn FROM v)
    SELECT t.doc_id, n_distinctive, CAST(shift AS BIGINT) AS shift, n_votes, coalesce(n_distinctive >= 3 AND n_votes * 2 >= n_distinctive, false) AS accepted FROM t LEFT JOIN r ON t.doc_id = r.doc_id AND rn = 1"""
)
def relocate_vote(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stored = docs.select(F.col("doc_id").alias("key"), F.lit(1).cast("long").alias("line_start"), F.col("text").alias("body"))
    live = docs.select(F.col("doc_id").alias("key"), F.concat(F.repeat(F.lit("x\n"), (F.col("doc_id") % 4).cast("int")), F.col("text")).alias("text"))
    return relocate.votes(stored, live).select(F.col("key").alias("doc_id"), "n_distinctive", "shift", "n_votes", "accepted")


@query()
def relocate_exact(spark, sf_dir):
    ship_package(spark)
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    chunks = etl.chunks(docs.select("doc_id", "text"), "text", 20).withColumnRenamed("chunk", "body")
    live = F.concat(F.repeat(F.lit("x\n"), (F.col("doc_id") % 4).cast("int")), F.col("text"))
    rows = chunks.withColumn("live", F.when(F.col("doc_id") % 9 != 0, live))
    return relocate.relocated(rows).select("doc_id", "line_start", "status", "shift", "new_start", "new_end")


@query()
def markdown_sections(spark, sf_dir):
    """Documents as Markdown: every third line is made a heading of its length's level."""
    ship_package(spark)
    head = F.array_join(F.transform(F.split("text", "\n"), lambda s, n: F.when(n % 3 == 0, F.concat(F.repeat(F.lit("#"), F.length(s) % 3 + 1), F.lit(" "), s)).otherwise(s)), "\n")
    rows = table(spark, sf_dir, "documents").select("doc_id", head.alias("text"))
    return etl.sections(rows).select("doc_id", "heading_path", "line_start", "line_end", F.md5("body").alias("digest"))


@query("SELECT event_type, count(DISTINCT user_id) AS n_keys FROM events GROUP BY 1")
def stream_dedupe_counts(spark, sf_dir):
    """The events as a file stream, merged by user and type: each key once, in whatever batches and order they come."""
    from ..streaming.ingest import Table, start_merge

    at = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    atexit.register(removed, spark, at)
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id")
    source = rows.schema
    rows.repartitionByRange(3, "event_id").write.parquet(f"{at}/in")
    stream = spark.readStream.schema(source).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    merged = Table(spark, f"{at}/table", ["user_id", "event_type"])
    run = start_merge(stream, merged, ["event_id"], f"{at}/checkpoint", {"availableNow": True})
    run.awaitTermination()
    kept = merged.read()
    return (rows.limit(0) if kept is None else kept).groupBy("event_type").agg(F.count(F.lit(1)).alias("n_keys"))


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_time_windows(spark, sf_dir):
    from ..streaming.ingest import windowed

    rows = windowed(table(spark, sf_dir, "events").select("ts", "event_type", "value"), "ts", "10 minutes", "1 hour", None, "event_type", "value")
    return rows.select(F.unix_timestamp("w.start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))
