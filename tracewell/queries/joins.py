"""Recency, as-of, prefix and routing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import etl
from ..operators import joins as J
from ..operators.scan import carried
from .registry import query, table

#: Rows of a table that one task joins or sorts, where the table's size sets the number of parts.
ROWS_OF_TASK = 1 << 19
#: The tables' own clock: the last event's second.
NOW_SQL = "(SELECT CAST(floor(epoch(max(ts))) AS BIGINT) FROM events)"


def now_of(spark, sf_dir) -> int:
    return table(spark, sf_dir, "events").agg(F.unix_timestamp(F.max("ts"))).first()[0]


@query("SELECT conv_id, turn, role, length(text) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn = 1 ORDER BY conv_id DESC LIMIT 50")
def recent_conversations(spark, sf_dir):
    rows = J.latest_per(table(spark, sf_dir, "conversations"), "conv_id", [F.desc("turn")])
    return rows.select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars")).orderBy(F.desc("conv_id")).limit(50)


@query(
    "WITH m AS (SELECT * FROM conversations WHERE list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), 'the')), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn, count(*) OVER (PARTITION BY conv_id) AS n_matches FROM m)"
    " SELECT conv_id, turn, n_matches FROM r WHERE rn = 1"
)
def recent_conversations_filtered(spark, sf_dir):
    found = table(spark, sf_dir, "conversations").filter(F.array_contains(T.tokens(F.col("text")), "the"))
    counts = found.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.count(F.lit(1)).alias("n_matches"))
    return counts.select("conv_id", "turn", "n_matches")


@query("SELECT count(DISTINCT conv_id) AS sessions, count(*) AS turns, count(DISTINCT conv_id) FILTER (WHERE contains(lower(text), 'the')) AS sessions_matched FROM conversations")
def session_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return rows.agg(F.countDistinct("conv_id").alias("sessions"), F.count(F.lit(1)).alias("turns"), F.countDistinct(F.when(T.contains_like(F.col("text"), "THE"), F.col("conv_id"))).alias("sessions_matched"))


@query(
    "SELECT conv_id, turn, md5(last_value(CASE WHEN role = 'assistant' AND trim(text) <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS rationale FROM conversations"
)
def carry_forward_rationale(spark, sf_dir):
    said = F.when((F.col("role") == "assistant") & (F.trim("text") != ""), F.col("text"))
    return carried(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", said, "said").select("conv_id", "turn", F.md5("said").alias("rationale"))


@query(
    """WITH t AS (SELECT c.conv_id, c.turn, c.role, coalesce(l.toxic, 0) = 1 AS tainted FROM conversations c LEFT JOIN labels l ON l.doc_id = c.conv_id * 7 + c.turn),
    g AS (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS change FROM t),
    r AS (SELECT *, sum(change) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM g)
    SELECT conv_id, turn, max(CAST(tainted AS INT)) OVER (PARTITION BY conv_id ORDER BY run RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS withheld FROM r"""
)
def ratchet_admission(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select((F.col("toxic") == 1).alias("toxic"), F.col("doc_id"))
    turns = table(spark, sf_dir, "conversations").withColumn("doc_id", F.col("conv_id") * 7 + F.col("turn"))
    rows = turns.join(labels, "doc_id", "left").withColumn("tainted", F.coalesce("toxic", F.lit(False)))
    return J.ratchet(rows, ["conv_id"], "role", ["turn"], "tainted").select("conv_id", "turn", "withheld")


@query("SELECT o_orderkey, o_custkey, CAST(epoch(o_orderdate) AS BIGINT) AS ordered_at FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) - INTERVAL 30 DAY FROM orders) ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def recent_orders(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("ordered_at", F.unix_timestamp("o_orderdate"))
    now = orders.agg(F.max("ordered_at")).first()[0]
    return J.since(orders, "ordered_at", now, 30).orderBy(F.desc("ordered_at"), "o_orderkey").limit(50).select("o_orderkey", "o_custkey", "ordered_at")


@query("SELECT o_orderkey, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE contains(lower(c_mktsegment), 'build') ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def recent_orders_by_segment(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").filter(T.contains_like(F.col("c_mktsegment"), "Build"))
    joined = table(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(50).select("o_orderkey", "c_mktsegment")


@query(
    """WITH e AS (SELECT event_id, 1 + user_id % 150 AS cust, CAST(floor(epoch(ts)) AS BIGINT) - 86400 * 365 * 25 AS edited_at FROM events),
    c AS (SELECT o_custkey AS cust, o_orderkey AS commit_id, CAST(epoch(o_orderdate) AS BIGINT) AS committed_at FROM orders),
    j AS (SELECT e.event_id, e.edited_at, min({'committed_at': c.committed_at, 'commit_id': c.commit_id}) AS n FROM e LEFT JOIN c ON e.cust = c.cust AND c.committed_at >= e.edited_at GROUP BY 1, 2)
    SELECT event_id, edited_at, n.commit_id AS commit_id, n.committed_at AS committed_at FROM j"""
)
def capturing_order_asof(spark, sf_dir):
    edits = table(spark, sf_dir, "events").select("event_id", (F.lit(1) + F.col("user_id") % 150).alias("cust"), (F.unix_timestamp("ts") - 86400 * 365 * 25).alias("edited_at"))
    commits = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("commit_id"), F.unix_timestamp("o_orderdate").alias("committed_at"))
    return J.capturing(edits, commits, ["cust"]).select("event_id", "edited_at", "commit_id", "committed_at")


_PATHS = "paths AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS path FROM pages)"
_ROOTS = "roots AS (SELECT DISTINCT regexp_extract(path, '^[^/]+', 0) AS root FROM paths UNION SELECT DISTINCT regexp_extract(path, '^[^/]+/[^/]+', 0) FROM paths WHERE contains(path, '/en/'))"


def _paths(spark, sf_dir):
    url = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", url.alias("path"))


def _roots(paths):
    return paths.select(F.regexp_extract("path", "^[^/]+", 0).alias("root")).union(paths.filter(F.col("path").contains("/en/")).select(F.regexp_extract("path", "^[^/]+/[^/]+", 0))).distinct()


@query(f"WITH {_PATHS}, {_ROOTS}, h AS (SELECT page_id, root, row_number() OVER (PARTITION BY page_id ORDER BY length(root) DESC) AS rn FROM paths LEFT JOIN roots ON path = root OR starts_with(path, root || '/')) SELECT page_id, root FROM h WHERE rn = 1")
def longest_prefix_owner(spark, sf_dir):
    paths = _paths(spark, sf_dir)
    return J.owner(paths, _roots(paths)).select("page_id", "root")


_LABELS = "labelled AS (SELECT root AS entry, CASE WHEN contains(root, '/en') THEN NULL WHEN length(root) % 3 = 0 THEN 'alpha' ELSE 'beta' END AS owner FROM roots)"


@query(
    f"WITH {_PATHS}, {_ROOTS}, {_LABELS}, h AS (SELECT page_id, owner, rank() OVER (PARTITION BY page_id ORDER BY length(entry) DESC) AS rn FROM paths JOIN labelled ON path = entry OR starts_with(path, entry || '/')),"
    " s AS (SELECT page_id, bool_or(coalesce(owner = 'alpha', false)) AND NOT bool_or(owner IS NULL) AS ok FROM h WHERE rn = 1 GROUP BY 1) SELECT p.page_id, coalesce(ok, false) AS admitted FROM paths p LEFT JOIN s USING (page_id)"
)
def domain_visible(spark, sf_dir):
    paths = _paths(spark, sf_dir)
    owner = F.when(F.col("root").contains("/en"), F.lit(None)).when(F.length("root") % 3 == 0, "alpha").otherwise("beta")
    labels = _roots(paths).select(F.col("root").alias("entry"), owner.alias("owner"))
    return J.visible(paths, labels, "alpha").select("page_id", "admitted")


@query("SELECT l_partkey AS part, max({'d': CAST(epoch(o_orderdate) AS BIGINT), 'k': o_orderkey}).k AS order_key, CAST(epoch(max(o_orderdate)) AS BIGINT) AS committed_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def last_touch_provenance(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.unix_timestamp("o_orderdate").alias("committed_at"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("string").alias("part"))
    parts = max(spark.sparkContext.defaultParallelism, -(-lines.count() // ROWS_OF_TASK))  # the files' own counts
    each = lines.repartition(parts, "l_orderkey").join(orders.repartition(parts, "l_orderkey"), "l_orderkey")
    commits = each.select(F.lit("repo").alias("repo"), F.col("l_orderkey").alias("commit_hash"), F.array(F.lit("parent")).alias("parents"), "committed_at", F.array("part").alias("files"))
    return etl.last_touch(commits, parts).select(F.col("path").cast("long").alias("part"), F.col("commit_hash").alias("order_key"), "committed_at")


@query(
    "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS host, regexp_extract(regexp_replace(url, '^[a-z]+://[^/]*', ''), '^(.*)/[^/]*$', 1) AS folder, translate(url, '/_.', '---') AS slug,"
    " CASE WHEN contains(url, '.html') THEN 'html' ELSE '' END AS ext FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url FROM pages)"
)
def url_path_parts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"[?#].*$", "").alias("url"))
    rest = F.regexp_replace("url", "^[a-z]+://[^/]*", "")
    return pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("host"), T.parent_dir(rest).alias("folder"), T.slug(F.col("url")).alias("slug"), F.when(T.extension(rest) == "html", "html").otherwise("").alias("ext"))


@query("SELECT c.doc_id, c.n, l.quality, l.toxic IS NULL AS unlabelled FROM (SELECT doc_id, length(text) AS n FROM documents) c LEFT JOIN labels l USING (doc_id)")
def provenance_left_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left").select("doc_id", "n", "quality", F.col("toxic").isNull().alias("unlabelled"))
