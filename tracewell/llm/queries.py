"""The registered queries of this package: thin calls of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, exact_digest, fim, hardneg, langid, linededup, mixing, pii, quality, sharding, simhash, toxicity, url_filter
from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def op1_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read_table(spark, sf_dir, "documents"))


def op2_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


def op4_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"))


def op5_prefix_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_report(read_table(spark, sf_dir, "documents"))


def op6_bitmask_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"))


def op7_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.drop("text_hash")


def op8_random_indexing_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_vantage_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_exact_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_digest.compare(read_table(spark, sf_dir, "documents"))


def op11_relational_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.report(read_table(spark, sf_dir, "documents"))


def op12_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_voronoi_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(read_table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_hierarchical_mix, op2_weak_pii, op3_url_filter, op4_hash_tree_shards, op5_prefix_line_join, op6_bitmask_langid, op7_positional_index, op8_random_indexing_quality, op9_vantage_simhash, op10_exact_digest, op11_relational_fim, op12_string_kernel_toxicity, op13_voronoi_negatives)}

#: Words and windows by regular expression and a join of window texts.
OP7_SQL = r"""
WITH doc_words AS (
    SELECT rowid_, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM (SELECT row_number() OVER () AS rowid_, doc_id, text FROM documents)
), item_words AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), item_windows AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + 9], ' ') AS win
    FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item_words WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
    SELECT rowid_, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
    FROM (SELECT rowid_, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, sizes WHERE len(w) >= n)
), hits AS (
    SELECT d.rowid_, d.i, d.n, t.item_id FROM doc_windows d JOIN item_windows t ON d.n = t.n AND d.win = t.win
), covered AS (
    SELECT rowid_, count(DISTINCT p) AS n_hit FROM (SELECT rowid_, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1
), owners AS (
    SELECT rowid_, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT rowid_, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(o.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(o.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN covered c USING (rowid_) LEFT JOIN owners o USING (rowid_)
"""

#: Every pair of distinct lines that share a word, by counting the words they share.
OP5_SQL = r"""
WITH lines AS (
    SELECT doc_id, i - 1 AS line, parts[i] AS body
    FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL))
), classes AS (
    SELECT body, min({'doc': doc_id, 'line': line}) AS first, row_number() OVER (ORDER BY min({'doc': doc_id, 'line': line})) AS c FROM lines GROUP BY body
), words AS (
    SELECT DISTINCT c, w FROM (SELECT c, unnest(string_split(translate(body, chr(9) || chr(13) || chr(11) || chr(12), '    '), ' ')) AS w FROM classes) WHERE w <> ''
), sizes AS (SELECT c, count(*) AS n FROM words GROUP BY c),
shared AS (
    SELECT a.c AS early, b.c AS later, count(*) AS s FROM words a JOIN words b ON a.w = b.w AND a.c < b.c GROUP BY 1, 2
), gone AS (
    SELECT DISTINCT later AS c FROM shared JOIN sizes x ON x.c = early JOIN sizes y ON y.c = later WHERE 5 * s >= 4 * (x.n + y.n - s)
), marked AS (
    SELECT l.doc_id, l.line, k.c IN (SELECT c FROM sizes) AND (k.first < {'doc': l.doc_id, 'line': l.line} OR k.c IN (SELECT c FROM gone)) AS gone
    FROM lines l JOIN classes k ON l.body = k.body
)
SELECT d.doc_id, CAST(count(m.line) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE m.gone) AS BIGINT) AS n_removed,
       coalesce(string_agg(CAST(m.line AS VARCHAR), ',' ORDER BY m.line) FILTER (WHERE m.gone), '') AS removed
FROM documents d LEFT JOIN marked m ON d.doc_id = m.doc_id GROUP BY d.doc_id
"""

#: Lines by regular expression, cut by sums of their lengths.
OP11_SQL = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, list_transform(regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+'), lambda u: length(u)) AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
    FROM documents
), drawn AS (
    SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
    FROM units
), cuts AS (
    SELECT doc_id, text, n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
           CAST(coalesce(list_sum(u[1 : least(h1 % (n + 1), h2 % (n + 1))]), 0) AS BIGINT) AS a, CAST(coalesce(list_sum(u[1 : greatest(h1 % (n + 1), h2 % (n + 1))]), 0) AS BIGINT) AS b
    FROM drawn
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || substr(text, 1, a) || '<S>' || substr(text, b + 1) || '<M>' || substr(text, a + 1, b - a)
              ELSE '<S>' || substr(text, b + 1) || '<P>' || substr(text, 1, a) || '<M>' || substr(text, a + 1, b - a) END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM cuts
"""

#: Every anchor against every vector, in whole numbers.
OP13_SQL = r"""
WITH vectors AS (
    SELECT CAST(vec_id AS BIGINT) AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), anchors AS (SELECT DISTINCT id, label, v FROM vectors WHERE id % 50 = 0),
pairs AS (
    SELECT a.id AS a, a.label = b.label AS same, b.id AS b, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS s FROM anchors a JOIN vectors b ON a.id <> b.id OR a.label <> b.label
), positives AS (SELECT a, b, s FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) AS INTEGER) AS rank, n.b AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM positives p JOIN pairs n ON n.a = p.a AND NOT n.same AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s
QUALIFY row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.b) <= 3
"""

ORACLES: dict[str, str] = {"op5_prefix_line_join": OP5_SQL, "op7_positional_index": OP7_SQL, "op11_relational_fim": OP11_SQL, "op13_voronoi_negatives": OP13_SQL}
