"""Authorship and feeder queries, over conversations and documents as code and prose.

A term's matches: documents (layer by source: even numbers are code, odd ones design) with the time
doc_id * 3000, and conversation turns (session edges) with the time conv_id * 5000 + turn * 60.

Queries without an ending are over TERMS, twelve given words. Those named ..._sampled are the whole
measurement: over a stride sample of SAMPLE_TERMS words of the documents' vocabulary, with the sample's
document frequencies and the window that the session edges have.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import analytics as A
from ..operators import provenance as P
from ..operators.search import spread
from .registry import ORACLES, query, table
from .search import TOKENS_OF

TERMS = ("license", "stupid", "apache", "version", "password", "example", "token", "trash", "mail7", "the", "der", "nosuchterm")
_IN = ", ".join(f"'{t}'" for t in TERMS)

#: Ranks are term frequencies below zero, which is all that the resolver needs of them.
MATCHES = f"""toks AS (SELECT doc_id, source, {TOKENS_OF.format('text')} AS t FROM documents),
    matches AS (SELECT term, CASE WHEN CAST(regexp_extract(source, '[0-9]+') AS BIGINT) % 2 = 0 THEN 'code' ELSE 'design' END AS layer, doc_id // 2 AS commit_hash, doc_id * 3000 AS authored_at, -len(list_filter(t, lambda x: x = term)) AS rank, source || '/' || doc_id || '.rs' AS file_path
    FROM toks, (SELECT unnest([{_IN}]) AS term) WHERE list_contains(t, term))"""
RESOLVED = f"""{MATCHES},
    kept AS (SELECT term, commit_hash, min({{'rank': rank, 'authored_at': authored_at, 'layer': layer, 'file_path': file_path}}) AS r FROM matches GROUP BY 1, 2),
    code AS (SELECT term, min({{'authored_at': r.authored_at, 'rank': r.rank, 'commit_hash': commit_hash}}) AS a FROM kept WHERE r.layer = 'code' GROUP BY 1),
    resolved AS (SELECT k.term, k.commit_hash, k.r.authored_at AS authored_at, k.r.file_path AS file_path, CASE WHEN k.commit_hash = c.a.commit_hash THEN 'author' WHEN k.r.layer = 'code' THEN 'other_code' ELSE 'feeder' END AS relation,
        CASE WHEN k.r.layer <> 'code' THEN k.r.authored_at - c.a.authored_at END AS delta FROM kept k LEFT JOIN code c USING (term))"""
FEEDERS = f"""{RESOLVED}, edges AS (SELECT term, conv_id AS session_id, role AS file_path, conv_id * 5000 + turn * 60 AS edited_at, -len(list_filter(t, lambda x: x = term)) AS rank
        FROM (SELECT *, {TOKENS_OF.format('text')} AS t FROM conversations), (SELECT unnest([{_IN}]) AS term) WHERE list_contains(t, term)),
    best AS (SELECT term, session_id, file_path, min({{'rank': rank, 'edited_at': edited_at}}) AS r FROM edges GROUP BY 1, 2, 3),
    authors AS (SELECT term, max(CASE WHEN relation = 'author' THEN authored_at END) AS author_at FROM resolved GROUP BY 1),
    feeders AS (SELECT b.term, session_id, file_path, b.r.edited_at AS edited_at, b.r.edited_at - author_at AS delta FROM best b LEFT JOIN authors a USING (term))"""
MEASURED = f"""{FEEDERS}, measured AS (SELECT r.term, count(*) AS df, max(CASE WHEN relation = 'author' THEN authored_at END) AS author_at, max(CASE WHEN relation = 'author' THEN file_path END) AS author_path,
        max(CASE WHEN relation = 'feeder' AND delta < 0 THEN delta END) AS prose_delta, any_value(s.session_delta) AS session_delta
    FROM resolved r LEFT JOIN (SELECT term, max(delta) AS session_delta FROM feeders WHERE delta < 0 GROUP BY 1) s ON r.term = s.term GROUP BY 1)"""


#: The same over the sample in place of the given words.
SAMPLE_TERMS = 200
_over_sample = lambda sql: f"sample AS ({ORACLES['stratified_terms']}), " + sql.replace(f"(SELECT unnest([{_IN}]) AS term)", "sample")
RESOLVED_S, FEEDERS_S = _over_sample(RESOLVED), _over_sample(FEEDERS)
MEASURED_S = f"""{FEEDERS_S}, opened AS (SELECT min(conv_id * 5000 + turn * 60) AS window_start FROM conversations),
    measured AS (SELECT s.term, any_value(s.df) AS df, max(CASE WHEN relation = 'author' THEN authored_at END) AS author_at, max(CASE WHEN relation = 'author' THEN r.file_path END) AS author_path,
        max(CASE WHEN relation = 'feeder' AND r.delta < 0 THEN r.delta END) AS prose_delta, any_value(f.session_delta) AS session_delta
    FROM sample s LEFT JOIN resolved r ON r.term = s.term LEFT JOIN (SELECT term, max(delta) AS session_delta FROM feeders WHERE delta < 0 GROUP BY 1) f ON f.term = s.term GROUP BY 1)"""


def _each_term(rows, *columns):
    """A row for each term that a text has, with its frequency: the text is tokenised once for all terms."""
    t = spread(rows.select("text", *columns)).withColumn("t", tokens(F.col("text")))
    times = lambda word: F.size(F.filter("t", lambda x: x == word))
    counts = F.filter(F.array(*(F.struct(F.lit(w).alias("term"), times(w).alias("tf")) for w in TERMS)), lambda c: c["tf"] > 0)
    return t.select(*columns, F.explode(counts).alias("c")).select("c.term", *columns, (-F.col("c.tf")).alias("rank"))


def sampled_terms(spark, sf_dir):
    """term, df of the sample, SAMPLE_TERMS rows at most: the words of ``stratified_terms``, a text's words counted once before the shuffle."""
    each = spread(table(spark, sf_dir, "documents").select("text")).select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    words = each.filter((F.length("term") >= 4) & F.col("term").rlike("^[a-z]+$")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).filter("df >= 2").persist(StorageLevel.MEMORY_AND_DISK)
    rows = A.stride_sample(words, SAMPLE_TERMS).select("term", "df").collect()
    words.unpersist()
    return spark.createDataFrame(rows, "term string, df long")


def _each_sampled(terms, rows, *columns):
    """As ``_each_term``, for a table of terms: one explode of the tokens, of which only the sample's are counted."""
    t = spread(rows.select("text", *columns)).withColumn("__row", F.monotonically_increasing_id())  # before the explode, which would number each token
    found = t.select(*columns, "__row", F.explode(tokens(F.col("text"))).alias("term")).join(F.broadcast(terms.select("term")), "term")  # SAMPLE_TERMS rows
    return found.groupBy("__row", *columns, "term").agg(F.count(F.lit(1)).alias("tf")).select("term", *columns, (-F.col("tf")).alias("rank"))


def _matches(spark, sf_dir, terms=None):
    docs = table(spark, sf_dir, "documents")
    rows = _each_term(docs, "doc_id", "source") if terms is None else _each_sampled(terms, docs, "doc_id", "source")
    layer = F.when(F.regexp_extract("source", "[0-9]+", 0).cast("long") % 2 == 0, "code").otherwise("design")
    return rows.select("term", layer.alias("layer"), F.floor(F.col("doc_id") / 2).alias("commit_hash"), (F.col("doc_id") * 3000).alias("authored_at"), "rank", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".rs")).alias("file_path"))


def _resolved(spark, sf_dir, terms=None):
    return P.resolve(_matches(spark, sf_dir, terms))


def _feeders(spark, sf_dir, resolved, terms=None):
    turns = table(spark, sf_dir, "conversations")
    edges = (_each_term(turns, "conv_id", "turn", "role") if terms is None else _each_sampled(terms, turns, "conv_id", "turn", "role")).select("term", F.col("conv_id").alias("session_id"), F.col("role").alias("file_path"), (F.col("conv_id") * 5000 + F.col("turn") * 60).alias("edited_at"), "rank")
    authors = resolved.groupBy("term").agg(F.max(F.when(F.col("relation") == "author", F.col("authored_at"))).alias("author_at"))
    return P.session_feeders(edges, authors)


def _measured(spark, sf_dir):
    resolved = _resolved(spark, sf_dir)
    rows = P.measured(resolved, _feeders(spark, sf_dir, resolved), 1_000_000)
    counts = resolved.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return rows.join(counts, "term").withColumn("author_lang", F.when(F.length("author_path") % 2 == 0, "rs").otherwise("tsx"))


def _measured_sample(spark, sf_dir):
    terms = sampled_terms(spark, sf_dir)
    resolved = _resolved(spark, sf_dir, terms)
    opened = table(spark, sf_dir, "conversations").agg(F.min(F.col("conv_id") * 5000 + F.col("turn") * 60)).first()[0]
    rows = P.measured(resolved, _feeders(spark, sf_dir, resolved, terms), opened)
    known = terms.join(rows, "term", "left").withColumn("has_author", F.col("author_at").isNotNull())
    return known.withColumn("author_lang", F.when(F.length("author_path") % 2 == 0, "rs").otherwise("tsx"))


@query(f"WITH {RESOLVED} SELECT term, commit_hash, authored_at, relation, delta FROM resolved")
def resolve_author_feeders(spark, sf_dir):
    return _resolved(spark, sf_dir).select("term", "commit_hash", "authored_at", "relation", "delta")


@query(f"WITH {MATCHES} SELECT term, commit_hash, authored_at, layer FROM matches WHERE term = 'license' ORDER BY authored_at, commit_hash, file_path LIMIT 8")
def trace_code(spark, sf_dir):
    rows = _matches(spark, sf_dir).filter("term = 'license'").withColumn("new_start", F.lit(1))
    return P.oldest_first(rows, 8).select("term", "commit_hash", "authored_at", "layer")


@query(f"WITH {FEEDERS} SELECT term, session_id, file_path, edited_at, delta FROM feeders")
def session_feeders(spark, sf_dir):
    return _feeders(spark, sf_dir, _resolved(spark, sf_dir)).select("term", "session_id", "file_path", "edited_at", "delta")


@query(
    f"WITH {MEASURED} SELECT count(*) AS n_terms, count(author_at) AS n_authored, count(*) FILTER (WHERE author_at IS NOT NULL AND prose_delta IS NOT NULL) AS n_prose, count(*) FILTER (WHERE author_at IS NOT NULL AND session_delta IS NOT NULL) AS n_session,"
    " count(*) FILTER (WHERE author_at >= 1000000) AS n_session_possible, count(*) FILTER (WHERE author_at IS NOT NULL AND (prose_delta IS NOT NULL OR session_delta IS NOT NULL)) AS n_either, count(*) FILTER (WHERE author_at IS NOT NULL AND prose_delta IS NULL AND session_delta IS NULL) AS n_neither FROM measured"
)
def thread_report(spark, sf_dir):
    return A.coverage(_measured(spark, sf_dir))


@query(
    f"WITH {RESOLVED}, d AS (SELECT abs(delta) AS s FROM resolved WHERE delta IS NOT NULL) SELECT count(*) FILTER (WHERE s < 3600) AS under_hour, count(*) FILTER (WHERE s >= 3600 AND s < 86400) AS under_day, count(*) FILTER (WHERE s >= 86400 AND s < 604800) AS under_week, count(*) FILTER (WHERE s >= 604800) AS week_or_more, count(*) AS n FROM d"
)
def delta_shape(spark, sf_dir):
    return A.delta_shapes(_resolved(spark, sf_dir), "delta")


@query(
    f"WITH {MEASURED}, k AS (SELECT *, row_number() OVER (ORDER BY df, term) - 1 AS k, count(*) OVER () AS n FROM measured) SELECT CAST(floor(k / ceil(n / 3.0)) AS BIGINT) AS tier, count(*) AS n, min(df) AS min_df, max(df) AS max_df, count(author_at) AS n_authored,"
    " count(*) FILTER (WHERE author_at IS NOT NULL AND (prose_delta IS NOT NULL OR session_delta IS NOT NULL)) AS n_with_feeder FROM k GROUP BY 1"
)
def idf_tiers(spark, sf_dir):
    return A.idf_tiers(_measured(spark, sf_dir))


@query(
    f"WITH {MEASURED}, a AS (SELECT CASE WHEN length(author_path) % 2 = 0 THEN 'rs' ELSE 'tsx' END AS author_lang, abs(greatest(prose_delta, session_delta)) AS s FROM measured WHERE author_at IS NOT NULL)"
    " SELECT author_lang, count(*) AS n_authored, count(s) AS n_with_feeder, list_sort(list(s) FILTER (WHERE s IS NOT NULL))[count(s) // 2 + 1] AS median_delta FROM a GROUP BY 1"
)
def lang_strata(spark, sf_dir):
    return A.language_strata(_measured(spark, sf_dir))


@query(f"WITH {RESOLVED} SELECT term, CASE WHEN delta < 0 THEN 'predating' ELSE 'descendant' END AS side, count(*) AS n FROM resolved WHERE relation = 'feeder' GROUP BY 1, 2")
def feeder_sides(spark, sf_dir):
    return P.ancestry(_resolved(spark, sf_dir)).groupBy("term", "side").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {RESOLVED_S} SELECT term, commit_hash, authored_at, relation, delta FROM resolved")
def resolve_author_feeders_sampled(spark, sf_dir):
    return _resolved(spark, sf_dir, sampled_terms(spark, sf_dir)).select("term", "commit_hash", "authored_at", "relation", "delta")


@query(f"WITH {FEEDERS_S} SELECT term, session_id, file_path, edited_at, delta FROM feeders")
def session_feeders_sampled(spark, sf_dir):
    terms = sampled_terms(spark, sf_dir)
    return _feeders(spark, sf_dir, _resolved(spark, sf_dir, terms), terms).select("term", "session_id", "file_path", "edited_at", "delta")


@query(ORACLES["thread_report"].replace(MEASURED, MEASURED_S).replace("author_at >= 1000000", "author_at >= (SELECT window_start FROM opened)"))
def thread_report_sampled(spark, sf_dir):
    return A.coverage(_measured_sample(spark, sf_dir))


@query(ORACLES["delta_shape"].replace(RESOLVED, RESOLVED_S))
def delta_shape_sampled(spark, sf_dir):
    return A.delta_shapes(_resolved(spark, sf_dir, sampled_terms(spark, sf_dir)), "delta")


@query(ORACLES["idf_tiers"].replace(MEASURED, MEASURED_S))
def idf_tiers_sampled(spark, sf_dir):
    return A.idf_tiers(_measured_sample(spark, sf_dir))


@query(ORACLES["lang_strata"].replace(MEASURED, MEASURED_S))
def lang_strata_sampled(spark, sf_dir):
    return A.language_strata(_measured_sample(spark, sf_dir))


@query(ORACLES["feeder_sides"].replace(RESOLVED, RESOLVED_S))
def feeder_sides_sampled(spark, sf_dir):
    return P.ancestry(_resolved(spark, sf_dir, sampled_terms(spark, sf_dir))).groupBy("term", "side").agg(F.count(F.lit(1)).alias("n"))
