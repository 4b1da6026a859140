"""Ledger, latency and health analytics over event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import count_bucket, delta_shape
from ..functions.text import parent_dir
from .scan import carried

DAYS = (1, 7, 30)
#: First letters by which terms of equal df are counted apart.
START = 3


def ledger_windows(events: DataFrame, at: str, tool: str, sums: dict[str, Column], now: int, days: tuple[int, ...] = DAYS) -> DataFrame:
    """window_days, tool (null: all tools), n_events and the sums for each trailing window, in one scan and one shuffle."""
    inside = F.filter(F.array(*(F.when(F.col(at) >= now - d * 86400, F.lit(d)) for d in days)), lambda d: d.isNotNull())
    each = events.select(F.explode(inside).alias("window_days"), F.col(tool).alias("tool"), *(c.alias(n) for n, c in sums.items()))
    rolled = each.rollup("window_days", "tool").agg(F.count(F.lit(1)).alias("n_events"), *(F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in sums))
    return rolled.filter("window_days IS NOT NULL")


def order_statistics(rows: DataFrame, key: str, value: str, ranks: dict[str, Column]) -> DataFrame:
    """key, n and, for each named rank (from 0, an expression of n), the value there.

    Values are counted before the shuffle and summed along each key's distinct values, so that no key's
    values are gathered.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    ordered = W.partitionBy(key).orderBy("__v")
    along = counts.withColumn("__upto", F.sum("__c").over(ordered)).withColumn("n", F.sum("__c").over(W.partitionBy(key)))
    return along.groupBy(key).agg(F.max("n").alias("n"), *(F.min(F.when(F.col("__upto") > rank, F.col("__v"))).alias(name) for name, rank in ranks.items()))


def nearest_rank(q: float) -> Column:
    return F.round((F.col("n") - 1) * F.lit(q)).cast("long")


def latencies(rows: DataFrame, now: int, window: int = 3600) -> DataFrame:
    """op_name, n, p50, p95 of the calls without an error in the trailing window; rows: op_name, started_at, duration_ms, error."""
    recent = rows.filter((F.col("started_at") >= now - window) & F.col("error").isNull() & F.col("op_name").isNotNull())
    return order_statistics(recent, "op_name", "duration_ms", {"p50": nearest_rank(0.5), "p95": nearest_rank(0.95)})


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, median: the upper one."""
    return order_statistics(rows, key, value, {"median": F.floor(F.col("n") / 2)})


def latest(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    return rows.groupBy(key).agg(*(F.max_by(c, order).alias(c) for c in columns))


def run_deltas(rows: DataFrame) -> DataFrame:
    """id, op_name, started_at, duration_ms, prior_ms, delta_ms, delta_percent against the successful run before; rows: id, op_name, started_at, duration_ms, error.

    There are few operations, each with all of history: their runs are scanned in ranges.
    """
    prior = carried(rows, ["op_name"], "id", F.when(F.col("error").isNull(), F.col("duration_ms")), "prior_ms", own=False)
    delta = F.col("duration_ms") - F.col("prior_ms")
    percent = F.when(F.col("prior_ms") == 0, F.lit(0.0)).otherwise(delta * 100.0 / F.col("prior_ms"))
    return prior.select("id", "op_name", "started_at", "duration_ms", "prior_ms", delta.alias("delta_ms"), percent.alias("delta_percent"))


def adoption(activity: DataFrame) -> DataFrame:
    """sessions, sessions_with_own, own_calls, retrieval_calls, share (percent, one decimal; null without sessions); activity: retrieval_calls, own_calls."""
    own = (F.col("own_calls") > 0).cast("long")
    counted = activity.agg(F.count(F.lit(1)).alias("sessions"), F.coalesce(F.sum(own), F.lit(0)).alias("sessions_with_own"), F.coalesce(F.sum("own_calls"), F.lit(0)).alias("own_calls"), F.coalesce(F.sum("retrieval_calls"), F.lit(0)).alias("retrieval_calls"))
    return counted.withColumn("share", F.when(F.col("sessions") > 0, F.round(F.col("sessions_with_own") * 1000.0 / F.col("sessions")) / 10))


def corpus_probe(corpora: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """corpus, n_rows, newest for each corpus by name: (rows, its clock column in seconds)."""
    found = None
    for name, (rows, clock) in corpora.items():
        one = rows.agg(F.count(F.lit(1)).alias("n_rows"), (F.max(clock).cast("long") if clock else F.lit(None).cast("long")).alias("newest")).select(F.lit(name).alias("corpus"), "n_rows", "newest")
        found = one if found is None else found.unionByName(one)
    return found


def orphans(children: dict[str, DataFrame], live: DataFrame, key: str) -> DataFrame:
    """child, n_orphans: rows whose key isn't among the live ones."""
    alive, found = live.select(key).distinct(), None
    for name, rows in children.items():
        one = rows.join(alive, key, "left_anti").agg(F.count(F.lit(1)).alias("n_orphans")).select(F.lit(name).alias("child"), "n_orphans")
        found = one if found is None else found.unionByName(one)
    return found


def locations(hits: DataFrame, most: int = 5) -> DataFrame:
    """folder, n_hits of the folders with most hits; hits: path."""
    return hits.select(parent_dir(F.col("path")).alias("folder")).groupBy("folder").agg(F.count(F.lit(1)).alias("n_hits")).orderBy(F.desc("n_hits"), "folder").limit(most)


def outcome_stats(log: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """outcome ("other" for unknown ones), n, n_scoped, total_hits, first_ts, last_ts; log: ts, outcome, scoped, hits."""
    outcome = F.when(F.col("outcome").isin(*known), F.col("outcome")).otherwise("other")
    return log.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("scoped", F.lit(False))).alias("n_scoped"), F.coalesce(F.sum("hits"), F.lit(0)).alias("total_hits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def delta_shapes(rows: DataFrame, delta: str) -> DataFrame:
    """under_hour, under_day, under_week, week_or_more, n of the absolute differences; ``medians`` has their median."""
    shape = delta_shape(F.col(delta))
    known = F.col(delta).isNotNull()
    return rows.agg(*(F.count_if(known & (shape == s)).alias(s) for s in ("under_hour", "under_day", "under_week", "week_or_more")), F.count(delta).alias("n"))


def coverage(terms: DataFrame) -> DataFrame:
    """Counts of terms by what precedes their author; terms: has_author, prose_delta, session_delta, session_possible."""
    prose, session = F.col("prose_delta").isNotNull(), F.col("session_delta").isNotNull()
    author = F.col("has_author")
    return terms.agg(
        F.count(F.lit(1)).alias("n_terms"), F.count_if(author).alias("n_authored"), F.count_if(author & prose).alias("n_prose"), F.count_if(author & session).alias("n_session"),
        F.count_if(author & F.col("session_possible")).alias("n_session_possible"), F.count_if(author & (prose | session)).alias("n_either"), F.count_if(author & ~prose & ~session).alias("n_neither"),
    )


def idf_tiers(terms: DataFrame) -> DataFrame:
    """tier (0 to 2), n, min_df, max_df, n_authored, n_with_feeder: thirds of ceil(n / 3) terms by df; terms: a sample."""
    rows = terms.withColumn("__n", F.count(F.lit(1)).over(W.partitionBy())).withColumn("__k", F.row_number().over(W.orderBy("df", "term")) - 1)
    tier = F.floor(F.col("__k") / F.ceil(F.col("__n") / 3)).cast("long")
    feeder = F.col("has_author") & (F.col("prose_delta").isNotNull() | F.col("session_delta").isNotNull())
    return rows.groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.min("df").alias("min_df"), F.max("df").alias("max_df"), F.count_if("has_author").alias("n_authored"), F.count_if(feeder).alias("n_with_feeder"))


def language_strata(terms: DataFrame) -> DataFrame:
    """author_lang, n_authored, n_with_feeder, median_delta (upper, of the tightest absolute differences)."""
    authored = terms.filter("has_author").withColumn("tightest", F.abs(F.greatest("prose_delta", "session_delta")))
    counts = authored.groupBy("author_lang").agg(F.count(F.lit(1)).alias("n_authored"), F.count("tightest").alias("n_with_feeder"))
    return counts.join(medians(authored, "author_lang", "tightest").select("author_lang", F.col("median").alias("median_delta")), "author_lang", "left")


def stride_sample(vocabulary: DataFrame, most: int) -> DataFrame:
    """term, df of ``most`` terms evenly spread over the order of falling df; all where there are fewer.

    Ranks come from counts of each df and of its terms' first letters, so the vocabulary isn't sorted as a
    whole and the many terms of a low df aren't numbered in one task: only the terms that share a df and
    first letters with a wanted rank are numbered, among themselves.
    """
    words = vocabulary.select("term", "df")
    n = words.count()
    if n <= most:
        return words
    words = words.withColumn("start", F.substring("term", 1, START))
    sizes = words.groupBy("df", "start").agg(F.count(F.lit(1)).alias("c"))
    so_far = lambda over: F.coalesce(F.sum("c").over(over.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    above = sizes.groupBy("df").agg(F.sum("c").alias("c")).select("df", so_far(W.orderBy(F.desc("df"))).alias("above"))  # distinct frequencies
    ranges = sizes.withColumn("first", so_far(W.partitionBy("df").orderBy("start"))).join(above, "df").withColumn("first", F.col("first") + F.col("above"))
    slot = lambda rank: F.ceil(rank * most / n).cast("long")  # the first one at or after a rank
    wanted = lambda rank: F.floor(slot(rank) * n / most)
    first, rank = F.col("first"), F.col("rank")
    holding = ranges.filter((slot(first) < most) & (wanted(first) < first + F.col("c"))).select("df", "start", "first")
    near = words.join(F.broadcast(holding), ["df", "start"])  # a range holds one wanted rank at least, so there are ``most`` ranges at most
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy("df", "start").orderBy("term")) - 1 + first)
    return ranked.filter((slot(rank) < most) & (wanted(rank) == rank)).select("term", "df")


def scrubbed(calls: DataFrame, tools: tuple[str, ...], outcomes: tuple[str, ...], now: int, days: int) -> DataFrame:
    """Calls as they may leave the machine: named columns only, counts in buckets, unknown names clamped.

    calls: ts (epoch seconds or null), tool, query_len, wall_ms, returned, outcome. Rows whose time can't
    be read are kept and marked.
    """
    recent = calls.filter(F.col("ts").isNull() | (F.col("ts") >= now - days * 86400))
    clamp = lambda c, allowed: F.when(F.col(c).isin(*allowed), F.col(c)).otherwise("other").alias(c)
    return recent.select(F.date_trunc("day", F.timestamp_seconds("ts")).cast("date").alias("day"), F.col("ts").isNull().alias("ts_unparseable"), clamp("tool", tools), count_bucket(F.col("query_len")).alias("query_len"), count_bucket(F.col("wall_ms")).alias("wall_ms"), count_bucket(F.col("returned")).alias("returned"), clamp("outcome", outcomes))


def rescored(calls: DataFrame, model: DataFrame, factor: float, overhead: int, empty_knob: int, rate: float) -> DataFrame:
    """Archived calls under the present model: tool, status (scored, error, not_in_model), old_saved, new_saved, delta, new_dollars.

    calls: id, tool, result_tokens, returned, tokens_saved, is_error; model: tool, p50, p95.
    """
    from ..functions.numbers import dollars, savings

    joined = calls.join(F.broadcast(model), "tool", "left")  # a row for each tool of the product
    _, _, saved = savings(F.col("result_tokens"), F.col("returned"), F.col("p50"), F.col("p95"), factor, overhead, empty_knob)
    status = F.when(F.col("is_error"), "error").when(F.col("p50").isNull(), "not_in_model").otherwise("scored")
    rows = joined.withColumn("status", status).withColumn("new_saved", F.when(F.col("status") == "scored", saved))
    return rows.select("id", "tool", "status", F.col("tokens_saved").alias("old_saved"), "new_saved", (F.col("new_saved") - F.col("tokens_saved")).alias("delta"), dollars(F.col("new_saved"), F.lit(rate)).alias("new_dollars"))
