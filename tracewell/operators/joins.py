"""Provenance joins: as-of binding, longest prefix, domain routing, containment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import path_prefixes, under

#: Ranges of time into which an as-of join cuts each key.
PARTS = 64


def capturing(edits: DataFrame, commits: DataFrame, keys: list[str]) -> DataFrame:
    """edits with commit_id and committed_at of the oldest commit of the same keys at or after edited_at; nulls for none.

    A forward as-of join without a range join: edits and commits are merged in one ordered pass of each
    key, newest first, which carries along the commit seen last. One shuffle of both on the keys and on
    PARTS ranges of time; a range passes on no more than its first commit to the ranges before it, so a
    key with most of the rows is many tasks' work.
    """
    none = lambda kind: F.lit(None).cast(kind)
    commit = commits.select(*keys, F.col("committed_at").alias("__at"), F.struct("committed_at", "commit_id").alias("__commit"), *(none(edits.schema[c].dataType).alias(c) for c in edits.columns if c not in keys), F.lit(1).alias("__kind"))
    edit = edits.select(*keys, F.col("edited_at").alias("__at"), none(commit.schema["__commit"].dataType).alias("__commit"), *(c for c in edits.columns if c not in keys), F.lit(0).alias("__kind"))
    span = commits.agg(F.min("committed_at").alias("low"), F.max("committed_at").alias("high")).first()
    low, width = span["low"] or 0, max(1, ((span["high"] or 0) - (span["low"] or 0)) // PARTS + 1)
    part = F.greatest(F.lit(0), F.least(F.lit(PARTS), F.floor((F.col("__at") - low) / width))).cast("int")
    merged = edit.unionByName(commit).withColumn("__part", part)
    firsts = commit.withColumn("__part", part).groupBy(*keys, "__part").agg(F.min("__commit").alias("__first"))
    later = W.partitionBy(*keys).orderBy(F.desc("__part"))  # PARTS + 1 rows of a key
    ahead = firsts.select(*keys, F.col("__part").alias("__from"), "__first", F.coalesce(F.lead("__part").over(later), F.lit(-1)).alias("__to"))
    before = F.when(F.col("__from") > 0, F.sequence(F.col("__from") - 1, F.greatest("__to", F.lit(0)), F.lit(-1)))
    ahead = ahead.select(*keys, "__first", F.explode(before).alias("__part"))
    newest = W.partitionBy(*keys, "__part").orderBy(F.desc("__at"), F.desc("__kind"), F.desc("__commit")).rowsBetween(W.unboundedPreceding, 0)
    inside = merged.withColumn("__next", F.last("__commit", ignorenulls=True).over(newest)).filter("__kind = 0")
    found = inside.join(ahead, [*keys, "__part"], "left").withColumn("__next", F.coalesce("__next", "__first"))
    return found.select(*edits.columns, F.col("__next.commit_id").alias("commit_id"), F.col("__next.committed_at").alias("committed_at"))


def owner(paths: DataFrame, roots: DataFrame, path: str = "path", root: str = "root") -> DataFrame:
    """paths with the innermost root that contains each one, null for none: an equi-join on the path's own prefixes."""
    each = paths.select(F.col(path).alias("__p")).distinct().select("__p", F.explode(path_prefixes(F.col("__p"))).alias("__prefix"))
    best = each.join(roots.select(F.rtrim(F.col(root), F.lit("/")).alias("__prefix"), F.col(root).alias("__root")).distinct(), "__prefix").groupBy("__p").agg(F.max_by("__root", F.length("__prefix")).alias(root))
    return paths.join(best, paths[path] == best["__p"], "left").drop("__p")


def visible(paths: DataFrame, labels: DataFrame, domain: str, path: str = "path") -> DataFrame:
    """paths with ``admitted``: the deepest label entries that contain a path all stand and one of them is the domain's.

    labels: entry, owner (null: withdrawn). What no entry contains isn't admitted.
    """
    each = paths.select(F.col(path).alias("__p")).distinct().select("__p", F.posexplode(path_prefixes(F.col("__p"))).alias("__depth", "entry"))
    hits = each.join(labels, "entry").withColumn("__deepest", F.max("__depth").over(W.partitionBy("__p"))).filter("__depth = __deepest")
    said = hits.groupBy("__p").agg((F.bool_or(F.col("owner").eqNullSafe(domain)) & ~F.bool_or(F.col("owner").isNull())).alias("__ok"))
    return paths.join(said, paths[path] == said["__p"], "left").withColumn("admitted", F.coalesce("__ok", F.lit(False))).drop("__p", "__ok")


def related(a: Column, b: Column) -> Column:
    """Whether one of two folders contains the other."""
    return under(a, b) | under(b, a)


def ratchet(rows: DataFrame, partition: list[str], group: str, order: list[str], tainted: str, to: str = "withheld") -> DataFrame:
    """Marks every row of a group with a tainted one, and all that follow it in the partition.

    Groups are runs of one value of ``group``; a run is judged as a whole.
    """
    w = W.partitionBy(*partition).orderBy(*order)
    change = F.coalesce(~F.col(group).eqNullSafe(F.lag(group).over(w)), F.lit(True)) & (F.row_number().over(w) > 1)
    runs = rows.withColumn("__run", F.sum(change.cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    by_run = W.partitionBy(*partition).orderBy("__run").rangeBetween(W.unboundedPreceding, 0)
    return runs.withColumn(to, F.max(F.coalesce(F.col(tainted), F.lit(True))).over(by_run)).drop("__run")


def latest_per(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row for each key: the first in the order."""
    return rows.withColumn("__rn", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("__rn = 1").drop("__rn")


def since(rows: DataFrame, at: str, now: int, days: int) -> DataFrame:
    """Rows of the last days (one at least) before now, in epoch seconds."""
    return rows.filter(F.col(at) >= now - max(1, days) * 86400)
