"""Idempotent merges of tables: each returns the new state as a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import under


def upsert(old: DataFrame, new: DataFrame, keys: list[str], kept: tuple[str, ...] = ()) -> DataFrame:
    """new's rows over old's by key; an existing key keeps its values of the ``kept`` columns."""
    was = old.select(*keys, *(F.col(c).alias(f"__was_{c}") for c in kept), F.lit(True).alias("__known")) if kept else None
    fresh = new.select(*old.columns)
    if kept:
        joined = fresh.join(was, keys, "left")
        fresh = joined.select(*(F.when(F.col("__known"), F.col(f"__was_{c}")).otherwise(F.col(c)).alias(c) if c in kept else F.col(c) for c in old.columns))
    return old.join(new.select(*keys), keys, "left_anti").unionByName(fresh)


def last_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key: the last in the order."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, *(c for c in rest if c not in order))).alias("__r"))
    return best.select(*(F.col(c) if c in keys else F.col(f"__r.{c}") for c in rows.columns))


def sweep(old: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """old without the keys that were not seen; all of old where nothing was seen at all."""
    some = seen.limit(1).agg((F.count(F.lit(1)) > 0).alias("__any"))
    marked = old.join(seen.select(*keys).distinct().withColumn("__seen", F.lit(True)), keys, "left").join(F.broadcast(some))  # one row
    return marked.filter(F.coalesce("__seen", ~F.col("__any"))).drop("__seen", "__any")


def replace_by(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of each key that new has are replaced by new's."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """old with those of new's keys that it lacks, the first of each by the order."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min(F.struct(*order, *(c for c in rest if c not in order))).alias("__r")).select(*(F.col(c) if c in keys else F.col(f"__r.{c}") for c in new.columns))
    return old.unionByName(first.select(*old.columns).join(old.select(*keys), keys, "left_anti"))


def late_binding(old: DataFrame, found: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Fills nulls of a column from rows found later; what is bound stays."""
    later = found.groupBy(*keys).agg(F.min(column).alias("__found"))
    return old.join(later, keys, "left").select(*(F.coalesce(c, F.col("__found")).alias(c) if c == column else F.col(c) for c in old.columns))


def merge_activity(old: DataFrame, new: DataFrame) -> DataFrame:
    """session_id, first_seen (the least), retrieval_calls and own_calls (the most)."""
    return old.unionByName(new).groupBy("session_id").agg(F.min("first_seen").alias("first_seen"), F.max("retrieval_calls").alias("retrieval_calls"), F.max("own_calls").alias("own_calls"))


def by_content(stored: DataFrame, live: DataFrame, path: str = "path", digest: str = "content_hash") -> DataFrame:
    """path, status: new, unchanged, changed or gone, by comparing content hashes."""
    a, b = stored.select(path, F.col(digest).alias("__old")), live.select(path, F.col(digest).alias("__new"))
    status = F.when(F.col("__old").isNull(), "new").when(F.col("__new").isNull(), "gone").when(F.col("__old") == F.col("__new"), "unchanged").otherwise("changed")
    return a.join(b, path, "full").select(path, status.alias("status"))


def prune(stored: DataFrame, tracked: DataFrame, repo: str, nested: list[str], path: str = "path") -> DataFrame:
    """stored without the repository's paths that aren't tracked; paths below a nested repository stay."""
    inside = under(F.col(path), F.lit(repo))
    for other in nested:
        inside = inside & ~under(F.col(path), F.lit(other))
    known = tracked.select(F.col(path), F.lit(True).alias("__tracked")).distinct()
    return stored.join(known, path, "left").filter(~inside | F.col("__tracked").isNotNull()).drop("__tracked")


def upsert_indexed(old: DataFrame, new: DataFrame, keys: list[str], index: DataFrame, corpus: str, body: Column, ref: str) -> tuple[DataFrame, DataFrame]:
    """(the upserted table, the text index with a row for each of its new rows in place of the old ones); index: source_table, ref, body."""
    fresh = new.select(F.lit(corpus).alias("source_table"), F.col(ref).alias("ref"), body.alias("body"))
    gone = old.join(new.select(*keys), keys, "left_semi").select(F.lit(corpus).alias("source_table"), F.col(ref).alias("ref")).unionByName(fresh.select("source_table", "ref")).distinct()
    return upsert(old, new, keys), index.join(gone, ["source_table", "ref"], "left_anti").unionByName(fresh)


def patched(stored: DataFrame, live: DataFrame, path: str = "path") -> DataFrame:
    """stored (path, content_hash, mtime, last_commit_id, ...) with live's mtime and commit where the content is the same; other rows stay."""
    now = live.select(path, F.col("content_hash").alias("__h"), F.col("mtime").alias("__m"), F.col("last_commit_id").alias("__c"))
    same = F.coalesce(F.col("content_hash") == F.col("__h"), F.lit(False))
    fix = {"mtime": F.when(same, F.col("__m")).otherwise(F.col("mtime")), "last_commit_id": F.when(same, F.coalesce("__c", "last_commit_id")).otherwise(F.col("last_commit_id"))}
    return stored.join(now, path, "left").select(*(fix[c].alias(c) if c in fix else F.col(c) for c in stored.columns))


def rebuilt(old: DataFrame, batches: list[DataFrame], key: str = "session_id") -> DataFrame:
    """old with the sessions of one pass rebuilt: their old rows go once, however many of the pass's batches have them."""
    kept, found = old, None
    for batch in batches:
        kept = kept.join(batch.select(key).distinct(), key, "left_anti")
        found = batch.select(*old.columns) if found is None else found.unionByName(batch.select(*old.columns))
    return kept if found is None else kept.unionByName(found)


def backfilled_repos(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """chunks (document_id, path, repo_path) whose missing repo_path is what their document's path has before their own.

    Only where the document's path ends in a slash and the chunk's path; others stay unknown. One join in
    place of a correlated subquery and its existence test.
    """
    ends = F.col("__doc").endswith(F.concat(F.lit("/"), F.col("path")))
    before = F.expr("substring(__doc, 1, length(__doc) - length(path) - 1)")
    rows = chunks.join(documents.select(F.col("id").alias("document_id"), F.col("path").alias("__doc")), "document_id", "left")
    return rows.select(*(F.coalesce("repo_path", F.when(ends, before)).alias(c) if c == "repo_path" else F.col(c) for c in chunks.columns))


def delete_with_children(document: Column, parents: DataFrame, children: dict[str, DataFrame], index: DataFrame | None = None) -> tuple[DataFrame, dict[str, DataFrame], DataFrame | None]:
    """Parents without those of the condition, children (document_id, id) without theirs, and the text index (source_table, ref) without theirs."""
    dead = parents.filter(document).select(F.col("id").alias("document_id"))
    left = {n: c.join(dead, "document_id", "left_anti") for n, c in children.items()}
    if index is not None:
        for name, rows in children.items():
            swept = rows.join(dead, "document_id", "left_semi").select(F.lit(name).alias("source_table"), F.col("id").alias("ref"))
            index = index.join(swept, ["source_table", "ref"], "left_anti")
    return parents.filter(F.coalesce(~document, F.lit(True))), left, index


def backfill_report(existing: DataFrame, scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the ledger with the scanned rows that it lacks by ts and tool, a row of counts that add up to the scanned rows).

    scanned: the ledger's columns and ``parse_error``; a row without tokens has no second layer.
    """
    state = F.when(F.col("parse_error"), "parse_errors").when(F.col("result_tokens").isNull(), "skipped_no_layer2")
    keyed = scanned.withColumn("__state", state).join(existing.select("ts", "tool", F.lit(True).alias("__have")).distinct(), ["ts", "tool"], "left")
    keyed = keyed.withColumn("__state", F.coalesce("__state", F.when(F.col("__have"), "skipped_existing")))
    fresh = keyed.filter("__state IS NULL").select(*existing.columns)
    first = last_by(fresh, ["ts", "tool"], [c for c in existing.columns if c not in ("ts", "tool")])
    n_first = first.agg(F.count(F.lit(1)).alias("inserted"))
    counts = keyed.agg(F.count(F.lit(1)).alias("scanned"), *(F.count_if(F.col("__state") == s).alias(s) for s in ("skipped_existing", "skipped_no_layer2", "parse_errors")))
    report = counts.join(F.broadcast(n_first)).withColumn("skipped_existing", F.expr("scanned - inserted - skipped_no_layer2 - parse_errors"))
    return existing.unionByName(first), report
