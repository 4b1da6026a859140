"""Document fingerprints: a canonical exact digest, by built-in functions only.

Canonical form: NFKC, full case folding, NFKC again, runs of white space to one space, ends trimmed.
Fingerprint: two chained XXH64 values of it, 32 hex digits, which depend on the text alone. Texts are
grouped by (hash, canonical bytes): the aggregation compares the bytes of the texts that fall into one
hash bucket, so two texts share a class only if they are equal, whatever their fingerprints; partial
aggregation collapses a hot group before the shuffle.

Likeness of two exact digests is 1 if the digests and the canonical bytes are equal, else 0.

Neighbours in descending order of doc_id are found without one global sort: ids are cut into ranges
at quantiles, each range is ordered by itself, and the first row of each range (one row for each of a
bounded number of ranges) is handed to the range before it.

Edge cases: a null text counts as empty; a null doc_id comes last in the descending order; repeated
ids are ordered by the text; one document alone is its own next; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut

#: Ranges of ids are ordered on their own; only the first row of each is looked up across ranges.
ROWS_IN_RANGE, MOST_RANGES = 256, 65536
#: Hashes of 32 characters that are broadcast at most, about 10 MB.
BROADCAST_HASHES = 1 << 17


def canonical(text: Column) -> Column:
    nfkc = lambda s: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), s, F.lit(True))
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), r"[\s\u0085\p{Z}]+", " "))


def wide_hash(canon: Column) -> Column:
    """128 bits as 32 hex digits: XXH64, and XXH64 seeded with a first hash of a constant."""
    word = lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")
    return F.concat(word(F.xxhash64(canon)), word(F.xxhash64(F.lit("second half"), canon)))


def digest_classes(docs: DataFrame) -> DataFrame:
    """A row for each class of equal canonical texts in a hash bucket of two rows or more: hash, check, class_doc_id (smallest), n_class, collides.

    Texts are compared byte by byte within a bucket. ``check`` is the canonical text's SHA-256, by
    which a document finds its class; ``collides`` says that the bucket holds several different texts.
    """
    rows = docs.select("doc_id", canonical(F.col("text")).alias("canon")).select("doc_id", "canon", wide_hash(F.col("canon")).alias("hash"))
    groups = _in_shared_buckets(rows).groupBy("hash", "canon").agg(F.min("doc_id").alias("class_doc_id"), F.count(F.lit(1)).alias("n_class"))
    checked = groups.select("hash", F.sha2("canon", 256).alias("check"), "class_doc_id", "n_class")
    return checked.withColumn("collides", F.count(F.lit(1)).over(W.partitionBy("hash")) > 1)


def _in_shared_buckets(rows: DataFrame) -> DataFrame:
    """The rows whose hash another row has, so that few texts move; all rows where those hashes are too many to broadcast."""
    shared = cut(rows.groupBy("hash").count().filter("count > 1").select("hash"))
    return rows.join(F.broadcast(shared), "hash", "left_semi") if shared.count() <= BROADCAST_HASHES else rows


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, class_doc_id, n_class for every row of docs."""
    rows = docs.select("doc_id", canonical(F.col("text")).alias("__canon"))
    rows = rows.select("doc_id", wide_hash(F.col("__canon")).alias("hash"), F.sha2("__canon", 256).alias("check"))
    shared = digest_classes(docs).filter("n_class > 1 or collides")
    found = rows.alias("r").join(shared.alias("c"), (F.col("r.hash") == F.col("c.hash")) & (F.col("r.check") == F.col("c.check")), "left")
    return found.select("r.doc_id", F.col("r.hash").alias("fingerprint"), F.coalesce("c.class_doc_id", "r.doc_id").alias("class_doc_id"), F.coalesce("c.n_class", F.lit(1)).alias("n_class"))


def range_of(ids: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts are at or below the id, looked up in two steps."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts)) + 1
    numbers = lambda some: F.split(F.lit(",".join(map(repr, some))), ",").cast("array<double>")
    at = ids.cast("double")
    coarse = F.size(F.filter(numbers(cuts[::width]), lambda e: e <= at))
    begin = F.greatest(coarse - 1, F.lit(0)) * width
    return F.coalesce(begin + F.size(F.filter(F.slice(numbers(cuts), begin + 1, width), lambda e: e <= at)), F.lit(0)).cast("int")


def with_next(rows: DataFrame, carried: list[str]) -> DataFrame:
    """rows (doc_id and the carried columns) with next_<column> of the row that follows in descending order of doc_id, the first after the last."""
    n = rows.agg(F.count(F.lit(1))).first()[0]
    ranges = max(2, min(MOST_RANGES, n // ROWS_IN_RANGE))
    cuts = rows.agg(F.percentile_approx(F.col("doc_id").cast("double"), [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    rows = rows.select("doc_id", *carried, range_of(F.col("doc_id"), sorted(set(cuts))).alias("range"))
    order = W.partitionBy("range").orderBy(F.col("doc_id").desc_nulls_last(), *carried)
    heads = rows.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), (-F.col("doc_id")).alias("down"), *carried)).alias("head"))
    around = W.orderBy(F.col("range").desc())  # a row for each range, MOST_RANGES at most
    first = F.first("head").over(around.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    follows = heads.select("range", F.coalesce(F.lead("head").over(around), first).alias("after"))
    inside = rows.select("*", F.lead(F.struct(*carried)).over(order).alias("within"))
    joined = inside.join(follows, "range")
    return joined.select("doc_id", *carried, *(F.coalesce(F.col("within")[c], F.col("after")[c]).alias(f"next_{c}") for c in carried))


def edited(text: Column, following: Column) -> Column:
    """text with its last third of code points replaced by as many of the following text's first."""
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(following, F.lit(1), third))


def compare(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, class_doc_id, n_class of every row."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    canon = rows.select("doc_id", "text", canonical(F.col("text")).alias("canon"))
    hashed = canon.select("doc_id", "text", wide_hash(F.col("canon")).alias("hash"), F.sha2("canon", 256).alias("check"))
    paired = with_next(hashed, ["text", "hash", "check"]).select("*", edited(F.col("text"), F.col("next_text")).alias("edited"))
    paired = paired.select("*", wide_hash(canonical(F.col("edited"))).alias("edited_hash"))
    same = lambda h, c: F.when(F.col("hash") == F.col(h), (canonical(F.col("text")) == canonical(F.col(c))).cast("double")).otherwise(F.lit(0.0))
    judged = paired.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "hash", "check", "edited_hash", same("edited_hash", "edited").alias("near_edited"), same("next_hash", "next_text").alias("near_next"),
    )
    shared = digest_classes(docs).filter("n_class > 1 or collides").select("hash", "check", "class_doc_id", "n_class")
    return judged.join(shared, ["hash", "check"], "left").select(
        "doc_id", "n_chars", "edited_sha256", F.col("hash").alias("fingerprint"), F.col("edited_hash").alias("edited_fingerprint"),
        "near_edited", "near_next", F.coalesce("class_doc_id", "doc_id").alias("class_doc_id"), F.coalesce("n_class", F.lit(1)).alias("n_class"),
    )
