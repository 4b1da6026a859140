"""Fill-in-middle transformation by relational units.

A text is cut into units, the matches of a pattern (lines unless another is given). Units are rows:
their lengths are exploded with their ordinals, and a window sums them up over each document. A
document's cut request names the two ordinals after which its prefix and its middle end; it's joined
with its units, the sums found are gathered to two offsets, and the text is cut there.

Only lengths are exploded; a text itself moves once, to its offsets. Requests and units of a document
meet in one partition, dealt once by the document's key (its id and two hashes of its text), and rows
that repeat id and text share one key, one request and one set of units. The offsets are written
before the texts are joined, so that the many rows of a repeated key can be split.

Edge cases: a null text is an empty one; an empty text, a text that contains one of the marks, and one
that the rate leaves out are plain, which is the text itself; a null id is drawn as an id without
digits; characters that no unit covers belong to the suffix; a text that is one unit of any length is
cut at its ends; repeated rows give equal rows; an empty table gives an empty result; other columns,
whatever they are called, are kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, one_of

LINES = r"[^\n]*\n|[^\n]+"


@dataclass(frozen=True)
class Format:
    """Marks of prefix, suffix and middle, none of which begins within another; draws of 100 below ``rate`` are cut, below ``spm`` suffix first."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    rate: int = 100
    spm: int = 50
    seed: int = 7
    units: str = LINES


PRODUCTION = Format()


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def _has_mark(text: Column, how: Format) -> Column:
    return text.contains(how.prefix) | text.contains(how.suffix) | text.contains(how.middle)


def offsets(keyed: DataFrame, how: Format) -> DataFrame:
    """key, n, first, second: units of each text and the characters before the ends of its prefix and middle; keyed: key (doc_id, h1, h2), text."""
    sizes = F.transform(F.regexp_extract_all("text", F.lit(how.units), F.lit(0)), F.length)
    each = keyed.select("key", F.when(F.col("text") == "", F.array().cast("array<int>")).otherwise(sizes).alias("sizes")).dropDuplicates(["key"])
    h1, h2, _, _ = draws(F.col("key.doc_id"), how.seed)
    n = F.size("sizes")
    low, high = F.least(h1 % (n + 1), h2 % (n + 1)), F.greatest(h1 % (n + 1), h2 % (n + 1))
    requests = each.select("key", n.cast("long").alias("n"), F.array(low, high).alias("ordinals"))
    units = each.select("key", F.posexplode("sizes").alias("at", "size"))
    so_far = F.sum("size").over(W.partitionBy("key").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    ends = units.select("key", (F.col("at") + 1).cast("long").alias("ordinal"), so_far.alias("end"))
    met = requests.join(ends, (requests["key"] == ends["key"]) & F.array_contains("ordinals", F.col("ordinal")), "left").select(requests["key"], "n", "ordinals", "ordinal", "end")
    where = lambda k: F.coalesce(F.max(F.when(F.col("ordinal") == F.col("ordinals")[k], F.col("end"))), F.lit(0)).cast("long")
    return met.groupBy("key").agg(F.max("n").alias("n"), where(0).alias("first"), where(1).alias("second"))


def fill_in_middle(docs: DataFrame, how: Format = PRODUCTION) -> DataFrame:
    """docs' columns and ``n`` (units), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` (null if plain), ``output``.

    A name that docs has already gets an underscore more.
    """
    names = [one_of(c, docs.columns) for c in ("n", "form", "prefix_chars", "middle_chars", "output")]
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # names may hold what a reference can't
    at = {c.lower(): f"c{k}" for k, c in enumerate(docs.columns)}
    text = F.coalesce(F.col(at["text"]), F.lit(""))
    key = F.struct(F.col(at["doc_id"]).alias("doc_id"), F.xxhash64(text).alias("h1"), F.crc32(text.cast("binary")).alias("h2"))
    found = cut(offsets(plain.select(key.alias("key"), text.alias("text")), how))
    found = found.select(F.col("key.doc_id").alias("k0"), F.col("key.h1").alias("k1"), F.col("key.h2").alias("k2"), "n", "first", "second")
    keyed = plain.withColumns({"h1": F.xxhash64(text), "h2": F.crc32(text.cast("binary"))})
    joined = keyed.join(found.hint("shuffle_hash"), keyed[at["doc_id"]].eqNullSafe(F.col("k0")) & (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    _, _, h3, h4 = draws(F.col(at["doc_id"]), how.seed)
    form = F.when((text == "") | _has_mark(text, how) | (h3 % 100 >= how.rate), "plain").when(h4 % 100 < how.spm, "spm").otherwise("psm")
    cuts = joined.withColumn("form", form)
    cutting = F.col("form") != "plain"
    first, second = F.col("first").cast("int"), F.col("second").cast("int")
    head, middle, tail = F.substring(text, F.lit(1), first), F.substring(text, first + 1, second - first), F.substring(text, second + 1, F.length(text))
    p, s, m = F.lit(how.prefix), F.lit(how.suffix), F.lit(how.middle)
    output = F.when(F.col("form") == "psm", F.concat(p, head, s, tail, m, middle)).when(F.col("form") == "spm", F.concat(s, tail, p, head, m, middle)).otherwise(text)
    return cuts.select(
        *(F.col(at[c.lower()]).alias(c) for c in docs.columns),
        F.col("n").alias(names[0]), F.col("form").alias(names[1]), F.when(cutting, F.col("first")).alias(names[2]), F.when(cutting, F.col("second") - F.col("first")).alias(names[3]), output.alias(names[4]),
    )


def restored(output: Column, form: Column, how: Format = PRODUCTION) -> Column:
    """The text that an output was made of: no text that was cut contains a mark, so each mark is found once."""
    mark = "|".join(f"\\Q{x}\\E" for x in (how.prefix, how.suffix, how.middle))
    parts = F.split(output, mark)  # nothing, then the two outer parts, then the middle
    return F.when(form == "psm", F.concat(parts[1], parts[3], parts[2])).when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)


def report(docs: DataFrame, how: Format = PRODUCTION) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and digests of the output and of the text restored from it."""
    made = fill_in_middle(docs.select("doc_id", "text"), how)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"), how)).alias("restored_sha256"))
