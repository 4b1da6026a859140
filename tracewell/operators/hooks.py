"""Search commands of a shell: what they look for, where, and what the index may answer them with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import is_indexable, parent_dir
from .analytics import order_statistics

MOST_HITS, TOP_FOLDERS, FIRST_LINES = 25, 5, 6
#: Programs that search, their flags that take a value beside those that carry the pattern, and outcomes that delivered.
SEARCH_TOOLS = ("grep", "rg", "ripgrep", "ack", "ag")
VALUED_FLAGS = ("-f", "-m", "-A", "-B", "-C", "-t", "-g", "--include", "--exclude", "--exclude-dir", "--max-count", "--type")
DELIVERED = ("served", "schema_served")
SEPARATORS = (";", "&&", "||")

#: A command's parts: separators and pipes; or a word, of plain characters (one "&" among them) and quoted stretches, of which the last may lack its end.
PARTS = r"""&&|\|\||;;|;|\||(?:[^\s"';|&]|&(?!&)|"[^"]*(?:"|\z)|'[^']*(?:'|\z))+"""
QUOTED = r"""(?s)"([^"]*)(?:"|\z)|'([^']*)(?:'|\z)"""

#: How an argument is read, by its form; the first form that fits decides. Forms with a group hold the pattern in it.
FORMS = (
    ("hidden", r"\A(?:-f|--file|--file=.*)\z"), ("inline", r"\A--regexp=(.*)\z"), ("next", r"\A(?:-e|--regexp|-(?!e|-).+e)\z"), ("inline", r"\A-e(.+)\z"),
    ("skips", r"\A(?:" + "|".join(VALUED_FLAGS) + r")\z"), ("flag", r"\A-"), ("word", r""),
)


def tokenize(command: Column) -> Column:
    """A command's words and separators, quotes taken off and their text kept together."""
    return F.filter(F.transform(F.regexp_extract_all(command, F.lit(PARTS), F.lit(0)), lambda t: F.regexp_replace(t, QUOTED, "$1$2")), lambda t: t != "")


def arguments(command: Column) -> Column:
    """The arguments of the first statement whose leading program searches, up to a pipe; null for other commands."""
    marked = F.array_join(F.transform(tokenize(command), lambda t: F.when(t.isin(*SEPARATORS), "\u0002").otherwise(t)), "\u0001")
    words = lambda statement: F.filter(F.split(statement, "\u0001"), lambda t: t != "")
    before_pipe = lambda w: F.when(F.array_contains(w, "|"), F.slice(w, F.lit(1), F.array_position(w, "|").cast("int") - 1)).otherwise(w)
    without_sudo = lambda w: F.when(F.get(w, F.lit(0)) == "sudo", F.slice(w, F.lit(2), F.size(w))).otherwise(w)
    heads = F.transform(F.split(marked, "\u0002"), lambda s: without_sudo(before_pipe(words(s))))
    searches = lambda w: F.coalesce(F.regexp_extract(F.get(w, F.lit(0)), r"([^/]*)/*\z", 1).isin(*SEARCH_TOOLS), F.lit(False))
    found = F.get(F.filter(heads, searches), F.lit(0))
    return F.slice(found, F.lit(2), F.size(found))


def _kind(argument: Column) -> Column:
    kind = F.lit(None).cast("string")
    for name, form in reversed(FORMS):
        kind = F.when(argument.rlike(f"(?s){form}"), name).otherwise(kind)
    return kind


def search_of(command: Column) -> Column:
    """(pattern, paths): what a command searches for and the paths that it is restricted to; null and none for other commands.

    Arguments are read from the left: one may say that the next one is the pattern or doesn't count. A
    pattern that a file holds, or that is missing, can't be known; then nothing after it is read and no path is named.
    """
    state = F.struct(F.lit(None).cast("string").alias("pattern"), F.array().cast("array<string>").alias("paths"), F.lit("any").alias("expects"))

    def read(s: Column, argument: Column) -> Column:
        kind = F.when(s["expects"] == "any", _kind(argument)).otherwise(s["expects"])
        inline = F.regexp_replace(argument, r"\A(?:--regexp=|-e)", "")
        names_path = (kind == "word") & s["pattern"].isNotNull() & (argument != ".")
        given = F.when(kind == "inline", inline).when((kind == "word") | (kind == "pattern"), argument)
        expects = F.when(kind.isin("hidden", "over"), "over").when(kind == "next", "pattern").when(kind == "skips", "ignored").otherwise("any")
        return F.struct(F.coalesce(s["pattern"], given).alias("pattern"), F.when(names_path, F.concat(s["paths"], F.array(F.rtrim(argument, F.lit("/"))))).otherwise(s["paths"]).alias("paths"), expects.alias("expects"))

    known = lambda s: F.struct(s["pattern"].alias("pattern"), F.when(s["expects"].isin("over", "pattern"), F.array().cast("array<string>")).otherwise(s["paths"]).alias("paths"))
    return F.aggregate(F.coalesce(arguments(command), F.array().cast("array<string>")), state, read, known)


def in_scope(path: Column, scope: list[str]) -> Column:
    """Whether a path is within one of the named ones: begins with it, holds it after a slash, or begins with its last part."""
    plain, keep = F.replace(path, F.lit("\\"), F.lit("/")), F.lit(not scope)
    for s in scope:
        while s.startswith("./"):
            s = s[2:]
        keep = keep | plain.startswith(s) | plain.contains("/" + s) | plain.startswith(s.rsplit("/", 1)[-1])
    return keep


def hits_in_scope(hits: DataFrame, needle: str, scope: list[str], most: int = MOST_HITS) -> DataFrame:
    """path, line (the first that has the needle, whatever its case), rank of the best hits within the scope; hits: path, body, rank, ref.

    The scope goes before the limit, so that a narrow one isn't emptied by better hits elsewhere.
    """
    lines = F.filter(F.split("body", r"\r?\n"), lambda x: F.lower(x).contains(needle.lower()))
    rows = hits.filter(in_scope(F.col("path"), scope)).withColumn("line", F.get(lines, F.lit(0))).filter("line IS NOT NULL")
    return rows.orderBy("rank", "path", "ref").limit(most).select("path", "line", "rank")


def by_location(hits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(folder, n_hits of the TOP_FOLDERS folders with most hits; path, line of the FIRST_LINES first hits of the largest); hits: path, line, pos; a page of results."""
    placed = hits.withColumn("folder", parent_dir(F.col("path")))
    top = placed.groupBy("folder").agg(F.count(F.lit(1)).alias("n_hits")).orderBy(F.desc("n_hits"), "folder").limit(TOP_FOLDERS)
    largest = top.orderBy(F.desc("n_hits"), "folder").limit(1).select("folder")
    return top, placed.join(F.broadcast(largest), "folder", "left_semi").orderBy("pos").limit(FIRST_LINES).select("path", "line")


def delivered(log: DataFrame, db: str) -> DataFrame:
    """n: firings that gave an answer from one database; log: outcome, db."""
    return log.agg(F.count_if(F.col("outcome").isin(*DELIVERED) & (F.col("db") == db)).alias("n"))


def outcome_shares(log: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """outcome ("other" for unknown ones), n, share (percent, one decimal), n_scoped, median_hits and median_term_len (upper); log: outcome, scoped, hits, term_len."""
    rows = log.withColumn("outcome", F.when(F.col("outcome").isin(*known), F.col("outcome")).otherwise("other"))
    counts = rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("scoped", F.lit(False))).alias("n_scoped"))
    counts = counts.withColumn("share", F.round(F.col("n") * 1000.0 / F.sum("n").over(W.partitionBy())) / 10)  # a row for each outcome
    for column, name in (("hits", "median_hits"), ("term_len", "median_term_len")):
        middle = order_statistics(rows, "outcome", column, {name: F.floor(F.col("n") / 2)}).select("outcome", name)
        counts = counts.join(F.broadcast(middle), "outcome", "left")
    return counts


def answerable(terms: DataFrame, column: str = "term") -> DataFrame:
    """The rows whose term the index can be asked for."""
    return terms.filter(is_indexable(F.col(column)))
