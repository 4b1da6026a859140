"""Whether a stored chunk still stands where it was, and where it has moved to."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import lines

LEAST_BYTES, QUORUM = 8, 3


def file_state(stored: DataFrame, live: DataFrame) -> DataFrame:
    """stored (path, mtime, content_hash) with state: missing, fresh or changed; live: path, mtime, content_hash."""
    now = live.select("path", F.col("mtime").alias("__m"), F.col("content_hash").alias("__h"))
    same = (F.col("mtime") == F.col("__m")) | (F.col("content_hash") == F.col("__h"))
    return stored.join(now, "path", "left").withColumn("state", F.when(F.col("__h").isNull(), "missing").when(same, "fresh").otherwise("changed")).drop("__m", "__h")


def exact_shift(chunk: list[str], file: list[str], at: int) -> int | None:
    """The least shift, earlier ones first, at which the whole chunk stands in the file; at counts from 0."""
    if not chunk:
        return None
    found = [k - at for k in range(len(file) - len(chunk) + 1) if file[k] == chunk[0] and file[k : k + len(chunk)] == chunk]
    return min(found, key=lambda s: (abs(s), s), default=None)


def _distinctive(line: str) -> bool:
    return len(line.strip().encode()) >= LEAST_BYTES and any(c.isalnum() for c in line)


def voted_shift(chunk: list[str], file: list[str], at: int) -> int | None:
    """The shift that most of the chunk's distinctive lines agree on, if it has half of them."""
    own = [(n, line.strip()) for n, line in enumerate(chunk) if _distinctive(line)]
    if len(own) < QUORUM:
        return None
    places: dict[str, list[int]] = {}
    for n, line in enumerate(file):
        places.setdefault(line.strip(), []).append(n)
    votes = Counter(k - (at + n) for n, line in own for k in places.get(line, ()))
    if not votes:
        return None
    shift, n = min(votes.items(), key=lambda v: (-v[1], abs(v[0]), v[0]))
    return shift if 2 * n >= len(own) else None


def shift_of(body: str, live: str, line_start: int) -> int | None:
    chunk, file = body.splitlines(), live.splitlines()
    exact = exact_shift(chunk, file, line_start - 1)
    return voted_shift(chunk, file, line_start - 1) if exact is None else exact


def relocated(rows: DataFrame) -> DataFrame:
    """rows (body, line_start, line_end, live) with status (verified, relocated, stale, file_missing), shift and the new lines.

    For the rows of a result: the comparison is a Python function over batches.
    """

    @F.pandas_udf("long")
    def shift(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for bodies, lives, starts in batches:
            found = [None if b is None or x is None else shift_of(b, x, int(s)) for b, x, s in zip(bodies, lives, starts)]
            yield pd.Series(found, dtype="Int64")

    moved = rows.withColumn("shift", shift("body", "live", "line_start"))
    status = F.when(F.col("live").isNull(), "file_missing").when(F.col("shift").isNull(), "stale").when(F.col("shift") == 0, "verified").otherwise("relocated")
    n = F.size(lines(F.col("live")))
    place = lambda c: F.when(F.col("shift").isNotNull(), F.least(F.greatest(F.col(c) + F.col("shift"), F.lit(1)), n))
    return moved.withColumn("status", status).withColumn("new_start", place("line_start")).withColumn("new_end", place("line_end"))


def votes(stored: DataFrame, live: DataFrame) -> DataFrame:
    """key, n_distinctive, shift, n_votes, accepted by a join of lines; stored: key, line_start, body; live: key, text. For whole corpora."""
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    good = (F.octet_length("line") >= LEAST_BYTES) & F.col("line").rlike(r"[\p{L}\p{N}]")
    own = stored.select("key", "line_start", F.posexplode(lines(F.col("body"))).alias("n", "raw")).withColumn("line", trimmed("raw")).filter(good)
    file = live.select("key", F.posexplode(lines(F.col("text"))).alias("k", "raw")).withColumn("line", trimmed("raw")).filter(good)
    totals = own.groupBy("key", "line_start").agg(F.count(F.lit(1)).alias("n_distinctive"))
    shift = F.col("k") - (F.col("line_start") - 1 + F.col("n"))
    counted = own.join(file, ["key", "line"]).groupBy("key", "line_start", shift.alias("shift")).agg(F.count(F.lit(1)).alias("n_votes"))
    best = counted.withColumn("__rn", F.row_number().over(W.partitionBy("key", "line_start").orderBy(F.desc("n_votes"), F.abs("shift"), "shift"))).filter("__rn = 1").drop("__rn")
    joined = totals.join(best, ["key", "line_start"], "left")
    return joined.withColumn("accepted", F.coalesce((F.col("n_distinctive") >= QUORUM) & (F.col("n_votes") * 2 >= F.col("n_distinctive")), F.lit(False)))


def quickfix(path: Column, line: Column, text: Column, status: Column) -> Column:
    """path:line: first line of text, with a mark of its status."""
    mark = F.when(status == "relocated", " [moved]").when(status == "stale", " [stale]").when(status == "file_missing", " [missing]").otherwise("")
    return F.concat(path, F.lit(":"), line.cast("string"), F.lit(": "), F.trim(F.split(text, "\n")[0]), mark)
