"""Incremental ingest: file streams into tables that keep what they have seen."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import base_name, parent_dir, path_prefixes
from ..operators.merge import insert_or_ignore, late_binding

LIVE_SECONDS, PARTS, COMPACT_EVERY = 60, 64, 16


class Table:
    """A Parquet table of keyed rows that grows by deltas: a batch that is run again finds its version and does nothing.

    A version is a folder v<n>, partitioned by a hash of the key into PARTS parts; ``versions`` lists what is
    complete through Spark's file system, so a lost driver resumes from it. New keys are only compared with
    the parts that they fall into. Each COMPACT_EVERY versions are written as one, so that reading stays
    cheap; a folder base<n>-<m> stands for all versions up to n, and for those of smaller n or m. It's complete
    before what it stands for goes, so that a driver may be lost at any time.
    """

    def __init__(self, spark: SparkSession, path: str, keys: list[str]) -> None:
        self.spark, self.path, self.keys = spark, path.rstrip("/"), keys
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _complete(self, kind: str) -> list[int]:
        if not self.fs.exists(self.fs_path(self.path)):
            return []
        found = [s.getPath() for s in self.fs.listStatus(self.fs_path(self.path))]
        numbers = [(p, p.getName().removeprefix(kind)) for p in found if p.getName().startswith(kind)]
        return sorted(int(n) for p, n in numbers if n.isdigit() and self.fs.exists(self.fs_path(p, "_SUCCESS")))

    def _base(self) -> tuple[int, int]:
        """The numbers (n, m) of the base that counts; (-1, 0) for none."""
        found = [p.getName().removeprefix("base").split("-") for p in self._listed("base") if self.fs.exists(self.fs_path(p, "_SUCCESS"))]
        return max(((int(n), int(m)) for n, m in found), default=(-1, 0))

    def _listed(self, kind: str) -> list:
        if not self.fs.exists(self.fs_path(self.path)):
            return []
        return [s.getPath() for s in self.fs.listStatus(self.fs_path(self.path)) if s.getPath().getName().startswith(kind)]

    def versions(self) -> list[int]:
        """Numbers of the versions that are complete, those that a base stands for as the base's."""
        base = self._base()[0]
        return sorted({*([base] if base >= 0 else []), *(n for n in self._complete("v") if n > base)})

    def _folders(self) -> list[str]:
        n, m = self._base()
        every = [*([f"{self.path}/base{n}-{m}"] if n >= 0 else []), *(f"{self.path}/v{k}" for k in self._complete("v") if k > n)]
        return [f for f in every if any(s.getPath().getName().startswith("part=") for s in self.fs.listStatus(self.fs_path(f)))]  # others are empty

    def read(self, parts: list[int] | None = None) -> DataFrame | None:
        """The rows; only those of some parts, if any are given."""
        found = None
        for folder in self._folders():
            rows = self.spark.read.parquet(folder)
            rows = rows if parts is None else rows.filter(F.col("part").isin(parts))
            found = rows if found is None else found.unionByName(rows)
        return None if found is None else found.drop("part")

    def _write(self, rows: DataFrame, folder: str) -> None:
        part = F.pmod(F.xxhash64(*self.keys), F.lit(PARTS)).cast("int")
        rows.withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(folder)

    def add(self, version: int, rows: DataFrame, order: list[str]) -> None:
        """Writes those of the rows whose key the table lacks, the first of each by the order, as a version."""
        if version in self._complete("v") or version <= self._base()[0]:
            return
        first = insert_or_ignore(rows.limit(0), rows, self.keys, order)
        if self._folders():
            part = F.pmod(F.xxhash64(*self.keys), F.lit(PARTS)).cast("int")
            touched = [r[0] for r in rows.select(part).distinct().collect()]  # PARTS numbers at most
            known = self.read(touched).select(*self.keys)
            first = first.join(known, self.keys, "left_anti")
        self._write(first, f"{self.path}/v{version}")
        self.compact()

    def compact(self, every: int | None = None) -> None:
        folders = self._folders()
        if len(folders) < (COMPACT_EVERY if every is None else every):
            return
        self._rebase(self.read())

    def _rebase(self, rows: DataFrame) -> None:
        """Writes rows as the base of all versions so far, then takes away what it stands for."""
        (n, m), last = self._base(), max(self.versions(), default=0)
        new = f"{self.path}/base{last}-{m + 1 if n == last else 0}"
        self._write(rows, new)
        for old in [p for p in self._listed("base") if not str(p.toString()).endswith(new.rpartition("/")[2])] + [self.fs_path(f"{self.path}/v{k}") for k in self._complete("v") if k <= last]:
            self.fs.delete(old, True)

    def delete(self, keys: DataFrame) -> None:
        """Takes rows by key out of the table; what remains becomes its base."""
        if self._folders():
            self._rebase(self.read().join(keys.select(*self.keys).distinct(), self.keys, "left_anti"))


def start_merge(stream: DataFrame, table: Table, order: list[str], checkpoint: str, trigger: dict) -> StreamingQuery:
    """Adds each batch's new keys to a table, once each, however often batches or rows come again.

    The keys that were seen are the table itself, not operator state, so nothing grows in memory, and a
    batch writes no more than its own rows.
    """
    return stream.writeStream.foreachBatch(lambda batch, number: table.add(number, batch, order)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def debounced(milliseconds: int = 500) -> dict:
    """The trigger that gathers notifications into batches."""
    return {"processingTime": f"{milliseconds} milliseconds"}


def route(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """events (path) with the corpus of the deepest subscription that matches, the later one where two are as deep; others are left out.

    subscriptions: n (their order), kind (file, folder, root, refs), root, corpus. A file is itself; a
    folder has the Markdown files below it; a root the ones right in it but for CLAUDE.md; refs a
    repository's head and branches.
    """
    paths = events.select("path").distinct()
    each = paths.select("path", F.explode(path_prefixes(F.col("path"))).alias("__at"))
    watched = F.when(F.col("kind") == "refs", F.concat("root", F.lit("/.git"))).otherwise(F.col("root"))
    found = each.join(F.broadcast(subscriptions.withColumn("__at", watched)), "__at")  # a row for each watched folder
    markdown, name = F.col("path").endswith(".md"), base_name(F.col("path"))
    head = (F.col("path") == F.concat("root", F.lit("/.git/HEAD"))) | F.col("path").startswith(F.concat("root", F.lit("/.git/refs/heads/")))
    fits = F.when(F.col("kind") == "file", F.col("path") == F.col("root")).when(F.col("kind") == "folder", markdown).when(F.col("kind") == "root", markdown & (parent_dir(F.col("path")) == F.col("root")) & (name != "CLAUDE.md")).otherwise(head)
    depth = F.size(F.split("root", "/"))
    best = found.filter(fits).groupBy("path").agg(F.max(F.struct(depth.alias("depth"), "n", "corpus", "root")).alias("b"))
    return events.join(best.select("path", "b.corpus", "b.root"), "path")


def applied(documents: DataFrame, events: DataFrame, live: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths to read again, documents without the paths that have gone); events, live: path."""
    seen = events.select("path").distinct()
    gone = seen.join(live.select("path"), "path", "left_anti")
    return seen.join(live.select("path"), "path", "left_semi"), documents.join(gone, "path", "left_anti")


@dataclass(frozen=True)
class WatcherState:
    started_at: int
    heartbeat: int
    last_event: int | None = None
    events_total: int = 0
    events_coalesced: int = 0

    def after(self, n: int, now: int) -> WatcherState:
        """The state after a batch of n notifications; an empty one only beats the heart."""
        return replace(self, heartbeat=now) if n == 0 else replace(self, heartbeat=now, last_event=now, events_total=self.events_total + n, events_coalesced=self.events_coalesced + 1)


def stop(query: StreamingQuery, seconds: int = 1) -> bool:
    """Lets a query finish what it has for a second, then stops it; whether it ended by itself."""
    ended = bool(query.awaitTermination(seconds))
    if not ended:
        query.stop()
    return ended


def bind_late(edges: DataFrame, commits: DataFrame, keys: list[str], column: str = "commit_id") -> DataFrame:
    """Edges whose commit appeared after them, bound; for each batch of commits."""
    return late_binding(edges, commits, keys, column)


def windowed(stream: DataFrame, at: str, watermark: str, length: str, slide: str | None, key: str, value: str) -> DataFrame:
    """Counts and sums by event-time window and key; rows later than the watermark are left out."""
    window = F.window(at, length, slide) if slide else F.window(at, length)
    return stream.withWatermark(at, watermark).groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def is_live(heartbeat: int | None, now: int) -> bool:
    return heartbeat is not None and now - heartbeat <= LIVE_SECONDS


def progress_counts(query: StreamingQuery) -> dict[str, int]:
    """events_total and events_coalesced_total (batches) of a query so far."""
    done = [p for p in query.recentProgress if p["numInputRows"] > 0]
    return {"events_total": sum(p["numInputRows"] for p in done), "events_coalesced_total": len(done)}
