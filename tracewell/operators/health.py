"""Measurements of the engine's own operations, and the health snapshot made of them."""

from __future__ import annotations

import json
import resource
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import analytics as A

OP_MEASUREMENT = "op_name string, started_at long, duration_ms long, rss_delta_bytes long, rss_after_bytes long, rows_in long, rows_out long, error string, extra_json string"
LIVE_SECONDS, PERF_WINDOW = 60, 3600


def _resident() -> int:
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024


@dataclass
class Operation:
    """Times one operation: ``with Operation("index") as op: op.rows_out = ...``; ``row`` is what ``record`` appends."""

    name: str
    rows_in: int | None = None
    rows_out: int | None = None
    extra: dict = field(default_factory=dict)
    row: tuple | None = None

    def __enter__(self) -> Operation:
        self.began, self.clock, self.before = int(time.time()), time.monotonic(), _resident()
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, trace: object) -> None:
        after = _resident()
        self.row = (self.name, self.began, int((time.monotonic() - self.clock) * 1000), after - self.before, after, self.rows_in, self.rows_out, None if error is None else str(error)[:500], json.dumps(self.extra))


def record(spark: SparkSession, operations: list[Operation], path: str) -> None:
    """Appends finished operations to the table of measurements, in one file."""
    spark.createDataFrame([o.row for o in operations if o.row], OP_MEASUREMENT).coalesce(1).write.mode("append").parquet(path)


def edit_window(edits: DataFrame, commits: DataFrame) -> DataFrame:
    """first_edit, last_edit, n_authors (distinct addresses of the commits)."""
    span = edits.agg(F.min("edited_at").alias("first_edit"), F.max("edited_at").alias("last_edit"))
    return span.join(F.broadcast(commits.agg(F.countDistinct("author_email").alias("n_authors"))))  # one row each


def delta_summary(rows: DataFrame, delta: str) -> DataFrame:
    """The counts of ``delta_shapes`` and the (upper) median of the absolute differences."""
    middle = A.order_statistics(rows.select(F.lit(1).alias("__all"), F.abs(F.col(delta)).alias("__d")), "__all", "__d", {"median_delta": F.floor(F.col("n") / 2)})
    return A.delta_shapes(rows, delta).join(F.broadcast(middle.select("median_delta")), how="left")  # one row each


def check(corpora: dict[str, tuple[DataFrame, str | None]], children: dict[str, DataFrame], live: DataFrame, key: str, repos: DataFrame, operations: DataFrame, activity: DataFrame, heartbeat: int | None, now: int) -> DataFrame:
    """section, name, value (a number): the health snapshot, one scan of each corpus.

    corpora: rows and newest clock by name (see ``corpus_probe``); children: rows that must have their
    ``key`` among the live ones; operations: op_name, id, started_at, duration_ms, error.
    """
    flat = lambda rows, section, name, **values: [rows.select(F.lit(section).alias("section"), (F.concat(F.col(name), F.lit("." + v)) if name else F.lit(v)).alias("name"), c.cast("double").alias("value")) for v, c in values.items()]
    probe, lost = A.corpus_probe(corpora), A.orphans(children, live, key)
    recent, last = A.latencies(operations, now, PERF_WINDOW), A.latest(operations.filter("error IS NULL"), "op_name", "id", "duration_ms")
    shallow = repos.agg(F.count_if(F.coalesce(F.col("is_shallow").cast("boolean"), F.lit(False))).alias("n"))
    alive = heartbeat is not None and now - heartbeat <= LIVE_SECONDS
    watcher = repos.sparkSession.range(1).select(F.lit(int(alive)).alias("n"))
    parts = [
        *flat(probe, "indexer", "corpus", n_rows=F.col("n_rows"), newest=F.col("newest")), *flat(lost, "orphans", "child", n_orphans=F.col("n_orphans")), *flat(shallow, "repos", None, n_shallow=F.col("n")),
        *flat(recent, "perf", "op_name", p50=F.col("p50"), p95=F.col("p95")), *flat(last, "last_run", "op_name", duration_ms=F.col("duration_ms")), *flat(watcher, "watcher", None, live=F.col("n")),
        *flat(A.adoption(activity), "adoption", None, sessions=F.col("sessions"), sessions_with_own=F.col("sessions_with_own"), share=F.col("share")),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found
