"""What leaves the engine: an event log of lines, and an export bundle with its counts."""

from __future__ import annotations

import json
import sys
from pathlib import Path
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class EventSink:
    """Writes one JSON line for each event, flushed at once, from the driver: "off", "stdout", or the path of a file that is appended to."""

    def __init__(self, where: str) -> None:
        self.out: TextIO | None = None
        if where == "stdout":
            self.out = sys.stdout
        elif where != "off":
            Path(where).parent.mkdir(parents=True, exist_ok=True)
            self.out = open(where, "a", encoding="utf-8")  # noqa: SIM115  closed by close()

    def emit(self, **event: object) -> None:
        if self.out:
            self.out.write(json.dumps(event, ensure_ascii=False, separators=(",", ":")) + "\n")
            self.out.flush()

    def close(self) -> None:
        if self.out and self.out is not sys.stdout:
            self.out.close()


def export_counts(calls: DataFrame, cutoff: int | None) -> DataFrame:
    """rows_total, rows_in_window, rows_unparseable_ts, error_rows, loss_rows; calls: ts (seconds, null where it can't be read), outcome, error, tokens_saved.

    Rows whose time can't be read are in the window; errors and losses are counted within it.
    """
    inside = F.lit(True) if cutoff is None else F.col("ts").isNull() | (F.col("ts") >= cutoff)
    failed = (F.coalesce(F.col("outcome") == "error", F.lit(False))) | F.col("error").isNotNull()
    return calls.agg(
        F.count(F.lit(1)).alias("rows_total"), F.count_if(inside).alias("rows_in_window"), F.count_if(F.col("ts").isNull() if cutoff is not None else F.lit(False)).alias("rows_unparseable_ts"),
        F.count_if(inside & failed).alias("error_rows"), F.count_if(inside & (F.col("tokens_saved") < 0)).alias("loss_rows"),
    )


def write_bundle(summary: DataFrame, calls: DataFrame, path: str) -> None:
    """A folder with ``summary`` (one row of counts) and ``calls`` as JSON lines, written by the executors; nothing is collected."""
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    calls.write.mode("overwrite").json(f"{path}/calls")


def bundle_text(summary: DataFrame, calls: DataFrame, most: int = 10_000) -> str:
    """The bundle as one pretty JSON text, for exports of at most ``most`` calls; an error for larger ones."""
    rows = calls.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} calls: write_bundle writes them")
    return json.dumps({"summary": json.loads(summary.toJSON().first()), "calls": [json.loads(r) for r in rows]}, indent=2, ensure_ascii=False)
