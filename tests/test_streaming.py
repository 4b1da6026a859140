"""File streams: merges that take each key once, late rows, counters."""

import pytest

from tracewell.streaming.ingest import Table, WatcherState, applied, is_live, progress_counts, route, start_merge, stop, windowed


def test_merge_survives_restarts_and_repeats(spark, tmp_path):
    schema = "uuid string, ordinal int, body string"
    put = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
    table = Table(spark, str(tmp_path / "table"), ["uuid", "ordinal"])

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        query = start_merge(stream, table, ["body"], str(tmp_path / "checkpoint"), {"availableNow": True})
        query.awaitTermination()
        return query

    put("a", [("x", 0, "first"), ("x", 0, "again"), ("y", 0, "y")])
    counts = progress_counts(run())
    assert counts == {"events_total": 3, "events_coalesced_total": 1}
    put("b", [("x", 0, "later"), ("x", 1, "second")])
    run()
    run()
    assert sorted(tuple(r) for r in table.read().collect()) == [("x", 0, "again"), ("x", 1, "second"), ("y", 0, "y")]


def test_windows(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:05:00", "a", 1.0), ("2024-01-01 00:55:00", "a", 2.0), ("2024-01-01 01:05:00", "b", 3.0)], "t string, k string, v double").selectExpr("CAST(t AS TIMESTAMP) AS ts", "k", "v").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, k string, v double").parquet(str(tmp_path / "in"))
    query = windowed(stream, "ts", "10 minutes", "1 hour", None, "k", "v").writeStream.format("memory").queryName("windows_test").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.k, r.n, r.total) for r in spark.table("windows_test").collect()) == [("a", 2, 3.0), ("b", 1, 3.0)]


def test_liveness():
    assert is_live(100, 160) and not is_live(100, 161) and not is_live(None, 0)


def test_table_compacts_and_deletes(spark, tmp_path):
    table = Table(spark, str(tmp_path / "t"), ["k"])
    make = lambda *rows: spark.createDataFrame(list(rows), "k int, v int")
    for n in range(3):
        table.add(n, make(*[(k, n) for k in range(n, n + 3)]), ["v"])
    table.add(1, make((99, 9)), ["v"])
    table.add(3, make((0, 7)), ["v"])
    expected = [(0, 0), (1, 0), (2, 0), (3, 1), (4, 2)]
    assert sorted(tuple(r) for r in table.read().collect()) == expected
    table.compact(2)
    assert table.versions() == [3] and sorted(tuple(r) for r in table.read().collect()) == expected
    table.add(2, make((98, 9)), ["v"])
    table.delete(make((2, 0), (77, 0)))
    assert sorted(r.k for r in table.read().collect()) == [0, 1, 3, 4]
    table.add(4, make((2, 5), (3, 5)), ["v"])
    assert sorted(tuple(r) for r in table.read().collect()) == [(0, 0), (1, 0), (2, 5), (3, 1), (4, 2)]


def test_routing_of_notifications(spark):
    subscriptions = spark.createDataFrame([(0, "file", "/w/CLAUDE.md", "session"), (1, "folder", "/w/notes", "memory"), (2, "root", "/w", "design"), (3, "folder", "/w", "design"), (4, "refs", "/w/r", "commits"), (5, "folder", "/w/notes", "late")], "n int, kind string, root string, corpus string")
    paths = ["/w/CLAUDE.md", "/w/notes/a/b.md", "/w/notes/x.txt", "/w/top.md", "/w/r/.git/HEAD", "/w/r/.git/refs/heads/m", "/w/r/.git/config", "/elsewhere/a.md"]
    found = route(spark.createDataFrame([(p,) for p in paths], "path string"), subscriptions)
    assert {r.path: r.corpus for r in found.collect()} == {"/w/CLAUDE.md": "session", "/w/notes/a/b.md": "late", "/w/top.md": "design", "/w/r/.git/HEAD": "commits", "/w/r/.git/refs/heads/m": "commits"}


def test_disappeared_files_leave(spark):
    frame = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    again, left = applied(frame("a", "b", "c"), frame("b", "c", "d", "b"), frame("a", "c", "d"))
    assert sorted(r.path for r in again.collect()) == ["c", "d"] and sorted(r.path for r in left.collect()) == ["a", "c"]


def test_watcher_state_counts_batches():
    state = WatcherState(1, 1).after(3, 5).after(0, 9).after(2, 12)
    assert (state.events_total, state.events_coalesced, state.last_event, state.heartbeat) == (5, 2, 12, 12)


def test_stop_waits_for_what_there_is(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long").parquet(str(tmp_path / "in"))
    query = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
    query.processAllAvailable()
    assert not stop(query) and not query.isActive


def test_a_lost_driver_leaves_the_table(spark, tmp_path, monkeypatch):
    """Lost before the new base is complete, or before what it stands for is gone: the rows are those before or after the delete."""
    table = Table(spark, str(tmp_path / "t"), ["k"])
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    keys = lambda: sorted(r.k for r in Table(spark, table.path, ["k"]).read().collect())
    for n in range(3):
        table.add(n, frame([(2 * n, "a"), (2 * n + 1, "b")]), ["v"])

    def lost(*_):
        raise RuntimeError("the driver is lost")

    with monkeypatch.context() as m:
        m.setattr(Table, "_write", lost)
        with pytest.raises(RuntimeError):
            table.delete(frame([(1, "")]))
    assert keys() == [0, 1, 2, 3, 4, 5]
    class Kept:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, name):
            return lost if name == "delete" else getattr(self.fs, name)

    with monkeypatch.context() as m:
        m.setattr(table, "fs", Kept(table.fs))
        with pytest.raises(RuntimeError):
            table.delete(frame([(1, "")]))
    assert keys() == [0, 2, 3, 4, 5]
    table.delete(frame([(4, "")]))
    table.add(1, frame([(1, "again")]), ["v"])  # a version that the base stands for
    assert keys() == [0, 2, 3, 5]
    table.add(3, frame([(1, "new"), (0, "old")]), ["v"])
    table.compact(1)
    table.delete(frame([(k, "") for k in range(9)]))
    assert keys() == [] if Table(spark, table.path, ["k"]).read() is not None else True
