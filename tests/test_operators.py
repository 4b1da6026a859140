"""Extractors, joins, merges, analytics, provenance, relocation: literal tables with known results."""

import json
import random
import re
import subprocess

import pytest
from pyspark.sql import functions as F

from tracewell.operators import analytics as A
from tracewell.operators import etl, joins, merge, provenance, relocate, scan
from tracewell.sources import readers


def rows_of(frame, *columns):
    return sorted((tuple(r[c] for c in columns or frame.columns) for r in frame.collect()), key=str)


def test_chunks(spark):
    text = "\n".join(f"l{n}" for n in range(7)) + "\n"
    found = rows_of(etl.chunks(spark.createDataFrame([(1, text), (2, ""), (3, None), (4, " \n\n"), (5, "a\r\nb")], "k int, text string"), "text", 3), "k", "line_start", "line_end", "chunk")
    assert found == [(1, 1, 3, "l0\nl1\nl2"), (1, 4, 6, "l3\nl4\nl5"), (1, 7, 7, "l6"), (5, 1, 2, "a\nb")]


def test_sections():
    text = "intro\n# A\nx\n```\n# no\n~~~\n```\n### C\ny\n## B\n #no\n#no\n# D\n"
    assert [(p, a, b) for p, a, b, _ in etl.sections_of(text)] == [("", 1, 1), ("A", 2, 12), ("A/C", 8, 9), ("A/B", 10, 12), ("D", 13, 13)]
    assert etl.sections_of("") == [] and etl.sections_of(None) == []


def test_front_matter(spark):
    notes = ["---\nname: \"a b\"\ndescription: d\ntype: user\nmetadata:\n  type: feedback\n---\n\nbody\n", "---\r\nname: x\r\ntype: 'y'\r\n---\r\nB", "---\nname: n\n---\nno type", "no front matter"]
    found = etl.front_matter(spark.createDataFrame([(t,) for t in notes], "text string"))
    assert rows_of(found, "name", "memory_type", "description", "body") == [("a b", "feedback", "d", "body\n"), ("x", "y", "", "B")]


def test_session_history(spark):
    text = "# x\n## Recent session history\n- **#618**: 2026-05-01 decided TODO #7 and TODO #2\n more\n- **#594**: plain\n## Next\n- **#1**: no\n"
    found = etl.session_history(spark.createDataFrame([(text,)], "text string"))
    assert rows_of(found, "session_number", "entry_date", "todos", "decisions") == [(594, None, [], []), (618, "2026-05-01", [2, 7], ["decided"])]
    said = etl.empty_extraction(spark.createDataFrame([("a",), ("## Recent session history\n",), ("## Recent session history\n- odd",)], "text string"))
    assert [r.diagnosis for r in said.collect()] == ["no_section", "no_bullets", "unreadable_bullets"]


def _line(kind="assistant", session="s", uuid="u", cwd="/ws/p", at="2026-06-06T01:13:22.173Z", blocks=()):
    return json.dumps({"type": kind, "sessionId": session, "uuid": uuid, "cwd": cwd, "timestamp": at, "message": {"id": "m", "content": list(blocks)}})


def _text(t):
    return {"type": "text", "text": t}


def _edit(path, name="Edit"):
    return {"type": "tool_use", "name": name, "input": {"file_path": path}}


def test_session_edges(spark, tmp_path):
    lines = [
        _line("user", blocks=[_text("ignored")]), "{torn", _line(uuid="a", blocks=[_text("why"), _edit("/ws/p/x.py"), _text(" "), _edit("/ws/p-other/y.py", "Write"), _edit("/ws/p/z.py", "Read")]),
        _line(uuid="b", blocks=[_edit("/ws/p/q.py")]), _line(uuid="c", session="t", blocks=[_edit("/ws/p/q.py")]), _line(uuid="d", at=None, blocks=[_edit("/ws/p/q.py")]), _line(uuid="", blocks=[_edit("/ws/p/q.py")]),
        _line(uuid="e", blocks=[_text("é" * 600), _edit("/ws/p/w.py")]), _line(uuid="f", cwd=None, blocks=[_edit("/ws/p/v.py")]),
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    read = readers.transcripts(spark, str(tmp_path))
    assert read.filter("corrupt").count() == 1
    found = etl.session_edges(read.filter("NOT corrupt"))
    assert rows_of(found.filter("message_uuid <> 'e'"), "message_uuid", "edge_ordinal", "file_path", "rationale") == [("a", 0, "x.py", "why"), ("a", 1, "/ws/p-other/y.py", "why"), ("b", 0, "q.py", "why"), ("c", 0, "q.py", None), ("f", 0, "/ws/p/v.py", None)]
    assert found.filter("message_uuid = 'e'").first().rationale == "é" * 250 + "…"
    assert found.first().edited_at == 1780708402


@pytest.mark.parametrize(("name", "command", "expected"), [("mcp__own__find", "", "own"), ("Grep", "", "retrieval"), ("Bash", "cd x; sudo grep a b | wc", "retrieval"), ("Bash", "cargo test | grep x", None), ("Read", "", None)])
def test_tool_classes(spark, name, command, expected):
    frame = spark.createDataFrame([(name, command)], "n string, c string")
    assert frame.select(etl.tool_class(F.col("n"), F.col("c"), "own").alias("x")).first().x == expected


def test_diff_blocks(spark):
    lines = ["commit abc1", "+++ b/a.py", "@@ -0,0 +5,3 @@", "+one", "+two", "-old", "+three", "@@ -9 +20 @@", "+   ", "+++ /dev/null", "@@ -1 +0,0 @@", "-x", "commit def2", "+++ b/b.py", "@@ -1,0 +2 @@", "+z"]
    found = etl.diff_blocks(spark.createDataFrame([("r", n, x) for n, x in enumerate(lines)], "repo string, line_no int, line string"))
    assert rows_of(found, "commit_hash", "file_path", "new_start", "added_body") == [("abc1", "a.py", 5, "one\ntwo"), ("abc1", "a.py", 7, "three"), ("def2", "b.py", 2, "z")]


def test_tables_of_sql(spark):
    said = ["psql -c 'select * from public.orders o join Items i on 1=1 join orders x'", "echo from nowhere", "sqlite3 db 'select 1 from information_schema.tables'"]
    found = spark.createDataFrame([(c,) for c in said], "c string").select(etl.tables_of_sql(F.col("c")).alias("t")).collect()
    assert [r.t for r in found] == [["public.orders", "Items"], [], []]


def test_source_files(spark):
    rows = [("a.py", b"x", 1), ("b.bin", b"a\x00b", 3), ("c.txt", b"\xff\xfe", 2), ("README.md", b"x", 1), ("big", b"x", 300_000)]
    assert [r.path for r in etl.source_files(spark.createDataFrame(rows, "path string, content binary, length long")).collect()] == ["a.py"]


def test_asof_binding(spark):
    edits = spark.createDataFrame([(1, "r", "f", 10), (2, "r", "f", 20), (3, "r", "g", 5), (4, "r", "f", 99)], "id int, repo string, path string, edited_at long")
    commits = spark.createDataFrame([("r", "f", 7, 10), ("r", "f", 6, 25), ("r", "f", 5, 25), ("r", "h", 1, 50)], "repo string, path string, commit_id long, committed_at long")
    assert rows_of(joins.capturing(edits, commits, ["repo", "path"]), "id", "commit_id", "committed_at") == [(1, 7, 10), (2, 5, 25), (3, None, None), (4, None, None)]


def test_prefix_and_domains(spark):
    paths = spark.createDataFrame([("/w/a/x",), ("/w/ab/x",), ("/w/a/n/y",), ("/z",)], "path string")
    roots = spark.createDataFrame([("/w",), ("/w/a/",), ("/w/a/n",)], "root string")
    assert rows_of(joins.owner(paths, roots), "path", "root") == [("/w/a/n/y", "/w/a/n"), ("/w/a/x", "/w/a/"), ("/w/ab/x", "/w"), ("/z", None)]
    labels = spark.createDataFrame([("/w", "d"), ("/w/a", "e"), ("/w/a/n", "d"), ("/w/a/n", None)], "entry string, owner string")
    assert rows_of(joins.visible(paths, labels, "d"), "path", "admitted") == [("/w/a/n/y", False), ("/w/a/x", False), ("/w/ab/x", True), ("/z", False)]


def test_ratchet(spark):
    rows = [("s", 1, "g", False), ("s", 2, "h", False), ("s", 3, "h", True), ("s", 4, "g", False), ("t", 1, "g", False), ("t", 2, "k", None)]
    found = joins.ratchet(spark.createDataFrame(rows, "s string, n int, g string, bad boolean"), ["s"], "g", ["n"], "bad")
    assert rows_of(found, "s", "n", "withheld") == [("s", 1, False), ("s", 2, True), ("s", 3, True), ("s", 4, True), ("t", 1, False), ("t", 2, True)]


def test_merges_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "k int, kind string, v int")
    new = spark.createDataFrame([(2, "c", 9), (3, "d", 9)], "k int, kind string, v int")
    once = merge.upsert(old, new, ["k"], ("kind",))
    assert rows_of(once) == [(1, "a", 1), (2, "b", 9), (3, "d", 9)] == rows_of(merge.upsert(once, new, ["k"], ("kind",)))
    kept = merge.insert_or_ignore(old, new.unionByName(new.withColumn("v", F.lit(5))), ["k"], ["v"])
    assert rows_of(kept) == [(1, "a", 1), (2, "b", 1), (3, "d", 5)] == rows_of(merge.insert_or_ignore(kept, new, ["k"], ["v"]))
    assert rows_of(merge.sweep(old, new, ["k"])) == [(2, "b", 1)] and rows_of(merge.sweep(old, new.limit(0), ["k"])) == rows_of(old)
    assert rows_of(merge.replace_by(old, new, "k")) == [(1, "a", 1), (2, "c", 9), (3, "d", 9)]
    bound = merge.late_binding(spark.createDataFrame([(1, 5), (2, None)], "k int, c int"), spark.createDataFrame([(1, 9), (2, 8), (2, 7)], "k int, c int"), ["k"], "c")
    assert rows_of(bound) == [(1, 5), (2, 7)]
    stored = spark.createDataFrame([("/r/a",), ("/r/b",), ("/r/sub/c",), ("/other",)], "path string")
    assert rows_of(merge.prune(stored, stored.limit(1), "/r", ["/r/sub"])) == [("/other",), ("/r/a",), ("/r/sub/c",)]


def test_backfill_counts_add_up(spark):
    have = spark.createDataFrame([("t1", "x", 5)], "ts string, tool string, result_tokens long")
    scanned = spark.createDataFrame([("t1", "x", 6, False), ("t2", "x", 7, False), ("t2", "x", 8, False), ("t3", "y", None, False), ("t4", "y", 1, True)], "ts string, tool string, result_tokens long, parse_error boolean")
    table, report = merge.backfill_report(have, scanned)
    assert report.first().asDict() == {"scanned": 5, "skipped_existing": 2, "skipped_no_layer2": 1, "parse_errors": 1, "inserted": 1}
    assert merge.backfill_report(table, scanned)[1].first().inserted == 0


def test_percentiles_and_medians(spark):
    rows = spark.createDataFrame([("a", 100, v, None) for v in (10, 20, 30, 40)] + [("a", 100, 999, "e"), ("a", 1, 5, None), ("b", 100, 7, None)], "op_name string, started_at long, duration_ms long, error string")
    assert rows_of(A.latencies(rows, 100, 50), "op_name", "n", "p50", "p95") == [("a", 4, 30, 40), ("b", 1, 7, 7)]
    assert rows_of(A.medians(rows.filter("error IS NULL"), "op_name", "duration_ms"), "op_name", "median") == [("a", 20), ("b", 7)]


TERMS = "term string, df long, has_author boolean, author_at long, author_lang string, prose_delta long, session_delta long, session_possible boolean"


def test_measurements(spark):
    shapes = A.delta_shapes(spark.createDataFrame([(-600,), (-7200,), (-200000,), (-1000000,), (None,)], "d long"), "d").first()
    assert tuple(shapes) == (1, 1, 1, 1, 4)
    terms = spark.createDataFrame([("a", 2, True, 1, "rs", -3000, -60, True), ("b", 2, True, 1, "rs", None, None, True), ("c", 5, True, 1, "tsx", -5, None, False), ("d", 5, True, 1, "tsx", None, -9, True), ("e", 30, True, 1, "tsx", -7, None, True), ("f", 30, False, None, None, None, None, False)], TERMS)
    assert A.coverage(terms).first().asDict() == {"n_terms": 6, "n_authored": 5, "n_prose": 3, "n_session": 2, "n_session_possible": 4, "n_either": 4, "n_neither": 1}
    assert rows_of(A.idf_tiers(terms)) == [(0, 2, 2, 2, 2, 1), (1, 2, 5, 5, 2, 2), (2, 2, 30, 30, 1, 1)]
    strata = {r.author_lang: r.median_delta for r in A.language_strata(terms).collect()}
    assert strata == {"rs": 60, "tsx": 7}
    words = spark.createDataFrame([(f"t{n:03}", 200 - n) for n in range(100)], "term string, df long")
    assert [r.term for r in A.stride_sample(words, 10).orderBy("term").collect()] == [f"t{n:03}" for n in range(0, 100, 10)] and A.stride_sample(words, 1000).count() == 100


@pytest.mark.parametrize("n, most", [(0, 5), (1, 1), (7, 7), (500, 13), (500, 200), (997, 200), (997, 996)])
def test_stride_sample_of_many_equal_frequencies_matches_brute_force(spark, n, most):
    rng = random.Random(n + most)
    letters = lambda: "".join(rng.choice("abé\U0001f600z") for _ in range(rng.randint(1, 8)))
    words = sorted({letters() for _ in range(3 * n)}, key=lambda w: rng.random())[:n]
    df = {w: 2 if rng.random() < 0.7 else rng.randint(3, 6) for w in words}
    order = sorted(words, key=lambda w: (-df[w], w.encode()))
    kept = order if len(order) <= most else [order[i * len(order) // most] for i in range(most)]
    found = A.stride_sample(spark.createDataFrame(list(df.items()), "term string, df long"), most).collect()
    assert sorted((r.term, r.df) for r in found) == sorted((w, df[w]) for w in kept)


def test_resolver(spark):
    rows = [("t", "code", "c2", 50, 1.0, "a"), ("t", "code", "c1", 20, 2.0, "b"), ("t", "code", "c1", 20, 0.5, "b"), ("t", "design", "d", 10, 0.0, "x"), ("t", "memory", "m", 90, 0.0, "y"), ("t", "config", "k", 5, 0.0, "z"), ("u", "design", "d", 10, 0.0, "x")]
    found = provenance.resolve(spark.createDataFrame(rows, "term string, layer string, commit_hash string, authored_at long, rank double, file_path string"))
    assert rows_of(found, "term", "commit_hash", "relation", "delta") == [("t", "c1", "author", None), ("t", "c2", "other_code", None), ("t", "d", "feeder", -10), ("t", "k", "other", None), ("t", "m", "feeder", 70), ("u", "d", "feeder", None)]


def test_relocation():
    chunk = [f"let value_{n} = compute({n});" for n in range(10)]
    body, pad = "\n".join(chunk), "\n".join(f"// filler {n}" for n in range(30))
    assert relocate.shift_of(body, f"{pad}\n{body}\n", 1) == 30
    assert relocate.shift_of(body, body, 31) == -30 and relocate.shift_of(body, body, 1) == 0
    edited = [*chunk[:4], "changed entirely here", *chunk[5:]]
    assert relocate.shift_of(body, f"{pad}\n" + "\n".join(edited), 1) == 30
    assert relocate.shift_of("}\n{\n}", "x\n}\n", 1) is None and relocate.shift_of(body, "nothing like it", 1) is None
    assert relocate.exact_shift(["a"], ["a", "b", "a"], 1) == -1


def test_relocation_by_batches_and_states(spark):
    rows = spark.createDataFrame([("a\nb\nc", 1, 3, "x\na\nb\nc"), ("a", 1, 1, None), ("a", 1, 1, "z"), ("a", 1, 1, "a")], "body string, line_start long, line_end long, live string")
    assert [(r.status, r.shift, r.new_start) for r in relocate.relocated(rows).collect()] == [("relocated", 1, 2), ("file_missing", None, None), ("stale", None, None), ("verified", 0, 1)]


def test_readers(spark, tmp_path):
    dump = {"database": "d", "objects": [{"name": "t"}, {"schema": "s", "name": "v", "type": "view", "columns": [{"name": "c", "type": "int", "nullable": False}], "extra": 1}]}
    (tmp_path / "x.schema.json").write_text(json.dumps(dump))
    found = readers.schema_objects(spark, str(tmp_path))
    assert rows_of(found, "schema_name", "object_name", "object_type") == [("public", "t", "table"), ("s", "v", "view")]
    log = tmp_path / "hook.jsonl"
    log.write_text('{"ts": 1, "outcome": "served", "hits": 2, "scoped": true}\nbad\n{"ts": 2, "outcome": "odd"}\n')
    read = readers.hook_log(spark, str(log))
    assert read.filter("corrupt").count() == 1
    stats = A.outcome_stats(read.filter("NOT corrupt"), ("served",))
    assert rows_of(stats, "outcome", "n", "n_scoped", "total_hits") == [("other", 1, 0, 0), ("served", 1, 1, 2)]
    (tmp_path / "d.toml").write_text('[domains.a]\nentries = ["x"]\nwithdrawn = ["y"]\n')
    assert rows_of(readers.domain_labels(spark, str(tmp_path / "d.toml"))) == [("x", "a"), ("y", None)]
    assert readers.dump_query("pg") == readers.dump_query("PostgreSQL")


def test_commits_and_last_touch(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "r"), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True, text=True)
    (tmp_path / "r").mkdir()
    git("init", "-q", "-b", "main")
    for n, name in enumerate(["a.py", "b.py", "a.py"]):
        (tmp_path / "r" / name).write_text(str(n))
        git("add", ".")
        git("commit", "-q", "-m", f"summary {n}\n\nbody {n}", "--date", f"2026-01-0{n + 1}T00:00:00Z")
    assert readers.discover_repos(str(tmp_path)) == [str(tmp_path / "r")]
    found = readers.commits(spark, str(tmp_path / "r"))
    assert [(r.message_summary, r.message_body, r.files_changed) for r in found.orderBy("authored_at").collect()] == [("summary 0", "body 0", ["a.py"]), ("summary 1", "body 1", ["b.py"]), ("summary 2", "body 2", ["a.py"])]
    head = found.orderBy(F.desc("authored_at")).first().commit_hash
    assert readers.commits(spark, str(tmp_path / "r"), head).count() == 0 and readers.commits(spark, str(tmp_path / "r"), "0" * 40).count() == 3
    touched = etl.last_touch(found.select(F.col("repo_path").alias("repo"), "commit_hash", F.col("parent_hashes").alias("parents"), F.col("authored_at").alias("committed_at"), F.col("files_changed").alias("files")))
    assert {r.path: r.commit_hash for r in touched.collect()}["a.py"] == head


def test_thread_measurement_covers_the_vocabulary_sample(spark):
    from tracewell.queries import QUERIES, provenance

    sf = "/root/testdata/sf0.001"
    terms = {r.term: r.df for r in provenance.sampled_terms(spark, sf).collect()}
    assert len(terms) == provenance.SAMPLE_TERMS and all(n >= 2 and len(t) >= 4 and t.isascii() and t.isalpha() for t, n in terms.items())
    assert terms == {r.term: r.df for r in QUERIES["stratified_terms"](spark, sf).collect()}
    assert QUERIES["thread_report_sampled"](spark, sf).first().n_terms == len(terms)
    tiers = QUERIES["idf_tiers_sampled"](spark, sf).orderBy("tier").collect()
    assert [t.n for t in tiers] == [67, 67, 66] and (tiers[0].min_df, tiers[2].max_df) == (min(terms.values()), max(terms.values()))
    assert {r.term for r in QUERIES["resolve_author_feeders_sampled"](spark, sf).select("term").distinct().collect()} == set(terms)


def test_neighbourhood_of_texts_needs_no_index(spark, tmp_path, monkeypatch):
    """The words are those that a stored index gives; the query writes none, and an index that is there is used."""
    from tracewell.operators import search as S
    from tracewell.queries import QUERIES
    from tracewell.queries import search as queries

    rng = random.Random(3)
    words = [f"word{k}" for k in range(30)]
    texts = [" ".join(rng.choice([*words, "License", "stupid", "licensed"]) for _ in range(rng.randrange(0, 14))) for _ in range(120)]
    index = S.index_of({"documents": spark.createDataFrame([(n, None if n % 17 == 0 else t) for n, t in enumerate(texts)], "ref long, body string")})
    stored = S.StoredIndex.write(index, str(tmp_path / "index"))
    for raw in ("license stupid", "word3 nosuchword", "licens* word1", "nosuchword nosuchterm"):
        for keep in (None, F.col("ref") % 2 == 0):
            found = [[(r.term, round(r.score, 9)) for r in S.neighbourhood(x, raw, keep).collect()] for x in (index, stored)]
            assert found[0] == found[1]
    monkeypatch.setattr(queries, "_WRITTEN", {})
    sf = "/root/testdata/sf0.001"
    alone = QUERIES["neighbourhood_terms"](spark, sf).collect()
    assert not queries._WRITTEN
    queries.documents_index(spark, sf)
    assert alone == QUERIES["neighbourhood_terms"](spark, sf).collect() and len(alone) == 8


@pytest.mark.parametrize(("own", "ranges"), [(True, 7), (False, 7), (True, 256), (False, 1)])
def test_carried_state_equals_a_plain_window(spark, own, ranges):
    """A key of all rows, null keys and values, places that are missing; the hot key's rows are in many tasks."""
    rng = random.Random(ranges)
    order = rng.sample(range(-(10**6), 10**6), 900)
    rows = [(n, rng.choice(["hot", "hot", "hot", "b", None]), k, rng.choice([None, None, f"v{n}"])) for n, k in enumerate(order)]
    frame = spark.createDataFrame(rows, "n long, k string, at long, v string")
    found = scan.carried(frame, ["k"], "at", F.col("v"), "last", own, ranges)
    seen, expected = {}, {}
    for n, k, at, v in sorted(rows, key=lambda r: r[2]):
        before = seen.get(k)
        seen[k] = v if v is not None else before
        expected[n] = seen[k] if own else before
    assert {r.n: r["last"] for r in found.collect()} == expected
    if ranges == 7:
        cut = frame.filter("k = 'hot'").select(scan.range_of(frame, "at", ranges).alias("r")).groupBy("r").count().collect()
        assert len(cut) == 7 and max(r["count"] for r in cut) < 200
    assert scan.carried(frame.limit(0), ["k"], "at", F.col("v"), "last").collect() == []


def test_last_touch_is_dealt_by_the_size_of_its_table(spark, monkeypatch):
    from tracewell.queries import joins as queries

    commits = spark.createDataFrame([("r", "c1", ["p"], 10, ["a"]), ("r", "c1", ["p"], 10, ["b"]), ("r", "c2", ["p"], 20, ["a"]), ("r", "c3", ["p", "q"], 30, ["a", "b"])], "repo string, commit_hash string, parents array<string>, committed_at long, files array<string>")
    assert sorted(tuple(r) for r in etl.last_touch(commits, 3).collect()) == [("r", "a", "c2", 20), ("r", "b", "c1", 10)]
    monkeypatch.setattr(queries, "ROWS_OF_TASK", 100)
    plan = queries.last_touch_provenance(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    parts = {int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM", plan)}
    assert len(parts) == 1 and parts.pop() >= 50  # 6,000 rows or so: each task joins and sorts as many, whatever the table's size


def test_sections_leave_a_task_in_pieces(spark, monkeypatch):
    import pandas as pd

    from tracewell.workers import ship_package

    ship_package(spark)
    monkeypatch.setattr(etl, "PIECE_CHARS", 64)
    made = []
    udf = F.pandas_udf
    monkeypatch.setattr(etl.F, "pandas_udf", lambda kind: lambda f: made.append(f) or udf(kind)(f))
    texts = [f"# h{n}\nbody {n}\n## s\nmore" if n % 7 else None for n in range(40)]
    rows = etl.sections(spark.createDataFrame(list(enumerate(texts)), "id int, text string"))
    pieces = list(made[0](iter([pd.Series(texts), pd.Series([], dtype=object), pd.Series(["# x"])])))
    assert len(pieces) > 10 and sum(map(len, pieces)) == 41  # sections of a few texts at a time
    assert [s["heading_path"] for s in pieces[0].iloc[1]] == ["h1", "h1/s"]
    assert rows.count() == 2 * sum(t is not None for t in texts)
