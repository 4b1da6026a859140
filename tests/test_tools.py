"""Hook commands, workspace and routing, operations and health, sinks, readers of whole histories, as-of at scale."""

import json
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from tracewell.operators import etl, health, hooks, joins, search, tools, workspace
from tracewell.sources import readers, sinks


TOKENS = {
    'grep -n "two words" f.rs': ["grep", "-n", "two words", "f.rs"], "a 2>&1 | b": ["a", "2>&1", "|", "b"], "a&&b||c;d": ["a", "&&", "b", "||", "c", ";", "d"], "grep 'a;b' f": ["grep", "a;b", "f"], "": [], "x 'open": ["x", "open"],
    "a;;b & c''": ["a", ";;", "b", "&", "c"], "x\n\"y\nz\"w '' \"\"": ["x", "y\nzw"],
}


def test_shell_tokens(spark):
    found = spark.createDataFrame([(c,) for c in TOKENS], "c string").select("c", hooks.tokenize(F.col("c")).alias("t")).collect()
    assert {r.c: r.t for r in found} == TOKENS


SEARCHES = {
    "grep -rn needle src/": ("needle", ["src"]), "cd x && rg -t py needle a b/": ("needle", ["a", "b"]), "cargo test | grep x": (None, []), "sudo /usr/bin/grep -e pat f": ("pat", ["f"]),
    "grep -rne pat .": ("pat", []), "grep -epat d": ("pat", ["d"]), "grep --regexp=p d": ("p", ["d"]), "grep -f list d": (None, []), "grep foo -f list": ("foo", []), "grep -e": (None, []), "ls -l": (None, []), "grep -A 3 p f": ("p", ["f"]), "grep": (None, []),
    "grep a b | rg c d; rg x": ("a", ["b"]), "ls; ack -e one -e two d1 d2/ && rg q": ("one", ["d1", "d2"]), "grep --file=x p d": (None, []), "grep p d --regexp": ("p", []), "rg -- p": ("p", []), "grep 'p q' \"d e/\"": ("p q", ["d e"]), "": (None, []), "ag -m": (None, []),
}


def test_searches_of_commands(spark):
    rows = spark.createDataFrame([*((c,) for c in SEARCHES), (None,)], "c string").select("c", hooks.search_of(F.col("c")).alias("s"))
    assert {r.c: (r.s.pattern, r.s.paths) for r in rows.collect()} == {**SEARCHES, None: (None, [])}
    assert "Python" not in rows._jdf.queryExecution().executedPlan().toString()


def test_scope_goes_before_the_limit(spark):
    rows = [(n, f"other/{n}.py", "a needle", float(n)) for n in range(40)] + [(99, "x/src/z.py", "no\r\nNeedle here", 99.0), (98, "src/q.py", "nothing", 98.0)]
    found = hooks.hits_in_scope(spark.createDataFrame(rows, "ref int, path string, body string, rank double"), "needle", ["./src"]).collect()
    assert [(r.path, r.line) for r in found] == [("x/src/z.py", "Needle here")]
    everywhere = hooks.hits_in_scope(spark.createDataFrame(rows, "ref int, path string, body string, rank double"), "needle", [])
    assert everywhere.count() == hooks.MOST_HITS


def test_terms_that_the_index_can_answer(spark):
    assert [r.term for r in hooks.answerable(spark.createDataFrame([("ab",), ("abc",), ("a.c",), ("né1",)], "term string")).collect()] == ["abc", "né1"]


def test_unassigned_folders_are_reported_once(spark):
    folders = spark.createDataFrame([(p,) for p in ("a", "a/x", "a/x/y", "b", "b/c", ".git", "a/node_modules", "d", "e/f/g/h/i/j/k")], "path string")
    labels = spark.createDataFrame([("a", "alpha"), ("a/x", None)], "entry string, owner string")
    assert sorted(r.path for r in workspace.unassigned(folders, labels).collect()) == ["a/x", "b", "d"]
    assert sorted(r.path for r in workspace.unassigned(folders, labels, ("d",)).collect()) == ["a/x", "b"]


def test_worst_finding(spark):
    schema = "severity int, kind string, path string"
    assert tuple(workspace.worst(spark.createDataFrame([(2, "k", "p"), (1, "k", "q")], schema)).first()) == ("warn", 2)
    assert tuple(workspace.worst(spark.createDataFrame([], schema)).first()) == ("ok", 0)


def test_labels_are_added_to_the_configuration():
    config = '[domains.a]\nentries = ["x"]\n\n[domains.b]\nwithdrawn = ["w"]\n'
    changed = workspace.label(config, "y", "a")
    assert 'entries = ["x", "y"]' in changed and "withdrawn" in changed
    assert 'entries = ["z"]' in workspace.label(config, "z", "b") and 'entries = ["n"]' in workspace.label(config, "n", "c")
    for bad in ("x", "/abs", "../up"):
        with pytest.raises(ValueError):
            workspace.label(config, bad, "b")
    staged = workspace.stage_undecided(config, ["q", "p"])
    assert 'undecided = ["p", "q"]' in staged and 'undecided = ["p", "q", "r"]' in workspace.stage_undecided(staged, ["r", "p"])
    assert workspace.stage_undecided(staged, ["p"]) == staged


def test_routing_counts(spark):
    schema = "session_id string, group_id string, ord int, file_path string, cwd string, repo_path string, git_branch string, rationale string"
    rows = [("s", "g1", 1, "/w/a/x", "/w/a", "r", "m", "why"), ("s", "g2", 2, "/w/b/x", "/w/a", "r", "m", "no"), ("s", "g3", 3, "/w/a/y", "/w/b", "r", "m", "late"), ("t", "g1", 1, "/w/top.md", "/w", "r", "m", "n"), ("t", "g2", 2, "/w/a/z", None, "r", "m", "ok")]
    edges = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([("/w/a", "alpha"), ("/w/b", "beta")], "entry string, owner string")
    kept = workspace.routed(edges, labels, "alpha", "/w", "/h/-w")
    assert sorted((r.session_id, r.ord, r.repo_path, r.rationale) for r in kept.collect()) == [("s", 1, "r", "why"), ("s", 3, None, "[withheld]"), ("t", 2, None, "ok")]
    assert tuple(workspace.routing_counts(edges, kept).first()) == (5, 2, 1)


def test_operations_are_recorded(spark, tmp_path):
    with health.Operation("index", rows_in=3) as good:
        good.rows_out = 2
    bad = health.Operation("index")
    with pytest.raises(KeyError), bad:
        raise KeyError("x" * 900)
    health.record(spark, [good, bad, health.Operation("never ended")], str(tmp_path / "m"))
    health.record(spark, [good], str(tmp_path / "m"))
    rows = spark.read.schema(health.OP_MEASUREMENT).parquet(str(tmp_path / "m"))
    assert rows.count() == 3 and rows.filter("error IS NULL AND rows_out = 2 AND duration_ms >= 0").count() == 2 and rows.filter("length(error) = 500").count() == 1


def test_event_sink_and_bundle(spark, tmp_path):
    sink = sinks.EventSink(str(tmp_path / "log" / "events.jsonl"))
    sink.emit(tool="é", n=1)
    assert (tmp_path / "log" / "events.jsonl").read_text() == '{"tool":"é","n":1}\n'
    sink.close()
    sinks.EventSink("off").emit(x=1)
    calls = spark.createDataFrame([(100, "ok", None, 5), (None, "error", None, -1), (1, "ok", "e", 2)], "ts long, outcome string, error string, tokens_saved long")
    counts = sinks.export_counts(calls, 50)
    assert tuple(counts.first()) == (3, 2, 1, 1, 1) and tuple(sinks.export_counts(calls, None).first()) == (3, 3, 0, 2, 1)
    bundle = json.loads(sinks.bundle_text(counts, calls))
    assert bundle["summary"]["rows_total"] == 3 and len(bundle["calls"]) == 3
    with pytest.raises(ValueError):
        sinks.bundle_text(counts, calls, 2)
    sinks.write_bundle(counts, calls, str(tmp_path / "bundle"))
    assert spark.read.json(str(tmp_path / "bundle" / "calls")).count() == 3


def test_commits_of_all_ancestry(spark, tmp_path):
    repo = tmp_path / "r"
    repo.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@x", *a], check=True, capture_output=True, text=True).stdout
    git("init", "-q", "-b", "main")

    def commit(name, at):
        (repo / name).write_text(name + at)
        git("add", ".")
        git("commit", "-q", "-m", f"touch {name}", "--date", at)

    commit("a.py", "2026-01-01T00:00:00Z")
    git("checkout", "-q", "-b", "side")
    commit("b.py", "2026-01-02T00:00:00Z")
    commit("c.py", "2020-01-01T00:00:00Z")
    git("checkout", "-q", "main")
    commit("d.py", "2026-01-03T00:00:00Z")
    git("merge", "-q", "--no-ff", "-m", "merge side", "side")
    found = readers.commits(spark, str(repo)).collect()
    assert len(found) == 5 and {r.message_summary for r in found} == {"touch a.py", "touch b.py", "touch c.py", "touch d.py", "merge side"}
    by = {r.message_summary: r for r in found}
    assert by["merge side"].position == 0 and sorted(by["merge side"].files_changed) == ["b.py", "c.py"] and by["touch a.py"].files_changed == ["a.py"]
    assert not any(r.shallow or r.capped for r in found)
    assert all(r.capped for r in readers.commits(spark, str(repo), cap=2).collect()) and readers.commits(spark, str(repo), cap=2).count() == 2
    subprocess.run(["git", "clone", "-q", "--depth", "1", f"file://{repo}", str(tmp_path / "s")], check=True)
    assert [r.shallow for r in readers.commits(spark, str(tmp_path / "s")).collect()] == [True]
    rows = readers.commits(spark, str(repo)).select(F.col("repo_path").alias("repo"), "position", "commit_hash", F.col("parent_hashes").alias("parents"), F.col("authored_at").alias("committed_at"), F.col("files_changed").alias("files"))
    assert {r.path: r.commit_hash for r in etl.last_touch(rows).collect()}["c.py"] == by["touch c.py"].commit_hash


def test_topology_decides_over_skewed_clocks(spark):
    rows = [("r", 0, "new", ["p"], 5, ["f"]), ("r", 1, "old", [], 900, ["f"])]
    frame = spark.createDataFrame(rows, "repo string, position long, commit_hash string, parents array<string>, committed_at long, files array<string>")
    assert etl.last_touch(frame).first().commit_hash == "new" and etl.last_touch(frame.drop("position")).first().commit_hash == "old"


def test_lines_are_numbered_from_each_files_start(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text('{"ts": 1}\r\n\nbad\n{"ts": 4}\n')
    rows = readers.hook_log(spark, str(tmp_path)).collect()
    assert sorted((r.file[-7:], r.line, r.ts, r.corrupt) for r in rows) == [(f"{n}.jsonl"[-7:], line, ts, bad) for n in "ab" for line, ts, bad in ((0, 1, False), (2, None, True), (3, 4, False))]


def test_calibration_model(spark, tmp_path):
    at = tmp_path / "c.toml"
    assert readers.calibration(spark, str(at)) is None
    at.write_text('[model]\nversion = "v1"\ndollars_per_token = 0.5\n[tools.find]\np50 = 3\np95 = 9\n')
    found = readers.calibration(spark, str(at), ("find", "check"))
    assert (found.version, found.rate, found.missing) == ("v1", 0.5, ("check",)) and tuple(found.tools.first()) == ("find", 3, 9)
    at.write_text("[model")
    with pytest.raises(ValueError):
        readers.calibration(spark, str(at))


def test_asof_matches_brute_force_and_takes_linear_time(spark):
    import random

    rng = random.Random(6)
    edits = [(n, rng.choice("ab"), rng.choice([None, rng.randrange(100)])) for n in range(400)]
    commits = [(rng.choice("abc"), n, rng.randrange(100)) for n in range(60)]
    schema = "id int, key string, edited_at long", "key string, commit_id long, committed_at long"
    found = {r.id: (r.commit_id, r.committed_at) for r in joins.capturing(spark.createDataFrame(edits, schema[0]), spark.createDataFrame(commits, schema[1]), ["key"]).collect()}
    for n, key, at in edits:
        after = [] if at is None else [(t, i) for k, i, t in commits if k == key and t >= at]
        assert found[n] == ((min(after)[1], min(after)[0]) if after else (None, None))
    assert joins.capturing(spark.createDataFrame(edits, schema[0]), spark.createDataFrame([], schema[1]), ["key"]).filter("commit_id IS NULL").count() == 400
    began = time.time()
    many = spark.range(80_000).select("id", F.lit("k").alias("key"), F.col("id").alias("edited_at"))
    few = spark.range(0, 80_000, 4).select(F.lit("k").alias("key"), F.col("id").alias("commit_id"), F.col("id").alias("committed_at"))
    assert joins.capturing(many, few, ["key"]).filter("committed_at >= edited_at AND committed_at < edited_at + 4").count() == 79_997
    assert time.time() - began < 60


def test_empty_queries_are_errors_and_empty_results_are_explained(spark):
    notes = spark.createDataFrame([(1, 1, "a", "plain words")], "ref long, document_id long, name string, body string")
    files = spark.createDataFrame([(1, "/n.md")], "document_id long, path string")
    index = search.index_of({"memory_entries": notes.select("ref", "body")})
    with pytest.raises(ValueError):
        tools.find_memory(index, notes, files, "  ")
    found = tools.find_memory(index, notes, files, "absent")
    said = found.summary.first()
    assert found.results.count() == 0 and (said.total_matched, said.returned, said.corpus_empty) == (0, 0, False)
    assert tools.find_memory(search.index_of({"other": notes.select("ref", "body")}), notes, files, "absent").summary.first().corpus_empty


def test_a_page_is_taken_from_keys_before_texts_are_read(spark):
    commits = spark.createDataFrame([(n, f"h{n:03}", "big" if n % 2 else "small", 100 + n // 2, "said", f"word text {n}") for n in range(60)] + [(7, "h900", "big", 90, "said", "word text 7")], "ref long, commit_hash string, repo_path string, authored_at long, message_summary string, message_body string")
    repos = spark.createDataFrame([("big", 1)], "repo_path string, is_shallow int")
    index = search.index_of({"commit_entries": commits.filter("commit_hash <> 'h900'").select("ref", F.col("message_body").alias("body"))})
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold") if spark.conf.get(k, None) is not None}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        found = tools.find_commit(index, commits, repos, "word", 5).results
        recent = tools.recent_commits(commits, repos, 130, 1, 4, index=index, filter_="word")
        for rows in (found, recent):
            joined = [x for x in rows._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "[ref#" in x]
            assert joined and all("BroadcastHashJoin" in x for x in joined)  # no text moves to meet its rank
        assert [(r["commit_hash"], r["shallow"], r["pos"]) for r in found.orderBy("pos").collect()] == [("h058", False, 1), ("h059", True, 2), ("h056", False, 3), ("h057", True, 4), ("h054", False, 5)]
        assert [(r["commit_hash"], r["shallow"]) for r in recent.collect()] == [("h058", False), ("h059", True), ("h056", False), ("h057", True)]
        assert tools.recent_commits(commits, repos, 130, 1, 3).select("commit_hash").collect() == [("h058",), ("h059",), ("h056",)]
        assert {r["commit_hash"] for r in tools.find_commit(index, commits.filter("ref = 7"), repos, "word").results.collect()} == {"h007", "h900"}
    finally:
        for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
            spark.conf.set(k, kept[k]) if k in kept else spark.conf.unset(k)
