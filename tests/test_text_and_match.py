"""The text kernel and the MATCH language; ranks against an independent full-text index."""

import random
import sqlite3
import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from tracewell.functions import numbers as N
from tracewell.functions import text as T
from tracewell.operators import search as S
from tracewell.plans import match as M


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("x")).first().x


@pytest.mark.parametrize(("text", "expected"), [("fooBar HTTPServer utf8", "foobar foo bar httpserver http server utf8 utf 8"), ("a_b", "a b"), ("", "")])
def test_expand_identifiers(spark, text, expected):
    assert one(spark, T.expand_identifiers(F.col("t")), t=text) == expected


@pytest.mark.parametrize(("n", "label"), [(-5, "0"), (0, "0"), (1, "1"), (3, "2-3"), (63, "32-63"), (64, "64-127"), (1023, "512-1023"), (1024, "1024-4095"), (65535, "16384-65535"), (65536, "65536+")])
def test_count_bucket(spark, n, label):
    assert one(spark, N.count_bucket(F.col("n")), n=n) == label


def test_labels_and_times(spark):
    assert one(spark, N.delta_label(F.col("s")), s=-90_000) == "−1d 1h before code"
    assert one(spark, N.duration_label(F.col("s")), s=3_720) == "1h 2m"
    assert one(spark, N.epoch_of(F.col("s")), s="2026-06-06T01:13:22.173Z") == 1780708402
    assert one(spark, N.epoch_of(F.col("s")), s="never") is None
    assert one(spark, N.signed(F.col("s")), s=-1234567) == "-1,234,567"


def test_paths(spark):
    at = lambda c, p: one(spark, c(F.col("p")), p=p)
    assert at(T.normalize_path, "/a/./b/../c") == "/a/c" and at(T.normalize_path, "a/../../b") is None
    assert at(T.layer_of, "x/memory/a.rs") == "memory" and at(T.layer_of, "a/CLAUDE.md") == "session" and at(T.layer_of, "a/b.tsx") == "code" and at(T.layer_of, "x.adoc") == "design" and at(T.layer_of, "Makefile") == "other"
    assert at(T.owned_by_other_corpus, "docs/a/b.md") and at(T.owned_by_other_corpus, "TODO.md") and not at(T.owned_by_other_corpus, "src/notes.md")
    assert at(T.language_of, "a/b.tsx") == "typescriptreact" and at(T.language_of, "a/b") is None
    assert at(lambda c: T.relative_to(c, F.lit("/ws/proj")), "/ws/proj-business/plan.md") == "/ws/proj-business/plan.md"
    schema, name = T.split_qualified(F.col("n"))
    assert (one(spark, schema, n='db."Sales"."Orders"'), one(spark, name, n='db."Sales"."Orders"')) == ("Sales", "Orders")


def test_truncation(spark):
    assert one(spark, T.truncate_bytes(F.col("t"), 5), t="aééé") == "aéé…"
    assert one(spark, T.truncate_bytes(F.col("t"), 4), t="aééé") == "aé…"
    assert one(spark, T.summarize(F.col("t"), 10), t="hello wide world") == "hello wide…"
    assert one(spark, T.summarize(F.col("t"), 10), t="hello, wide world") == "hello,…"
    assert one(spark, T.summarize(F.col("t"), 10), t="a bcdefghijkl") == "a bcdefghi…"
    assert one(spark, T.lines(F.col("t")), t="a\r\nb\n\n") == ["a", "b", ""]


def test_sanitize_and_broaden():
    assert M.sanitize('foo-bar ba*z "x y') == '"foo-bar" ba*z "x y'
    assert M.broadened("a b", "a b") == "a OR b"
    assert M.broadened("a", "a") is None and M.broadened("a OR b", "a OR b") is None and M.broadened('"a" b', '"a" b') is None
    assert M.has_operators("foo OR bar") and M.has_operators("prefix*") and M.has_operators("col:term") and not M.has_operators("apples or oranges")


@pytest.mark.parametrize("text", ["", "  ", "one,two", "(one", "one AND", "NOT a", "b-a", "a OR", "x:y", 'a "b', "NEAR(a b, x)"])
def test_malformed_queries_are_errors(text):
    with pytest.raises(M.QuerySyntaxError):
        M.parse(text)
    assert M.explain_error(M.QuerySyntaxError("x" * 900))[1].endswith("…")


def test_precedence():
    assert M.parse("one two OR three") == M.Or((M.And((M.Phrase(("one",)), M.Phrase(("two",)))), M.Phrase(("three",))))
    assert M.parse("a NOT b OR c") == M.Or((M.Not(M.Phrase(("a",)), M.Phrase(("b",))), M.Phrase(("c",))))
    assert M.parse("or not") == M.And((M.Phrase(("or",)), M.Phrase(("not",))))
    assert M.parse("a + b") == M.Phrase(("a", "b")) and M.parse("^a") == M.Phrase(("a",), False, True)


QUERIES = ["alpha", "alpha beta", "alpha OR beta", '"alpha beta"', "alph*", "gamma NOT alpha", "NEAR(alpha beta, 2)", "NEAR(alpha beta gamma)", "^alpha", "alpha alpha", "(alpha OR beta) AND gamma", "(alpha AND x1) OR gamma", "alpha OR beta OR x1", "x1 OR x1", "(alpha NOT beta) OR delta", "NEAR(alpha x1, 1) OR beta", '"beta gam" *', "café", 'alpha "--"', "delta + alpha"]


@pytest.mark.parametrize("stored", [False, True])
def test_matches_and_ranks_agree_with_an_independent_index(spark, tmp_path, stored):
    rng = random.Random(9)
    vocabulary = ["alpha", "beta", "gamma", "delta", "alphabet", "Café", "naïve", "x1"]
    bodies = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 25))) for _ in range(120)]
    plain = sqlite3.connect(":memory:")
    plain.execute("CREATE VIRTUAL TABLE t USING fts5(body)")
    plain.executemany("INSERT INTO t(rowid, body) VALUES (?, ?)", enumerate(bodies))
    index = S.index_of({"t": spark.createDataFrame(list(enumerate(bodies)), "ref long, body string")}).cache()
    index = S.StoredIndex.write(index, str(tmp_path / "index")) if stored else index
    for text in QUERIES:
        expected = {r: s for r, s in plain.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (text,))}
        found = {r.ref: r.rank for r in S.ranked(index, M.parse(text)).collect()}
        assert found.keys() == expected.keys(), text
        for ref, rank in found.items():
            assert rank == pytest.approx(expected[ref], abs=1e-9), text


def test_stored_index_reads_its_words_only(spark, tmp_path):
    frame = S.index_of({"a": spark.createDataFrame([(1, "one two one"), (2, "onset")], "ref long, body string"), "b": spark.createDataFrame([(1, "two"), (3, None)], "ref long, body string")})
    index = S.StoredIndex.write(frame, str(tmp_path / "i"))
    again = S.StoredIndex(spark, str(tmp_path / "i"))
    assert (again.n, again.avgdl) == (4, 1.25)
    plan = again.postings_of([("one", False)])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,one)" in plan
    counted = S.rows_of(again, [("one", False)], S.view_of([M.parse("one")]))._jdf.queryExecution().executedPlan().toString()
    assert "positions" not in counted.split("ReadSchema")[1]
    assert [(r.source_table, r.ref, r.body) for r in S.top(again, "on*").collect()] == [(r.source_table, r.ref, r.body) for r in S.top(frame, "on*").collect()]
    assert {(r.term, r.df, r.cf) for r in S.vocabulary(index).collect()} == {(r.term, r.df, r.cf) for r in S.vocabulary(frame).collect()}
    key = lambda rows: sorted((r.source_table, r.term, r.ref, r.tf, tuple(r.positions)) for r in rows.collect())
    assert key(S.postings(index)) == key(S.postings(frame))
    assert S.top(index, "two", keep=F.col("source_table") == "b").first().body == "two"


def documents_of(spark, rows):
    return S.index_of({"t": spark.createDataFrame(rows, "ref long, body string")})


def same_ranks(found, expected, text):
    key = lambda index: sorted((r.source_table, r.ref, round(r.rank, 9)) for r in S.ranked(index, M.parse(text)).collect())
    assert key(found) == key(expected), text


def test_changes_equal_a_fresh_index(spark, tmp_path):
    """Upserts, replacements and deletes reach the stored index; ranks, counts, vocabulary and bodies equal those of an index written anew."""
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "alphabet", "x1"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 20)))
    live = {n: text() for n in range(60)}
    index = S.StoredIndex.write(documents_of(spark, list(live.items())), str(tmp_path / "i"))
    for step in range(5):
        changed = {rng.randrange(80): text() for _ in range(8)}
        live |= changed
        index = index.upsert(documents_of(spark, list(changed.items())))
        gone = rng.sample(sorted(live), 3)
        live = {k: v for k, v in live.items() if k not in gone}
        index = index.delete(spark.createDataFrame([("t", k) for k in [*gone, 999]], "source_table string, ref long"))
    fresh = documents_of(spark, list(live.items()))
    assert len(index.segments) < 4  # small ones were merged
    assert (index.n, round(index.avgdl, 9)) == (len(live), round(sum(len(t.split()) for t in live.values()) / len(live), 9))
    for query in ("alpha", "alpha OR beta", '"alpha beta"', "gamma NOT x1", "alph*"):
        same_ranks(index, fresh, query)
    assert {(r.term, r.df, r.cf) for r in S.vocabulary(index).collect()} == {(r.term, r.df, r.cf) for r in S.vocabulary(fresh).collect()}
    assert {r.ref: r.body for r in S.top(index, "alpha", 50).collect()} == {r.ref: r.body for r in S.top(fresh, "alpha", 50).collect()}
    again = S.StoredIndex(spark, str(tmp_path / "i"))
    assert (again.gen, again.n) == (index.gen, index.n)


def test_a_change_that_never_ends_is_not_seen(spark, tmp_path, monkeypatch):
    index = S.StoredIndex.write(documents_of(spark, [(1, "alpha"), (2, "beta")]), str(tmp_path / "i"))

    def lost(*_):
        raise RuntimeError("the driver is lost")

    with monkeypatch.context() as m:
        m.setattr(S.StoredIndex, "_manifest", staticmethod(lost))
        with pytest.raises(RuntimeError):
            index.delete(spark.createDataFrame([("t", 1)], "source_table string, ref long"))
    again = S.StoredIndex(spark, str(tmp_path / "i"))
    assert [r.ref for r in S.ranked(again, M.parse("alpha")).collect()] == [1] and again.n == 2
    assert S.ranked(again.delete(spark.createDataFrame([("t", 2)], "source_table string, ref long")), M.parse("alpha OR beta")).count() == 1


def test_best_rows_leave_tiers_unread(spark, tmp_path):
    rng = random.Random(8)
    rows = [(n, " ".join(["alpha"] * rng.randrange(1, 9) + ["beta"] * rng.choice([0, 0, 1, 5]) + ["pad"] * rng.randrange(0, 60))) for n in range(2000)]
    frame = documents_of(spark, [*rows, *((n, "other words " * 5) for n in range(2000, 4500))]).cache()
    index = S.StoredIndex.write(frame, str(tmp_path / "i"))
    for words, k in ((["alpha"], 10), (["alpha", "beta"], 10), (["beta", "alpha", "beta"], 3), (["alpha"], 5000), (["nothing", "beta"], 5)):
        tree = M.parse(" OR ".join(words))
        expected = S.ranked(frame, tree).orderBy("rank", "source_table", "ref").limit(k).collect()
        found = index.best_words(words, k).collect()
        assert [(r.ref, round(r.rank, 9)) for r in found] == [(r.ref, round(r.rank, 9)) for r in expected], words
    plan = index.read_plan(["alpha"], ["alpha"], 10)
    assert plan.read["alpha"] < plan.every["alpha"] and len(plan.read["alpha"]) * 2 <= len(plan.every["alpha"])
    read = index._postings(index.segments, [("alpha", False)], plan.needed)
    assert 10 <= read.count() < 1000 and "(tier," in read._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]


def test_files_and_parts_that_are_read(spark, tmp_path, monkeypatch):
    from tracewell.operators import textindex

    monkeypatch.setattr(textindex, "TASK_POSTINGS", 8)
    monkeypatch.setattr(textindex, "FILE_DOCUMENTS", 10)
    words = [f"{c}{n}" for c in "abcdefgh" for n in range(10)]
    index = S.StoredIndex.write(documents_of(spark, [(n, " ".join(words[n % 80 : n % 80 + 3])) for n in range(100)]), str(tmp_path / "i"))
    segment = index.segments[0]
    every = index.files_of(segment, None)
    assert len(every) > 4 and len(index.files_of(segment, [("c5", False)])) <= 2 and len(index.files_of(segment, [("h", True)])) < len(every) and index.files_of(segment, [("zzz", False)]) == []
    assert {r.term for r in index.words_like([("b", True)]).collect()} == {f"b{n}" for n in range(10)}
    assert "StringStartsWith(term,b)" in index.words_like([("b", True)])._jdf.queryExecution().executedPlan().toString()
    found = index.with_bodies(S.page(index, M.parse("c5"), 2, bodies=False))
    assert [r.body.split()[0][0] for r in found.collect()] == ["c", "c"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert segment.parts == 10 and "PartitionFilters: [part" in plan.replace("isnotnull(part#", "part").replace("[isnotnull", "[part") and "In(h" in plan or "EqualTo(h" in plan


def test_empty_index_and_broadening(spark):
    index = S.index_of({"t": spark.createDataFrame([(1, "one two"), (2, "one"), (3, None)], "ref long, body string")})
    assert [r.ref for r in S.top(index, "one three").collect()] and S.count_with_fallback(index, "one three").query_broadened
    assert not S.count_with_fallback(index, "one two").query_broadened
    assert S.top(index.limit(0), "one").collect() == []
    assert S.top(index, '"--"').collect() == []
    assert S.clamp_limit(None) == 10 and S.clamp_limit(0) == 1 and S.clamp_limit(999) == 50
    span = S.rank_span(S.top(index, "nothing")).first()
    assert span.top_rank is None and span.rank_spread is None


def test_snippets_equal_those_of_an_independent_index(spark):
    rng = random.Random(7)
    vocabulary, bodies = ["alpha", "beta", "gamma", "delta", "aa", "Café", "x1", "Łódź", "e\u0301t"], []
    for _ in range(1000):
        words = [rng.choice(vocabulary if rng.random() < 0.3 else ["zz", "yy", f"w{rng.randrange(50)}"]) for _ in range(rng.choice([1, 5, 40, 64, 65, 66, 100, 200, 400]))]
        bodies.append("".join(w + rng.choice([" ", " ", " ", ". ", ": ", ".", "\n", "  ", ", ", " .\n"]) for w in words))
    plain = sqlite3.connect(":memory:")
    plain.execute("CREATE VIRTUAL TABLE t USING fts5(body)")
    plain.executemany("INSERT INTO t(rowid, body) VALUES (?, ?)", enumerate(bodies))
    checked = 0
    for query in ("aa", "alpha beta", "alpha OR beta OR aa", '"alpha beta" OR gamma', "alph*", "NEAR(alpha beta, 3)", "(alpha AND x1) OR gamma", "gamma NOT x1", "alpha alpha", "cafe OR w1 OR lodz OR łodz", "^alpha OR delta", "NEAR(alpha beta gamma, 5) OR et"):
        tree = M.parse(query)
        for ref, shown in plain.execute("SELECT rowid, snippet(t, 0, '', '', '…', 64) FROM t WHERE t MATCH ?", (query,)):
            assert S.snippet(bodies[ref], tree) == shown, (query, ref)
            checked += 1
    assert checked > 3000
    rows = spark.createDataFrame([(1, "one\ntwo three"), (2, None)], "ref long, body string")
    found = S.with_snippet(rows, M.parse("three"), "shown", "at").orderBy("ref").collect()
    assert [(r.shown, r["at"]) for r in found] == [("one\ntwo three", 0), (None, None)]


def test_words_equal_those_of_an_independent_index(spark):
    """Latin, Greek, Cyrillic, Armenian, Hebrew, Devanagari, Hangul, letter-like signs, two planes, private characters and combining marks."""
    rng = random.Random(5)
    blocks = ((0x20, 0x250), (0x370, 0x400), (0x400, 0x528), (0x531, 0x557), (0x5D0, 0x5EB), (0x904, 0x940), (0x1E00, 0x2000), (0x2100, 0x2180), (0xAC00, 0xAC80), (0xE000, 0xE010), (0xFF21, 0xFF5A), (0x10400, 0x10450))
    pool = [chr(c) for low, high in blocks for c in range(low, high) if unicodedata.category(chr(c)) != "Cn" and c != 0x37F]
    marks = [chr(c) for c in [*T.DROPPED_MARKS, 0x305, 0x30D, 0x340]]
    char = lambda: rng.choice(pool) if rng.random() < 0.6 else rng.choice("abc ABC -_.") if rng.random() < 0.7 else rng.choice(marks)
    texts = ["Škoda Łódź őr ŵ", "co\u0301dex", *("".join(char() for _ in range(rng.randrange(0, 30))) for _ in range(5000))]
    plain = sqlite3.connect(":memory:")
    plain.execute("CREATE VIRTUAL TABLE t USING fts5(body)")
    plain.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    plain.executemany("INSERT INTO t(rowid, body) VALUES (?, ?)", enumerate(texts))
    expected = [[] for _ in texts]
    for term, ref in plain.execute("SELECT term, doc FROM v ORDER BY doc, offset"):
        expected[ref].append(term)
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, t string").select("n", T.tokens(F.col("t")).alias("t")).orderBy("n").collect()
    assert [r.t for r in rows] == expected == [list(M.tokenize(t)) for t in texts]
    from tracewell.queries.search import TOKENS_OF

    with duckdb.connect() as con:
        con.execute("CREATE TABLE d (n BIGINT, t VARCHAR)")
        con.executemany("INSERT INTO d VALUES (?, ?)", [(n, t) for n, t in enumerate(texts[:500])])
        assert [r[0] for r in con.execute(f"SELECT {TOKENS_OF.format('t')} FROM d ORDER BY n").fetchall()] == expected[:500]


def test_below_window_pointers(spark):
    rows = [("a", 5, 1), ("b", 7, 2), ("c", 9, 3), ("a", 1, 4), ("c", 2, 5), ("d", 3, 6)]
    found = S.also_matched(spark.createDataFrame(rows, "path string, match_line long, pos long"), 2).orderBy("first_pos").collect()
    assert [(r.path, r.match_line, r.matches) for r in found] == [("c", 9, 2), ("d", 3, 1)]


def test_words_of_large_texts_are_the_query_words():
    texts = ["", "Order-Contract: Target_Cost (WBS) 24kV", "naıve Straße É ét ́ x́", "日本 \U0001d400b  ①", "a" * 50 + "̈"]
    assert [M.words_in(t.encode()) for t in texts] == [list(M.tokenize(t)) for t in texts]
    assert M.words_in(None) == [] and M.words_in(b"a\xffb") == ["a", "b"]


def test_writing_moves_postings_once_in_bounded_files(spark, tmp_path, monkeypatch):
    from tracewell.operators import textindex

    monkeypatch.setattr(textindex, "FILE_POSTINGS", 400)
    monkeypatch.setattr(textindex, "FILE_BYTES", 4000)
    seen = []
    dealt = textindex.postings_of
    monkeypatch.setattr(textindex, "postings_of", lambda rows: seen.append(dealt(rows)) or seen[-1])
    live = {n: " ".join(f"w{(n * k) % 97}" for k in range(40)) + " every" for n in range(100)}
    index = S.StoredIndex.write(documents_of(spark, list(live.items())), str(tmp_path / "i"))
    assert "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString()  # grouped where documents are read
    assert index.segments[0].parts >= 3 and len(index.files_of(index.segments[0], None)) >= 8
    assert S.vocabulary(index).count() == len({w for t in live.values() for w in t.split()})
    counted = {r["term"]: (r["df"], r["cf"]) for r in S.vocabulary(index).collect()}
    assert counted == {r["term"]: (r["df"], r["cf"]) for r in S.vocabulary(documents_of(spark, list(live.items()))).collect()}
    assert counted["every"] == (100, 100)


def test_vocabulary_moves_counts_alone(spark):
    plan = S.vocabulary(documents_of(spark, [(1, "a b a"), (2, "b"), (3, None)])).orderBy("term")
    assert [tuple(r) for r in plan.collect()] == [("a", 1, 2), ("b", 2, 2)]
    text = S.vocabulary(documents_of(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and "ref" not in text.split("Exchange hashpartitioning")[1].split("MapInArrow")[0]
