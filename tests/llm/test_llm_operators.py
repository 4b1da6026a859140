"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import time
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tracewell.llm import components, decontam, exact_digest, langid, linededup, mixing, pii, quality, sharding, simhash, url_filter
from tracewell.llm.common import one_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use themselves.
CLASHES = ("fingerprint", "fp", "shard", "slot", "range", "hash", "score", "path", "epoch", "rank", "cut", "body", "spans", "found", "quality", "__passes_", "component_id", "n_class", "__passes", "__cut", "__path", "__epoch", "__hit_id", "__hit_hash", "__id", "__gone", "__head_id", "__head_hash", "__slot_part", "odd `name`.x")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in rows], SCHEMA)


def odd_documents(spark):
    """Nulls in every column, empty and white texts, a long one, ties, repeated rows, and clashing further columns."""
    words = [f"word{n % 50}" for n in range(60_000)]
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "src0"), (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "src1"),
        (3, None, None, None), (4, "", "en", "src2"), (5, " \n\t ", None, "src3"), (6, " ".join(words), "en", "src0"), (7, "Straße Ünïcode ﬁ ÉTÉ", "de", "src11"), (7, "Straße Ünïcode ﬁ ÉTÉ", "de", "src11"),
        (None, "no id here at all", "en", "src16"), (None, None, None, None), (8, "a", "fr", ""), (9, "mail me: x@y.org or 10.0.0.1", "es", "srcx"), (10, "line one\nline one\nline two", "en", "src0"),
    ]
    frame = documents(spark, rows)
    for c in CLASHES:
        frame = frame.withColumn(c, F.lit("taken"))
    return frame.withColumn("mapped", F.create_map(F.lit("k"), F.lit(1)))


def empty(spark):
    return documents(spark, []).withColumn("fingerprint", F.lit("x"))


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").withColumn("doc_id", F.lit(1))


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


EACH = {
    "mixing": lambda s, d: mixing.plan(d), "pii": lambda s, d: pii.find(d), "sharding": lambda s, d: sharding.shard_documents(d), "lines": lambda s, d: linededup.dedup_report(d),
    "langid": lambda s, d: langid.identify(d), "decontam": lambda s, d: decontam.contamination(d, items(s, [(1, "quick brown fox jumps over the lazy dog near the river")])),
    "quality": lambda s, d: quality.judge(d, labels(s, [(1, 1, 0), (4, 0, 0), (None, 1, None), (99, 1, 0)])), "simhash": lambda s, d: simhash.near_duplicates(d), "digest": lambda s, d: exact_digest.compare(d),
}


@pytest.mark.parametrize("name", EACH)
def test_odd_rows_give_a_row_each(spark, name):
    found = EACH[name](spark, odd_documents(spark)).collect()
    if name == "mixing":
        assert {r.domain for r in found} <= {"web", "books", "code", "unknown"}
    elif name == "lines":
        assert len(found) == 11
    else:
        assert len(found) == 13
    again = EACH[name](spark, odd_documents(spark)).collect()
    assert Counter(map(str, found)) == Counter(map(str, again))


@pytest.mark.parametrize("name", EACH)
def test_empty_tables_give_empty_results(spark, name):
    assert EACH[name](spark, empty(spark)).collect() == []


@pytest.mark.parametrize("stage", ["keep_good", "keep_first", "without_contaminated", "select", "without_repeated_lines"])
def test_stages_keep_all_columns(spark, stage):
    docs = odd_documents(spark)
    run = {
        "keep_good": lambda d: quality.keep_good(d, labels(spark, [(1, 1, 0)])), "keep_first": simhash.keep_first, "without_contaminated": lambda d: decontam.without_contaminated(d, items(spark, [(1, "quick brown fox jumps over the lazy dog near the river")])),
        "select": mixing.select, "without_repeated_lines": linededup.without_repeated_lines,
    }[stage]
    kept = run(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert rows and all(r.shard == "taken" for r in rows)
    assert run(empty(spark)).collect() == []
    if stage == "without_contaminated":
        assert {1, 2}.isdisjoint(r.doc_id for r in rows) and len(rows) == 11
    if stage == "keep_first":
        ids = [r.doc_id for r in rows]
        assert 1 in ids and 2 not in ids and ids.count(7) == 1 and ids.count(None) == 1  # the null text of a null id is a copy of document 3


def test_first_of_a_component_by_id_and_text(spark):
    a, b = (" ".join(f"{c}{n}" for n in range(60)) for c in "ab")
    rows = [(1, a, "en", "s"), (1, b, "en", "s"), (None, a, None, None), (2, b, "en", "s"), (2, b, "de", "t"), (None, "x y z", None, None), (None, "x y z", None, None)]
    kept = simhash.keep_first(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(1, a), (1, b), (None, "x y z")])


def test_working_names_avoid_columns():
    assert one_of("a", ["A", "a_", "b"]) == "a__"


# mixing


def test_budgets_fill_siblings_before_ancestors():
    recipe = mixing.Recipe(weights={("a",): 0.5, ("b",): 0.5, ("a", "x"): 0.5, ("a", "y"): 0.5, ("b", "z"): 1.0}, total=1000, max_epochs=1, levels=mixing.PRODUCTION.levels[:2])
    have = {("a", "x"): 100, ("a", "y"): 600, ("b", "z"): 900}
    assert mixing.budgets(have, recipe) == {("a", "x"): 100, ("a", "y"): 400, ("b", "z"): 500}
    have[("a", "y")] = 150
    assert mixing.budgets(have, recipe) == {("a", "x"): 100, ("a", "y"): 150, ("b", "z"): 750}
    assert sum(mixing.budgets({("a", "x"): 7, ("a", "y"): 5, ("b", "z"): 3}, recipe).values()) == 15


def test_unlisted_children_have_their_share_of_tokens():
    have = {(d, lang, d): 250 for d in ("web", "books", "code") for lang in ("en", "de", "fr", "es")} | {("web", "unknown", "web"): 500, ("unknown", "en", "blog"): 500}
    found = mixing.budgets(have, mixing.PRODUCTION)
    assert sum(found.values()) == sum(have.values()) == 4000 and found["unknown", "en", "blog"] == 500
    web = {lang: n for (d, lang, _), n in found.items() if d == "web"}
    assert abs(sum(web.values()) - 3500 * 0.55) <= 1 and abs(web["unknown"] - sum(web.values()) / 3) <= 1
    assert mixing.shares({("a",): 1, ("b",): 3, ("c",): 1}, {("a",): 0.6}) == {("a",): 0.6, ("b",): pytest.approx(0.3), ("c",): pytest.approx(0.1)}


def test_mixing_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(n, " ".join("w" for _ in range(rng.randrange(0, 30))), rng.choice(["en", "de", "fr", None]), f"src{rng.randrange(20)}") for n in range(600)]
    found = Counter((r.doc_id, r.epoch) for r in mixing.plan(documents(spark, rows)).collect())
    domain = lambda s: "web" if int(s[3:]) < 10 else "books" if int(s[3:]) < 15 else "code"
    leaves: dict = {}
    for i, t, lang, src in rows:
        leaves.setdefault((domain(src), lang or "unknown", src), []).append((i, len(t.split())))
    have = {p: sum(n for _, n in d) for p, d in leaves.items()}
    asked = mixing.budgets(have, mixing.PRODUCTION)
    sent = {(r.seed, r.epoch, r.doc_id): r.h for r in spark.createDataFrame([(mixing.SEED, e, i) for i in range(600) for e in range(5)], "seed int, epoch int, doc_id long").selectExpr("*", "shiftrightunsigned(xxhash64(seed, epoch, doc_id), 1) AS h").collect()}
    expected: Counter = Counter()
    for p, docs in leaves.items():
        if not have[p]:
            continue
        whole, rest = divmod(asked[p], have[p])
        for i, _ in docs:
            expected.update((i, e) for e in range(whole))
        taken = 0
        for h, i, n in sorted((sent[mixing.SEED, whole, i], i, n) for i, n in docs):
            if taken >= rest:
                break
            expected[i, whole] += 1
            taken += n
    assert found == expected


# personal data


def test_base_spans():
    text = "a@b.co x@y c.d@e-f.org 1.2.3.256 1.2.3.4 4111 1111-1111 1111 4111 1111 1111 1112 +1 (234) 567-8901 +12 34 é +49 30 1234567"
    good, failed = pii.base_spans(text)
    assert [(k, text[a:b]) for k, a, b in good] == [("email", "a@b.co"), ("email", "c.d@e-f.org"), ("ip", "1.2.3.4"), ("phone", "+1 (234) 567-8901"), ("phone", "+49 30 1234567")]
    assert ("ip", "1.2.3.256") in [(k, text[a:b]) for k, a, b in failed]
    assert pii.base_spans("4111 1111-1111 1111")[0] == [("card", 0, 19)]


def test_pii_finds_base_and_adds_secrets(spark):
    rows = [(n, f"The password=hunter{n}x here and mail u{n}@example.org, token = \"9f8e7d6c5b4a39281706f5e4d3c2b1a0\"", "en", "s") for n in range(40)] + [(99, "Nothing to see, version 1.2 of page 345", "en", "s"), (100, "card 4111111111111112 fails", "en", "s")]
    found = {r.doc_id: r for r in pii.find(documents(spark, rows)).collect()}
    assert found[0].n_email == 1 and "email:" in found[0].spans and "secret:" in found[0].spans
    a = rows[0][1].index("u0@")
    assert found[0].base_sha256 == hashlib.sha256(f"email:{a}:{a + len('u0@example.org')}".encode()).hexdigest()
    for n in (99, 100):
        assert found[n].spans == "" and found[n].base_sha256 == hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("found", ["jane.doe [at] example [dot] com", "jane(AT)example(DOT)com"])
def test_loose_addresses_without_digits_are_candidates(found):
    rows = pii.candidates(f"write to {found} now")[1]
    assert [(r[0], f"write to {found} now"[r[1] : r[2]]) for r in rows] == [("email", f"write to {found}"[9:])]


@pytest.mark.parametrize("name", ["password", "passwd", "pwd", "secret", "token"])
def test_secrets_without_digits_are_candidates_in_any_case(name):
    for said in (name, name.upper(), name.title()):
        text = f"set {said}=hunterhunter now"
        assert [(r[0], text[r[1] : r[2]]) for r in pii.candidates(text)[1]] == [("secret", "hunterhunter")]


def test_texts_past_the_gate_have_no_form():
    texts = ["", "plain words", "password: hunter", "a.b.c at d dot e", "+ - / _ ]) {at}", "DE GB secret token pwd"]
    forms = [*pii.BASE.values(), *pii.LOOSE.values()]
    assert not any(pii.SIGN.search(t) or f.search(t) for t in texts for f in forms)
    assert all(pii.SIGN.search(t) for t in ("a@b.co", "1.2.3.4", "x (at) y (dot) z", "x [AT] y [DOT] z", "\u017fecret=abcdef"))


def test_base_matches_are_those_of_the_plain_forms():
    rng = random.Random(8)
    for _ in range(3000):
        text = "".join(rng.choice(["a", "1", "23", ".", "@", "_", "-", " ", "+", "%", "a@b.c", "1.2.3.4"]) for _ in range(rng.randrange(0, 24)))
        for kind, form in pii.BASE.items():
            assert list(pii.base_matches(kind, text)) == [m.span() for m in form.finditer(text)], (kind, text)


@pytest.mark.parametrize("text", ["7" * 1_000_000, "a" * 1_000_000, "a@" * 300_000, "1." * 300_000, "a.b [" * 100_000, "4111 1111 1111 1111, " * 20_000], ids=["digits", "letters", "ats", "dots", "brackets", "cards"])
def test_long_runs_are_searched_in_linear_time(text):
    began = time.time()
    pii.candidates(text)
    assert time.time() - began < 15


def test_taken_intervals():
    rng = random.Random(3)
    for _ in range(300):
        spans = [(a, a + rng.randrange(1, 6)) for a in (rng.randrange(30) for _ in range(rng.randrange(6)))]
        taken = pii.Taken(spans)
        for a in range(36):
            for b in range(a + 1, 37):
                assert taken.touches(a, b) == any(x < b and a < y for x, y in spans)


def test_added_spans_of_the_table_are_what_it_plants(spark):
    """The small table plants tokens of 40 hex digits: nearly all get a span, and nearly all added spans hold one."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pii.find(docs).join(docs.select("doc_id", "text"), "doc_id").collect()
    said = {(r.doc_id, *map(int, s.split(":")[1:])) for r in rows for s in r.spans.split(",") if s.split(":")[0] not in (*pii.BASE, "")}
    planted = {(r.doc_id, *m.span(1)) for r in rows for m in re.finditer(r'token = "([0-9a-f]{40})"', r.text or "")}
    assert len(planted) >= 10 and len(planted & said) / len(planted) >= 0.9 and len(planted & said) / len(said) >= 0.8
    clean = [r for r in rows if not re.search(r"[0-9@=]", r.text or "")]
    assert len(clean) > 500 and all(r.spans == "" for r in clean)


# URLs


def _grams(host, path):
    for kind, s in (("h", host), ("p", path)):
        s = f"\x02{kind}{s}\x03"
        for n in url_filter.SIZES:
            for i in range(max(1, len(s) - n + 1)):
                h = xxhash.xxh64_intdigest(s[i : i + n].encode(), 42)
                yield (h - (1 << 64) if h >> 63 else h) % url_filter.BUCKETS


def test_urls_match_a_plain_implementation(spark):
    model = url_filter.train(spark)
    urls = ["http://A.Example.NET/en/x?y#z", "https://example.com/de/1", "http://org/fr/", "http://xorg/fr/", "http://net", "net/", None, "", "http://a.net/?x", "http://spam-farm.example.org/en/1", "http://thering.example.org/es/3", "ftp://u:p@h.com:80/p/q", "http://é.example.net/de/"]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("x")).withColumn("html", F.lit(None).cast("string"))
    found = {r.page_id: r for r in url_filter.judge(frame, model).collect()}
    for n, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(said, h, p) for said, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        grams = list(_grams(host, path))
        p = 1 / (1 + math.exp(-(sum(model.weights[g] for g in grams) / math.sqrt(len(grams)) + model.bias)))
        r = found[n]
        assert (r.host, r.path, r.rule) == (host, path, best and best[1] + best[2])
        assert r.p_block == pytest.approx(p, abs=1e-9)
        assert r.verdict == (best[0] if best else "block" if p >= 0.5 else "allow")
    assert found[9].verdict == "block" and found[10].verdict == "allow"
    assert url_filter.judge(frame.limit(0), model).collect() == []
    assert url_filter.train(spark, ()).bias == 0


def test_url_training_separates_its_table(spark):
    model = url_filter.train(spark)
    frame = spark.createDataFrame([(n, u) for n, (u, _) in enumerate(url_filter.LABELLED)], "page_id long, url string")
    said = {r.page_id: r.p_block >= 0.5 for r in url_filter.judge(frame, model).collect()}
    assert all(said[n] == bool(y) for n, (_, y) in enumerate(url_filter.LABELLED))


# sharding


def _xx(spark, rows):
    return {tuple(r)[:3]: r.h for r in spark.createDataFrame(rows, "seed int, id int, key string").selectExpr("*", "xxhash64(seed, id, key) AS h").collect()}


def test_shards_match_a_plain_descent(spark):
    rows = [(n, f"text {n % 7}", "en", "s") for n in range(400)]
    found = {r.doc_id: r for r in sharding.shard_documents(documents(spark, rows)).collect()}
    hashes = _xx(spark, [(sharding.SEED, i, f"={n}") for n in range(400) for i in range(25)])

    def place(n, tree):
        draw = lambda c: (math.log((((hashes[sharding.SEED, c[0], f"={n}"] % (1 << 64)) >> 11) + 0.5) / (1 << 53)) / c[1], -c[0])
        rack = lambda r: max(map(draw, tree.leaves[r[0]]))
        region = max(tree.regions, key=lambda g: max(map(rack, tree.racks[g[0]])))
        return max(tree.leaves[max(tree.racks[region[0]], key=rack)[0]], key=draw)[0]

    for n in range(400):
        assert found[n].shard == place(n, sharding.tree_for(24)) and found[n].grown_shard == place(n, sharding.tree_for(25))
        assert found[n].grown_shard in (found[n].shard, 24)
        assert found[n].size == len(rows[n][1]) + 8 and found[n].text_crc32 == zlib.crc32(rows[n][1].encode())
    for shard in range(24):
        slots = sorted(r.slot for r in found.values() if r.shard == shard)
        assert slots == list(range(len(slots)))


@pytest.mark.parametrize("n", [1, 5, 10, 20, 25])
def test_one_shard_more_takes_rows_only_into_itself(spark, n):
    rows = sharding.shard_documents(documents(spark, [(k, "x", None, None) for k in range(600)]), shards=n).collect()
    assert all(r.grown_shard in (r.shard, n) for r in rows) and any(r.grown_shard == n for r in rows) and max(r.shard for r in rows) < n
    wider = {r.doc_id: r.shard for r in sharding.shard_documents(documents(spark, [(k, "x", None, None) for k in range(600)]), shards=n + 1).collect()}
    assert wider == {r.doc_id: r.grown_shard for r in rows}


def test_slots_of_copies_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(sharding, "COPIES", 16)
    rows = [(7, "same", None, None)] * 90 + [(None, None, None, None)] * 50 + [(n, str(n), None, None) for n in range(40)]
    found = sharding.shard_documents(documents(spark, rows), shards=3).collect()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((i, 8 + len(t or "")) for i, t, *_ in rows)
    for shard in range(3):
        own = [r.slot for r in found if r.shard == shard]
        assert sorted(own) == list(range(len(own)))


def test_weights_confine_movement(spark):
    docs = spark.range(3000).withColumnRenamed("id", "doc_id")
    place = lambda w, to: sharding.with_shard(docs, F.col("doc_id"), sharding.tree_for(24, w), to)
    rows = place(None, "a").join(place({3: 3.0}, "b"), "doc_id").filter("a <> b").collect()
    assert rows and all(r.b == 3 for r in rows)
    less = place(None, "a").join(place({3: 0.2, 4: 0.0}, "b"), "doc_id").filter("a <> b").collect()
    assert less and all(r.a in (3, 4) and r.b != 4 for r in less)
    share = {s: place(None, "a").filter(F.col("a").between(8 * s, 8 * s + 7)).count() / 3000 for s in range(3)}
    assert all(0.28 < x < 0.39 for x in share.values())
    heavy = place({3: 3.0}, "b").filter("b = 3").count()
    assert heavy > 2 * place(None, "a").filter("a = 3").count()


# lines


def _words(line):
    return set(re.split(r"[ \t\r\x0b\f]", line)) - {""}


def _removed(rows):
    lines = [(i, n, x) for i, t, *_ in rows if t is not None for n, x in enumerate(t.split("\n"))]
    out = {i: [] for i, *_ in rows}
    for i, n, x in lines:
        a = _words(x)
        if a and any((j, m) < (i, n) and _words(y) and 5 * len(a & _words(y)) >= 4 * len(a | _words(y)) for j, m, y in lines):
            out[i].append(n)
    return {i: ",".join(map(str, sorted(x))) for i, x in out.items()}


@pytest.mark.parametrize(("hot", "most"), [(linededup.HOT, linededup.MOST_POSTINGS), (3, linededup.MOST_POSTINGS), (3, 20), (linededup.HOT, 20)])
def test_lines_match_brute_force(spark, monkeypatch, hot, most):
    monkeypatch.setattr(linededup, "HOT", hot)
    monkeypatch.setattr(linededup, "MOST_POSTINGS", most)
    rng = random.Random(hot)
    base = [" ".join(rng.choice("abcdefghij") * rng.randrange(1, 4) for _ in range(rng.randrange(1, 14))) for _ in range(12)]
    rows = []
    for n in range(60):
        text = []
        for _ in range(rng.randrange(0, 5)):
            w = rng.choice(base).split()
            for _ in range(rng.randrange(0, 3)):
                w[rng.randrange(len(w))] = rng.choice("xyzuvw") * rng.randrange(1, 3)
            text.append(rng.choice(["  ", ""]) + " ".join(w))
        rows.append((n, None if n == 5 else "\n".join(text), "en", "s"))
    found = {r.doc_id: r.removed for r in linededup.dedup_report(documents(spark, rows)).collect()}
    assert found == _removed(rows)


@pytest.mark.parametrize(("hot", "most"), [(linededup.HOT, linededup.MOST_POSTINGS), (2, linededup.MOST_POSTINGS), (2, 6)])
def test_lines_of_null_and_repeated_ids_match_brute_force(spark, monkeypatch, hot, most):
    """Several texts in one place: each line is compared with what it is itself."""
    monkeypatch.setattr(linededup, "HOT", hot)
    monkeypatch.setattr(linededup, "MOST_POSTINGS", most)
    fixed = [(None, "aa bb cc dd ee"), (None, "v w x y z"), (5, "v w x y z q"), (6, "aa bb cc dd ee ff"), (6, "m n o p q\nm n o p q"), (6, "k\nm n o p q r")]
    rng = random.Random(hot)
    base = ["a b c d e f", "g h i j k l", "a b c d e g", "h i j k l m n o"]
    line = lambda: " ".join(w if rng.random() < 0.9 else rng.choice("xyz") for w in rng.choice(base).split())
    drawn = [(rng.choice([None, 1, 1, 2, 3, 9]), "\n".join(line() for _ in range(rng.randrange(1, 4)))) for _ in range(25)]
    for rows in (fixed, drawn):
        lines = [(-(10**9) if i is None else i, n, x) for i, t in rows for n, x in enumerate(t.split("\n"))]
        close = lambda x, y: 5 * len(_words(x) & _words(y)) >= 4 * len(_words(x) | _words(y))
        gone = {(i, n, x) for i, n, x in lines if any((j, m) < (i, n) and close(x, y) for j, m, y in lines)}
        frame = documents(spark, [(i, t, None, None) for i, t in rows])
        marked = linededup.marked_lines(frame).groupBy("doc", "line").agg(F.count_if("gone").alias("n")).collect()
        expected = Counter((i, n) for i, n, x in lines if (i, n, x) in gone)
        assert {(-(10**9) if r.doc == linededup.NO_ID else r.doc, r.line): r.n for r in marked if r.n} == expected


def _matched(lines, frequent=1 << linededup.CODE_BITS, rarest=()):
    ranks = np.arange(linededup.BUCKETS, dtype=np.uint32)
    for word in rarest:
        ranks[int(linededup.word_hashes(word.encode())[0][0]) >> (64 - linededup.BUCKET_BITS)] = 0
    keys = [linededup._signed(xxhash.xxh3_128_intdigest(x.encode()) >> 64) for x in lines]
    found = linededup.prefixes([x.encode() for x in lines], keys, ranks, frequent)
    found = found[np.argsort(found["code"], kind="stable")]
    table = linededup.match(pa.table({"shard": [0], "data": [linededup.packed(found)]}), linededup.HOT, linededup.MOST_POSTINGS)
    pairs = {tuple(sorted((keys.index(r["a"]), keys.index(r["b"])))) for r in table.to_pylist() if r["b"] is not None}
    return pairs, sum(r["b"] is None for r in table.to_pylist()), found


def _unlike(rng, n, size, shared=()):
    return [" ".join([*shared, *(f"w{rng.randrange(10**9)}" for _ in range(size - len(shared)))]) for _ in range(n)]


def test_long_lines_that_share_a_few_words_are_no_candidates():
    lines = _unlike(random.Random(1), 60, 200, [f"common{k}" for k in range(40)])
    near = lines[0].rsplit(" ", 15)[0] + " other"
    pairs, hot, _ = _matched([*lines, near])
    assert pairs == {(0, 60)} and not hot


def test_words_of_many_lines_are_compared_in_their_shard_and_groups_of_copies_go_apart():
    """A word that 600 unlike lines share gives no rows of its own; 200 near copies give a row for each word, no square of pairs."""
    rng = random.Random(2)
    pairs, hot, found = _matched(_unlike(rng, 600, 9, ["the", "of"]), rarest=["the", "of"])
    assert max(Counter(found["code"].tolist()).values()) == 600 and len(pairs) < 10 and not hot
    text = _unlike(rng, 1, 30)[0]
    pairs, hot, _ = _matched([f"{text} x{k}" for k in range(200)])
    assert 0 < hot <= 200 * 7 and len(pairs) <= linededup.HOT * 200


@pytest.mark.parametrize("share", [0, 0.3, 0.9])
def test_frequent_words_meet_by_pairs_and_lose_no_link(share):
    rng = random.Random(7)
    frequent = int((1 << linededup.CODE_BITS) * share)
    words = [f"w{k}" for k in range(60)]
    lines = sorted({" ".join(rng.sample(words, rng.randrange(1, 25))) for _ in range(150)})
    for x in list(lines):
        own = x.split()
        own[rng.randrange(len(own))] = rng.choice(words)
        lines.append(" ".join(rng.sample(own, len(own))) + rng.choice(["", " extra"]))
    lines = sorted(set(lines))
    similar = {(i, j) for j in range(len(lines)) for i in range(j) if linededup.similar(lines[i].encode(), lines[j].encode())}
    pairs, hot, _ = _matched(lines, frequent)
    assert len(similar) > 50 and not hot and similar <= pairs


def test_texts_of_candidates_are_read_in_place(spark):
    """Every wanted line comes, from its place, and the table of documents isn't shuffled for it."""
    docs = documents(spark, [(i, f"one {i}\n\ntwo {i} é" if i % 5 else None, None, None) for i in range(300)])
    wanted = linededup.classes_of(linededup.lines_of(linededup.survey(docs))).filter("doc % 3 = 0 AND line = 2")
    found = linededup.bodies_of(docs, wanted)
    assert "Exchange" not in found._jdf.queryExecution().toString()
    expected = {f"two {i} é" for i in range(300) if i % 5 and i % 3 == 0}
    bodies = {bytes(r.body).decode() for r in found.collect()}
    assert expected <= bodies and len(bodies) < len(expected) + 30


@pytest.mark.parametrize(("hot", "most"), [(linededup.HOT, linededup.MOST_POSTINGS), (1, 2)])
def test_candidates_are_put_in_order_without_comparing_structs(spark, monkeypatch, hot, most):
    """Comparisons of structs are long methods, whose compilation took hundreds of MB of an executor beside its heap."""
    monkeypatch.setattr(linededup, "HOT", hot)
    monkeypatch.setattr(linededup, "MOST_POSTINGS", most)
    docs = documents(spark, [(k, f"a b c d e f g h i j k {k}\nanother line {k}", None, None) for k in range(30)])
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the whole plan is there before it runs
    try:
        surveyed = linededup.survey(docs)
        gone = linededup.removed_classes(docs, linededup.bucket_counts(surveyed), linededup.classes_of(linededup.lines_of(surveyed)))
        stages = gone._jdf.queryExecution().debug().codegenToSeq()
        code = [stages.apply(k)._2() for k in range(stages.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert gone.count() == 29
    assert code and not any("compareStruct" in x for x in code)


def test_every_word_is_counted_once_however_many_a_task_has(spark):
    """More words in one task than a worker keeps uncounted, and a last few after them."""
    text = " ".join(f"w{k}" for k in range(2000))
    docs = documents(spark, [(k, text, None, None) for k in range(300)] + [(300, "only here", None, None), (301, None, None, None)]).coalesce(1)
    counts = linededup.bucket_counts(linededup.survey(docs))
    expected = Counter({w: 300 for w in text.split()}) + Counter({"only": 1, "here": 1})
    of = lambda w: int(linededup.word_hashes(w.encode())[0][0]) >> (64 - linededup.BUCKET_BITS)
    buckets = Counter()
    for w, n in expected.items():
        buckets[of(w)] += n
    assert 300 * 2000 > linededup.KEPT_WORDS and {int(k): int(counts[k]) for k in np.flatnonzero(counts)} == buckets


def test_session_keeps_its_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    linededup.marked_lines(documents(spark, [(1, "a b", None, None)])).collect()
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


# language


def test_language_filters():
    rng = random.Random(1)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(80))
    kinds = {"aa": ["tion", "the", "ing", "er"], "bb": ["ung", "sch", "keit", "ei"], "cc": ["ció", "mente", "ado", "que"]}
    filters = langid.fit([(make(p), lang) for lang, p in kinds.items() for _ in range(20)])
    for lang, parts in kinds.items():
        assert filters.predict(make(parts))[0] == lang
    mask = filters.languages_of(langid.grams(langid.codes_of("keitung"), 3)[0])
    assert all(int(m) >> 1 & 1 for m in mask[1:-1, 0])
    assert filters.predict("12 34 !") == ("und", 0.0) and filters.predict(None) == ("und", 0.0) and filters.predict("") == ("und", 0.0)
    assert langid.fit([]).predict("abc") == ("und", 0.0)
    long = make(kinds["bb"]) * 4000
    assert len(long) > langid.PIECE and filters.predict(long)[0] == "bb"


def test_more_languages_than_a_word_has_bits():
    rng = random.Random(2)
    letters = [chr(0x4E00 + n) for n in range(20 * 70)]
    make = lambda n: " ".join("".join(rng.choice(letters[20 * n : 20 * n + 20]) for _ in range(5)) for _ in range(60))
    filters = langid.fit([(make(n), f"l{n:02}") for n in range(70) for _ in range(3)])
    assert len(filters.languages) == 70 and all(filters.predict(make(n))[0] == f"l{n:02}" for n in range(70))


def test_languages_are_learned_from_tables_as_from_texts(spark):
    """A language of copies of one row is learned; counts on the executors make the same filters."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    copies = spark.range(1000).select(F.lit(1000).cast("long").alias("doc_id"), F.lit("żółć gęślą jaźń wszystkich językach").alias("text"), F.lit("pl").alias("lang"))
    rows = docs.unionByName(copies)
    trained, plain = langid.train(rows), langid.fit([(r.text, r.lang) for r in langid.sample(rows).collect()])
    assert "pl" in trained.languages and trained.predict("wszystkich językach jaźń")[0] == "pl"
    assert trained.languages == plain.languages and (trained.slots == plain.slots).all() and (trained.rates == plain.rates).all()


def test_language_accuracy_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 for r in rows) and all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)


# decontamination


def _windows(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return w, [tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))] if w else []


def test_decontamination_matches_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "a", "É", "x1", "foo", "bar", "baz", "qux"])
    bench = [(1, " ".join(word() for _ in range(14))), (2, "Foo-bar BAZ"), (3, None), (4, "..."), (None, "qux qux qux qux"), (5, " ".join(word() for _ in range(10)))]
    rows = [(n, " ".join([word() for _ in range(rng.randrange(0, 40))] + (rng.choice(bench)[1] or "").split() + [word() for _ in range(5)]), "en", "s") for n in range(80)] + [(200, None, None, None), (201, "", None, None)]
    expected = {}
    for i, t, *_ in rows:
        w, _ = _windows(t)
        hit, owners = set(), set()
        for item, text in bench:
            for win in _windows(text)[1]:
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit.update(range(k, k + len(win)))
                        if item is not None:
                            owners.add(str(item))
        expected[i] = (len(w), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), bool(hit))
    for block in (decontam.BLOCK_BYTES, 40):
        monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
        found = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.contamination(documents(spark, rows), items(spark, bench)).collect()}
        assert found == expected
    assert decontam.contamination(documents(spark, rows), items(spark, [])).filter("contaminated").count() == 0


def test_small_segments_and_proximity(spark, monkeypatch):
    monkeypatch.setattr(decontam, "SEGMENT_WORDS", 30)
    rows = [(n, f"alpha beta {'x ' * (n % 4)}gamma delta", "en", "s") for n in range(20)]
    near = decontam.proximity(documents(spark, rows), items(spark, [(1, "alpha beta gamma delta")]), 4, 2)
    assert {r.doc_id for r in near.collect()} == {n for n in range(20) if n % 4 <= 2}
    exact = decontam.contamination(documents(spark, rows), items(spark, [(1, "alpha beta gamma delta")])).filter("contaminated")
    assert {r.doc_id for r in exact.collect()} == {n for n in range(20) if n % 4 == 0}


def test_index_of_all_terms(spark):
    index = decontam.build_index(documents(spark, [(1, "b a b", None, None), (2, None, None, None)])).collect()
    assert sum(sum(r.counts) for r in index) == 3 and sum(len(r.doc_ids) for r in index) == 2


# quality


def test_quality_accuracy_held_out(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    rows = quality.judge(docs, marks).join(marks, "doc_id").filter("held_out").collect()
    assert len(rows) > 1000 and sum(r.predicted == r.quality for r in rows) / len(rows) > 0.98
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_quality_without_two_kinds_of_labels(spark):
    docs = documents(spark, [(1, "a", None, None), (2, None, None, None)])
    assert {r.score for r in quality.judge(docs, labels(spark, [])).collect()} == {0.5}
    assert {r.score for r in quality.judge(docs, labels(spark, [(2, 1, 0), (2, None, 0)])).collect()} <= {0.5, 1.0}


def test_temperature_lowers_confidence_of_wrong_logits():
    z, y = np.array([4.0, 4.0, 4.0, -4.0]), np.array([1.0, 1.0, 0.0, 0.0])
    assert quality._temperature(z, y) > 1 > quality._temperature(np.array([1.0, -1.0] * 9), np.array([1.0, 0.0] * 9))


# SimHash


def _fingerprint(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w)] if len(w) < k else [" ".join(w[n : n + k]) for n in range(len(w) - k + 1)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_match_brute_force(spark):
    texts = [None, "", "One", "a b c d", "É\x0bÈ x y Z z", " ".join(f"w{n % 97}" for n in range(70_000)), "A b\tc d e f g"]
    found = {r.doc_id: r.fingerprint for r in simhash.near_duplicates(documents(spark, [(n, t, None, None) for n, t in enumerate(texts)])).collect()}
    assert found == {n: f"{_fingerprint(t):016x}" for n, t in enumerate(texts)}


@pytest.mark.parametrize("leaf", [(1024, 4096), (8, 16)])
def test_links_match_brute_force(spark, monkeypatch, leaf):
    monkeypatch.setattr(simhash, "LEAF", leaf[0])
    monkeypatch.setattr(simhash, "LEAF_CAP", leaf[1])
    monkeypatch.setattr(simhash, "SAMPLE_PART", 1)
    rng = np.random.default_rng(2)
    points = list(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    for p in points[:60]:
        for _ in range(6):
            p = p ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
            points.append(p)
    points = np.unique(np.array(points, np.uint64))
    frame = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.links(frame)).collect()}
    parent = list(range(len(points)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(points)):
        for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= 4):
            parent[find(int(j))] = find(i)
    ids = [int(x) for x in points.view(np.int64)]
    groups: dict = {}
    for i, x in enumerate(ids):
        groups.setdefault(find(i), []).append(x)
    for members in groups.values():
        assert len({roots.get(m, m) for m in members}) == 1
    assert len({roots.get(x, x) for x in ids}) == len(groups)


def test_components_of_a_path_and_loops(spark):
    edges = [(n, n + 1) for n in range(200)] + [(500, 501), (501, 500), (7, 7), (None, 3)]
    found = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {n: 0 for n in range(201)} | {500: 500, 501: 500}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


# exact digests


def _canonical(text):
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return re.sub(r"[\t\n\v\f\r \u0085   -     　]+", " ", folded).strip(" ")


def test_digests_match_brute_force(spark):
    texts = ["Ab  c", "ab c", " AB\nC ", "ﬁne", "FINE", "Straße", "STRASSE", "é", "é", None, "", "ab cd", "x" * 50_000, " a b"]
    rows = [(n, t, None, None) for n, t in enumerate(texts)]
    found = {r.doc_id: r for r in exact_digest.compare(documents(spark, rows)).collect()}
    digest = lambda s: "{:016x}".format(xxhash.xxh64_intdigest(s.encode(), 42))
    for n, t in enumerate(texts):
        t = t or ""
        after = texts[n - 1 if n else len(texts) - 1] or ""
        third = len(t) // 3
        edit = t[: len(t) - third] + after[:third]
        r = found[n]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edit.encode()).hexdigest())
        assert r.fingerprint[:16] == digest(_canonical(t)) and r.edited_fingerprint[:16] == digest(_canonical(edit)) and len(r.fingerprint) == 32
        assert r.near_edited == float(_canonical(edit) == _canonical(t)) and r.near_next == float(_canonical(after) == _canonical(t))
        same = [m for m, o in enumerate(texts) if _canonical(o) == _canonical(t)]
        assert (r.class_doc_id, r.n_class) == (min(same), len(same))


def test_colliding_hashes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_digest, "wide_hash", lambda canon: F.substring(canon, 1, 1))
    rows = [(1, "ab", None, None), (2, "ac", None, None), (3, "AB", None, None), (4, "b", None, None)]
    found = {r.doc_id: r for r in exact_digest.fingerprints(documents(spark, rows)).collect()}
    assert found[1].fingerprint == found[3].fingerprint == found[2].fingerprint == "a"  # a fingerprint depends on its text alone
    assert (found[3].class_doc_id, found[3].n_class, found[2].class_doc_id, found[2].n_class, found[4].fingerprint) == (1, 2, 2, 1, "b")
    compared = {r.doc_id: r for r in exact_digest.compare(documents(spark, rows)).collect()}
    assert {i: (r.fingerprint, r.class_doc_id, r.n_class) for i, r in compared.items()} == {i: (r.fingerprint, r.class_doc_id, r.n_class) for i, r in found.items()}
    assert compared[3].near_next == 0.0 and {r.edited_fingerprint for r in compared.values()} <= {"a", "b"}


def test_next_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(exact_digest, "ROWS_IN_RANGE", 7)
    ids = random.Random(4).sample(range(-5000, 5000), 300)
    found = {r.doc_id: r.next_text for r in exact_digest.with_next(documents(spark, [(i, f"t{i}", None, None) for i in ids]).select("doc_id", "text"), ["text"]).collect()}
    order = sorted(ids, reverse=True)
    assert found == {i: f"t{order[(k + 1) % len(order)]}" for k, i in enumerate(order)}


def test_word_hashes():
    h, line = linededup.word_hashes("a bb\ta\r\n\n\x0bbb é".encode())
    assert line.tolist() == [0, 0, 0, 2, 2] and h[0] == h[2] != h[1] == h[3] and len(set(h.tolist())) == 3
    assert len(linededup.word_hashes(b"")[0]) == len(linededup.word_hashes(b" \n ")[0]) == 0
    long = [f"w{n}" for n in range(5000)]
    assert len(set(linededup.word_hashes(" ".join(long * 2).encode())[0].tolist())) == 5000


@pytest.mark.parametrize(("a", "b", "same"), [(b"a b c d e", b"e d c b a", True), (b"a b c d e", b"a b c d", True), (b"a b c d", b"a b c", False), (b"a a a", b"a", True)])
def test_similar_lines(a, b, same):
    assert linededup.similar(a, b) == same
