"""Fill-in-middle, toxicity and hard negatives on small and odd tables, against brute force and held-out rows."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewell.llm import fim, hardneg, toxicity

SCHEMA = "doc_id long, text string"


def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


# fill in the middle


def _cut(doc_id, text, how=fim.PRODUCTION):
    """n, form, prefix, middle, output by plain string functions."""
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{how.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    form = "plain" if not text or any(m in text for m in (how.prefix, how.suffix, how.middle)) or h[2] % 100 >= how.rate else "spm" if h[3] % 100 < how.spm else "psm"
    output = {"plain": text, "psm": how.prefix + prefix + how.suffix + suffix + how.middle + middle, "spm": how.suffix + suffix + how.prefix + prefix + how.middle + middle}[form]
    return n, form, None if form == "plain" else len(prefix), None if form == "plain" else len(middle), output


def _texts():
    rng = random.Random(3)
    odd = ["", None, "\n", "\n\n", "a", "no end\nlast", "ends\n", "𝄞 é\n x\r\ny\r", "<", "a <P> b\nc", "<S>", "x<M", "<<P\n>S>\n<\n", "long " * 40_000, "l\n" * 3000]
    return odd + ["".join(rng.choice(["ab", " ", "\n", "é", "𝄞", "<", "P", ">"]) for _ in range(rng.randrange(0, 60))) for _ in range(120)]


def test_cuts_match_brute_force(spark):
    rows = [(n, t) for n, t in enumerate(_texts())] + [(None, "two\nlines"), (None, None), (5, "other text\nof one id\n"), (7, "twice\nthe same\n"), (7, "twice\nthe same\n")]
    found = fim.fill_in_middle(documents(spark, rows))
    key = lambda r: (r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)
    assert Counter(map(key, found.collect())) == Counter((i, t, *_cut(i, t)) for i, t in rows)
    assert {r.form for r in found.collect()} == {"plain", "psm", "spm"}
    again = found.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert all(r.back == (r.text or "") for r in again)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    digests = {(r.doc_id, r.output_sha256, r.restored_sha256) for r in fim.report(documents(spark, rows)).collect()}
    assert digests == {(i, hashlib.sha256(_cut(i, t)[4].encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}


def test_other_formats_and_units(spark):
    how = fim.Format(prefix="[pre]", suffix="(suf)", middle=".mid.", rate=40, spm=20, seed=9)
    rows = [(n, f"line {n}\n" * (n % 9)) for n in range(200)]
    found = fim.fill_in_middle(documents(spark, rows), how)
    assert {(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found.collect()} == {(i, *_cut(i, t, how)) for i, t in rows}
    assert all(r.back == r.text for r in found.withColumn("back", fim.restored(F.col("output"), F.col("form"), how)).collect())
    words = fim.fill_in_middle(documents(spark, [(1, "one two  three ")]), fim.Format(units=r"\S+\s*")).first()
    assert words.n == 3 and words.prefix_chars + words.middle_chars <= 15


def test_fim_keeps_columns_and_empty_tables(spark):
    docs = documents(spark, [(1, "a\nb\n"), (None, None)])
    for c in ("n", "form", "output", "key", "h1", "first", "k0", "c0", "odd `name`.x"):
        docs = docs.withColumn(c, F.lit("taken"))
    found = fim.fill_in_middle(docs)
    assert found.columns[: len(docs.columns)] == docs.columns and found.columns[len(docs.columns) :] == ["n_", "form_", "prefix_chars", "middle_chars", "output_"]
    assert all(r.n == r.key == "taken" for r in found.collect()) and found.count() == 2
    assert fim.report(documents(spark, [])).collect() == []


# toxicity


def _kernel(s, t):
    """The normalised kernel by enumerating every subsequence of three letters."""

    def weights(x):
        found = Counter()
        for i, j, k in itertools.combinations(range(len(x)), 3):
            if k - i < toxicity.SPAN:
                found[x[i] + x[j] + x[k]] += toxicity.DECAY ** (k - i + 1)
        return found

    a, b = weights(s), weights(t)
    norm = lambda w: math.sqrt(sum(v * v for v in w.values()))
    return sum(v * b[u] for u, v in a.items()) / (norm(a) * norm(b)) if a and b else 0.0


def test_kernel_matches_enumeration():
    words = ["#idiot#", "#idxiot#", "#iddiiot#", "#the#", "#b?na?#", "#a#", "#wordwordwordword#"]
    found = toxicity.kernels(words, toxicity._dense(words))
    for s, t in itertools.product(range(len(words)), repeat=2):
        assert found[s, t] == pytest.approx(_kernel(words[s], words[t]), abs=1e-5)
    assert found[0, 1] > 0.4 > found[0, 3]


def test_units_of_texts():
    texts = ["An i.d-i o t, 1diot", "", "É té x y Z", "日本 語", "a b"]
    letters, unit, of = toxicity.units(texts)
    found = [(int(k), s) for k, s in zip(of, toxicity.unit_texts(letters, unit))]
    assert found == [(0, "#an#"), (0, "#idi#"), (0, "#ot#"), (0, "#diot#"), (2, "#e#"), (2, "#te#"), (2, "#xyz#"), (3, "#??#"), (3, "#?#"), (4, "#ab#")]


def _examples(n=400, seed=1):
    rng = random.Random(seed)
    syllables = ["th", "an", "er", "in", "re", "on", "at", "en", "nd", "ti", "es"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    rows = []
    for k in range(n):
        words = [word() for _ in range(rng.randrange(10, 60))]
        if k % 5 == 0:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["blorgh", "snazwick"]))
        rows.append((" ".join(words), int(k % 5 == 0)))
    return rows


def test_margins_and_altered_insults():
    model = toxicity.fit(_examples())
    score = lambda t: float(model.scores(model.margins([t])[0])[0])
    clean = "then another thing in the sand"
    for insult in ("blorgh", "SNAZWICK!", "b l o r g h", "bl-or.gh", "snáżwick"):
        assert score(f"{clean} {insult} there") >= 0.7, insult
    for altered in ("blorxgh blorrgh blorgqh", "snazzwick snazwiick snaxzwick"):
        assert score(f"{clean} {altered} there") >= 0.7, altered
    assert score(clean) < 0.3 and score("") < 0.3 and model.margins([""])[1] == [""]
    texts = [t for t, _ in _examples(60, 2)] + ["", "blorgh", "x" * 1000]
    together, shown = model.margins(texts)
    for t, margins, unit in zip(texts, together, shown):
        own, decided = model.margins([t])
        assert np.allclose(own[0], margins, atol=1e-6) and decided == [unit]
        # margins by the kernel itself, unit by unit
        letters, unit_of, _ = toxicity.units([t])
        each = [m for m in model.unit_margins(toxicity.unit_texts(letters, unit_of)) if m > toxicity.FLOOR] if len(letters) else []
        assert np.allclose(sorted(each, reverse=True)[: toxicity.TOP], [m for m in margins if m > toxicity.FLOOR], atol=1e-5)


def test_copies_are_one_group():
    bag = lambda seed: {f"w{random.Random(seed).randrange(10**6)}x{k}" for k in range(40)}
    bags = [bag(1), bag(1) | {"one"}, bag(1) | {"two"}, bag(2), set(), set()]
    groups = toxicity.near_groups(bags)
    assert groups[0] == groups[1] == groups[2] != groups[3] and len(set(groups)) == 4


def test_toxicity_held_out(spark):
    docs, marks = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    rows = toxicity.judge(docs, marks).join(marks, "doc_id").filter("held_out").collect()
    assert len(rows) > 1000 and sum(r.predicted == r.toxic for r in rows) / len(rows) > 0.96
    caught = [r.predicted for r in rows if r.toxic == 1]
    assert sum(caught) / len(caught) > 0.6 and sum(r.predicted for r in rows if r.toxic == 0) / sum(r.toxic == 0 for r in rows) < 0.008
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_toxicity_of_odd_rows(spark):
    labels = "doc_id long, quality int, toxic int"
    docs = documents(spark, [(1, "a"), (2, None), (2, None), (None, "blorgh " * 50_000), (3, "")]).withColumn("score", F.lit("taken")).withColumn("unit", F.lit("taken"))
    none = toxicity.judge(docs, spark.createDataFrame([], labels)).collect()
    assert len(none) == 5 and {r.score for r in none} == {0.0}
    one = toxicity.judge(docs, spark.createDataFrame([(3, 1, 1), (3, 1, None), (None, 1, 0), (99, 1, 0)], labels)).collect()
    assert {r.score for r in one} <= {0.0, 1.0}
    taught = [(n, t) for n, (t, _) in enumerate(_examples(600))]
    marks = spark.createDataFrame([(n, 1, y) for n, (_, y) in enumerate(_examples(600))], labels)
    found = {(r.doc_id, r.score) for r in toxicity.judge(documents(spark, [*taught, (None, "blorgh " * 50_000), (-1, None), (-1, None), (-2, "")]), marks).collect()}
    score = dict(found)
    assert len(found) == 603 and score[None] >= 0.7 and score[-1] == score[-2] < 0.3
    assert toxicity.judge(documents(spark, []), marks).collect() == []


# hard negatives


def _mined(rows, how=hardneg.PRODUCTION):
    """Every anchor against every row, in Python's integers."""
    ok = [(i, lab, [math.floor(how.scale * x) for x in v]) for i, lab, v in rows if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)]
    dims = max((len(v) for *_, v in ok), default=0)
    ok = [(i, lab, tuple(v + [0] * (dims - len(v)))) for i, lab, v in ok]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = Counter()
    for a, lab, v in {x for x in ok if x[0] % how.every == 0}:
        ranked = sorted((-dot(v, w), b, other) for b, other, w in ok)
        positives = [(b, -s) for s, b, other in ranked if other == lab and b != a][: how.partners]
        for b, p in positives:
            fits = [(c, -s) for s, c, other in ranked if other != lab and how.low * p <= -100 * s <= how.high * p]
            for rank, (c, s) in enumerate(fits[: how.negatives], 1):
                out[a, b, rank, c, p, s] += 1
    return out


def _found(spark, rows, how=hardneg.PRODUCTION):
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").withColumn("score", F.lit("taken")).withColumn("cell", F.lit(1)).withColumn("id", F.lit("x"))
    return Counter(tuple(r) for r in hardneg.mine(frame, how).collect())


def _vectors(n, dims, seed, copies=0):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims)) / math.sqrt(dims)
    v[: n // 3] += 0.4 * rng.normal(size=dims)
    if copies:
        v[-copies:] = v[-1]
    return [(int(i), int(rng.integers(0, 4)), [float(np.float32(x)) for x in row]) for i, row in enumerate(v)]


@pytest.mark.parametrize(("split", "anchors", "sample", "cells"), [(32_768, 4096, 4096, 4), (60, 3, 40, 7), (25, 1, 2, 2), (1000, 2, 600, 16)])
def test_negatives_match_brute_force(spark, monkeypatch, split, anchors, sample, cells):
    for name, value in (("SPLIT", split), ("MOST_ANCHORS", anchors), ("SAMPLE", sample), ("LEAST_CELLS", cells)):
        monkeypatch.setattr(hardneg, name, value)
    how = hardneg.Recipe(every=10)
    for rows in (_vectors(260, 6, 1), _vectors(240, 3, 2, copies=90)):
        assert _found(spark, rows, how) == _mined(rows, how)


def test_negatives_of_odd_rows(spark):
    rows = _vectors(160, 4, 5)
    rows += [(200, None, [0.1] * 4), (250, 1, None), (None, 1, [0.1] * 4), (300, 1, [0.1, None, 0.2, 0.3]), (350, 1, [float("nan"), 0.0, 0.0, 0.0]), (400, 1, [float("inf"), 0.0, 0.0, 0.0])]
    rows += [(450, 1, [0.5, 0.25]), (500, 2, []), (550, 3, [0.0] * 4), rows[50], rows[50], rows[7], rows[7], rows[8], (100, 2, [0.3, 0.3, 0.3, -0.3])]
    assert _found(spark, rows) == _mined(rows)
    assert _found(spark, [r for r in rows if r[0] is not None and r[0] % 50]) == Counter() == _found(spark, []) == _found(spark, [(50, 1, [1.0])])
    wide = [(n, n % 3, [2.0**20 * (n % 7 - 3), 2.0**22 + n, -1.0]) for n in range(0, 200, 5)]
    assert _found(spark, wide) == _mined(wide)


def test_bounds_leave_candidates_at_home(spark, monkeypatch):
    """Where vectors are clustered, a candidate goes to few groups."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 5))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = [(int(i), int(rng.integers(0, 3)), [float(np.float32(x)) for x in centres[i % 8] + 0.02 * rng.normal(size=5)]) for i in range(1600)]
    monkeypatch.setattr(hardneg, "LEAST_CELLS", 16)
    served = []
    plain = hardneg._served

    def counted(*args):
        frame = plain(*args)
        served.append((len(args[1]), frame.select(F.sum(F.octet_length("ids") / 8)).first()[0]))
        return frame

    monkeypatch.setattr(hardneg, "_served", counted)
    how = hardneg.Recipe(every=10, low=97, high=100)
    assert _found(spark, rows, how) == _mined(rows, how)
    groups, candidates = served[0]
    assert candidates < 0.5 * groups * len(rows) / 3
