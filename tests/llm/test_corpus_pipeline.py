"""The pipeline's stages against plain versions of what they keep."""

import re

import __spark_entry__
import corpus_pipeline
from tracewell.llm import mixing, quality, simhash

SF = "/root/testdata/sf0.01"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, kept[-1], SF)
        kept.append(spark.createDataFrame(rows.collect(), rows.schema))
    assert all(k.columns == columns for k in kept[:-1])
    good, alone, clean, mixed, shards = ([r.asDict() for r in k.collect()] for k in kept[1:])

    scores = {r.doc_id: r.score for r in quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r["doc_id"] for r in good} == {i for i, s in scores.items() if s >= 0.5}

    component = {r.doc_id: r.component_id for r in simhash.near_duplicates(kept[1]).collect()}
    assert sorted(r["doc_id"] for r in alone) == sorted(set(component.values()))
    assert len({r["text"] for r in alone}) == len(alone)

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    windows = {tuple(w[k : k + 10]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() for w in [words(r.text)] for k in range(max(1, len(w) - 9))}
    hit = lambda w: any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))
    assert sorted(r["doc_id"] for r in clean) == sorted(r["doc_id"] for r in alone if not hit(words(r["text"])))

    taken = sorted(r.doc_id for r in mixing.plan(kept[3]).collect())
    assert sorted(r["doc_id"] for r in mixed) == taken == sorted(r["doc_id"] for r in shards)
    assert sorted(str(r) for r in corpus_pipeline.run(spark, SF).collect()) == sorted(str(r) for r in kept[-1].collect())


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 14))
