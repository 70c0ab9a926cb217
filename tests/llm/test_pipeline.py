"""The pipeline against each stage's brute-force version on what the stage before kept."""

import sys
import os
from collections import defaultdict

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline
from test_llm import ODD, brute_cut, check_packed, roots
from test_similar import near, shingles

from cytoloom.llm import toxicity

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept, columns = docs, docs.columns
    after = []
    for _, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = stage(spark, kept, FOLDER)
        after.append((before, kept.collect()))
        if stage is not corpus_pipeline.pack:
            assert kept.columns == columns
    model = toxicity.train(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    before, out = after[0]
    scores = dict(zip(before, model.scores([t or "" for t in before.values()], toxicity.Hits(model.lexicons))))
    assert {r.doc_id for r in out} == {i for i, s in scores.items() if s < 0.5}

    before, out = after[1]
    groups = defaultdict(list)
    for i, t in before.items():
        groups["".join((t or "").split())].append((-len(t or ""), i))
    assert {r.doc_id for r in out} == {min(g)[1] for g in groups.values()}

    before, out = after[2]
    rows = sorted((i, shingles(t)) for i, t in before.items())
    of = roots(len(rows), [(a, b) for a in range(len(rows)) for b in range(a) if near(rows[a][1], rows[b][1])])
    assert {r.doc_id for r in out} == {rows[k][0] for k in set(of)}

    before, out = after[3]
    assert all(r.n_chars == len(r.text) for r in out)
    assert {r.doc_id: r.text for r in out} == dict(zip(sorted(before), brute_cut([before[i] for i in sorted(before)])))

    before, out = after[4]
    check_packed(out, 2048)
    assert {r.doc_id for r in out} == set(before)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_stages_take_nulls_repeated_rows_and_clashing_columns(spark):
    rows = [(k, t, None, "s", None, 7, 8) for k, t in enumerate(ODD)] + [(4, "a", "en", "s", 1, 7, 8)] * 2 + [(None, "of no id", None, None, None, 7, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, gone int, removed int")
    for given in (docs, docs.limit(0)):
        kept = given
        for _, stage in corpus_pipeline.STAGES:
            kept = stage(spark, kept, FOLDER)
            if stage is not corpus_pipeline.pack:
                assert kept.dtypes == docs.dtypes
        out = kept.collect()
        check_packed(out, 2048)
        assert bool(out) == bool(given.take(1))
