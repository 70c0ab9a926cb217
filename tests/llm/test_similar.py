"""The near-copy stage against all pairs of shingle sets."""

import os
import random
import sys

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))]

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm import ODD, roots

from cytoloom.llm import similar, simhash

FOLDER = "/root/testdata/sf0.001"


def shingles(text):
    parts = (text or "").encode().lower().split()
    return {b" ".join(parts[k : k + 5]) for k in range(max(1, len(parts) - 4))} if parts else set()


def near(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def altered(seed, changes):
    """Texts with ever more of their words replaced, one after another."""
    rng = random.Random(seed)
    words = [f"{rng.choice(['bead', 'sail', 'coin', 'moss'])}{rng.randrange(400)}" for _ in range(200)]
    texts = [" ".join(words)]
    for at in rng.sample(range(200), changes):
        words[at] = f"new{at}"
        texts.append(" ".join(words))
    return texts


def test_stage_finds_all_pairs_of_the_similarity(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    texts = [r.text for r in docs] + ODD + [t for seed in range(12) for t in (lambda x: [x[0], x[2], x[-1]])(altered(seed, 3 + seed % 4))]
    sets = [shingles(t) for t in texts]
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if near(sets[a], sets[b])]
    assert any((simhash.simhash(texts[a]) ^ simhash.simhash(texts[b])).bit_count() > 4 for a, b in linked)
    of = roots(len(sets), linked)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, df, FOLDER).collect()} == set(of)
    got = {r.doc_id: r.component_id for r in similar.near_copies(df).collect()}
    assert got == dict(enumerate(of))


@pytest.mark.parametrize("large", [4096, 3])
def test_prefixes_alone_find_all_pairs(spark, monkeypatch, large):
    texts = [t for seed in range(6) for t in altered(seed, 12)]
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, key long")
    rows = similar.shingle_rows(df, 5, 0.8, similar.frequent_shingles(df, 5)).cache()
    node = {r.doc_id: r.node for r in rows.collect()}
    known = rows.select("node", "size", "sketch", "head", F.col("doc_id").alias("class")).dropDuplicates(["node"])
    monkeypatch.setattr(similar, "LARGE", large)
    runs = similar.prefix_runs(known)
    all_, some = (similar.verified(similar.run_pairs(runs, known.drop("head"), 0.8, forest), df, rows, 0.8, 5).collect() for forest in (False, True))
    got = {(r.src, r.dst) for r in all_}
    assert {(r.src, r.dst) for r in some} <= got and len(some) < len(got)
    sets = [shingles(t) for t in texts]
    assert got == {tuple(sorted((node[a], node[b]))) for a in range(len(sets)) for b in range(a) if near(sets[a], sets[b])}


def test_null_ids_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a"), (4, "A"), (4, "A"), (None, "b c"), (2, None), (3, " ")], "doc_id long, text string")
    kept = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in similar.drop_near_copies(df).collect())
    assert kept == [(False, 0, "a"), (False, 0, "b c"), (True, 2, ""), (True, 4, "A"), (True, 4, "A")]
    assert similar.drop_near_copies(df.limit(0)).collect() == []


def test_sketches_never_rule_out_what_is_similar():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.choice([1, 2, 5, 60, 130, 300, 1000])
        base = [rng.getrandbits(63) for _ in range(n)]
        other = base[: rng.randint(0, n)] + [rng.getrandbits(63) for _ in range(rng.randint(0, max(1, n // 3)))]
        a, b = set(base), set(other)
        x, y = (similar.sketch(np.array(sorted(s), np.int64)) for s in (a, b))
        if near(a, b):
            assert similar.possible(x, y, len(a) + len(b), 0.8)
    a, b = ({rng.getrandbits(63) for _ in range(300)} for _ in range(2))
    assert not similar.possible(*(similar.sketch(np.array(sorted(s), np.int64)) for s in (a, b)), 600, 0.8)


def test_plans_keep_texts_in_place(spark):
    """Documents that go are few: no exchange of texts."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    plan = similar.drop_near_copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan


def test_groups_of_near_copies_give_no_square_of_pairs(spark):
    """A base and many texts that are near it, or nearly, and not near each other."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    texts = [" ".join(base)]
    for k in range(150):
        words = list(base)
        for at in rng.sample(range(200), 3 + k % 5):
            words[at] = f"own{k}x{at}"
        texts.append(" ".join(words))
    df = spark.createDataFrame([(k, t, k) for k, t in enumerate(texts)], "doc_id long, text string, key long")
    rows = similar.shingle_rows(df, 5, 0.8, []).cache()
    known = rows.select("node", "size", "sketch", "head", F.col("node").alias("class"))
    pairs = similar.run_pairs(similar.prefix_runs(known), known.drop("head"), 0.8, True)
    assert pairs.distinct().count() < 8 * len(texts)
    sets = [shingles(t) for t in texts]
    of = roots(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if near(sets[a], sets[b])])
    assert {r.doc_id: r.component_id for r in similar.near_copies(df).collect()} == dict(enumerate(of))


@pytest.mark.parametrize("large", [4096, 5])
def test_heavy_shingles_are_drawn_from_and_dealt(spark, monkeypatch, large):
    """One base, many near copies of it and of each other's ends, and texts of the same frequent shingles that are not near."""
    monkeypatch.setattr(similar, "LARGE", large)
    rng = random.Random(9)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(40):
        words = list(base)
        for at in rng.sample(range(60), k % 3):
            words[at] = f"own{k}x{at}"
        texts.append(" ".join(words))
    texts += [" ".join(base[:30] + [f"else{k}y{j}" for j in range(k % 9, 12)]) for k in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    of = roots(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if near(sets[a], sets[b])])
    assert {r.doc_id: r.component_id for r in similar.near_copies(df).collect()} == dict(enumerate(of))


def test_drawn_pairs_are_about_as_many_as_texts(spark, monkeypatch):
    monkeypatch.setattr(similar, "LARGE", 10)
    rows = spark.createDataFrame([(k, k, [7, 100 + k]) for k in range(50)] + [(60, 60, [8])], "node long, class long, head array<long>")
    heavy = similar.heavy_shingles(rows)
    assert [tuple(r) for r in heavy.collect()] == [(7, 50)]
    pairs = similar.drawn_pairs(rows, heavy, 0).collect()
    assert len(pairs) == 49 and len({r.a for r in pairs} & {r.b for r in pairs}) <= 1
    assert similar.classes_in(rows.withColumn("class", F.lit(1)), heavy).first().several is False


def test_sets_of_one_number_are_told_apart(spark, monkeypatch):
    """With two bits for a number most texts share theirs."""
    whole = similar.node_of
    monkeypatch.setattr(similar, "node_of", lambda s: (whole(s)[0] & 3, whole(s)[1]))
    texts = [t for seed in range(5) for t in altered(seed, 3)] + ["a", "b", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    of = roots(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if near(sets[a], sets[b])])
    assert {r.doc_id: r.component_id for r in similar.near_copies(df).collect()} == dict(enumerate(of))
