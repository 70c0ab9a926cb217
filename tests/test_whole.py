"""Queries on small tables where leaving anything out shows."""

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import numpy as np

from cytoloom.operators import clustering
from cytoloom.plans import cell_queries, spatial_queries

FOLDER = "/root/testdata/sf0.001"


def scattered(spark):
    """Cells close together and far apart, on slides of low and high ids."""
    rows = [(s, s * 1000 + k, float(x), float(y), "AB"[k % 2]) for s in (3, 40, 77) for k, (x, y) in enumerate([(0, 0), (10, 0), (20, 5), (0, 30), (900, 900), (905, 700), (400, 0)])]
    return spark.createDataFrame(rows, "slide_id long, cell_id long, x double, y double, phenotype string")


def test_permutation_test_covers_all_slides(spark, monkeypatch):
    monkeypatch.setattr(spatial_queries, "cells", lambda spark, sf: scattered(spark))
    assert {r.roi for r in spatial_queries.permutation_test(spark, "").collect()} == {"3", "40", "77"}


def test_far_neighbours_are_kept(spark, monkeypatch):
    monkeypatch.setattr(spatial_queries, "cells", lambda spark, sf: scattered(spark))
    rows = scattered(spark).collect()
    want = set()
    for a in rows:
        near = sorted(((a.x - b.x) ** 2 + (a.y - b.y) ** 2, b.cell_id) for b in rows if b.slide_id == a.slide_id and b.cell_id != a.cell_id)[:3]
        want |= {(a.slide_id, a.cell_id, i, round(d**0.5, 6), k + 1) for k, (d, i) in enumerate(near)}
    got = {(r.slide_id, r.src, r.dst, r.distance, r["rank"]) for r in spatial_queries.spatial_knn(spark, "").collect()}
    assert got == want


def test_all_channels_are_pivoted(spark):
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity").collect()
    want = {}
    for r in lines:
        k = (r.l_orderkey, f"q{r.l_linenumber}")
        want[k] = max(r.l_quantity, want.get(k, r.l_quantity))
    out = cell_queries.channel_pivot(spark, FOLDER).collect()
    assert {(r.l_orderkey, c): v for r in out for c, v in r.asDict().items() if c != "l_orderkey" and v is not None} == want
    assert len(out) == len({r.l_orderkey for r in lines})


def test_all_brands_and_phenotypes_are_encoded(spark):
    brands = {r.p_partkey: r.p_brand for r in spark.read.parquet(f"{FOLDER}/part.parquet").collect()}
    for r in cell_queries.one_hot(spark, FOLDER).collect():
        assert [c for c, v in r.asDict().items() if c != "p_partkey" and v == 1] == [brands[r.p_partkey]]
    wide = spatial_queries.wide_ring_counts(spark, FOLDER).collect()
    long = spatial_queries.neighbor_ring_counts(spark, FOLDER).where("ring = 0").collect()
    assert {(r.slide_id, r.cell_id, c[:2], v) for r in wide for c, v in r.asDict().items() if " in " in c and v} == {(r.slide_id, r.cell_id, r.neighbor, r.n) for r in long}


def test_every_cell_has_a_colour(spark):
    got = cell_queries.colour_index(spark, FOLDER)
    assert got.where("colour IS NOT NULL").count() == spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()
    assert got.select("colour").distinct().count() == 31


def vectors(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").orderBy("vec_id").collect()
    return [r.vec_id for r in rows], np.array([r.label for r in rows]), np.array([r.embedding for r in rows], float)


def test_all_dimensions_are_ranked_and_tested(spark):
    _, labels, v = vectors(spark)
    got = {(r.feature, r.label): r.rank_sum for r in cell_queries.wilcoxon_ranks(spark, FOLDER).collect()}
    ranks = np.array([[np.mean([(c < x).sum() + 1, (c <= x).sum()]) for x in c] for c in v.T]).T
    assert got == {(f, g): round(float(ranks[labels == g, f].sum()), 3) for f in range(v.shape[1]) for g in set(labels.tolist())}
    assert {r.feature for r in cell_queries.wilcoxon_test(spark, FOLDER).select("feature").distinct().collect()} == set(range(v.shape[1]))


def test_all_dimensions_make_memberships_matrix_and_components(spark):
    ids, labels, v = vectors(spark)
    names = sorted(set(labels.tolist()))
    e = np.exp(v @ np.array([v[labels == g].mean(0) for g in names]).T)
    want = e / e.sum(1, keepdims=True)
    got = {(r.vec_id, r.cluster): r.probability for r in cell_queries.softmax_membership(spark, FOLDER).collect()}
    assert len(got) == want.size and all(abs(got[i, g] - want[a, b]) < 2e-6 for a, i in enumerate(ids) for b, g in enumerate(names))
    n = np.log1p(np.abs(v) / np.abs(v).sum(1, keepdims=True))
    n = (n - n.mean(0)) / n.std(0, ddof=1)
    rows = np.array([list(r)[1:] for r in cell_queries.feature_matrix(spark, FOLDER).orderBy("vec_id").collect()])
    assert np.allclose(rows, n, atol=2e-6)
    xy = np.array([list(r)[1:] for r in cell_queries.pca_embedding(spark, FOLDER).orderBy("vec_id").collect()])
    assert np.allclose(np.sort(xy.var(0, ddof=1))[::-1], np.linalg.eigvalsh(np.cov(v.T))[::-1][:2], rtol=1e-6)


def test_elbow_uses_all_dimensions_and_fifty_starts(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(clustering, "elbow", lambda df, names, ks, **more: seen.update(names=names, **more) or [(1, 0.0)])
    cell_queries.k_means_elbow(spark, FOLDER)
    assert len(seen["names"]) == 64 and seen["tries"] == 50


def test_affixes_come_from_all_names(spark, monkeypatch):
    names = ["Supplier#0001-x", "Supp#02-x", "Suppl-x"]
    df = spark.createDataFrame(list(enumerate(names)), "s_suppkey long, s_name string")
    monkeypatch.setattr(cell_queries, "table", lambda *a: df)
    assert {r.s_suppkey: r.tail for r in cell_queries.common_affixes(spark, "").collect()} == {0: "lier#0001", 1: "#02", 2: "l"}
