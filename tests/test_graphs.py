"""Modularity communities, neighbour descent and the manifold embedding."""

import random
from collections import defaultdict

import numpy as np
import pytest

from cytoloom.operators import clustering, manifold, modularity

FOLDER = "/root/testdata/sf0.001"


def frame(spark, edges):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, w double")


def plain_modularity(edges, of, resolution=1.0):
    w = defaultdict(float)
    for a, b, x in edges:
        if a != b:
            w[a, b] += x / 2
            w[b, a] += x / 2
    total, k = sum(w.values()), defaultdict(float)
    for (a, _), x in w.items():
        k[a] += x
    sums = defaultdict(float)
    for a in k:
        sums[of[a]] += k[a]
    return sum(x for (a, b), x in w.items() if of[a] == of[b]) / total - resolution * sum(s * s for s in sums.values()) / total**2


def connected(edges, members):
    around = defaultdict(set)
    for a, b, _ in edges:
        around[a].add(b)
        around[b].add(a)
    seen, todo = set(), [next(iter(members))]
    while todo:
        x = todo.pop()
        if x not in seen:
            seen.add(x)
            todo += around[x] & members
    return seen == members


def found(spark, edges, **more):
    of = {r.node: r.community for r in modularity.communities(frame(spark, edges), **more).collect()}
    groups = defaultdict(set)
    for n, c in of.items():
        groups[c].add(n)
    assert of.keys() == {x for a, b, _ in edges if a != b for x in (a, b)}
    assert all(connected(edges, g) and c in g for c, g in groups.items())
    return of, groups


def planted(seed, groups, size, inside, outside):
    r = random.Random(seed)
    n = groups * size
    return [(a, b, 1.0) for a in range(n) for b in range(a) if r.random() < (inside if a // size == b // size else outside)]


def test_planted_groups_are_found(spark):
    edges = planted(1, 4, 15, 0.6, 0.02)
    of, groups = found(spark, edges)
    assert sorted(map(sorted, groups.values())) == [list(range(15 * k, 15 * k + 15)) for k in range(4)]
    df = frame(spark, edges)
    assert modularity.modularity(modularity.adjacency(df), modularity.communities(df)) == pytest.approx(plain_modularity(edges, of))


def test_a_ring_of_cliques(spark):
    edges = [(5 * k + i, 5 * k + j, 1.0) for k in range(6) for i in range(5) for j in range(i)] + [(5 * k, (5 * k + 5) % 30 + 1, 1.0) for k in range(6)]
    _, groups = found(spark, edges)
    assert sorted(map(sorted, groups.values())) == [list(range(5 * k, 5 * k + 5)) for k in range(6)]


def test_no_single_move_betters_and_propagation_is_no_better(spark):
    edges = planted(2, 5, 10, 0.35, 0.08)
    of, _ = found(spark, edges)
    at = plain_modularity(edges, of)
    df = frame(spark, edges)
    spread = {r.node: r.community for r in clustering.communities(df).collect()}
    assert at >= plain_modularity(edges, spread) - 1e-9 and at > 0.25
    adj = modularity.adjacency(df)
    nodes = adj.groupBy("src").sum("w").toDF("node", "k").selectExpr("node", "k", "0.0D as loop").join(modularity.communities(df), "node")
    total = nodes.agg({"k": "sum"}).first()[0]
    for m in modularity.proposals(adj, nodes, total, 1.0).collect():  # what remains is cut off by the last contraction's level
        better = plain_modularity(edges, of | {m.node: m.to}) - at
        assert better == pytest.approx(2 * m.gain / total, abs=1e-9)


def test_gains_of_matched_moves_add_up(spark):
    edges = planted(3, 3, 8, 0.5, 0.1)
    adj = modularity.adjacency(frame(spark, edges))
    nodes = adj.groupBy("src").sum("w").toDF("node", "k").selectExpr("node", "k", "0.0D as loop", "node as community")
    total = nodes.agg({"k": "sum"}).first()[0]
    moves = modularity.matched(modularity.proposals(adj, nodes, total, 1.0)).collect()
    touched = [c for m in moves for c in (m.community, m.to)]
    assert moves and len(touched) == len(set(touched))
    alone = {r.node: r.node for r in nodes.collect()}
    after = alone | {m.node: m.to for m in moves}
    assert plain_modularity(edges, after) - plain_modularity(edges, alone) == pytest.approx(2 * sum(m.gain for m in moves) / total)


def test_odd_graphs(spark):
    assert modularity.communities(frame(spark, []).limit(0)).collect() == []
    assert found(spark, [(1, 1, 5.0), (1, 2, 1.0), (2, 1, 1.0), (3, 4, 2.0), (4, 3, 0.0)])[1] == {1: {1, 2}, 3: {3, 4}}
    sizes = modularity.named_by_size(spark.createDataFrame([(k, 9 if k < 3 else 4) for k in range(5)], "node long, community long"))
    assert {(r.node, r.community) for r in sizes.collect()} == {(0, 0), (1, 0), (2, 0), (3, 1), (4, 1)}


def test_communities_of_the_embeddings(spark):
    from cytoloom.plans import cell_queries

    edges = cell_queries._shared_graph(spark, FOLDER).persist()
    plain = [tuple(r) for r in edges.select("src", "dst", "w").collect()]
    one = {r.node: r.community for r in modularity.communities(edges).collect()}
    two = {r.node: r.community for r in clustering.communities(edges).collect()}
    assert plain_modularity(plain, one) >= plain_modularity(plain, two)


def vectors(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>")


def nearest(x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    return [set(r) for r in d.argsort(axis=1, kind="stable")[:, :k].tolist()]


@pytest.mark.parametrize("dims", [8, 24])
def test_descent_finds_nine_of_ten(spark, dims, monkeypatch):
    monkeypatch.setattr(manifold, "BUCKET", 40)
    x = np.random.default_rng(dims).normal(size=(1500, dims))
    got = defaultdict(set)
    rows = manifold.descended_neighbors(vectors(spark, x), "id", "v", 10).collect()
    for r in rows:
        got[r.src].add(r.dst)
        assert r.distance == pytest.approx(np.linalg.norm(x[r.src] - x[r.dst]))
    assert all(len(got[k]) == 10 for k in range(1500))
    assert np.mean([len(got[k] & v) / 10 for k, v in enumerate(nearest(x, 10))]) >= 0.9


def test_descent_of_few_rows_and_ties(spark):
    df = vectors(spark, np.array([[0.0], [1.0], [1.0], [3.0]]))
    got = [(r.src, r.dst, r.rank) for r in manifold.descended_neighbors(df, "id", "v", 2).orderBy("src", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (1, 2, 1), (1, 0, 2), (2, 1, 1), (2, 0, 2), (3, 1, 1), (3, 2, 2)]
    assert manifold.descended_neighbors(df.limit(0), "id", "v", 2).collect() == []


def test_fuzzy_weights_add_up(spark):
    r = np.random.default_rng(1)
    d = np.sort(r.random((20, 8)), axis=1)
    df = spark.createDataFrame([(s, 100 + k, float(d[s, k])) for s in range(20) for k in range(8)], "src long, dst long, distance double")
    sums = defaultdict(list)
    for w in manifold.fuzzy_weights(df).collect():
        sums[w.src].append(w.w)
    assert all(sum(v) == pytest.approx(3.0, abs=1e-3) and max(v) == pytest.approx(1.0) for v in sums.values())


def test_embedding_keeps_neighbours_better_than_components(spark):
    r = np.random.default_rng(6)
    turn = np.linalg.qr(r.normal(size=(12, 12)))[0]
    t, h = r.random(700) * 9 + 4, r.random(700) * 12
    x = np.c_[t * np.cos(t), h, t * np.sin(t), np.zeros((700, 9))] @ turn  # a rolled sheet
    df = vectors(spark, x[:600])
    fitted = manifold.fit(df, "id", "v", 12, clustering.nearest_neighbors(df, "id", "v", 12))
    places = {p.node: (p.x, p.y) for p in fitted.places.collect()}
    assert len(places) == 600 and np.isfinite(list(places.values())).all()
    true = nearest(x[:600], 12)
    kept = lambda y: np.mean([len(a & b) / 12 for a, b in zip(true, nearest(y, 12))])
    wide = np.linalg.svd(x[:600] - x[:600].mean(axis=0))[2][:2]
    mine = kept(np.array([places[k] for k in range(600)]))
    assert mine > kept(x[:600] @ wide.T) + 0.1
    again = {p.node: (p.x, p.y) for p in manifold.fit(df, "id", "v", 12, clustering.nearest_neighbors(df, "id", "v", 12)).places.collect()}
    assert np.allclose([again[k] for k in range(600)], [places[k] for k in range(600)])
    new = spark.createDataFrame([(1000 + k, v.tolist()) for k, v in enumerate(x[600:])], "id long, v array<double>")
    put = {p.node - 1000: (p.x, p.y) for p in fitted.transform(new, "id", "v").collect()}
    y = np.array([places[k] for k in range(600)])
    near = lambda points, p: set(((points - p) ** 2).sum(axis=1).argsort()[:12].tolist())
    assert np.mean([len(near(x[:600], x[600 + k]) & near(y, np.array(put[k]))) / 12 for k in range(100)]) > 0.5
