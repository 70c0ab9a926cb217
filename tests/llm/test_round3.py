"""Quality, periodic runs and hard negatives against brute force, planted cases and edge cases."""

import hashlib
import os
import random
import sys
import zlib
from collections import defaultdict

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

import numpy as np
import pytest
from compare import assert_same
from pyspark.sql import functions as F
from test_llm import ODD

from cytoloom.llm import negatives, quality, queries, runs

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "class", 1, 2) for k, t in enumerate(ODD)] + [(None, "null id", "h", 1, 2), (4, "a", "key", 1, 2), (4, "a", "key", 1, 2), (20, " a ", "", 1, 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, runs int, x int")


# quality


def plain_numbers(text):
    kinds = [int(quality.KIND[b]) for b in text.encode()]
    pairs = [0.0] * quality.KINDS**2
    for a, b in zip(kinds, kinds[1:]):
        pairs[a * quality.KINDS + b] += 1
    return [(p / max(len(kinds) - 1, 1)) ** 0.5 for p in pairs]


def test_numbers_of_texts():
    for t in ["", "a", "Ab 1.\nx", "naïve 中文 😀 !! $$$", " a a a b", None or "x" * 5000]:
        got = quality.read(t)
        assert len(got) == quality.FEATURES and np.isfinite(got).all()
        assert np.allclose(got[: quality.KINDS**2], plain_numbers(t), atol=1e-6)
    repeats = quality.read("a b b b b c")[quality.KINDS**2 :]
    assert repeats[4] == pytest.approx(3 / 6) and repeats[5] == pytest.approx(4 / 6) and repeats[6] == pytest.approx(4 / 6)


def sums_of(x, trusted, w):
    return quality.risk_terms(x, w, False), quality.risk_terms(trusted, w, True)


def test_slope_and_curvature_of_the_risk():
    r = np.random.default_rng(1)
    d = quality.FEATURES + 1
    x, trusted, w = r.normal(size=(300, d)), r.normal(0.3, 1, size=(90, d)), r.normal(size=d) * 0.1
    risk, slope, curve, bad = quality.unbiased_risk(*sums_of(x, trusted, w), w, 0.6)
    direct = 0.6 * np.log1p(np.exp(-trusted @ w)).mean() + np.log1p(np.exp(x @ w)).mean() - 0.6 * np.log1p(np.exp(trusted @ w)).mean()
    penalty = np.r_[np.full(d - 1, quality.RIDGE / 300), 1e-6]
    assert risk == pytest.approx(direct + 0.5 * (penalty * w**2).sum())
    assert bad == pytest.approx(np.log1p(np.exp(x @ w)).mean() - 0.6 * np.log1p(np.exp(trusted @ w)).mean())
    for k in (0, 5, d - 1):
        step = np.zeros(d)
        step[k] = 1e-5
        up, down = (quality.unbiased_risk(*sums_of(x, trusted, w + s), w + s, 0.6) for s in (step, -step))
        assert slope[k] == pytest.approx((up[0] - down[0]) / 2e-5, abs=1e-6)
        assert np.allclose(curve[k], (up[1] - down[1]) / 2e-5, atol=1e-5)


@pytest.mark.parametrize("share", [0.2, 0.6, 0.9])
def test_prior_of_a_planted_mixture(share):
    r = np.random.default_rng(2)
    good, bad = r.beta(6, 2, 400_000), r.beta(2, 6, 400_000)
    bins = lambda s: np.histogram(s, quality.BINS, (0, 1))[0]
    n = int(200_000 * share)
    found = quality.prior_of(bins(np.r_[good[:n], bad[: 200_000 - n]]), bins(good[-50_000:]))
    assert found == pytest.approx(share, abs=0.06)


def fitted_plainly(x, trusted, model):
    """Weights by damped steps on all rows at once in numpy."""
    z, zt = model.standardised(x), model.standardised(trusted)
    w = np.zeros(z.shape[1])
    for prior, rounds in ((quality.GUESS, 40), (model.prior, 200)):
        for _ in range(rounds):
            _, slope, curve, _ = quality.unbiased_risk(*sums_of(z, zt, w), w, prior)
            step = -np.linalg.solve(curve, slope)
            w = w + step * min(1.0, 0.5 / np.abs(step).max())
    return w


def test_distributed_fit_equals_the_plain_one(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.features(docs).cache()
    model = quality.fit(rows, labels)
    x = {r.doc_id: np.frombuffer(r.x, np.float32).astype(float) for r in rows.collect()}
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and zlib.crc32(str(r.doc_id).encode()) % 5}
    all_, trusted = np.array(list(x.values())), np.array([v for k, v in x.items() if k in good])
    assert np.allclose(model.mean, all_.mean(axis=0), atol=1e-6)
    plain = fitted_plainly(all_, trusted, model)
    scores = {k: 1 / (1 + np.exp(-f)) for k, f in zip(x, model.standardised(all_) @ plain)}
    got = {r.doc_id: (r.held_out, r.score, r.predicted) for r in queries.op11_quality(spark, FOLDER).collect()}
    assert got.keys() == x.keys()
    for k, (held, s, p) in got.items():
        assert held == (zlib.crc32(str(k).encode()) % 5 == 0) and p == (s >= 0.3) and 0 <= s <= 1
        assert s == pytest.approx(scores[k], abs=0.1)
    assert np.corrcoef([got[k][1] for k in x], [scores[k] for k in x])[0, 1] > 0.99


def test_quality_of_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op11_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").select("predicted", "quality").collect()
    good, bad = ([r.predicted for r in got if r.quality == q] for q in (1, 0))
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.15


def test_quality_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(k, 1, "e") for k in range(9)] + [(None, 1, "e"), (9, None, "e"), (2, 1, "e")], "doc_id long, quality int, x string")
    got = quality.quality(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.quality(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.quality(odd.limit(0), labels).collect() == []


# periodic runs


def brute_runs(words, least=runs.LEAST):
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.append((i, j - i + q, q))
            i = j + 1
    return sorted(r for r in found if r[1] >= least and not any(p < r[2] and s <= r[0] and s + m >= r[0] + r[1] for s, m, p in found))


@pytest.mark.parametrize("least", [2, runs.LEAST])
def test_runs_equal_brute_force(least, monkeypatch):
    r = random.Random(least)
    texts = []
    for _ in range(400):
        n, letters = r.randint(0, 60), r.choice([1, 2, 3, 10])
        words = [b"%d" % r.randrange(letters) for _ in range(n)]
        if n and r.random() < 0.5:
            a = r.randrange(n)
            p = 1 + (n - a) // r.randint(2, 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        texts.append(words)
    fib = [b"a"], [b"a", b"b"]
    while len(fib[1]) < 300:
        fib = fib[1], fib[1] + fib[0]
    texts += [fib[1], [b"z"] * 3000, [b"x", b"y", b"x", b"z"] * 500]
    expected = [brute_runs(t, least) for t in texts[:-2]] + [[(0, 3000, 1)], [(0, 2000, 4)]]
    for at_once in (500_000, 100):
        monkeypatch.setattr(runs, "WORDS", at_once)
        got = [sorted(zip(*(x.tolist() for x in found))) for found in runs.find(texts, least)]
        assert got == expected


def test_keys_too_wide_for_one_number():
    r = np.random.default_rng(3)
    a, b = r.integers(0, 5, (2, 200))
    c = r.permutation(200)
    assert (runs.sort_by(a, b, c, 201) == runs.sort_by(a, b, c, 1 << 40)).all()


def plain_digest(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    s, m, q = min(found, key=lambda x: (-x[1], x[0], x[2])) if found else (None,) * 3
    digest = lambda b: hashlib.sha256(b).hexdigest()
    said = "".join(f"{s},{m},{q}\n" for s, m, q in found).encode()
    return (doc_id, len(found), s, m, q, 1000 * m // q if found else None, digest(said), digest(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_query_equals_sql_and_brute_force(spark):
    got = queries.op12_periodic_runs(spark, FOLDER)
    assert_same(got, queries.ORACLE_SQL["op12_periodic_runs"], FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("length(text) < 3000").collect()
    rows = {r.doc_id: tuple(r) for r in got.collect()}
    for d in docs:
        assert rows[d.doc_id] == plain_digest(d.doc_id, d.text)


def test_runs_of_odd_rows(spark, odd):
    more = spark.createDataFrame([(50, "go\x1cgo " * 30, "", 1, 2), (51, "a b " * 20, "", 1, 2)], odd.schema)
    got = runs.periodic_runs(odd.union(more)).collect()
    assert len(got) == odd.count() + 2
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert all(r.runs == [] and r.n_words == 0 and r.collapsed == "" for k in range(4) for r in by[k]) and len(by[4]) == 3
    assert by[50][0].runs == [(0, 30, 1)] and by[50][0].collapsed == "go\x1cgo" and by[51][0].collapsed == "a b"
    assert runs.periodic_runs(odd.limit(0)).collect() == []


# hard negatives


def brute_negatives(rows, anchor, positives=5, negatives_=3, low=50, high=95):
    """rows: id -> (label, whole numbers)."""
    score = lambda a, b: sum(x * y for x, y in zip(rows[a][1], rows[b][1]))
    out = set()
    for a in filter(anchor, rows):
        others = sorted((-score(a, b), b) for b in rows if b != a)
        for s, p in [x for x in others if rows[x[1]][0] == rows[a][0]][:positives]:
            fit = [x for x in others if rows[x[1]][0] != rows[a][0] and low * -s <= 100 * -x[0] <= high * -s][:negatives_]
            out |= {(a, p, k + 1, n, -s, -m) for k, (m, n) in enumerate(fit)}
    return out


def as_rows(spark, rows):
    return spark.createDataFrame([(k, label, [float(x) / 256 for x in v]) for k, (label, v) in rows.items()], "vec_id long, label int, embedding array<double>")


@pytest.mark.parametrize("kind", ["spread", "flat", "ties", "large"])
def test_negatives_equal_brute_force(spark, monkeypatch, kind):
    r = np.random.default_rng(4)
    for name, value in (("ANCHORS", 7), ("CHUNK", 2048), ("FIRST", 3)):
        monkeypatch.setattr(negatives, name, value)
    scale = {"spread": 200 * 0.8 ** np.arange(16), "flat": np.full(16, 60), "ties": np.full(16, 1), "large": np.full(16, 2e8)}[kind]
    rows = {k: (int(r.integers(3)), (r.normal(0.4, 1, 16) * scale).astype(np.int64).tolist()) for k in range(300)}
    got = [tuple(x) for x in negatives.mine(as_rows(spark, rows), F.col("id") % 10 == 0).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_negatives(rows, lambda k: k % 10 == 0)


def test_early_discarding_loses_nothing():
    r = np.random.default_rng(5)
    whole = (r.normal(0.2, 1, (400, 24)) * 100 * 0.85 ** np.arange(24)).astype(np.int64)
    rotation = np.linalg.eigh((whole.T @ whole).astype(float))[1][:, ::-1].copy()
    block = lambda a, b: negatives.Block(np.arange(a, b).tobytes(), np.zeros(b - a, np.int64).tobytes(), whole[a:b].tobytes(), 24, np.dtype(np.int64), rotation)
    exact = whole[:50] @ whole[50:].T
    least = np.sort(exact, axis=1)[:, -4].astype(float)  # ties with the bound stay
    i, j, s = negatives.survivors(block(0, 50), block(50, 400), np.ones(exact.shape, bool), least, None, int(np.abs(whole).max()))
    assert (s == exact[i, j]).all() and {(a, b) for a, b in zip(*np.nonzero(exact >= least[:, None]))} <= set(zip(i.tolist(), j.tolist()))
    assert len(i) < exact.size / 20


def test_negatives_query_equals_sql(spark):
    assert_same(queries.op13_hard_negatives(spark, FOLDER), queries.ORACLE_SQL["op13_hard_negatives"], FOLDER)


def test_negatives_of_odd_rows(spark):
    schema = "vec_id long, label int, embedding array<float>, id string, block int, more int"
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 2, [0.5, 0.5]), (3, 2, [0.5]), (4, None, [1.0, 1.0]), (5, 1, None), (6, 1, [1.0, None]), (7, 1, [nan, 1.0]), (8, 2, [inf, 1.0]), (None, 2, [0.5, 0.5]), (2, 2, [0.5, 0.5]), (9, 2, []), (1, 3, [0.4, 0.4])]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], schema)
    got = {tuple(r) for r in negatives.mine(df, F.col("id") == 0).collect()}
    whole = {0: (1, [256, 128]), 1: (1, [256, 128]), 2: (2, [128, 128]), 3: (2, [128, 0])}
    assert got == brute_negatives(whole, lambda k: k == 0)
    assert negatives.mine(df.limit(0), F.col("id") == 0).collect() == [] and negatives.mine(df, F.col("id") == 77).collect() == []
    zero = spark.createDataFrame([(0, 1, []), (1, 1, []), (2, 2, [])], "vec_id long, label int, embedding array<float>")
    assert {tuple(r) for r in negatives.mine(zero, F.col("id") == 0).collect()} == {(0, 1, 1, 2, 0, 0)}


# tables of the shared folder


def test_threads_keep_their_own_tables(spark):
    """A block that ends in one thread leaves what another one still reads."""
    import threading

    from cytoloom.llm import shared

    started, ended, found = threading.Event(), threading.Event(), []

    def one():
        with shared.scratch():
            mine = shared.Stored(spark.range(5).toDF("id"), "one")
            started.set()
            ended.wait(60)
            found.append(mine.df.count())
        found.append(shared.exists(spark, mine.path))

    t = threading.Thread(target=one)
    t.start()
    started.wait(60)
    with shared.scratch():
        other = shared.Stored(spark.range(3).toDF("id"), "other")
        with shared.scratch():
            inner = shared.Stored(spark.range(2).toDF("id"), "inner")
        assert not shared.exists(spark, inner.path) and shared.exists(spark, other.path)
    assert not shared.exists(spark, other.path)
    ended.set()
    t.join()
    assert found == [5, False]


def test_the_cache_of_the_query_goes_with_it(spark, monkeypatch):
    from cytoloom.llm import shared

    paths = []
    new = queries.new_path
    monkeypatch.setattr(queries, "new_path", lambda *a: paths.append(new(*a)) or paths[-1])
    assert queries.op5_token_counts(spark, FOLDER).count() > 0
    assert paths and not any(shared.exists(spark, p) for p in paths)
