"""Queries that failed on larger tables: kernels against plain loops, and ties as SQL has them."""

import math
import os
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import assert_same  # noqa: E402
from cytoloom.operators import clustering, interaction, modularity, onetask, profiles, spatial, tissue, whole  # noqa: E402
from cytoloom.plans import cell_queries  # noqa: E402, F401
from cytoloom.plans.registry import QUERIES, SQL  # noqa: E402


def test_neighbours_that_rounding_ties_are_ranked_by_id(spark, tmp_path):
    """Distances that differ beyond the sixth digit, the farther neighbour with the smaller id."""
    near = [[3.0, 1.0 + 1e-7 * (20 - k)] for k in range(20)]
    rows = [(100 + k, [float(20 * (k % 3)), *v], 0) for k, v in enumerate(near)] + [(k, [0.0, 0.0, float(k)], 1) for k in range(3)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    for t in "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split():
        os.symlink(f"/root/testdata/sf0.001/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.read.parquet(str(tmp_path / "embeddings.parquet")).coalesce(1).toPandas().to_parquet(str(tmp_path / "e.parquet"))
    os.rename(tmp_path / "embeddings.parquet", tmp_path / "folder")
    os.rename(tmp_path / "e.parquet", tmp_path / "embeddings.parquet")
    assert_same(QUERIES["exact_knn"](spark, str(tmp_path)), SQL["exact_knn"], str(tmp_path))


def test_neighbours_of_far_rows_and_copies(spark):
    """Rows far from the origin, where a matrix product loses digits, and many copies of one."""
    r = np.random.default_rng(3)
    v = np.vstack([1e4 + r.normal(0, 1e-3, (300, 3)), np.ones((60, 3)), r.normal(0, 1, (300, 3))])
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "id long, v array<double>")
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(len(v)) for j in np.lexsort((np.arange(len(v)), d[i]))[:4]}
    assert {(x.src, x.dst) for x in clustering.nearest_neighbors(df, "id", "v", 4, blocks=3).collect()} == want


def test_approximate_neighbours_equal_those_of_joined_buckets(spark):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector

    r = np.random.default_rng(4)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(r.normal(0, 3, (250, 5)))], "id long, v array<double>")
    data = df.select("id", array_to_vector("v").alias("__v"))
    model = BucketedRandomProjectionLSH(inputCol="__v", outputCol="__h", bucketLength=2.0, numHashTables=2, seed=0).fit(data)
    pairs = model.approxSimilarityJoin(data, data, 4.0, "distance").where("datasetA.id <> datasetB.id").select(F.col("datasetA.id").alias("src"), F.col("datasetB.id").alias("dst"), "distance").collect()
    want = set()
    for i in range(250):
        want |= {(i, p.dst, round(p.distance, 9)) for p in sorted((p for p in pairs if p.src == i), key=lambda p: (p.distance, p.dst))[:3]}
    found = clustering.approximate_neighbors(df, "id", "v", 3, 4.0, tables=2)
    assert "BroadcastNestedLoop" not in found._jdf.queryExecution().toString()
    assert {(x.src, x.dst, round(x.distance, 9)) for x in found.collect()} == want


def odd_cells(spark, seed=5):
    """Images of unlike density with repeated ids and places, nulls and places that are no numbers."""
    r = np.random.default_rng(seed)
    rows = [("abc"[k % 3], k // 2 * 2 if k % 17 == 0 else k, float(x), float(y), "PQR"[k % 3] if k % 11 else None) for k, (x, y) in enumerate(np.vstack([r.integers(0, 40, (150, 2)), r.normal(-60, 3, (150, 2)), r.uniform(-500, 500, (60, 2))]))]
    rows += [("a", 1, 0.0, 0.0, "Q"), (None, 2, 0.0, 0.0, "P"), ("b", 900, None, 1.0, "P"), ("b", 901, float("nan"), 1.0, "P"), ("d", 903, 1.0, 1.0, "P"), ("a", None, 3.0, 3.0, "P"), ("a", None, 3.0, 4.0, "R")]
    return spark.createDataFrame(rows, "slide_id string, cell_id long, x double, y double, phenotype string")


def all_rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("closed, alone, center", [("(]", False, "own"), ("[)", True, None), ("[)", False, None)])
def test_ring_counts_of_whole_images_equal_the_join(spark, monkeypatch, closed, alone, center):
    df = odd_cells(spark)
    df = df.where("cell_id IS NOT NULL") if center else df  # the join knows no phenotype of cells without an id
    found = spatial.ring_counts(df, [0.0, 5.0, 20.0, 60.0], closed, exclude_self=alone, center=center)
    joined = spatial.joined_ring_counts(df, [0.0, 5.0, 20.0, 60.0], closed, "cell_id", "slide_id", "phenotype", alone, center)
    assert all_rows(found) == all_rows(joined)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan  # cells are moved, no pairs or counts
    monkeypatch.setattr(whole, "WHOLE", 100)
    assert all_rows(spatial.ring_counts(df, [0.0, 5.0, 20.0, 60.0], closed, exclude_self=alone, center=center)) == all_rows(joined)


def test_totals_of_rings(spark, monkeypatch):
    for size in (whole.WHOLE, 100):
        monkeypatch.setattr(whole, "WHOLE", size)
        counts = spatial.ring_counts(odd_cells(spark), [0.0, 5.0, 20.0], total="all").where("cell_id IS NOT NULL")
        a, b = (all_rows(profiles.proportions(counts, ["slide_id", "cell_id"], t)) for t in ("all", None))
        assert a == b and len(a) > 100


def test_groups_are_gathered_whole(monkeypatch):
    monkeypatch.setattr(whole, "GATHERED", 5)
    for sizes in ([1, 1, 12, 3, 1, 9], [4] * 6, [30], [1] * 13):
        image = np.repeat(np.arange(len(sizes)), sizes)
        for step in (1, 3, 7, 100):
            batches = [pa.RecordBatch.from_pydict({"g": image[a : a + step]}) for a in range(0, len(image), step)]
            tables = [t.column("g").to_numpy() for t in whole.gathered(iter(batches), ["g"])]
            assert np.concatenate(tables).tolist() == image.tolist() and all(a[-1] < b[0] for a, b in zip(tables, tables[1:]))


def test_counts_of_whole_rois_equal_the_join(spark, monkeypatch):
    df = odd_cells(spark).where("x IS NOT NULL AND NOT isnan(x)").withColumn("half", F.when(F.col("cell_id") % 5 > 0, F.col("cell_id") % 2))
    roi = ["slide_id", "half"]
    both = [interaction.observed, interaction.poisson_test, lambda *a: interaction.count_pmf(*a).drop("z", "p_left", "p_right")]
    digits = lambda df: sorted((tuple(float(f"{v:.9g}") if isinstance(v, float) else v for v in r) for r in all_rows(df)), key=repr)
    here = [f(df, 9.0, roi) for f in both]
    plan = here[0]._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    here = [digits(x) for x in here]
    assert len(here[0]) > 20 and len(here[2]) > 60
    for size in (50, 0):  # joined above it
        monkeypatch.setattr(whole, "WHOLE", size)
        assert here == [digits(f(df, 9.0, roi)) for f in both]


def test_nearest_of_whole_images_equal_the_join(spark, monkeypatch):
    df = odd_cells(spark)
    joined = all_rows(spatial.met_by_level(df, 4, 30.0, "cell_id", "slide_id"))
    found = spatial.nearest(df, 4, 30.0)
    assert all_rows(found) == joined and len(joined) > 1000
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    monkeypatch.setattr(whole, "WHOLE", 130)
    assert all_rows(spatial.nearest(df, 4, 30.0)) == joined


def test_shuffles_of_whole_rois_equal_the_join(spark, monkeypatch):
    df = odd_cells(spark).withColumn("phenotype", F.expr("get(array('P', 'Q', 'R'), int(cell_id % 4))"))
    names = ["slide_id", "center", "neighbor", "edges", "expected"]
    here = interaction.permutation_test(df, 9.0, ["slide_id"], 7, 3).select(names)
    plan = here._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
    for size in (whole.WHOLE, 0):
        monkeypatch.setattr(whole, "WHOLE", size)
        rows = all_rows(interaction.permutation_test(df, 9.0, ["slide_id"], 7, 3).select(names))
        assert rows == all_rows(here) and len(rows) >= 27


def test_outlines_of_whole_images_equal_the_merged_ones(spark, monkeypatch):
    r = np.random.default_rng(7)
    images = {1: np.vstack([r.normal(0, 40, (400, 2)), r.uniform(-400, 400, (12, 2))]), 2: r.integers(0, 30, (300, 2)).astype(float), 3: r.integers(0, 3, (20, 2)) * 9.0, 4: np.array([[0.0, 0], [900, 0], [0, 900], [900, 900], [5000, 450]])}
    df = spark.createDataFrame([(k, float(x), float(y)) for k, p in images.items() for x, y in p], "slide_id int, x double, y double")
    want = all_rows(tissue.merged_outlines(df, 25.0).select("slide_id", "x", "y", "n", "most_x", "most_y"))
    found = tissue.outlines(df, 25.0)
    assert all_rows(found) == want and len(want) > 100 and "Join" not in found._jdf.queryExecution().executedPlan().toString()
    fitted = all_rows(tissue.ellipses(df, 25.0))
    monkeypatch.setattr(tissue, "OUTLINED", 100)
    assert all_rows(tissue.ellipses(df, 25.0)) == fitted


def test_simplexes_end_at_the_least_points():
    r = np.random.default_rng(2)
    aim = r.normal(0, 3, (7, 3))
    calls = []
    found = tissue.simplexes(lambda k, p: calls.append(len(k)) or ((p - aim[k]) ** 2).sum(axis=1), np.ones((7, 3)))
    assert np.abs(found - aim).max() < 1e-3 and sum(calls) > 3 * len(calls)  # in step
    alone = [tissue.simplexes(lambda k, p, i=i: ((p - aim[i]) ** 2).sum(axis=1), np.ones((1, 3)))[0] for i in range(7)]
    assert np.array_equal(found, np.array(alone))


def test_counts_inside_ellipses_equal_the_lattice():
    r = np.random.default_rng(3)
    centres, shape = r.integers(-40, 140, (400, 2)).astype(float), np.tile([50.0, 45.0, 60.0, 25.0, 0.4], (400, 1))
    for o in tissue.ring_offsets([5.0, 12.0]):
        dx, dy = (centres[:, k, None] + o[None, :, k] - shape[:, k, None] for k in (0, 1))
        c, s = math.cos(0.4), math.sin(0.4)
        want = (((c * dx + s * dy) / 60.0) ** 2 + ((s * dx - c * dy) / 25.0) ** 2 <= 1).sum(axis=1)
        assert np.array_equal(tissue.inside_counts(centres, shape, o), want) and {0, len(o)} < set(want)


def test_elbow_fits_all_starts_in_the_same_passes(spark, monkeypatch):
    r = np.random.default_rng(6)
    x = np.vstack([r.normal(c, 0.3, (80, 2)) for c in ((0, 0), (6, 0), (0, 7), (9, 9))])
    df = spark.createDataFrame([tuple(map(float, p)) for p in x], ["a", "b"])
    passes, sums = [], clustering.Passes.sums
    monkeypatch.setattr(clustering.Passes, "sums", lambda self, models: passes.append(len(models)) or sums(self, models))
    found = dict(clustering.elbow(df, ["a", "b"], range(1, 5), tries=6))
    assert passes[0] == 18 and len(passes) < 40
    near = lambda m: ((x[:, None] - m[None]) ** 2).sum(axis=2).min(axis=1).sum()
    assert found[4] == pytest.approx(near(np.array([x[80 * k : 80 * k + 80].mean(axis=0) for k in range(4)])))
    assert found[1] == pytest.approx(near(x.mean(axis=0)[None])) and found[1] > found[2] > found[3] > found[4]


def test_communities_in_one_task_equal_those_of_tables(spark, monkeypatch):
    r = np.random.default_rng(8)
    pairs = [(int(a) - 20, int(b) - 20, float(w)) for a, b, w in zip(r.integers(0, 60, 260), r.integers(0, 60, 260), r.integers(1, 9, 260)) if a // 12 == b // 12 or w == 1]
    edges = spark.createDataFrame([*pairs, (500, 501, 1.0), (502, 503, -1.0), (504, 504, 1.0)], "src long, dst long, w double")
    here = [f(edges) for f in (clustering.communities, modularity.communities)]
    assert [all_rows(x) for x in here] == [all_rows(clustering.propagated(edges, 50)), all_rows(modularity.risen(edges, 1.0))]
    monkeypatch.setattr(onetask, "EDGES", 3)
    assert not onetask.fits(edges)
    assert modularity.communities(edges.limit(0)).count() == clustering.communities(edges.limit(0)).count() == 0
