"""Areas as columns, uniform images beside given ones, labels of images, settings from files."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cytoloom.operators import spatial, summaries, tissue
from cytoloom.sources.settings import Settings


def test_lattice_area_of_a_column(spark):
    radii = [0.0, 0.5, 1.0, 2.25, 24.9, 25.0, 49.5, 50.0, 200.0]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in radii], "r double").select(spatial.lattice_area(F.col("r"))).collect()]
    assert got == [0, *spatial.lattice_areas(radii[1:])]


def test_ring_densities(spark):
    cells = spark.createDataFrame([(1, x, y) for x, y in [(0.0, 0.0), (10.0, 10.0), (5.0, 5.0), (5.0, 6.0)]] + [(None, 0.0, 0.0)], "slide_id long, x double, y double")
    got = {(r.slide_id, r.ring): (r.n, r.pixels) for r in spatial.ring_densities(cells, 4.0).collect()}
    four, eight = spatial.lattice_areas([4.0, 8.0])
    assert got == {(1, 4.0): (2, four), (1, 8.0): (2, eight - four)}  # cells of no image are of no ring
    assert spatial.ring_densities(cells.limit(0), 4.0).collect() == []


@pytest.mark.parametrize("seed", [0, 1])
def test_uniform_images_beside_given_ones(spark, seed):
    cells = spark.range(6_000).selectExpr("id % 2 as slide_id", "id as cell_id", "cast(id % 101 as double) as x", "cast(20 + id % 41 as double) as y")
    made = tissue.synthetic_like(cells, 0.5, seed)
    assert made.count() == 6_000
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, tissue.synthetic_like(cells.repartition(7), 0.5, seed).collect()))
    for r in made.groupBy("slide_id").agg(F.min("x"), F.max("x"), F.min("y"), F.max("y"), F.avg("x"), F.avg("y"), F.avg((F.col("Phenotype A") == "A+").cast("int")), F.max(F.pmod("x", F.lit(0.5)))).collect():
        assert r[1] >= 0 and r[2] <= 100 and r[3] >= 20 and r[4] <= 60 and abs(r[5] - 50) < 3 and abs(r[6] - 40) < 1.5 and abs(r[7] - 2 / 3) < 0.04 and r[8] == 0
    assert made.where("`Phenotype A` = 'A+' AND `Phenotype B` = 'B+'").count() == 0


def test_images_of_several_labels_are_told(spark):
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y")], "image string, label string")
    assert [tuple(r) for r in summaries.unique_label(rows.where("image = 'a'"), "image", "label").collect()] == [("a", "x")]
    with pytest.raises(PySparkException, match="several labels: b"):
        summaries.unique_label(rows, "image", "label").collect()


def test_settings_of_a_file(tmp_path):
    pytest.importorskip("yaml")
    path = tmp_path / "s.yml"
    path.write_text("phenotyping:\n  method: Marker\nanalysis:\n  roi_width: 300\n  images_to_analyze: [a, b]\nplotting:\n")
    found = Settings.read(str(path))
    assert (found.phenotyping_method, found.roi_width, found.images_to_analyze, found.n_neighs) == ("Marker", 300, ["a", "b"], 6)
    for text, match in (("a: 1", "sections"), ("- a", "sections"), ("x:\n  y: 1", "unknown"), ("analysis:\n  roi_width: -1", "roi_width")):
        path.write_text(text)
        with pytest.raises(ValueError, match=match):
            Settings.read(str(path))
    path.write_text("")
    assert Settings.read(str(path)) == Settings()
