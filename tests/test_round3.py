"""Distributed ranks, shuffled labels without gathering, and queries without the text operators' needs."""

import math
import random
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest

from cytoloom.operators import annotations, interaction, statistics, tissue


@pytest.mark.parametrize("rows", [3, 100_000])
def test_ranks_over_ranges_equal_plain_ranks(spark, rows):
    r = random.Random(1)
    data = [(f, r.choice("abc"), float(r.choice([r.randint(0, 9), r.random() * 10]))) for f in range(3) for _ in range(200)]
    df = spark.createDataFrame(data, "f long, g string, v double")
    got = {(x.f, x.g): (x.rank_sum, x.n, x.total, x.ties) for x in statistics.rank_sums(df, "f", "g", "v", rows).collect()}
    for f in range(3):
        values = [v for k, _, v in data if k == f]
        rank = {v: sum(x < v for x in values) + (values.count(v) + 1) / 2 for v in values}
        ties = sum(c**3 - c for c in Counter(values).values())
        for g in "abc":
            mine = [v for k, h, v in data if (k, h) == (f, g)]
            assert got[f, g] == (pytest.approx(sum(rank[v] for v in mine)), len(mine), 200, ties)


def test_wilcoxon_equals_plain_formulas(spark):
    r = random.Random(2)
    data = [("f", "a" if k < 30 else "b", r.gauss(k < 30, 1.0)) for k in range(80)]
    got = {x.group: x for x in statistics.wilcoxon(spark.createDataFrame(data, "feature string, group string, v double"), "feature", "group", "v").collect()}
    order = sorted(v for _, _, v in data)
    w = sum(order.index(v) + 1 for _, g, v in data if g == "a")
    z = (w - 30 * 81 / 2) / math.sqrt(30 * 50 / 12 * 81)
    assert got["a"].z == pytest.approx(z) and got["a"].p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-6)


def test_shuffles_equal_the_closed_form_and_keep_rois_apart(spark):
    r = np.random.default_rng(3)
    rows = [("a|b", "c", k, *(r.random(2) * 50).tolist(), "AB"[int(r.random() < 0.4)]) for k in range(60)]
    rows += [("a", "b|c", k, *(r.random(2) * 50).tolist(), "AB"[int(r.random() < 0.7)]) for k in range(40)]
    rows += [(None, "one kind", k, 0.0, float(k), "A") for k in range(5)] + [("two", "cells", k, 0.0, float(k), "AB"[k]) for k in range(2)]
    df = spark.createDataFrame(rows, "p string, q string, cell_id long, x double, y double, phenotype string")
    one, two = ({(x.p, x.q, x.center, x.neighbor): x for x in interaction.permutation_test(d, 9.0, ["p", "q"], 300).collect()} for d in (df, df.repartition(3)))
    assert {k: v.z for k, v in one.items()} == {k: v.z for k, v in two.items()}
    assert {k[:2] for k in one} == {("a|b", "c"), ("a", "b|c")} and len(one) == 8
    for p, q in (("a|b", "c"), ("a", "b|c")):
        cells = [x for x in rows if x[:2] == (p, q)]
        links = [(a, b) for a in cells for b in cells if a is not b and (a[3] - b[3]) ** 2 + (a[4] - b[4]) ** 2 <= 81]
        n, kinds = len(cells), Counter(x[5] for x in cells)
        for c in "AB":
            for d in "AB":
                expected = len(links) * kinds[c] * (kinds[d] - (c == d)) / n / (n - 1)  # labels are permuted, not drawn
                found = one[p, q, c, d]
                assert found.edges == sum(a[5] == c and b[5] == d for a, b in links)
                assert found.expected == pytest.approx(expected, rel=0.1)
                assert found.p_left + found.p_right == pytest.approx(1.0)


def test_ring_areas_of_many_cells_equal_those_of_each(monkeypatch):
    r = np.random.default_rng(4)
    centres = np.trunc(r.random((60, 2)) * 100)
    shapes = np.c_[r.random((60, 2)) * 100, r.random((60, 2)) * 40 + 5, r.random(60) * 3]
    shapes[7] = np.nan
    monkeypatch.setattr(tissue, "AT_ONCE", 5_000)
    for offsets in tissue.ring_offsets([8.0, 15.0]):
        one = [(tissue.inside(c + offsets, e) <= 1).sum() for c, e in zip(centres, shapes)]
        assert tissue.inside_counts(centres, shapes, offsets).tolist() == one and max(one) > 0


def test_footprint_runs_cover_the_same_pixels(spark):
    r = random.Random(5)
    rows = [(r.choice("ab"), x, y, x + r.randint(-1, 9), y + r.randint(-1, 6)) for x, y in ((r.randint(0, 30), r.randint(0, 30)) for _ in range(60))]
    df = spark.createDataFrame(rows, "image string, x0 long, y0 long, x1 long, y1 long")
    runs = annotations.footprint_runs(df, "image").collect()
    pixels = [(x.image, p, x.py) for x in runs for p in range(x.start, x.stop)]
    assert len(pixels) == len(set(pixels)) and set(pixels) == {(x.image, x.px, x.py) for x in annotations.footprint(df, "image").collect()}
    ends = {(x.image, x.py, x.stop) for x in runs}
    assert not any((x.image, x.py, x.start) in ends for x in runs)  # runs that touch are one


def test_entry_without_what_text_operators_need():
    code = "import sys; sys.modules['xxhash'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], timeout=120).returncode == 0
