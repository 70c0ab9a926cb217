"""Heavy shingles are counted by the executors: what reaches the driver does not grow with tasks or cells."""

import os
import pickle
import random
import sys
from collections import Counter

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))]

import pytest

from cytoloom.llm import similar
from cytoloom.llm.shared import scratch


@pytest.fixture
def collected(spark, monkeypatch):
    """Bytes that each collect() brought to the driver."""
    kind, sizes = type(spark.range(1)), []
    collect = kind.collect

    def measured(self):
        rows = collect(self)
        sizes.append(len(pickle.dumps([tuple(r) for r in rows])))
        return rows

    monkeypatch.setattr(kind, "collect", measured)
    return sizes


@pytest.mark.parametrize("large, cells", [(10, 1 << 18), (10, 4), (10_000, 1 << 18)])
def test_heavy_shingles_are_counted_off_the_driver(spark, monkeypatch, collected, large, cells):
    rng = random.Random(5)
    common = [-(1 << 63), -1, 0, 1 << 18, (1 << 63) - 1]
    heads = [[rng.randrange(-(1 << 63), 1 << 63) for _ in range(20)] + rng.sample(common, k % 4) for k in range(200)] + [[]]
    monkeypatch.setattr(similar, "LARGE", large)
    monkeypatch.setattr(similar, "CELLS", cells)
    rows = spark.createDataFrame([(h,) for h in heads], "head array<long>").repartition(16)
    with scratch():
        found = similar.heavy_shingles(rows)
        reached = max(collected, default=0)
        found = {} if found is None else {r.h: r.n for r in found.collect()}
    want = {h: n for h, n in Counter(h for head in heads for h in head).items() if n > large}
    assert found == want and len(want) == (5 if large == 10 else 0)
    assert reached < 10_000
