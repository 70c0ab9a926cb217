"""What a task holds while it encodes is bounded: two of them stand beside an executor's heap."""

import os
import random
import sys
import tracemalloc

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))]

import pytest

from cytoloom.llm import bpe
from cytoloom.llm.queries import vocabulary


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_a_batch_of_new_words_takes_little_beside_the_cache(name):
    draw = random.Random(7)
    texts = [" ".join("".join(draw.choices("abcdefghijklmnop", k=draw.randint(4, 9))) for _ in range(280)) for _ in range(2_000)]
    encoder = bpe.load(vocabulary(name))
    tracemalloc.start()
    try:
        tokens = sum(len(ids) // 4 for ids in encoder.packed_all(texts))
        held, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert tokens > 280 * 2_000
    assert most - held < 100 << 20, f"{(most - held) >> 20} MB beside {held >> 20} MB that stay"


def test_a_task_keeps_as_many_words_as_it_is_told():
    path = vocabulary("word_bpe_49k.json")
    texts = [" ".join(f"{a}{b}" for b in "pqrstuvw" * 40) for a in ("one", "other", "one", "third")]
    few, many = bpe.load(path, bpe.ENTRY), bpe.load(path)
    # new chunks of a group are kept together, so a generation holds the last group's
    together = [ids for text in texts for ids in few.packed_all([text])]
    assert together == list(many.packed_all(texts))
    assert few.chunks.kept == bpe.ENTRY and many.chunks.kept == bpe.KEPT
    assert len(few.chunks) + len(few.chunks.old) < len(many.chunks) + len(many.chunks.old)
