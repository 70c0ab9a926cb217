"""Python workers serve one stage after another: what a stage cached goes with its tasks."""

import gc
import os
import sys

sys.path[:0] = [os.path.dirname(os.path.abspath(__file__)), os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))]

import pyarrow as pa
import pytest

from cytoloom.llm import bpe, packing
from cytoloom.llm.queries import vocabulary


def held(batches):
    """Process, and the entries of all caches of words in it."""
    list(batches)
    found = sum(len(x) + len(x.old) for x in gc.get_objects() if type(x).__name__ == "Words" and hasattr(x, "kept"))
    yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "n": [found]})


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_words_do_not_outlive_their_task(spark, name):
    docs = spark.range(400).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 50), k -> hex(xxhash64(id, k)))) AS text").repartition(8)
    pieces = packing.token_pieces(docs, vocabulary(name), 64)
    assert pieces.selectExpr("sum(length)").first()[0] > 400 * 50
    after = spark.range(0, 64, 1, 64).mapInArrow(held, "pid long, n long").collect()
    assert after and max(r.n for r in after) == 0


def test_caches_are_of_each_encoder_alone():
    path = vocabulary("byte_bpe_50k.json")
    one, other = bpe.load(path), bpe.load(path)
    ids = one.encode("a passage of words, of words")
    assert one.chunks and not other.chunks and not bpe.read(path).chunks
    assert other.encode("a passage of words, of words") == ids and other.vocab is one.vocab
