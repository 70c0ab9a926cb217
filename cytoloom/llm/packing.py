"""Best-two-fit packing of token sequences.

Packing depends on lengths alone, and there are at most as many lengths as a
sequence has places. So the corpus is reduced to a histogram of lengths, the
packing is planned on it as patterns with multiplicities, and every piece then
finds its place from its rank among the pieces of its length. What the driver
holds and sends is bounded by the capacity, not by the number of documents.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from .arrowmap import map_lists
from .shared import Stored, result, scratch


def two_closest(lengths: list[int], left: dict[int, int], room: int) -> tuple[int, int]:
    """Two unpacked lengths whose sum comes closest to ``room`` from below; (0, 0) if none."""
    best, pair, i, j = 0, (0, 0), 0, bisect_right(lengths, room) - 1
    while i <= j:
        total = lengths[i] + lengths[j]
        if total > room or i == j and left[lengths[i]] < 2:
            j -= 1
            continue
        if total > best:
            best, pair = total, (lengths[j], lengths[i])
            if best == room:
                break
        i += 1
    return pair


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths of one bin, largest first) and how many bins have each.

    A bin takes the largest unpacked length that fits until none does; then its
    smallest is replaced by the two unpacked ones that fill the gap and its
    place best, as long as that leaves less room. The bin is repeated while the
    lengths last, so the patterns number a few times the distinct lengths.
    """
    left = {n: k for n, k in histogram.items() if k > 0}
    lengths = sorted(left)
    patterns = []

    def take(n: int) -> None:
        left[n] -= 1
        if not left[n]:
            lengths.remove(n)

    def put_back(n: int) -> None:
        if not left[n]:
            insort(lengths, n)
        left[n] += 1

    while lengths:
        filled, gap = [], capacity
        while (at := bisect_right(lengths, gap)) and gap:
            filled.append(lengths[at - 1])
            gap -= filled[-1]
            take(filled[-1])
        while gap and len(filled) > 1:
            pair = two_closest(lengths, left, gap + filled[-1])
            if sum(pair) <= filled[-1]:
                break
            gap -= sum(pair) - filled[-1]
            put_back(filled.pop())
            for n in pair:
                take(n)
            filled = sorted([*filled, *pair], reverse=True)
        uses = {n: filled.count(n) for n in set(filled)}
        more = min(left[n] // k for n, k in uses.items())
        for n, k in uses.items():
            left[n] -= more * k
            if not left[n] and n in lengths:
                lengths.remove(n)
        patterns.append((filled, 1 + more))
    return patterns


class Places:
    """Where the piece of a rank among those of its length goes."""

    def __init__(self, patterns: list[tuple[list[int], int]]):
        used: dict[int, int] = {}
        rows, sequence = [], 0
        for filled, bins in patterns:
            offset = 0
            for n in dict.fromkeys(filled):
                k = filled.count(n)
                rows.append((n, used.get(n, 0), k, sequence, offset))
                used[n] = used.get(n, 0) + k * bins
                offset += k * n
            sequence += bins
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        self.length, self.first, self.each, self.sequence, self.offset = table.T.copy()
        self.key = (self.length << 48) + self.first

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 48) + rank, side="right") - 1
        nth = rank - self.first[at]
        return self.sequence[at] + nth // self.each[at], self.offset[at] + nth % self.each[at] * length


def token_pieces(
    docs: DataFrame, path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", kept: int | None = None
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and an end id, cut at ``capacity``; ``kept`` as for ``bpe.load``."""

    def make():
        encoder, end = bpe.load(path, kept), end_id.to_bytes(4, "little")

        def step(ids_of, texts):
            out = [], [], [], [], []
            for doc, ids in zip(ids_of, encoder.packed_all([text or "" for text in texts])):
                ids += end
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    for column, value in zip(out, (doc, piece, start // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            return out

        return step

    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`"))
    return map_lists(rows, make, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` with sequence_id and offset; sequences have no gaps before their end.

    Needs a long column ``length`` from 1 to ``capacity``; the others are only
    carried, whatever their names. Pieces of one length are ranked in buckets
    whose number follows the number of rows; a random number written beside
    each piece deals them, so neither a length that a third of the pieces
    share nor a row that repeats as often makes a large task. The result is
    written. No pieces give no rows.
    """
    names, kinds = pieces.columns, dict(pieces.dtypes)
    at = names.index("length")
    with scratch():
        # columns go by number meanwhile, so that no name clashes with the new ones
        numbered = pieces.select(*[F.col(f"`{c}`").alias(str(k)) for k, c in enumerate(names)], F.rand().alias("salt"))
        dealt = Stored(numbered, "pieces").df
        buckets = max(64, dealt.count() // 50_000)
        dealt = dealt.withColumn("bucket", F.floor(F.col("salt") * buckets)).withColumn("length", F.col(f"`{at}`"))
        counts = Stored(dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "lengths").df
        histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
        places = Places(plan(histogram, capacity))
        before = Window.partitionBy("length").orderBy("bucket")
        firsts = counts.select("length", "bucket", (F.sum("n").over(before) - F.col("n")).alias("first"))
        within = Window.partitionBy("length", "bucket").orderBy("salt", *[str(k) for k in range(len(names))])
        ranked = dealt.withColumn("nth", F.row_number().over(within)).join(firsts, ["length", "bucket"])
        ranked = ranked.select(*[F.col(f"`{k}`") for k in range(len(names))], (F.col("first") + F.col("nth") - 1).alias("rank"))

        def make():
            def step(*columns):
                sequence, offset = places.find(np.array(columns[at], np.int64), np.array(columns[-1], np.int64))
                return *columns[:-1], sequence, offset

            return step

        return result(map_lists(ranked, make, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", sequence_id long, offset long"), "packed")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, kept: int | None = None) -> DataFrame:
    """All documents in sequences of at most ``capacity`` tokens, as a written table.

    Null text is empty text, one end id. Null ids, repeated rows and equal
    texts each get a place of their own. Other columns are not read. An empty
    table gives an empty result. ``kept``: bytes of words that a task keeps
    with their ids in each of two generations; fewer cost time, not results.
    """
    return pack(token_pieces(docs, path, capacity, end_id, kept=kept), capacity)
