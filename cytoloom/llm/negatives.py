"""Hard negatives: rows of other labels that score just below an anchor's positives.

Vectors become whole numbers, and a score is an integer inner product. Anchors
meet all rows in blocks: for a block of anchors, chunks of rows stream past in
one task, and the best so far stay. Vectors are turned by the eigenvectors of
their second moments, so that leading components carry most of a product. A
product is added up some components at a time; what is left is at most the
product of the norms of the rest, and together with a slack for rounding that
bounds the score from both sides. Rows whose bounds can't reach the best so
far, or the window asked for, are discarded early; survivors are verified by
integer products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .arrowmap import array_sum, bound_batches
from .shared import Stored, result, scratch

#: Anchors of a block, bytes of rows in a chunk, and products that a task should make at most.
ANCHORS, CHUNK, PRODUCTS = 4_096, 1 << 20, 1 << 32
#: Shares of the components after which a product is bounded.
CUTS = (0.25, 0.5, 0.75)
#: Relative slack for rounding. Rotation and sums in doubles err by less than 4 x 10^-16 of the norms for each component, so this holds for some 10^5 components.
SLACK = 1e-10
#: Rows of a chunk that are looked at first, while nothing is known to discard by.
FIRST = 64
NOTHING = np.iinfo(np.int64).min
PACKED = "block int, slice int, kind int, ids binary, labels binary, vectors binary, more binary"
NAMES = [x.split()[0] for x in PACKED.split(", ")]


def whole_numbers(df: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """id, label, q: floor(scale * x) of the rows that take part, an id once."""
    vector = F.col(f"`{vector_col}`")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{label_col}`").cast("long").alias("label"), vector.cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(finite, F.lit(False)))
    return rows.select("id", "label", F.transform("v", lambda x: F.floor(x * scale)).alias("q"))


def once_each(rows: DataFrame) -> DataFrame:
    """Of stored rows that share an id the one of the smallest label, then vector. Only ids move where none repeat."""
    repeated = Stored(rows.groupBy("id").count().where("count > 1").select(F.col("id").alias("again")), "repeated").df
    if not repeated.take(1):
        return rows
    single = rows.join(repeated, F.col("id") == F.col("again"), "left_anti")
    several = rows.join(repeated, F.col("id") == F.col("again"), "left_semi").groupBy("id").agg(F.min(F.struct("label", "q")).alias("r"))
    return single.unionByName(several.select("id", "r.label", "r.q"))


def width_of(largest: int) -> np.dtype:
    return np.dtype(np.int16 if largest < 1 << 15 else np.int64)


def padded(vectors: list, dims: int, dtype: np.dtype) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    if all(len(v) == dims for v in vectors):
        return np.array(vectors, dtype).reshape(len(vectors), dims)
    out = np.zeros((len(vectors), dims), dtype)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def rotation_of(rows: DataFrame, dims: int, dtype: np.dtype) -> np.ndarray:
    """Eigenvectors of the second moments of all rows, those of the largest first."""

    def make():
        def step(vectors):
            x = padded(vectors, dims, dtype).astype(float)
            return (x.T @ x).ravel()

        return step

    _, vectors = np.linalg.eigh(array_sum(rows.select("q"), make, dims * dims).reshape(dims, dims))
    return vectors[:, ::-1].copy()


def packed(rows: DataFrame, dims: int, dtype: np.dtype, kind: int) -> DataFrame:
    """``rows`` (block, id, label, q, more) in records of up to ``CHUNK`` bytes of one block each. More: an array of longs."""
    most = max(1, CHUNK // max(1, dims * dtype.itemsize))
    bound_batches(rows.sparkSession)

    def record(block: int, part: list[tuple]) -> pa.RecordBatch:
        ids, labels, vectors, more = zip(*part)
        wide = max(map(len, more))
        extra = np.full((len(part), wide), NOTHING)
        for k, m in enumerate(more):
            extra[k, : len(m)] = m
        values = [block, 0, kind, np.array(ids, np.int64).tobytes(), np.array(labels, np.int64).tobytes(), padded(vectors, dims, dtype).tobytes(), extra.tobytes()]
        types = [pa.int32()] * 3 + [pa.binary()] * 4
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=NAMES)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, part = None, []
        for batch in batches:
            for b, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if part and (b != block or len(part) == most):
                    yield record(block, part)
                    part = []
                block = b
                part.append(tuple(row))
        if part:
            yield record(block, part)

    return rows.select("block", "id", "label", "q", "more").mapInArrow(pack, PACKED)


class Block:
    """Ids, labels, whole numbers, turned vectors and the norms of what is left after each cut."""

    def __init__(self, ids: bytes, labels: bytes, vectors: bytes, dims: int, dtype: np.dtype, rotation: np.ndarray):
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.whole = np.frombuffer(vectors, dtype).reshape(len(self.ids), dims)
        self.turned = self.whole.astype(float) @ rotation
        tail = np.sqrt(np.maximum((self.turned**2)[:, ::-1].cumsum(axis=1)[:, ::-1], 0))
        self.norms = np.c_[tail, np.zeros(len(self.ids))]  # of the components from each one on
        self.length = self.norms[:, 0] if dims else np.zeros(len(self.ids))

    def part(self, a: int, b: int) -> Block:
        out = object.__new__(Block)
        for name in ("ids", "labels", "whole", "turned", "norms", "length"):
            setattr(out, name, getattr(self, name)[a:b])
        return out


def products(a: np.ndarray, b: np.ndarray, largest: int) -> np.ndarray:
    """Integer inner products row by row: exact in doubles while they must stay below 2^53, else in Python's integers and held within 64 bits."""
    if largest * largest * max(1, a.shape[1]) < 1 << 53:
        return np.einsum("ij,ij->i", a.astype(float), b.astype(float)).astype(np.int64)
    exact = (a.astype(object) * b.astype(object)).sum(axis=1)
    return np.array([min(max(int(x), NOTHING + 1), -(NOTHING + 1)) for x in exact], np.int64)


def survivors(anchors: Block, rows: Block, allowed: np.ndarray, least: np.ndarray, most: np.ndarray | None, largest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, score) of the allowed pairs whose score may lie between ``least`` and ``most`` of the anchor, as far as bounds tell."""
    dims = anchors.turned.shape[1]
    cuts = sorted({0, dims, *(int(dims * c) for c in CUTS)})
    slack = SLACK * np.outer(anchors.length, rows.length) + 1e-6 if dims else np.zeros(allowed.shape)
    total, at = np.zeros(allowed.shape), None  # all pairs, then few of them
    for a, b in zip(cuts, cuts[1:]):
        if at is None:
            total += anchors.turned[:, a:b] @ rows.turned[:, a:b].T
            rest = np.outer(anchors.norms[:, b], rows.norms[:, b]) + slack
            allowed &= total + rest >= least[:, None]
            if most is not None:
                allowed &= total - rest <= most[:, None]
            if b == dims or 8 * np.count_nonzero(allowed) < allowed.size:
                at = np.nonzero(allowed)
                total, slack = total[at], slack[at]
        else:
            i, j = at
            total = total + np.einsum("ij,ij->i", anchors.turned[i, a:b], rows.turned[j, a:b])
            rest = anchors.norms[i, b] * rows.norms[j, b] + slack
            stays = total + rest >= least[i]
            if most is not None:
                stays &= total - rest <= most[i]
            at, total, slack = (i[stays], j[stays]), total[stays], slack[stays]
    i, j = at if at is not None else np.nonzero(allowed)
    return i, j, products(anchors.whole[i], rows.whole[j], largest)


class Best:
    """The first few (score, id) of each anchor: higher scores first, then smaller ids."""

    def __init__(self, n: int, most: int):
        self.most = most
        self.score, self.id = np.full((n, most), NOTHING), np.full((n, most), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        """The last one's score; what is lower doesn't matter any more."""
        return self.score[:, -1]

    def add(self, of: np.ndarray, score: np.ndarray, id_: np.ndarray) -> None:
        stays = score >= self.score[of, -1]
        of, score, id_ = of[stays], score[stays], id_[stays]
        if not len(of):
            return
        who = np.unique(of)
        there = np.repeat(who, self.most)
        of, score, id_ = np.r_[there, of], np.r_[self.score[who].ravel(), score], np.r_[self.id[who].ravel(), id_]
        order = np.lexsort((id_, ~score, of))
        of, score, id_ = of[order], score[order], id_[order]
        first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        take = (first[:, None] + np.arange(self.most)).ravel()
        self.score[who], self.id[who] = score[take].reshape(-1, self.most), id_[take].reshape(-1, self.most)


class Positives:
    """The best rows of an anchor's own label."""

    def __init__(self, anchors: Block, more: np.ndarray, most: int):
        self.anchors, self.best = anchors, Best(len(anchors.ids), most)

    def meet(self, rows: Block, largest: int) -> None:
        a = self.anchors
        allowed = (a.labels[:, None] == rows.labels) & (a.ids[:, None] != rows.ids)
        known = self.best.least()
        i, j, s = survivors(a, rows, allowed, np.where(known == NOTHING, -np.inf, known), None, largest)
        self.best.add(i, s, rows.ids[j])

    def rows(self) -> Iterator[tuple]:
        some = self.best.score > NOTHING
        i, k = np.nonzero(some)
        yield self.anchors.ids[i], self.best.id[some], self.best.score[some], self.best.score[some]


class Negatives:
    """The best rows of other labels within the window of each of an anchor's positives; ``more`` holds the windows' ends."""

    def __init__(self, anchors: Block, more: np.ndarray, most: int):
        self.anchors = anchors
        windows = more.reshape(len(anchors.ids), -1, 4)  # positive's id and score, from, to
        self.ids, self.scores, self.low, self.high = (windows[:, :, k] for k in range(4))
        self.open = (self.low > NOTHING) & (self.low <= self.high)
        self.best = [Best(len(anchors.ids), most) for _ in range(windows.shape[1])]

    def meet(self, rows: Block, largest: int) -> None:
        a = self.anchors
        least = np.full(self.low.shape, np.inf)
        for w, best in enumerate(self.best):
            least[:, w] = np.where(self.open[:, w], np.maximum(self.low[:, w], best.least()), np.inf)
        most = np.where(self.open, self.high, -np.inf).max(axis=1, initial=-np.inf)
        allowed = (a.labels[:, None] != rows.labels) & (a.ids[:, None] != rows.ids)
        i, j, s = survivors(a, rows, allowed, least.min(axis=1, initial=np.inf), most, largest)
        for w, best in enumerate(self.best):
            inside = self.open[i, w] & (self.low[i, w] <= s) & (s <= self.high[i, w])
            best.add(i[inside], s[inside], rows.ids[j[inside]])

    def rows(self) -> Iterator[tuple]:
        for w, best in enumerate(self.best):
            some = best.score > NOTHING
            i, _ = np.nonzero(some)
            yield self.anchors.ids[i], self.ids[i, w], best.id[some], self.scores[i, w], best.score[some]


def meetings(anchors: DataFrame, rows: DataFrame, blocks: int, slices: int, of: type, most: int, dims: int, dtype: np.dtype, rotation: np.ndarray, largest: int, schema: str) -> DataFrame:
    """What ``of`` keeps of each block of packed anchors when a slice of the packed rows has passed."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = anchors.withColumn("slice", every(slices))
    # the number of a record is mixed before it is dealt, so that each block's slices are even
    r = rows.withColumn("slice", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slices)).cast("int")).withColumn("block", every(blocks))
    tasks = max(blocks * slices, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    both = a.unionByName(r).select(*NAMES).repartition(tasks, "block", "slice").sortWithinPartitions("block", "slice", "kind")
    names = [x.split()[0] for x in schema.split(", ")]

    def told(state) -> Iterator[pa.RecordBatch]:
        for found in state.rows():
            cols = found[: len(names)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, state = None, [], None
        for batch in batches:
            for block, slice_, kind, *content in zip(*(c.to_pylist() for c in batch.columns)):
                if (block, slice_) != key:
                    if state is not None:
                        yield from told(state)
                    key, waiting, state = (block, slice_), [], None
                if kind == 0:
                    waiting.append(content)
                    continue
                if state is None and not waiting:
                    continue  # a block that no anchor fell into
                if state is None:
                    ids, labels, vectors, more = (b"".join(x) for x in zip(*waiting))
                    state = of(Block(ids, labels, vectors, dims, dtype, rotation), np.frombuffer(more, np.int64), most)
                chunk = Block(*content[:3], dims, dtype, rotation)
                at, step = 0, FIRST
                while at < len(chunk.ids):
                    state.meet(chunk.part(at, at + step), largest)
                    at, step = at + step, step * 4
        if state is not None:
            yield from told(state)

    return both.mapInArrow(meet, schema)


def mine(
    df: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchor``: a condition on the column ``id``, of the rows that ask. An
    anchor's positives are its ``positives`` best other rows of its label; for
    each, the ``negatives`` best rows of other labels that score from ``low``
    to ``high`` percent of it. Ties go by smaller id. Scores are of vectors
    times ``scale``, rounded down, and held within 64 bits; shorter vectors end
    in zeros.

    Rows with a null id, label or vector, or a component that is null or not
    finite, take no part. Labels are whole numbers. Rows that share an id are
    one: that of the smallest label, then vector. Other columns are not read.
    An empty table, or one without anchors, gives an empty result.
    """
    with scratch():
        rows = Stored(whole_numbers(df, id_col, vector_col, label_col, scale), "vectors").df
        rows = Stored(once_each(rows), "once").df
        size = F.coalesce(F.greatest(F.abs(F.array_max("q")), F.abs(F.array_min("q"))), F.lit(0))
        n, dims, largest, asked = rows.agg(F.count(F.lit(1)), F.max(F.size("q")), F.max(size), F.count(F.when(anchor, 1))).first()
        dims, largest = dims or 0, largest or 0
        dtype = width_of(largest)
        rotation = rotation_of(rows, dims, dtype) if dims else np.zeros((0, 0))
        blocks = max(1, -(-asked // ANCHORS))
        slices = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks, -(-n * min(asked, ANCHORS) // PRODUCTS), 1)
        none = F.array().cast("array<long>")
        chunks = Stored(packed(rows.select(F.lit(0).alias("block"), "id", "label", "q", none.alias("more")), dims, dtype, 1).drop("slice", "block"), "chunks").df
        asking = rows.where(anchor).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
        asking = Stored(asking.repartition("block"), "anchors").df

        def meet(asking: DataFrame, of: type, most: int, schema: str) -> DataFrame:
            together = asking.repartition("block").sortWithinPartitions("block")
            return meetings(packed(together, dims, dtype, 0).drop("slice"), chunks, blocks, slices, of, most, dims, dtype, rotation, largest, schema)

        first = meet(asking.withColumn("more", none), Positives, positives, "anchor_id long, id long, score long")
        best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
        found = Stored(first.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives), "positives").df
        # whole numbers from low to high percent: the ends rounded inwards
        window = F.array(
            F.col("id"), F.col("score"), F.expr(f"-(cast(floor(-cast({low} as decimal(38,0)) * score / 100) as bigint))"), F.expr(f"cast(floor(cast({high} as decimal(38,0)) * score / 100) as bigint)")
        )
        windows = found.groupBy("anchor_id").agg(F.flatten(F.collect_list(window)).alias("more"))
        second = meet(asking.join(windows, F.col("id") == F.col("anchor_id")).drop("anchor_id"), Negatives, negatives, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
        best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
        found = second.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
        return result(found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
