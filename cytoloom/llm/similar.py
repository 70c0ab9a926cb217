"""Near copies by exact shingle similarity: SimHash finds most of the pairs, a prefix join all others.

Texts are sets of hashes of word shingles; two are near when the Jaccard
similarity of their sets reaches a bound. Fingerprints within a few bits are
looked for first, by the trie join, and kept where the sets agree. At a
similarity of 0.8 fingerprints differ in some 10 of 64 bits and often more, and
no budget of bits finds all of these, so the rest is found by prefixes: in any
order of all shingles, two near sets share one among the first
n - ceil(0.8 n) + 1 of each. Frequent shingles come last in that order, so that
few texts meet in a bucket. Texts that are in one class already are not paired.

Texts that meet are compared by parity sketches: each member flips one bit of
a sketch of a few bits a member, so two sketches differ in at most as many bits
as the sets in members. Those that meet at one shingle make a run, equal runs
count once, and a run gives no square of pairs: first a spanning forest of what
sketches allow, which is verified on the whole sets and joins most classes,
then what they still allow between different classes. So no link is lost, and
a group of near copies gives about as many pairs as texts. Whole sets are made
again for the texts of pairs; only prefixes and sketches are stored.

Shingles that very many prefixes hold are counted before a task loads them. In
each a text is drawn that all others there are held against, some times over,
so that groups of near copies become one class and need no more pairs; what
still has several classes is dealt into parts that meet two by two.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowmap import giving_back, map_lists
from .components import components
from .shared import Stored, beside, result, scratch, without
from .simhash import BUDGET, bucket_edges, majority, shingle_digests, signed

WORDS = 5
SIMILARITY = 0.8
#: Documents of the sample that tells frequent shingles, and the most shingles it may name. They only set the order.
SAMPLE, FREQUENT = 20_000, 100_000
#: Bits of a sketch, at least and at most.
NARROW, WIDE = 64, 1 << 16
#: Rows of prefixes, and of runs with sketches, that a task should hold; members beyond which a run is split.
ROWS, SKETCHES, LARGE = 2_000_000, 200_000, 4_096
#: Times that the texts of a split shingle are held against a drawn one; cells that shingles are counted in first.
DRAWS, CELLS = 3, 1 << 18
#: Pairs of two classes from which a forest takes them for one, forest by forest; 0 for all pairs that are left.
FORESTS = (1, 8, 0)


def shingle_set(digests: bytes) -> np.ndarray:
    """The distinct hashes, ascending."""
    return np.unique(np.frombuffer(digests, ">u8").astype(np.uint64)).view(np.int64)


def least_common(size: int, similarity: float) -> int:
    """The fewest members a set of ``size`` shares with one at least so similar."""
    return max(1, math.ceil(similarity * size - 1e-9))


def frequent_shingles(docs: DataFrame, words: int) -> list[int]:
    """Hashes that three or more texts of a sample have, the least frequent first."""
    n = docs.count()
    if n > SAMPLE:
        docs = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < (SAMPLE << 20) // n)

    def make():
        return lambda texts: ([shingle_set(shingle_digests(t, words)) for t in texts],)

    found = map_lists(docs.select("text"), make, "s array<long>").select(F.explode("s").alias("h")).groupBy("h").count().where("count >= 3")
    return [r.h for r in reversed(found.orderBy(F.desc("count"), "h").limit(FREQUENT).collect())]


def node_of(shingles: np.ndarray) -> tuple[int, int]:
    """A set's number, and another one by which two sets of one number are told apart."""
    digest = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return signed(digest >> 64), signed(digest & (1 << 64) - 1)


def told_apart(rows: DataFrame, shared: DataFrame | None) -> DataFrame:
    """Numbers in ``shared`` are made from both; without ``other``."""
    if shared is None:
        return rows.drop("other")
    rows = rows.join(beside(shared), F.col("node") == F.col("shared"), "left")
    return rows.withColumn("node", F.when(F.col("shared").isNotNull(), F.xxhash64("node", "other")).otherwise(F.col("node"))).drop("shared", "other")


def sketch(shingles: np.ndarray) -> bytes:
    """Parity of the members in each of two to four cells a member, a power of two."""
    bits = min(WIDE, max(NARROW, 1 << (2 * max(len(shingles), 1) - 1).bit_length()))
    return np.packbits(np.bincount(shingles.astype(np.uint64) % np.uint64(bits), minlength=bits) & 1 == 1, bitorder="little").tobytes()


def possible(a: bytes, b: bytes, sizes: int, similarity: float) -> bool:
    """Whether sets of these sketches and of so many members in all may be so similar."""
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    while len(x) != len(y):  # the wider one folds: a cell is then one of its members modulo half as many
        x, y = (x, y) if len(x) < len(y) else (y, x)
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum()) <= sizes * (1 - similarity) / (1 + similarity) + 1e-9


def shingle_rows(docs: DataFrame, words: int, similarity: float, frequent: list[int]) -> DataFrame:
    """doc_id, key, node and other (digests of the set), fp, size, sketch, head: the set's prefix when frequent ones come last."""
    names = np.array(frequent, np.int64)
    by_value = np.argsort(names)
    names = names[by_value]

    def prefix(s: np.ndarray) -> np.ndarray:
        n = len(s) - least_common(len(s), similarity) + 1
        if not len(names):
            return s[:n]
        at = np.minimum(np.searchsorted(names, s), len(names) - 1)
        known = names[at] == s
        rare = s[~known]
        return rare[:n] if len(rare) >= n else np.r_[rare, s[known][np.argsort(by_value[at[known]])][: n - len(rare)]]

    def make():
        def step(ids, keys, texts):
            nodes, others, fps, sizes, sketches, heads = [], [], [], [], [], []
            for t in texts:
                digests = shingle_digests(t, words)
                s = shingle_set(digests)
                node, other = node_of(s)
                nodes.append(node)
                others.append(other)
                fps.append(signed(majority(digests)) if digests else 0)
                sizes.append(len(s))
                sketches.append(sketch(s))
                heads.append(prefix(s))
            return ids, keys, nodes, others, fps, sizes, sketches, heads

        return step

    kind = dict(docs.dtypes)["doc_id"]
    return map_lists(docs.select("doc_id", "key", "text"), make, f"doc_id {kind}, key long, node long, other long, fp long, size int, sketch binary, head array<long>")


def whole_sets(docs: DataFrame, words: int, shared: DataFrame | None = None) -> DataFrame:
    """node, s: the sets of shingles of the texts."""

    def make():
        def step(texts):
            sets = [shingle_set(shingle_digests(t, words)) for t in texts]
            return *zip(*map(node_of, sets)), sets

        return step

    return told_apart(map_lists(docs.select("text"), make, "node long, other long, s array<long>"), shared)


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64 bits of each number."""
    x = x.view(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def heavy_shingles(rows: DataFrame) -> DataFrame | None:
    """h, n: shingles that more than ``LARGE`` prefixes hold, if any may. Only those in cells of so many are counted one by one.

    Cells are counted where the prefixes are and added by a shuffle; no count reaches the driver.
    """
    held = rows.select(F.explode("head").alias("h")).withColumn("in_cell", F.col("h").bitwiseAND(F.lit(CELLS - 1)))
    full = held.groupBy(F.col("in_cell").alias("cell")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE).select("cell")
    full = Stored(full, "cells").df
    if full.isEmpty():
        return None
    counted = held.join(beside(full), F.col("in_cell") == F.col("cell"), "left_semi").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    return Stored(counted.where(F.col("n") > LARGE), "heavy").df


def classes_in(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """h, n, several: whether the texts whose prefixes hold a heavy shingle are of several classes."""
    held = rows.select("class", F.explode("head").alias("h")).join(beside(heavy.select(F.col("h").alias("heavy"), "n")), F.col("h") == F.col("heavy"))
    return held.groupBy("h").agg(F.first("n").alias("n"), (F.min("class") != F.max("class")).alias("several"))


def drawn_pairs(rows: DataFrame, heavy: DataFrame, draw: int) -> DataFrame:
    """a, b: the texts of each heavy shingle of several classes, each with one that is drawn, if that is of another class."""
    held = rows.select("node", "class", F.explode("head").alias("h")).join(beside(heavy.select(F.col("h").alias("heavy"))), F.col("h") == F.col("heavy"), "left_semi")
    held = Stored(held, "held").df  # so that the join below can split a shingle of very many texts
    drawn = held.groupBy("h").agg(F.min(F.struct(F.xxhash64("node", F.lit(draw)).alias("lot"), "node", "class")).alias("d"))
    drawn = Stored(drawn.select(F.col("h").alias("of"), F.col("d.node").alias("one"), F.col("d.class").alias("its")), "drawn").df
    both = held.join(drawn, F.col("h") == F.col("of")).where("class <> its")
    return both.select(F.least("node", "one").alias("a"), F.greatest("node", "one").alias("b"))


def prefix_runs(rows: DataFrame, heavy: DataFrame | None = None) -> DataFrame:
    """run, node, least: the nodes, of two classes or more, whose prefixes share a shingle, and the smallest of them; equal runs count once.

    ``rows``: node, class, head; those of one node count once, but are better
    not repeated. Shingles of very many texts are dealt into parts, every two
    of which are a run, before any task loads them; ``heavy`` has them where
    they are known.
    """
    wanted = rows.agg(F.sum(F.size("head"))).first()[0] or 0
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1, wanted // ROWS)
    keyed = rows.select("node", "class", F.explode("head").alias("h")).withColumn("sub", F.lit(0).cast("long"))
    heavy = heavy_shingles(rows) if heavy is None else heavy
    if heavy is not None:
        deals = classes_in(rows, heavy).select(F.col("h").alias("heavy"), F.when(F.col("several"), F.ceil(2 * F.col("n") / LARGE)).otherwise(0).alias("deals"))
        keyed = keyed.join(beside(Stored(deals, "deals").df), F.col("h") == F.col("heavy"), "left")
        other = F.when(F.col("deals").isNull(), F.array(F.lit(0).cast("long"))).when(F.col("deals") > 0, F.sequence(F.lit(0).cast("long"), F.col("deals") - 1))
        keyed = keyed.withColumn("other", F.explode(other)).withColumn("own", F.pmod(F.xxhash64("node"), F.col("deals")))
        sub = F.least("own", "other") * F.col("deals") + F.greatest("own", "other")
        keyed = keyed.select("node", "class", "h", F.coalesce(sub, F.lit(0).cast("long")).alias("sub"))
    keyed = keyed.repartition(parts, "h", "sub")

    def run(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        h, sub, node, of = (table[c].to_numpy() for c in ("h", "sub", "node", "class"))
        order = np.lexsort((node, sub, h))
        h, sub, node, of = (x[order] for x in (h, sub, node, of))
        begins = (h[1:] != h[:-1]) | (sub[1:] != sub[:-1])
        fresh = np.r_[True, begins | (node[1:] != node[:-1])]
        starts = np.r_[True, begins][fresh]
        node, of = node[fresh], of[fresh]
        starts = np.flatnonzero(starts)
        sizes = np.diff(np.r_[starts, len(node)])
        with np.errstate(over="ignore"):
            sums = np.add.reduceat(mixed(node), starts)
        several = np.minimum.reduceat(of, starts) != np.maximum.reduceat(of, starts)
        first = np.zeros(len(starts), bool)
        first[np.flatnonzero(several)[np.unique(sums[several], return_index=True)[1]]] = True
        keep = np.repeat(first, sizes)
        columns = [np.repeat(sums, sizes)[keep].view(np.int64), node[keep], np.repeat(node[starts], sizes)[keep]]
        for at in range(0, len(columns[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(c[at : at + (1 << 16)]) for c in columns], names=["run", "node", "least"])

    return keyed.mapInArrow(giving_back(run), "run long, node long, least long").distinct()


def folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of the narrowest one's width: halves of wider ones are added, so a cell is one of its members modulo fewer."""
    words = min(map(len, sketches)) // 8
    out = np.zeros((len(sketches), words), np.uint64)
    for k, v in enumerate(sketches):
        out[k] = np.bitwise_xor.reduce(np.frombuffer(v, np.uint64).reshape(-1, words), axis=0)
    return out


def allowed_pairs(node: np.ndarray, of: np.ndarray, size: np.ndarray, sketches: list[bytes], similarity: float, forest: int) -> list[tuple[int, int]]:
    """Pairs of different classes whose sketches allow the similarity; with ``forest`` two classes count as one from so many pairs of theirs on."""
    order = np.lexsort((node, size))
    node, of, size, sketches = node[order], of[order].copy(), size[order].astype(np.int64), [sketches[k] for k in order]
    until = np.searchsorted(size, np.floor(size / similarity + 1e-9).astype(np.int64), "right")
    most, out, at, base, last = (1 - similarity) / (1 + similarity), [], None, 0, 0
    seen = Counter()
    for i in range(len(node) - 1):
        j = int(until[i])
        if j <= i + 1 or (of[i + 1 : j] == of[i]).all():
            continue
        if j > last:  # fold anew; within the window sizes, and so widths, differ by a factor of two or so
            base, last = i, max(j, int(np.searchsorted(size, 2 * size[i], "right")))
            at = folded(sketches[base:last])
        bits = np.bitwise_count(at[i + 1 - base : j - base] ^ at[i - base]).sum(axis=1)
        room = (size[i + 1 : j] + size[i]) * most - bits
        near = np.flatnonzero((room >= -1e-9) & (of[i + 1 : j] != of[i])) + i + 1
        if forest and len(near):
            near = near[np.argsort(-room[near - i - 1], kind="stable")]  # of a class the likeliest one
            labels, first = np.unique(of[near], return_index=True)
            near = near[first]
            if forest > 1:
                both = [(min(int(of[i]), c), max(int(of[i]), c)) for c in labels.tolist()]
                seen.update(both)
                labels = labels[[seen[k] >= forest for k in both]]
            of[np.isin(of, labels)] = of[i]
        out += [(int(min(node[i], node[k])), int(max(node[i], node[k]))) for k in near]
    return out


def run_pairs(runs: DataFrame, nodes: DataFrame, similarity: float, forest: int) -> DataFrame:
    """a, b: pairs within the runs of what sketches allow; ``nodes``: node, class, size, sketch.

    Near copies meet in many runs. Those with one smallest node are of one
    task, which makes a pair once; they are at most as many as its prefix has
    shingles.
    """
    tasks = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1, runs.count() // SKETCHES)
    keyed = runs.join(nodes, "node").select("run", "node", "least", "class", "size", "sketch").repartition(tasks, "least")

    def run(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        name, node, of, size = (table[c].to_numpy() for c in ("run", "node", "class", "size"))
        sketches = table["sketch"].to_pylist()
        order = np.lexsort((node, name))
        starts = np.flatnonzero(np.r_[True, np.diff(name[order]) != 0])
        found = set()
        for a, b in zip(starts, np.r_[starts[1:], len(order)]):
            if b - a > 1:
                k = order[a:b]
                found.update(allowed_pairs(node[k], of[k], size[k], [sketches[x] for x in k], similarity, forest))
        found = np.array(sorted(found), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["a", "b"])

    return keyed.mapInArrow(giving_back(run), "a long, b long")


def verified(pairs: DataFrame, docs: DataFrame, rows: DataFrame, similarity: float, words: int, shared: DataFrame | None = None) -> DataFrame:
    """src, dst: the pairs whose whole sets are so similar."""
    nodes = rows.groupBy("node").agg(F.min(F.struct("size", "sketch")).alias("of"))
    pairs = Stored(pairs.where("a <> b").distinct(), "pairs").df
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("of.size").alias(f"{end}_size"), F.col("of.sketch").alias(f"{end}_sketch")), end)

    def make():
        def step(a, b, a_sizes, a_sketches, b_sizes, b_sketches):
            left = [k for k in range(len(a)) if possible(a_sketches[k], b_sketches[k], a_sizes[k] + b_sizes[k], similarity)]
            return [a[k] for k in left], [b[k] for k in left]

        return step

    pairs = Stored(map_lists(pairs.select("a", "b", "a_size", "a_sketch", "b_size", "b_sketch"), make, "a long, b long"), "possible").df
    there = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    keys = rows.select("node", "key").join(beside(Stored(there, "paired").df), "node", "left_semi").groupBy("node").agg(F.min("key").alias("key"))
    keys = beside(Stored(keys.select("key").distinct(), "keys").df)
    # one shuffle by node, which both joins read; the second moves a set for each pair
    sets = whole_sets(docs.join(keys, "key", "left_semi"), words, shared).groupBy("node").agg(F.first("s").alias("s"))
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(common >= similarity * (F.size("sa") + F.size("sb") - common) - 1e-9).select(F.col("a").alias("src"), F.col("b").alias("dst"))


def once_each(rows: DataFrame) -> DataFrame:
    """``rows`` (stored, with a column rid), one of each node. While few repeat one they alone are moved."""
    first = rows.groupBy("node").agg(F.min("rid").alias("first"))
    others = rows.select("node", "rid").join(first, "node").where("rid <> first").select(F.col("rid").alias("other"))
    others = Stored(others, "others").df
    return rows.join(beside(others), F.col("rid") == F.col("other"), "left_anti")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, words: int = WORDS, budget: int = BUDGET) -> DataFrame:
    """doc_id, component_id of each row: the smallest doc_id reachable over pairs of at least the similarity.

    Texts without words are alike; null is empty text. A null id is passed over
    in the minimum, repeated rows give repeated rows, other columns are not
    read, an empty table gives an empty result.
    """
    with scratch():
        return result(classes_of(docs, id_col, text_col, similarity, words, budget), "near-copies")


def classes_of(docs: DataFrame, id_col: str, text_col: str, similarity: float, words: int, budget: int) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    docs = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))
    rows = shingle_rows(docs, words, similarity, frequent_shingles(docs, words)).withColumn("rid", F.monotonically_increasing_id())
    rows = Stored(rows, "shingles").df
    shared = rows.groupBy("node").agg(F.min("other").alias("lo"), F.max("other").alias("hi")).where("lo <> hi").select(F.col("node").alias("shared"))
    shared = Stored(shared, "shared").df
    shared = None if shared.isEmpty() else shared
    rows = told_apart(rows, shared)
    first = Stored(rows.groupBy("fp").agg(F.min("node").alias("first")), "fingerprints").df
    same = rows.select("fp", "node").distinct().join(first, "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    found = bucket_edges(first.select("fp"), budget).distinct()
    found = found.join(first.select(F.col("fp").alias("src"), F.col("first").alias("a")), "src").join(first.select(F.col("fp").alias("dst"), F.col("first").alias("b")), "dst").select("a", "b")
    edges = Stored(verified(same.union(found), docs, rows, similarity, words, shared), "near").df
    nodes = Stored(once_each(rows).select("node", "size", "sketch", "head"), "nodes").df

    def classed(edges: DataFrame) -> DataFrame:
        classes = Stored(components(edges).where("node <> component").withColumnRenamed("component", "class"), "classes").df
        return nodes.join(beside(classes), "node", "left").withColumn("class", F.coalesce("class", "node"))

    known = classed(edges)
    heavy = all_heavy = heavy_shingles(nodes)
    for draw in range(DRAWS if heavy is not None else 0):
        heavy = Stored(classes_in(known, heavy).where("several").select("h", "n"), "heavy").df
        if heavy.isEmpty():
            break
        edges = Stored(edges.union(verified(drawn_pairs(known, heavy, draw), docs, rows, similarity, words, shared)), "near").df
        known = classed(edges)
    runs = Stored(prefix_runs(known, all_heavy), "runs").df
    for forest in FORESTS:
        pairs = run_pairs(runs, known.select("node", "class", "size", "sketch"), similarity, forest)
        new = Stored(verified(pairs, docs, rows, similarity, words, shared), "links").df
        edges = Stored(edges.union(new), "near").df
        known = classed(edges) if forest else known
    classes = Stored(components(edges), "classes").df
    members = Stored(rows.join(classes, "node", "left").select("doc_id", F.coalesce("component", "node").alias("component")), "members").df
    least = Stored(members.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least").df
    return members.join(least, "component").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id is the smallest of their component; rows of null id stay only where no other is near."""
    with scratch():
        found = classes_of(docs, id_col, text_col, SIMILARITY, WORDS, BUDGET)
        return without(docs, found.select("doc_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), id_col)
