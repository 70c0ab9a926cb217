"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are first made distinct. Two that differ in at most k bits agree
wholly in all but k of any n blocks of their bits, so each goes to one bucket
for every choice of n-k blocks, and its partners meet it there. n grows from
k+1 with the number of fingerprints, so that buckets stay small. A bucket is a binary trie over the remaining
bits: pairs of its nodes are traversed together, differing bits accumulate,
and a pair goes when they exceed the budget. Since classes and not pairs are
wanted, the budget is raised from one bit up, links found join their leaves,
and node pairs whose leaves all are of one class already go too; a bucket
emits at most one edge a member, so a group of near copies makes no square.

Buckets of more members than a task should traverse are dealt into even parts
by a hash, as many as their size asks for, and every pair of parts is a bucket
of its own: bits of the trie would leave a group of near copies mostly in one
part, and none of their sub-tries is too far from another to be pruned.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowmap import map_lists
from .components import components
from .shared import Stored, result, scratch, without

WORDS = 4
BUDGET = 4
#: Members that even buckets hold on average at most, and those beyond which a bucket is split.
EVEN, LARGE = 1_024, 16_384
#: Rows that a task should take in.
ROWS = 500_000
#: Node pairs expanded at once.
AT_ONCE = 1 << 18


def shingle_digests(text: str | None, words: int, seed: int = 42) -> bytes:
    """XXH64 of each word shingle in order, 8 bytes each, repeats included; a shorter text is one shingle."""
    parts = (text or "").encode().lower().split()  # of bytes: A-Z and ASCII white space only
    if not parts:
        return b""
    joined = b" ".join(parts)
    digest = xxhash.xxh64_digest
    if len(parts) <= words:
        return digest(joined, seed)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(parts) - words + 1].tolist()
    return b"".join([digest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :].tolist())])


def simhash(text: str | None, words: int = WORDS, seed: int = 42) -> int:
    """64 bits: each set if set in over half of the XXH64 hashes of the word shingles; 0 without words."""
    return majority(shingle_digests(text, words, seed))


def majority(hashes: bytes) -> int:
    """Bits set in over half of the hashes of 8 bytes each."""
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(bits), 1 << 14):
        counts += bits[at : at + (1 << 14)].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(bits)).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def make():
        return lambda ids, texts: (ids, [signed(simhash(t, words)) for t in texts])

    kind = dict(docs.dtypes)[id_col]
    return map_lists(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`")), make, f"doc_id {kind}, fp long")


def blocks(n: int) -> list[tuple[int, int]]:
    """(shift, width) of n blocks that cover 64 bits."""
    cuts = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def enough_blocks(fingerprints: int, budget: int, most: int = EVEN) -> int:
    """The fewest blocks at which even buckets of so many fingerprints hold ``most`` at most; 2 (budget + 2) in any case."""
    n = budget + 1
    while n < 2 * (budget + 2) and fingerprints / 2.0 ** (64 * (n - budget) // n) > most:
        n += 1
    return n


class Classes:
    """Union-find over 0..n-1 by repeated pointer jumping on arrays; the label is the smallest member."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.of[a], self.of[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.of[self.of]
                if (up == self.of).all():
                    break
                self.of = up


def trie_classes(key: np.ndarray, value: np.ndarray, budget: int, side: np.ndarray | None = None) -> np.ndarray:
    """Class (index of a smallest member) of each row: rows of one key link where values differ in at most ``budget`` bits.

    Rows must be sorted by key, then value (unsigned); the trie's nodes are
    ranges of them. Implicit nodes at depth d of a key are the runs of equal
    top d bits, found by bisection of the range, so no tree is stored.
    """
    n = len(key)
    classes = Classes(n)
    if n < 2:
        return classes.of
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    last = np.r_[first[1:], n]
    for limit in range(1, budget + 1):
        changes = np.flatnonzero(classes.of[1:] != classes.of[:-1])  # a range holds one class iff none lies in it
        several = last - first > 1
        stack = [(np.zeros(several.sum(), np.int64), first[several], last[several], first[several], last[several], np.zeros(several.sum(), np.int64))]
        while stack:
            depth, a, b, c, d, off = stack.pop()
            if len(a) > AT_ONCE:
                half = len(a) // 2
                stack += [tuple(x[half:] for x in (depth, a, b, c, d, off)), tuple(x[:half] for x in (depth, a, b, c, d, off))]
                continue
            one = (np.searchsorted(changes, a) == np.searchsorted(changes, b - 1)) & (np.searchsorted(changes, c) == np.searchsorted(changes, d - 1)) & (classes.of[a] == classes.of[c])
            one |= (a == c) & (b - a == 1)
            depth, a, b, c, d, off = (x[~one] for x in (depth, a, b, c, d, off))
            small = (b - a) * (d - c) <= 16
            if small.any():
                left, right = pairs(a[small], b[small], c[small], d[small])
                near = np.bitwise_count(value[left] ^ value[right]) <= limit
                classes.join(left[near], right[near])
            depth, a, b, c, d, off = (x[~small] for x in (depth, a, b, c, d, off))
            if not len(a):
                continue
            # skip bits that all leaves of both nodes share among themselves: the next bit where either range splits
            spread = (value[a] ^ value[b - 1]) | (value[c] ^ value[d - 1])
            fork = 63 - np.frexp(spread.astype(np.float64))[1].astype(np.int64) + 1
            fork = np.where(spread == 0, 64, np.clip(fork, depth, 63))
            fork = exact_fork(spread, fork)
            above = ~(np.uint64(0xFFFFFFFFFFFFFFFF) >> np.minimum(fork, 63).astype(np.uint64))
            above = np.where(fork >= 64, np.uint64(0xFFFFFFFFFFFFFFFF), above)
            off = np.bitwise_count((value[a] ^ value[c]) & above).astype(np.int64)
            alive = off <= limit
            leaf = alive & (fork >= 64)
            if leaf.any():  # equal values in both: link all of them through one
                classes.join(a[leaf], c[leaf])
            alive &= fork < 64
            a, b, c, d, off, fork = (x[alive] for x in (a, b, c, d, off, fork))
            m, k = middle(value, a, b, fork), middle(value, c, d, fork)
            same = a == c
            new = [(a, m, c, k, off, slice(None)), (m, b, k, d, off, slice(None)), (a, m, k, d, off + 1, slice(None)), (m, b, c, k, off + 1, ~same)]
            parts = [[], [], [], [], [], []]
            for p, q, r, s, o, which in new:
                ok = (p < q) & (r < s) & (o <= limit)
                if which is not new[0][5] and isinstance(which, np.ndarray):
                    ok &= which
                for x, y in zip(parts, (fork + 1, p, q, r, s, o)):
                    x.append(y[ok])
            stack.append(tuple(np.concatenate(x) for x in parts))
    return classes.of


def exact_fork(spread: np.ndarray, fork: np.ndarray) -> np.ndarray:
    """Index from the top of the highest set bit; the float estimate may be one too high up."""
    shift = np.minimum(63 - np.minimum(fork, 63), 63).astype(np.uint64)
    return np.where((fork < 64) & ((spread >> shift) == 0), fork + 1, fork)


def middle(value: np.ndarray, a: np.ndarray, b: np.ndarray, fork: np.ndarray) -> np.ndarray:
    """First row of each range [a, b) whose bit ``fork`` (from the top) is set, else b; ranges share the bits above."""
    low, high, bit = a.copy(), b.copy(), (63 - fork).astype(np.uint64)
    while (open_ := low < high).any():
        mid = (low + high) // 2
        up = (value[np.minimum(mid, len(value) - 1)] >> bit & np.uint64(1)).astype(bool)
        high = np.where(open_ & up, mid, high)
        low = np.where(open_ & ~up, mid + 1, low)
    return low


def pairs(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows between the ranges [a, b) and [c, d)."""
    wide = d - c
    sizes = (b - a) * wide
    of = np.repeat(np.arange(len(a)), sizes)
    nth = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return a[of] + nth // wide[of], c[of] + nth % wide[of]


def bucket_edges(distinct: DataFrame, budget: int, large: int = LARGE, n_blocks: int | None = None) -> DataFrame:
    """src, dst: for each bucket, edges from members to the smallest of their class there. ``distinct`` (fp) must be stored."""
    spark, there = distinct.sparkSession, distinct.count()
    places = blocks(n_blocks or enough_blocks(there, budget))
    choices = list(combinations(range(len(places)), len(places) - budget))

    def bits(k: int) -> Column:
        shift, width = places[k]
        return F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))

    keyed = []
    for block, chosen in enumerate(choices):
        key = F.lit(0).cast("bigint")
        for k in chosen:
            key = F.shiftleft(key, places[k][1]).bitwiseOR(bits(k))
        keyed.append(F.struct(F.lit(block).alias("block"), key.alias("key")))
    rows = distinct.select("fp", F.explode(F.array(*keyed)).alias("b")).select("fp", "b.block", "b.key")
    counts = rows.groupBy("block", "key").count().where(F.col("count") > large)
    hot = Stored(counts.select("block", "key", F.ceil(F.col("count") * 2 / large).cast("long").alias("parts")), "hot").df
    rows = rows.join(hot, ["block", "key"], "left")
    parts, own = F.coalesce("parts", F.lit(1).cast("long")), F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1).cast("long")))
    pair = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda other: F.least(own, other) * parts + F.greatest(own, other))
    rows = rows.select("fp", "block", "key", F.explode(pair).alias("sub"))
    more = hot.agg(F.sum(F.col("parts") * F.col("parts") * large)).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1, (there * len(choices) + more) // ROWS)
    rows = rows.repartition(tasks, "block", "key", "sub")

    def run(batches):
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        fp = table["fp"].to_numpy().view(np.uint64)
        by = [table[c].to_numpy() for c in ("sub", "key", "block")]
        order = np.lexsort((fp, *by))
        fp, by = fp[order], [x[order] for x in by]
        bucket = np.cumsum(np.r_[False, np.any([x[1:] != x[:-1] for x in by], axis=0)])
        of = trie_classes(bucket, fp, budget)
        edge = of != np.arange(len(of))
        yield pa.RecordBatch.from_arrays([pa.array(fp[edge].view(np.int64)), pa.array(fp[of[edge]].view(np.int64))], names=["src", "dst"])

    return rows.mapInArrow(run, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = BUDGET, words: int = WORDS, large: int = LARGE) -> DataFrame:
    """doc_id, fingerprint, component_id of each row.

    component_id is the smallest doc_id reachable over links, its own included;
    rows without words share fingerprint zero and link like any others. Null
    text is empty text. A null id is passed over in the minimum (a component
    of null ids only has a null component_id). Repeated rows give repeated
    rows; other columns are not read; an empty table gives an empty result.
    """
    with scratch():
        return result(components_of(docs, id_col, text_col, budget, words, large), "near")


def components_of(docs: DataFrame, id_col: str, text_col: str, budget: int, words: int, large: int) -> DataFrame:
    rows = Stored(fingerprints(docs, id_col, text_col, words), "fingerprints").df
    owners = Stored(rows.groupBy("fp").agg(F.min("doc_id").alias("own")), "owners").df
    found = components(bucket_edges(owners.select("fp"), budget, large))
    members = owners.join(found, F.col("fp") == F.col("node"), "left").select("fp", "own", F.coalesce("component", "fp").alias("component"))
    members = Stored(members, "members").df
    # what is aggregated is written before it is joined back, so that the joins can split a very large component or fingerprint
    least = Stored(members.groupBy("component").agg(F.min("own").alias("component_id")), "least").df
    labels = Stored(members.join(least, "component").select(F.col("fp").alias("of"), "component_id"), "labels").df
    return rows.join(labels, F.col("fp") == F.col("of")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose id is the smallest of their component; rows of null id stay only where no other is near."""
    with scratch():
        found = components_of(docs, id_col, text_col, BUDGET, WORDS, LARGE)
        return without(docs, found.select("doc_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")), id_col)
