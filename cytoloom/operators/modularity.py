"""Communities by modularity: local moving, connected refinement and contraction, level by level.

A level is an edge table and a node table. Nodes move to the neighbouring
community of the largest gain, half of them a round by a hash; a round that
does not raise modularity is done again with the moves alone that are the best
of both communities they touch, whose gains add up exactly. So modularity
rises with every round, and a level ends when no move gains anything.
Communities are cut into their connected parts and become the nodes of the
next level, until a level merges nothing. Nothing but sums leaves the
executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from . import onetask

#: Gains of modularity that count.
LEAST_GAIN = 1e-9


def adjacency(edges: DataFrame) -> DataFrame:
    """src, dst, w both ways, parallel edges added, each undirected pair weighing the mean of its two directions; loops left out."""
    one = edges.where("src <> dst").select("src", "dst", "w")
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return both.groupBy("src", "dst").agg((F.sum("w") / 2).alias("w")).where("w > 0")


def modularity(adj: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Of ``labels`` (node, community) over a graph as ``adjacency`` gives it."""
    degrees = adj.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).withColumn("loop", F.lit(0.0))
    nodes = degrees.join(labels, "node")
    return quality(adj, nodes, float(nodes.agg(F.sum("k")).first()[0] or 0.0), resolution)


def quality(adj: DataFrame, nodes: DataFrame, total: float, resolution: float) -> float:
    """Modularity of nodes (node, k, loop, community); total: the sum of k."""
    if not total:
        return 0.0
    of = nodes.select("node", "community")
    inside = adj.join(of.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(of.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    within = inside.where("a = b").agg(F.sum("w")).first()[0] or 0.0
    loops, squares = nodes.groupBy("community").agg(F.sum("k").alias("t"), F.sum("loop").alias("l")).agg(F.sum("l"), F.sum(F.col("t") * F.col("t"))).first()
    return (within + loops) / total - resolution * squares / total**2


def proposals(adj: DataFrame, nodes: DataFrame, total: float, resolution: float) -> DataFrame:
    """node, k, community, to, gain: each node's best move that gains. Of two lone nodes the larger moves to the smaller."""
    of = nodes.select(F.col("node").alias("dst"), "community")
    links = adj.join(of, "dst").groupBy(F.col("src").alias("node"), F.col("community").alias("to")).agg(F.sum("w").alias("w"))
    sums = nodes.groupBy("community").agg(F.sum("k").alias("t"), F.count(F.lit(1)).alias("n"))
    here = nodes.join(sums, "community").select("node", "k", "community", (F.col("t") - F.col("k")).alias("rest"), F.col("n").alias("own_n"))
    each = links.join(here, "node").join(sums.select(F.col("community").alias("to"), F.col("t").alias("to_t"), F.col("n").alias("to_n")), "to")
    gain = F.col("w") - resolution * F.col("k") * F.when(F.col("to") == F.col("community"), F.col("rest")).otherwise(F.col("to_t")) / total
    each = each.withColumn("gain", gain)
    stay = F.max(F.when(F.col("to") == F.col("community"), F.col("gain")))
    leave = F.max(F.when((F.col("to") != F.col("community")) & ~((F.col("own_n") == 1) & (F.col("to_n") == 1) & (F.col("to") > F.col("community"))), F.struct("gain", "to")))
    best = each.groupBy("node", "k", "community", "rest").agg(stay.alias("stay"), leave.alias("leave"))
    stay = F.coalesce("stay", -resolution * F.col("k") * F.col("rest") / total)
    return best.where("leave IS NOT NULL").select("node", "k", "community", F.col("leave.to").alias("to"), (F.col("leave.gain") - stay).alias("gain")).where(F.col("gain") > LEAST_GAIN * total)


def matched(moves: DataFrame) -> DataFrame:
    """Moves that are the best of both communities they touch: no two of them touch one, so their gains add up."""
    ends = moves.select(F.explode(F.array("community", "to")).alias("c"), F.struct("gain", "node").alias("m")).groupBy("c").agg(F.max("m").alias("m"))
    best = F.struct("gain", "node")
    first = moves.join(ends.select(F.col("c").alias("community"), F.col("m").alias("m1")), "community").where(best == F.col("m1"))
    return first.join(ends.select(F.col("c").alias("to"), F.col("m").alias("m2")), "to").where(best == F.col("m2"))


def moved(nodes: DataFrame, moves: DataFrame) -> DataFrame:
    new = nodes.join(moves.select("node", "to"), "node", "left").withColumn("community", F.coalesce("to", "community")).drop("to")
    return written(new)


def local_moving(adj: DataFrame, nodes: DataFrame, total: float, resolution: float) -> DataFrame:
    """Nodes in communities that no single move betters."""
    at, turn = quality(adj, nodes, total, resolution), 0
    while True:
        moves = written(proposals(adj, nodes, total, resolution))
        if moves.isEmpty():
            return nodes
        half = moves.where(F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0)
        for some in (half, matched(moves)):
            new = moved(nodes, some)
            then = quality(adj, new, total, resolution)
            if then > at + LEAST_GAIN:
                break
        else:
            return nodes
        nodes, at, turn = new, then, turn + 1


def connected_parts(adj: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes whose communities are cut into connected parts, each named by its smallest node.

    Names spread along edges inside a community, and to what a name's own node
    is called by then, so that rounds grow with the logarithm of a chain.
    """
    of = nodes.select("node", "community")
    inside = adj.join(of.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(of.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    inside = written(inside.where("a = b").select("src", "dst"))
    parts = written(of.select("node", F.col("node").alias("part")))
    while True:
        around = inside.join(parts.select(F.col("node").alias("dst"), F.col("part").alias("p")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("p").alias("p"))
        new = parts.join(around, "node", "left").select("node", "part", F.least("part", "p").alias("near"))
        jump = new.select(F.col("node").alias("near"), F.col("near").alias("beyond"))
        new = written(new.join(jump, "near", "left").select("node", "part", F.least("near", "beyond").alias("to")))
        if new.where("part <> to").isEmpty():
            return nodes.drop("community").join(parts.withColumnRenamed("part", "community"), "node")
        parts = new.select("node", F.col("to").alias("part"))


def communities(edges: DataFrame, resolution: float = 1.0) -> DataFrame:
    """(node, community) of an edge table (src, dst, w): communities of high modularity, each connected, named by one of its nodes.

    Directed tables are read as undirected; weights of no more than zero count
    as no edge. Nodes without any edge to another are not in the result. An
    empty table gives an empty result. A graph that fits a task rises in it.
    """
    edges = written(edges.select("src", "dst", "w"))
    if onetask.fits(edges):
        return written(onetask.in_one_task(edges, lambda src, dst, w: onetask.risen(src, dst, w, resolution, LEAST_GAIN)))
    return risen(edges, resolution)


def risen(edges: DataFrame, resolution: float) -> DataFrame:
    """``communities`` by rounds over tables."""
    adj = written(adjacency(edges))
    nodes = written(adj.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k")).withColumn("loop", F.lit(0.0)).withColumn("community", F.col("node")))
    labels = nodes.select("node", "community")
    total = float(nodes.agg(F.sum("k")).first()[0] or 0.0)
    if not total:
        return labels
    while True:
        before = nodes.count()
        nodes = written(connected_parts(adj, local_moving(adj, nodes, total, resolution)))
        of = nodes.select("node", F.col("community").alias("to"))
        labels = written(labels.join(of.withColumnRenamed("node", "community"), "community").select("node", F.col("to").alias("community")))
        ends = adj.join(of.select(F.col("node").alias("src"), F.col("to").alias("a")), "src").join(of.select(F.col("node").alias("dst"), F.col("to").alias("b")), "dst")
        ends = written(ends.groupBy("a", "b").agg(F.sum("w").alias("w")))
        loops = ends.where("a = b").select(F.col("a").alias("node"), F.col("w").alias("more"))
        merged = nodes.groupBy(F.col("community").alias("node")).agg(F.sum("k").alias("k"), F.sum("loop").alias("loop")).join(loops, "node", "left")
        nodes = written(merged.select("node", "k", (F.col("loop") + F.coalesce("more", F.lit(0.0))).alias("loop"), F.col("node").alias("community")))
        adj = ends.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")
        if nodes.count() == before:
            return labels


def named_by_size(labels: DataFrame) -> DataFrame:
    """Communities numbered from 0, the largest first, ties by name; the numbering sees communities, not nodes."""
    sizes = labels.groupBy("community").agg(F.count(F.lit(1)).alias("n"))
    numbers = sizes.select("community", (F.row_number().over(Window.orderBy(F.desc("n"), "community")) - 1).alias("number"))
    return labels.join(numbers, "community").select("node", F.col("number").alias("community"))
