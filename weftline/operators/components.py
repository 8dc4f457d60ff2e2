"""Connected components of an undirected graph, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.staging import discard, stage


def _contracted(edges: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(node, to) of every node of edges (a, b), and the edges that are left.

    Every node goes to the first of itself and its neighbours in the order of a
    hash that is new in each round, so of a chain about a third of the nodes stay;
    edges between nodes that went together are settled, and so is a node that has
    no other edge: neither comes into a later round.
    """
    first = lambda c: F.xxhash64(F.lit(k), c)
    both = edges.union(edges.select("b", "a"))
    near = both.groupBy("a").agg(F.min(F.struct(first("b").alias("h"), F.col("b").alias("node"))).alias("near"))
    own = F.struct(first("a").alias("h"), F.col("a").alias("node"))
    moved = stage(near.select(F.col("a").alias("node"), F.least(own, F.col("near"))["node"].alias("to")), "cc-moved")
    ends = lambda c: moved.select(F.col("node").alias(c), F.col("to").alias(f"to_{c}"))
    # a node of very many edges is a skewed key whose other side has one row
    left = edges.join(ends("a"), "a").join(ends("b"), "b").where("to_a <> to_b")
    return moved, stage(left.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "cc-edges")


def components(nodes: DataFrame, edges: DataFrame, rounds: list[tuple[int, int]] | None = None) -> DataFrame:
    """node, comp: the least node that is reachable by edges (a, b).

    Edges are contracted until none is left, so what a round reads and writes
    falls by a factor from round to round, and there are about as many rounds
    as the logarithm of the number of nodes, however long a path is.  Then the
    rounds are gone through backwards, each node taking the name of what it went
    to.  Each round is a written table: losing an executor costs no earlier
    round.  `rounds`, if given, gets the nodes and edges that each began with.
    """
    left = stage(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
    moves = []
    while n := left.count():
        moved, after = _contracted(left, len(moves))
        if rounds is not None:
            rounds.append((moved.count(), n))
        moves.append(moved)
        discard(left)
        left = after
    discard(left)
    if not moves:
        return nodes.select("node", F.col("node").alias("comp"))
    names = moves[-1]
    for moved in reversed(moves[:-1]):
        last = names.select(F.col("node").alias("to"), F.col("to").alias("name"))
        # what a node went to may have had no edge of its own any more
        named = stage(moved.join(last, "to", "left").select("node", F.coalesce("name", "to").alias("to")), "cc-named")
        discard(names, moved)
        names = named
    least = names.groupBy("to").agg(F.min("node").alias("comp"))
    comp = names.join(least, "to").select("node", "comp")
    return nodes.select("node").join(comp, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
