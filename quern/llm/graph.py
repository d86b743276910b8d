"""Connected components of a large graph, with DataFrames only."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pinned

#: Edges that one task joins by itself; more are contracted first.
FEW_EDGES = 200_000


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of all edges with the least node that they join it to."""
    up: dict = {}
    kind = None
    for batch in batches:
        kind = batch.column("a").type
        for ends in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            tops = []
            for x in ends:
                top = up.setdefault(x, x)
                while top != up[top]:
                    up[top] = top = up[up[top]]
                up[x] = top
                tops.append(top)
            up[max(tops)] = min(tops)
    for x in sorted(up):  # no node is above a lesser one, so what it is under is settled before it
        up[x] = up[up[x]]
    if up:
        yield pa.record_batch([pa.array(up.keys(), kind), pa.array(up.values(), kind)], ["node", "into"])


def components(edges: DataFrame) -> DataFrame:
    """node and component (its least node) for every node of edges(a, b); loops are allowed, nulls are not.

    Rounds of contraction, while more than FEW_EDGES edges are left: every node is taken into the one of least hash among itself and its neighbours, by a hash of the round, and edges become edges of
    what their ends were taken into, without loops and repeats. A quarter of the nodes or more is expected to go each time, and of edges around hubs nearly all, so all rounds together join a small
    multiple of the edges, whatever the paths' lengths. One task joins the rest. Then what each node was taken into is followed from the last round back. The joins are on one key and none is a
    broadcast; hubs' rows are dealt anew by Spark's skew joins. Every round is checkpointed; the driver sees one count of edges a round.
    """
    left = pinned(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    kind = left.schema["a"].dataType.simpleString()
    rounds: list[DataFrame] = []
    while left.count() > FEW_EDGES:
        rank = lambda c: F.struct(F.xxhash64(F.lit(len(rounds)), c).alias("h"), F.col(c).alias("into"))
        least = F.least(rank("a"), rank("b")).alias("m")
        sides = left.select(F.col("a").alias("node"), least).union(left.select(F.col("b").alias("node"), least))
        taken = pinned(sides.groupBy("node").agg(F.min("m").alias("m")).select("node", F.col("m.into").alias("into")))
        rounds.append(taken)
        one, two = taken.select(F.col("node").alias("a"), F.col("into").alias("x")), taken.select(F.col("node").alias("b"), F.col("into").alias("y"))
        ahead = left.join(one.hint("merge"), "a").join(two.hint("merge"), "b").where("x != y")
        left = pinned(ahead.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    ends = pinned(left.coalesce(1).mapInArrow(_trees, f"node {kind}, into {kind}"))
    if not rounds:
        return ends.select("node", F.col("into").alias("component"))
    for taken in reversed(rounds):
        after = ends.select(F.col("node").alias("into"), F.col("into").alias("last"))
        ends = pinned(taken.join(after.hint("merge"), "into", "left").select("node", F.coalesce("last", "into").alias("into")))
    least = ends.groupBy("into").agg(F.min("node").alias("component"))
    return ends.join(least.hint("merge"), "into").select("node", "component")
