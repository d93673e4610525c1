"""Connected components of an edge list, without collecting it anywhere.

Large-star and small-star steps alternate; each links the neighbours of a node
to the smallest of them, so the number of edges never grows and long chains
shrink by a constant factor a round. Each round ends in a written table. It is
over as soon as the edges are stars around smallest nodes, without a further
round that changes nothing. Up to ``LOCAL`` edges, a fixed number whatever the
input, are joined by one task instead: a round takes seven small jobs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mobilome_spark.llm.common import join_counted, materialize

#: Edges that one task joins at most, 2 MB.
LOCAL = 1 << 17


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    near = _both(edges)
    least = near.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n")).withColumn("m", F.least("a", "m"))
    # the centre of a star may hold most edges: the join deals those out
    moved = join_counted(near.filter("b > a"), materialize(least, "components-least"), ["a"], 2 * total)
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(down: DataFrame, total: int) -> DataFrame:
    least = materialize(down.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("_n")), "components-least")
    moved = join_counted(down, least, ["a"], total).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.unionByName(own).filter("a <> b").distinct()


def _state(edges: DataFrame) -> tuple[int, bool]:
    """(number of edges, whether they are stars: no node has two smaller neighbours or neighbours of both kinds)."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("_least"))
    bent = (F.col("up") > 1) | ((F.col("up") > 0) & (F.col("_least") == 0))
    found = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)).alias("edges"), F.count_if(bent).alias("bent")).first()
    return found.edges, not found.bent


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, root) of few edges."""

    def join(batches):
        held = [b for b in batches if len(b)]
        if not held:
            return
        ends = [np.concatenate([b.column(i).to_numpy(zero_copy_only=False) for b in held]) for i in (0, 1)]
        nodes, places = np.unique(np.concatenate(ends), return_inverse=True)
        root = list(range(len(nodes)))  # nodes are in order, so the smallest place is the smallest node
        for x, y in places.reshape(2, -1).T.tolist():
            while root[x] != x:
                root[x] = x = root[root[x]]
            while root[y] != y:
                root[y] = y = root[root[y]]
            root[max(x, y)] = min(x, y)
        for x in range(len(root)):
            root[x] = root[root[x]]
        kind = held[0].column(0).type
        yield pa.record_batch([pa.array(nodes, kind), pa.array(nodes[root], kind)], ["node", "root"])

    kind = edges.schema["a"].dataType.simpleString()
    return edges.coalesce(1).mapInArrow(join, f"node {kind}, root {kind}")


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node
    of its component. Loops and repeated edges do no harm; no edges, no rows."""
    ordered = edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = materialize(ordered.distinct(), "components")
    if current.count() <= LOCAL:
        return _in_one_task(current)
    for _ in range(most_rounds):
        total, stars = _state(current)
        if stars:
            break
        # edges only change their ends in a step, so the count bounds that of every step of the round
        grown = materialize(_large_star(current, total), "components")  # its larger end is still called a
        current = materialize(_small_star(grown, total), "components")
    else:
        raise RuntimeError("components did not settle")
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
