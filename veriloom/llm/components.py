"""Connected components of pairwise matches by seed-tree pruning.

Every round each vertex looks at its neighbourhood minimum.  Vertices that are
nobody's minimum leave the graph and hang under their minimum in a propagation
forest, so the graph shrinks geometrically whatever the chain length.  When no
edge is left the remaining vertices are the seeds, and their identifiers flow
down the forest, last round first.

Everything stays in tables: per round one edge table and one tree table are
written to the shared folder, the driver only sees row counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.session import materialize


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 200) -> DataFrame:
    """(id, group_id): one row per vertex of ``edges``; ``group_id`` is the smallest id of its group.

    Edges are undirected; repeated, mirrored and self edges are fine, and a
    vertex with only a self edge forms a group of its own.  Edges with a null
    end are dropped.  An empty table gives an empty result.

    The minimum of a neighbourhood is an aggregate with map-side combining, so
    a hub with a third of all edges costs one partial row per task; the joins
    that follow carry one row per vertex on the other side, and the hub's
    edges are split by the adaptive skew join.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter(F.col("u").isNotNull() & F.col("v").isNotNull())
    live = materialize(
        pairs.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
        .select("e.*")
        .distinct(),
        "cc_edges",
    )
    vertices = live.select(F.col("u").alias("id")).distinct()
    live = live.filter("u <> v")
    forest: list[DataFrame] = []
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        # Min selection: everybody in u's neighbourhood (u included) points at the neighbourhood minimum.
        low = live.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        chosen = live.join(low, "u").select(F.col("v").alias("x"), "m").union(low.select(F.col("u").alias("x"), "m")).distinct()
        chosen = materialize(chosen, "cc_chosen")
        # Pruning: keep the smallest of the minima; the others are its neighbours in the next round.
        root = chosen.groupBy("x").agg(F.min("m").alias("r"), F.max(F.col("m") == F.col("x")).alias("own"))
        root = materialize(root, "cc_root")
        gone = root.filter("not own").select(F.col("x").alias("id"), F.col("r").alias("parent"))
        forest.append(gone)
        linked = chosen.join(root.select("x", "r"), "x").filter("m <> r").select(F.col("r").alias("u"), F.col("m").alias("v"))
        live = materialize(
            linked.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e"))
            .select("e.*")
            .distinct(),
            "cc_edges",
        )
    else:
        raise RuntimeError("connected_components did not converge")
    dropped = None
    for f in forest:
        dropped = f.select("id") if dropped is None else dropped.union(f.select("id"))
    labels = vertices if dropped is None else vertices.join(dropped, "id", "left_anti")
    labels = materialize(labels.select("id", F.col("id").alias("group_id")), "cc_seeds")
    for f in reversed(forest):
        # Only the vertices of this round are written; their parents left the graph later or never.
        down = f.join(labels.withColumnRenamed("id", "parent"), "parent").select("id", "group_id")
        labels = labels.union(materialize(down, "cc_labels"))
    return labels
