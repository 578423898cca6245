"""Connected components of an edge list, by contraction.

Each round every vertex points to its smallest neighbour (or itself), pointers are followed once more, and the edges are
rewritten between what they point to. A round at least halves the vertices that still have edges, so rounds grow with the
logarithm of the longest path. Each round's tables are written to the shared folder, which ends their lineage. Nothing is
collected; a hub with many edges is summed where its edges are, before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakepipe.llm.common import dropped, small_broadcasts, written


def components(edges: DataFrame) -> DataFrame:
    """``edges``: columns u and v, in any direction, repeats allowed. Gives (node, label) for every vertex with an edge to
    another; ``label`` is the smallest vertex of its component."""
    with small_broadcasts(edges.sparkSession):
        return _components(edges)


def _components(edges: DataFrame) -> DataFrame:
    both = edges.where(F.col("u") != F.col("v")).select("u", "v")
    e = written(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = None
    while True:
        if e.isEmpty():
            break
        p = e.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("parent"))
        p = written(p, "parents")
        jumped = p.join(p.select(F.col("node").alias("parent"), F.col("parent").alias("top")), "parent").select("node", F.col("top").alias("parent"))
        step = written(jumped, "parents")
        u = step.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        v = step.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        moved = e.join(u, "u").join(v, "v").where(F.col("pu") != F.col("pv")).select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct()
        nxt = written(moved, "edges")
        if labels is None:
            new = step.select("node", F.col("parent").alias("label"))
        else:
            up = step.select(F.col("node").alias("label"), F.col("parent").alias("top"))
            new = written(labels.join(up, "label", "left").select("node", F.coalesce("top", "label").alias("label")), "labels")
            dropped(labels)
        dropped(e, p)
        if labels is not None:
            dropped(step)
        elif new is not step:
            new._lakepipe_path = step._lakepipe_path
        e, labels = nxt, new
    dropped(e)
    if labels is None:
        return edges.sparkSession.createDataFrame([], f"node {edges.schema['u'].dataType.simpleString()}, label {edges.schema['u'].dataType.simpleString()}")
    return labels
