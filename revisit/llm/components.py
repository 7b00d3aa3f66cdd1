"""Connected components by hooking and contraction, in Spark joins only.

Each round every node points to the smallest of itself and its neighbours,
pointers are followed once more, and the edges are rewritten to the nodes
pointed at; a component at least halves each round.  Rounds are cut by tables
in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from revisit.llm.store import stored


def components(edges: DataFrame) -> DataFrame | None:
    """``edges`` (a, b) -> (node, root) for every node of an edge, root being
    the smallest node of its component; None without edges."""
    found = None
    edges = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        near = stored(both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("to")), "hooks")
        further = near.select(F.col("a").alias("to"), F.col("to").alias("further"))
        hook = near.join(further, "to").select("a", F.col("further").alias("to"))
        step = hook.select(F.col("a").alias("root"), "to")
        found = (hook.select(F.col("a").alias("node"), F.col("to").alias("root")) if found is None
                 else found.join(step, "root", "left").select("node", F.coalesce("to", "root").alias("root")))
        left, right = hook.select("a", F.col("to").alias("x")), hook.select(F.col("a").alias("b"), F.col("to").alias("y"))
        edges = stored(edges.join(left, "a").join(right, "b").where("x <> y")
                       .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return found
