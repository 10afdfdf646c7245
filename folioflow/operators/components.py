"""Connected components by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from folioflow.operators.skew import lookup_join
from folioflow.storage import drop_written, written


def _ordered(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct edges as (hi, lo) with hi > lo; loops and nulls are dropped."""
    return (
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct()
    )


def pointer_jump(hooks: DataFrame) -> DataFrame:
    """Flatten a forest of (node, root) pointers until every root is final.

    Pointers lead to smaller nodes only, so the number of rounds is the
    logarithm of the longest chain.
    """
    while True:
        onward = hooks.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        longer = hooks.select(F.col("root").alias("_via")).distinct().join(onward, F.col("_via") == F.col("_n")).select("_via", "_r")
        longer = written(longer, "jump")
        if longer.isEmpty():
            drop_written(longer)
            return hooks
        jumped = lookup_join(hooks, "root", longer, "_via").select("node", F.coalesce("_r", "root").alias("root"))
        jumped = written(jumped, "hooks")
        drop_written(hooks, longer)
        hooks = jumped


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that isn't the smallest of its component.

    A node that appears in no edge, or is itself the smallest node of its
    component, has no row: ``coalesce(root, node)`` after a left join names
    the component of any node.  Each round hooks every node to its smallest
    neighbour, flattens the pointers and contracts the edges, so the edge
    table shrinks geometrically.  Nulls and loops are ignored; repeated edges
    count once; an empty table gives an empty result.
    """
    live = written(_ordered(edges, a, b), "edges")
    maps: list[DataFrame] = []
    while not live.isEmpty():
        hooks = written(live.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root")), "hooks")
        hooks = pointer_jump(hooks)
        maps.append(hooks)
        ends = hooks.select(F.col("node").alias("_end"), F.col("root").alias("_to"))
        step = lookup_join(live, "hi", ends, "_end", "inner").select(F.col("_to").alias("hi"), "lo")
        step = step.where("hi != lo")
        step = written(step, "half")
        nxt = lookup_join(step, "lo", ends, "_end").select("hi", F.coalesce("_to", "lo").alias("lo"))
        nxt = written(_ordered(nxt, "hi", "lo"), "edges")
        drop_written(live, step)
        live = nxt
    if not maps:
        return live.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    total = maps.pop()
    while maps:  # a node is hooked in exactly one round; its root may be hooked in a later one
        m = maps.pop()
        via = total.select(F.col("node").alias("_via"), F.col("root").alias("_r"))
        joined = lookup_join(m, "root", via, "_via").select("node", F.coalesce("_r", "root").alias("root"))
        combined = written(joined.unionByName(total), "roots")
        drop_written(m, total)
        total = combined
    return total
