"""Connected components by graph contraction over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """Maps each node of ``edges(a long, b long)`` to its component: ``(node, root)``.

    Each round hooks every node to its smallest neighbour, follows the hooks to
    their ends by pointer doubling and contracts the edges to those ends. Every
    tree of hooks has two nodes at least, so the nodes halve each round. The
    only aggregate is a minimum, which combines before the shuffle, so a node
    with very many neighbours is never gathered. ``root`` is the smallest node
    of the component. An empty input gives an empty result.
    """
    edges = staged(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    layers: list[DataFrame] = []
    while edges.limit(1).count():
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root"))
        hook = _settle(hook)
        layers.append(hook)
        at_a = hook.select(F.col("node").alias("a"), F.col("root").alias("ua"))
        at_b = hook.select(F.col("node").alias("b"), F.col("root").alias("ub"))
        moved = edges.join(at_a, "a").join(at_b, "b").where("ua <> ub")
        edges = staged(moved.select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct(), "edges")
    if not layers:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = layers[-1]
    for layer in reversed(layers[:-1]):
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("above"))
        roots = layer.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root"))
    return roots


def _settle(roots: DataFrame) -> DataFrame:
    """Pointer doubling of ``(node, root)`` until nothing moves."""
    roots = staged(roots, "hooks")
    while True:
        # Only nodes that point past themselves lead on; ends need no row.
        onward = roots.where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("upper"))
        if not roots.join(onward, "root", "left_semi").limit(1).count():
            return roots
        roots = staged(roots.join(onward, "root", "left").select("node", F.coalesce("upper", "root").alias("root")), "hooks")
