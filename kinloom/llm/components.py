"""Connected components of edge tables, by hooking, pointer jumping and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from kinloom.llm.scratch import Scratch


def _jumped(scratch: Scratch, parents: DataFrame, name: str) -> DataFrame:
    """parents (node, parent) with each parent replaced by the root above it."""
    k = 0
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        parents = scratch.save(parents.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("above") != F.col("parent")).alias("moved")), f"{name}-jump{k}")
        if k:
            scratch.drop(f"{name}-jump{k - 1}")
        if parents.filter("moved").isEmpty():
            return parents.select("node", "parent")
        parents, k = parents.select("node", "parent"), k + 1


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b): the least node that it is connected with.

    In each round every node hooks to its least neighbour if that is smaller, pointers jump to the roots, and edges go over to
    these; the rounds end when no edge is left.  Minima are found map-side first, so a node of very many edges is no hot spot.
    Null ends and loops are left out.  No edges give an empty table.
    """
    edges = scratch.save(edges.filter(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    found, k = None, 0
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = scratch.save(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("parent")), f"{name}-hook{k}")
        roots = _jumped(scratch, hooked, f"{name}-{k}")
        if found is None:
            found = roots.select("node", F.col("parent").alias("component"))
        else:
            found = scratch.save(found.join(roots.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("parent", "component").alias("component")), f"{name}-found{k}")
        a, b = roots.select(F.col("node").alias("a"), F.col("parent").alias("ra")), roots.select(F.col("node").alias("b"), F.col("parent").alias("rb"))
        moved = edges.join(a, "a").join(b, "b").filter(F.col("ra") != F.col("rb"))
        edges = scratch.save(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), f"{name}-edges{k}")
        if edges.isEmpty():
            return found
        k += 1
