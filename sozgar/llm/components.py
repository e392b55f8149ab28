"""Connected components of an edge table by contraction to local minima; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sozgar.llm.common import Scratch


def _downward(a, b) -> list:
    """An edge from its greater to its smaller vertex."""
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(v, label) for every vertex of the edges (a, b): the label is the smallest vertex that can be reached.

    In each round a vertex points to its smallest neighbour below it, pointers are followed to their ends (doubling
    each time), and the edges are drawn between the ends. Ends are local minima, so each round at least halves the
    vertices that still have edges: the rounds, and the doublings in each, are logarithmic, and the edges of all
    rounds together few. The smallest vertex of a component never moves, so it is the end of all.
    """
    links = scratch.write(edges.where("a <> b").select(*_downward(F.col("a"), F.col("b"))).distinct(), f"{name}-edges-0")
    labels, k = None, 0
    while True:
        ends = scratch.write(links.groupBy("a").agg(F.min("b").alias("end")), f"{name}-ends-{k}-0")
        step, moved = 0, True
        while moved:
            further = ends.select(F.col("a").alias("end"), F.col("end").alias("further"))
            step += 1
            ends = scratch.write(ends.join(further, "end", "left").select("a", F.coalesce("further", "end").alias("end"), F.col("further").isNotNull().alias("moved")), f"{name}-ends-{k}-{step}")
            moved = bool(ends.where("moved").limit(1).count())
            ends = ends.select("a", "end")
            scratch.drop(f"{name}-ends-{k}-{step - 1}")
        if labels is None:
            found = ends.select(F.col("a").alias("v"), F.col("end").alias("label"))
        else:
            now = labels.join(ends.select(F.col("a").alias("label"), "end"), "label", "left").select("v", F.coalesce("end", "label").alias("label"))
            found = now.unionByName(ends.select(F.col("a").alias("v"), F.col("end").alias("label")))
        labels = scratch.write(found, f"{name}-labels-{k}")
        above = links.join(ends, "a").select(F.col("end").alias("x"), "b")
        both = above.join(ends.select(F.col("a").alias("b"), F.col("end").alias("y")), "b", "left").select("x", F.coalesce("y", "b").alias("y"))
        links = scratch.write(both.where("x <> y").select(*_downward(F.col("x"), F.col("y"))).distinct(), f"{name}-edges-{k + 1}")
        scratch.drop(f"{name}-edges-{k}", f"{name}-ends-{k}-{step}", f"{name}-labels-{k - 1}")
        k += 1
        if not links.limit(1).count():
            break
    scratch.drop(f"{name}-edges-{k}")
    roots = labels.select(F.col("label").alias("v"), "label").distinct()
    done = scratch.write(labels.unionByName(roots), f"{name}-done")
    scratch.drop(f"{name}-labels-{k - 1}")
    return done
