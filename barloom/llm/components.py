"""Connected components of a link table, by contraction with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm import scratch

JUMPS = 3


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node long, label long) for every node of ``links``; label is the component's smallest node.

    Each round points every node at its smallest neighbour, follows those pointers a
    few steps, and keeps only the links whose ends still differ.  Rounds grow with the
    logarithm of the longest chain.  Aggregates are partial, so a node with very many
    links costs one row per task.  Links with a null end, loops and repeated links do
    no harm; an empty table gives an empty result.
    """
    with scratch.scope() as around:
        return _contract(links, a, b, around)


def _contract(links: DataFrame, a: str, b: str, around: scratch.Tables) -> DataFrame:
    ends = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a is not null and b is not null")
    edges = scratch.write(ends.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    labels = scratch.write(labels, "labels")
    edges = edges.where("a < b")
    while not edges.isEmpty():
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p"))
        step = scratch.write(step, "pointers")
        for _ in range(JUMPS):
            on = step.select(F.col("a").alias("p"), F.col("p").alias("q"))
            step = step.join(on, "p", "left").select("a", F.coalesce("q", "p").alias("p"))
        step = scratch.write(step, "pointers")
        moved = lambda df, c: df.join(step.select(F.col("a").alias(c), F.col("p").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")  # noqa: B023, E731
        labels = scratch.write(moved(labels, "label"), "labels")
        edges = moved(moved(edges, "a"), "b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        edges = scratch.write(edges.where("a < b").distinct(), "edges")
    return scratch.write(labels, "labels", around)
