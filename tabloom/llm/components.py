"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch, join_repeated

#: Tables of so many edges and more keep hubs, nodes with a thousandth of all edges, out of the shuffled join.
HUB_EDGES = 20_000


def star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """One star step on `rows` edges (a > b): neighbours of a node are hung on its smallest neighbour."""
    if large:
        sides = F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v"))))
        around = edges.select(sides)
    else:
        around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("_m"), F.count("*").alias("_n"))
    if rows < HUB_EDGES:
        joined = around.join(least, "u")
    else:
        joined = join_repeated(around, least, "u", "_n", F.xxhash64("u", "v"), total=rows * (1 + large))
    joined = joined.withColumn("m", F.least("u", "_m"))
    if large:
        moved = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select("v", "m").where("v > m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("_m").alias("b"))
        )
    return moved.where("a > b").distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the smallest node it can reach.

    Every half round is written to the shared folder, so lineage stays short and a lost
    executor costs one step. Minima are combined before they are shuffled; no neighbourhood is
    gathered. Ends when a round changes nothing.
    """
    scratch = Scratch(edges.sparkSession)
    seen = None
    current = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name
    )
    rows = current.count()
    while True:
        half = scratch.keep(star(current, True, rows), name)
        scratch.drop(current)
        current = scratch.keep(star(half, False, half.count()), name)
        scratch.drop(half)
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            break
        seen, rows = mark, mark[0]
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
