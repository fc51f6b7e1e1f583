"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step aggregates before it joins, so a node with many neighbours never gathers them in one place; between steps
the edges are written to the shared folder and those of the step before removed. Nothing is collected but two numbers
per step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.scratch import Workspace


def _large_star(edges: DataFrame, work: Workspace, step: int) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(work.write(least, f"large{step}"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, work: Workspace, step: int) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("b < a")
    least = work.write(down.groupBy("a").agg(F.min("b").alias("m")), f"small{step}")
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least).where("b < a").distinct()


def _state(edges: DataFrame) -> tuple:
    # A pmod keeps the sum of hashes from overflowing.
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 30)))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of the edges ``a, b`` (any ordered type): root is the least node it reaches.

    Edges with a null end and loops are left out; repeated edges do no harm; an empty table gives an empty result.
    """
    work = Workspace(edges.sparkSession, "components")
    current = work.write(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), "edges0")
    before, step = None, 0
    while (now := _state(current)) != before:
        before = now
        if not now[0]:
            break
        step += 1
        current = work.write(_small_star(_large_star(current, work, step), work, step), f"edges{step}")
        work.drop(f"large{step}", f"small{step}", f"edges{step - 1}")
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.union(leaves.select(F.col("root").alias("node"), "root").distinct())
