"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of every node on the least id around it.

    large: the neighbours above a node; else the node and its neighbours below it. The least neighbour comes from a
    partial aggregate and a join, so a node with very many links is no single group anywhere."""
    ends = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = ends.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    hung = ends.join(low, "a")
    if large:
        out = hung.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a long, b long) -> (node long, component long), component the least id that links reach.

    Null ends and self links link nothing; repeated links and either direction are the same link; nodes without a link
    are not returned; an empty table gives an empty one. Raises if the rounds do not suffice (they grow with the
    logarithm of the longest path)."""
    at = materialize(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a is not null and b is not null and a <> b")
                     .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = lambda t: t.agg(F.count("*").alias("n"), F.sum((F.xxhash64("a", "b") % 1000000007).cast("long")).alias("s")).first()
    seen = mark(at)
    for _ in range(rounds):
        if not seen["n"]:
            break
        new = materialize(_star(_star(at, True), False))
        now = mark(new)
        discard(at)
        at = new
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    star = at.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return star.union(star.select(F.col("component").alias("node"), "component").distinct())
