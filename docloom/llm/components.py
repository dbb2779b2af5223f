"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import ensure_checkpoint_dir


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """One contraction: every node passes its smallest neighbour on.

    Large star: to its larger neighbours; small star: to its smaller ones and itself.
    """
    seen = _both(edges) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = seen.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = seen.join(least, "a")
    if larger:
        moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Columns node, root: the smallest node of each linked node's component.

    ``edges`` has comparable columns a and b; repeated and reversed links and loops are
    allowed, nulls are not.  Each round contracts by a large and a small star and is cut off
    by a checkpoint; rounds grow with the logarithm of a component's size.  Links stay
    distributed; one sum a round tells the driver whether anything moved.  A node without
    links to another has no row.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    state = edges.select("a", "b").where(F.col("a") != F.col("b")).distinct().checkpoint()
    mark = None
    while True:
        state = _star(_star(state, True), False).checkpoint()
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    # Every remaining link leads to a root.
    return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
