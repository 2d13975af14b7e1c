"""Connected components (G6) by alternating large-star and small-star steps.

Each step rewires every edge towards the smallest neighbour; the edge list never grows beyond its first size
and ends as stars around the smallest node of each component. Rounds are cut by tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkveil.session import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    # (a, b) with b > a: b hangs on the smallest of a and a's neighbours; only the original direction a < b is needed
    return (
        edges.join(low, edges["a"] == low["u"])
        .select(F.least("m", "a").alias("a"), F.col("b"))
        .where("a <> b")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
    hung = edges.join(low, edges["b"] == low["u"])
    return (
        hung.select(F.explode(F.array(F.struct("m", F.col("a").alias("v")), F.struct("m", F.col("b").alias("v")))).alias("e"))
        .select(F.col("e.m").alias("a"), F.col("e.v").alias("b"))
        .where("a <> b")
        .distinct()
    )


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges; component is the smallest node reachable.

    Nulls at either end are no edge; loops keep their node as a component of one. Nodes may be of any ordered type.
    """
    pairs = edges.select(F.col(src).alias("s"), F.col(dst).alias("d")).where("s is not null and d is not null")
    current = materialize(
        pairs.select(F.least("s", "d").alias("a"), F.greatest("s", "d").alias("b")).distinct(), "edges"
    )
    loops = current.where("a = b").select("a")
    current = current.where("a <> b")

    def mark(df: DataFrame):
        row = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        return row["n"], row["x"]

    seen = mark(current)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        current = materialize(_small_star(_large_star(current)), "stars")
        now = mark(current)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components have not settled in {max_rounds} rounds")
    hung = current.select(F.col("b").alias("node"), F.col("a").alias("component"))
    roots = current.select(F.col("a").alias("node"), F.col("a").alias("component"))
    alone = loops.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return hung.unionByName(roots).unionByName(alone).groupBy("node").agg(F.min("component").alias("component"))
