"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.shared import sized, stored


def _toward_least(edges: DataFrame, n: int) -> DataFrame:
    """Each node's larger neighbours are linked to the least node of its neighbourhood instead. ``n``: the number of edges."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    larger = both.filter("v > u").join(sized(least, n), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return larger.filter("u <> v").distinct()


def _among_smaller(edges: DataFrame, n: int) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of these. ``edges``: u > v, ``n`` at most."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(sized(least, n), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``node`` and ``root``, the least node of its component, for each node with an edge (columns u and v).

    Both steps of a round move edges toward least nodes until each component is a star around its root. The
    edges of a round are written to the shared folder, so a lost executor costs one round at most.
    Edges from a node to itself, or with nulls, are left out.
    """
    now = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = stored(now, "edges"), None
    for _ in range(rounds):
        state = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).collect()[0]
        if state == before or not state[0]:
            break
        before = state
        now = stored(_among_smaller(_toward_least(now, state[0]), state[0]), "edges")
    else:
        raise RuntimeError("the components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
