"""Connected components over an edge table, by alternating star contractions.

No link, node or component passes through the driver: every round is two grouped minima joined back, its
result is a table in the shared folder, and only a count and a checksum come back to stop the loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemara.llm.common import materialise


def _with_lowest(edges: DataFrame) -> DataFrame:
    """Edges with the smallest ``v`` of their ``u``: a grouped minimum joined back, so a hub's edges stay spread."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_lowest(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array("u", "v")).alias("u")
    return _with_lowest(edges).select(ends, F.col("m").alias("v")).where("u > v")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node with a link; the component is its smallest node.

    Nodes are longs; self links and repeated links are allowed. An empty table gives an empty one.
    The number of rounds grows with the logarithm of the longest path.
    """
    work = materialise(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct(), "edges", narrow=True
    )
    seen = None
    for _ in range(max_rounds):
        check = work.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if check == seen or not check[0]:
            break
        seen = check
        work = materialise(_large_star(work).where("u > v").distinct(), "edges", narrow=True)
        work = materialise(_small_star(work).distinct(), "edges", narrow=True)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = work.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return work.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
