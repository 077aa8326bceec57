"""Connected components of an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join over edges, so no component has to fit anywhere.  Nodes of high degree are
split by AQE's skew-join handling: the step joins edges to one minimum per node instead of collecting neighbours.

Few edges are one partition, so that a round needs no shuffle: the driver keeps what it knows of each task, and rounds of
empty ones would fill its memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut_lineage


_EDGES = 100_000  # edges for each task; fewer edges than tasks would make files of nothing
_ALONE = 200_000  # so many edges (some 10 MB) are one partition


def tasks_for(edges: int) -> int:
    """Partitions of a table of so many edges."""
    return 1 if edges <= _ALONE else 8 + edges // _EDGES


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """edges (a, b): each neighbour of a node is linked to the node's smallest neighbour or the node itself.

    large: neighbours greater than the node move; otherwise neighbours that are smaller, and the node.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
    moved = both.where(F.col("b") > F.col("a")) if large else both.where(F.col("b") < F.col("a"))
    out = moved.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).coalesce(tasks).distinct()


def components(edges: DataFrame, rounds: int = 30) -> DataFrame:
    """Node and smallest node of its component, for each node of the edges (a long, b long) that isn't smallest itself.

    Loops and repeated edges are ignored; edges with nulls link nothing.  An empty table gives an empty table.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = cut_lineage(now)
    tasks = tasks_for(now.count())
    now, state = now.coalesce(tasks), None
    for _ in range(rounds):
        now = cut_lineage(_star(_star(now, True, tasks), False, tasks).coalesce(tasks)).coalesce(tasks)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum((F.col("b") >= F.col("a")).cast("int"))).first()
        if tuple(seen) == state and not now.alias("x").join(now.alias("y"), F.col("x.b") == F.col("y.a"), "left_semi").limit(1).count():
            break
        state = tuple(seen)
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
