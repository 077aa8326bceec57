"""Connected components of rows that share keys, in a number of rounds that grows with the logarithm of the longest chain.

Rows meet at their keys: each row of a key is linked to the key's smallest row, so a key that a third of all rows share
gives as many links as rows, not pairs.  Then every node is linked to the smallest of its neighbours, for larger and for
smaller neighbours in turn, until all links lead to their component's smallest node.  Both are grouped minima, combined
before they move, and joins; no component is held anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from findinglake.storage import written


def _linked(links: DataFrame, larger: bool) -> DataFrame:
    """links (node, to: smaller): each node's larger (or smaller) neighbours move to the smallest one around it."""
    both = links.unionByName(links.select(F.col("to").alias("node"), F.col("node").alias("to")))
    least = both.groupBy("node").agg(F.min("to").alias("least")).withColumn("least", F.least("least", "node"))
    moved = both.where("to > node" if larger else "to < node").join(least, "node").select(F.col("to").alias("node"), F.col("least").alias("to"))
    if not larger:
        moved = moved.unionByName(least.select("node", F.col("least").alias("to")))
    return moved.where("node <> to").select(F.greatest("node", "to").alias("node"), F.least("node", "to").alias("to")).distinct()


def smallest_linked(links: DataFrame, most: int = 60) -> tuple[DataFrame, int]:
    """(node, to) with the smallest node of its component for each node but these, and the rounds that it took.

    links: node, to, of any order; loops and nulls link nothing.  Rounds are about the logarithm of the longest path, so
    `most` is beyond any input; it is there to end a run that is wrong.
    """
    now = links.where("node <> to").select(F.greatest("node", "to").alias("node"), F.least("node", "to").alias("to")).distinct()
    now = written(now)
    for n in range(most):
        # Done when each node has one link and no link leads to a node that has one.
        rows, nodes = now.agg(F.count("*"), F.count_distinct("node")).first()
        if rows == nodes and not now.join(now.select(F.col("node").alias("to")), "to", "left_semi").limit(1).count():
            return now, n
        now = written(_linked(_linked(now, True), False))
    raise RuntimeError(f"links still change after {most} rounds")


def grouped_by_keys(rows: DataFrame) -> DataFrame:
    """id and group_id, the smallest id reachable over shared keys, of rows (id, keys: array of texts).

    Rows without keys are groups of their own; null keys are none; rows with one id are one, and so are groups that a row
    with keys of both bridges.
    """
    pairs = written(rows.select("id", F.explode("keys").alias("key")).where("key is not null").distinct())
    of_key = pairs.groupBy("key").agg(F.min("id").alias("to"), F.count("*").alias("n")).where("n > 1").drop("n")
    links = pairs.join(of_key, "key").select(F.col("id").alias("node"), "to")
    found, _ = smallest_linked(links)
    ids = rows.select("id").distinct()
    return ids.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("to", "id").alias("group_id"))
