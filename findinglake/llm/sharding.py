"""Uniform random sharding with exact shard sizes, by a hypergeometric communication matrix.

A uniform permutation of all rows, cut into shards of fixed sizes, sends from each partition of the input a random
number of rows to each shard.  These numbers follow a multivariate hypergeometric law and are drawn first: a table of
partitions by shards with `most` lines at most, however large the input.  Then each partition permutes its rows and deals them out by its
line of the table, the rows are exchanged, and each shard permutes what it received.  No global sort is needed, and
the shards' sizes are exact.

Rows are handled by DataFrame functions only.  Partitions are hash classes of about `rows` rows each, or more where
that would be over `most` of them, not Spark's own, so a lost executor's work is repeated with the same result; shards
are permuted in blocks of that size, which are placed one after the other.  Equal rows are counted first and told apart
by their number, so they spread over partitions and blocks like others.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import cut_lineage

_COPIES = 65_536


def hypergeometric(good: int, bad: int, draws: int, rnd: random.Random) -> int:
    """How many of `draws` items, taken without replacement, are among the `good` ones.  Any size; exact inversion.

    Walks outwards from the mode, so the time grows with the standard deviation only.
    """
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    mode = min(high, max(low, (draws + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(n: int, k: int) -> float:
        return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)

    top = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    u = rnd.random() - top
    a = b = mode
    up = down = top
    while u > 0 and (a > low or b < high):
        if b < high:
            up *= (good - b) * (draws - b) / ((b + 1) * (bad - draws + b + 1))
            b += 1
            u -= up
            if u <= 0:
                return b
        if a > low:
            down *= a * (bad - draws + a) / ((good - a + 1) * (draws - a + 1))
            a -= 1
            u -= down
            if u <= 0:
                return a
        if up + down < 1e-300:
            break
    return mode


def communication_matrix(rows: list[int], shards: list[int], rnd: random.Random) -> list[list[int]]:
    """How many rows each partition sends to each shard; lines sum to `rows`, columns to `shards`."""
    left, out = list(shards), []
    for n in rows:
        line, pool = [], sum(left)
        for s, space in enumerate(left):
            pool -= space
            x = hypergeometric(space, pool, n, rnd)
            line.append(x)
            left[s] -= x
            n -= x
        out.append(line)
    return out


def shard(docs: DataFrame, shards: int = 8, seed: int = 1, rows: int = 20_000, most: int = 4096) -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `rows`: the shards' row counts are at most one apart, and slots run from 0 without gaps in each shard.
    size is the text's UTF-8 bytes plus 1, and text_crc32 is that of a null text's empty string.  Repeated rows and
    rows without doc_id count like others.  The same rows, seed and number of shards give the same result.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + F.lit(1)).cast("long")
    order = ["doc_id", "text_crc32", "size", "copy"]
    table = docs.select("doc_id", size.alias("size"), F.crc32(text).alias("text_crc32")).groupBy(*order[:3]).agg(F.count("*").alias("n"))
    # Equal rows are numbered in blocks of _COPIES, so that no array grows with a group's size.
    heads = table.select(*order[:3], "n", F.explode(F.sequence(F.lit(1).cast("long"), "n", F.lit(_COPIES))).alias("head"))
    tail = F.least("n", F.col("head") + (_COPIES - 1))
    table = cut_lineage(heads.select(*order[:3], F.explode(F.sequence("head", tail)).alias("copy")))
    total = table.count()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))

    parts = min(most, max(2 * least, -(-total // rows)))
    table = table.withColumn("part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    counts = sorted((r.part, r.n) for r in table.groupBy("part").agg(F.count("*").alias("n")).collect())
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([n for _, n in counts], sizes, random.Random(seed))
    lines = [{"p": p, "upto": [sum(line[: s + 1]) for s in range(shards)]} for (p, _), line in zip(counts, matrix)]
    deal = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(lines)), "array<struct<p:int,upto:array<long>>>")).alias("x"))
    deal = deal.select(F.col("x.p").alias("part"), "x.upto")

    def shuffled(by: str, salt: int):
        keys = ", ".join(order)
        return F.expr(f"row_number() over (partition by {by} order by xxhash64({seed}, {salt}, {keys}), {keys})")

    # The table of lines has one row for each partition, `most` at most.
    dealt = table.withColumn("nth", shuffled("part", 1)).join(F.broadcast(deal), "part")
    dealt = dealt.withColumn("shard", F.size(F.filter("upto", lambda u: u < F.col("nth"))).cast("int"))
    blocks = min(max(1, most // shards), max(1, -(-least // 2), -(-total // (rows * shards))))
    block = F.pmod(F.xxhash64(F.lit(seed), F.lit(2), *order), F.lit(blocks)).cast("int")
    dealt = cut_lineage(dealt.select(*order, "shard", block.alias("block")))

    filled = dealt.groupBy("shard", "block").agg(F.count("*").alias("n"))
    # One row for each block of each shard, `most` or the number of shards in all at most.
    before = filled.select(
        "shard", "block", F.expr("sum(n) over (partition by shard order by block) - n").alias("before")
    )
    slot = F.col("before") + shuffled("shard, block", 3) - 1
    return dealt.join(F.broadcast(before), ["shard", "block"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        slot.cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
