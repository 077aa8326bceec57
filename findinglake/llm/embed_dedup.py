"""Near-duplicate embeddings: random-hyperplane sign hashing in several tables, exact cosines, connected components.

A table's key is the signs of `bits` random projections.  Vectors at cosine c agree in one sign with probability
1 - acos(c) / pi, so with 16 bits and 28 tables a pair at 0.98 is missed with probability 7e-6, closer pairs less.
Equal vectors are folded to one with a count first.  Keys are counted before vectors move, so only vectors with a
companion do.  Buckets of at most `small` vectors share tasks.  A bucket of more than `block` vectors is compared in
several tasks, one for each pair of its blocks, and a pair that meets in several tables counts in the first of them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import cut_lineage


def _planes(dim: int, tables: int, bits: int) -> np.ndarray:
    return np.random.default_rng([20240229, dim]).standard_normal((dim, tables * bits))


def table_keys(vectors: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Row by row, one key for each table."""
    signs = vectors @ _planes(vectors.shape[1], tables, bits) > 0
    return signs.reshape(len(vectors), tables, bits) @ (1 << np.arange(bits, dtype=np.int64))


def _small_pairs(x: np.ndarray, code: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs, at cosine `least` or more, of rows (in order of code) with equal codes; for codes of few rows."""
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    size = np.diff(np.append(first, code.size))
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for s in np.unique(size[size > 1]):
        heads = first[size == s]
        for part in np.array_split(heads, -(-heads.size * int(s) // 8192)):
            at = part[:, None] + np.arange(s)
            near = np.einsum("bik,bjk->bij", x[at], x[at]) >= least
            b, i, j = np.nonzero(np.triu(near, 1))
            left.append(part[b] + i)
            right.append(part[b] + j)
    return np.concatenate(left), np.concatenate(right)


def _linked(pdf: pd.DataFrame, least: float, tables: int, bits: int) -> pd.DataFrame:
    """One task: links of each vector that first meet in their bucket's table, and edges that connect what is linked.

    A task is one pair of blocks of a large bucket (i, j not both -1) or many whole small buckets.
    """
    pdf = pdf.sort_values(["dim", "table", "key", "label", "rep"], ignore_index=True)
    if pdf["dim"].iloc[0] != pdf["dim"].iloc[-1] or (pdf["i"].iloc[0] >= 0 and pdf[["table", "key", "label"]].drop_duplicates().shape[0] > 1):
        by = "dim" if pdf["i"].iloc[0] < 0 else ["dim", "table", "key", "label"]
        return pd.concat([_linked(own, least, tables, bits) for _, own in pdf.groupby(by)])
    x = np.stack(pdf["v"].to_numpy()).astype(np.float64)
    keys = table_keys(x, tables, bits)
    x /= np.sqrt((x * x).sum(1))[:, None]
    n, rep, side, table = (pdf[c].to_numpy() for c in ("n", "rep", "side", "table"))
    if pdf["i"].iloc[0] < 0:
        a, b = _small_pairs(x, pdf.groupby(["dim", "table", "key", "label"], sort=True).ngroup().to_numpy(), least)
    else:
        near = np.triu(x @ x.T >= least, 1)
        if side.max():
            near &= side[:, None] != side[None, :]
        if table[0]:  # most pairs of a dense bucket met in the first table
            near &= keys[:, 0][:, None] != keys[:, 0][None, :]
        a, b = np.nonzero(near)
    met = np.zeros(a.size, bool)
    for t in range(tables):
        met |= (t < table[a]) & (keys[a, t] == keys[b, t])
    a, b = a[~met], b[~met]
    count = np.bincount(a, n[b], rep.size).astype(np.int64) + np.bincount(b, n[a], rep.size).astype(np.int64)
    low = np.arange(rep.size)
    while True:  # smallest linked index, until nothing changes
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            break
        low = new
    # One row for each vector of a linked set, not for each pair; a vector of several buckets can stand here twice.
    found = np.flatnonzero(count)
    return pd.DataFrame({"rep": rep[found], "links": count[found], "to": rep[low[found]]})


def embedding_groups(
    vectors: DataFrame, least: float = 0.98, tables: int = 28, bits: int = 16, block: int = 1024, small: int = 64
) -> DataFrame:
    """Per row of (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and their cosine, in double precision, is `least` or more.  A vector that
    is null, zero, or holds null or non-finite components, and one without label or vec_id, links with nothing;
    vectors of different lengths don't link.  Equal rows are vectors of their own and link with each other, and so are
    rows that share a vec_id but not a vector.  kept is true for the smallest vec_id of a component, and null for rows
    without vec_id.  Labels can be of any type that Spark groups by; columns other than the three named aren't read.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), "label")
    fit = (
        F.col("vec_id").isNotNull()
        & F.col("label").isNotNull()
        & F.col("v").isNotNull()
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0)
    )
    rows = cut_lineage(rows.withColumn("fit", F.coalesce(fit, F.lit(False))))
    valid = rows.where("fit").withColumn("hash", F.xxhash64("v"))
    # Several vectors can share a vec_id, so each distinct vector has a number (`rep`) of its own, given as it is written.
    reps = valid.groupBy("label", "hash", "v").agg(F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
    reps = cut_lineage(reps.withColumn("rep", F.monotonically_increasing_id()))

    def hashed(batches):
        for pdf in batches:
            out = pdf[["rep", "label", "dim"]].copy()
            out["keys"] = None
            for _, own in pdf.groupby("dim"):
                x = np.stack(own["v"].to_numpy()).astype(np.float64)
                for i, k in zip(own.index, table_keys(x, tables, bits).tolist()):
                    out.at[i, "keys"] = k
            yield out

    label = dict(rows.dtypes)["label"]
    keys = reps.select("rep", "label", F.size("v").alias("dim"), "v").mapInPandas(
        hashed, f"rep long, label {label}, dim int, keys array<long>"
    )
    keys = keys.select("rep", "label", "dim", F.posexplode("keys").alias("table", "key"))
    bucket = ["label", "dim", "table", "key"]
    several = keys.groupBy(*bucket).agg(F.count("*").alias("m")).where("m > 1")
    members = keys.join(several, bucket).withColumn("nb", F.ceil(F.col("m") / block).cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    spread = max(4 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), reps.count() * tables // 100_000)
    alone, hash_ = F.col("m") > min(small, block), F.xxhash64(*bucket)
    tasks = members.withColumn("x", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        *bucket,
        "rep",
        F.when(alone, hash_).otherwise(F.pmod(hash_, F.lit(spread))).alias("task"),
        F.when(alone, F.least("block", "x")).otherwise(-1).alias("i"),
        F.when(alone, F.greatest("block", "x")).otherwise(-1).alias("j"),
        (F.col("block") > F.col("x")).cast("int").alias("side"),
    )
    found = cut_lineage(
        tasks.join(reps.select("rep", "v", "n"), "rep")
        .groupBy("task", "i", "j")
        .applyInPandas(lambda pdf: _linked(pdf, least, tables, bits), "rep long, links long, to long")
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("to").alias("b")))
    groups = groups.unionByName(groups.select(F.col("component").alias("node"), "component").distinct())
    named = cut_lineage(groups.join(reps.select(F.col("rep").alias("node"), "first_id"), "node"))
    lowest = named.groupBy("component").agg(F.min("first_id").alias("low"))
    named = named.join(lowest, "component").select(F.col("node").alias("rep"), "low")
    known = reps.join(links, "rep", "left").join(named, "rep", "left")
    known = known.select(
        "label",
        "hash",
        "v",
        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        F.coalesce("low", "first_id").alias("component_id"),
    )
    out = valid.join(known, ["label", "hash", "v"]).select("vec_id", "n_links", "component_id")
    rest = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id") == F.col("component_id"))
