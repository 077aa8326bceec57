"""Numbers within groups of any size: counts of blocks of rows become offsets, so no group passes one task whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, by: str, order: dict[str, Column], unique: str, name: str = "nth", width: int = 1 << 16, ties: tuple[str, ...] = ()) -> DataFrame:
    """rows with their place (from 1) in their group of `by`, in the order of few-valued expressions and then `unique`.

    order: name -> expression, ascending; each has few values.  unique: a column of whole numbers that tells the rows
    of a group apart (equal ones get places next to each other, in the order of `ties`; null ones stand first).  A group's rows
    are numbered in blocks of `width` values of `unique` under one order; the table of blocks' sizes is what one
    window task of a group sees.  Columns called like `name` or like a key of order are replaced.
    """
    keys = [f"_{name}_{k}" for k in order]
    block = f"_{name}_block"
    rows = rows.withColumns({k: e for k, e in zip(keys, order.values())} | {block: F.floor(F.col(unique) / width)})
    where = [by, *keys, block]
    sizes = rows.groupBy(*where).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(by).orderBy(*keys, block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*where).orderBy(unique, *ties))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in where]
    joined = rows.withColumn("_own", own).alias("r").join(offsets.alias("o"), same)
    kept = [F.col(f"r.{c}") for c in rows.columns if c not in (*keys, block, name)]
    return joined.select(*kept, (F.col("o._before") + F.col("r._own")).alias(name))


def last_before(rows: DataFrame, by: str, time: str, tie: str, value: Column, name: str) -> DataFrame:
    """rows with the last non-null `value` of the rows before each in its group of `by`, in the order of time and tie.

    A group is folded day by day: within a day in one window, and across days on one row for each of them.
    """
    rows = rows.withColumns({"_value": value, "_day": F.to_date(time)})
    inner = Window.partitionBy(by, "_day").orderBy(time, tie)
    here = F.last("_value", ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, -1))
    found = F.col("_value").isNotNull()
    days = rows.groupBy(by, "_day").agg(F.max_by(F.when(found, F.col("_value")), F.when(found, F.struct(time, tie))).alias("_last"))
    across = Window.partitionBy(by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(F.col(by).alias("_by"), F.col("_day").alias("_on"), F.last("_last", ignorenulls=True).over(across).alias("_carried"))
    same = F.col(by).eqNullSafe(F.col("_by")) & F.col("_day").eqNullSafe(F.col("_on"))
    out = rows.withColumn("_here", here).join(days, same)
    return out.withColumn(name, F.coalesce("_here", "_carried")).drop("_value", "_day", "_by", "_on", "_carried", "_here")
