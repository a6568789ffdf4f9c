"""Consecutive labels without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_offsets(rows: DataFrame, key: str, value: str, width: int = 4096) -> DataFrame:
    """(key, off): the sum of value over all smaller keys, by ranges of ``width`` keys and the sums of the ranges before."""
    r = rows.select(key, value).withColumn("__b", F.floor(F.col(key) / width))
    sums = r.groupBy("__b").agg(F.sum(value).alias("__s"))
    before = sums.select("__b", (F.sum("__s").over(Window.orderBy("__b")) - F.col("__s")).alias("__o"))
    own = F.sum(value).over(Window.partitionBy("__b").orderBy(key)) - F.col(value)
    return r.join(before, "__b").select(key, (own + F.col("__o")).cast("long").alias("off"))


def dense_ids(values: DataFrame, col: str, start: int = 0, width: int = 4096) -> DataFrame:
    """(col, new_label) of distinct numeric labels in order: ranks inside ranges of ``width``, plus the count before each range."""
    d = values.select(col).distinct().withColumn("__b", F.floor(F.col(col) / width))
    sizes = d.groupBy("__b").count()
    offsets = sizes.select("__b", (F.sum("count").over(Window.orderBy("__b")) - F.col("count")).alias("__o"))
    rank = F.row_number().over(Window.partitionBy("__b").orderBy(col)) - 1
    return d.join(offsets, "__b").select(col, (rank + F.col("__o") + start).cast("long").alias("new_label"))


def consecutive(df: DataFrame, col: str, start: int = 0, keep_zero: bool = False) -> DataFrame:
    """df with new_label; with keep_zero label 0 stays 0 and the others count from 1."""
    ids = dense_ids(df.filter(F.col(col) != 0) if keep_zero else df, col, 1 if keep_zero else start)
    if keep_zero:
        return df.join(ids, col, "left").withColumn("new_label", F.coalesce("new_label", F.lit(0)))
    return df.join(ids, col)
