"""Reductions that don't depend on how rows are partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_sum(df: DataFrame, value: str, key: str, window: int = 100_000) -> DataFrame:
    """``total``: the sum in ascending key order, the same to the last bit for any partitioning.

    Ids are cut into ranges of ``window``; each range is folded in order by itself, and the ranges' sums in order after that, so
    no task holds more than a range.  Repeated keys are an error.
    """
    parts = df.groupBy(F.floor(F.col(key) / window).alias("w")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).cast("double").alias("v")))).alias("rows"), F.count_distinct(key).alias("d")
    )
    fold = F.aggregate("rows", F.lit(0.0), lambda a, r: a + r["v"])
    checked = F.when(F.col("d") == F.size("rows"), fold).otherwise(F.raise_error(F.lit("keys of a canonical sum repeat")).cast("double"))
    each = parts.select("w", checked.alias("s"))
    rows = each.agg(F.array_sort(F.collect_list(F.struct("w", "s"))).alias("rows"))
    return rows.select(F.aggregate("rows", F.lit(0.0), lambda a, r: a + r["s"]).alias("total"))


def greatest_violation(value: Column) -> Column:
    """Greatest value, 0 at least or for no rows; NaN if there is one (it orders above all numbers)."""
    return F.greatest(F.coalesce(F.max(value), F.lit(0.0)), F.lit(0.0))


def batched_max(df: DataFrame, value: str, by: str = "rep_id") -> DataFrame:
    """:func:`greatest_violation` of every group in one pass."""
    return df.groupBy(by).agg(greatest_violation(F.col(value)).alias("worst"))


def canonical_vector_sum(df: DataFrame, vector: str, key: str, size: int) -> DataFrame:
    """``total``: sum of one vector per key (such as a partition's partial sum) in ascending key order. Meant for few rows: a row per partition or rank."""
    rows = df.agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(vector).alias("v")))).alias("rows"))

    def folded(k: int) -> Column:
        return F.aggregate("rows", F.lit(0.0), lambda a, r: a + F.get(r["v"], k))

    return rows.select(F.array(*[folded(k) for k in range(size)]).alias("total"))
