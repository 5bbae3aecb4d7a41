"""Observations from tables and arrays, with explicit schemas."""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(df: DataFrame, key: Column) -> DataFrame:
    """Adds ``obs_id`` 0..N-1 in the order of a distinct integer key; see :func:`positioned`."""
    return positioned(df, [key.cast("long")], "obs_id")


def positioned(df: DataFrame, keys: Sequence[Column], name: str) -> DataFrame:
    """Adds ``name``, 0..N-1 in the order of keys that are distinct together.

    Rows are range-partitioned by the keys and counted by partition; offsets are a running sum over partitions, so no task sees all rows.
    """
    from pyspark.sql import Window as W

    cols = [f"_key{i}" for i in range(len(keys))]
    placed = df.select("*", *[k.alias(c) for k, c in zip(keys, cols, strict=True)]).repartitionByRange(*cols).withColumn("_p", F.spark_partition_id()).persist()
    counts = placed.groupBy("_p").count()
    starts = counts.select("_p", (F.sum("count").over(W.orderBy("_p")) - F.col("count")).alias("_start"))
    within = F.row_number().over(W.partitionBy("_p").orderBy(*cols))
    return placed.withColumn("_i", within).join(F.broadcast(starts), "_p").withColumn(name, F.col("_start") + F.col("_i") - 1).drop("_p", "_i", "_start", *cols)


def from_arrays(spark: SparkSession, choice, shocks=None, **covariates) -> tuple[DataFrame, DataFrame | None]:
    """Observations (obs_id, choice, covariates) and shocks (obs_id, sim_id, nu) of arrays: choice (N, M), shocks (N, S, ...)."""
    choice = np.asarray(choice)
    n = len(choice)
    for name, v in covariates.items():
        if len(v) != n:
            raise ValueError(f"{name} has {len(v)} rows, not {n}")
    names = list(covariates)
    rows = [(i, np.atleast_1d(choice[i]).astype(float).tolist(), *[np.asarray(covariates[c][i]).astype(float).tolist() for c in names]) for i in range(n)]
    deep = lambda v: "array<" * (np.ndim(v) - 1) + "double" + ">" * (np.ndim(v) - 1)
    obs = spark.createDataFrame(rows, ", ".join(["obs_id bigint", "choice array<double>", *[f"`{c}` {deep(covariates[c])}" for c in names]]))
    if shocks is None:
        return obs, None
    shocks = np.asarray(shocks, float)
    if shocks.ndim < 2 or len(shocks) != n:
        raise ValueError(f"shocks must be observations by draws, not {shocks.shape}")
    kind = deep(np.empty((0,) * (shocks.ndim - 1)))
    flat = [(i, s, shocks[i, s].tolist()) for i in range(n) for s in range(shocks.shape[1])]
    return obs, spark.createDataFrame(flat, f"obs_id bigint, sim_id int, nu {kind}")


def items(customers: DataFrame) -> DataFrame:
    """Five synthetic items for each customer: obs_id, r, nu (simulation draw), choice (from another draw and fixed parameters).

    Everything is an integer over a power of two, so sums are exact.
    """
    a = F.col("c_custkey")
    r = [F.when((a * 31 + k * 17) % 2 == 0, 1.0).otherwise(-1.0) for k in range(1, 6)]
    nu = [((a * 37 + k * 53) % 101 - 50) / F.lit(128.0) + F.lit(1 / 1024) for k in range(1, 6)]
    other = [((a * 59 + k * 29) % 103 - 51) / F.lit(128.0) + F.lit(1 / 1024) for k in range(1, 6)]
    true = (0.25, -0.125, 0.1875, -0.25, 0.0625)
    choice = [F.when(r[k] * true[k] + other[k] > 0, 1.0).otherwise(0.0) for k in range(5)]
    return customers.select(a.alias("key"), F.array(*r).alias("r"), F.array(*nu).alias("nu"), F.array(*choice).alias("choice"))


def shared_arrays(spark: SparkSession, most_bytes: int = 256 << 20, **arrays):
    """One read-only copy of NumPy arrays on every executor, for user oracles; larger ones belong into a table."""
    size = sum(np.asarray(a).nbytes for a in arrays.values())
    if size > most_bytes:
        raise ValueError(f"{size} bytes are more than {most_bytes}: join a table instead")
    for a in arrays.values():
        a.flags.writeable = False
    return spark.sparkContext.broadcast(arrays)


def written(df: DataFrame, path: str) -> None:
    """``df`` as Parquet in a new folder, without processes that the driver would start.

    Hadoop starts ``chmod`` for every file and folder it makes in a local file system, and that process holds the driver's memory a second
    time until it begins. So the committer finds its folders made, and makes no _SUCCESS.
    """
    if path.startswith("file:/"):
        os.makedirs("/" + path.removeprefix("file:").lstrip("/") + "/_temporary/0")
    df.write.mode("append").option("compression", "zstd").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
