"""Summaries of bootstrap replications ``(rep_id, converged, theta)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import item


def _used(boot: DataFrame, converged_only: bool) -> DataFrame:
    return boot.where("converged") if converged_only else boot


def mean(boot: DataFrame, size: int, converged_only: bool = True) -> DataFrame:
    return _used(boot, converged_only).agg(*[F.avg(item("theta", k)).alias(f"_{k}") for k in range(size)]).select(F.array(*[f"_{k}" for k in range(size)]).alias("mean"))


def standard_errors(boot: DataFrame, size: int, converged_only: bool = True) -> DataFrame:
    """Column standard deviations with one degree of freedom less."""
    return _used(boot, converged_only).agg(*[F.stddev_samp(item("theta", k)).alias(f"_{k}") for k in range(size)]).select(F.array(*[f"_{k}" for k in range(size)]).alias("se"))


def covariance(boot: DataFrame, size: int, converged_only: bool = True) -> DataFrame:
    """i, j, cov."""
    pairs = [(i, j) for i in range(size) for j in range(size)]
    one = _used(boot, converged_only).agg(*[F.covar_samp(item("theta", i), item("theta", j)).alias(f"_{i}_{j}") for i, j in pairs])
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"_{i}_{j}").alias("cov")) for i, j in pairs])).alias("r")).select("r.*")


def interval(boot: DataFrame, size: int, level: float = 0.95, converged_only: bool = True) -> DataFrame:
    """k, lower, upper: exact percentiles with linear interpolation."""
    if not 0 < level < 1:
        raise ValueError("level must be in (0, 1)")
    lo, hi = (1 - level) / 2, (1 + level) / 2
    one = _used(boot, converged_only).agg(*[F.percentile(item("theta", k), F.array(F.lit(lo), F.lit(hi))).alias(f"_{k}") for k in range(size)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.get(F.col(f"_{k}"), 0).alias("lower"), F.get(F.col(f"_{k}"), 1).alias("upper")) for k in range(size)])).alias("r")).select("r.*")


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """Replications of several runs, numbered on; layouts must agree. The number of parts is the driver's list, and so are the offsets."""
    if not parts or any(p.schema != parts[0].schema for p in parts):
        raise ValueError("replications to join need one layout")
    out, before = None, 0
    for p in parts:
        moved = p.withColumn("rep_id", (F.col("rep_id") + before).cast(p.schema["rep_id"].dataType))
        out = moved if out is None else out.unionByName(moved)
        before += p.agg(F.coalesce(F.max("rep_id"), F.lit(-1))).first()[0] + 1
    return out
