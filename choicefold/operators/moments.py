"""Observed moments and objective coefficients."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import item


def sums(df: DataFrame, vector: str, size: int, weight: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``total``: the (weighted) sum of a vector column, by group: partial sums on the map side, one row a group after."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    parts = [F.sum(w * item(vector, k)).alias(f"_s{k}") for k in range(size)]
    out = df.groupBy(*by).agg(*parts) if by else df.agg(*parts)
    return out.select(*by, F.array(*[F.coalesce(f"_s{k}", F.lit(0.0)) for k in range(size)]).alias("total"))


def empirical_moment(observed: DataFrame, size: int) -> DataFrame:
    """``moment``: mean of phi over observations (one row each)."""
    return observed.agg(*[F.avg(item("phi", k)).alias(f"_m{k}") for k in range(size)]).select(F.array(*[f"_m{k}" for k in range(size)]).alias("moment"))


def objective_coefficients(observed: DataFrame, size: int, n_simulations: int = 1, weight: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``c``: minus the weighted sum of observed phi over agents, which is S times that over observations."""
    s = sums(observed, "phi", size, weight, by)
    return s.select(*by, F.transform("total", lambda x: -x * float(n_simulations)).alias("c"))


def aggregate_cut(priced: DataFrame, size: int, weight: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """``phi``, ``epsilon`` of the one cut that sums all agents' (weighted) rows, and the pricing tally; one row a group."""
    w = F.lit(1.0) if weight is None else F.col(weight)
    parts = [F.sum(w * item("phi", k)).alias(f"_p{k}") for k in range(size)]
    tally = [F.count(F.lit(1)).alias("n_priced"), F.count_if(F.col("gap") > 0).alias("n_inexact"), F.max("gap").alias("worst_gap")]
    g = priced.groupBy(*by) if by else priced
    out = g.agg(*parts, F.sum(w * F.col("epsilon")).alias("epsilon"), *tally)
    return out.select(*by, F.array(*[f"_p{k}" for k in range(size)]).alias("phi"), "epsilon", "n_priced", "n_inexact", "worst_gap")


def instrument_slope(df: DataFrame, instrument: str, regressor: str, outcome: str) -> DataFrame:
    """``ols`` and ``iv``: slopes of outcome on regressor, plain and by one instrument, each with a constant."""
    return df.agg(
        (F.covar_samp(regressor, outcome) / F.var_samp(regressor)).alias("ols"),
        (F.covar_samp(instrument, outcome) / F.covar_samp(instrument, regressor)).alias("iv"),
    )


def sigma_criterion(duals: DataFrame, observed: float, n: int) -> DataFrame:
    """sigma, criterion: squared relative distance of the dual mean of ``size`` squared from its observed value. ``duals``: sigma, pi, size."""
    m = duals.groupBy("sigma").agg((F.sum(F.col("pi") * F.col("size") * F.col("size")) / n).alias("m"))
    return m.select("sigma", F.pow((F.col("m") - observed) / observed, 2).alias("criterion"))
