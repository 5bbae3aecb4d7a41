"""Random bootstrap weights: counter-based by key, and one stream per replication."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The namespace of bootstrap keys, and the splitmix64 increment and multipliers.
NAMESPACE = 0xC0B2202606250001
INCREMENT = 0x9E3779B97F4A7C15
MULTIPLIERS = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _scramble(x: np.ndarray) -> np.ndarray:
    """One splitmix64 step of every element."""
    u = np.uint64
    x = x + u(INCREMENT)
    for shift, by in zip((30, 27), MULTIPLIERS, strict=True):
        x = (x ^ (x >> u(shift))) * u(by)
    return x ^ (x >> u(31))


def exponential_draws(seed: int, rep, obs) -> np.ndarray:
    """Exp(1) draws that depend on (seed, rep, obs) only, wherever they are made. ``rep``, ``obs``: numbers or arrays."""
    rep, obs = np.broadcast_arrays(np.asarray(rep), np.asarray(obs))
    for a in (rep, obs, np.asarray(seed)):
        if not np.issubdtype(a.dtype, np.integer) or (a.size and a.min() < 0):
            raise ValueError("keys of draws must be integers of at least 0")
    with np.errstate(over="ignore"):
        x = np.full(rep.shape, NAMESPACE, np.uint64)
        for key in (np.full(rep.shape, seed, np.uint64), rep.astype(np.uint64), obs.astype(np.uint64)):
            x = _scramble(x ^ key)
    return -np.log1p(-((x >> np.uint64(11)).astype(float) * 2.0**-53))


def draw(seed: int, rep: Column, obs: Column) -> Column:
    """:func:`exponential_draws` as a column, Arrow batch by batch."""

    @F.pandas_udf("double")
    def run(r: pd.Series, o: pd.Series) -> pd.Series:
        return pd.Series(exponential_draws(seed, r.to_numpy(np.int64), o.to_numpy(np.int64)))

    return run(rep.cast("long"), obs.cast("long"))


def observation_weights(obs: DataFrame, reps: range, seed: int) -> DataFrame:
    """rep_id, obs_id, w: draws of every observation and replication, scaled to a sum of N by replication.

    The sum is an aggregate joined back, not a window, so no task holds a whole replication.
    """
    n = obs.count()
    each = obs.select("obs_id", F.explode(F.sequence(F.lit(reps.start), F.lit(reps.stop - 1))).alias("rep_id")) if len(reps) else obs.select("obs_id", F.lit(0).alias("rep_id")).limit(0)
    raw = each.withColumn("raw", draw(seed, F.col("rep_id"), F.col("obs_id")))
    sums = raw.groupBy("rep_id").agg(F.sum("raw").alias("total"))  # a row per replication
    return raw.join(F.broadcast(sums), "rep_id").select("rep_id", "obs_id", (F.col("raw") * F.lit(float(n)) / F.col("total")).alias("w"))


def scaled(raw: np.ndarray) -> np.ndarray:
    """Weights with a sum of their number."""
    s = raw.sum()
    return raw * (len(raw) / s) if s > 0 else np.ones(len(raw))


def keyed_weights(n: int, seed: int, rep: int) -> np.ndarray:
    """Counter-based weights of observations 0..n-1, scaled."""
    if n < 1:
        raise ValueError("at least one observation is needed")
    return scaled(exponential_draws(seed, rep, np.arange(n)))


def stream_weights(n: int, seed: int, rep: int) -> np.ndarray:
    """Weights from a PCG64 stream of (seed, rep), scaled: another sequence than :func:`keyed_weights`."""
    if n < 1 or seed < 0 or rep < 0:
        raise ValueError("n must be at least 1, seed and rep at least 0")
    return scaled(np.random.Generator(np.random.PCG64(np.random.SeedSequence((seed, rep)))).standard_exponential(n))


class ExponentialDraws:
    """Weight source: :func:`stream_weights` by default, or counter-based ones."""

    def __init__(self, seed: int, keyed: bool = False):
        self.seed, self.keyed = int(seed), keyed

    def weights(self, n: int, rep: int) -> np.ndarray:
        return (keyed_weights if self.keyed else stream_weights)(n, self.seed, rep)


class ReplayedWeights:
    """Weight source: the rows of a matrix (replications by observations)."""

    def __init__(self, matrix):
        self.matrix = np.array(matrix, float)
        if self.matrix.ndim != 2 or not np.isfinite(self.matrix).all() or (self.matrix < 0).any():
            raise ValueError("weights must be a finite, non-negative matrix of replications by observations")

    def weights(self, n: int, rep: int) -> np.ndarray:
        if not 0 <= rep < len(self.matrix) or self.matrix.shape[1] != n:
            raise ValueError(f"no weights for replication {rep} of {n} observations in a matrix of {self.matrix.shape}")
        return self.matrix[rep]


