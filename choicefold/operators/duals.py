"""Dual measures, slack and certification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import item
from .agents import decoded


def dictionary(duals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Duals (rep_id, agent_id, bundle, pi, pos) as (duals with bundle_row_id, bundle_table): each distinct bundle once, in order of first sight.

    Numbering runs over a replication's distinct bundles, which are few.
    """
    first = duals.groupBy("rep_id", "bundle").agg(F.min("pos").alias("_p"))
    table = first.withColumn("bundle_row_id", F.row_number().over(W.partitionBy("rep_id").orderBy("_p")) - 1).drop("_p")
    coded = duals.join(table, ["rep_id", "bundle"]).select("rep_id", "agent_id", "bundle_row_id", "pi")
    return coded, table.select("rep_id", "bundle_row_id", "bundle")


def rows(coded: DataFrame, table: DataFrame, n_observations: int) -> DataFrame:
    """rep_id, obs_id, sim_id, bundle, pi of a coded dual measure."""
    return coded.join(table, ["rep_id", "bundle_row_id"]).select("rep_id", *decoded(F.col("agent_id"), n_observations), "bundle", "pi")


def moment(coded: DataFrame, table: DataFrame, size: int) -> DataFrame:
    """rep_id, moment: bundles weighted by their duals. Duals are summed by bundle first, so the join carries a row per bundle."""
    mass = coded.groupBy("rep_id", "bundle_row_id").agg(F.sum("pi").alias("pi"))
    joined = mass.join(table, ["rep_id", "bundle_row_id"])
    parts = joined.groupBy("rep_id").agg(*[F.sum(F.col("pi") * item("bundle", k)).alias(f"_m{k}") for k in range(size)])
    return parts.select("rep_id", F.array(*[f"_m{k}" for k in range(size)]).alias("moment"))


def slack_summary(slack: DataFrame, column: str = "slack") -> DataFrame:
    """total, mean, greatest and how many are exactly zero."""
    s = F.col(column)
    return slack.agg(F.sum(s).alias("total"), F.avg(s).alias("mean"), F.max(s).alias("max"), F.count_if(s == 0).alias("n_zero"))


def certification(demand: DataFrame) -> DataFrame:
    """n_priced, n_inexact, worst_gap over a log of all pricing calls."""
    return demand.agg(F.count(F.lit(1)).alias("n_priced"), F.count_if(F.col("gap") > 0).alias("n_inexact"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("worst_gap"))


def convergence_trace(trace: DataFrame, by: str | None = None) -> DataFrame:
    """Adds ``gap_delta``, the change of ``gap`` since the iteration before."""
    w = W.partitionBy(by).orderBy("iteration") if by else W.orderBy("iteration")
    return trace.withColumn("gap_delta", F.col("gap") - F.lag("gap").over(w))
