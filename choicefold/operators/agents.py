"""The agent axis: ``agent_id = sim_id * N + obs_id``, its shards and their owners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CYCLIC, CONTIGUOUS = "cyclic", "contiguous"


def expand(observations: DataFrame, n_observations: int, n_simulations: int) -> DataFrame:
    """Every observation once per simulation draw. The draws are a literal sequence, so nothing is shuffled."""
    sims = F.explode(F.sequence(F.lit(0), F.lit(n_simulations - 1)))
    each = observations.withColumn("sim_id", sims)
    return each.withColumn("agent_id", F.col("sim_id").cast("long") * n_observations + F.col("obs_id"))


def decoded(agent: Column, n_observations: int) -> tuple[Column, Column]:
    """obs_id and sim_id of an agent id."""
    return F.pmod(agent, F.lit(n_observations)).cast("long").alias("obs_id"), F.floor(agent / n_observations).cast("int").alias("sim_id")


def shard_bounds(n: int, parts: int, part: int) -> tuple[int, int]:
    """First id and end of the ``part``-th of balanced contiguous shards; sizes differ by one at most, larger ones first."""
    if not 0 <= part < parts:
        raise ValueError(f"shard {part} of {parts}")
    small, more = divmod(n, parts)
    start = part * small + min(part, more)
    return start, start + small + (part < more)


def owner(agent: Column, n: int, parts: int, kind: str = CONTIGUOUS) -> Column:
    """Shard of an id, by arithmetic: no lookup table, no join."""
    if kind == CYCLIC:
        return F.pmod(agent, F.lit(parts)).cast("int")
    small, more = divmod(n, parts)
    turn = more * (small + 1)
    late = F.lit(more) if small == 0 else more + F.floor((agent - turn) / small)
    return F.when(agent < turn, F.floor(agent / (small + 1))).otherwise(late).cast("int")


def shard(df: DataFrame, n: int, parts: int, part: int, kind: str = CONTIGUOUS, column: str = "agent_id") -> DataFrame:
    """Rows of one shard; a contiguous one is a range filter that reaches the scan."""
    if kind == CYCLIC:
        return df.where(F.pmod(F.col(column), F.lit(parts)) == part)
    lo, hi = shard_bounds(n, parts, part)
    return df.where((F.col(column) >= lo) & (F.col(column) < hi))


def interleaved_owners(ranks: DataFrame, n_reps: int) -> DataFrame:
    """rep_id, rank: replications dealt to ranks in turn over nodes. ``ranks``: rank, node_id, node_rank."""
    from pyspark.sql import Window as W

    placed = ranks.withColumn("at", F.row_number().over(W.orderBy("node_rank", "node_id", "rank")) - 1).withColumn("size", F.count(F.lit(1)).over(W.partitionBy(F.lit(1))))
    return placed.select("rank", F.explode(F.when(F.col("at") < n_reps, F.sequence(F.col("at"), F.lit(n_reps - 1), F.col("size").cast("int"))).otherwise(F.array().cast("array<int>"))).alias("rep_id")).select("rep_id", "rank")


def dense(values: DataFrame, n: int, column: str = "value") -> DataFrame:
    """agent_id, value for all of 0..n-1; 0 where there is none. Repeated ids are an error."""
    if values.groupBy("agent_id").count().where("count > 1").limit(1).count():
        raise ValueError("an agent has several values")
    return values.sparkSession.range(n).withColumnRenamed("id", "agent_id").join(values.select("agent_id", column), "agent_id", "left").fillna(0.0, [column])


def scattered(values: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``values`` for the ids asked for."""
    return ids.select("agent_id").join(values, "agent_id")
