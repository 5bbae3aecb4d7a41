"""Which agents an iteration prices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .agents import shard_bounds
from .cuts import DUAL_ZERO


def concentration(duals: DataFrame) -> DataFrame:
    """agent_id, share: an agent's greatest dual over the sum of its duals above zero."""
    return duals.where(F.col("pi") > DUAL_ZERO).groupBy("agent_id").agg((F.max("pi") / F.sum("pi")).alias("share"))


def staleness(log: DataFrame, iteration: int) -> DataFrame:
    """agent_id, age: iterations since an agent was last priced. ``log``: agent_id, iteration."""
    return log.groupBy("agent_id").agg((F.lit(iteration) - F.max("iteration")).cast("long").alias("age"))


class RepricingSchedule:
    """``select(agents, iteration, duals, last)``: the agents to price. ``last``: agent_id, iteration last priced."""

    full = False
    needs_duals = False

    def select(self, agents: DataFrame, n: int, iteration: int, duals: DataFrame | None = None, last: DataFrame | None = None) -> DataFrame:
        raise NotImplementedError

    def mask(self, n: int, iteration: int) -> Column | None:
        """The same as a condition on ``agent_id``, for schedules that need nothing else."""
        return None


class ResolveAll(RepricingSchedule):
    full = True

    def select(self, agents, n, iteration, duals=None, last=None):
        return agents


@dataclass(frozen=True)
class RoundRobin(RepricingSchedule):
    """One balanced contiguous slice after the other: a range filter that reaches the scan."""

    chunks: int

    def __post_init__(self):
        if isinstance(self.chunks, bool) or self.chunks < 1:
            raise ValueError("chunks must be at least 1")

    def select(self, agents, n, iteration, duals=None, last=None):
        return agents.where(self.mask(n, iteration))

    def mask(self, n, iteration):
        lo, hi = shard_bounds(n, self.chunks, iteration % self.chunks)
        return (F.col("agent_id") >= lo) & (F.col("agent_id") < hi)


@dataclass(frozen=True)
class DualInformed(RepricingSchedule):
    """Skips agents whose dual sits on one cut (a share of ``threshold`` or more) and that were priced less than ``max_staleness`` iterations ago.

    All agents in iteration 0 or without both signals.
    """

    threshold: float = 0.9
    max_staleness: int = 5
    needs_duals = True

    def __post_init__(self):
        if not 0 < self.threshold <= 1 or isinstance(self.max_staleness, bool) or self.max_staleness < 1:
            raise ValueError("threshold must be in (0, 1], max_staleness at least 1")

    def select(self, agents, n, iteration, duals=None, last=None):
        if iteration == 0 or duals is None or last is None:
            return agents
        settled = concentration(duals).where(F.col("share") >= self.threshold).select("agent_id")
        recent = last.where(iteration - F.col("iteration") < self.max_staleness).select("agent_id")
        return agents.join(settled.join(recent, "agent_id", "left_semi"), "agent_id", "left_anti")
