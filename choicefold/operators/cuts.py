"""Cuts as rows ``(rep_id, agent_id, bundle_key, phi, epsilon)``: identity, order, admission and retirement.

Rows come with a position ``pos`` (long) where order counts; ties go to the smaller.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import positioned

SCHEMA = "rep_id int, agent_id bigint, bundle_key binary, phi array<double>, epsilon double"
KEY = ("agent_id", "bundle_key")
#: Fixed value: a dual of at most this size counts as zero.
DUAL_ZERO = 1e-10


def canonical_order(cuts: DataFrame) -> DataFrame:
    """By replication, agent, key; position breaks ties, since Spark's sort is not stable."""
    return cuts.orderBy("rep_id", "agent_id", "bundle_key", "pos") if "pos" in cuts.columns else cuts.orderBy("rep_id", "agent_id", "bundle_key")


def canonical_positions(cuts: DataFrame) -> DataFrame:
    """Adds ``n``, 1..N in :func:`canonical_order`, over all cuts: range partitions with offsets, so no task sorts the whole log."""
    placed = positioned(cuts, [F.col(c) for c in ("rep_id", "agent_id", "bundle_key", "pos")], "n")
    return placed.withColumn("n", F.col("n") + 1)


def deduplicated(cuts: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """The first row of each key: one aggregate with a partial one before its shuffle, no sort."""
    rest = [c for c in cuts.columns if c not in by and c != "pos"]
    first = cuts.groupBy(*by).agg(F.min(F.struct("pos", *rest)).alias("_r"))
    return first.select(*by, "_r.*").select(*cuts.columns)


def fresh(cuts: DataFrame, installed: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """Cuts that are not installed yet."""
    return cuts.join(installed.select(*by), list(by), "left_anti").select(*cuts.columns)


def removed(installed: DataFrame, keys: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """Installed cuts but for some keys."""
    return installed.join(keys.select(*by), list(by), "left_anti").select(*installed.columns)


def rewritten(installed: DataFrame, updates: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """Installed cuts with new ``epsilon`` by key; an unknown key is an error before anything changes."""
    if updates.join(installed.select(*by), list(by), "left_anti").limit(1).count():
        raise KeyError("an update names a cut that is not installed")
    new = updates.select(*by, F.col("epsilon").alias("_new"))
    return installed.join(new, list(by), "left").withColumn("epsilon", F.coalesce("_new", "epsilon")).select(*installed.columns)


def exchanged(cuts: DataFrame, parts: int) -> DataFrame:
    """Each replication's cuts together, in canonical order."""
    return cuts.repartition(parts, "rep_id").sortWithinPartitions("rep_id", "agent_id", "bundle_key")


class CutPolicy:
    """What to admit and what to retire. ``needs`` names the signals that are read: violation, slack, dual.

    ``admit(candidates)`` gets ``violation`` and ``pos``; ``retire(readings)`` gets agent_id, bundle_key, pos and
    dual or slack, null where a cut has no reading, and returns the keys to retire.
    """

    needs: frozenset[str] = frozenset()

    def admit(self, candidates: DataFrame) -> DataFrame:
        return candidates

    def retire(self, readings: DataFrame) -> DataFrame:
        return readings.select(*KEY).limit(0)

    def check_size(self, k: int, n_agents: int) -> None:
        """ValueError if the policy leaves too few cuts for a program of k parameters and a slack for each of n_agents (agents or blocks of them)."""


class AddAll(CutPolicy):
    """Admits all, retires none."""


@dataclass(frozen=True)
class ViolationThreshold(CutPolicy):
    """Admits what violates by more than ``epsilon``."""

    epsilon: float
    needs = frozenset({"violation"})

    def admit(self, candidates: DataFrame) -> DataFrame:
        return candidates.where(F.col("violation") > self.epsilon)


@dataclass(frozen=True)
class MostViolated(CutPolicy):
    """Admits the ``k`` most violated, or a share of the violated (one at least); ties go to the earlier."""

    k: int | None = None
    fraction: float | None = None
    needs = frozenset({"violation"})

    def __post_init__(self):
        if (self.k is None) == (self.fraction is None):
            raise ValueError("give k or fraction")
        if self.k is not None and self.k < 1 or self.fraction is not None and not 0 < self.fraction <= 1:
            raise ValueError("k must be at least 1, fraction in (0, 1]")

    def admit(self, candidates: DataFrame) -> DataFrame:
        found = candidates.where(F.col("violation") > 0)
        n = self.k if self.k is not None else max(1, int(self.fraction * found.count()))
        # A limit over a sort keeps n rows of each partition, not a sort of all.
        return found.orderBy(F.desc("violation"), "pos").limit(n).orderBy("pos")


@dataclass(frozen=True)
class SlackStrip(CutPolicy):
    """Retires cuts whose slack is above a percentile; if more than ``most`` stay, all but the ``most`` tightest. Cuts without a reading stay."""

    percentile: float = 95.0
    most: int | None = None
    needs = frozenset({"slack"})

    def __post_init__(self):
        if not 0 <= self.percentile <= 100 or (self.most is not None and self.most < 1):
            raise ValueError("percentile must be in [0, 100], most at least 1")

    def check_size(self, k: int, n_agents: int) -> None:
        """The cap must leave room for a basis."""
        if self.most is not None and self.most < k + n_agents:
            raise ValueError(f"a cap of {self.most} cuts is below the {k + n_agents} that a basis may need")

    def retire(self, readings: DataFrame) -> DataFrame:
        r = readings.where(F.col("slack").isNotNull())
        cut = r.agg(F.percentile("slack", F.lit(self.percentile / 100)).alias("_cut"))
        r = r.crossJoin(F.broadcast(cut))  # one row
        keep = r.where(F.col("slack") <= F.col("_cut"))
        if self.most is not None and keep.count() > self.most:
            keep = keep.orderBy("slack", "pos").limit(self.most)
        return r.join(keep.select(*KEY), list(KEY), "left_anti").select(*KEY)


@dataclass(frozen=True)
class PurgeInactive(CutPolicy):
    """Retires a cut after ``max_age`` readings in a row with a dual of zero.

    The history is the reading log itself (``iteration``), so the policy keeps no state: a larger dual starts anew, a missing reading neither counts nor
    resets, and only cuts with a reading in the last iteration can be retired.
    """

    max_age: int
    needs = frozenset({"dual"})

    def __post_init__(self):
        if self.max_age < 1:
            raise ValueError("max_age must be at least 1")

    def retire(self, readings: DataFrame) -> DataFrame:
        return streaks(readings, by=KEY).where(F.col("streak") >= self.max_age).select(*KEY)


def streaks(log: DataFrame, by: Sequence[str] = KEY, value: str = "dual", order: str = "iteration") -> DataFrame:
    """Per key, how many of its last readings in a row have a zero ``value`` (nulls are no readings).

    Two aggregates in one pass: readings after the last one that isn't zero. No window, no sort.
    """
    zero = F.abs(F.col(value)) <= DUAL_ZERO
    read = log.where(F.col(value).isNotNull())
    last = read.groupBy(*by).agg(F.max(F.when(~zero, F.col(order))).alias("_reset"), F.sort_array(F.collect_list(F.when(zero, F.col(order)))).alias("_zeros"))
    after = F.filter("_zeros", lambda i: F.col("_reset").isNull() | (i > F.col("_reset")))
    return last.select(*by, F.size(after).cast("long").alias("streak"))


@dataclass(frozen=True)
class Compose(CutPolicy):
    """Admission goes through a chain in order; retirement joins the votes of others, each on the same cuts."""

    admit_chain: tuple[CutPolicy, ...] = ()
    retire_votes: tuple[CutPolicy, ...] = ()

    @property
    def needs(self) -> frozenset[str]:
        return frozenset().union(*[p.needs for p in (*self.admit_chain, *self.retire_votes)])

    def admit(self, candidates: DataFrame) -> DataFrame:
        for p in self.admit_chain:
            candidates = p.admit(candidates)
        return candidates

    def check_size(self, k: int, n_agents: int) -> None:
        for p in (*self.admit_chain, *self.retire_votes):
            p.check_size(k, n_agents)

    def retire(self, readings: DataFrame) -> DataFrame:
        votes = [p.retire(readings) for p in self.retire_votes]
        if not votes:
            return super().retire(readings)
        out = votes[0]
        for v in votes[1:]:
            out = out.union(v)
        return out.distinct()
