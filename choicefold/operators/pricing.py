"""Pricing: every agent's best bundle at a trial theta.

Native oracles are expressions over an agent's row, with theta as one vector column (a literal, or a
column when many replications are priced in one plan).  They add ``bundle``, ``payoff``, ``gap``, ``phi``, ``epsilon``;
nothing is shuffled or exploded.  :class:`Oracle` is for user code, which runs Arrow batch by batch.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import bundles
from ..functions.vectors import first_max, item, total

OUT = "bundle array<double>, payoff double, gap double, phi array<double>, epsilon double"
#: Columns that carry an agent's installed cuts through pricing; user code doesn't see them.
KEPT = ("_cuts", "_keys")


@dataclass(frozen=True)
class Demand:
    """A priced bundle; gap 0 is exact, finite and positive certified, infinite unknown."""

    bundle: np.ndarray
    payoff: float
    gap: float = 0.0

    def __post_init__(self):
        if not math.isfinite(self.payoff):
            raise ValueError(f"payoff must be finite, not {self.payoff}")
        if math.isnan(self.gap) or self.gap < 0:
            raise ValueError(f"gap must be at least 0, not {self.gap}")

    @classmethod
    def exact(cls, bundle, payoff: float) -> Demand:
        return cls(np.asarray(bundle), float(payoff))

    @classmethod
    def inexact(cls, bundle, payoff: float, gap: float) -> Demand:
        if not 0 < gap < math.inf:
            raise ValueError("an inexact demand has a finite gap above 0")
        return cls(np.asarray(bundle), float(payoff), float(gap))

    @classmethod
    def uncertified(cls, bundle, payoff: float) -> Demand:
        return cls(np.asarray(bundle), float(payoff), math.inf)


@dataclass(frozen=True)
class DemandBatch:
    """Priced bundles of several agents, in columns."""

    agent_ids: np.ndarray
    bundles: np.ndarray
    payoffs: np.ndarray
    gaps: np.ndarray

    def __post_init__(self):
        n = len(self.agent_ids)
        if len(np.unique(self.agent_ids)) < n or not n == len(self.bundles) == len(self.payoffs) == len(self.gaps):
            raise ValueError("a batch needs one bundle, payoff and gap for each of its distinct agents")
        if not (np.isfinite(self.payoffs).all() and np.isfinite(self.gaps).all() and (np.asarray(self.gaps) >= 0).all()):
            raise ValueError("payoffs and gaps of a batch must be finite, gaps at least 0")

    def demands(self) -> dict[int, Demand]:
        return {int(a): Demand(b, float(p), float(g)) for a, b, p, g in zip(self.agent_ids, self.bundles, self.payoffs, self.gaps, strict=True)}


class NativeOracle:
    """An oracle in column expressions: ``priced(agents, theta)`` adds the columns of OUT."""

    K: int

    def priced(self, agents: DataFrame, theta: Column) -> DataFrame:
        raise NotImplementedError

    def observed(self, observations: DataFrame, choice: str = "choice") -> Column:
        """phi of an observed choice."""
        raise NotImplementedError


@dataclass(frozen=True)
class Modular(NativeOracle):
    """Items chosen one by one: item k is taken if ``r_k theta_k + nu_k > 0``. Agents have ``r`` and ``nu`` of size K."""

    K: int
    r: str = "r"
    nu: str = "nu"

    def priced(self, agents: DataFrame, theta: Column) -> DataFrame:
        v = [item(self.r, k) * item(theta, k) + item(self.nu, k) for k in range(self.K)]
        b = [F.when(x > 0, 1.0).otherwise(0.0) for x in v]
        return agents.withColumns({
            "bundle": F.array(*b), "payoff": total([F.greatest(x, F.lit(0.0)) for x in v]), "gap": F.lit(0.0),
            "phi": F.array(*[y * item(self.r, k) for k, y in enumerate(b)]), "epsilon": total([y * item(self.nu, k) for k, y in enumerate(b)]),
        })

    def observed(self, observations: DataFrame, choice: str = "choice") -> Column:
        return F.array(*[item(choice, k).cast("double") * item(self.r, k) for k in range(self.K)])


@dataclass(frozen=True)
class Enumerated(NativeOracle):
    """All ``2^M`` bundles of M items; theta = (price weight, item weights), phi = (x.b, b). The first best one is taken.

    Agents have ``x`` and ``nu`` of size M, and ``capacity`` if ``weights`` are given: heavier bundles are left out.
    With ``pairs`` (item, item, value) theta ends with a weight on the sum of values of pairs that a bundle holds, and items count as costs.
    """

    M: int
    weights: Sequence[float] | None = None
    pairs: Sequence[tuple[int, int, float]] | None = None

    @property
    def K(self) -> int:
        return self.M + 1 + (self.pairs is not None)

    def _sets(self) -> list[tuple[int, ...]]:
        return list(itertools.product((0, 1), repeat=self.M))

    def _phi(self, b: tuple[int, ...]) -> list[Column]:
        sign = -1.0 if self.pairs is not None else 1.0
        head = total([item("x", k) * float(y) for k, y in enumerate(b)])
        tail = [F.lit(float(sum(v for i, j, v in self.pairs if b[i] and b[j])))] if self.pairs is not None else []
        return [head, *[F.lit(sign * y) for y in b], *tail]

    def priced(self, agents: DataFrame, theta: Column) -> DataFrame:
        sets, scores = self._sets(), []
        for b in sets:
            s = total([p * item(theta, k) for k, p in enumerate(self._phi(b))]) + total([item("nu", k) * float(y) for k, y in enumerate(b)])
            if self.weights is not None:
                load = float(sum(w * y for w, y in zip(self.weights, b, strict=True)))
                s = F.when(F.lit(load) <= F.col("capacity"), s).otherwise(F.lit(-math.inf))
            scores.append(s)
        scored = agents.withColumn("_scores", F.array(*scores))
        best, at = first_max([item("_scores", i) for i in range(len(sets))])
        chosen = scored.withColumns({"payoff": best, "_at": at})
        every = F.array(*[F.array(*[F.lit(float(y)) for y in b]) for b in sets])
        chosen = chosen.withColumn("bundle", F.get(every, F.col("_at"))).withColumn("gap", F.lit(0.0))
        b = [item("bundle", k) for k in range(self.M)]
        sign = -1.0 if self.pairs is not None else 1.0
        tail = [total([b[i] * b[j] * float(v) for i, j, v in self.pairs])] if self.pairs is not None else []
        phi = F.array(total([item("x", k) * y for k, y in enumerate(b)]), *[y * sign for y in b], *tail)
        return chosen.withColumns({"phi": phi, "epsilon": total([item("nu", k) * y for k, y in enumerate(b)])}).drop("_scores", "_at")

    def observed(self, observations: DataFrame, choice: str = "choice") -> Column:
        b = [item(choice, k).cast("double") for k in range(self.M)]
        sign = -1.0 if self.pairs is not None else 1.0
        tail = [total([b[i] * b[j] * float(v) for i, j, v in self.pairs])] if self.pairs is not None else []
        return F.array(total([item("x", k) * y for k, y in enumerate(b)]), *[y * sign for y in b], *tail)


@dataclass(frozen=True)
class UnitDemand(NativeOracle):
    """One item of J or none. ``x``: J vectors of K features; ``nu``: J + 1 shocks, the last for taking none.

    An item is taken only if it is strictly better than none; of equal items the first.
    """

    K: int
    J: int

    def priced(self, agents: DataFrame, theta: Column) -> DataFrame:
        inside = [total([item(F.get(F.col("x"), j), k) * item(theta, k) for k in range(self.K)]) + item("nu", j) for j in range(self.J)]
        scored = agents.withColumn("_scores", F.array(*inside))
        best, at = first_max([item("_scores", j) for j in range(self.J)])
        scored = scored.withColumn("_at", F.when(best > item("nu", self.J), at).otherwise(self.J)).withColumn("payoff", F.greatest(best, item("nu", self.J)))
        one = F.array(*[F.when(F.col("_at") == j, 1.0).otherwise(0.0) for j in range(self.J + 1)])
        phi = F.array(*[F.coalesce(item(F.get(F.col("x"), F.col("_at")), k), F.lit(0.0)) for k in range(self.K)])
        return scored.withColumns({"bundle": one, "gap": F.lit(0.0), "phi": phi, "epsilon": F.get(F.col("nu"), F.col("_at"))}).drop("_scores", "_at")

    def observed(self, observations: DataFrame, choice: str = "choice") -> Column:
        return F.array(*[total([item(F.get(F.col("x"), j), k) * item(choice, j).cast("double") for j in range(self.J)]) for k in range(self.K)])


class Oracle:
    """User code: implement :meth:`price` or :meth:`price_batch`, and :meth:`features` or :meth:`features_batch`.

    :meth:`features_aggregate` adds the weighted features of many agents without a row for each; fits with aggregate cuts use it where it is there.
    Each must be a pure function of theta and the agents' rows. ``setup`` runs before the first row of a task, ``teardown`` after its last, even
    if one fails.
    Where both forms are there, ``check=True`` compares them.
    """

    TOLERANCE = 1e-13
    check = False

    def setup(self) -> None: ...

    def teardown(self) -> None: ...

    def price(self, theta: np.ndarray, row: dict) -> Demand:
        raise NotImplementedError

    def price_batch(self, theta: np.ndarray, rows: pd.DataFrame) -> Mapping[int, Demand] | DemandBatch:
        raise NotImplementedError

    def features(self, row: dict, bundle: np.ndarray) -> tuple[np.ndarray, float]:
        raise NotImplementedError

    def features_batch(self, rows: pd.DataFrame, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def features_aggregate(self, rows: pd.DataFrame, sets: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, float]:
        raise NotImplementedError

    def has(self, name: str) -> bool:
        return getattr(type(self), name) is not getattr(Oracle, name)


def _rows(pdf: pd.DataFrame) -> list[dict]:
    return pdf.to_dict("records")


def _price(oracle: Oracle, theta: np.ndarray, pdf: pd.DataFrame) -> list[Demand]:
    ids = [int(a) for a in pdf["agent_id"]]
    many = one = None
    if oracle.has("price_batch"):
        many = oracle.price_batch(theta, pdf)
        many = many.demands() if isinstance(many, DemandBatch) else dict(many)
        if set(many) != set(ids):
            raise ValueError(f"price_batch answered for other agents than asked: {sorted(set(many) ^ set(ids))[:5]}")
    if not oracle.has("price_batch") or (oracle.check and oracle.has("price")):
        if not oracle.has("price"):
            raise TypeError("an oracle needs price or price_batch")
        one = {a: oracle.price(theta, r) for a, r in zip(ids, _rows(pdf), strict=True)}
    if many and one:
        for a in ids:
            if not np.array_equal(many[a].bundle, one[a].bundle) or abs(many[a].payoff - one[a].payoff) > oracle.TOLERANCE:
                raise ValueError(f"price and price_batch differ for agent {a}")
    found = many or one or {}
    return [found[a] for a in ids]


def _features(oracle: Oracle, pdf: pd.DataFrame, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    many = one = None
    if oracle.has("features_batch"):
        phi, eps = oracle.features_batch(pdf, sets)
        many = np.asarray(phi, float), np.asarray(eps, float)
    if many is None or (oracle.check and oracle.has("features")):
        if not oracle.has("features"):
            raise TypeError("a feature map needs features or features_batch")
        each = [oracle.features(r, b) for r, b in zip(_rows(pdf), sets, strict=True)]
        one = np.array([p for p, _ in each], float).reshape(len(each), -1), np.array([e for _, e in each], float)
    if many is not None and one is not None:
        same_sign = (np.sign(many[0]) == np.sign(one[0])).all()
        if not same_sign or any(np.abs(a - b).max(initial=0) > oracle.TOLERANCE for a, b in zip(many, one, strict=True)):
            raise ValueError("features and features_batch differ")
    phi, eps = many if many is not None else one
    if not (np.isfinite(phi).all() and np.isfinite(eps).all()):
        raise ValueError("features must be finite")
    return phi, eps


def _features_sum(oracle: Oracle, pdf: pd.DataFrame, sets: list[np.ndarray], weights: np.ndarray, size: int) -> tuple[np.ndarray, float]:
    phi, eps = oracle.features_aggregate(pdf, sets, weights)
    phi, eps = np.asarray(phi, float), float(eps)
    if phi.shape != (size,) or not (np.isfinite(phi).all() and np.isfinite(eps)):
        raise ValueError(f"aggregate features must be {size} finite numbers and one more")
    if oracle.check:
        each, e = _features(oracle, pdf, sets)
        scale = max(1.0, np.abs(weights) @ np.abs(each).max(1, initial=0), np.abs(weights) @ np.abs(e))
        if max(np.abs(weights @ each - phi).max(), abs(weights @ e - eps)) > oracle.TOLERANCE * scale:
            raise ValueError("features_aggregate differs from the sum of features")
    return phi, eps


@dataclass(frozen=True)
class UserOracle(NativeOracle):
    """Adapter of :class:`Oracle` to plans. Filter and project agents before it: nothing moves through Python code."""

    oracle: Oracle
    K: int

    def priced(self, agents: DataFrame, theta: Column) -> DataFrame:
        oracle, names = self.oracle, agents.columns

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            oracle.setup()
            try:
                for pdf in it:
                    if not len(pdf):
                        continue
                    out = []
                    for t, part in pdf.groupby(pdf["_theta"].map(tuple), sort=False):
                        part = part.drop(columns="_theta").reset_index(drop=True)
                        shown = part.drop(columns=[c for c in KEPT if c in part])
                        found = _price(oracle, np.array(t), shown)
                        sets = [np.atleast_1d(np.asarray(d.bundle, float)) for d in found]
                        phi, eps = _features(oracle, shown, [d.bundle for d in found])
                        out.append(part.assign(bundle=sets, payoff=[d.payoff for d in found], gap=[d.gap for d in found], phi=list(phi), epsilon=eps))
                    yield pd.concat(out)[[*names, "bundle", "payoff", "gap", "phi", "epsilon"]]
            finally:
                oracle.teardown()

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in agents.schema)
        return agents.withColumn("_theta", theta).mapInPandas(run, f"{schema}, {OUT}")

    def aggregate_cut(self, agents: DataFrame, theta: Column, weight: str | None, by: tuple[str, ...]) -> DataFrame:
        """The columns of :func:`moments.aggregate_cut` by ``features_aggregate``: one row a group and batch comes out of Python."""
        oracle, size, by = self.oracle, self.K, list(by)

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            oracle.setup()
            try:
                for pdf in it:
                    out = []
                    for (key, t), part in pdf.groupby([pdf[by].apply(tuple, axis=1), pdf["_theta"].map(tuple)], sort=False):
                        part = part.drop(columns=["_theta", *by]).reset_index(drop=True)
                        found = _price(oracle, np.array(t), part)
                        w = np.ones(len(part)) if weight is None else part[weight].to_numpy(float)
                        phi, eps = _features_sum(oracle, part, [d.bundle for d in found], w, size)
                        out.append((*key, phi, eps, len(part), sum(d.gap > 0 for d in found), max(d.gap for d in found)))
                    if out:
                        yield pd.DataFrame(out, columns=[*by, "phi", "epsilon", "n_priced", "n_inexact", "worst_gap"])
            finally:
                oracle.teardown()

        types = {f.name: f.dataType.simpleString() for f in agents.schema}
        schema = ", ".join(f"`{b}` {types[b]}" for b in by) + ", phi array<double>, epsilon double, n_priced bigint, n_inexact bigint, worst_gap double"
        parts = agents.withColumn("_theta", theta).mapInPandas(run, schema)
        totals = [F.sum(c).alias(c) for c in ("epsilon", "n_priced", "n_inexact")]
        whole = parts.groupBy(*by).agg(*[F.sum(item("phi", k)).alias(f"_p{k}") for k in range(size)], *totals, F.max("worst_gap").alias("worst_gap"))
        return whole.select(*by, F.array(*[f"_p{k}" for k in range(size)]).alias("phi"), "epsilon", "n_priced", "n_inexact", "worst_gap")

    def observed(self, observations: DataFrame, choice: str = "choice") -> Column:
        oracle = self.oracle

        @F.pandas_udf("array<double>")
        def run(row: pd.DataFrame, chosen: pd.Series) -> pd.Series:
            return pd.Series(list(_features(oracle, row, [np.asarray(c) for c in chosen])[0]))

        return run(F.struct(*[c for c in observations.columns if c != choice]), F.col(choice))


def with_key(priced: DataFrame) -> DataFrame:
    """Adds ``bundle_key``, exact for bundles of any numbers."""
    return priced.withColumn("bundle_key", bundles.sql_key(F.col("bundle")))


def reduced_cost(priced: DataFrame, u: DataFrame | None) -> DataFrame:
    """Adds ``rc``, payoff less the agent's u (0 where it has none). ``u``: agent_id, u."""
    if u is None:
        return priced.withColumn("rc", F.col("payoff"))
    return priced.join(u, "agent_id", "left").withColumn("rc", F.col("payoff") - F.coalesce("u", F.lit(0.0))).drop("u")


def violation(cuts: DataFrame, theta: Column, u: Column, size: int) -> Column:
    """``phi.theta + epsilon - u`` of candidate cuts."""
    return total([item("phi", k) * item(theta, k) for k in range(size)]) + F.col("epsilon") - u


def disagreement(a: DataFrame, b: DataFrame, size: int, tolerance: float = Oracle.TOLERANCE) -> DataFrame:
    """Agents whose rows (agent_id, phi, epsilon) differ: other signs of phi, or values further apart than tolerance, or only one row."""
    x, y = a.select("agent_id", F.col("phi").alias("p"), F.col("epsilon").alias("e")), b.select("agent_id", F.col("phi").alias("q"), F.col("epsilon").alias("f"))
    apart = F.abs(F.col("e") - F.col("f")) > tolerance
    for k in range(size):
        apart = apart | (F.signum(item("p", k)) != F.signum(item("q", k))) | (F.abs(item("p", k) - item("q", k)) > tolerance)
    both = x.join(y, "agent_id", "full_outer")
    return both.where(F.coalesce(apart, F.lit(True))).select("agent_id")


def missing_answers(asked: DataFrame, answered: DataFrame) -> DataFrame:
    """agent_id of agents that were asked but not answered for, or the other way round."""
    a, b = asked.select("agent_id"), answered.select("agent_id")
    return a.exceptAll(b).union(b.exceptAll(a))
