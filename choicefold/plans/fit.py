"""Row generation as a sequence of small plans.

Agents are read once and kept in executor memory; each iteration is one action over them with theta as a literal, so lineage
never grows.  With ``NSLACK`` the action brings back violated agents' cuts; with ``ONESLACK`` it brings one aggregate row, whatever the number of agents, which is
the form to use at scale.  ``BLOCKSLACK`` lies between: one row for each of a fixed number of groups of agents,
which takes fewer iterations.  From ``LoopConfig.spread`` agents on, ``NSLACK`` leaves cuts with the executors (see :mod:`spread`).
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.bundles import aggregate_key
from ..functions.layout import Parameters
from ..functions.vectors import item, literal
from ..operators import agents as ax
from ..operators import cuts as cx
from ..operators import moments
from ..operators.pricing import NativeOracle, Oracle, UserOracle, reduced_cost, with_key
from ..operators.schedules import RepricingSchedule, ResolveAll
from .master import CutRow, Master
from .results import Certification, FitResult, Publication, RunInfo
from .spread import TABLE, SpreadMaster

NSLACK, ONESLACK, BLOCKSLACK = "nslack", "oneslack", "blockslack"
AGGREGATE = -1


@dataclass(frozen=True)
class Data:
    """``observations``: obs_id 0..N-1 (long), choice and covariates, and ``weight`` if not all 1; ``shocks``: obs_id, sim_id and shocks, for S draws (None: in observations, S = 1)."""

    observations: DataFrame
    shocks: DataFrame | None = None
    n_simulations: int = 1
    choice: str = "choice"

    def agents(self) -> tuple[DataFrame, int]:
        n, lo, hi, d = self.observations.agg(F.count(F.lit(1)), F.min("obs_id"), F.max("obs_id"), F.count_distinct("obs_id")).first()
        if not n or lo != 0 or hi != n - 1 or d != n:
            raise ValueError("obs_id must number the observations from 0 without gaps")
        if self.shocks is None:
            return ax.expand(self.observations, n, self.n_simulations), n
        if self.shocks.count() != n * self.n_simulations:
            raise ValueError(f"{self.n_simulations} draws for each of {n} observations are needed")
        joined = self.observations.join(self.shocks, "obs_id")
        return joined.withColumn("agent_id", F.col("sim_id").cast("long") * n + F.col("obs_id")), n


@dataclass(frozen=True)
class Model:
    """An oracle over a parameter layout, and how its cuts are put together."""

    oracle: NativeOracle | Oracle
    parameters: Parameters
    formulation: str = NSLACK
    blocks: int = 16

    def native(self) -> NativeOracle:
        return self.oracle if isinstance(self.oracle, NativeOracle) else UserOracle(self.oracle, self.parameters.K)


@dataclass(frozen=True)
class LoopConfig:
    tolerance: float = 1e-6
    max_iterations: int = 1000
    min_iterations: int = 0
    #: Proximal term ``qp_weight |theta - ref|^2`` of the first ``qp_iterations`` programs after the first; ``ref`` is ``anchor``
    #: (None: zeros) throughout if ``penalty_ref`` is "static", the theta priced last if it is "dynamic".
    qp_weight: float = 0.0
    qp_iterations: int = 0
    penalty_ref: str = "static"
    anchor: np.ndarray | None = None
    schedule: RepricingSchedule = field(default_factory=ResolveAll)
    policy: cx.CutPolicy = field(default_factory=cx.AddAll)
    callback: Callable[[int, object], int | None] | None = None
    on_event: Callable[[dict], None] | None = None
    #: Agents from which on the cuts of single agents stay with the executors. Warm cuts, kept masters, policies, schedules that read duals and u without a
    #: lower bound of 0 or more keep them on the driver.
    spread: int = 50_000
    _silent: list[Exception] = field(default_factory=list, compare=False, repr=False)

    def __post_init__(self):
        for v, name in ((self.max_iterations, "max_iterations"), (self.min_iterations, "min_iterations"), (self.qp_iterations, "qp_iterations")):
            if isinstance(v, bool) or int(v) != v or v < 0:
                raise ValueError(f"{name} must be an integer of at least 0")
        if not self.tolerance >= 0 or self.max_iterations < max(1, self.min_iterations):
            raise ValueError("tolerance must be at least 0 and max_iterations at least 1 and min_iterations")
        if isinstance(self.qp_weight, bool) or not 0 <= self.qp_weight < np.inf:
            raise ValueError("qp_weight must be a finite number of at least 0")
        if self.qp_weight and not self.qp_iterations:
            raise ValueError("a penalty must end: qp_weight needs qp_iterations of at least 1")
        if self.penalty_ref not in ("static", "dynamic"):
            raise ValueError(f"penalty_ref must be static or dynamic, not {self.penalty_ref!r}")

    @property
    def floor(self) -> int:
        """Iterations that every fit makes: those with a penalty, and one without."""
        return max(self.min_iterations, self.qp_iterations + 1 if self.qp_weight else 0)

    def penalise(self, master: Master, iteration: int, priced: np.ndarray | None) -> bool:
        """Puts the penalty of an iteration on its master (``priced``: theta of the iteration before), or takes it off; whether there is one."""
        if not self.qp_weight:
            return False
        if not 1 <= iteration <= self.qp_iterations:
            master.set_penalty(None, 0.0)
            return False
        ref = priced if self.penalty_ref == "dynamic" else np.zeros(master.K) if self.anchor is None else self.anchor
        master.set_penalty(ref, self.qp_weight)
        return True


def tell(config: LoopConfig, event: dict) -> None:
    """Progress goes to the caller's function; a failing one is never the fit's failure, and isn't called again."""
    if config.on_event is not None and not config._silent:
        try:
            config.on_event(event)
        except Exception as e:  # noqa: BLE001
            config._silent.append(e)


class Problem:
    """A model over data, ready to iterate: cached agents, objective coefficients, empirical moment."""

    def __init__(self, model: Model, data: Data, weight: str | None = None):
        self.model, self.data, self.K = model, data, model.parameters.K
        self.oracle = model.native()
        if self.oracle.K != self.K:
            raise ValueError(f"the oracle has {self.oracle.K} parameters, the layout {self.K}")
        self.weight = weight
        agents, self.n = data.agents()
        self.S = data.n_simulations
        self.spark = data.observations.sparkSession
        keep = [c for c in agents.columns if c not in (data.choice, "sim_id")]
        self.agents = agents.select(*keep).persist(StorageLevel.MEMORY_AND_DISK)
        self.observed = data.observations.select("obs_id", self.oracle.observed(data.observations, data.choice).alias("phi"), *([weight] if weight else [])).persist(StorageLevel.MEMORY_AND_DISK)
        self.moment = np.array(moments.empirical_moment(self.observed, self.K).first()["moment"])
        self.c = np.array(moments.objective_coefficients(self.observed, self.K, self.S, weight).first()["c"])

    def close(self) -> None:
        self.agents.unpersist()
        self.observed.unpersist()

    def weights(self) -> Callable[[int], float] | float:
        """Weight of an agent for a master with a slack for each."""
        if self.weight is None:
            return 1.0
        w = {r["obs_id"]: float(r[self.weight]) for r in self.observed.select("obs_id", self.weight).toLocalIterator()}
        return lambda a: w[a % self.n]

    def priced(self, agents: DataFrame, theta: Column) -> DataFrame:
        return self.oracle.priced(agents, theta)

    # One action an iteration.

    def violated(self, agents: DataFrame, theta: np.ndarray, u: dict[int, float], tolerance: float) -> tuple[list, float, Certification]:
        """Cut rows of agents whose reduced cost is above tolerance, the greatest reduced cost, the tally."""
        known = self.spark.createDataFrame(list(u.items()), "agent_id bigint, u double") if u else None
        d = with_key(reduced_cost(self.priced(agents, literal(theta)), known))
        seen = Observation()
        d = d.observe(seen, F.max("rc").alias("worst"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("gap") > 0).alias("inexact"), F.max("gap").alias("gap"))
        rows = d.where(F.col("rc") > tolerance).select("agent_id", "bundle_key", "phi", "epsilon", "rc").collect()
        rows.sort(key=lambda r: (r["agent_id"], bytes(r["bundle_key"])))
        m = seen.get
        return rows, float(m["worst"] or 0.0), Certification(m["n"] or 0, m["inexact"] or 0, float(m["gap"] or 0.0))

    def aggregated(self, theta: np.ndarray, blocks: int) -> tuple[list[CutRow], Certification]:
        """The aggregate cut of each block of agents."""
        block = F.pmod(F.xxhash64("agent_id"), F.lit(blocks)) if blocks > 1 else F.lit(0)
        if isinstance(self.oracle, UserOracle) and self.oracle.oracle.has("features_aggregate"):
            found = self.oracle.aggregate_cut(self.agents.withColumn("block", block), literal(theta), self.weight, ("block",))
        else:
            found = moments.aggregate_cut(self.priced(self.agents, literal(theta)).withColumn("block", block), self.K, self.weight, ("block",))
        rows = sorted(found.collect(), key=lambda r: r["block"])
        cuts = [CutRow(0, int(r["block"]), np.array(r["phi"]), r["epsilon"], aggregate_key(r["phi"], r["epsilon"])) for r in rows]
        tally = Certification(sum(r["n_priced"] for r in rows), sum(r["n_inexact"] for r in rows), max(r["worst_gap"] for r in rows))
        return cuts, tally


def admitted(spark, policy: cx.CutPolicy, rows: list[CutRow], violations: list[float]) -> list[CutRow]:
    if type(policy) is cx.AddAll or not rows:
        return rows
    df = spark.createDataFrame([(i, r.agent_id, bytearray(r.bundle_key), v) for i, (r, v) in enumerate(zip(rows, violations, strict=True))], "pos bigint, agent_id bigint, bundle_key binary, violation double")
    return [rows[r["pos"]] for r in policy.admit(df).select("pos").collect()]


class Retirement:
    """Readings of past solves for a policy that retires."""

    def __init__(self, policy: cx.CutPolicy):
        self.policy, self.log = policy, []
        self.on = bool(policy.needs & {"slack", "dual"})

    def keys(self, spark, master: Master, iteration: int) -> list[tuple[int, bytes]]:
        if not self.on or not master.n_active_cuts:
            return []
        read = master.cut_readings()
        # A cut that is not installed now is forgotten: should it come back, it starts anew.
        self.log = [{k: v for k, v in past.items() if k in read.dual} for past in self.log]
        # Multipliers of a penalised program are no duals of the linear one.
        self.log.append({k: (None if master.penalty else read.dual[k], read.slack[k]) for k in read.dual})
        rows, now = [], self.log[-1]
        deep = self.log if "dual" in self.policy.needs else self.log[-1:]
        for i, past in enumerate(deep):
            rows += [(i, n, a, bytearray(b), d, s if i == len(deep) - 1 else None) for n, ((a, b), (d, s)) in enumerate(past.items()) if (a, b) in now]
        df = spark.createDataFrame(rows, "iteration int, pos bigint, agent_id bigint, bundle_key binary, dual double, slack double")
        return [(r["agent_id"], bytes(r["bundle_key"])) for r in self.policy.retire(df).collect()]


def run_fit(p: Problem, config: LoopConfig, warm_cuts: Iterable[CutRow] = (), master: Master | None = None, u_lower: float | None = 0.0, publish: Publication = Publication.FULL) -> tuple[FitResult, Master]:
    """The loop of a fit; also for a master that is kept over several fits."""
    began, total, trace = time.perf_counter(), Certification(), []
    nslack = p.model.formulation == NSLACK
    if not nslack and not config.schedule.full:
        raise ValueError("aggregate cuts need every agent in every iteration")
    spread = nslack and master is None and not warm_cuts and spreads(config, p, u_lower)
    if spread:
        master = SpreadMaster(p.spark, p.agents, p.n * p.S, p.model.parameters.bounds, p.c, p.weight, u_lower)
    elif master is None:
        master = Master(p.model.parameters.bounds, p.c, p.weights() if nslack else 1.0, u_lower)
    try:
        result = _loop(p, config, warm_cuts, master, u_lower, publish, began, total, trace)
    except BaseException:
        if spread:
            master.close()
        raise
    if spread and result.cut_table is None:
        master.close()
    return result, master


def spreads(config: LoopConfig, p: Problem, u_lower: float | None) -> bool:
    """Whether a fit leaves the cuts of single agents with the executors."""
    plain = type(config.policy) is cx.AddAll and (config.schedule.full or config.schedule.mask(1, 0) is not None)
    return plain and u_lower is not None and u_lower >= 0 and p.n * p.S >= config.spread


def _cut_table(spark, master: Master) -> DataFrame:
    read = master.cut_readings()
    return spark.createDataFrame([(r.agent_id, bytearray(r.bundle_key), r.phi.tolist(), r.epsilon, float(read.dual[r.key]), float(read.slack[r.key])) for r in master.extract_cuts()], TABLE)


def _loop(p: Problem, config: LoopConfig, warm_cuts, master: Master | SpreadMaster, u_lower, publish, began, total, trace) -> FitResult:
    nslack, spread = p.model.formulation == NSLACK, isinstance(master, SpreadMaster)
    if warm_cuts:
        master.reinstall(warm_cuts)
    blocks = p.model.blocks if p.model.formulation == BLOCKSLACK else 1
    config.policy.check_size(p.K, p.n * p.S if nslack else blocks)
    retire, last, force_full, converged = Retirement(config.policy), None, False, False
    tell(config, {"event": "start", "n_agents": p.n * p.S, "K": p.K})
    it, coming = 0, config.penalise(master, 0, None)
    for it in range(config.max_iterations):  # noqa: B007
        floor = config.floor
        if config.callback is not None:
            asked = config.callback(it, p.model.oracle)
            floor = max(floor, asked or 0)
        penalised = coming
        master.solve()
        theta, full = master.theta(), True
        if spread:
            mask = None if config.schedule.full or force_full or penalised else config.schedule.mask(p.n * p.S, it)
            full = mask is None
            worst, tally, new = master.price(p.oracle, theta, config.tolerance, mask)
        elif nslack:
            agents = p.agents
            if not config.schedule.full and not force_full and not penalised:
                duals = None
                if config.schedule.needs_duals and it:
                    found = [(a, pi) for (a, _), pi in master.dual_values().items()]
                    duals = p.spark.createDataFrame(found, "agent_id bigint, pi double")
                past = p.spark.createDataFrame(last, "agent_id bigint, iteration int") if last is not None and config.schedule.needs_duals else None
                agents = config.schedule.select(p.agents, p.n * p.S, it, duals, past)
                full = agents is p.agents
            rows, worst, tally = p.violated(agents, theta, master.u_values(), config.tolerance)
            if config.schedule.needs_duals:
                seen = dict(last or [])
                seen.update({r["agent_id"]: it for r in agents.select("agent_id").toLocalIterator()} if not full or last is None else dict.fromkeys(seen, it))
                last = sorted(seen.items())
            found = [CutRow(0, r["agent_id"], np.array(r["phi"]), r["epsilon"], bytes(r["bundle_key"])) for r in rows]
            admit = admitted(p.spark, config.policy, found, [r["rc"] for r in rows])
        else:
            admit, tally = p.aggregated(theta, blocks)
            u = master.u_values()
            raw = [float(r.phi @ theta) + r.epsilon - u.get(r.agent_id, 0.0) for r in admit]
            first = u_lower is None and not master.n_active_cuts
            worst = max(0.0, sum(raw)) if not first else max(sum(raw), float(np.nextafter(config.tolerance, np.inf)))
            admit = [r for r, v in zip(admit, raw, strict=True) if v > config.tolerance / max(1, blocks) or first]
        total = total.plus(tally)
        hit = worst <= config.tolerance
        done = hit and full and it + 1 >= floor and not penalised
        gone = [] if done or spread else retire.keys(p.spark, master, it)
        if gone:
            master.remove_cuts(gone)
        if not spread:
            new = master.add_cuts(admit)
        coming = config.penalise(master, it + 1, theta)
        trace.append({"iteration": it, "gap": worst, "n_priced": tally.n_priced, "added": new, "retired": len(gone), "n_cuts": master.n_active_cuts, "objective": master.objective(), "penalty": master.penalty})
        tell(config, {"event": "iteration", **trace[-1]})
        force_full = hit and not full
        if done:
            converged = True
            break
        if full and not new and not gone and it + 1 >= floor and not penalised:
            converged = hit
            break
    master.set_penalty(None, 0.0)
    master.solve()
    keep = Publication(publish)
    slack = master.u_values() if nslack and keep & Publication.SLACK else None
    result = FitResult(
        master.theta(), master.objective(), p.moment, converged, it + 1, master.n_active_cuts, p.model.parameters, total, slack,
        master.extract_cuts() if keep & Publication.ACTIVE_SET else None, master.dual_values() if nslack and keep & Publication.DUAL else None, master.bound_duals(), RunInfo.of(p.spark, began), trace,
        (master.table() if spread else _cut_table(p.spark, master)) if keep & Publication.TABLE else None, master.close if spread else None,
    )
    tell(config, {"event": "final", "converged": converged, "iterations": it + 1, "objective": result.objective})
    return result


def estimate(model: Model, data: Data, *, weight: str | None = None, warm_cuts: Iterable[CutRow] = (), u_lower: float | None = 0.0, publish: Publication = Publication.FULL, **controls) -> FitResult:
    """Point estimate. ``weight`` names a column of observations; ``controls`` are those of :class:`LoopConfig`."""
    p = Problem(model, data, weight)
    try:
        return run_fit(p, LoopConfig(**controls), list(warm_cuts), None, u_lower, publish)[0]
    finally:
        p.close()


#: Spark distributes every fit; the name is kept for callers that ask for it.
estimate_distributed = estimate

__all__ = ["AGGREGATE", "BLOCKSLACK", "NSLACK", "ONESLACK", "Data", "LoopConfig", "Model", "Problem", "estimate", "estimate_distributed", "item", "run_fit"]
