"""Multiplier bootstrap: all live replications of a wave are priced in one plan.

Each iteration explodes agents by the live replications' thetas (at most ``max_live`` literals) and brings back, by replication, either violated cuts
or one aggregate row; every replication has a master of its own and leaves the wave when it converges.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions.bundles import aggregate_key
from ..functions.draws import ExponentialDraws, observation_weights
from ..functions.vectors import literal
from ..operators import moments
from ..operators.pricing import reduced_cost, with_key
from .fit import BLOCKSLACK, NSLACK, Data, LoopConfig, Model, Problem, Retirement, admitted, tell
from .master import CutRow, Master
from .results import BootstrapResult, Certification, FitResult

MAX_LIVE = 64


def bootstrap(model: Model, data: Data, n_bootstrap: int, *, seed: int = 0, source=None, point: FitResult | None = None, warm_cuts=(), max_live: int = MAX_LIVE, keep_fits: bool = False, on_replication: Callable[[int, FitResult], None] | None = None, **controls) -> BootstrapResult:
    """``n_bootstrap`` weighted refits. ``source``: an object with ``weights(n, rep)``; counter-based draws of ``seed`` if there is none.

    ``policy`` admits and retires cuts of every replication on its own; every agent is priced in every iteration, so a
    ``schedule`` that leaves some out is refused. ``on_replication(rep, fit)`` is called as each replication ends.
    """
    if isinstance(n_bootstrap, bool) or n_bootstrap < 1 or max_live < 1:
        raise ValueError("n_bootstrap and max_live must be at least 1")
    config, source = LoopConfig(**controls), source or ExponentialDraws(seed, keyed=True)
    if not config.schedule.full:
        raise ValueError("a bootstrap prices every agent in every iteration")
    p = Problem(model, data)
    thetas, converged, iterations = np.zeros((n_bootstrap, p.K)), np.zeros(n_bootstrap, bool), np.zeros(n_bootstrap, int)
    total, fits = Certification(), []
    try:
        tell(config, {"event": "bootstrap start", "n_bootstrap": n_bootstrap})
        for start in range(0, n_bootstrap, max_live):
            reps = range(start, min(start + max_live, n_bootstrap))
            total = total.plus(_wave(p, config, source, list(reps), list(warm_cuts), thetas, converged, iterations, fits if keep_fits else None, on_replication))
        tell(config, {"event": "bootstrap final", "n_converged": int(converged.sum())})
    finally:
        p.close()
    return BootstrapResult(thetas, converged, model.parameters, None if point is None else point.theta_hat, total, iterations, fits if keep_fits else None)


#: One implementation serves both names: replications always share their plans.
bootstrap_distributed = bootstrap


def _wave(p: Problem, config: LoopConfig, source, reps: list[int], warm: list[CutRow], thetas, converged, iterations, fits, on_replication) -> Certification:
    spark, nslack, total = p.spark, p.model.formulation == NSLACK, Certification()
    blocks = p.model.blocks if p.model.formulation == BLOCKSLACK else 1
    config.policy.check_size(p.K, p.n * p.S if nslack else blocks)
    drawn = {}
    if nslack or not (isinstance(source, ExponentialDraws) and source.keyed):
        drawn = {b: np.asarray(source.weights(p.n, b), float) for b in reps}
        for b, w in drawn.items():
            if w.shape != (p.n,) or not np.isfinite(w).all() or (w < 0).any():
                raise ValueError(f"weights of replication {b} must be {p.n} finite numbers of at least 0")
    # A row per observation with the wave's weights as one vector: joined once, kept for the wave.
    if drawn:
        whole = np.column_stack([drawn[b] for b in reps])
        table = spark.createDataFrame(pa.table({"obs_id": np.arange(p.n), "ws": pa.FixedSizeListArray.from_arrays(whole.ravel(), len(reps)).cast(pa.list_(pa.float64()))}))
    else:  # counter-based draws are made where the observations are
        each = observation_weights(p.observed.select("obs_id"), range(reps[0], reps[-1] + 1), source.seed)
        table = each.groupBy("obs_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rep_id", "w"))), lambda x: x["w"]).alias("ws"))
    at = {b: i for i, b in enumerate(reps)}
    agents = p.agents.join(table, "obs_id").persist()
    w = p.observed.select("obs_id", "phi").join(table, "obs_id").select("obs_id", "phi", F.posexplode("ws").alias("i", "w"))
    c = {reps[r["i"]]: np.array(r["c"]) for r in moments.objective_coefficients(w, p.K, p.S, "w", ("i",)).collect()}
    masters = {b: Master(p.model.parameters.bounds, c[b], (lambda a, b=b: float(drawn[b][a % p.n])) if nslack else 1.0) for b in reps}
    for m in masters.values():
        m.reinstall(CutRow(r.rep_id, r.agent_id, r.phi, r.epsilon, r.bundle_key) for r in warm)
    retire = {b: Retirement(config.policy) for b in reps}
    live, trial = list(reps), {}
    try:
        for it in range(config.max_iterations):
            floor = config.floor
            if config.callback is not None:
                floor = max(floor, config.callback(it, p.model.oracle) or 0)
            penalised = False
            for b in live:
                penalised = config.penalise(masters[b], it, trial.get(b))
                trial[b] = masters[b].theta()
            each = F.explode(F.array(*[F.struct(F.lit(b).alias("rep_id"), literal(trial[b]).alias("theta"), F.lit(at[b]).alias("i")) for b in live]))
            d = p.priced(agents.withColumn("_r", each).select("*", F.col("_r.rep_id").alias("rep_id")), F.col("_r.theta"))
            over_by: dict[int, list[float]] = {b: [] for b in live}
            if nslack:
                u = [(b, a, v) for b in live for a, v in masters[b].u_values().items()]
                if u:
                    known = spark.createDataFrame(u, "rep_id int, agent_id bigint, u double")
                    d = d.join(known, ["rep_id", "agent_id"], "left").withColumn("rc", F.col("payoff") - F.coalesce("u", F.lit(0.0)))
                else:
                    d = reduced_cost(d, None)
                seen = Observation()
                d = with_key(d).observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("gap") > 0).alias("inexact"), F.max("gap").alias("gap"))
                rows = d.where(F.col("rc") > config.tolerance).select("rep_id", "agent_id", "bundle_key", "phi", "epsilon", "rc").collect()
                rows.sort(key=lambda r: (r["rep_id"], r["agent_id"], bytes(r["bundle_key"])))
                found: dict[int, list] = {b: [] for b in live}
                worst = dict.fromkeys(live, 0.0)
                for r in rows:
                    found[r["rep_id"]].append(CutRow(r["rep_id"], r["agent_id"], np.array(r["phi"]), r["epsilon"], bytes(r["bundle_key"])))
                    over_by[r["rep_id"]].append(r["rc"])
                    worst[r["rep_id"]] = max(worst[r["rep_id"]], r["rc"])
                m = seen.get
                total = total.plus(Certification(m["n"] or 0, m["inexact"] or 0, float(m["gap"] or 0.0)))
            else:
                block = F.pmod(F.xxhash64("agent_id"), F.lit(blocks)) if blocks > 1 else F.lit(0)
                d = d.withColumn("_w", F.get("ws", F.col("_r.i"))).withColumn("block", block)
                rows = moments.aggregate_cut(d, p.K, "_w", ("rep_id", "block")).collect()
                rows.sort(key=lambda r: (r["rep_id"], r["block"]))
                found, worst = {b: [] for b in live}, dict.fromkeys(live, 0.0)
                for r in rows:
                    b, t = r["rep_id"], trial[r["rep_id"]]
                    over = float(np.dot(r["phi"], t)) + r["epsilon"] - masters[b].u_values().get(r["block"], 0.0)
                    worst[b] += over
                    if over > config.tolerance / blocks:
                        found[b].append(CutRow(b, r["block"], np.array(r["phi"]), r["epsilon"], aggregate_key(r["phi"], r["epsilon"])))
                        over_by[b].append(over)
                    total = total.plus(Certification(r["n_priced"], r["n_inexact"], r["worst_gap"]))
            for b in list(live):
                hit = worst[b] <= config.tolerance
                may_end = it + 1 >= floor and not penalised
                gone = [] if hit and may_end else retire[b].keys(spark, masters[b], it)
                if gone:
                    masters[b].remove_cuts(gone)
                new = masters[b].add_cuts(admitted(spark, config.policy, found[b], over_by[b]))
                iterations[b] = it + 1
                if may_end and (hit or (not new and not gone)):
                    converged[b] = hit
                    live.remove(b)
                    tell(config, {"event": "bootstrap replication", "rep_id": b, "converged": bool(hit), "iterations": it + 1})
            tell(config, {"event": "bootstrap round", "iteration": it, "live": len(live)})
            if not live:
                break
    finally:
        agents.unpersist()
    for b in reps:
        m = masters[b]
        m.set_penalty(None, 0.0)
        thetas[b] = m.theta()
        if fits is None and on_replication is None:
            continue
        fit = FitResult(m.theta(), m.objective(), p.moment, bool(converged[b]), int(iterations[b]), m.n_active_cuts, p.model.parameters, Certification(), m.u_values() if nslack else None, m.extract_cuts(), m.dual_values() if nslack else None, m.bound_duals())
        if fits is not None:
            fits.append(fit)
        if on_replication is not None:
            on_replication(b, fit)
    return total
