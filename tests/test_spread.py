"""Fits whose single agents' cuts stay with the executors give what the driver's master gives, without a row an agent on the driver."""

import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from choicefold import queries as q
from choicefold.functions.layout import Parameters
from choicefold.operators import cuts as cx
from choicefold.operators.pricing import Enumerated, Modular
from choicefold.operators.schedules import DualInformed, RoundRobin
from choicefold.plans import fit as plan
from choicefold.plans.fit import NSLACK, Data, LoopConfig, Model, Problem, estimate, spreads
from choicefold.plans.results import Publication
from choicefold.plans.spread import SpreadMaster
from choicefold.sources.tables import written

ALL = 10**12


def observations(spark, sf, m=5):
    o = q._obs(spark, sf).where("obs_id < 60")
    return o.select("obs_id", *[F.slice(c, 1, m).alias(c) for c in ("r", "nu", "choice")], (1 + F.col("obs_id") % 3).cast("double").alias("share"))


@pytest.mark.parametrize("controls", [{}, {"schedule": RoundRobin(3)}, {"weight": "share"}, {"qp_weight": 0.5, "qp_iterations": 2, "penalty_ref": "dynamic"}], ids=["plain", "slices", "weights", "penalty"])
def test_same_fit_without_agents_on_the_driver(spark, sf, controls, monkeypatch):
    model, data = Model(Modular(3), Parameters({"taste": (-10.0, 10.0, 3)}), NSLACK), Data(observations(spark, sf, 3))
    near = estimate(model, data, tolerance=1e-8, publish=0, spread=ALL, **controls)

    def fail(*_):
        raise AssertionError("a row an agent came to the driver")

    monkeypatch.setattr(Problem, "violated", fail)
    monkeypatch.setattr(Problem, "weights", fail)
    far = estimate(model, data, tolerance=1e-8, publish=0, spread=0, **controls)
    assert far.converged and near.converged
    assert far.objective == pytest.approx(near.objective, abs=1e-9)
    assert far.n_active_cuts > 0 and far.slack is None and far.cuts is None


@pytest.mark.parametrize("spread", [0, ALL])
def test_table_of_cuts_is_dual_feasible(spark, sf, spread):
    o = observations(spark, sf, 2).select("obs_id", F.col("r").alias("x"), "nu", "choice")
    model = Model(Enumerated(2), Parameters({"price": (-10.0, 10.0, 1), "item": (-10.0, 10.0, 2)}), NSLACK)
    r = estimate(model, Data(o), tolerance=1e-8, publish=Publication.TABLE, spread=spread)
    rows = r.cut_table.collect()
    r.close()
    assert len(rows) == r.n_active_cuts == len({(x["agent_id"], bytes(x["bundle_key"])) for x in rows})
    p = Problem(model, Data(o))
    left = p.c + sum(x["pi"] * np.array(x["phi"]) for x in rows) - np.array([r.bound_duals.get(k, 0.0) for k in range(3)])
    p.close()
    assert np.abs(left).max() < 1e-8
    mass = {}
    for x in rows:
        mass[x["agent_id"]] = mass.get(x["agent_id"], 0.0) + x["pi"]
        assert x["pi"] >= 0 and x["pi"] * x["slack"] < 1e-8
    assert max(mass.values()) < 1 + 1e-9


def test_published_parts_are_those_of_the_cuts(spark, sf):
    model, data = Model(Modular(2), Parameters({"taste": (-10.0, 10.0, 2)}), NSLACK), Data(observations(spark, sf, 2))
    far = estimate(model, data, tolerance=1e-8, spread=0)
    assert len(far.cuts) == far.n_active_cuts and set(far.cut_duals) == {c.key for c in far.cuts}
    for a, u in far.slack.items():
        assert u == pytest.approx(max(0.0, max(c.phi @ far.theta_hat + c.epsilon for c in far.cuts if c.agent_id == a)))


def test_what_keeps_cuts_on_the_driver(spark, sf):
    p = Problem(Model(Modular(2), Parameters({"taste": (-10.0, 10.0, 2)}), NSLACK), Data(observations(spark, sf, 2)))
    assert spreads(LoopConfig(spread=0), p, 0.0) and spreads(LoopConfig(spread=0, schedule=RoundRobin(2)), p, 0.0)
    assert not spreads(LoopConfig(spread=0), p, None) and not spreads(LoopConfig(), p, 0.0)
    assert not spreads(LoopConfig(spread=0, schedule=DualInformed()), p, 0.0)
    assert not spreads(LoopConfig(spread=0, policy=cx.MostViolatedK(5) if hasattr(cx, "MostViolatedK") else object()), p, 0.0)
    with pytest.raises(ValueError, match="lower bound"):
        SpreadMaster(spark, p.agents, p.n, p.model.parameters.bounds, p.c, None, -1.0)
    p.close()
    assert plan.TABLE.startswith("agent_id")


def test_master_of_heavy_agents_solves():
    """Rows of millions beside ones: the program's matrix was singular at 900,000 agents."""
    from choicefold.plans.master import CutRow, Master

    rng = np.random.default_rng(0)
    n, heavy = 400, 60_000.0
    r, nu = rng.choice([-1.0, 1.0], (n, 5)), rng.integers(-50, 51, (n, 5)) / 128 + 1 / 1024
    b = (r * [0.25, -0.125, 0.1875, -0.25, 0.0625] + rng.integers(-51, 52, (n, 5)) / 128 > 0).astype(float)
    light = [Master((np.full(5, -10.0), np.full(5, 10.0)), -w * (b * r).sum(0), w) for w in (1.0, heavy)]
    for _ in range(30):
        got = [m.theta() for m in light]
        for m, theta in zip(light, got, strict=True):
            take = (r * theta + nu > 0).astype(float)
            m.add_cuts([CutRow(0, i, take[i] * r[i], float(take[i] @ nu[i]), take[i].tobytes()) for i in range(n)])
    assert light[1].objective() / heavy == pytest.approx(light[0].objective(), abs=1e-9)
    assert light[1]._unit > light[0]._unit >= 1


def test_a_step_leaves_the_driver_as_it_was(spark, sf):
    """What passes left on the driver is freed with each step, and the driver makes no file of its own."""
    model, data = Model(Modular(3), Parameters({"taste": (-10.0, 10.0, 3)}), NSLACK), Data(observations(spark, sf, 3))
    p = Problem(model, data)
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    collected = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    m = SpreadMaster(spark, p.agents, p.n, model.parameters.bounds, p.c, None)
    before = collected()
    _, _, added = m.price(p.oracle, m.theta(), 1e-8, None)
    assert added > 0 and collected() > before
    assert {x.suffix for x in Path(m.path.removeprefix("file:")).iterdir() if not x.name.startswith(".")} == {".parquet"}
    m.close()
    p.close()


def test_folders_of_steps_are_made_without_child_processes(spark, tmp_path):
    """Hadoop's own folders get 0755 by ``chmod``, whatever the driver's umask; these keep it."""
    before = os.umask(0o077)
    try:
        written(spark.range(7), f"file://{tmp_path}/a b/made")
    finally:
        os.umask(before)
    made = tmp_path / "a b" / "made"
    assert made.stat().st_mode & 0o777 == 0o700
    assert spark.read.parquet(f"file://{made}").count() == 7
    assert not list(made.glob("_*"))
