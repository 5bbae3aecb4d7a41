import numpy as np
import pytest
from pyspark.sql import functions as F

from choicefold.functions.draws import ExponentialDraws, ReplayedWeights
from choicefold.functions.layout import Parameters
from choicefold.operators import cuts, schedules
from choicefold.operators.pricing import Demand, Enumerated, Modular, Oracle
from choicefold.plans.bootstrap import bootstrap
from choicefold.plans.callbacks import Phase, TimeoutSchedule, bootstrap_timeout_callback, point_timeout_callback
from choicefold.plans.fit import BLOCKSLACK, NSLACK, ONESLACK, Data, Model, Problem, estimate
from choicefold.plans.persistent import PersistentFit
from choicefold.plans.results import BootstrapResult, Certification
from choicefold.sources.tables import from_arrays

BOX = Parameters({"taste": (-10.0, 10.0, 4)})


def toy(spark, n=14, m=4, seed=7):
    rng = np.random.default_rng(seed)
    r = rng.choice([-1.0, 1.0], (n, m))
    nu, other = rng.normal(size=(n, m)), rng.normal(size=(n, m))
    true = rng.choice([-1, 1], m) * rng.uniform(0.5, 2, m)
    choice = (r * true + other > 0).astype(float)
    obs, _ = from_arrays(spark, choice, r=r, nu=nu)
    value = 0.0
    for k in range(m):
        points = np.concatenate([-nu[:, k] / r[:, k], [-10, 10]])
        value += min(np.maximum(0, r[:, k] * t + nu[:, k]).sum() - t * (r[:, k] * choice[:, k]).sum() for t in points[np.abs(points) <= 10])
    return Data(obs), value


@pytest.mark.parametrize("form", [NSLACK, ONESLACK, BLOCKSLACK])
def test_closed_form(spark, form):
    data, value = toy(spark)
    r = estimate(Model(Modular(4), BOX, form, blocks=4), data, tolerance=1e-8, max_iterations=500)
    assert r.converged and r.objective == pytest.approx(value, abs=1e-6)
    assert r.certification.n_inexact == 0 and r.certification.n_priced == 14 * r.iterations
    assert r.to_df(spark).first()["converged"] and set(r.theta_named) == {"taste"} and r.to_json()


def test_warm_start_needs_one_or_two_sweeps(spark):
    data, value = toy(spark)
    cold = estimate(Model(Modular(4), BOX), data, tolerance=1e-8)
    warm = estimate(Model(Modular(4), BOX), data, tolerance=1e-8, warm_cuts=cold.cuts)
    assert warm.iterations <= 2 < cold.iterations and warm.objective == pytest.approx(cold.objective, abs=1e-9)


@pytest.mark.parametrize("controls", [{"schedule": schedules.RoundRobin(3)}, {"schedule": schedules.DualInformed(0.9, 3)}, {"policy": cuts.SlackStrip(95.0, 60)}, {"policy": cuts.PurgeInactive(3)}, {"policy": cuts.MostViolated(k=6)}])
def test_policies_keep_the_estimate(spark, controls):
    data, value = toy(spark)
    r = estimate(Model(Modular(4), BOX), data, tolerance=1e-7, max_iterations=200, **controls)
    assert r.converged and r.objective == pytest.approx(value, abs=1e-5)


class Scalar(Oracle):
    check = True

    def price(self, theta, row):
        v = row["r"] * theta + row["nu"]
        b = (v > 0).astype(float)
        return Demand.exact(b, float(np.maximum(v, 0).sum()))

    def features(self, row, bundle):
        return bundle * row["r"], float(bundle @ row["nu"])


class Both(Scalar):
    def price_batch(self, theta, rows):
        return {int(r["agent_id"]): self.price(theta, r) for r in rows.to_dict("records")}


class Wrong(Scalar):
    def price_batch(self, theta, rows):
        return {int(a): Demand.exact(np.zeros(4), 0.0) for a in rows["agent_id"]}


def test_user_oracles(spark):
    data, value = toy(spark)
    for oracle in (Scalar(), Both()):
        r = estimate(Model(oracle, BOX), data, tolerance=1e-8)
        assert r.objective == pytest.approx(value, abs=1e-7)
    with pytest.raises(Exception, match="differ for agent"):
        estimate(Model(Wrong(), BOX), data)


def test_partitioning_changes_nothing(spark):
    data, _ = toy(spark)
    found = [estimate(Model(Modular(4), BOX), Data(data.observations.repartition(p)), tolerance=1e-8).objective for p in (1, 2, 3, 7)]
    assert max(found) - min(found) < 1e-9


def test_simulations(spark):
    rng = np.random.default_rng(1)
    x, nu = rng.uniform(0, 2, (10, 3)), rng.normal(size=(10, 2, 3))
    choice = rng.integers(0, 2, (10, 3))
    obs, shocks = from_arrays(spark, choice, nu, x=x)
    model = Model(Enumerated(3), Parameters({"a": (-5.0, 5.0, 1), "b": (-5.0, 5.0, 3)}))
    r = estimate(model, Data(obs, shocks, 2), tolerance=1e-8)
    one = estimate(Model(model.oracle, model.parameters, ONESLACK), Data(obs, shocks, 2), tolerance=1e-8)
    assert r.converged and r.objective == pytest.approx(one.objective, abs=1e-6)
    assert r.empirical_moment == pytest.approx(np.column_stack([(x * choice).sum(1), choice]).mean(0))


def test_bootstrap(spark):
    data, _ = toy(spark)
    a = bootstrap(Model(Modular(4), BOX), data, 4, seed=2, tolerance=1e-8, max_live=3, keep_fits=True)
    b = bootstrap(Model(Modular(4), BOX, BLOCKSLACK, 4), data, 4, seed=2, tolerance=1e-8, keep_fits=True)
    assert a.converged.all() and [f.objective for f in a.fits] == pytest.approx([f.objective for f in b.fits], abs=1e-5)
    w = np.array([ExponentialDraws(2, keyed=True).weights(14, i) for i in range(4)])
    c = bootstrap(Model(Modular(4), BOX), data, 4, source=ReplayedWeights(w), tolerance=1e-8)
    assert np.allclose(a.thetas, c.thetas)
    whole = BootstrapResult.concat([a, a])
    assert len(whole.thetas) == 8 and whole.certification.n_priced == 2 * a.certification.n_priced
    assert a.se() == pytest.approx(a.thetas.std(0, ddof=1)) and a.cov().shape == (4, 4)
    lo, hi = a.ci(0.9)
    assert (lo <= hi).all()
    ones = bootstrap(Model(Modular(4), BOX), data, 1, source=ReplayedWeights(np.ones((1, 14))), tolerance=1e-8, keep_fits=True)
    assert ones.fits[0].objective == pytest.approx(estimate(Model(Modular(4), BOX), data, tolerance=1e-8).objective, abs=1e-8)


def test_persistent_refit_equals_a_new_fit(spark):
    data, _ = toy(spark)
    rows = {r["obs_id"]: np.array(r["nu"]) for r in data.observations.collect()}
    from pyspark.sql import functions as F

    def at(scale):
        return Data(data.observations.withColumn("nu", F.transform("nu", lambda v: v * scale)))

    def rhs(row, scale):
        bundle = np.array([int(c) for c in row.bundle_key.decode()], float)
        return float(bundle @ rows[row.agent_id]) * scale

    p = PersistentFit(Model(Modular(4), BOX), at, rhs, geometry=lambda scale: np.array([4, scale > 0]), tolerance=1e-8)
    p.fit(1.0)
    for refit in (p.fit, p.reevaluate):
        with pytest.raises(ValueError, match="geometry"):
            refit(-1.0)
    again = p.fit(0.5)
    assert again.objective == pytest.approx(estimate(Model(Modular(4), BOX), at(0.5), tolerance=1e-8).objective, abs=1e-8)
    assert p.reevaluate(0.5) == pytest.approx(again.objective, abs=1e-8)
    with pytest.raises(ValueError):
        PersistentFit(Model(Modular(4), BOX, ONESLACK), at, rhs)


def test_controls_are_checked(spark):
    data, _ = toy(spark)
    for bad in ({"max_iterations": 0}, {"tolerance": -1.0}, {"min_iterations": True}, {"qp_weight": 1.0}, {"qp_weight": np.inf, "qp_iterations": 2}, {"qp_weight": 1.0, "qp_iterations": 2, "penalty_ref": "none"}):
        with pytest.raises(ValueError):
            estimate(Model(Modular(4), BOX), data, **bad)
    with pytest.raises(ValueError):
        estimate(Model(Modular(4), BOX, ONESLACK), data, schedule=schedules.RoundRobin(2))


def test_callbacks():
    s = TimeoutSchedule([Phase(1.0, 2), Phase(2.0, 3, retire=True), Phase(9.0)])
    told = []

    class Configurable:
        def apply_solver_settings(self, v):
            told.append((v.time_limit_seconds, v.mip_focus))

    point, boot = point_timeout_callback(s), bootstrap_timeout_callback(s)
    assert [point(i, Configurable()) for i in range(6)] == [2, 2, 0, 0, 0, None]
    assert told == [(1.0, 1), (1.0, 0), (2.0, 0), (2.0, 0), (2.0, 0), (9.0, 0)]
    assert [boot(i, None) for i in (0, 2, 7)] == [2, 0, 10**9]
    with pytest.raises(ValueError):
        TimeoutSchedule([Phase(1.0, 2)])


def test_certification_rules():
    assert Certification(3, 1, float("inf")).to_dict() == {"n_priced": 3, "n_inexact": 1, "worst_gap": None, "worst_gap_unknown": True}
    with pytest.raises(ValueError):
        Certification(1, 2, 0.5)


class Quantity(Oracle):
    """A quantity of 0 to 3 of one good: value theta x q - q^2 / 2 + nu q."""

    def price(self, theta, row):
        worth = [theta[0] * row["x"] * q - q * q / 2 + row["shock"] * q for q in range(4)]
        q = int(np.argmax(worth))
        return Demand.exact(np.array([float(q)]), worth[q])

    def features(self, row, bundle):
        return np.array([row["x"] * bundle[0]]), float(-bundle[0] ** 2 / 2 + row["shock"] * bundle[0])


def quantities(spark):
    rng = np.random.default_rng(5)
    x, shock = rng.uniform(0.5, 1.5, 30), rng.normal(0, 0.7, 30)
    q = np.array([np.argmax([1.5 * x[i] * k - k * k / 2 + shock[i] * k for k in range(4)]) for i in range(30)])
    rows = [(i, float(x[i]), float(rng.normal(0, 0.7)), [float(q[i])]) for i in range(30)]
    return Data(spark.createDataFrame(rows, "obs_id bigint, x double, shock double, choice array<double>")), rows


def test_bundles_that_are_not_zeros_and_ones(spark):
    data, rows = quantities(spark)

    def objective(t):
        return sum(max(t * x * k - k * k / 2 + s * k for k in range(4)) - t * x * c[0] for _, x, s, c in rows)

    # Piecewise linear and convex: the least value is at a kink, where a quantity and the next are worth the same.
    kinks = [(k + 0.5 - s) / x for _, x, s, _ in rows for k in range(3)]
    best = min(objective(t) for t in [-5.0, 5.0, *[k for k in kinks if abs(k) < 5]])
    box = Parameters({"taste": (-5.0, 5.0, 1)})
    for form in (NSLACK, ONESLACK, BLOCKSLACK):
        f = estimate(Model(Quantity(), box, form), data, tolerance=1e-8, u_lower=None if form != NSLACK else 0.0)
        assert f.converged and f.objective == pytest.approx(best, abs=1e-5), form


def test_bootstrap_controls(spark):
    data, _ = toy(spark)
    asked, told = [], []

    class Counting(cuts.MostViolated):
        def admit(self, candidates):
            asked.append(1)
            return super().admit(candidates)

    a = bootstrap(Model(Modular(4), BOX), data, 2, seed=2, tolerance=1e-8, policy=Counting(k=6), keep_fits=True, on_replication=lambda b, f: told.append((b, f.objective)))
    b = bootstrap(Model(Modular(4), BOX), data, 2, seed=2, tolerance=1e-8, keep_fits=True)
    assert asked and [f.objective for f in a.fits] == pytest.approx([f.objective for f in b.fits], abs=1e-6)
    assert told == [(i, f.objective) for i, f in enumerate(a.fits)]
    with pytest.raises(ValueError):
        bootstrap(Model(Modular(4), BOX), data, 2, schedule=schedules.RoundRobin(2))
    with pytest.raises(ValueError):
        bootstrap(Model(Modular(4), BOX), data, 2, policy=cuts.SlackStrip(50.0, 3))


def test_retirement_reaches_block_cuts(spark):
    data, _ = toy(spark)
    plain = estimate(Model(Modular(4), BOX, BLOCKSLACK, 4), data, tolerance=1e-8)
    f = estimate(Model(Modular(4), BOX, BLOCKSLACK, 4), data, tolerance=1e-8, policy=cuts.SlackStrip(99.0, 12), max_iterations=60)
    assert max(t["retired"] for t in f.trace) > 0 and f.n_active_cuts < plain.n_active_cuts
    with pytest.raises(ValueError):
        estimate(Model(Modular(4), BOX, BLOCKSLACK, 4), data, policy=cuts.SlackStrip(99.0, 7))


def test_a_failing_sink_is_called_once(spark):
    data, _ = toy(spark)
    calls = []

    def sink(event):
        calls.append(event)
        raise RuntimeError("no")

    assert estimate(Model(Modular(4), BOX), data, tolerance=1e-8, on_event=sink).converged and len(calls) == 1


def test_summaries_need_replications():
    r = BootstrapResult(np.zeros((2, 1)), np.array([True, False]), Parameters({"a": (0.0, 1.0, 1)}))
    with pytest.warns(UserWarning), pytest.raises(ValueError):
        r.se()
    with pytest.warns(UserWarning):
        assert r.mean().tolist() == [0.0]


@pytest.mark.parametrize("form,ref", [(NSLACK, "static"), (ONESLACK, "static"), (BLOCKSLACK, "dynamic")])
def test_a_penalty_ends_before_the_fit_does(spark, form, ref):
    data, value = toy(spark)
    ask = {"tolerance": 1e-8, "max_iterations": 500, "qp_weight": 0.7, "qp_iterations": 4, "penalty_ref": ref}
    r = estimate(Model(Modular(4), BOX, form, blocks=4), data, **ask)
    assert r.converged and r.objective == pytest.approx(value, abs=1e-6) and r.iterations >= 5
    assert [t["penalty"] for t in r.trace[:5]] == [0.7] * 4 + [0.0] and not any(t["penalty"] for t in r.trace[5:])
    again = estimate(Model(Modular(4), BOX, form, blocks=4), data, **ask) if form == BLOCKSLACK else r
    assert again.theta_hat.tobytes() == r.theta_hat.tobytes() and again.objective == r.objective


def test_a_fit_stopped_under_a_penalty_publishes_the_linear_program(spark):
    data, _ = toy(spark)
    r = estimate(Model(Modular(4), BOX, BLOCKSLACK, 4), data, tolerance=1e-8, max_iterations=2, qp_weight=5.0, qp_iterations=50)
    assert not r.converged and r.objective <= estimate(Model(Modular(4), BOX), data, tolerance=1e-8).objective + 1e-9


def test_retirement_reads_no_duals_of_a_penalised_program(spark):
    data, value = toy(spark)
    r = estimate(Model(Modular(4), BOX), data, tolerance=1e-7, max_iterations=200, policy=cuts.PurgeInactive(1), qp_weight=0.5, qp_iterations=3)
    assert r.converged and r.objective == pytest.approx(value, abs=1e-5) and [t["retired"] for t in r.trace[1:4]] == [0, 0, 0]


def test_penalised_replications_reach_the_same_objectives(spark):
    data, _ = toy(spark)
    plain = bootstrap(Model(Modular(4), BOX, BLOCKSLACK, 4), data, 3, seed=2, tolerance=1e-8, keep_fits=True)
    b = bootstrap(Model(Modular(4), BOX, BLOCKSLACK, 4), data, 3, seed=2, tolerance=1e-8, keep_fits=True, qp_weight=0.5, qp_iterations=3, penalty_ref="dynamic")
    assert b.converged.all() and [f.objective for f in b.fits] == pytest.approx([f.objective for f in plain.fits], abs=1e-6)


class Summed(Scalar):
    def features_aggregate(self, rows, sets, weights):
        b = np.array(sets)
        return weights @ (b * np.stack(rows["r"])), float(weights @ (b * np.stack(rows["nu"])).sum(1))


class WronglySummed(Summed):
    def features_aggregate(self, rows, sets, weights):
        phi, eps = super().features_aggregate(rows, sets, weights)
        return phi * 2 + 1, eps


def test_aggregate_features_make_the_same_cuts(spark):
    data, _ = toy(spark)
    heavy = Data(data.observations.withColumn("w", F.col("obs_id") % 3 + 0.5))
    rows = []
    for oracle in (Scalar(), Summed()):
        for weight in (None, "w"):
            p = Problem(Model(oracle, BOX, BLOCKSLACK, 3), heavy, weight)
            cuts_, tally = p.aggregated(np.array([0.3, -0.2, 0.1, 0.4]), 3)
            rows.append((np.array([[*c.phi, c.epsilon, c.agent_id] for c in cuts_]), tally))
            p.close()
    for (a, x), (b, y) in zip(rows[:2], rows[2:], strict=True):
        assert a == pytest.approx(b, abs=1e-12) and x == y and x.n_priced == 14
    p = Problem(Model(WronglySummed(), BOX, ONESLACK), data)
    with pytest.raises(Exception, match="features_aggregate differs"):
        p.aggregated(np.zeros(4), 1)
    p.close()
