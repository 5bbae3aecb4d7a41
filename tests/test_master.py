import numpy as np
import pytest

from choicefold.plans.lp import GrowingLP
from choicefold.plans.master import CutRow, Master


def row(agent, key, phi, eps):
    return CutRow(0, agent, np.array(phi, float), eps, key.encode())


# Agent 7 decides the first parameter, agent 5 the second: -3 x + 2 u7 and 2 y + 3 u5.
SPLIT = [row(7, "low", (0.5, 0), 1.0), row(7, "high", (2, 0), -4.0), row(7, "loose", (1, 0), -2.0), row(5, "down", (0, -1), 1.0), row(5, "up", (0, 0.25), 0.5), row(5, "under", (0, -1), 0.0)]
BOX, COST, WEIGHT = ([-20, -20], [20, 20]), (-3.0, 2.0), {7: 2.0, 5: 3.0}
BEST = -14 / 3 + 2.6


def split():
    m = Master(BOX, COST, WEIGHT)
    m.add_cuts(SPLIT)
    return m


def test_answer_where_cuts_cross():
    m = split()
    assert m.theta() == pytest.approx([10 / 3, 0.4]) and m.objective() == pytest.approx(BEST)
    assert m.u_values() == pytest.approx({7: 8 / 3, 5: 0.6}) and m.bound_duals() == {}
    r = m.cut_readings()
    assert r.dual == pytest.approx({(7, b"low"): 2 / 3, (7, b"high"): 4 / 3, (7, b"loose"): 0, (5, b"down"): 2.2, (5, b"up"): 0.8, (5, b"under"): 0})
    assert r.slack == pytest.approx({(7, b"low"): 0, (7, b"high"): 0, (7, b"loose"): 4 / 3, (5, b"down"): 0, (5, b"up"): 0, (5, b"under"): 1.0}, abs=1e-9)


def test_answer_at_a_bound():
    m = Master(([-1, -5], [1, 5]), (-4.0, 1.0), {3: 1.0})
    m.add_cuts([row(3, "only", (3, -2), 0.5)])
    assert m.theta() == pytest.approx([1, 1.75]) and m.u_values() == pytest.approx({3: 0}, abs=1e-9) and m.bound_duals() == pytest.approx({0: -2.5})


def test_without_cuts_theta_is_a_corner():
    m = Master(([-1, -2], [3, 4]), (1.0, -1.0))
    assert m.theta().tolist() == [-1, 4] and m.u_values() == {} and m.objective() == -5


def test_edits():
    m = split()
    whole = m.objective()
    assert m.add_cuts(SPLIT) == 0 and m.n_active_cuts == 6
    with pytest.raises(KeyError):
        m.set_rhs({(7, b"low"): 0.0, (9, b"none"): 1.0})
    assert m.objective() == whole
    m.set_rhs({(7, b"low"): 5.0})
    fresh = Master(BOX, COST, WEIGHT)
    fresh.add_cuts([row(7, "low", (0.5, 0), 5.0), *SPLIT[1:]])
    assert m.objective() == pytest.approx(fresh.objective(), abs=1e-9) and m.objective() != pytest.approx(whole)
    m.set_rhs({(7, b"low"): 1.0})
    assert m.objective() == pytest.approx(whole, abs=1e-9)
    assert m.remove_cuts([(5, b"under")]) == 1 and m.objective() == pytest.approx(BEST, abs=1e-9)
    assert [r.bundle_key for r in m.extract_cuts()] == [b"down", b"up", b"high", b"loose", b"low"]


@pytest.mark.parametrize("case", range(40))
def test_penalised_optimum_satisfies_its_conditions(case):
    rng = np.random.default_rng(case)
    k, n, rho = int(rng.integers(1, 7)), int(rng.integers(1, 10)), float(rng.choice([1e-3, 0.5, 10]))
    low, high, c, ref = -rng.uniform(0, 3, k), rng.uniform(0, 3, k), rng.normal(size=k) * 3, rng.normal(size=k) * 2
    if case % 5 == 0:
        high[0] = low[0]
    weight = {a: float(rng.uniform(0.1, 2)) for a in range(n)}
    rows = [row(a, str(j), rng.integers(-2, 3, k) if case % 2 else rng.normal(size=k), float(rng.integers(-2, 3))) for a in range(n) for j in range(4)]
    m = Master((low, high), c, weight)
    m.add_cuts(rows)
    m.set_penalty(ref, rho)
    theta, read, bound = m.theta(), m.cut_readings(), m.bound_duals()
    left = c + 2 * rho * (theta - ref) + sum(read.dual[r.key] * r.phi for r in rows)
    assert left == pytest.approx([bound.get(i, 0.0) for i in range(k)], abs=1e-9)
    mass = {a: sum(read.dual[r.key] for r in rows if r.agent_id == a) for a in range(n)}
    for a, u in m.u_values().items():
        assert mass[a] <= weight[a] + 1e-9 and (weight[a] - mass[a]) * u == pytest.approx(0, abs=1e-8)
    assert all(p >= 0 and p * read.slack[key] == pytest.approx(0, abs=1e-8) for key, p in read.dual.items())
    for i, z in bound.items():
        assert low[i] == high[i] or (z > 0 and theta[i] == low[i]) or (z < 0 and theta[i] == high[i])
    m.set_penalty(None, 0.0)
    plain = Master((low, high), c, weight)
    plain.add_cuts(rows)
    assert m.objective() == pytest.approx(plain.objective(), abs=1e-8)


def test_a_penalty_chooses_a_point_of_a_flat_face():
    m = Master(([-4, -4], [4, 4]), (-1.0, 0.0), {0: 1.0})
    m.add_cuts([row(0, "a", (2, 0), -1.0)])
    value = m.objective()
    m.set_penalty([0.5, 3.0], 0.01)
    assert m.theta() == pytest.approx([0.5, 3.0]) and m.objective() == pytest.approx(value)
    for bad in (([0.0], 1.0), ([0.0, np.inf], 1.0), ([0.0, 0.0], np.nan)):
        with pytest.raises(ValueError):
            m.set_penalty(*bad)


def test_a_penalty_without_cuts():
    m = Master(([-1, -2], [3, 4]), (1.0, -1.0))
    m.set_penalty([0.0, 0.0], 0.25)
    assert m.theta() == pytest.approx([-1, 2]) and m.bound_duals() == pytest.approx({0: 0.5})


@pytest.mark.parametrize("seed", range(8))
def test_random_programs_meet_the_conditions(seed):
    rng = np.random.default_rng(seed)
    k, n, c = int(rng.integers(1, 8)), int(rng.integers(1, 120)), 6
    phi, eps = rng.integers(-1, 2, (n * c, k)).astype(float), rng.integers(-50, 51, n * c) / 64
    m = Master((np.full(k, -10.0), np.full(k, 10.0)), -phi[::c].sum(0), lambda a: 1 + a % 3)
    m.add_cuts([CutRow(0, i // c, phi[i], eps[i], bytes([i % c])) for i in range(n * c // 2)])
    m.solve()
    m.add_cuts([CutRow(0, i // c, phi[i], eps[i], bytes([i % c])) for i in range(n * c)])
    pi, b = m.dual_values(), m.bound_duals()
    rows = m.extract_cuts()
    left = m.c + sum(pi[r.key] * r.phi for r in rows)
    assert left == pytest.approx([b.get(i, 0.0) for i in range(k)], abs=1e-9)
    dual = sum(pi[r.key] * r.epsilon for r in rows) + sum(v * (m.lower[i] if v > 0 else m.upper[i]) for i, v in b.items())
    assert dual == pytest.approx(m.objective(), abs=1e-8)
    for a in range(n):
        assert sum(pi[r.key] for r in rows if r.agent_id == a) <= 1 + a % 3 + 1e-9


def test_small_program_by_its_corners():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lp = GrowingLP(rng.normal(size=2), [-1, -1], [1, 1])
        a, b = rng.normal(size=(4, 2)), -rng.uniform(0.1, 0.5, 4)
        lp.add(a, b)
        x = lp.solve()
        lines = [*zip(a, b, strict=True), *[(np.array(g, float), -1.0) for g in ((1, 0), (-1, 0), (0, 1), (0, -1))]]
        best = np.inf
        for i in range(len(lines)):
            for j in range(i):
                g = np.array([lines[i][0], lines[j][0]])
                if abs(np.linalg.det(g)) > 1e-9:
                    p = np.linalg.solve(g, [lines[i][1], lines[j][1]])
                    if all(h @ p >= r - 1e-9 for h, r in lines):
                        best = min(best, lp.c @ p)
        assert lp.c @ x == pytest.approx(best, abs=1e-8)
