import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from choicefold.functions import bundles, draws
from choicefold.functions.layout import Parameters
from choicefold.operators import agents, reduce
from choicefold.operators.combinatorial import assignment, greedy_demand, quadratic_knapsack, supermodular
from choicefold.sources.dual_store import DualStore, equal
from choicefold.streaming.refit import refit_stream


def test_layout():
    p = Parameters({"a": (-1.0, 1.0, 2), "b": (0.0, 5.0, 1)})
    assert p.K == 3 and p.names == ("a", "b") and p.block("b") == slice(2, 3)
    assert p.pack({"a": [1, 2], "b": 3}).tolist() == [1, 2, 3]
    assert {k: v.tolist() for k, v in p.unpack([1, 2, 3]).items()} == {"a": [1, 2], "b": [3]}
    assert p == Parameters([("a", (-1.0, 1.0, 2)), ("b", (0.0, 5.0, 1))]) and hash(p) == hash(Parameters([("a", (-1.0, 1.0, 2)), ("b", (0.0, 5.0, 1))]))
    import pickle

    assert pickle.loads(pickle.dumps(p)) == p
    for bad in ({"a": (1.0, 0.0, 1)}, {"a": (0.0, 1.0, 0)}, {"a": [0, 1, 1]}):
        with pytest.raises(ValueError):
            Parameters(bad)


def test_bundle_keys(spark):
    sets = [[0.0, 1.0], [1.0, 0.0], [0.0, 2.0], [0.0, 3.0], [0.5, -1.0], [0.5, 1.0], [1e-5, 1e17], [0.1 + 0.2, 0.3], [0.3, 0.3], [2.0, 0.0, 1.0]]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "i int, bundle array<double>").select("i", bundles.sql_key(F.col("bundle")).alias("k")).collect()
    keys = {r["i"]: bytes(r["k"]) for r in rows}
    assert keys[0] == b"01" and len(set(keys.values())) == len(sets)
    assert all(bundles.values(keys[i]).tolist() == s for i, s in enumerate(sets))
    zero = spark.createDataFrame([([-0.0, 1.0],), ([0.0, 1.0],)], "bundle array<double>").select(bundles.sql_key(F.col("bundle"))).distinct().count()
    assert zero == 1
    with pytest.raises(ValueError):
        bundles.values(bundles.aggregate_key([1.0, 2.0], 3.0))


def splitmix(x):
    m = (1 << 64) - 1
    x = (x + 0x9E3779B97F4A7C15) & m
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & m
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & m
    return x ^ (x >> 31)


def test_draws(spark):
    import math

    def one(seed, rep, obs):
        x = draws.NAMESPACE
        for k in (seed, rep, obs):
            x = splitmix(x ^ k)
        return -math.log1p(-((x >> 11) * 2.0**-53))

    got = draws.exponential_draws(9, 4, np.arange(50))
    assert got == pytest.approx([one(9, 4, i) for i in range(50)], rel=1e-15)
    assert draws.keyed_weights(50, 9, 4).sum() == pytest.approx(50) and draws.stream_weights(50, 9, 4).sum() == pytest.approx(50)
    df = draws.observation_weights(spark.range(50).withColumnRenamed("id", "obs_id"), range(2), 9)
    w = {(r["rep_id"], r["obs_id"]): r["w"] for r in df.collect()}
    assert [w[1, i] for i in range(50)] == pytest.approx(draws.keyed_weights(50, 9, 1).tolist())
    with pytest.raises(ValueError):
        draws.exponential_draws(-1, 0, 0)


@pytest.mark.parametrize("n,parts", [(10, 3), (3, 7), (12, 4), (1, 1)])
def test_shards(spark, n, parts):
    bounds = [agents.shard_bounds(n, parts, p) for p in range(parts)]
    assert bounds[0][0] == 0 and bounds[-1][1] == n and all(a[1] == b[0] for a, b in itertools.pairwise(bounds))
    got = {r["id"]: r["o"] for r in spark.range(n).select("id", agents.owner(F.col("id"), n, parts).alias("o")).collect()}
    assert got == {i: p for p, (a, b) in enumerate(bounds) for i in range(a, b)}


def test_canonical_sum_is_the_same_for_any_partitioning(spark):
    v = np.random.default_rng(0).normal(size=500) * 10.0 ** np.random.default_rng(1).integers(-8, 8, 500)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "id bigint, v double")
    found = {reduce.canonical_sum(df.repartition(p), "v", "id", 64).first()[0] for p in (1, 3, 7)}
    assert len(found) == 1
    with pytest.raises(Exception, match="repeat"):
        reduce.canonical_sum(df.union(df), "v", "id").collect()


def test_knapsack():
    rng = np.random.default_rng(0)
    for _ in range(30):
        m = 7
        v, w = rng.normal(0.2, 1, m), rng.uniform(0.5, 1.5, m)
        q = np.triu(rng.uniform(0, 1, (m, m)) * (rng.random((m, m)) < 0.4), 1)
        q, cap = q + q.T, 0.5 * w.sum()
        best = max(v @ b + b @ q @ b / 2 for b in map(np.array, itertools.product((0, 1), repeat=m)) if w @ b <= cap)
        b, got, gap = quadratic_knapsack(v, q, w, cap)
        assert got == pytest.approx(best) and gap == 0 and w @ b <= cap and v @ b + b @ q @ b / 2 == pytest.approx(best)
    assert quadratic_knapsack(v, q, w, cap, most_nodes=1)[2] >= 0


def test_supermodular():
    rng = np.random.default_rng(1)
    for _ in range(30):
        m = 6
        pairs = [(i, j) for i in range(m) for j in range(i) if rng.random() < 0.5]
        rows, cols = (np.array([p[k] for p in pairs], int) for k in (0, 1))
        v, p = rng.normal(-0.5, 1, m), rng.uniform(0, 1, len(pairs))
        best = max(v @ b + sum(x for x, i, j in zip(p, rows, cols, strict=True) if b[i] and b[j]) for b in map(np.array, itertools.product((0, 1), repeat=m)))
        assert supermodular(v, rows, cols, p)[1] == pytest.approx(best, abs=1e-6)


def test_auction_demand():
    rng = np.random.default_rng(2)
    for _ in range(20):
        worth, price = rng.uniform(0, 1, (3, 5)), rng.uniform(0, 0.6, 5)
        brute = max(sum(worth[i, c] for i, c in enumerate(p)) for p in itertools.permutations(range(5), 3))
        assert assignment(worth)[1] == pytest.approx(brute)
        best = max(assignment(worth[:, list(s)])[1] - price[list(s)].sum() if s else 0.0 for k in range(6) for s in itertools.combinations(range(5), k))
        assert greedy_demand(worth, price)[1] == pytest.approx(best)


def test_dual_store(spark, tmp_path):
    s = DualStore(spark, f"file://{tmp_path}/store")
    d = spark.createDataFrame([(0, 0, 0.25), (1, 1, 0.5), (1, 0, 0.125)], "agent_id bigint, bundle_row_id bigint, pi double")
    b = spark.createDataFrame([(0, [1.0, 0.0, 2.0, 0.5]), (1, [0.0, 1.0, 1.0, 0.25])], "bundle_row_id bigint, bundle array<double>")
    c = spark.createDataFrame([(0, -0.5)], "coord int, value double")
    assert s.rep_ids() == []
    s.write(3, d, b, c)
    with pytest.raises(FileExistsError):
        s.write(3, d, b, c)
    got = s.load(3)
    assert s.rep_ids() == [3] and equal(got["duals"], d) and equal(got["bundles"], b) and equal(got["bounds"], c)
    with pytest.raises(KeyError):
        s.load(4)
    s.write(5, d, b.limit(1), c)
    with pytest.raises(ValueError):
        s.load(5)


def test_zeros_of_different_sign_differ(spark):
    a, b = (spark.createDataFrame([(x,)], "v double") for x in (0.0, -0.0))
    assert equal(a, a) and not equal(a, b)


def test_refit_stream(spark, tmp_path):
    from choicefold.operators.pricing import Modular
    from choicefold.plans.fit import Model

    src = str(tmp_path / "in")
    rows = [(i, [1.0 if i % 2 else -1.0], [i / 8 - 0.5 + 1 / 64], [float(i % 3 == 0)]) for i in range(12)]
    schema = "key bigint, r array<double>, nu array<double>, choice array<double>"
    spark.createDataFrame(rows, schema).repartition(1).write.parquet(src)
    found = []
    q = refit_stream(spark.readStream.schema(schema).parquet(src), str(tmp_path / "table"), str(tmp_path / "ck"), Model(Modular(1), Parameters({"t": (-2.0, 2.0, 1)})), "key", lambda e, r: found.append(r.converged))
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert found == [True]


def test_events(spark, capsys):
    import io

    from choicefold.plans.events import EventLog, ProgressTable
    from choicefold.plans.fit import LoopConfig, tell

    log, out = EventLog(), io.StringIO()
    for sink in (log, ProgressTable(out=out)):
        c = LoopConfig(on_event=sink)
        tell(c, {"event": "start", "K": 2})
        tell(c, {"event": "iteration", "iteration": 0, "gap": 1.0, "n_cuts": 3, "objective": 2.0})
    assert [r["event"] for r in log.table(spark).collect()] == ["start", "iteration"] and len(out.getvalue().splitlines()) == 2
    tell(LoopConfig(on_event=lambda e: 1 / 0), {"event": "start"})  # a failing sink fails nothing


def test_shared_arrays(spark):
    from choicefold.sources.tables import shared_arrays

    b = shared_arrays(spark, q=np.eye(3))
    assert b.value["q"].sum() == 3
    with pytest.raises(ValueError):
        shared_arrays(spark, most_bytes=8, q=np.eye(3))


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
