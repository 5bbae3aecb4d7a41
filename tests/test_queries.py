"""Every query of the engine against its SQL, on the small tables."""

import duckdb
import pytest

from choicefold import queries as q

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES.split():
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def value(v):
        if isinstance(v, (list, tuple)):
            return tuple(map(value, v))
        if type(v).__name__ == "Decimal":
            v = float(v)
        return 0.0 if v == 0 and isinstance(v, float) else v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, con, name):
    df = q.QUERIES[name](spark, SF)
    rows = plain([tuple(r) for r in df.collect()], df.columns)
    assert rows
    if name in q.SQL:
        c = con.execute(q.SQL[name])
        cols = [x[0] for x in c.description]
        assert sorted(cols) == sorted(df.columns)
        assert rows == plain(c.fetchall(), cols)


def test_conditions_of_optimality(spark):
    row = q.QUERIES["fit_enumerated_kkt"](spark, SF).first()
    assert row["converged"] and row["stationarity"] == 0 and row["mass_over"] == 0


def test_flagship_value(spark):
    """A value known from the closed form."""
    assert q.QUERIES["fit_modular_objective"](spark, SF).first()["objective"] == pytest.approx(58.7607421875, abs=1e-6)
