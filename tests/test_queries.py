"""Every query against its SQL, and properties of those without."""

import pytest

from oracle import connect, duck_rows, spark_rows
from terralens.plans.oracles import SQL
from terralens.plans.queries import QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(D)


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    cols, rows = spark_rows(QUERIES[name](spark, D))
    want_cols, want = duck_rows(con, SQL[name])
    assert cols == want_cols
    assert len(rows) == len(want) and rows == want


def test_model_queries(spark):
    rows = QUERIES["model_train_predict"](spark, D).collect()
    assert rows and all(0 <= r.confianza <= 1 and r.riesgo_pred in ("Bajo", "Medio", "Alto", "Crítico") for r in rows)
    imp = QUERIES["model_importances"](spark, D).collect()
    assert len(imp) == 15 and all(r.importance >= 0 for r in imp)


def test_anomaly_queries(spark):
    rows = QUERIES["isolation_forest"](spark, D).collect()
    assert all(0 <= r.score_anomalia <= 1 for r in rows)
    n = sum(r.es_anomalia for r in rows)
    assert 0 < n <= 0.06 * len(rows)
    c = QUERIES["anomaly_cross"](spark, D).first()
    assert c.anomalias == n == c.en_nivel_alto + c.no_priorizadas


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 15
    assert set(e.oracle_sql()) <= set(e.queries())
