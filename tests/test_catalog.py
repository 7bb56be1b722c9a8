"""Every query with an oracle gives DuckDB's rows; the others run."""

import pytest

from betwixt.plans import catalog

from .util import DATA, same

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()
SLOW = {"study_xi", "model_vote", "network_sage", "network_gcn", "network_epochs"}  # their parts are in test_study and test_networks, the whole in the bench


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_same_as_oracle(spark, name):
    same(QUERIES[name], ORACLES[name], spark)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, name):
    out = QUERIES[name](spark, f"{DATA}/sf0.001")
    assert out.columns and out.count() >= 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
