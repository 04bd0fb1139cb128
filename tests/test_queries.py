"""Every registered query against its SQL on the smallest tables."""

import pytest

from cohortlens.plans.catalog import ORACLES, QUERIES
from tests.check_oracles import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], SF) is None


@pytest.mark.parametrize("name", ["curve_window", "seed_mean_curve", "best_cutoff_grid"])
def test_positions_that_small_tables_lack(spark, name):
    """Their positions begin at 4,000, beyond the smallest tables."""
    larger = "/root/testdata/sf0.01"
    assert compare(spark, connect(larger), QUERIES[name], ORACLES[name], larger) is None
    assert QUERIES[name](spark, larger).count() > 0


@pytest.mark.parametrize("name", ["cv_gain", "trial_table", "target_comparison", "model_gain_compare"])
def test_model_queries_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    from __spark_entry__ import entry, oracle_sql, queries

    assert entry(spark).count() > 0
    assert set(oracle_sql()) <= set(queries())
