"""Every registered query of the panel library vs its DuckDB oracle (sf0.01; blocked windows at sf0.1)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check_oracle  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from tillcast import catalog  # noqa: E402

SF, SF_LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
QUERIES = catalog.queries()
ORACLES = catalog.oracle_sql()
FAST = sorted(n for n in QUERIES if n in ORACLES)
BLOCKED = ["wn3_lag_bank_lineitem", "wn5_sparse_sales_lags", "wn6_promo_flags_sparse", "wn13_refurb_counters_sparse"]


@pytest.fixture(scope="module")
def con():
    return check_oracle.duck(SF)


@pytest.fixture(scope="module")
def con_large():
    return check_oracle.duck(SF_LARGE)


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and set(df.columns) == {"rmspe_all", "rmspe_aug_sep", "n_all", "n_aug_sep"}


def test_registry_covers_oracles():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 140


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    r = check_oracle.compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert r["ok"], r


@pytest.mark.parametrize("name", BLOCKED)
def test_blocked_windows_at_a_size_with_many_tasks(spark, con_large, name):
    r = check_oracle.compare(spark, con_large, name, QUERIES[name], ORACLES[name], SF_LARGE)
    assert r["ok"], r
