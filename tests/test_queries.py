import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from check_oracles import compare, connect  # noqa: E402

import __spark_entry__ as entry_module  # noqa: E402
from marketgrid import catalogue  # noqa: E402
from oracles import all_oracles  # noqa: E402

SF = "/root/testdata/sf0.001"
# every registered query is compared at sf0.01 by check_oracles.py; these keep the suite short
NAMES = [
    "q01_deposits_by_county_year", "q02_market_share_by_county_year", "q03_branch_deposit_cagr",
    "q04_rank_branches_in_market", "q05_market_vs_branch_attribution", "q06_branch_percentile_in_county",
    "q08_branch_performance_index", "q09_tract_lending_outcomes", "q11_unmet_demand_ranking",
    "q12_market_opportunity_index", "q13_lmi_coverage", "q14_reconciliation", "a14_deposit_distribution",
    "a21_staged_lending", "d03_tie_break_sensitivity", "d06_county_growth", "d11_leave_one_out", "d19_branch_drift",
    "g06_household_growth", "j17_crosswalk", "j18_point_in_polygon", "j28_miles_to_outline", "x05_transitions",
    "gate07_references", "m07_deposit_trend",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_against_oracle(spark, con, name):
    _, _, verdict = compare(spark, con, entry_module.queries()[name], entry_module.oracle_sql()[name], SF)
    assert verdict == "ok"


def test_registered_names():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(catalogue.queries()) == set(all_oracles())


def test_entry(spark):
    df = entry_module.entry(spark)
    assert "deposit_share_pct" in df.columns and df.count() > 0
