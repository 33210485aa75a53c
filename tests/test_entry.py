"""Driver contract and a sample of Spark-vs-DuckDB checks on the smallest tables."""
import pytest

import __spark_entry__ as E
from oracle_compare import compare, duck
from conftest import SF_SMALL


def test_registry_and_oracles_consistent():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    own = {k for k in q if not k.startswith("op") and k != "pipeline"}  # corpus operators have their own tests
    assert {k for k in own if k not in s} == {k for k in own if k.endswith("_ml")}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "fpr_range_psi" in df.columns


@pytest.mark.parametrize("name", ["run_log", "feature_table", "lhs_rejection", "validate_dataset",
                                  "correlation_matrix", "median_by_step", "section_scan", "apply_scenario"])
def test_oracle_matches(spark, name):
    ok, msg = compare(E.queries()[name](spark, SF_SMALL), duck(SF_SMALL), E.oracle_sql()[name])
    assert ok, msg
