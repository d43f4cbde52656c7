"""Plan checks: per-row work stays in the JVM, filters and projections reach the scan, and no
window runs unpartitioned over observations."""

import pytest

import __spark_entry__ as E

from .conftest import SF_SMALL

ROW_QUERIES = ["scan_obs", "scalar_features", "features_ext16", "features_optimized10", "standardize",
               "metrics_by_class", "class_by_site_mean", "zone_counts", "residuals"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ROW_QUERIES)
def test_no_python_in_row_queries(spark, name):
    p = _plan(E.queries()[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p


def test_scan_is_pruned_and_filtered(spark):
    from calibra.operators.classes import complete_cases
    from calibra.sources.observations import driver_obs
    df = complete_cases(driver_obs(spark, SF_SMALL)).select("site", "y")
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "l_returnflag" not in p and "l_linestatus" not in p      # unused columns never read
    assert "PushedFilters: [IsNotNull" in p


def test_windows_over_rows_are_partitioned(spark):
    # windows that touch observation-derived rows are partitioned (stratum, bucket, approach); the
    # only unpartitioned ones run over result tables of a few rows (model ranking)
    import re
    from calibra.operators.classes import complete_cases
    from calibra.operators.splits import stratified_holdout
    from calibra.sources.observations import driver_obs
    split = stratified_holdout(complete_cases(driver_obs(spark, SF_SMALL)), "site")  # the query stores its result
    for name, df in [("split", split), ("importance_rank", E.queries()["importance_rank"](spark, SF_SMALL))]:
        p = _plan(df)
        specs = re.findall(r"Window \[.*?\], \[(.*?)\], \[", p)
        assert specs and all(s.strip() for s in specs), (name, specs)


def test_linear_solve_is_python_on_statistics_only(spark):
    # the linear family solves in pandas over one row of O(p^2) statistics per split, not over rows
    p = _plan(E.queries()["linear_holdout"](spark, SF_SMALL))
    assert "MapInPandas" in p and "ArrowEvalPython" not in p and "FlatMapGroupsInPandas" not in p
