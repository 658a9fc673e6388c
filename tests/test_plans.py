"""Physical-plan properties of the registered queries (what a 100 TB run relies on)."""

import datetime

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tickwise.operators import requests as rq

QUERIES = E.queries()


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _pure_names():
    """Queries that do not write files when built (those are checked by the oracle tests)."""
    from tickwise.plans import queries as Q
    return sorted(n for n, fn in Q.QUERIES.items() if fn.__module__ == Q.__name__)


@pytest.mark.parametrize("name", _pure_names())
def test_no_python_rows_no_pair_joins(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert "BatchEvalPython" not in plan, name
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, name


def test_topk_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in _plan(QUERIES["top_performers"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in _plan(QUERIES["most_traded"](spark, SF_SMALL))


def test_knn_uses_partial_window_group_limit(spark):
    assert "WindowGroupLimit" in _plan(QUERIES["similarity_search"](spark, SF_SMALL))


def test_date_range_and_columns_reach_the_scan(spark, tmp_dir):
    from tickwise.plans import views as V
    V.prices(spark, SF_SMALL).write.parquet(f"{tmp_dir}/prices")
    landed = spark.read.parquet(f"{tmp_dir}/prices")
    universe = spark.createDataFrame([("C1-US",)], "TICKER string")
    start, end = rq.last_month_bounds(datetime.date(2024, 2, 15))
    out = rq.data_request(landed, universe, ["PX_LAST"], date_col="DATE", start=start, end=end)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(DATE,2024-01-01)" in plan and "LessThanOrEqual(DATE,2024-02-01)" in plan
    # (the scan is found by its columns: plan text abbreviates long locations)
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line and "DATE#" in line][0]
    assert "PX_OPEN" not in scan and "PX_LAST" in scan


def test_exposure_weights_use_a_scalar_subquery_not_a_window(spark):
    plan = _plan(QUERIES["exposure_by_industry"](spark, SF_SMALL))
    assert "Subquery" in plan and "Window" not in plan


def test_lexicon_join_is_broadcast_and_tokens_prefiltered(spark):
    plan = _plan(QUERIES["link_mentions"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan and "Generate explode" in plan


def test_history_request_range_reaches_the_events_scan(spark):
    plan = _plan(QUERIES["data_request_history"](spark, SF_SMALL))
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line and "ts#" in line][0]
    assert "GreaterThanOrEqual(ts,2024-01-01T00:00)" in scan and "LessThan(ts,2024-02-02T00:00)" in scan
