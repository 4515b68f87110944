"""What the plans must look like, whatever the size of the data."""

import re

import pytest

import __spark_entry__ as entry
from airlake.operators import align, features, series
from airlake.sources import views as V
from tests import oracle


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def hourly(spark):
    return V.weather(spark, oracle.SF).join(V.air_quality(spark, oracle.SF), ["station", "ts"])


def test_no_registered_query_multiplies_rows(spark):
    for name, query in entry.queries().items():
        if name in ("merge_current", "engineer_features", "override_nearest", "health_status", "fallback_chain", "box_stats"):
            text = plan(query(spark, oracle.SF))
            assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_features_stay_in_the_jvm_and_windows_are_by_slice(spark):
    text = plan(features.engineer(hourly(spark)))
    assert "Python" not in text and "Arrow" not in text
    for keys in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text):
        columns = re.findall(r"(\w+)#", keys)
        # By station alone only the slice table is moved.
        assert columns in (["station", "ts"], ["station", "_slice"], ["station"])


def test_upstream_of_a_sliced_operator_runs_once(spark):
    df = series.bounded(hourly(spark).select("station", "ts", "us_aqi"), features.lag_columns, back=24)
    df.collect()
    text = plan(df).split("== Initial Plan ==")[0]
    assert text.count("FileScan parquet") == 2 and "ReusedExchange" in text


def test_last_rows_are_cut_before_the_exchange(spark):
    text = plan(align.tail(V.air_quality(spark, oracle.SF), 48))
    assert text.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("name", ["hazard_alerts", "box_stats"])
def test_scans_read_only_needed_columns(spark, name):
    text = plan(entry.queries()[name](spark, oracle.SF))
    for columns in re.findall(r"ReadSchema: struct<([^>]*)>", text):
        assert len(columns.split(",")) <= 4
