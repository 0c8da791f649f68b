"""Plan shape: one scan per report, pruned columns, bounded windows, no Python."""

import pytest

import __spark_entry__ as E
from tokentally.catalog import QUERIES
from tokentally.operators.history import history_last
from tokentally.sources.driver_tables import load_usage

SF = "/root/testdata/sf0.001"


def plan_of(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_period_table_is_one_scan(spark, capsys):
    p = plan_of(E.queries()["period_summary"](spark, SF), capsys)
    assert p.count("FileScan parquet") == 1
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double,props:string>" in p


def test_series_is_one_pruned_scan(spark, capsys):
    p = plan_of(E.queries()["series_scaled"](spark, SF), capsys)
    assert p.count("FileScan parquet") == 1
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double,props:string>" in p


def test_keyed_history_limits_before_shuffle(spark, capsys):
    p = plan_of(history_last(load_usage(spark, SF), 50, key="session"), capsys)
    assert "WindowGroupLimit" in p and "Partial" in p


def test_top_k_is_take_ordered(spark, capsys):
    p = plan_of(E.queries()["top_sessions"](spark, SF), capsys)
    assert "TakeOrderedAndProject" in p


@pytest.mark.parametrize("name", sorted(k for k in QUERIES if not k.startswith("stream_")))
def test_no_python_in_plans(spark, capsys, name):
    p = plan_of(E.queries()[name](spark, SF), capsys)
    assert "EvalPython" not in p and "PythonUDF" not in p and "ExistingRDD" not in p
