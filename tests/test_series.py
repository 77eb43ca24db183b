"""The series' windows: one sort for all, and the same values as row by row."""

import io
from contextlib import redirect_stdout

from veritape.operators import timeseries

ROWS = [("a", q, v, n, None) for q, v, n in [("2024-Q1", 10.0, 1.0), ("2023-Q4", 5.0, None), ("2024-Q2", None, 3.0), ("10000-Q1", 20.0, 2.0), ("x", 8.0, 8.0)]]


def plan(df) -> str:
    with redirect_stdout(out := io.StringIO()):
        df.explain()
    return out.getvalue()


def wide(spark):
    return spark.createDataFrame(ROWS, "company string, quarter string, revenue double, net_profit double, operating_profit double")


def test_time_windows_share_one_sort(spark):
    # a sort for each window held the rows of a task in memory as often: 23 times
    assert plan(timeseries.features(wide(spark))).count("Sort [") == 1
    assert plan(timeseries.forward_fill(wide(spark), ["revenue", "net_profit"])).count("Sort [") == 1


def test_order_is_that_of_numbers_not_text(spark):
    got = timeseries.features(wide(spark)).select("quarter", "revenue", "net_profit", "revenue_qoq_abs_change", "revenue_yoy_change").collect()
    assert [tuple(r) for r in got] == [
        ("x", 8.0, 8.0, None, None),
        ("2023-Q4", 5.0, 8.0, -3.0, None),
        ("2024-Q1", 10.0, 1.0, 5.0, None),
        ("2024-Q2", 10.0, 3.0, 0.0, None),
        ("10000-Q1", 20.0, 2.0, 10.0, 150.0),
    ]
    assert timeseries.features(wide(spark)).columns[:6] == ["company", "quarter", "revenue", "net_profit", "operating_profit", "profit_margin"]
