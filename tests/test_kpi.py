import datetime
import math

import pytest

from tallyward.operators import charts, kpi

D = datetime.date
NAMES = "month date, revenue double, budget_revenue double, labor_expense double, other_expense double"


def table(spark, rows, names=NAMES):
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="module")
def hand(spark):
    return table(
        spark,
        [
            (D(2025, 1, 1), 100000.0, 90000.0, 30000.0, 20000.0),
            (D(2025, 2, 1), 110000.0, 110000.0, 35000.0, 25000.0),
        ],
    )


def test_hand_checked_kpis(hand):
    variance = kpi.variance_to_budget(hand).first()
    assert variance.variance_amount == 10000.0 and variance.variance_percent == pytest.approx(5.0)
    margin = kpi.margin(hand).first()
    assert margin.operating_margin_percent == pytest.approx(47.619047619)
    assert margin.total_expense == 110000.0
    assert kpi.labor_share(hand).first().labor_expense_percent == pytest.approx(30.952380952)
    last = kpi.latest_month(hand).first()
    assert (last.month, last.change_amount) == (D(2025, 2, 1), 10000.0)
    assert last.change_percent == pytest.approx(10.0)


def test_pack_equals_the_single_kpis(hand):
    pack = kpi.metric_pack(hand).first().asDict()
    for single in (kpi.variance_to_budget, kpi.margin, kpi.labor_share):
        for name, value in single(hand).first().asDict().items():
            assert pack[name] == value
    series = kpi.monthly_revenue_change(hand).orderBy("month").collect()
    assert [tuple(m) for m in pack["months"]] == [tuple(r) for r in series]
    latest = kpi.with_latest(kpi.metric_pack(hand)).first()
    assert latest.latest_month == D(2025, 2, 1) and latest.latest_change_amount == 10000.0


def test_zero_denominators(spark):
    no_budget = table(spark, [(D(2025, 1, 1), r, 0.0, 0.0, 0.0) for r in (100.0, 50.0)])
    row = kpi.variance_to_budget(no_budget).first()
    assert (row.variance_amount, row.variance_percent) == (150.0, None)
    nothing = table(spark, [(D(2025, 1, 1), 0.0, 0.0, 10.0, 5.0)])
    assert kpi.margin(nothing).first().operating_margin_percent is None
    assert kpi.labor_share(nothing).first().labor_expense_percent is None


def test_missing_values_are_skipped_and_empty_sums_are_zero(spark):
    df = table(spark, [(D(2025, 1, 1), None, 5.0, None, None), (D(2025, 1, 1), 7.0, None, None, None)])
    row = kpi.metric_pack(df).first()
    assert (row.actual_revenue, row.budget_revenue, row.total_expense) == (7.0, 5.0, 0.0)
    empty = kpi.metric_pack(df.limit(0)).first()
    assert (empty.actual_revenue, empty.variance_percent, empty.months) == (0.0, None, [])
    assert kpi.latest_month(df.limit(0)).count() == 0


def test_months_are_summed_and_sorted(spark):
    rows = [(D(2025, 2, 1), 120.0), (D(2025, 1, 1), 100.0), (D(2025, 2, 1), 60.0), (D(2025, 1, 1), 50.0)]
    df = table(spark, rows, "month date, revenue double")
    got = [tuple(r) for r in kpi.monthly_revenue_change(df).orderBy("month").collect()]
    assert got == [(D(2025, 1, 1), 150.0, None, None, None), (D(2025, 2, 1), 180.0, 150.0, 30.0, 20.0)]


def test_gap_is_bridged_unless_calendar_months_are_asked(spark):
    rows = [(D(2025, 1, 1), 100.0), (D(2025, 3, 1), 150.0), (D(2025, 4, 1), 75.0)]
    df = table(spark, rows, "month date, revenue double")
    bridged = kpi.monthly_revenue_change(df).orderBy("month").collect()
    assert [r.prior_month_revenue for r in bridged] == [None, 100.0, 150.0]
    strict = kpi.monthly_revenue_change(df, adjacent_only=True).orderBy("month").collect()
    assert [r.prior_month_revenue for r in strict] == [None, None, 150.0]


def test_change_over_a_zero_month_has_no_percent(spark):
    rows = [(D(2025, 1, 1), 0.0), (D(2025, 2, 1), 5.0), (D(2025, 3, 1), 0.0), (None, 9.0)]
    df = table(spark, rows, "month date, revenue double")
    got = kpi.monthly_revenue_change(df).orderBy("month").collect()
    assert [(r.change_amount, r.change_percent) for r in got] == [
        (None, None),
        (5.0, None),
        (-5.0, -100.0),
    ]
    assert kpi.variance_to_budget(
        table(spark, [(None, 9.0, 9.0, 0.0, 0.0)])
    ).first().actual_revenue == 9.0


def test_groups_and_missing_group_keys(spark):
    rows = [("N", D(2025, 1, 1), 10.0, 8.0), ("S", D(2025, 1, 1), 5.0, 8.0), (None, D(2025, 1, 1), 1.0, 1.0)]
    df = table(spark, rows, "region string, month date, revenue double, budget_revenue double")
    got = {r.region: r.variance_amount for r in kpi.variance_to_budget(df, ["region"]).collect()}
    assert got == {"N": 2.0, "S": -3.0}
    assert kpi.latest_month(df, ["region"]).count() == 2


def test_sums_are_exact_and_keep_infinities(spark):
    rows = [(0.1,)] * 1000 + [(0.2,)] * 1000
    df = table(spark, rows, "revenue double").selectExpr("revenue", "revenue as budget_revenue")
    assert kpi.variance_to_budget(df.repartition(7)).first().actual_revenue == 300.0
    fine = table(spark, [(1e-9,)] * 1000 + [(12345678.25,)], "revenue double")
    fine = fine.selectExpr("revenue", "0.0D as budget_revenue")
    assert kpi.variance_to_budget(fine).first().actual_revenue == 12345678.250001
    huge = table(spark, [(math.inf, 1e30), (5.0, 1e30)], "revenue double, budget_revenue double")
    row = kpi.variance_to_budget(huge).first()
    assert row.actual_revenue == math.inf and row.budget_revenue == 2e30


def test_chart_series(spark):
    rows = [
        (D(2025, 2, 1), 120.0, 130.0),
        (D(2025, 1, 1), 100.0, 90.0),
        (D(2025, 2, 1), 60.0, 70.0),
        (D(2025, 1, 1), 50.0, 60.0),
    ]
    df = table(spark, rows, "month date, revenue double, budget_revenue double")
    bars = charts.actual_vs_budget(df).collect()
    assert [(b.revenue, b.budget_revenue) for b in bars] == [(150.0, 150.0), (180.0, 200.0)]
    assert [r.revenue for r in charts.revenue_trend(df).collect()] == [150.0, 180.0]


def test_widest_variances(spark):
    rows = [("Alpha", 100.0, 60.0), ("Beta", 40.0, 100.0), ("Gamma", 50.0, 45.0)]
    df = table(spark, rows, "location_name string, revenue double, budget_revenue double")
    top = charts.widest_variances(df, count=2).collect()
    assert [(t.location_name, t.variance_amount) for t in top] == [("Beta", -60.0), ("Alpha", 40.0)]
    assert charts.chart_data(df, "largest_variances").count() == 3
    with pytest.raises(ValueError, match="pie"):
        charts.chart_data(df, "pie")


def test_equal_variances_go_by_name(spark):
    rows = [(n, 10.0, 0.0) for n in "dbca"]
    df = table(spark, rows, "location_name string, revenue double, budget_revenue double")
    assert [r.location_name for r in charts.widest_variances(df, count=2).collect()] == ["a", "b"]


def test_unit_sums_are_exact(spark):
    from tallyward.sources.facts import _unit_sum

    units = [2**62, 2**62, 2**62, -(2**61) - 7, -1, 0, 1048575, 1048576, -1048577]
    df = spark.createDataFrame([(u,) for u in units], "u bigint")
    assert int(df.agg(_unit_sum("u", "total")).first().total) == sum(units)
