"""Data behind the three report charts."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyward.functions.totals import sum_by, total
from tallyward.operators.kpi import monthly_revenue_change


def actual_vs_budget(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    sums = sum_by(df, (*by, "month"), ("revenue", "budget_revenue"))
    return sums.select(
        *by,
        "month",
        total("revenue").alias("revenue"),
        total("budget_revenue").alias("budget_revenue"),
    ).orderBy(*by, "month")


def revenue_trend(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return monthly_revenue_change(df, by).select(*by, "month", "revenue").orderBy(*by, "month")


def widest_variances(
    df: DataFrame,
    dimension: str = "location_name",
    count: int = 10,
    by: Sequence[str] = (),
) -> DataFrame:
    """The ``count`` values of ``dimension`` furthest from budget, lowest variance
    first; of each group with ``by``."""
    sums = sum_by(df, (*by, dimension), ("revenue", "budget_revenue"))
    gaps = (
        sums.select(
            *by,
            dimension,
            total("revenue").alias("revenue"),
            total("budget_revenue").alias("budget_revenue"),
        )
        .withColumn("variance_amount", F.col("revenue") - F.col("budget_revenue"))
        .withColumn("absolute_variance", F.abs("variance_amount"))
    )
    order = [F.desc("absolute_variance"), F.col(dimension)]
    if not by:
        top = gaps.orderBy(*order).limit(count)
    else:
        place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        top = gaps.withColumn("_place", place).where(F.col("_place") <= count).drop("_place")
    return top.orderBy(*by, "variance_amount", dimension)


CHARTS = {
    "actual_vs_budget": actual_vs_budget,
    "monthly_revenue": revenue_trend,
    "largest_variances": widest_variances,
}


def chart_data(df: DataFrame, name: str) -> DataFrame:
    if name not in CHARTS:
        raise ValueError(f"No chart named {name!r}; choose one of {sorted(CHARTS)}")
    return CHARTS[name](df)
