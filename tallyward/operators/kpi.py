"""Revenue variance, operating margin, labor share and month-over-month change.

Every function takes optional ``by`` columns; without them it returns one row
(or one series) for the whole input.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.functions.totals import merged_sums, partial_sums, percent, sum_by, total

KPI_MEASURES = ("revenue", "budget_revenue", "labor_expense", "other_expense")


def _variance_columns() -> list[Column]:
    actual, budget = total("revenue"), total("budget_revenue")
    return [
        actual.alias("actual_revenue"),
        budget.alias("budget_revenue"),
        (actual - budget).alias("variance_amount"),
        percent(actual - budget, budget).alias("variance_percent"),
    ]


def _margin_columns() -> list[Column]:
    revenue = total("revenue")
    expense = total("labor_expense") + total("other_expense")
    return [
        revenue.alias("total_revenue"),
        expense.alias("total_expense"),
        (revenue - expense).alias("operating_income"),
        percent(revenue - expense, revenue).alias("operating_margin_percent"),
    ]


def _labor_columns() -> list[Column]:
    labor, revenue = total("labor_expense"), total("revenue")
    return [
        labor.alias("total_labor_expense"),
        revenue.alias("total_revenue"),
        percent(labor, revenue).alias("labor_expense_percent"),
    ]


def kpi_columns() -> list[Column]:
    """All KPI columns over finished partial sums, each name once."""
    return _variance_columns() + _margin_columns() + [_labor_columns()[0], _labor_columns()[2]]


def variance_to_budget(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return sum_by(df, by, ("revenue", "budget_revenue")).select(*by, *_variance_columns())


def margin(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    sums = sum_by(df, by, ("revenue", "labor_expense", "other_expense"))
    return sums.select(*by, *_margin_columns())


def labor_share(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return sum_by(df, by, ("labor_expense", "revenue")).select(*by, *_labor_columns())


def monthly_revenue_change(
    df: DataFrame, by: Sequence[str] = (), adjacent_only: bool = False
) -> DataFrame:
    """Revenue per month beside the month before it.

    The month before is the previous one present in the data; with
    ``adjacent_only`` it must be the calendar month before. The window runs
    over months that are already summed. A zero month before gives a NULL
    percent.
    """
    monthly = sum_by(df, (*by, "month"), ("revenue",)).select(
        *by, "month", total("revenue").alias("revenue")
    )
    order = Window.partitionBy(*by).orderBy("month")
    prior = F.lag("revenue").over(order)
    if adjacent_only:
        follows = F.add_months(F.lag("month").over(order), 1) == F.col("month")
        prior = F.when(follows, prior)
    change = F.col("revenue") - F.col("prior_month_revenue")
    return (
        monthly.withColumn("prior_month_revenue", prior)
        .withColumn("change_amount", change)
        .withColumn(
            "change_percent", percent(F.col("change_amount"), F.col("prior_month_revenue"))
        )
    )


def latest_month(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The last row of each monthly series; no row for an empty one."""
    series = monthly_revenue_change(df, by)
    if not by:
        return series.orderBy(F.desc("month")).limit(1)
    names = [c for c in series.columns if c not in by]
    last = series.groupBy(*by).agg(F.max_by(F.struct(*names), "month").alias("last"))
    return last.select(*by, "last.*")


def metric_pack(
    df: DataFrame, by: Sequence[str] = (), groups: DataFrame | None = None
) -> DataFrame:
    """All KPIs and the monthly series from one pass over the data.

    Rows are summed per month first. The totals and the ``months`` array (one
    entry per calendar month present) both come from those monthly sums.
    ``groups`` lists all keys; those without rows have sums of zero and no month.
    """
    for key in by:
        df = df.where(F.col(key).isNotNull())
    monthly = df.groupBy(*by, "month").agg(*partial_sums(df, KPI_MEASURES))
    entry = F.when(
        F.col("month").isNotNull(), F.struct("month", total("revenue").alias("revenue"))
    )
    packed = monthly.groupBy(*by).agg(
        *merged_sums(KPI_MEASURES), F.array_sort(F.collect_list(entry)).alias("sorted")
    )
    if groups is not None:
        packed = groups.select(*by).distinct().join(packed, list(by), "left")

    def with_prior(item: Column, index: Column) -> Column:
        prior = F.when(index > 0, F.get(F.col("sorted"), index - 1)["revenue"])
        change = item["revenue"] - prior
        return F.struct(
            item["month"].alias("month"),
            item["revenue"].alias("revenue"),
            prior.alias("prior_month_revenue"),
            change.alias("change_amount"),
            percent(change, prior).alias("change_percent"),
        )

    return packed.select(
        *by,
        *kpi_columns(),
        F.coalesce(F.transform("sorted", with_prior), F.array()).alias("months"),
    )


def with_latest(pack: DataFrame) -> DataFrame:
    """Replace ``months`` by the latest month and its change."""
    last = F.try_element_at("months", F.lit(-1))
    return pack.select(
        *[c for c in pack.columns if c != "months"],
        last["month"].alias("latest_month"),
        last["change_amount"].alias("latest_change_amount"),
        last["change_percent"].alias("latest_change_percent"),
    )


def region_and_location(df: DataFrame) -> DataFrame:
    """KPIs per location, per region and over everything (missing key = all).

    Only locations, which are summed first, go into the sums of regions and of all.
    """
    df = df.where(F.col("region").isNotNull() & F.col("location_id").isNotNull())
    locations = df.groupBy("region", "location_id").agg(*partial_sums(df, KPI_MEASURES))
    sums = locations.rollup("region", "location_id").agg(*merged_sums(KPI_MEASURES))
    return sums.select("region", "location_id", *kpi_columns())
