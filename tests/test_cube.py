"""The summary cube gives what the data gives, and cubes of batches add up."""

import random

import pytest
from pyspark.sql import functions as F

from rows import COLUMNS, as_csv, clean
from tallyward.operators import charts, cube, kpi, quality
from tallyward.plans.queries import REGISTRY
from tallyward.plans.report import run_report

WIDE = f"source string, {COLUMNS}, total_expense double"


@pytest.fixture(scope="module")
def data(spark):
    """Three sources: clean, with faults of every kind, and with missing keys."""
    pick = random.Random(6)
    rows = [("clean", *r, r[6] + r[7]) for r in clean(4, 5)]
    for r in clean(5, 6):
        r = list(r)
        if pick.random() < 0.2:
            r[pick.choice([1, 2, 4, 5, 6])] = None
        if pick.random() < 0.2:
            r[8] = -r[8]
        apart = pick.choice([0, 0, 0, 0.01, 0.02, 700])
        rows += [("faulty", *r, (r[6] or 0) + r[7] + apart)] * pick.choice([1, 1, 1, 2, 5])
    rows += [("keyless", None, "Place 1", None, None, 1e17, 2.5, float("nan"), 4.0, None, None)] * 9
    rows += [("keyless", "LOC-1", None, "R", None, float("inf"), 1.0, 1.0, 1.0, 1.0, 2.0)]
    return spark.createDataFrame(rows, WIDE).repartition(7).cache()


def as_rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


SAME = {
    "pack": lambda d: kpi.metric_pack(d, ["source"]),
    "margin": lambda d: kpi.margin(d, ["region"]),
    "change": lambda d: kpi.monthly_revenue_change(d, ["source"]),
    "latest": lambda d: kpi.latest_month(d),
    "rollup": kpi.region_and_location,
    "budget": lambda d: charts.actual_vs_budget(d, ["source"]),
    "trend": lambda d: charts.revenue_trend(d),
    "widest": lambda d: charts.widest_variances(d, count=3, by=["source"]),
    "verdicts": quality.validated,
    "counts": quality.issue_counts,
    "types": quality.issue_type_sets,
    "gated": quality.clean_source_kpis,
}


@pytest.mark.parametrize("name", SAME)
def test_cube_gives_what_the_data_gives(data, name):
    assert as_rows(SAME[name](cube.summary_cube(data))) == as_rows(SAME[name](data))


def test_cubes_of_batches_add_up(data):
    """However the rows are dealt, even within a key; sums come out to the last bit."""
    whole = cube.summary_cube(data)
    dealt = data.withColumn("part", F.pmod(F.xxhash64("location_id", "revenue", F.rand(3)), F.lit(3)))
    dealt = dealt.cache()
    parts = [cube.summary_cube(dealt.where(F.col("part") == i).drop("part")) for i in range(3)]
    both = cube.merged(*parts)
    assert as_rows(cube.cells(both)) == as_rows(cube.cells(whole))
    assert as_rows(quality.issue_counts(both)) == as_rows(quality.issue_counts(data))
    assert as_rows(cube.cells(cube.merged(cube.merged(parts[2], parts[0]), parts[1]))) == as_rows(cube.cells(whole))


def test_cube_without_rows_or_source(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert cube.summary_cube(empty, "x").collect() == []
    named = spark.createDataFrame(clean(1, 1), COLUMNS)
    assert cube.cells(cube.summary_cube(named, "x")).first().source == "x"
    lacking = cube.summary_cube(named.drop("region", "budget_revenue"), "y")
    both = cube.merged(lacking, cube.summary_cube(named, "x"))
    assert {r.source: (r.region, r.budget_revenue) for r in cube.cells(both).collect()} == {
        "x": ("Region 1", 100000.0 + 1000 + 10 + 0.25 + 350),
        "y": (None, 0.0),
    }
    counts = {(r.source, r.issue_type): r.issue_count for r in quality.issue_counts(both).collect()}
    assert counts["y", "missing_required_column"] == 2 and counts["x", "missing_required_column"] == 0


def test_report_reads_its_data_for_issues_and_cube_only(spark, tmp_path):
    (tmp_path / "a.csv").write_text(as_csv(clean(3, 4)))
    report = run_report(spark, str(tmp_path / "a.csv"), str(tmp_path / "out"))
    for part in ("issues", "verdicts", "metrics", "narratives", "facts", "actual_vs_budget", "monthly_revenue", "largest_variances"):
        files = getattr(report, part).inputFiles()
        assert not [f for f in files if "/out/data/" in f], part
    assert cube.cells(spark.read.parquet(str(tmp_path / "out" / "cube"))).count() == 12


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString().splitlines()


def test_all_issues_scan_line_items_once(spark, tables):
    plan = plan_of(REGISTRY["dq_all_issues"](spark, tables))
    assert sum("FileScan" in line and "l_extendedprice" in line for line in plan) == 1


def test_region_sums_are_not_expanded_from_rows(spark, tables):
    plan = plan_of(REGISTRY["kpi_by_region"](spark, tables))
    (expand,) = [i for i, line in enumerate(plan) if "Expand" in line]
    merges = [i for i, line in enumerate(plan) if "Aggregate(keys=[region" in line and "location_id" in line]
    # Lines further down are closer to the data: locations are summed below it.
    assert max(merges) > expand


def test_equal_issues_of_many_rows_are_all_listed(spark, monkeypatch):
    monkeypatch.setattr(quality, "COPIES", 3)
    row = ("LOC-1", None, "R", None, 1.0, 1.0, 1.0, 1.0, -5.0)
    df = spark.createDataFrame([row] * 10 + [("LOC-2", *row[1:])], COLUMNS)
    found = quality.all_issues(df, "x").collect()
    kinds = [(i.rule_order, i.location_id, i.column_name, i.observed) for i in found]
    assert kinds.count((2, "LOC-1", None, "10")) == 1
    assert kinds.count((3, "LOC-1", "month", None)) == kinds.count((3, "LOC-1", "location_name", None)) == 10
    assert kinds.count((4, "LOC-1", "volume", "-5.0")) + kinds.count((4, "LOC-1", "volume", "-5")) == 10
    assert len(kinds) == 1 + 3 * 11


def test_cubes_are_put_together_in_tasks_of_bounded_size(spark, tables, monkeypatch):
    monkeypatch.setattr(cube, "TASK_ROWS", 500)
    asked = []
    merged = cube.merged
    monkeypatch.setattr(cube, "merged", lambda *c, **o: asked.append((c, o["tasks"])) or merged(*c, **o))
    found = sorted(map(tuple, REGISTRY["cube_gated_kpis"](spark, tables).collect()))
    cubes, tasks = asked[0]
    rows = sum(c.count() for c in cubes)
    assert tasks == -(-rows // 500) > 1
    assert merged(*cubes, tasks=tasks).count() == merged(*cubes).count()
    # Read from tables, so that no task holds the maps of both batches as well.
    assert all("HashAggregate" not in c._jdf.queryExecution().executedPlan().toString() for c in cubes)
    assert found == sorted(map(tuple, quality.clean_source_kpis(merged(*cubes)).collect()))
