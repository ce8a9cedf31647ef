import math

import pytest
from pyspark.sql import functions as F

from rows import COLUMNS, clean, table
from tallyward.operators import quality
from tallyward.schema import ISSUE_SCHEMA, ISSUE_TYPES
from tallyward.sources import tables as tables_module

WITH_TOTAL = COLUMNS + ", total_expense double"


def with_totals(rows):
    return [(*r, r[6] + r[7]) for r in rows]


def edit(rows, index, column, value):
    names = [c.split()[0] for c in WITH_TOTAL.split(", ")]
    row = list(rows[index])
    row[names.index(column)] = value
    return [*rows[:index], tuple(row), *rows[index + 1 :]]


def counts(df, source="data"):
    return {r.issue_type: r.issue_count for r in quality.issue_counts(df, source).collect()}


def test_clean_table_has_no_issue(spark):
    df = table(spark, clean())
    assert quality.all_issues(df, "clean").count() == 0
    assert set(counts(df).values()) == {0}


def test_missing_column(spark):
    df = table(spark, clean()).drop("budget_revenue", "region")
    issues = quality.required_columns(df, "x.csv").collect()
    assert [i.column_name for i in issues] == ["budget_revenue", "region"]
    assert "budget_revenue" in issues[0].explanation and issues[0].severity == "error"
    assert quality.all_issues(df, "x").count() == 2
    assert counts(df)["missing_required_column"] == 2
    assert quality.clean_source_kpis(df, "x").count() == 0


def test_missing_column_is_named_for_each_source(spark):
    rows = [(*r, s) for s in ("a", "b") for r in clean(1, 2)]
    df = table(spark, rows, COLUMNS + ", source string").drop("region")
    issues = quality.all_issues(df).orderBy("source").collect()
    assert [(i.source, i.column_name) for i in issues] == [("a", "region"), ("b", "region")]


def test_one_issue_per_repeated_key(spark):
    rows = clean()
    df = table(spark, [*rows, rows[0], rows[0], rows[5]])
    issues = quality.duplicate_keys(df, "x").orderBy("month").collect()
    assert [(i.location_id, i.month.isoformat(), i.observed) for i in issues] == [
        ("LOC-001", "2025-01-01", "3"),
        ("LOC-001", "2025-06-01", "2"),
    ]
    assert "LOC-001" in issues[0].explanation and "2025-01-01" in issues[0].explanation
    assert counts(df)["duplicate_record"] == 2


def test_missing_keys_count_as_equal(spark):
    rows = [(None, *r[1:]) for r in clean(1, 1) * 2]
    df = table(spark, rows)
    assert quality.duplicate_keys(df, "x").first().location_id is None
    assert counts(df) == {**dict.fromkeys(ISSUE_TYPES, 0), "duplicate_record": 1, "missing_value": 2}


def test_missing_values_by_row_and_column(spark):
    rows = edit(edit(with_totals(clean(2, 2)), 0, "revenue", None), 0, "region", None)
    rows = edit(rows, 3, "total_expense", None)
    issues = quality.missing_values(table(spark, rows, WITH_TOTAL), "x").collect()
    assert [(i.location_id, i.column_name) for i in issues] == [
        ("LOC-001", "region"),
        ("LOC-001", "revenue"),
    ]
    assert "revenue" in issues[1].explanation
    short = {r.column_name: r.missing for r in quality.missing_value_counts(table(spark, rows, WITH_TOTAL)).collect()}
    assert short == {"region": 1, "revenue": 1}


@pytest.mark.parametrize("value,shown", [(-25.0, "-25"), (-0.5, "-0.5"), (-math.inf, "-Infinity")])
def test_negative_volume(spark, value, shown):
    rows = edit(with_totals(clean(1, 3)), 1, "volume", value)
    issue = quality.impossible_values(table(spark, rows, WITH_TOTAL), "x").first()
    assert shown in issue.explanation and "volume" in issue.explanation
    assert issue.observed == shown


def test_missing_or_zero_volume_is_not_impossible(spark):
    rows = edit(edit(with_totals(clean(1, 3)), 1, "volume", None), 2, "volume", 0.0)
    assert quality.impossible_values(table(spark, rows, WITH_TOTAL), "x").count() == 0


def test_unreconciled_expenses(spark):
    rows = with_totals(clean(1, 4))
    rows = edit(rows, 0, "total_expense", rows[0][9] + 5000)
    rows = edit(rows, 1, "total_expense", rows[1][9] + 0.01)
    rows = edit(rows, 2, "total_expense", rows[2][9] - 0.02)
    rows = edit(rows, 3, "total_expense", None)
    issues = quality.unreconciled_expenses(table(spark, rows, WITH_TOTAL), "x")
    got = issues.orderBy("month").collect()
    assert [i.observed for i in got] == ["5,000.00", "0.02"]
    assert "5,000" in got[0].explanation
    assert quality.unreconciled_expenses(table(spark, clean(1, 1)), "x").count() == 0


def test_tolerance_edge_in_decimals_and_in_doubles(spark):
    names = "labor_expense double, other_expense double, total_expense double"
    df = spark.createDataFrame([(100.0, 50.0, 150.01), (51590.74, 69789.43, 121380.18)], names)
    assert quality.unreconciled_expenses(df, "x").count() == 0
    strict = [abs(a + b - c) > 0.01 for a, b, c in df.collect()]
    assert strict == [False, True]
    assert quality.unreconciled_expenses(df, "x", strict_double=True).count() == 1
    assert quality.unreconciled_expenses(df, "x", tolerance="0.005").count() == 2


def test_amounts_no_decimal_holds_are_compared_as_doubles(spark):
    names = "labor_expense double, other_expense double, total_expense double"
    rows = [(math.inf, 1.0, 2.0), (math.inf, 1.0, math.inf), (1e25, 0.0, 3e25)]
    df = spark.createDataFrame(rows, names)
    assert quality.unreconciled_expenses(df, "x").count() == 2


def test_all_rules_together(spark):
    rows = with_totals(clean())
    rows = edit(edit(rows, 2, "revenue", None), 3, "volume", -25.0)
    rows = edit(rows, 4, "total_expense", rows[4][9] + 5000)
    df = table(spark, [*rows, rows[0]], WITH_TOTAL)
    issues = quality.all_issues(df, "multi.csv")
    assert issues.schema.fieldNames() == ISSUE_SCHEMA.fieldNames()
    assert [(i.rule_order, i.issue_type) for i in issues.orderBy("rule_order").collect()] == [
        (2, "duplicate_record"),
        (3, "missing_value"),
        (4, "impossible_value"),
        (5, "reconciliation_error"),
    ]
    types = quality.issue_type_sets(df, "multi.csv").first()
    assert types.issue_types == (
        "duplicate_record,impossible_value,missing_value,reconciliation_error"
    )
    assert {i.source for i in issues.collect()} == {"multi.csv"}


def test_issue_count_does_not_depend_on_partitions(spark):
    rows = with_totals(clean())
    rows = edit(edit(rows, 2, "revenue", None), 3, "volume", -25.0)
    df = table(spark, [*rows, *rows[:20]], WITH_TOTAL)
    want = sorted(map(tuple, quality.all_issues(df, "x").collect()), key=str)
    for parts in (1, 13):
        again = quality.all_issues(df.repartition(parts), "x").collect()
        assert sorted(map(tuple, again), key=str) == want


def test_counts_agree_with_issue_rows(spark, tables):
    from tallyward.sources import facts

    df = facts.with_source_year(facts.operations_with_faults(spark, tables))
    rows = quality.all_issues(df).groupBy("source", "issue_type").count()
    short = quality.issue_counts(df).where("issue_count > 0")
    assert rows.exceptAll(short).count() == 0 and short.exceptAll(rows).count() == 0


def test_gate_leaves_only_clean_sources(spark):
    names = COLUMNS + ", source string"
    rows = [(*r, "good") for r in clean(2, 3)] + [(*r, "bad") for r in clean(2, 3)]
    rows.append(rows[-1])
    df = table(spark, rows, names)
    assert [r.source for r in quality.clean_source_kpis(df).collect()] == ["good"]
    kept = quality.clean_rows(df, quality.all_issues(df))
    assert {r.source for r in kept.collect()} == {"good"} and kept.count() == 6
    verdicts = {r.source: (r.issue_count, r.clean) for r in quality.validated(df).collect()}
    assert verdicts == {"good": (0, True), "bad": (1, False)}


def test_repeated_keys_are_looked_for_within_a_source(spark):
    names = COLUMNS + ", source string"
    df = table(spark, [(*r, s) for s in ("a", "b") for r in clean(1, 2)], names)
    assert quality.all_issues(df).count() == 0


def test_row_index_is_named(spark):
    rows = edit(with_totals(clean(1, 3)), 1, "revenue", None)
    df = table(spark, rows, WITH_TOTAL).withColumn("row_index", F.month("month") - 1)
    issue = quality.missing_values(df, "x").first()
    assert issue.row_index == 1 and "row 1," in issue.explanation


def test_unreadable_month_is_impossible_when_its_text_is_kept(spark):
    rows = [("A", "2025-01-01"), ("B", "soon"), ("C", None), ("D", "NA")]
    raw = spark.createDataFrame(rows, "location_id string, month string")
    kept = tables_module.normalize_types(raw, keep_raw_month=True)
    issues = quality.row_issues(kept, "x").orderBy("location_id").collect()
    assert [(i.location_id, i.issue_type) for i in issues] == [
        ("B", "impossible_value"),
        ("C", "missing_value"),
        ("D", "missing_value"),
    ]
    assert "'soon'" in issues[0].explanation
    found = counts(kept)
    assert (found["impossible_value"], found["missing_value"]) == (1, 2)
    plain = tables_module.normalize_types(raw)
    assert quality.row_issues(plain, "x").where("issue_type = 'missing_value'").count() == 3


def test_severity_domain(spark):
    good = quality.required_columns(table(spark, clean(1, 1)).drop("region"), "x")
    assert quality.with_bad_severity(good).count() == 0
    assert quality.checked_severity(good).count() == 1
    bad = good.withColumn("severity", F.lit("fatal"))
    assert quality.with_bad_severity(bad).count() == 1
    with pytest.raises(Exception, match="fatal"):
        quality.checked_severity(bad).collect()


def test_scorecard_against_manifest(spark):
    names = COLUMNS + ", source string"
    rows = clean(1, 3)
    data = [(*r, "clean.csv") for r in rows]
    data += [(*r, "twice.csv") for r in [*rows, rows[0]]]
    data += [(*r, "miss.csv") for r in rows]
    detected = quality.issue_counts(table(spark, data, names))
    manifest = spark.createDataFrame(
        [
            ("clean.csv", None, 0),
            ("twice.csv", "duplicate_record", 1),
            ("miss.csv", "missing_value", 1),
            ("gone.csv", "missing_value", 1),
        ],
        "source string, issue_type string, expected bigint",
    )
    got = {r.source: (r.detected, r.passed) for r in quality.rule_scorecard(detected, manifest).collect()}
    assert got == {
        "clean.csv": (0, True),
        "twice.csv": (1, True),
        "miss.csv": (0, False),
        "gone.csv": (0, False),
    }
