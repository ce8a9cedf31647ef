import json

import pytest

from rows import COLUMNS, as_csv, clean
from tallyward.operators import quality
from tallyward.plans.report import build_report, run_report
from tallyward.sources import tables
from tallyward.session import checkpoint_folder, drop_durable, durable


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """A clean file, one file per fault, and the manifest that says so."""
    path = tmp_path_factory.mktemp("files")
    rows = clean()
    names = as_csv([]).strip().split(",")
    files = {
        "clean.csv": as_csv(rows),
        "no_budget.csv": as_csv([r[:5] + r[6:] for r in rows], names[:5] + names[6:]),
        "twice.csv": as_csv([*rows, rows[0]]),
        "blank.csv": as_csv([*rows[:5], (*rows[5][:4], None, *rows[5][5:]), *rows[6:]]),
        "negative.csv": as_csv([*rows[:9], (*rows[9][:8], -25), *rows[10:]]),
        "apart.csv": as_csv(
            [(*r, r[6] + r[7] + (5000 if n == 40 else 0)) for n, r in enumerate(rows)],
            [*names, "total_expense"],
        ),
    }
    for name, text in files.items():
        (path / name).write_text(text)
    rules = {
        "no_budget.csv": "required_columns",
        "twice.csv": "duplicate_records",
        "blank.csv": "missing_values",
        "negative.csv": "impossible_values",
        "apart.csv": "reconciliation",
    }
    manifest = {
        "clean_file": "clean.csv",
        "corrupted_files": [
            {"file": f, "rule": r, "expected_issue_count": 1, "expected": {}} for f, r in rules.items()
        ],
    }
    (path / "manifest.json").write_text(json.dumps(manifest))
    return path


def test_every_file_has_the_expected_issues(spark, folder):
    df = tables.load(str(folder / "*.csv"), spark)
    card = quality.rule_scorecard(
        quality.issue_counts(df), tables.read_manifest(spark, str(folder / "manifest.json"))
    ).collect()
    assert len(card) == 6 and all(c.passed for c in card)
    assert {c.source: c.detected for c in card}["clean.csv"] == 0


def test_whole_report(spark, folder, tmp_path):
    report = run_report(spark, str(folder / "*.csv"), str(tmp_path / "out"))
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    assert read("data").count() == 6 * 180 + 1
    assert read("rejected").count() == 0
    issues = spark.read.option("header", True).csv(str(tmp_path / "out" / "issues"))
    assert issues.count() == 5
    assert [r.source for r in read("metrics").collect()] == ["clean.csv"]
    assert read("monthly_revenue").count() == 12 and read("actual_vs_budget").count() == 12
    assert read("facts").where("line = 'calculated_metrics'").count() == 6
    assert read("facts").where("line = 'validation_issue'").count() == 5
    assert read("largest_variances").count() == 10
    text = spark.read.text(str(tmp_path / "out" / "summary")).first()[0]
    assert text.startswith("Total revenue was $19,")
    assert report.verdicts.where("clean").count() == 1


def test_files_without_rows_are_judged_too(spark, tmp_path):
    (tmp_path / "head only.csv").write_text(as_csv([]))
    (tmp_path / "no region.csv").write_text(as_csv([]).replace("region,", ""))
    (tmp_path / "rows.csv").write_text(as_csv(clean(2, 2)))
    report = run_report(spark, str(tmp_path / "*.csv"), str(tmp_path / "out"))
    issues = report.issues.collect()
    assert [(i.source, i.column_name) for i in issues] == [("no region.csv", "region")]
    verdicts = {v.source: (v.issue_count, v.clean) for v in report.verdicts.collect()}
    assert verdicts == {
        "head only.csv": (0, True),
        "no region.csv": (1, False),
        "rows.csv": (0, True),
    }
    metrics = {m.source: m for m in report.metrics.collect()}
    assert set(metrics) == {"head only.csv", "rows.csv"}
    assert metrics["head only.csv"].actual_revenue == 0
    assert metrics["head only.csv"].variance_percent is None and metrics["head only.csv"].months == []
    texts = {n.source: n.narrative for n in report.narratives.collect()}
    assert texts["head only.csv"].endswith("A change on the month before cannot be stated.")


def test_tables_without_rows_are_judged_too(spark, tmp_path):
    empty = spark.createDataFrame([], COLUMNS)
    counts = {r.issue_type: r.issue_count for r in quality.issue_counts(empty, "x").collect()}
    assert len(counts) == 5 and set(counts.values()) == {0}
    (verdict,) = quality.validated(empty.drop("region"), "x").collect()
    assert (verdict.source, verdict.issue_count, verdict.clean) == ("x", 1, False)
    assert quality.clean_source_kpis(empty, "x").first().actual_revenue == 0
    empty.coalesce(1).write.parquet(str(tmp_path / "none.parquet"))
    report = run_report(spark, str(tmp_path / "none.parquet"), str(tmp_path / "out"))
    assert [v.clean for v in report.verdicts.collect()] == [True]
    assert report.metrics.first().operating_income == 0 and report.narratives.count() == 1


def test_same_name_in_two_folders(spark, tmp_path):
    for year in (2024, 2025):
        (tmp_path / str(year)).mkdir()
        (tmp_path / str(year) / "jan +1.csv").write_text(as_csv(clean(2, 1 + year % 2)))
    report = run_report(spark, str(tmp_path / "*" / "*.csv"), str(tmp_path / "out"), row_index=True)
    verdicts = {v.source: v.clean for v in report.verdicts.collect()}
    assert verdicts == {"2024/jan +1.csv": True, "2025/jan +1.csv": True}
    found = {}
    for r in report.data.collect():
        found.setdefault(r.source, []).append(r.row_index)
    assert {s: sorted(i) for s, i in found.items()} == {
        "2024/jan +1.csv": [0, 1],
        "2025/jan +1.csv": [0, 1, 2, 3],
    }
    assert report.metrics.count() == 2


def test_columns_go_by_their_own_header(spark, tmp_path):
    names = as_csv([]).strip().split(",")
    swapped = [*names[:4], names[5], names[4], *names[6:]]
    rows = clean(2, 1)
    (tmp_path / "a.csv").write_text(as_csv(rows))
    (tmp_path / "b.csv").write_text(as_csv([(*r[:4], r[5], r[4], *r[6:]) for r in rows], swapped))
    got = {}
    for r in tables.load(str(tmp_path / "*.csv"), spark).collect():
        got.setdefault(r.source, []).append((r.location_id, r.revenue, r.budget_revenue))
    assert sorted(got["a.csv"]) == sorted(got["b.csv"]) == sorted((r[0], r[4], r[5]) for r in rows)


def test_jobs_do_not_grow_with_the_files(spark, tmp_path):
    def jobs(count):
        folder = tmp_path / str(count)
        folder.mkdir()
        for i in range(count):
            (folder / f"f{i}.csv").write_text(as_csv(clean(1, 1)))
        tracker = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(f"read-{count}", "")
        tables.read_raw(spark, str(folder / "*.csv"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(f"read-{count}"))

    assert jobs(2) == jobs(12)


def test_report_options_reach_the_rules(spark, tmp_path):
    rows = [(*r, r[6] + r[7] + 0.5) for r in clean(2, 2)]
    names = [*as_csv([]).strip().split(","), "total_expense"]
    text = as_csv(rows, names).replace("2025-02-01", "soon")
    (tmp_path / "a.csv").write_text(text)
    strict = run_report(spark, str(tmp_path / "a.csv"), str(tmp_path / "one"), keep_raw_month=True)
    kinds = [i.issue_type for i in strict.issues.collect()]
    assert kinds.count("impossible_value") == 2 and kinds.count("reconciliation_error") == 4
    loose = run_report(
        spark, str(tmp_path / "a.csv"), str(tmp_path / "two"), tolerance="1", strict_double=True
    )
    assert {i.issue_type for i in loose.issues.collect()} == {"missing_value"}


def test_gate_can_be_left_out(spark, folder):
    df = tables.load(str(folder / "twice.csv"), spark)
    assert build_report(df).metrics.count() == 0
    assert build_report(df, gate=False).metrics.count() == 1
    assert build_report(df.drop("source"), "x", gate=False).metrics.first().source == "x"


def test_durable_rows_land_in_the_session_folder(spark):
    kept = durable(spark.range(10))
    assert kept.count() == 10
    assert spark.conf.get("spark.checkpoint.dir") in kept.inputFiles()[0]


def test_durable_rows_are_dropped(spark):
    from pathlib import Path
    from urllib.parse import urlparse

    path = Path(urlparse(durable(spark.range(3)).inputFiles()[0]).path)
    assert path.exists()
    assert drop_durable(spark) > 0
    assert not path.parent.exists()


@pytest.mark.parametrize("master,refused", [("local[4]", False), ("local", False), ("local-cluster[2,1,1024]", True), ("yarn", True)])
def test_only_a_single_process_may_use_its_own_folder(master, refused):
    class Context:
        def __init__(self):
            self.master = master

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default: default)

    if refused:
        with pytest.raises(ValueError):
            checkpoint_folder(Session)
    else:
        assert checkpoint_folder(Session)
