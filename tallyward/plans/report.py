"""The batch report: read, validate, gate, compute, write."""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.functions.coerce import DAY_FORMATS
from tallyward.operators import charts, cube, kpi, narrative, quality
from tallyward.session import durable
from tallyward.sources import sinks, tables

SOURCE = ("source",)


@dataclass
class Report:
    """The parts of a report, each a table with a ``source`` column."""

    data: DataFrame
    cube: DataFrame
    issues: DataFrame
    verdicts: DataFrame
    metrics: DataFrame
    narratives: DataFrame
    facts: DataFrame
    actual_vs_budget: DataFrame
    monthly_revenue: DataFrame
    largest_variances: DataFrame


def build_report(
    data: DataFrame,
    source: str = "data",
    gate: bool = True,
    files: DataFrame | None = None,
    **rules,
) -> Report:
    """All report parts of a normalised table, per source.

    With ``gate`` only sources without an issue get KPIs, text and charts. Issues and
    a summary cube are written, and everything but the issues is read from the cube;
    the gate is applied to the results. Runs jobs.
    ``files`` (source, _absent_columns) lists all sources, so that those without
    rows are reported on too. ``rules`` are those of the quality rules:
    ``tolerance`` and ``strict_double``.
    """
    if "source" not in data.columns:
        data = data.withColumn("source", F.lit(source))
    # The data is read twice: for its issues, and for the cube that gives all the rest.
    issues = durable(quality.all_issues(data, files=files, **rules))
    summary = durable(cube.summary_cube(data, **rules))
    verdicts = durable(quality.verdicts(quality.source_profile(summary, files=files)))
    clean = verdicts.where("clean").select(F.col("source").alias("_clean"))

    def gated(df: DataFrame) -> DataFrame:
        if not gate:
            return df
        return df.join(clean, F.col("source") == F.col("_clean"), "left_semi")

    pack = durable(kpi.metric_pack(summary, SOURCE, groups=files))
    reported = gated(pack)
    return Report(
        data=data,
        cube=summary,
        issues=issues,
        verdicts=verdicts,
        metrics=reported,
        narratives=narrative.kpi_narrative(reported, SOURCE),
        facts=narrative.facts_json(pack, issues, "source"),
        actual_vs_budget=gated(charts.actual_vs_budget(summary, SOURCE)),
        monthly_revenue=gated(charts.revenue_trend(summary, SOURCE)),
        largest_variances=gated(charts.widest_variances(summary, by=SOURCE)),
    )


def run_report(
    spark: SparkSession,
    paths: str | Sequence[str],
    out: str,
    gate: bool = True,
    day_formats: Sequence[str] = DAY_FORMATS,
    keep_raw_month: bool = False,
    tolerance: str = quality.TOLERANCE,
    strict_double: bool = False,
    **reading,
) -> Report:
    """Write a whole report under ``out``.

    The normalised rows are written first and read back: every later pass
    reads only the columns it needs from Parquet, and none parses text again.
    ``reading`` are options of :func:`tallyward.sources.tables.read_raw`.
    """
    raw = tables.read_raw(spark, paths, **reading)
    sinks.write_table(tables.rejected_rows(raw), f"{out}/rejected")
    rows = tables.normalize_types(tables.accepted_rows(raw), day_formats, keep_raw_month)
    sinks.write_table(rows, f"{out}/data")
    report = build_report(
        spark.read.schema(rows.schema).parquet(f"{out}/data"),
        gate=gate,
        files=durable(tables.source_files(spark, paths)),
        tolerance=tolerance,
        strict_double=strict_double,
    )
    sinks.write_table(report.cube, f"{out}/cube")
    sinks.write_table(report.issues, f"{out}/issues", "csv")
    sinks.write_table(report.verdicts, f"{out}/verdicts")
    sinks.write_table(report.metrics, f"{out}/metrics")
    sinks.write_table(report.facts, f"{out}/facts")
    sinks.write_table(report.actual_vs_budget, f"{out}/actual_vs_budget")
    sinks.write_table(report.monthly_revenue, f"{out}/monthly_revenue")
    sinks.write_table(report.largest_variances, f"{out}/largest_variances")
    sinks.write_text(report.narratives, f"{out}/summary", "narrative")
    return report
