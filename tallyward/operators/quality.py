"""Data-quality rules over an operations table.

Each rule returns rows of :data:`tallyward.schema.ISSUE_SCHEMA`. The source of a
row is its ``source`` column when the input has one, else the ``source``
argument. When the input carries ``_absent_columns`` (a batch of files with
different layouts), a rule leaves out the columns the row's file does not have.
"""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.functions.text import grouped, shortest
from tallyward.functions.totals import exact, has_sums, merged_sums, partial_sums, with_blank_sums
from tallyward.operators.kpi import KPI_MEASURES, kpi_columns
from tallyward.schema import (
    ABSENT_COLUMN,
    EXPENSE_COLUMNS,
    ISSUE_SCHEMA,
    ISSUE_TYPES,
    KEY_COLUMNS,
    RAW_MONTH_COLUMN,
    REQUIRED_COLUMNS,
    ROW_INDEX_COLUMN,
    SEVERITIES,
    SOURCE_COLUMN,
)

TOLERANCE = "0.01"


def _source(df: DataFrame, source: str | None) -> Column:
    if SOURCE_COLUMN in df.columns:
        return F.col(SOURCE_COLUMN)
    return F.lit(source).cast("string")


def _present(df: DataFrame, name: str) -> Column:
    """Whether the row's own file has the column."""
    if ABSENT_COLUMN in df.columns:
        return ~F.array_contains(ABSENT_COLUMN, name)
    return F.lit(True)


def _key(df: DataFrame, name: str, dtype: str) -> Column:
    column = F.col(name) if name in df.columns else F.lit(None)
    return column.cast(dtype)


def _row_index(df: DataFrame) -> Column:
    if ROW_INDEX_COLUMN in df.columns:
        return F.col(ROW_INDEX_COLUMN).cast("bigint")
    return F.lit(None).cast("bigint")


# What a rule finds; the wording is added afterwards, once for all rules.
FINDING = (
    "rule_order",
    "source",
    "location_id",
    "month",
    "column_name",
    "row_index",
    "observed",
)
_PLACE = """concat(
    if(row_index is null, '', concat('row ', row_index, ', ')),
    'location ', coalesce(location_id, 'unknown'),
    ', month ', coalesce(cast(month as string), 'unknown'))"""
_EXPLANATION = """case
    when rule_order = 1 then concat("The required column '", column_name, "' is not in the data.")
    when rule_order = 2 then concat(observed, ' rows share ', place, '.')
    when rule_order = 3 then concat("No value in column '", column_name, "' (", place, ').')
    when rule_order = 4 and column_name = 'month' then concat(
      "Column 'month' holds '", observed, "', which is no date (", place, ').')
    when rule_order = 4 then concat(
      "Column 'volume' holds the impossible negative value ", observed, ' (', place, ').')
    else concat(
      'Labor plus other expense is $', observed, ' away from the stated total (', place, ').')
    end"""
_ACTION = """case
    when rule_order = 1 then concat("Supply the column '", column_name, "'.")
    when rule_order = 2 then concat('Keep one row for ', place, '.')
    when rule_order = 3 then concat("Fill in '", column_name, "' (", place, ').')
    when rule_order = 4 and column_name = 'month' then concat(
      "Write 'month' as a date (", place, ').')
    when rule_order = 4 then concat("Correct 'volume' to zero or more (", place, ').')
    else concat('Check the expense parts and the total (', place, ').')
    end"""
_TYPE = "element_at(array({}), rule_order)".format(", ".join(f"'{t}'" for t in ISSUE_TYPES))


def _worded(findings: DataFrame) -> DataFrame:
    """Findings as issue records."""
    return findings.selectExpr(*FINDING, f"{_PLACE} as place").selectExpr(
        "rule_order",
        f"{_TYPE} as issue_type",
        "'error' as severity",
        "source",
        "location_id",
        "month",
        "column_name",
        "row_index",
        "observed",
        f"{_EXPLANATION} as explanation",
        f"{_ACTION} as suggested_action",
    )


def missing_mask(df: DataFrame, name: str) -> Column:
    missing = F.col(name).isNull() & _present(df, name)
    if name == "month":
        missing = missing & ~unreadable_month_mask(df)
    return missing


def unreadable_month_mask(df: DataFrame) -> Column:
    """Month cells with text that is no date, where that text was kept."""
    if not {"month", RAW_MONTH_COLUMN} <= set(df.columns):
        return F.lit(False)
    return F.col("month").isNull() & F.col(RAW_MONTH_COLUMN).isNotNull()


def _checked_columns(df: DataFrame) -> list[str]:
    return sorted(c for c in REQUIRED_COLUMNS if c in df.columns)


def negative_mask(df: DataFrame) -> Column:
    if "volume" not in df.columns:
        return F.lit(False)
    return F.coalesce(F.col("volume") < 0, F.lit(False))


def expense_difference(df: DataFrame, strict_double: bool = False) -> Column:
    """How far labor plus other expense is from the stated total.

    In decimals, 100.00 + 50.00 against 150.01 differs by exactly 0.01.
    ``strict_double`` subtracts as doubles instead, where that difference may
    come out a little above or below. Amounts no decimal holds are subtracted
    as doubles either way.
    """
    labor, other, stated = (F.col(c).cast("double") for c in EXPENSE_COLUMNS)
    loose = F.abs(labor + other - stated)
    loose = F.when(~F.isnan(loose), loose)
    if strict_double:
        return loose
    labor, other, stated = (exact(F.col(c), df.schema[c].dataType) for c in EXPENSE_COLUMNS)
    return F.coalesce(F.abs(labor + other - stated).cast("double"), loose)


def unreconciled_mask(
    df: DataFrame, tolerance: str = TOLERANCE, strict_double: bool = False
) -> Column:
    if not set(EXPENSE_COLUMNS) <= set(df.columns):
        return F.lit(False)
    off = expense_difference(df, strict_double) > F.lit(float(tolerance))
    return F.coalesce(off, F.lit(False))


def _absent_findings(df: DataFrame, source: str | None) -> DataFrame:
    if ABSENT_COLUMN in df.columns:
        files = df.select(_source(df, source).alias("source"), ABSENT_COLUMN).distinct()
        absent = files.select("source", F.explode(ABSENT_COLUMN).alias("column_name")).where(
            F.col("column_name").isin(*REQUIRED_COLUMNS)
        )
    else:
        names = sorted(set(REQUIRED_COLUMNS) - set(df.columns))
        if names and SOURCE_COLUMN in df.columns:
            absent = df.select("source").distinct().withColumn(
                "column_name", F.explode(F.array(*map(F.lit, names)))
            )
        else:
            absent = df.sparkSession.createDataFrame(
                [(source, name) for name in names], "source string, column_name string"
            )
    return absent.selectExpr(
        "1 as rule_order",
        "source",
        "cast(null as string) as location_id",
        "cast(null as date) as month",
        "column_name",
        "cast(null as bigint) as row_index",
        "cast(null as string) as observed",
    )


def required_columns(df: DataFrame, source: str | None = None) -> DataFrame:
    """One issue per required column that is not there, by source and name."""
    return _worded(_absent_findings(df, source))


def presence(df: DataFrame, source: str | None = None) -> DataFrame:
    """source and present: one bit per required column, set where a row of the source
    has a value in it. Bitmaps of parts of a source are put together by ``bit_or``."""
    bits = F.lit(0)
    for i, name in enumerate(REQUIRED_COLUMNS):
        if name in df.columns:
            held = F.col(name).isNotNull() & _present(df, name)
            bits = bits + F.when(held, 1 << i).otherwise(0)
    return df.groupBy(_source(df, source).alias("source")).agg(F.bit_or(bits).alias("present"))


def wholly_missing_columns(df: DataFrame, source: str | None = None) -> DataFrame:
    """:func:`required_columns` for a table whose files are not known any more: a column
    is not there if no row of the source has a value in it. One scan; what is shuffled is
    a bitmap per task and source."""
    names = F.array(*[F.lit(c) for c in REQUIRED_COLUMNS])
    lacking = F.filter(names, lambda c, i: F.expr("present").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) == 0)
    absent = presence(df, source).select("source", F.explode(lacking).alias("column_name"))
    return _worded(
        absent.selectExpr(
            "1 as rule_order",
            "source",
            "cast(null as string) as location_id",
            "cast(null as date) as month",
            "column_name",
            "cast(null as bigint) as row_index",
            "cast(null as string) as observed",
        )
    )


def _no_findings(df: DataFrame) -> DataFrame:
    fields = [f for f in ISSUE_SCHEMA.fields if f.name in FINDING]
    return df.sparkSession.createDataFrame([], T.StructType(fields)).select(*FINDING)


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys held by more than one row, with the number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("group_size")).where("group_size > 1")


def _key_findings(df: DataFrame, source: str | None) -> DataFrame:
    if not set(KEY_COLUMNS) <= set(df.columns):
        return _no_findings(df)
    keyed = df.where(_present(df, "location_id") & _present(df, "month")).select(
        _source(df, source).alias("source"), *KEY_COLUMNS
    )
    return duplicate_groups(keyed, ("source", *KEY_COLUMNS)).selectExpr(
        "2 as rule_order",
        "source",
        "cast(location_id as string) as location_id",
        "cast(month as date) as month",
        "cast(null as string) as column_name",
        "cast(null as bigint) as row_index",
        "cast(group_size as string) as observed",
    )


def duplicate_keys(df: DataFrame, source: str | None = None) -> DataFrame:
    """One issue per repeated (location, month) of a source; missing keys are equal."""
    return _worded(_key_findings(df, source))


def _row_checks(
    df: DataFrame, rules: Sequence[int], tolerance: str, strict_double: bool
) -> list[tuple[int, Column, str, Column]]:
    """(rule, failing mask, column name, observed value) of every check on a row."""
    checks = [(3, missing_mask(df, c), c, F.lit(None)) for c in _checked_columns(df)]
    if "volume" in df.columns:
        checks.append((4, negative_mask(df), "volume", shortest(F.col("volume"))))
    if RAW_MONTH_COLUMN in df.columns:
        checks.append((4, unreadable_month_mask(df), "month", F.col(RAW_MONTH_COLUMN)))
    if set(EXPENSE_COLUMNS) <= set(df.columns):
        mask = unreconciled_mask(df, tolerance, strict_double)
        apart = grouped(expense_difference(df, strict_double), 2)
        checks.append((5, mask, "total_expense", apart))
    return [check for check in checks if check[0] in rules]


def _row_findings(
    df: DataFrame,
    source: str | None,
    rules: Sequence[int] = (3, 4, 5),
    tolerance: str = TOLERANCE,
    strict_double: bool = False,
) -> DataFrame:
    """One scan without a shuffle; rows without a fault go first."""
    checks = _row_checks(df, rules, tolerance, strict_double)
    if not checks:
        return _no_findings(df)
    failing = reduce(Column.__or__, [mask for _, mask, _, _ in checks])
    found = [
        F.when(
            mask,
            F.struct(
                F.lit(rule).alias("rule_order"),
                F.lit(name).alias("column_name"),
                observed.cast("string").alias("observed"),
            ),
        )
        for rule, mask, name, observed in checks
    ]
    exploded = df.where(failing).select(
        _source(df, source).alias("source"),
        _key(df, "location_id", "string").alias("location_id"),
        _key(df, "month", "date").alias("month"),
        _row_index(df).alias("row_index"),
        F.explode(F.array_compact(F.array(*found))).alias("finding"),
    )
    return exploded.select("source", "location_id", "month", "row_index", "finding.*").select(
        *FINDING
    )


def row_issues(
    df: DataFrame,
    source: str | None = None,
    rules: Sequence[int] = (3, 4, 5),
    tolerance: str = TOLERANCE,
    strict_double: bool = False,
) -> DataFrame:
    """Missing, impossible and unreconciled values, by rule number."""
    return _worded(_row_findings(df, source, rules, tolerance, strict_double))


def missing_values(df: DataFrame, source: str | None = None) -> DataFrame:
    return row_issues(df, source, rules=(3,))


def missing_value_counts(df: DataFrame) -> DataFrame:
    """Missing cells per required column: the short form of :func:`missing_values`."""
    names = _checked_columns(df)
    counts = df.agg(*[F.count_if(missing_mask(df, c)).alias(c) for c in names])
    return counts.unpivot([], names, "column_name", "missing").where("missing > 0")


def impossible_values(df: DataFrame, source: str | None = None) -> DataFrame:
    return row_issues(df, source, rules=(4,))


def unreconciled_expenses(
    df: DataFrame,
    source: str | None = None,
    tolerance: str = TOLERANCE,
    strict_double: bool = False,
) -> DataFrame:
    return row_issues(df, source, (5,), tolerance, strict_double)


# Copies of one issue that one row is spread into at a time.
COPIES = 4096


def all_issues(
    df: DataFrame,
    source: str | None = None,
    tolerance: str = TOLERANCE,
    strict_double: bool = False,
    files: DataFrame | None = None,
) -> DataFrame:
    """Issues of all rules; ``rule_order`` gives their fixed order.

    ``files`` (source, _absent_columns) lists the sources, for those without rows.

    One scan and one shuffle: each row gives a mark of its key and its own findings,
    and equal ones are counted. A mark that comes again is a repeated key, a finding
    as many issues as rows have it, so no list of a key's rows is ever built.
    """
    absent = _absent_findings(df if files is None else files, source)
    keyed = F.lit(set(KEY_COLUMNS) <= set(df.columns))
    keyed = keyed & _present(df, "location_id") & _present(df, "month")

    def entry(rule: int, column: Column, observed: Column, row: Column) -> Column:
        return F.struct(
            F.lit(rule).alias("rule_order"),
            column.cast("string").alias("column_name"),
            observed.cast("string").alias("observed"),
            row.cast("bigint").alias("row_index"),
        )

    nothing = F.lit(None)
    entries = [F.when(keyed, entry(2, nothing, nothing, nothing))]
    for rule, mask, name, observed in _row_checks(df, (3, 4, 5), tolerance, strict_double):
        entries.append(F.when(mask, entry(rule, F.lit(name), observed, _row_index(df))))
    tagged = df.select(
        _source(df, source).alias("source"),
        _key(df, "location_id", "string").alias("location_id"),
        _key(df, "month", "date").alias("month"),
        F.explode(F.array_compact(F.array(*entries))).alias("entry"),
    ).select("source", "location_id", "month", "entry.*")
    names = ("source", "location_id", "month", "rule_order", "column_name", "observed", "row_index")
    counted = tagged.groupBy(*names).agg(F.count("*").alias("n")).where("rule_order > 2 OR n > 1")
    times = F.when(F.col("rule_order") == 2, 1).otherwise(F.col("n"))
    parts = counted.withColumn("times", times).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.expr(f"(times - 1) div {COPIES}")))
    )
    copies = F.least(F.lit(COPIES), F.col("times") - F.col("part") * COPIES)
    listed = parts.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))
    size = F.when(F.col("rule_order") == 2, F.col("n").cast("string")).otherwise(F.col("observed"))
    return _worded(absent.unionByName(listed.withColumn("observed", size).select(*FINDING)))


def with_bad_severity(issues: DataFrame) -> DataFrame:
    """Issue rows whose severity is outside its domain."""
    return issues.where(F.col("severity").isNull() | ~F.col("severity").isin(*SEVERITIES))


def checked_severity(issues: DataFrame) -> DataFrame:
    """The same rows; running it fails on a severity outside its domain."""
    valid = F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False))
    fault = F.raise_error(
        F.concat(F.lit("Severity must be error or warning, not "), F.col("severity"))
    )
    return issues.withColumn("severity", F.when(valid, F.col("severity")).otherwise(fault))


def _count_name(issue_type: str) -> str:
    return f"n_{issue_type}"


def fault_counts(df: DataFrame, tolerance: str = TOLERANCE, strict_double: bool = False) -> list[Column]:
    """Aggregates that count rows with a key and faults of each rule; see
    :func:`merged_faults`."""
    blanks = F.lit(0)
    for name in _checked_columns(df):
        blanks = blanks + missing_mask(df, name).cast("int")
    both = set(KEY_COLUMNS) <= set(df.columns)
    keyed = _present(df, "location_id") & _present(df, "month") & F.lit(both)
    if ABSENT_COLUMN in df.columns:
        absent = F.size(F.array_intersect(ABSENT_COLUMN, F.array(*map(F.lit, REQUIRED_COLUMNS))))
    else:
        absent = F.lit(len(set(REQUIRED_COLUMNS) - set(df.columns)))
    return [
        F.count_if(keyed).alias("_keyed"),
        F.max(absent).alias("_absent"),
        F.sum(blanks).alias("_blanks"),
        F.count_if(negative_mask(df)).alias("_negative"),
        F.count_if(unreadable_month_mask(df)).alias("_unreadable"),
        F.count_if(unreconciled_mask(df, tolerance, strict_double)).alias("_apart"),
    ]


def merged_faults() -> list[Column]:
    """Aggregates that put the columns made by :func:`fault_counts` together."""
    added = [F.sum(c).alias(c) for c in ("_keyed", "_blanks", "_negative", "_unreadable", "_apart")]
    return [*added, F.max("_absent").alias("_absent")]


def is_cube(df: DataFrame) -> bool:
    return "_keyed" in df.columns


def cube_measures(df: DataFrame) -> list[str]:
    return [c for c in KPI_MEASURES if has_sums(df, c)]


def source_profile(
    df: DataFrame,
    source: str | None = None,
    tolerance: str = TOLERANCE,
    strict_double: bool = False,
    files: DataFrame | None = None,
) -> DataFrame:
    """Per source: issues of each rule, and the KPI sums, from one scan.

    With ``files`` (source, _absent_columns) sources without rows are there too,
    as is a table that is one ``source`` by name, with or without rows.

    Rows are reduced per (source, location, month) first, which finds repeated
    keys and keeps a large source spread over many tasks, then per source. A cube
    (:mod:`tallyward.operators.cube`) is reduced already.
    """
    keys = [c for c in KEY_COLUMNS if c in df.columns]
    if is_cube(df):
        measures = cube_measures(df)
        sums = [*merged_faults(), *merged_sums(measures)]
        per_key = df.withColumnRenamed(SOURCE_COLUMN, "_source").groupBy("_source", *keys).agg(*sums)
    else:
        measures = [c for c in KPI_MEASURES if c in df.columns]
        sums = [*fault_counts(df, tolerance, strict_double), *partial_sums(df, measures)]
        per_key = df.withColumn("_source", _source(df, source)).groupBy("_source", *keys).agg(*sums)
    profile = per_key.groupBy(F.col("_source").alias("source")).agg(
        F.max("_absent").cast("bigint").alias(_count_name(ISSUE_TYPES[0])),
        F.count_if(F.col("_keyed") > 1).alias(_count_name(ISSUE_TYPES[1])),
        F.sum("_blanks").alias(_count_name(ISSUE_TYPES[2])),
        F.sum(F.col("_negative") + F.col("_unreadable")).alias(_count_name(ISSUE_TYPES[3])),
        F.sum("_apart").alias(_count_name(ISSUE_TYPES[4])),
        *merged_sums(measures),
    )
    if files is None and source is not None and SOURCE_COLUMN not in df.columns:
        missing = sorted(set(REQUIRED_COLUMNS) - set(df.columns))
        files = df.sparkSession.createDataFrame(
            [(source, missing)], f"source string, {ABSENT_COLUMN} array<string>"
        )
    if files is None:
        return profile
    absent = F.array_intersect(ABSENT_COLUMN, F.array(*map(F.lit, REQUIRED_COLUMNS)))
    listed = files.select("source", F.size(absent).cast("bigint").alias("_absent"))
    counts = {_count_name(t): F.coalesce(_count_name(t), F.lit(0)) for t in ISSUE_TYPES}
    counts[_count_name(ISSUE_TYPES[0])] = F.col("_absent")
    return listed.join(profile, "source", "left").withColumns(counts).drop("_absent")


def _total_issues() -> Column:
    total = F.lit(0)
    for issue_type in ISSUE_TYPES:
        total = total + F.col(_count_name(issue_type))
    return total


def issue_counts(df: DataFrame, source: str | None = None, **options) -> DataFrame:
    """Issues per source and rule, zeros included."""
    profile = source_profile(df, source, **options).select(
        "source", *[F.col(_count_name(t)).alias(t) for t in ISSUE_TYPES]
    )
    return profile.unpivot("source", list(ISSUE_TYPES), "issue_type", "issue_count")


def issue_type_sets(df: DataFrame, source: str | None = None, **options) -> DataFrame:
    """The sorted issue types found in each source, joined by commas."""
    profile = source_profile(df, source, **options)
    types = [F.when(F.col(_count_name(t)) > 0, F.lit(t)) for t in sorted(ISSUE_TYPES)]
    return profile.select("source", F.concat_ws(",", *types).alias("issue_types"))


def validated(df: DataFrame, source: str | None = None, **options) -> DataFrame:
    """Per source: issue count and whether it may be reported on."""
    return verdicts(source_profile(df, source, **options))


def verdicts(profile: DataFrame) -> DataFrame:
    """The verdict on each source of a :func:`source_profile`."""
    count = _total_issues().cast("bigint")
    return profile.select("source", count.alias("issue_count"), (count == 0).alias("clean"))


def clean_source_kpis(df: DataFrame, source: str | None = None, **options) -> DataFrame:
    """KPIs of the sources without a single issue."""
    profile = source_profile(df, source, **options)
    clean = with_blank_sums(profile, KPI_MEASURES).where(_total_issues() == 0)
    return clean.select("source", *kpi_columns())


def clean_rows(df: DataFrame, issues: DataFrame) -> DataFrame:
    """Rows of the sources that no issue names."""
    named = issues.select(F.col("source").alias("_named")).distinct()
    return df.join(named, F.col(SOURCE_COLUMN).eqNullSafe(F.col("_named")), "left_anti")


def rule_scorecard(detected: DataFrame, manifest: DataFrame) -> DataFrame:
    """Detected against expected issue counts per source.

    ``detected`` is the result of :func:`issue_counts`; ``manifest`` has
    ``source, issue_type, expected``. A case passes when the source has exactly
    the expected number of issues and the expected type is among them.
    """
    per_source = detected.groupBy("source").agg(
        F.sum("issue_count").alias("detected"),
        F.collect_set(F.when(F.col("issue_count") > 0, F.col("issue_type"))).alias("types"),
    )
    cases = manifest.join(per_source, "source", "full_outer")
    passed = (F.col("detected") == F.col("expected")) & F.array_contains("types", F.col("issue_type"))
    return cases.select(
        "source",
        "issue_type",
        F.coalesce("expected", F.lit(0)).cast("bigint").alias("expected"),
        F.coalesce("detected", F.lit(0)).cast("bigint").alias("detected"),
        F.when(F.col("issue_type").isNull(), F.coalesce("detected", F.lit(0)) == 0)
        .otherwise(F.coalesce(passed, F.lit(False)))
        .alias("passed"),
    )


def rule_agreement(detected: DataFrame, manifest: DataFrame) -> DataFrame:
    """Detected against expected issue counts per source and rule, where a
    source may have faults of several rules."""
    cases = manifest.join(detected, ["source", "issue_type"], "full_outer")
    expected = F.coalesce("expected", F.lit(0)).cast("bigint")
    found = F.coalesce("issue_count", F.lit(0)).cast("bigint")
    return cases.select(
        "source",
        "issue_type",
        expected.alias("expected"),
        found.alias("detected"),
        (expected == found).alias("passed"),
    )
