"""A summary cube: what a report needs of its data, small enough to be read many times.

One row per source, location, name, region and month holds exact sums of the measures
and counts of faults. Both can be added up again, so KPIs, charts, the gate and the
counts per rule all come from the cube as they would from the data: the functions of
``kpi``, ``charts`` and ``quality`` take either. Cubes of two batches put together are
the cube of both, so a new batch is added without reading the old ones.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.totals import merged_sums, partial_sums, total
from tallyward.operators import quality
from tallyward.operators.kpi import KPI_MEASURES
from tallyward.schema import SOURCE_COLUMN

# Cube rows that a task puts together; it holds them in up to three hash maps.
TASK_ROWS = 200_000
DIMENSIONS = ("location_id", "location_name", "region", "month")


def summary_cube(
    df: DataFrame,
    source: str | None = None,
    tolerance: str = quality.TOLERANCE,
    strict_double: bool = False,
) -> DataFrame:
    """The cube of a table, from one scan and one shuffle.

    Missing keys are keys of their own. A table without a ``source`` column is the
    source named. Columns the data does not have are not in the cube.
    """
    keys = [c for c in DIMENSIONS if c in df.columns]
    measures = [c for c in KPI_MEASURES if c in df.columns]
    named = df if SOURCE_COLUMN in df.columns else df.withColumn(SOURCE_COLUMN, F.lit(source).cast("string"))
    return named.groupBy(SOURCE_COLUMN, *keys).agg(
        F.count("*").alias("_rows"),
        *quality.fault_counts(df, tolerance, strict_double),
        *partial_sums(df, measures),
    )


def merged(*cubes: DataFrame, tasks: int | None = None) -> DataFrame:
    """One cube of several, whose batches need not be apart in any key. Measures and
    keys that a cube lacks count as missing in all its rows. It is put together in as
    many ``tasks`` as :func:`tasks_for` says, else as the session has shuffle partitions."""
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cubes)
    keys = [c for c in DIMENSIONS if c in both.columns]
    if tasks is not None:
        both = both.repartition(tasks, SOURCE_COLUMN, *keys)
    return both.groupBy(SOURCE_COLUMN, *keys).agg(
        F.sum("_rows").alias("_rows"),
        *quality.merged_faults(),
        *merged_sums(quality.cube_measures(both)),
    )


def tasks_for(*cubes: DataFrame) -> int:
    """Into how many tasks written cubes go, so that none holds more than a fixed number of
    their rows, whatever their size. Counts them, which for tables reads no rows."""
    return max(1, -(-sum(c.count() for c in cubes) // TASK_ROWS))


def cells(cube: DataFrame) -> DataFrame:
    """The cube for reading: keys, rows, finished sums and faults by kind."""
    keys = [c for c in (SOURCE_COLUMN, *DIMENSIONS) if c in cube.columns]
    faults = {"_blanks": "blank_cells", "_negative": "negative_volumes", "_unreadable": "unreadable_months", "_apart": "unreconciled"}
    return cube.select(
        *keys,
        F.col("_rows").alias("row_count"),
        *[total(m).alias(m) for m in quality.cube_measures(cube)],
        *[F.col(c).cast("bigint").alias(n) for c, n in faults.items()],
    )
