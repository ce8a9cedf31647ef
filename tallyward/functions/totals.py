"""Sums whose value does not depend on the order in which tasks finish.

Every finite double is a number of coarse units and a rest, and both are added as
decimals, so sums are exact to fifteen places. An amount has to be smaller than 1e30;
a larger one fails the query. Infinities, whose sum knows no order either, are added as
doubles. The partial sums can be summed again, which lets an operator aggregate by a
fine key first and by a coarse one later.
"""

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A power of two, so that taking units off a double is exact.
UNIT = float(1 << 40)
_EXACT = "__exact"
_COARSE = "__coarse"
_LOOSE = "__loose"
_PARTS = {_EXACT: "decimal(38,15)", _COARSE: "decimal(28,0)", _LOOSE: "double"}


def exact(column: Column, dtype: T.DataType) -> Column:
    """Decimal form of a numeric column; NULL where it does not fit."""
    if isinstance(dtype, T.DecimalType):
        return column
    if isinstance(dtype, T.IntegralType):
        return column.cast("decimal(20,0)")
    return column.cast("double").try_cast("decimal(28,12)")


def partial_sums(df: DataFrame, names: Iterable[str]) -> list[Column]:
    """Aggregates of measures; those that ``df`` holds as partial sums are added up."""
    sums = []
    for name in names:
        if has_sums(df, name):
            sums += merged_sums([name])
            continue
        dtype = df.schema[name].dataType
        column = F.col(name)
        if isinstance(dtype, (T.DoubleType, T.FloatType)):
            value = F.nanvl(column.cast("double"), F.lit(None).cast("double"))
            finite = F.when(F.abs(value) < float("inf"), value)
            units = F.rint(finite / UNIT)
            rest = (finite - units * UNIT).cast("decimal(28,15)")
            units = units.cast("decimal(18,0)")
            loose = F.when(F.abs(value) == float("inf"), value)
        else:
            rest = exact(column, dtype)
            units = F.lit(None).cast("decimal(18,0)")
            loose = F.lit(None).cast("double")
        sums.append(F.sum(rest).alias(name + _EXACT))
        sums.append(F.sum(units).alias(name + _COARSE))
        sums.append(F.sum(loose).alias(name + _LOOSE))
    return sums


def has_sums(df: DataFrame, name: str) -> bool:
    """Whether ``df`` holds a measure as partial sums."""
    return name + _EXACT in df.columns


def merged_sums(names: Iterable[str]) -> list[Column]:
    """Aggregates that add up the columns made by :func:`partial_sums`."""
    return [
        F.sum(name + part).alias(name + part)
        for name in names
        for part in _PARTS
    ]


def with_blank_sums(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Add empty partial sums for measures the data does not have."""
    wanted = [(n + part, kind) for n in names for part, kind in _PARTS.items()]
    blank = {c: F.lit(None).cast(t) for c, t in wanted if c not in df.columns}
    return df.withColumns(blank) if blank else df


def total(name: str) -> Column:
    """The finished sum as a double; 0.0 when there was nothing to add."""
    part = {p: F.coalesce(F.col(name + p).cast("double"), F.lit(0.0)) for p in _PARTS}
    return part[_COARSE] * UNIT + part[_EXACT] + part[_LOOSE]


def sum_by(df: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Sums per key (one row over everything without keys); missing keys are left out."""
    for key in by:
        df = df.where(F.col(key).isNotNull())
    return df.groupBy(*by).agg(*partial_sums(df, names))


def percent(part: Column, whole: Column) -> Column:
    """part / whole * 100, NULL when the whole is zero."""
    return F.when(whole != 0, part / whole * 100)
