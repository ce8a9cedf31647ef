"""Turning text cells into numbers and days without ever raising."""

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.schema import MISSING_TOKENS

# try_cast alone also takes suffixes such as '1d'; the pattern keeps plain
# decimal notation only.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY_PATTERN = r"(?i)^\s*[+-]?inf(inity)?\s*$"

DAY_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM",
    "yyyy/MM/dd",
    "M/d/yyyy",
)
MONTH_FIRST, DAY_FIRST = "M/d/yyyy", "d/M/yyyy"
SLASHED = r"^(\d{1,2})/(\d{1,2})/\d{4}$"


def known(text: Column) -> Column:
    """The text, or NULL where it is one of the missing tokens."""
    return F.when(~text.isin(*MISSING_TOKENS), text)


def to_number(text: Column) -> Column:
    """A double; NULL for anything that is not a finite number or an infinity word."""
    value = text.try_cast("double")
    overflow = F.abs(value) == F.lit(float("inf"))
    return F.when(text.rlike(NUMBER_PATTERN) & ~overflow, value).when(
        text.rlike(INFINITY_PATTERN), value
    )


# What the letters of a format stand for.
_SHAPES = {
    "yyyy": r"\d{4}",
    "MM": r"\d{2}",
    "dd": r"\d{2}",
    "HH": r"\d{2}",
    "mm": r"\d{2}",
    "ss": r"\d{2}",
    "M": r"\d{1,2}",
    "d": r"\d{1,2}",
}


def shape_of(day_format: str) -> str | None:
    """A pattern every text of the format matches; None if it has other letters."""
    pattern = "^"
    for part in re.findall(r"'[^']*'|y+|M+|d+|H+|m+|s+|.", day_format):
        if part.startswith("'"):
            pattern += re.escape(part.strip("'"))
        elif part in _SHAPES:
            pattern += _SHAPES[part]
        elif part.isalpha():
            return None
        else:
            pattern += re.escape(part)
    return pattern + "$"


def order_votes(text: Column) -> list[Column]:
    """Sums over cells, which add up over parts: ``slashed``, those of the shape 1/2/2025;
    ``day_first`` and ``month_first``, those of them that only one order can read."""
    cell = F.trim(text)
    part = lambda i: F.regexp_extract(cell, SLASHED, i).try_cast("int")
    month = lambda i: part(i).between(1, 12)
    day = lambda i: part(i).between(13, 31)
    return [
        F.count_if(cell.rlike(SLASHED)).alias("slashed"),
        F.count_if(day(1) & month(2)).alias("day_first"),
        F.count_if(month(1) & day(2)).alias("month_first"),
    ]


def to_day(
    text: Column, formats: Sequence[str] = DAY_FORMATS, day_first: Column | None = None
) -> Column:
    """A date by the first format that fits the cell itself; NULL if none does. Where
    ``day_first`` holds, the day stands before the month in cells such as 1/2/2025."""
    cell = F.trim(text)

    def attempt(day_format: str) -> Column:
        shape = shape_of(day_format)
        if day_format == "yyyy-MM-dd":
            day = cell.try_cast("date")
        else:
            day = F.try_to_timestamp(cell, F.lit(day_format)).cast("date")
        # A failing parse costs far more than a failing match.
        return day if shape is None else F.when(cell.rlike(shape), day)

    def chosen(day_format: str) -> Column:
        if day_first is None or day_format != MONTH_FIRST:
            return attempt(day_format)
        return F.when(day_first, attempt(DAY_FIRST)).otherwise(attempt(MONTH_FIRST))

    return F.coalesce(*[chosen(f) for f in formats])


def as_number(column: Column, dtype: T.DataType) -> Column:
    """Numeric form of a column of any type; NaN counts as missing, and so do
    the missing tokens, none of which reads as a number."""
    if isinstance(dtype, T.StringType):
        return to_number(column)
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        value = column.cast("double")
        return F.when(~F.isnan(value), value)
    if isinstance(dtype, T.NumericType):
        return column
    return column.try_cast("double")


def as_text(column: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.StringType):
        return known(column)
    return column.cast("string")


def as_day(
    column: Column, dtype: T.DataType, formats: Sequence[str], day_first: Column | None = None
) -> Column:
    """Date form of a column; bare numbers are not dates."""
    if isinstance(dtype, T.StringType):
        return to_day(known(column), formats, day_first)
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return column.cast("date")
    return to_day(column.cast("string"), formats)
