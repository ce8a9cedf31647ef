"""Text helpers: stripping, line breaks, number display."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character Unicode counts as white space, as a trim set.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
# Line breaks other than newline.
OTHER_BREAKS = "\r\n|[\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def plain_lines(text: Column) -> Column:
    """The text with newline as its only line break and none at its end."""
    return F.regexp_replace(F.regexp_replace(text, OTHER_BREAKS, "\n"), "\n\\z", "")


def grouped(value: Column, decimals: int) -> Column:
    """1234567.5 -> '1,234,568', rounding half to even."""
    return F.format_number(value, decimals)


def ungrouped(value: Column, decimals: int) -> Column:
    return F.replace(F.format_number(value, decimals), F.lit(","), F.lit(""))


def shortest(value: Column) -> Column:
    """A number as text, without '.0' on whole values."""
    number = value.cast("double")
    whole = F.when(number == F.floor(number), number.try_cast("decimal(38,0)").cast("string"))
    return F.coalesce(whole, value.cast("string"))
