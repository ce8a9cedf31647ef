"""Writing tables, issues and report text."""

from pyspark.sql import DataFrame

from tallyward.schema import ABSENT_COLUMN


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write rows as Parquet, or as CSV with a header and no index."""
    if kind == "csv":
        df.drop(ABSENT_COLUMN).write.mode("overwrite").option("header", True).option(
            "escape", '"'
        ).csv(path)
    elif kind in ("parquet", "json"):
        df.write.mode("overwrite").format(kind).save(path)
    else:
        raise ValueError(f"Cannot write {kind!r}: use csv, json or parquet")


def write_text(df: DataFrame, path: str, column: str) -> None:
    df.select(column).write.mode("overwrite").text(path)
