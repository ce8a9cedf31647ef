"""Running totals over ordered rows of one group, safe for very large groups."""

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Positions per window partition. A group longer than this is summed span by
# span, so no task ever sorts a whole group.
SPAN = 4096


def running_before(
    df: DataFrame,
    group: str,
    position: str,
    value: str,
    ties: Sequence[str] = (),
    span: int = SPAN,
) -> DataFrame:
    """Add ``before`` (sum of ``value`` over earlier rows of the group) and
    ``group_total`` (sum over the whole group).

    ``position`` is an integral column. Totals per span are aggregated first
    and accumulated over spans (one narrow row each); only then are rows
    ordered, inside their own span. Ordering and the lookup of the totals share
    one exchange of the rows, since both go by the same two keys.
    """
    # Keys without NULL: a plain equality, so that one partitioning serves both.
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    place = F.coalesce(F.floor(F.col(position) / span), F.lit(-(1 << 62)))
    rows = df.withColumn("_key", key).withColumn("_span", place)
    spans = rows.groupBy("_key", "_span").agg(F.sum(value).alias("_in_span"))
    all_spans = Window.partitionBy("_key")
    earlier = all_spans.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        "_key",
        "_span",
        F.coalesce(F.sum("_in_span").over(earlier), F.lit(0)).alias("_base"),
        F.sum("_in_span").over(all_spans).alias("group_total"),
    )
    inside = (
        Window.partitionBy("_key", "_span")
        .orderBy(position, *ties)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    counted = rows.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = counted.join(spans, ["_key", "_span"])
    return joined.withColumn("before", F.col("_base") + F.col("_inside")).drop(
        "_key", "_span", "_base", "_inside"
    )
