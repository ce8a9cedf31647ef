"""Scoring retrieval, chunking strategies and request routing."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retrieval_scorecard(
    hits: DataFrame, passed: Column, case: str = "query_id", by: Sequence[str] = ()
) -> DataFrame:
    """Share of cases answered by the first hit and by the first three.

    ``hits`` has one row per case and rank; ``passed`` tells whether a hit is a
    right one. A case without hits has to be in ``hits`` with a NULL rank.
    """
    good = F.coalesce(passed, F.lit(False))
    cases = hits.groupBy(*by, case).agg(
        F.max((good & (F.col("rank") == 1)).cast("int")).alias("first"),
        F.max((good & (F.col("rank") <= 3)).cast("int")).alias("among_three"),
    )
    flag_first, flag_three = F.coalesce("first", F.lit(0)), F.coalesce("among_three", F.lit(0))
    counted = cases.groupBy(*by).agg(
        F.count("*").alias("cases"),
        F.coalesce(F.sum(flag_first), F.lit(0)).cast("bigint").alias("top1_correct"),
        F.coalesce(F.sum(flag_three), F.lit(0)).cast("bigint").alias("top3_correct"),
    )

    def share(name: str) -> Column:
        return F.when(F.col("cases") > 0, F.col(name) / F.col("cases") * 100)

    return counted.withColumns(
        {"top1_percent": share("top1_correct"), "top3_percent": share("top3_correct")}
    )


def majority_label(hits: DataFrame, case: str = "query_id", label: str = "label") -> DataFrame:
    """The label most hits of a case carry; the nearer one when tied."""
    votes = hits.groupBy(case, label).agg(
        F.count("*").alias("votes"), F.min("rank").alias("nearest")
    )
    best = F.max_by(label, F.struct(F.col("votes"), (-F.col("nearest")).alias("near")))
    return votes.groupBy(case).agg(best.alias("actual"))


def routing_scorecard(cases: DataFrame) -> DataFrame:
    """Cases per (expected, actual) route and the overall share of right ones.

    The share is a window over the counts, which are one row per pair of routes.
    """
    pairs = cases.groupBy("expected", "actual").agg(F.count("*").alias("cases"))
    everything = Window.partitionBy(F.lit(1))
    right = F.when(F.col("expected") == F.col("actual"), F.col("cases")).otherwise(0)
    share = F.sum(right).over(everything) / F.sum("cases").over(everything) * 100
    return pairs.withColumn("overall_percent", share)
