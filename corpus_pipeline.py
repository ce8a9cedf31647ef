"""Documents to training sequences: classified, judged by rules, freed of near
copies, packed. Each stage reads what the stage before it has written."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm import adaptive_rules, lsh_forest, neighbour_quality, packing, sieve
from tallyward.llm.registry import TOKENIZER, quality_space, tokenizer_path
from tallyward.session import durable
from tallyward.sources.facts import table


READ = ("doc_id", "text", "lang", "source")


def _unclashed(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``work`` leaves of the documents, in their own columns. It sees the columns
    it reads by name and all others under names that no operator uses."""
    names = docs.columns
    safe = [n if n in READ else f"_column_{i}" for i, n in enumerate(names)]
    kept = work(docs.toDF(*safe))
    return kept.select(*[F.col(s).alias(n) for s, n in zip(safe, names, strict=True)])


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose labelled neighbours vote for quality. Empty and null texts get the
    share of good labels and stay with a majority of them."""
    space = quality_space(spark, docs, sf_dir)

    def work(rows: DataFrame) -> DataFrame:
        return neighbour_quality.scored(rows, space, carry=tuple(rows.columns)).where("score >= 0.5")

    return _unclashed(docs, work)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the limits of their language and source; those without a text
    have too few words."""
    return _unclashed(docs, lambda rows: adaptive_rules.judged(rows, keep_text=True).where("kept"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id; of rows with
    the same id and text one. Only rows whose id comes again are compared by text, and no
    text moves but theirs and those of a few kept rows that a filter mistakes for others."""

    def work(rows: DataFrame) -> DataFrame:
        found = lsh_forest.near_duplicates(rows)
        ids = durable(found.groupBy(F.col("doc_id").alias("_id")).agg(F.count_if("kept").alias("_rows")))
        own = F.xxhash64("_id")
        # Most rows are kept once or left out for certain by filters of ids.
        other = ids.where("_rows <> 1").select(own)
        unsure = durable(sieve.passed(ids.where("_rows > 0"), own, other))
        split = sieve.marked(rows, F.xxhash64("doc_id"), other, "_other")
        sure = split.where("NOT _other").drop("_other")
        met = durable(sieve.passed(split.where("_other").drop("_other"), F.xxhash64("doc_id"), unsure.select(own)))
        match = F.col("doc_id").eqNullSafe(F.col("_id"))
        once = met.join(unsure.where("_rows = 1"), match, "left_semi")
        again = met.join(unsure.where("_rows > 1"), match, "left_semi")
        return sure.unionByName(once).unionByName(again.dropDuplicates(["doc_id", "text"]))

    return _unclashed(docs, work)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 4096 tokens; a null text is empty."""
    return packing.packed(docs, tokenizer_path(TOKENIZER))


STAGES = [
    ("quality classifier", classify),
    ("quality rules", rules),
    ("MinHash near-dedup", dedup),
    ("packing", pack),
]

# The classifier, the sketches and the tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
