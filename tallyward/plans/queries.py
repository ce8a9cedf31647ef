"""The registered queries: each takes a session and a folder of tables."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.operators import charts, chunks, cube, kpi, narrative, nearest, quality, scorecards
from tallyward.schema import ABSENT_COLUMN, REQUIRED_COLUMNS
from tallyward.session import durable
from tallyward.sources import facts, tables

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

ALL = "all locations"


def registered(query: Query) -> Query:
    REGISTRY[query.__name__] = query
    return query


def _spoiled(key: Column, good: Column, bad: dict[int, str | Column]) -> Column:
    """Text cells with a bad value wherever the key is a multiple of a number."""
    cell = None
    for every, value in bad.items():
        value = F.lit(value) if isinstance(value, str) else value
        hit = key % every == 0
        cell = F.when(hit, value) if cell is None else cell.when(hit, value)
    return cell.otherwise(good)


# Reading and normalising


@registered
def day_order_by_source(spark, folder):
    """Order dates, written by each priority in its own way, and how many read right."""
    written = facts.table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("source"), F.col("o_orderdate").cast("date").alias("day")
    )
    way = F.substring("source", 1, 1)
    early = (way == "5") & (F.dayofmonth("day") <= 12)
    cell = (
        F.when(way.isin("1", "3") | early, F.date_format("day", "d/M/yyyy"))
        .when(way.isin("2", "4"), F.date_format("day", "M/d/yyyy"))
        .otherwise(F.date_format("day", "yyyy-MM-dd"))
    )
    raw = written.withColumn("month", cell)
    read = tables.load(raw, day_order="vote").groupBy("source").agg(
        F.count("month").alias("days"), F.count_if(F.col("month") == F.col("day")).alias("right_days")
    )
    return tables.day_orders(raw).join(read, "source")


@registered
def normalize_types(spark, folder):
    key = F.col("l_orderkey")
    quantity = F.col("l_quantity").cast("bigint").cast("string")
    price = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    text = facts.table(spark, folder, "lineitem").select(
        key.alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        _spoiled(
            key,
            quantity,
            {
                13: "bad-value",
                17: "N/A",
                19: "1d",
                23: F.concat(F.lit(" "), quantity, F.lit(" ")),
                29: "1e400",
            },
        ).alias("volume"),
        _spoiled(key, price, {11: "$5", 31: "null", 37: F.concat(F.lit("+"), price)}).alias(
            "revenue"
        ),
        _spoiled(key, day, {7: "not-a-date", 41: "202501", 43: "None", 47: "2001-02-30"}).alias(
            "month"
        ),
    )
    return tables.normalize_types(text).select(
        "order_key",
        "line_number",
        F.col("volume").alias("quantity"),
        F.col("revenue").alias("price"),
        F.col("month").alias("ship_date"),
    )


@registered
def preview_rows(spark, folder):
    ops = facts.money_as_double(facts.operations(spark, folder))
    return tables.preview(ops, ["location_id", "month"])


@registered
def dataset_profile(spark, folder):
    return tables.profile(facts.operations(spark, folder))


@registered
def dataset_fingerprint(spark, folder):
    return tables.fingerprint(facts.table(spark, folder, "documents"))


@registered
def ordered_fingerprint(spark, folder):
    return tables.ordered_fingerprint(facts.table(spark, folder, "documents"), "doc_id")


@registered
def fingerprint_spans(spark, folder):
    """Where a version of the documents differs from another: a digest per 64 ids."""
    return tables.span_digests(facts.table(spark, folder, "documents"), "doc_id", 64)


# Data quality


@registered
def multi_source_issue_counts(spark, folder):
    ops = facts.operations_with_faults(spark, folder)
    by_region = ops.withColumn("source", F.coalesce("region", F.lit("unknown")))
    return quality.issue_counts(by_region)


@registered
def dq_required_columns(spark, folder):
    """Each location sends a file a month: the columns a file has no value in."""
    ops = facts.operations_with_faults(spark, folder)
    files = F.concat_ws("/", "location_id", F.date_format("month", "yyyy-MM"))
    found = quality.wholly_missing_columns(ops.withColumn("source", files))
    return found.select("source", "column_name", "severity")


@registered
def empty_source_counts(spark, folder):
    """Sources are the regions; those with an odd key have no row, and are judged too."""
    region = facts.table(spark, folder, "region")
    ops = facts.operations_with_faults(spark, folder).withColumnRenamed("region", "source")
    kept = ops.join(region.where("r_regionkey % 2 = 0"), ops["source"] == F.col("r_name"), "left_semi")
    nothing = F.array().cast("array<string>").alias(ABSENT_COLUMN)
    files = region.select(F.col("r_name").alias("source"), nothing)
    return quality.issue_counts(kept.withColumn("region", F.col("source")), files=files)


@registered
def dq_duplicate_keys(spark, folder):
    issues = quality.duplicate_keys(facts.operations_with_faults(spark, folder), ALL)
    size = F.col("observed").cast("bigint").alias("group_size")
    return issues.select("location_id", "month", size)


@registered
def dq_duplicate_lineitems(spark, folder):
    lines = facts.table(spark, folder, "lineitem")
    return quality.duplicate_groups(lines, ["l_orderkey", "l_linenumber"])


@registered
def dq_missing_values(spark, folder):
    issues = quality.missing_values(facts.operations_with_faults(spark, folder), ALL)
    return issues.select("location_id", "month", "column_name")


@registered
def dq_missing_value_counts(spark, folder):
    return quality.missing_value_counts(facts.operations_with_faults(spark, folder))


@registered
def dq_impossible_values(spark, folder):
    issues = quality.impossible_values(facts.operations_with_faults(spark, folder), ALL)
    return issues.select("location_id", "month", F.col("observed").cast("double").alias("volume"))


@registered
def dq_reconciliation(spark, folder):
    issues = quality.unreconciled_expenses(facts.operations_with_faults(spark, folder), ALL)
    amount = F.replace("observed", F.lit(","), F.lit("")).cast("decimal(18,2)")
    return issues.select("location_id", "month", amount.cast("double").alias("difference"))


@registered
def dq_all_issues(spark, folder):
    ops = facts.operations_with_faults(spark, folder)
    return quality.all_issues(ops, ALL).select(
        "rule_order", "issue_type", "severity", "location_id", "month", "column_name"
    )


@registered
def dq_invalid_dates(spark, folder):
    key = F.col("o_orderkey")
    orders = facts.table(spark, folder, "orders").select(
        key.cast("string").alias("location_id"),
        _spoiled(
            key,
            F.date_format("o_orderdate", "yyyy-MM-dd"),
            {7: "not-a-date", 11: "2001-02-30", 13: "NA", 17: "202501"},
        ).alias("month"),
    )
    read = tables.normalize_types(orders, ["yyyy-MM-dd"], keep_raw_month=True)
    issues = quality.impossible_values(read, "orders")
    return issues.select(
        F.col("location_id").cast("bigint").alias("key"), F.col("observed").alias("raw_value")
    )


@registered
def gated_kpis(spark, folder):
    ops = facts.with_source_year(facts.operations_with_faults(spark, folder))
    return quality.clean_source_kpis(ops).select(
        "source", "actual_revenue", "budget_revenue", "variance_amount", "variance_percent"
    )


@registered
def summary_cube(spark, folder):
    ops = facts.with_source_year(facts.operations_with_faults(spark, folder))
    return cube.cells(cube.summary_cube(ops)).drop("location_name", "unreadable_months")


@registered
def cube_gated_kpis(spark, folder):
    """Two batches, odd months and even ones, each with its cube; the gate and the KPIs
    of both from the cubes put together."""
    ops = facts.with_source_year(facts.operations_with_faults(spark, folder))
    odd = F.month("month") % 2 == 1
    # Written, as batches are: cubes that one plan makes and merges share their tasks.
    cubes = [durable(cube.summary_cube(ops.where(part))) for part in (odd, ~odd)]
    return quality.clean_source_kpis(cube.merged(*cubes, tasks=cube.tasks_for(*cubes)))


@registered
def issue_counts(spark, folder):
    counts = quality.issue_counts(facts.operations_with_faults(spark, folder), ALL)
    return counts.select("issue_type", "issue_count")


@registered
def issue_types_by_source(spark, folder):
    ops = facts.with_source_year(facts.operations_with_faults(spark, folder))
    return quality.issue_type_sets(ops)


@registered
def issues_json(spark, folder):
    issues = quality.impossible_values(facts.operations_with_faults(spark, folder), ALL)
    return narrative.issues_as_json(issues).select("location_id", "month", "issue_json")


@registered
def dq_rule_scorecard(spark, folder):
    detected = quality.issue_counts(facts.operations_with_faults(spark, folder), ALL)
    k = facts.fault_key()
    copies = F.when(k % 101 == 0, 2).otherwise(1)

    def seeded(*moduli: int) -> Column:
        hits = sum(((k % m == 0).cast("int") for m in moduli), F.lit(0))
        return F.coalesce(F.sum(hits * copies), F.lit(0))

    manifest = (
        facts.operations(spark, folder)
        .agg(
            F.lit(0).cast("bigint").alias("missing_required_column"),
            F.count_if(k % 101 == 0).alias("duplicate_record"),
            seeded(89, 97).alias("missing_value"),
            seeded(79).alias("impossible_value"),
            seeded(83).alias("reconciliation_error"),
        )
        .unpivot([], quality.ISSUE_TYPES, "issue_type", "expected")
        .withColumn("source", F.lit(ALL))
    )
    return quality.rule_agreement(detected, manifest).select(
        F.col("issue_type").alias("rule"), "expected", "detected", "passed"
    )


# KPIs and charts


@registered
def kpi_revenue_variance(spark, folder):
    return kpi.variance_to_budget(facts.operations(spark, folder))


@registered
def kpi_operating_margin(spark, folder):
    return kpi.margin(facts.operations(spark, folder))


@registered
def kpi_labor_pct(spark, folder):
    return kpi.labor_share(facts.operations(spark, folder))


@registered
def kpi_pack(spark, folder):
    return kpi.with_latest(kpi.metric_pack(facts.operations(spark, folder)))


@registered
def kpi_month_over_month(spark, folder):
    return kpi.monthly_revenue_change(facts.operations(spark, folder)).orderBy("month")


@registered
def kpi_latest_month(spark, folder):
    return kpi.latest_month(facts.operations(spark, folder))


@registered
def kpi_by_region(spark, folder):
    return kpi.region_and_location(facts.operations(spark, folder))


@registered
def kpi_mom_calendar(spark, folder):
    ops = facts.operations(spark, folder)
    return kpi.monthly_revenue_change(ops, ["location_id"], adjacent_only=True)


@registered
def chart_actual_vs_budget(spark, folder):
    return charts.chart_data(facts.operations(spark, folder), "actual_vs_budget")


@registered
def chart_monthly_trend(spark, folder):
    return charts.chart_data(facts.operations(spark, folder), "monthly_revenue")


@registered
def chart_largest_variances(spark, folder):
    return charts.chart_data(facts.operations(spark, folder), "largest_variances")


@registered
def chart_largest_variances_by_source(spark, folder):
    """As a batch report has them: the three widest of each source."""
    ops = facts.operations(spark, folder).withColumn("source", F.coalesce("region", F.lit("unknown")))
    return charts.widest_variances(ops, count=3, by=["source"])


@registered
def chart_largest_variances_by_region(spark, folder):
    widest = charts.widest_variances(facts.operations(spark, folder), "region")
    return widest.select("region", "variance_amount", "absolute_variance")


# Report text


def _region_pack(spark: SparkSession, folder: str) -> DataFrame:
    return kpi.metric_pack(facts.operations(spark, folder), ["region"])


@registered
def report_narrative(spark, folder):
    return narrative.kpi_narrative(_region_pack(spark, folder), ["region"])


@registered
def report_facts_json(spark, folder):
    # Read for the KPIs, the keys and the rows.
    ops = durable(facts.with_source_year(facts.operations_with_faults(spark, folder)))
    lines = narrative.facts_json(kpi.metric_pack(ops, ["source"]), quality.all_issues(ops), "source")
    return narrative.facts_values(lines, "source")


@registered
def render_claims(spark, folder):
    claims = narrative.supported(narrative.kpi_claims(_region_pack(spark, folder), ["region"]))
    return narrative.render_claims(claims).select("region", "text")


@registered
def split_summary(spark, folder):
    return narrative.split_at_findings(render_claims(spark, folder)).select(
        "region", "before", "after"
    )


# Documents and retrieval


@registered
def section_chunks(spark, folder):
    pages = facts.transcript_pages(spark, folder)
    return chunks.markdown_page_sections(pages, "conv_id", "turn", ties=["role", "text"])


@registered
def document_sections(spark, folder):
    return chunks.markdown_sections(facts.web_documents(spark, folder), "page_id")


@registered
def paged_section_chunks(spark, folder):
    pages = facts.numbered_pages(spark, folder)
    sections = chunks.numbered_page_sections(pages, "conv_id", "turn", ties=["role", "text"])
    return sections.select("conv_id", "section_no", "section", "text", "page")


@registered
def fixed_chunks(spark, folder):
    documents = facts.table(spark, folder, "documents")
    return chunks.fixed_chunks(documents, "doc_id").select("doc_id", "chunk_no", "text")


@registered
def paged_fixed_chunks(spark, folder):
    pages = facts.table(spark, folder, "conversations")
    pieces = chunks.fixed_page_chunks(pages, "conv_id", "turn", ties=["role", "text"])
    return pieces.select("conv_id", "chunk_no", "page", "text")


@registered
def corpus_build(spark, folder):
    markdown = section_chunks(spark, folder)
    paged = paged_section_chunks(spark, folder)
    return chunks.corpus(markdown, paged, "conv_id").select(
        "chunk_id", "document", "source_type", "section", "page"
    )


@registered
def knn_top3(spark, folder):
    vectors = facts.table(spark, folder, "embeddings")
    # The scorecards and citations ask the same corpus: whichever comes first packs it.
    index = nearest.corpus_index(vectors, k=3, carry=["label"])
    hits = nearest.nearest(vectors, vectors, k=3, carry=["label"], skip_same_id=True, index=index)
    return hits.select("query_id", "rank", "vec_id", "label", "distance")


@registered
def knn_citation(spark, folder):
    return nearest.citations(knn_top3(spark, folder), ["vec_id", "label"])


def _labelled_hits(spark: SparkSession, folder: str) -> DataFrame:
    expected = facts.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("label").alias("expected")
    )
    return expected.join(knn_top3(spark, folder), "query_id", "left")


@registered
def retrieval_scorecard(spark, folder):
    return scorecards.retrieval_scorecard(
        _labelled_hits(spark, folder), F.col("label") == F.col("expected")
    )


@registered
def routing_scorecard(spark, folder):
    hits = _labelled_hits(spark, folder)
    actual = scorecards.majority_label(hits)
    expected = facts.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("label").alias("expected")
    )
    return scorecards.routing_scorecard(expected.join(actual, "query_id"))


@registered
def corpus_citation(spark, folder):
    """Every turn is a question; the nearest piece of the corpus is cited by document,
    section and page."""
    pieces = durable(
        facts.with_letter_shares(
            chunks.corpus(section_chunks(spark, folder), paged_section_chunks(spark, folder), "conv_id"), "text"
        ).select("chunk_id", "embedding", "document", "source_type", "section", "page")
    )
    turns = facts.table(spark, folder, "conversations")
    questions = durable(
        facts.with_letter_shares(turns, "text").select(
            F.concat_ws("-", "conv_id", "turn", "role").alias("question"), "embedding"
        )
    )
    hits = nearest.nearest(questions, pieces, k=1, query_id="question", vec_id="chunk_id")
    places = pieces.drop("embedding").withColumnRenamed("chunk_id", "vec_id")
    return nearest.citations(
        hits.join(places, "vec_id"), ["vec_id", "document", "source_type", "section", "page"]
    )


@registered
def chunk_strategy_scorecard(spark, folder):
    """Every turn is a question; the right chunk carries the turn's heading."""
    conversations = facts.table(spark, folder, "conversations")
    name = F.concat_ws(" ", F.lit("Conversation"), "conv_id", F.lit("turn"), "turn", "role")
    pages = conversations.withColumn("text", F.concat(F.lit("## "), name, F.lit("\n"), "text"))
    questions = durable(
        facts.with_letter_shares(conversations, "text").select(name.alias("question"), "embedding")
    )
    ties = ["role", "text"]
    strategies = {
        "section": chunks.markdown_page_sections(pages, "conv_id", "turn", ties=ties).withColumnRenamed(
            "section_no", "chunk_no"
        ),
        "fixed": chunks.fixed_page_chunks(pages, "conv_id", "turn", ties=ties),
    }
    hits = None
    for strategy, pieces in strategies.items():
        corpus = durable(
            facts.with_letter_shares(pieces, "text").select(
                F.concat_ws("-", "conv_id", "chunk_no").alias("chunk_id"),
                "embedding",
                F.col("text").alias("chunk"),
            )
        )
        # Only ids go through the search; texts are looked up for its answers.
        found = nearest.nearest(questions, corpus, query_id="question", vec_id="chunk_id")
        texts = corpus.select(F.col("chunk_id").alias("vec_id"), "chunk")
        found = found.join(texts, "vec_id").withColumn("strategy", F.lit(strategy))
        hits = found if hits is None else hits.unionByName(found)
    # The line break keeps 'turn 1' from standing for 'turn 10'.
    line = F.concat(F.lit("## "), F.col("query_id"), F.lit("\n"))
    scores = scorecards.retrieval_scorecard(hits, F.contains("chunk", line), by=["strategy"])
    return scores.select("strategy", "cases", "top1_correct", "top3_correct")
