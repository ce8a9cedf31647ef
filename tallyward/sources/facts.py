"""The location-by-month operations table built from the sales star schema.

A location is a supplier and a month is a ship month. ``operations_with_faults``
is the same table with known faults seeded by key, for the quality rules.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEASURES = (
    "revenue",
    "budget_revenue",
    "labor_expense",
    "other_expense",
    "total_expense",
)


# Stated so that building a plan does not open the files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int,"
    " p_retailprice double",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int,"
    " l_quantity double, l_extendedprice double, l_discount double, l_tax double,"
    " l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def _hundredths(column: str) -> str:
    """Two-decimal amounts as whole hundredths."""
    return f"cast(rint({column} * 100) as bigint)"


def _unit_sum(units: str, name: str) -> Column:
    """Sum of whole numbers as an exact decimal.

    High and low bits are summed apart, both as longs: that stays in generated
    code, where wide decimals do not, and no group is too large for it.
    """
    high = f"cast(sum(shiftright({units}, 20)) as decimal(20,0)) * 1048576"
    low = f"cast(sum(({units}) & 1048575L) as decimal(20,0))"
    return F.expr(f"cast({high} + {low} as decimal(26,0)) as {name}")


def _amount(units: str) -> str:
    """Whole ten-thousandths as a decimal amount."""
    return f"cast(({units}) * 0.0001BD as decimal(24,4))"


def operations(spark: SparkSession, folder: str) -> DataFrame:
    """One row per location and month, money as exact decimals.

    Line items are reduced to (supplier, month) before the supplier is looked
    up, so only the part price is joined at line-item size.
    """
    lines = table(spark, folder, "lineitem").selectExpr(
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "trunc(cast(l_shipdate as date), 'MM') as month",
        f"{_hundredths('l_extendedprice')} as price",
        f"{_hundredths('l_discount')} as discount",
        f"{_hundredths('l_tax')} as tax",
    )
    part = table(spark, folder, "part").selectExpr(
        "p_partkey", f"{_hundredths('p_retailprice')} as retail"
    )
    monthly = (
        lines.join(part, F.expr("l_partkey = p_partkey"))
        .groupBy("l_suppkey", "month")
        .agg(
            _unit_sum("price * (100 - discount)", "revenue"),
            _unit_sum("price * 95", "budget"),
            _unit_sum("price * tax", "labor"),
            _unit_sum("retail * cast(l_quantity as bigint) * 40", "other"),
            F.expr("sum(l_quantity) as volume"),
        )
    )
    # One lookup after the other: the planner knows the size of each file, but
    # not of a join of files, so this way it can tell what fits a broadcast.
    placed = (
        monthly.join(table(spark, folder, "supplier"), F.expr("l_suppkey = s_suppkey"))
        .join(table(spark, folder, "nation"), F.expr("s_nationkey = n_nationkey"))
        .join(table(spark, folder, "region"), F.expr("n_regionkey = r_regionkey"))
    )
    return placed.selectExpr(
        "'SUP-' || lpad(cast(s_suppkey as string), 6, '0') as location_id",
        "s_name as location_name",
        "r_name as region",
        "month",
        f"{_amount('revenue')} as revenue",
        f"{_amount('budget')} as budget_revenue",
        f"{_amount('labor')} as labor_expense",
        f"{_amount('other')} as other_expense",
        f"{_amount('labor + other')} as total_expense",
        "volume",
    )


def fault_key() -> Column:
    return (
        F.substring("location_id", 5, 20).cast("int") * 31
        + F.year("month") * 12
        + F.month("month")
    )


def operations_with_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Blank regions and revenues, wrong totals, negative volumes, repeated rows."""
    base = operations(spark, folder).withColumn("k", fault_key())

    def every(n: int) -> Column:
        return F.col("k") % n == 0

    return base.select(
        "location_id",
        "location_name",
        F.when(~every(89), F.col("region")).alias("region"),
        "month",
        F.when(~every(97), F.col("revenue")).alias("revenue"),
        "budget_revenue",
        "labor_expense",
        "other_expense",
        F.when(every(83), F.col("total_expense") + 5000)
        .otherwise(F.col("total_expense"))
        .cast("decimal(24,4)")
        .alias("total_expense"),
        F.when(every(79), -F.col("volume")).otherwise(F.col("volume")).alias("volume"),
        F.explode(F.when(every(101), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias(
            "copy"
        ),
    ).drop("copy")


def money_as_double(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {name: F.col(name).cast("double") for name in MEASURES if name in df.columns}
    )


def with_source_year(df: DataFrame) -> DataFrame:
    """Add ``source``: one reporting file per location and year."""
    year = F.year("month").cast("string")
    return df.withColumn("source", F.concat_ws("-", "location_id", year))


def transcript_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as Markdown documents, one page and one heading per turn."""
    title = F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n"))
    heading = F.concat(
        F.lit("## "), F.col("turn").cast("string"), F.lit(" "), F.col("role"), F.lit("\n")
    )
    return table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        "role",
        F.concat(F.when(F.col("turn") == 0, title).otherwise(""), heading, F.col("text")).alias("text"),
    )


def web_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Web pages as whole Markdown documents: the page heading opens a section,
    what stands before it is lead-in."""
    opened = F.replace("html", F.lit("<h1>"), F.lit("\n## "))
    return table(spark, folder, "pages").select(
        "page_id", F.replace(opened, F.lit("</h1>"), F.lit("\n")).alias("text")
    )


def numbered_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as paged documents with a numbered heading on every even turn."""
    heading = F.concat(
        (F.col("turn") + 1).cast("string"), F.lit(". "), F.col("role"), F.lit("\n")
    )
    return table(spark, folder, "conversations").select(
        "conv_id",
        "turn",
        "role",
        F.concat(F.when(F.col("turn") % 2 == 0, heading).otherwise(""), F.col("text")).alias("text"),
    )


# The letters whose shares make up a text's vector.
LETTERS = "etaoinshrdlu"


def with_letter_shares(df: DataFrame, text: str, name: str = "embedding") -> DataFrame:
    """Add how often a dozen common letters occur in a text, as shares of their
    sum: a vector that needs no model."""
    counts = [
        F.octet_length("_lower") - F.octet_length(F.replace(F.col("_lower"), F.lit(c), F.lit("")))
        for c in LETTERS
    ]
    names = [f"_{i}" for i in range(len(counts))]
    counted = df.withColumn("_lower", F.lower(text)).withColumns(dict(zip(names, counts)))
    letters = sum((F.col(n) for n in names), F.lit(0))
    counted = counted.withColumn("_letters", F.greatest(letters, F.lit(1)))
    shares = F.array(*[F.col(n) / F.col("_letters") for n in names])
    return counted.withColumn(name, shares).drop("_lower", "_letters", *names)
