"""Names and types of the operations table and of the issue table."""

from pyspark.sql import types as T

# Column names, rule names and severities other tools rely on.
TEXT_COLUMNS = ("location_id", "location_name", "region")
MONTH_COLUMN = "month"
NUMERIC_COLUMNS = (
    "revenue",
    "budget_revenue",
    "labor_expense",
    "other_expense",
    "total_expense",
    "volume",
)
REQUIRED_COLUMNS = (
    "location_id",
    "location_name",
    "region",
    "month",
    "revenue",
    "budget_revenue",
    "labor_expense",
    "other_expense",
    "volume",
)
KEY_COLUMNS = ("location_id", "month")
EXPENSE_COLUMNS = ("labor_expense", "other_expense", "total_expense")

ISSUE_TYPES = (
    "missing_required_column",
    "duplicate_record",
    "missing_value",
    "impossible_value",
    "reconciliation_error",
)
MANIFEST_RULES = {
    "required_columns": "missing_required_column",
    "duplicate_records": "duplicate_record",
    "missing_values": "missing_value",
    "impossible_values": "impossible_value",
    "reconciliation": "reconciliation_error",
}
SEVERITIES = ("error", "warning")

# Cells that count as missing in delimited text.
MISSING_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Carried by batches whose files differ in layout: the required or expense
# columns the row's own file does not have.
ABSENT_COLUMN = "_absent_columns"
# Carried on request: the month cell as text, which turns on the rule that a
# month nobody can read is an impossible value, not a missing one.
RAW_MONTH_COLUMN = "_raw_month"
SOURCE_COLUMN = "source"
ROW_INDEX_COLUMN = "row_index"

ISSUE_SCHEMA = T.StructType(
    [
        T.StructField("rule_order", T.IntegerType(), False),
        T.StructField("issue_type", T.StringType(), False),
        T.StructField("severity", T.StringType(), False),
        T.StructField("source", T.StringType()),
        T.StructField("location_id", T.StringType()),
        T.StructField("month", T.DateType()),
        T.StructField("column_name", T.StringType()),
        T.StructField("row_index", T.LongType()),
        T.StructField("observed", T.StringType()),
        T.StructField("explanation", T.StringType()),
        T.StructField("suggested_action", T.StringType()),
    ]
)

CLAIM = T.StructType(
    [
        T.StructField("statement", T.StringType()),
        T.StructField("evidence", T.ArrayType(T.StringType())),
    ]
)
