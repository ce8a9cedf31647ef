"""Reading operations files: headers, types, missing tokens, rejected rows."""

import csv
from collections.abc import Iterable, Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.functions.coerce import (
    DAY_FORMATS,
    as_day,
    as_number,
    as_text,
    known,
    order_votes,
)
from tallyward.schema import (
    ABSENT_COLUMN,
    EXPENSE_COLUMNS,
    MANIFEST_RULES,
    MONTH_COLUMN,
    NUMERIC_COLUMNS,
    REQUIRED_COLUMNS,
    RAW_MONTH_COLUMN,
    ROW_INDEX_COLUMN,
    SOURCE_COLUMN,
    TEXT_COLUMNS,
)
from tallyward.session import durable

FORMATS = ("csv", "json", "parquet")
OVERFLOW_COLUMN = "_overflow"
_FILE, _BLOCK, _ORDER = "_file", "_block", "_order"
_DAY_FIRST = "_day_first"
DAY_ORDERS = ("month", "day", "vote")


def table_format(path: str) -> str:
    """The format a path's suffix stands for."""
    suffix = PurePosixPath(path.rstrip("/")).suffix.lower().lstrip(".")
    if suffix not in FORMATS:
        raise ValueError(f"Cannot read {path!r}: use one of {', '.join(FORMATS)}")
    return suffix


def clean_name(header: str) -> str:
    return header.strip().lower().replace(" ", "_").replace("-", "_")


def clean_names(headers: Iterable[str]) -> list[str]:
    """Normalised column names; two headers must not become the same name."""
    names = [clean_name(h) for h in headers]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"Columns with the same name after normalising: {', '.join(twice)}")
    return names


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_names(df.columns))


def normalize_types(
    df: DataFrame,
    day_formats: Sequence[str] = DAY_FORMATS,
    keep_raw_month: bool = False,
    day_first: Column | None = None,
) -> DataFrame:
    """Known columns in their types; cells that do not fit become NULL.

    Missing tokens become NULL in every text column. Columns nothing is known
    about keep their type. ``keep_raw_month`` keeps the month as text too, for
    the rule on unreadable months. ``day_first`` tells rows whose month cells have
    the day before the month. One projection, no shuffle.
    """
    columns = []
    if keep_raw_month and MONTH_COLUMN in df.columns:
        raw = as_text(F.col(MONTH_COLUMN), df.schema[MONTH_COLUMN].dataType)
        columns.append(raw.alias(RAW_MONTH_COLUMN))
    for field in df.schema.fields:
        name, dtype = field.name, field.dataType
        column = F.col(f"`{name}`")
        if name in NUMERIC_COLUMNS:
            column = as_number(column, dtype)
        elif name in TEXT_COLUMNS:
            column = as_text(column, dtype)
        elif name == MONTH_COLUMN:
            column = as_day(column, dtype, day_formats, day_first)
        elif isinstance(dtype, T.StringType) and name != SOURCE_COLUMN:
            column = known(column)
        columns.append(column.alias(name))
    return df.select(*columns)


def _plain_path(path: Column) -> Column:
    """A path as written, whichever way Spark shows it."""
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(decoded, "^file:/+", "file:/")


def _listed_path() -> Column:
    return F.regexp_replace("path", "^file:/+", "file:/")


def _folder(spark: SparkSession, paths: list[str]) -> str:
    """The folder that all files lie in; refuses a batch with an empty or no file.

    Files are listed, not read.
    """
    files = spark.read.format("binaryFile").load(paths)
    name = _listed_path()
    found = files.agg(
        F.min(name), F.max(name), F.min(F.when(F.col("length") == 0, name))
    ).first()
    first, last, empty = found
    if first is None:
        raise ValueError(f"Nothing to read in {paths}")
    if empty is not None:
        raise ValueError(f"{empty} is empty")
    # What the least and the greatest path have in common, all have.
    same = next((i for i, (a, b) in enumerate(zip(first, last)) if a != b), len(first))
    return first[: first[:same].rfind("/") + 1]


def _label(path: Column, folder: str) -> Column:
    """A file's name within the batch: its path below the common folder."""
    return F.substring(path, F.lit(len(folder) + 1), F.length(path))


def _headers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per CSV file: its path and first line. One job for all files."""
    lines = spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"),
    )
    first = lines.where("start = 0").groupBy("path").agg(F.min_by("value", "at").alias("header"))
    return durable(first.select(_plain_path(F.col("path")).alias(_FILE), "header"))


def _cells(header: str) -> tuple[str, ...]:
    return tuple(next(csv.reader([header.lstrip("\ufeff")])))


def _layouts(headers: DataFrame) -> dict[str, list[str]]:
    """Clean column names by header line; as many as there are different ones."""
    return {
        r.header: clean_names(_cells(r.header)) for r in headers.select("header").distinct().collect()
    }


def _absent(names: Iterable[str]) -> list[str]:
    return sorted({*REQUIRED_COLUMNS, *EXPENSE_COLUMNS} - set(names))


def _by_layout(layouts: dict[str, list[str]], value) -> Column:
    """A value by the header line of the row's file."""
    chosen = None
    for header, names in layouts.items():
        case = F.col("header") == header
        chosen = F.when(case, value(names)) if chosen is None else chosen.when(case, value(names))
    return chosen


def _absent_list(names: Iterable[str]) -> Column:
    return F.array(*[F.lit(c) for c in _absent(names)]).cast("array<string>")


def _csv_rows(
    spark: SparkSession, paths: list[str], headers: DataFrame, multiline: bool
) -> DataFrame:
    """Rows of all files by their own headers, in one scan.

    Cells are read by place. With one header line for all files, places are
    columns. With several, the row's file is looked up, and each column is
    taken from where that file has it.
    """
    layouts = _layouts(headers)
    width = max(map(len, layouts.values())) + 1
    cells = [f"_c{i}" for i in range(width)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cells])
    reader = spark.read.schema(schema).options(header=True, escape='"', multiLine=multiline)
    rows = reader.csv(paths).select(
        *cells,
        _plain_path(F.col("_metadata.file_path")).alias(_FILE),
        F.col("_metadata.file_block_start").alias(_BLOCK),
    )
    names = list(dict.fromkeys(n for own in layouts.values() for n in own))
    if len(layouts) == 1:
        columns = [F.col(c).alias(n) for c, n in zip(cells, names)]
        overflow, absent = F.col(cells[-1]), _absent_list(names)
    else:
        rows = rows.join(headers, _FILE)

        def cell(name: str) -> Column:
            # A file without the column has no case, hence NULL.
            has = {h: own for h, own in layouts.items() if name in own}
            return _by_layout(has, lambda own: F.col(cells[own.index(name)])).alias(name)

        columns = [cell(n) for n in names]
        overflow = _by_layout(layouts, lambda own: F.col(cells[len(own)]))
        absent = _by_layout(layouts, _absent_list)
    return rows.select(
        *columns, overflow.alias(OVERFLOW_COLUMN), absent.alias(ABSENT_COLUMN), _FILE, _BLOCK
    )


def source_files(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """One row per file: ``source`` and the known columns it does not have.

    Also names the files without a data row, which no scan of the rows shows.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    folder = _folder(spark, paths)
    kind = table_format(paths[0])
    if kind == "csv":
        headers = _headers(spark, paths)
        absent = _by_layout(_layouts(headers), _absent_list)
        path = F.col(_FILE)
    else:
        headers = spark.read.format("binaryFile").load(paths)
        absent = _absent_list(clean_names(spark.read.format(kind).load(paths).columns))
        path = _listed_path()
    return headers.select(_label(path, folder).alias(SOURCE_COLUMN), absent.alias(ABSENT_COLUMN))


def _with_row_index(df: DataFrame) -> DataFrame:
    """Add the 0-based row number within its file.

    A file is read in blocks. Row ids rise within a block, so a row's place in
    its block plus the rows in the file's earlier blocks is its number; only
    one count per block is ordered.
    """
    rows = df.withColumn(_ORDER, F.monotonically_increasing_id())
    blocks = rows.groupBy(
        F.col(_FILE).alias("_of"), F.col(_BLOCK).alias("_at")
    ).agg(F.count("*").alias("_rows"), F.min(_ORDER).alias("_first"))
    earlier = (
        Window.partitionBy("_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    )
    base = F.coalesce(F.sum("_rows").over(earlier), F.lit(0))
    blocks = blocks.select("_of", "_at", (base - F.col("_first")).alias("_shift"))
    joined = rows.join(
        blocks, (F.col(_FILE) == F.col("_of")) & (F.col(_BLOCK) == F.col("_at"))
    )
    return joined.withColumn(ROW_INDEX_COLUMN, F.col(_ORDER) + F.col("_shift")).drop(
        "_of", "_at", "_shift", _ORDER
    )


def read_raw(
    spark: SparkSession,
    paths: str | Sequence[str],
    multiline: bool = False,
    row_index: bool = False,
) -> DataFrame:
    """All files as one table with clean headers: text cells for CSV, plus
    ``source`` (the path below the folder the files share, so the file name
    where they lie in one folder) and the columns each file does not have.

    Every CSV file is read by its own header line. ``multiline`` allows line
    breaks in quoted cells, at the price of one task per file. ``row_index``
    numbers the rows. Lists the files and reads their headers, in one job each.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    kinds = {table_format(p) for p in paths}
    if len(kinds) > 1:
        raise ValueError(f"One format at a time, not {sorted(kinds)}")
    kind = kinds.pop()
    folder = _folder(spark, paths)
    if kind == "csv":
        whole = _csv_rows(spark, paths, _headers(spark, paths), multiline)
        whole = _with_row_index(whole) if row_index else whole
        named = whole.withColumn(SOURCE_COLUMN, _label(F.col(_FILE), folder))
        return named.drop(_BLOCK, _FILE)
    df = spark.read.format(kind).load(paths)
    if not df.columns:
        raise ValueError(f"{paths} has no columns")
    names = clean_names(df.columns)
    extra = {SOURCE_COLUMN: _label(_plain_path(F.col("_metadata.file_path")), folder)}
    if row_index and kind == "parquet":
        extra[ROW_INDEX_COLUMN] = F.col("_metadata.row_index")
    kept = df.withColumns(extra).toDF(*names, *extra)
    return kept.withColumn(ABSENT_COLUMN, _absent_list(kept.columns))


def rejected_rows(raw: DataFrame) -> DataFrame:
    """CSV rows with more cells than the header has."""
    if OVERFLOW_COLUMN not in raw.columns:
        return raw.limit(0)
    return raw.where(F.col(OVERFLOW_COLUMN).isNotNull())


def accepted_rows(raw: DataFrame) -> DataFrame:
    if OVERFLOW_COLUMN not in raw.columns:
        return raw
    return raw.where(F.col(OVERFLOW_COLUMN).isNull()).drop(OVERFLOW_COLUMN)


def day_orders(raw: DataFrame) -> DataFrame:
    """How each source writes its days: ``source``, the votes of its month cells (see
    ``order_votes``), ``day_order`` (day or month, what more cells say) and ``ambiguous``.

    Where as many cells speak for either order, none among them, the month comes first,
    and a source with cells of that shape is ambiguous. Sums of sums, so a source may
    hold any share of the rows. A table without sources is one, named NULL.
    """
    dtype = raw.schema[MONTH_COLUMN].dataType
    cell = known(F.col(MONTH_COLUMN)) if isinstance(dtype, T.StringType) else F.lit(None).cast("string")
    name = F.col(SOURCE_COLUMN) if SOURCE_COLUMN in raw.columns else F.lit(None).cast("string")
    votes = raw.groupBy(name.alias(SOURCE_COLUMN)).agg(*order_votes(cell))
    return votes.withColumns(
        {
            "day_order": F.when(F.col("day_first") > F.col("month_first"), "day").otherwise("month"),
            "ambiguous": (F.col("slashed") > 0) & (F.col("day_first") == F.col("month_first")),
        }
    )


def _typed(
    rows: DataFrame, day_formats: Sequence[str], keep_raw_month: bool, day_order: str
) -> DataFrame:
    if day_order not in DAY_ORDERS:
        raise ValueError(f"No day order {day_order!r}: use one of {', '.join(DAY_ORDERS)}")
    if day_order == "month" or MONTH_COLUMN not in rows.columns:
        return normalize_types(rows, day_formats, keep_raw_month)
    if day_order == "day":
        return normalize_types(rows, day_formats, keep_raw_month, F.lit(True))
    settled = durable(
        day_orders(rows).select(
            F.col(SOURCE_COLUMN).alias("_of"), (F.col("day_order") == "day").alias(_DAY_FIRST)
        )
    )
    name = F.col(SOURCE_COLUMN) if SOURCE_COLUMN in rows.columns else F.lit(None).cast("string")
    known_rows = rows.join(settled, name.eqNullSafe(F.col("_of")), "left").drop("_of")
    first = F.coalesce(_DAY_FIRST, F.lit(False))
    return normalize_types(known_rows, day_formats, keep_raw_month, first).drop(_DAY_FIRST)


def load(
    source: DataFrame | str | Sequence[str],
    spark: SparkSession | None = None,
    day_formats: Sequence[str] = DAY_FORMATS,
    keep_raw_month: bool = False,
    day_order: str = "month",
    **options,
) -> DataFrame:
    """A normalised operations table from paths or from a DataFrame.

    ``day_order`` is how cells such as 1/2/2025 are read: month first, day first, or by
    a vote of all cells of the source, which costs one more scan of the month cells.
    """
    if isinstance(source, DataFrame):
        return _typed(normalize_headers(source), day_formats, keep_raw_month, day_order)
    spark = spark or SparkSession.active()
    rows = accepted_rows(read_raw(spark, source, **options))
    return _typed(rows, day_formats, keep_raw_month, day_order)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Expected issues per file: source, issue_type, expected. A clean file has
    no issue type and expects none."""
    manifest = spark.read.json(path, multiLine=True)
    faulty = manifest.select(F.explode("corrupted_files").alias("case")).select(
        F.col("case.file").alias("source"),
        F.create_map(*[F.lit(v) for pair in MANIFEST_RULES.items() for v in pair])[
            F.col("case.rule")
        ].alias("issue_type"),
        F.col("case.expected_issue_count").cast("bigint").alias("expected"),
    )
    clean = manifest.select(
        F.col("clean_file").alias("source"),
        F.lit(None).cast("string").alias("issue_type"),
        F.lit(0).cast("bigint").alias("expected"),
    )
    return faulty.unionByName(clean)


def preview(df: DataFrame, order: Sequence[str], rows: int = 20) -> DataFrame:
    return df.orderBy(*order).limit(rows)


def profile(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("row_count")).withColumn(
        "column_count", F.lit(len(df.columns))
    )


def _row_hash(names: Sequence[str]) -> Column:
    """Fifteen digits of the MD5 of all cells. Each cell goes in with its length, a
    missing one as a mark of its own, so that no value can move to a neighbouring cell
    unnoticed."""

    def cell(name: str) -> Column:
        text = F.col(f"`{name}`").cast("string")
        tagged = F.concat(F.length(text).cast("string"), F.lit(":"), text)
        return F.coalesce(tagged, F.lit("-"))

    digits = F.substring(F.md5(F.concat(*[cell(c) for c in names])), 1, 15)
    return F.conv(digits, 16, 10)


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and a content hash that does not depend on row order: the hashes of
    all rows added up."""
    return df.agg(
        F.count("*").alias("row_count"),
        F.coalesce(F.sum(_row_hash(df.columns).cast("decimal(20,0)")), F.lit(0)).cast("string").alias("fingerprint"),
    )


# Two polynomials, each over a prime below 2 ** 31, so that products fit a long.
POLYNOMIALS = ((2147483647, 1000003), (2147483629, 998244353))
POSITION_BITS = 62


def _power(exponent: Column, prime: int, base: int, bits: int) -> Column:
    """base ** exponent modulo the prime, by the bits of the exponent."""
    squares = F.array(
        *[F.struct(F.lit(i).alias("bit"), F.lit(pow(base, 1 << i, prime)).cast("bigint").alias("factor")) for i in range(bits)]
    )

    def step(result: Column, square: Column) -> Column:
        is_set = F.call_function("shiftright", exponent, square["bit"]).bitwiseAND(F.lit(1).cast("bigint")) == 1
        return F.when(is_set, F.pmod(result * square["factor"], F.lit(prime))).otherwise(result)

    return F.aggregate(squares, F.lit(1).cast("bigint"), step)


def span_digests(df: DataFrame, position: str, span: int = 4096) -> DataFrame:
    """span, row_count, first and second: for every ``span`` positions how many rows lie
    there, and a digest of what stands where.

    ``position`` is a whole number from 0, such as a row number; rows without one are the
    span that has no number, and their order does not count. A digest is a pair of
    polynomials, each row's hash being the coefficient of its place in the span. So two
    rows that change places change it, and comparing the digests of two versions tells
    where they differ. Rows are neither moved nor sorted: digests are sums, put together
    from those of the tasks.
    """
    place = F.col(position).cast("bigint")
    inside = F.coalesce(F.pmod(place, F.lit(span)), F.lit(0)).cast("bigint")
    digits = _row_hash([c for c in df.columns if c != position]).cast("bigint")
    narrow = df.select(
        F.expr(f"cast(floor(`{position}` / {span}) AS bigint)").alias("span"), inside.alias("inside"), digits.alias("digits")
    )
    terms = [
        F.pmod(F.pmod("digits", F.lit(prime)) * _power(F.col("inside"), prime, base, span.bit_length()), F.lit(prime)).alias(name)
        for name, (prime, base) in zip(("first", "second"), POLYNOMIALS, strict=True)
    ]
    sums = [
        F.pmod(F.sum(name), F.lit(prime)).cast("bigint").alias(name)
        for name, (prime, _) in zip(("first", "second"), POLYNOMIALS, strict=True)
    ]
    return narrow.select("span", *terms).groupBy("span").agg(F.count("*").alias("row_count"), *sums)


def ordered_fingerprint(df: DataFrame, position: str, span: int = 4096) -> DataFrame:
    """Row count and a content hash that depends on which row stands where, put together
    from :func:`span_digests`. The same for any ``span``."""
    return joined_digests(span_digests(df, position, span), span)


def joined_digests(digests: DataFrame, span: int = 4096) -> DataFrame:
    """One fingerprint of many spans, each shifted to its place. Where a batch is
    appended, its spans' digests join those that were kept."""
    start = F.coalesce(F.col("span") * span, F.lit(0)).cast("bigint")
    parts = [
        F.pmod(F.sum(F.pmod(F.col(name) * _power(start, prime, base, POSITION_BITS), F.lit(prime))), F.lit(prime))
        for name, (prime, base) in zip(("first", "second"), POLYNOMIALS, strict=True)
    ]
    both = F.concat_ws("-", *[F.coalesce(p.cast("bigint"), F.lit(0)).cast("string") for p in parts])
    rows = F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count")
    return digests.agg(rows, both.alias("fingerprint"))
