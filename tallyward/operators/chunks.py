"""Splitting reference documents into sections and fixed-size chunks.

A whole document in one cell is split inside its row, without a shuffle. A
document that comes as pages (one row each) is split inside every row too; only
the pieces of sections that reach over a page break are put together again.
Page numbers are unique within a document.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.positions import running_before
from tallyward.functions.text import plain_lines, strip

# What opens a section, and the chunk length in characters.
MARKDOWN_HEADING = "## "
NUMBERED_HEADING = r"(?U)[^\S\n]*\d+\."
CHUNK_CHARACTERS = 500


def _pieces(text: Column, opening: str) -> Column:
    """Text before the first heading, then one piece per heading. Lines start
    after a newline, so one is put in front; it is taken off piece 0 later."""
    return F.split(F.concat(F.lit("\n"), plain_lines(text)), f"\n(?={opening})")


def _first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def _markdown_name(piece: Column) -> Column:
    return strip(F.substring(_first_line(piece), 4, 1 << 30))


def markdown_sections(df: DataFrame, document: str, text: str = "text") -> DataFrame:
    """Sections of whole Markdown documents: document, section_no, section, text.

    Text before the first heading is left out; a document without a heading is
    one section without a name. Sections are numbered from 1 (0 when unnamed).
    """
    cut = df.where(F.col(text).isNotNull()).select(
        document, _pieces(F.col(text), MARKDOWN_HEADING).alias("_cut")
    )
    # A split has at least one piece, so the outer form changes nothing but
    # the plan: the plain one adds a filter that splits every text again.
    exploded = cut.select(document, "_cut", F.size("_cut").alias("_pieces")).select(
        document, "_pieces", F.posexplode_outer("_cut").alias("section_no", "piece")
    )
    kept = exploded.where((F.col("section_no") > 0) | (F.col("_pieces") == 1))
    named = F.when(F.col("section_no") > 0, _markdown_name(F.col("piece")))
    number = F.col("section_no").cast("bigint").alias("section_no")
    return kept.select(
        document, number, named.alias("section"), strip(F.col("piece")).alias("text")
    )


def _page_pieces(
    pages: DataFrame, document: str, page: str, text: str, ties: Sequence[str], opening: str
) -> DataFrame:
    """One row per piece: section number, order within the section, text."""
    cut = pages.where(F.col(text).isNotNull()).select(
        F.col(document).alias("_doc"),
        F.col(page).alias("_page"),
        F.struct(F.col(page).cast("bigint").alias("page"), *ties).alias("_at"),
        F.substring_index(F.col(text), "\n", 1).alias("_line"),
        F.when(F.col(text) == "", F.array(F.lit(""))).otherwise(
            _pieces(F.col(text), opening)
        ).alias("_cut"),
    )
    cut = cut.withColumn("_headings", F.size("_cut") - 1)
    numbered = running_before(cut, "_doc", "_page", "_headings", ties=["_at"])
    return numbered.select(
        "_doc",
        "_at",
        "_line",
        "group_total",
        F.col("before"),
        F.posexplode_outer("_cut").alias("_n", "_piece"),
    ).select(
        F.col("_doc").alias(document),
        (F.col("before") + F.col("_n")).cast("bigint").alias("section_no"),
        F.struct("_at", "_n").alias("_order"),
        "group_total",
        F.when(F.col("_n") > 0, _first_line(F.col("_piece"))).otherwise(F.col("_line")).alias("_name"),
        # An empty piece 0 adds no line; otherwise it starts with the newline
        # that was put in front.
        F.when(F.col("_n") > 0, F.col("_piece"))
        .when(F.col("_piece") != "", F.expr("substring(_piece, 2)"))
        .alias("_lines"),
        F.col("_at.page").alias("_page"),
    )


def _joined(pieces: DataFrame, document: str) -> DataFrame:
    lines = F.array_sort(F.collect_list(F.struct("_order", "_lines")))
    return pieces.groupBy(document, "section_no").agg(
        F.array_join(F.transform(lines, lambda p: p["_lines"]), "\n").alias("_text"),
        F.min_by("_name", "_order").alias("_name"),
        F.min("_page").alias("page"),
        F.first("group_total").alias("_headings"),
    )


def markdown_page_sections(
    pages: DataFrame, document: str, page: str, text: str = "text", ties: Sequence[str] = ()
) -> DataFrame:
    """:func:`markdown_sections` for documents that come as ordered pages."""
    pieces = _page_pieces(pages, document, page, text, ties, MARKDOWN_HEADING)
    # Text before the first heading goes before anything is shuffled.
    pieces = pieces.where((F.col("section_no") > 0) | (F.col("group_total") == 0))
    return _joined(pieces, document).select(
        document,
        "section_no",
        F.when(F.col("section_no") > 0, _markdown_name(F.col("_name"))).alias("section"),
        strip(F.col("_text")).alias("text"),
    )


def numbered_page_sections(
    pages: DataFrame, document: str, page: str, text: str = "text", ties: Sequence[str] = ()
) -> DataFrame:
    """Sections under numbered heading lines, over page breaks, with start page.

    What stands before the first heading is section 0, named by the first line
    of the document and flagged ``is_empty`` when the document opens with a
    heading.
    """
    pieces = _page_pieces(pages, document, page, text, ties, NUMBERED_HEADING)
    sections = _joined(pieces, document).select(
        document,
        "section_no",
        F.col("_name").alias("section"),
        strip(F.col("_text")).alias("text"),
        "page",
    )
    return sections.withColumn("is_empty", F.col("text") == "")


def _windows(text: Column, size: int) -> Column:
    """Consecutive pieces of ``size`` characters, found in one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{int(size)}}}"), F.lit(0))


def fixed_chunks(
    df: DataFrame, document: str, text: str = "text", size: int = CHUNK_CHARACTERS
) -> DataFrame:
    """Chunks of ``size`` characters, stripped: document, chunk_no, section, text."""
    exploded = df.select(
        document, F.posexplode(_windows(F.col(text), size)).alias("chunk_no", "_piece")
    )
    return exploded.select(
        document,
        F.col("chunk_no").cast("bigint").alias("chunk_no"),
        F.concat(F.lit("chunk_"), F.col("chunk_no").cast("string")).alias("section"),
        strip(F.col("_piece")).alias("text"),
    )


def fixed_page_chunks(
    pages: DataFrame,
    document: str,
    page: str,
    text: str = "text",
    ties: Sequence[str] = (),
    size: int = CHUNK_CHARACTERS,
) -> DataFrame:
    """:func:`fixed_chunks` within each page, numbered through the document."""
    columns = list(dict.fromkeys([document, page, text, *ties]))
    counted = pages.select(*columns).withColumn(
        "_chunks", F.coalesce(F.ceil(F.length(text) / size), F.lit(0))
    )
    numbered = running_before(counted, document, page, "_chunks", ties)
    exploded = numbered.select(
        document,
        F.col(page).alias("page"),
        "before",
        F.posexplode(_windows(F.col(text), size)).alias("_n", "_piece"),
    )
    number = (F.col("before") + F.col("_n")).cast("bigint")
    return exploded.select(
        document,
        number.alias("chunk_no"),
        F.concat(F.lit("chunk_"), number.cast("string")).alias("section"),
        "page",
        strip(F.col("_piece")).alias("text"),
    )


def corpus(markdown: DataFrame, paged: DataFrame, document: str) -> DataFrame:
    """Markdown and paged sections as one table with an id made of the place."""

    def tagged(df: DataFrame, source_type: str) -> DataFrame:
        return df.select(
            F.concat_ws(
                "-", F.lit(source_type), F.col(document).cast("string"), F.col("section_no").cast("string")
            ).alias("chunk_id"),
            F.col(document).cast("string").alias("document"),
            F.lit(source_type).alias("source_type"),
            "section",
            "text",
            *([F.col("page")] if "page" in df.columns else []),
        )

    return tagged(markdown, "markdown").unionByName(
        tagged(paged, "paged"), allowMissingColumns=True
    )
