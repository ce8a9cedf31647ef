"""Quality rules whose limits follow the data.

Each measure of a document is compared with limits taken from a quantile sketch of
its language and source, not with a fixed cutoff. Sketches are small and merge, so
a language's sketch is the merger of its sources' sketches; it stands in where a
source has too few documents. Documents are judged by joining the limits.

DataFrame functions only: words are split, hashed and sorted inside the row.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.session import durable

# Up to this many values a sketch is exact; beyond, ranks are off by well under 1 %.
SKETCH_SIZE = 4096
LEAST_DOCUMENTS = 30
LEAST_WORDS = 50
MOST_REPEATED = 50
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = "[ \t\n\x0b\x0c\r]+"
SYMBOLS = "[#*$%&|<>]"
NO_LETTERS = r"[^\p{L}\p{M}\p{N}]+"

# Each measure with the side on which it can fail, the quantile whose distance from the
# median is the group's spread, how many spreads are allowed, and the least room, for
# groups whose documents are all alike. Bad documents gather on the side that fails, so
# the spread is taken on the other one; shares of repetition are mostly 0 there. Signs
# are characters of words that are no letter, mark or digit.
MEASURES = {
    "sign_share": ("high", 0.1, 6.0, 0.05),
    "word_length": ("both", 0.1, 6.0, 1.1),
    "repeat_share": ("high", 0.9, 12.0, 0.05),
    "dup_line_share": ("high", 0.9, 12.0, 0.25),
}


def counted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_letters (letters, marks and digits) and n_lines (those with a word).

    A null text counts as one without words.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    trimmed = F.btrim(body, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))
    spoken = F.filter(F.split(body, "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "")
    first = docs.withColumn("_words", words).withColumn("_lines", spoken)
    n = F.size("_words")
    # Windows sort by their whole hash, then by place.
    second = (
        first.withColumn("n_words", n.cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", F.regexp_count(body, F.lit(SYMBOLS)).cast("long"))
        .withColumn("n_letters", F.length(F.regexp_replace(body, NO_LETTERS, "")).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("_hashes", F.transform("_words", lambda word: F.xxhash64(word)))
        .drop("_words", "_lines")
    )
    windows = F.expr(
        "CASE WHEN n_words < 3 THEN cast(array() AS array<struct<h: bigint, place: bigint>>) ELSE "
        "transform(slice(_hashes, 1, cast(n_words AS int) - 2), (h, i) -> named_struct("
        "'h', xxhash64(h, _hashes[i + 1], _hashes[i + 2]), 'place', cast(i AS bigint))) END"
    )
    third = second.withColumn("_windows", F.sort_array(windows)).drop("_hashes")
    twice = F.expr(
        "transform(filter(_windows, (w, i) -> "
        "(i > 0 AND w.h = _windows[i - 1].h) OR "
        "(i + 1 < size(_windows) AND w.h = _windows[i + 1].h)), w -> w.place)"
    )
    fourth = third.withColumn("_places", F.sort_array(twice)).drop("_windows")
    # A repeated window covers three words; what the next one covers is not counted twice.
    covered = F.expr(
        "aggregate(_places, cast(named_struct('n', 0L, 'last', -3L) AS struct<n: bigint, last: bigint>), "
        "(a, p) -> named_struct('n', a.n + least(3L, p - a.last), 'last', p), a -> a.n)"
    )
    return fourth.withColumn("n_repeat_words", covered).drop("_places")


def base_failed() -> Column:
    """The fixed part of the rules: too few words, or mostly repeated windows."""
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")
    )


def _measured(counts: DataFrame) -> DataFrame:
    words = F.nullif(F.col("n_words"), F.lit(0)).cast("double")
    return (
        counts.withColumn("sign_share", (F.col("word_chars") - F.col("n_letters")) / words)
        .withColumn("word_length", F.col("word_chars") / words)
        .withColumn("repeat_share", F.col("n_repeat_words") / words)
        .withColumn("dup_line_share", F.col("n_dup_lines") / F.nullif(F.col("n_lines"), F.lit(0)))
    )


def sketches(measured: DataFrame, by: list[str]) -> DataFrame:
    """One mergeable quantile sketch per group and measure, over all documents that pass the
    fixed rules."""
    return (
        measured.where(~base_failed())
        .groupBy(*by)
        .agg(
            F.count("*").alias("documents"),
            *[F.kll_sketch_agg_double(m, F.lit(SKETCH_SIZE)).alias(m) for m in MEASURES],
        )
    )


def merged(parts: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of coarser groups from those of finer ones."""
    grouped = parts.groupBy(*by) if by else parts.groupBy()
    return grouped.agg(
        F.sum("documents").alias("documents"),
        *[F.kll_merge_agg_double(m, F.lit(SKETCH_SIZE)).alias(m) for m in MEASURES],
    )


def limits(parts: DataFrame, by: list[str]) -> DataFrame:
    """Lowest and highest accepted value of each measure per group.

    A limit lies a number of spreads beyond the median; the spread is the distance from
    the median to a quantile of the group (see ``MEASURES``). A group with few documents
    has the limits of its language, or of all.
    """

    def bounds(groups: DataFrame, name: str) -> DataFrame:
        columns = []
        for m, (side, rank, spreads, room) in MEASURES.items():
            middle = F.kll_sketch_get_quantile_double(m, F.lit(0.5))
            spread = F.abs(F.kll_sketch_get_quantile_double(m, F.lit(rank)) - middle)
            reach = F.greatest(spreads * spread, F.lit(room))
            low = F.lit(float("-inf")) if side == "high" else middle - reach
            high = F.lit(float("inf")) if side == "low" else middle + reach
            columns += [low.alias(f"{m}_low"), high.alias(f"{m}_high"), (spreads * spread > room).alias(f"{m}_own")]
        return groups.where("documents > 0").select(*[c for c in by if c in groups.columns], "documents", F.struct(*columns).alias(name))

    language = by[:1]
    fine, middle, whole = bounds(parts, "own"), bounds(merged(parts, language), "wide"), bounds(merged(parts, []), "all")
    wide = middle.withColumnRenamed("documents", "wide_documents").withColumnRenamed(by[0], "_language")
    joined = fine.join(wide, fine[by[0]].eqNullSafe(F.col("_language")))
    # One row of a few numbers, the limits of the merger of every sketch.
    last = whole.first()
    numbers = last["all"].asDict() if last else {}
    fallback = F.struct(*[F.lit(v).alias(k) for k, v in numbers.items()]) if numbers else F.col("own")
    chosen = (
        F.when(F.col("documents") >= LEAST_DOCUMENTS, F.col("own"))
        .when(F.col("wide_documents") >= LEAST_DOCUMENTS, F.col("wide"))
        .otherwise(fallback)
    )
    return joined.select(*by, chosen.alias("limits"))


def judged(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    keep_text: bool = False,
) -> DataFrame:
    """The columns of ``docs``, the text only if asked for, with the counts,
    base_failed and kept.

    A document is kept if it passes the fixed rules and each measure is within the
    limits of its language and source, taken over the documents there that pass them.
    Null languages and sources are groups of their own. Documents without a word fail.
    Columns of ``docs`` that have the name of a count or verdict are handed on as
    ``_given_`` and that name. Limits are written before they are used, so all rows are
    judged by the same ones.
    """
    helpers = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_letters", "n_lines"]
    clash = {c: f"_given_{c}" for c in docs.columns if c in (*helpers, *MEASURES, "limits", "base_failed", "kept")}
    plain = docs.withColumnsRenamed(clash)
    counts = counted(plain, text)
    counts = durable(counts if keep_text else counts.drop(text))
    measured = _measured(counts)
    by = [lang, source]
    allowed = durable(limits(durable(sketches(measured, by)), by)).withColumnsRenamed(
        {lang: "_lang", source: "_source"}
    )
    match = measured[lang].eqNullSafe(F.col("_lang")) & measured[source].eqNullSafe(F.col("_source"))
    within = None
    for m in MEASURES:
        value = F.col(m)
        fits = (value >= F.col(f"limits.{m}_low")) & (value <= F.col(f"limits.{m}_high"))
        within = fits if within is None else within & fits
    joined = measured.join(allowed, match, "left")
    return (
        joined.withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(within, F.lit(False)))
        .drop("_lang", "_source", "limits", "n_letters", "n_lines", *MEASURES)
    )
