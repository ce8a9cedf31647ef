"""Fingerprints of texts by winnowing, and how alike two fingerprints are.

Tokens are words, those of more than 16 code points in pieces of 16. Every run of
``gram`` tokens has a polynomial (Karp-Rabin) hash; of every ``window`` runs in a row
the least hash is chosen, of equal ones the rightmost, and kept with the place of its
first token. So two texts that share ``gram + window - 1`` tokens in a row share a
hash, and no shared run of fewer than ``gram`` tokens makes one.

DataFrame functions only. A text is fingerprinted inside its row, in time and memory
in proportion to its length.
"""

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.llm.sharding import KEY_BITS, splitters
from tallyward.session import durable

GRAM = 5
WINDOW = 8
PIECE = 16
PRIME = (1 << 31) - 1
BASE = 1_000_003
# The hash stands above the place, counted down so that the rightmost is the least.
PLACES = 1 << 31
SPAN_BYTES = 8_000_000
MOST_SPANS = 4096
CELL_BITS = 12


def tokens(text: Column) -> Column:
    """Words, each in pieces of at most ``PIECE`` code points."""
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]{1,%d}" % PIECE), F.lit(0))


def chosen(text: Column, gram: int = GRAM, window: int = WINDOW) -> Column:
    """(hash, place) of every chosen run, in order of place: an array of one long each.
    A text of fewer than ``gram`` tokens is one run, one without tokens has none."""

    def hashed(values: Column) -> Column:
        def run(_, i):
            total = F.get(values, i)
            for step in range(1, gram):
                total = F.pmod(total * BASE + F.coalesce(F.get(values, i + step), F.lit(0)), F.lit(PRIME))
            return total * PLACES + (PLACES - 1 - i)

        many = F.greatest(F.size(values) - (gram - 1), F.least(F.size(values), F.lit(1)))
        return F.transform(F.slice(values, 1, many), run)

    def least(runs: Column) -> Column:
        many = F.greatest(F.size(runs) - (window - 1), F.least(F.size(runs), F.lit(1)))
        # Places beyond the end are null, which least passes over.
        over = lambda own, i: F.least(own, *[F.get(runs, i + step) for step in range(1, window)])
        return F.array_distinct(F.transform(F.slice(runs, 1, many), over))

    word = lambda w: F.conv(F.left(F.md5(w.cast("binary")), F.lit(7)), 16, 10).cast("long") + 1
    return _bound(F.transform(tokens(text), word), lambda v: _bound(hashed(v), least))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), use), 0)


def hashes(picks: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(picks, lambda p: F.call_function("div", p, F.lit(PLACES))))


def written(picks: Column) -> Column:
    """The fingerprint as text: hash:place of every chosen run."""
    one = lambda p: F.concat(
        F.lower(F.hex(F.call_function("div", p, F.lit(PLACES)))),
        F.lit(":"),
        (PLACES - 1 - p % PLACES).cast("string"),
    )
    return F.array_join(F.transform(picks, one), " ")


def likeness(one: Column, two: Column) -> Column:
    """Shared hashes to all hashes, 0 to 1; two fingerprints without a hash are alike."""
    common = F.size(F.array_intersect(one, two))
    every = F.size(one) + F.size(two) - common
    return F.when(every == 0, 1.0).otherwise(common / every)


def _spans(keys: DataFrame) -> Column:
    """The span of a row's ``_key``: spans follow the order of keys and hold about equal
    bytes. Borders are counted out, and looked up in the cell of the key."""
    total = keys.agg(F.sum("size")).first()[0] or 0
    spans = min(MOST_SPANS, total // SPAN_BYTES + 1)
    cells: list[list[int]] = [[] for _ in range(1 << CELL_BITS)]
    for start in splitters(keys, "size", spans, 0.2):
        cells[min(start >> (KEY_BITS - CELL_BITS), len(cells) - 1)].append(start)
    before = [0]
    for cell in cells[:-1]:
        before.append(before[-1] + len(cell))
    constant = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    cell = F.shiftright("_key", KEY_BITS - CELL_BITS).cast("int")
    passed = F.filter(F.get(constant(cells, "array<array<bigint>>"), cell), lambda s: s <= F.col("_key"))
    return F.get(constant(before, "array<bigint>"), cell) + F.size(passed)


def with_next(docs: DataFrame, doc_id: str, text: str, values: dict[str, Column]) -> DataFrame:
    """``doc_id``, ``text`` and the columns of ``values`` (over ``text``), and with
    next_ before their names the text and those columns of the document with the next
    smaller id; the last one is followed by the first.

    Texts move once, by spans of the ids. The largest document of a span goes to the
    span above it as well, so that every row has its next one beside it.
    """
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    low, high = source.agg(F.min("doc_id"), F.max("doc_id")).first()
    # Ids spread over all keys; one below the least stands for null.
    low = (low if low is not None else 0) - 1
    shift = KEY_BITS - max(1, ((high if high is not None else 0) - low).bit_length())
    key = F.shiftleft(F.coalesce(F.col("doc_id") - low, F.lit(0)).cast("long"), max(0, shift))
    rows = source.withColumn("_key", key)
    keys = durable(rows.select("_key", (F.octet_length("text") + 64).cast("long").alias("size")))
    span = _spans(keys)
    tops = sorted(tuple(r) for r in keys.groupBy(span.alias("span")).agg(F.max("_key")).collect())
    above = [(top, tops[(i + 1) % len(tops)][0]) for i, (_, top) in enumerate(tops)]
    spark = docs.sparkSession
    guests = spark.createDataFrame(above, "_key long, span long")
    guests = rows.join(F.broadcast(guests), "_key").withColumn("guest", F.lit(True))
    own = rows.withColumn("span", span.cast("long")).withColumn("guest", F.lit(False))
    placed = own.unionByName(guests).withColumn("_order", F.xxhash64("text"))
    carried = placed.repartition("span").select("*", *[c.alias(n) for n, c in values.items()])
    order = Window.partitionBy("span").orderBy(F.desc("guest"), "_key", "_order")
    names = ["text", *values]
    beside = carried.select("*", *[F.lag(n).over(order).alias(f"next_{n}") for n in names])
    return beside.where("NOT guest").select("doc_id", *names, *[f"next_{n}" for n in names])


def fingerprinted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and
    near_next of every document.

    The edited text has its last third (rounded down, in code points) replaced by the
    first as many code points, or all, of the document with the next smaller id; the
    last is followed by the first, a single document by itself. ``near_edited`` and
    ``near_next`` compare a document's fingerprint with that of its edited text and of
    the next document. Null texts are empty and have an empty fingerprint. Null ids come
    after all others. Rows that share an id follow each other in order of a hash of the
    text, and meet in one task. Other columns are not looked at. Runs jobs to divide
    the ids.
    """
    rows = with_next(docs, doc_id, text, {"picks": chosen(F.col("text"), gram, window)})
    n = F.length("text")
    third = F.call_function("div", n, F.lit(3)).cast("int")
    edited = F.concat(F.left(F.col("text"), n - third), F.left(F.col("next_text"), third))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "picks", "next_picks", edited.alias("edited"))
    rows = rows.withColumn("again", chosen(F.col("edited"), gram, window))
    sets = rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        written(F.col("picks")).alias("fingerprint"),
        written(F.col("again")).alias("edited_fingerprint"),
        *[hashes(F.col(c)).alias(c) for c in ("picks", "again", "next_picks")],
    )
    return sets.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("picks"), F.col("again")).alias("near_edited"),
        likeness(F.col("picks"), F.col("next_picks")).alias("near_next"),
    )
