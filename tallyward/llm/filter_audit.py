"""How filters of a corpus overlap, in every order they could be applied in.

Each document gets a mask with one bit per filter it fails. Masks are counted per part,
and as counts add up, everything an audit asks for (what a filter removes after others,
what it alone removes, its Shapley value) follows from at most 32 counts a part.

One filter asks for an earlier document with the same text. A counting Bloom sketch
of all texts comes first: tasks count up to two in sketches of their own, which are
added, and a text one of whose counters stands at one is unique for certain. Only the
others move, whole, to find the least id of each text. The sketch has eight counters a
document. What is broadcast of it, a bit a counter, is at most 64 MB: past some 70
million documents it is fuller and clears fewer texts, but never one that has a copy.
"""

import itertools
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

COUNTERS_A_ROW = 8
PROBES = 3
# Counters in all, and of one stripe, the unit in which sketches are added.
MOST_COUNTERS = 1 << 29
STRIPE = 1 << 17
WORDS = r"[^\x20\x09-\x0D]+"
FILTERS = "ABCDE"


def _places(keys: np.ndarray, counters: int) -> Iterator[np.ndarray]:
    """The counters of each 64-bit hash; ``counters`` is a power of two."""
    keys = keys.view(np.uint64)
    low, high = keys & np.uint64(0xFFFFFFFF), keys >> np.uint64(32) | np.uint64(1)
    for probe in range(PROBES):
        mixed = (low + np.uint64(probe) * high) * np.uint64(0x9E3779B97F4A7C15)
        yield (mixed >> np.uint64(64 - counters.bit_length() + 1)).astype(np.int64)


def _counted(counters: int):
    """Task code: which counters of each stripe the hashes of a batch raise, and which
    of them by two or more."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Copies of a text within a batch are two at most, as everywhere.
            keys, copies = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            places = np.sort(np.stack(list(_places(keys, counters))), axis=0)
            # A hash with two probes on one counter counts once there.
            fresh = np.concatenate((np.ones((1, len(keys)), bool), places[1:] != places[:-1]))
            weight = np.broadcast_to(np.minimum(copies, 2), places.shape)
            places, inverse = np.unique(places[fresh], return_inverse=True)
            times = np.bincount(inverse, weight[fresh])
            stripes, starts = np.unique(places // STRIPE, return_index=True)
            inside, often = (places % STRIPE).astype(np.int32), times > 1
            cuts = list(zip(starts, [*starts[1:], len(places)], strict=True))
            columns = [
                pa.array(stripes, pa.int32()),
                pa.array([inside[a:b].tobytes() for a, b in cuts], pa.binary()),
                pa.array([np.packbits(often[a:b]).tobytes() for a, b in cuts], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["stripe", "raised", "often"])

    return count


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: the stripes that meet in the task, counted up to two; returns as bits
    which counters stand at two."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for stripe, raised, often in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            places = np.frombuffer(raised, np.int32)
            twice = np.unpackbits(np.frombuffer(often, np.uint8), count=len(places))
            own = sums.setdefault(stripe, np.zeros(STRIPE, np.uint8))
            own[places] = np.minimum(own[places] + 1 + twice, 2)
    for stripe, own in sums.items():
        columns = [pa.array([stripe], pa.int32()), pa.array([np.packbits(own == 2).tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["stripe", "twice"])


def counters_for(rows: int) -> int:
    """A power of two, eight a row and ``MOST_COUNTERS`` at most."""
    counters = STRIPE
    while counters < min(MOST_COUNTERS, COUNTERS_A_ROW * rows):
        counters *= 2
    return counters


def repeat_sketch(hashes: DataFrame, rows: int) -> np.ndarray:
    """Packed bits: the counters that stand at two or more, from one column of 64-bit
    hashes. Tasks send what they counted, stripe by stripe, to be added."""
    counters = counters_for(rows)
    parts = hashes.mapInArrow(_counted(counters), "stripe int, raised binary, often binary")
    sums = parts.repartition("stripe").mapInArrow(_added, "stripe int, twice binary")
    table = np.zeros((counters // STRIPE, STRIPE // 8), np.uint8)
    for row in sums.toLocalIterator():
        table[row.stripe] = np.frombuffer(row.twice, np.uint8)
    return table.reshape(-1)


def possible_repeat(spark, sketch: np.ndarray):
    """A function of a hash column: false only where the text is unique for certain."""
    shared = spark.sparkContext.broadcast(sketch)

    def possible(keys: pd.Series) -> pd.Series:
        bits = shared.value
        found = np.ones(len(keys), bool)
        for places in _places(keys.to_numpy(np.int64), 8 * len(bits)):
            found &= (bits[places >> 3] >> (7 - (places & 7)).astype(np.uint8)) & 1 == 1
        return pd.Series(found)

    return F.pandas_udf(possible, "boolean")


def text_flags(text: Column) -> dict[str, Column]:
    """Filters that look at one text: whether it fails."""
    words = F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))
    distinct = F.size(F.array_distinct(words))
    upper = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * distinct < 50 * F.size(words),
        "C": 100 * upper > 3 * F.length(text),
        "D": F.rlike(text, F.lit(r"[#$%&*|]")),
    }


def masks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """doc_id, part and mask of every row: bit i is set if the row fails filter i of
    ``FILTERS``. Runs jobs for the sketch and for the least ids of texts."""
    spark = docs.sparkSession
    source = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(text, F.lit("")).alias("text"),
        F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
    )
    # Words are split once: the count and the distinct count share their array.
    flags = text_flags(F.col("text"))
    bits = sum((F.when(flag, 1 << i).otherwise(0) for i, flag in enumerate(flags.values())), F.lit(0))
    judged = durable(source.select("doc_id", "part", bits.alias("mask"), F.xxhash64("text").alias("hash")))
    maybe = possible_repeat(spark, repeat_sketch(judged.select("hash"), judged.count()))
    # Whole texts, so that equal hashes decide nothing; copies meet in map-side minima.
    repeats = source.where(F.col("doc_id").isNotNull()).withColumn("hash", F.xxhash64("text")).where(maybe("hash"))
    firsts = repeats.groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.first("hash").alias("hash"))
    firsts = firsts.select("doc_id", "hash", F.lit(True).alias("is_first"))
    known = judged.where(maybe("hash") & F.col("doc_id").isNotNull())
    late = known.join(firsts, ["doc_id", "hash"], "left")
    late = late.withColumn("mask", F.col("mask") + F.when(F.col("is_first"), 0).otherwise(16))
    alone = judged.where(~maybe("hash") | F.col("doc_id").isNull())
    names = ["doc_id", "part", "mask"]
    return late.select(*names).unionByName(alone.select(*names))


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The audit from mask counts: part, mask, n, good and toxic, one row per part and
    mask. Returns one row per part, order and step, see :func:`audited`."""
    last = len(filters)
    orders = ["".join(o) for o in itertools.permutations(filters)]
    own = F.collect_list(F.struct("mask", "n", "good", "toxic"))
    rows = counts.groupBy("part").agg(own.alias("own"))
    rows = rows.withColumn("filter_order", F.explode(F.array(*[F.lit(o) for o in orders])))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(last))))
    bit = lambda letter: F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(filters) for x in (f, 1 << i)]), letter)
    rows = rows.withColumn("bit", bit(F.substr("filter_order", "step", F.lit(1))))
    earlier = F.sequence(F.lit(1), F.col("step") - 1)
    before = F.aggregate(earlier, F.lit(0), lambda s, i: s + bit(F.substr("filter_order", i, F.lit(1))))
    rows = rows.withColumn("before", F.when(F.col("step") > 1, before).otherwise(0))

    def total(keep, value="n") -> Column:
        add = lambda s, x: s + F.when(keep(x["mask"]), x[value]).otherwise(0)
        return F.aggregate("own", F.lit(0).cast("long"), add)

    both = F.col("before").bitwiseOR(F.col("bit"))
    has = lambda m: m.bitwiseAND(F.col("bit")) != 0
    removed = lambda m: has(m) & (m.bitwiseAND(F.col("before")) == 0)
    # Of all orders, a filter comes first among k failed ones in one of k.
    share = lambda s, x: s + F.when(has(x["mask"]), x["n"] * F.call_function("div", F.lit(len(orders)), F.bit_count(x["mask"]))).otherwise(0)
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda m: m.bitwiseAND(both) == 0).alias("kept"),
        total(removed).alias("removed"),
        total(lambda m: has(m) & (m.bitwiseAND(F.col("before")) != 0)).alias("redundant"),
        total(lambda m: m == F.col("bit")).alias("unique_fails"),
        total(removed, "good").alias("good_lost"),
        total(removed, "toxic").alias("toxic_lost"),
        F.aggregate("own", F.lit(0).cast("long"), share).alias("shapley"),
    )


def audited(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    part: str = "lang",
) -> DataFrame:
    """One row per part, order of the filters and step: how many documents of the part
    are kept after the step, removed in it, redundant (fail its filter, but were removed
    before), fail its filter only, are good or toxic and removed in it; and the filter's
    removed documents summed over all orders.

    ``A`` under 200 words, ``B`` fewer distinct words than half of all, ``C`` more than
    3 % of the code points in A-Z, ``D`` any of ``#$%&*|``, ``E`` the text of a document
    with a smaller id. Null texts are empty, a null part is the empty one. A null id has
    no smaller one and is smaller than none. Rows with one id are documents of their own;
    equal rows are not earlier than each other. ``labels`` has doc_id, quality and toxic;
    of several labels of a document any 1 counts. Without documents there is no part.
    """
    marks = labels.groupBy(F.col("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"),
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    )
    rows = masks(docs, doc_id, text, part).join(marks, "doc_id", "left")
    counts = rows.groupBy("part", "mask").agg(
        F.count("*").alias("n"),
        F.coalesce(F.sum("good"), F.lit(0)).alias("good"),
        F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"),
    )
    return interactions(counts)
