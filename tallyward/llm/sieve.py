"""Which rows need not move: a Bloom filter as a small table, joined by broadcast.

A key sets one bit in each of the eight words of its block. Rows that the filter rules
out have a key that is not listed for certain, and stay in their task; the others go on
to an exact join. The table has at most ``MOST_BLOCKS`` blocks, 17 MB of bits, whatever
the number of keys. A fuller filter passes more rows, never fewer.

DataFrame functions only.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.session import durable

WORDS = 8
WORD_BITS = 64
BITS_A_KEY = 16
MOST_BLOCKS = 1 << 18


def _masks(key: Column) -> list[Column]:
    """For each word the bit of a key."""
    # Bits that say nothing about the block.
    places = F.xxhash64(key, F.lit(1))
    one = F.lit(1).cast("long")
    bit = lambda i: F.shiftrightunsigned(places, 6 * i).bitwiseAND(F.lit(WORD_BITS - 1)).cast("int")
    return [F.call_function("shiftleft", one, bit(i)) for i in range(WORDS)]


def marked(rows: DataFrame, key: Column, listed: DataFrame, name: str) -> DataFrame:
    """The rows with a boolean column ``name``, false only where the 64-bit hash ``key`` is
    not in ``listed``, a table of one column of such hashes. Runs jobs for the filter;
    ``listed`` is read twice."""
    known = listed.toDF("_key")
    count = known.count()
    blocks = 1
    while blocks < MOST_BLOCKS and blocks * WORDS * WORD_BITS < BITS_A_KEY * count:
        blocks *= 2
    block = lambda c: F.col(c).bitwiseAND(F.lit(blocks - 1).cast("long"))
    words = [f"_word_{i}" for i in range(WORDS)]
    table = durable(
        known.groupBy(block("_key").alias("_block")).agg(
            *[F.bit_or(m).alias(w) for w, m in zip(words, _masks(F.col("_key")), strict=True)]
        )
    )
    joined = rows.withColumn("_key", key).withColumn("_block", block("_key"))
    joined = joined.join(F.broadcast(table), "_block", "left")
    hits = F.lit(True)
    for word, mask in zip(words, _masks(F.col("_key")), strict=True):
        hits = hits & (F.col(word).bitwiseAND(mask) != 0)
    return joined.withColumn(name, F.coalesce(hits, F.lit(False))).select(*rows.columns, name)


def passed(rows: DataFrame, key: Column, listed: DataFrame) -> DataFrame:
    """The rows whose key may be listed, all that are among them."""
    return marked(rows, key, listed, "_passed").where("_passed").drop("_passed")
