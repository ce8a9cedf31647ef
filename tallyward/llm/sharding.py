"""Shards of nearly equal bytes by histogram sort.

Rows get a 63-bit key, the group's hash above and a row's own hash below, so rows of
a group are neighbours and even the largest group can be cut. Borders between shards
are found by counting: each round takes the exact bytes below evenly spaced candidate
borders, but only inside the intervals that still hold a wanted border, until every
border is within the tolerance. Then the rows are exchanged once, by range of the key.

DataFrame functions only. The driver holds the histogram of the open intervals, at
most 256 counts for each border.
"""

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tallyward.session import durable

KEY_BITS = 63
ROUND_BITS = 8


def keyed(rows: DataFrame, group: Column, row: list[str]) -> DataFrame:
    """The rows with a key: 32 bits of the group's hash, 31 of the row's."""
    above = F.shiftrightunsigned(F.xxhash64(group), 32)
    number = F.monotonically_increasing_id()
    below = F.shiftrightunsigned(F.xxhash64(*row, number), 33)
    return rows.withColumn("_key", F.shiftleft(above, 31).bitwiseOR(below))


def splitters(keys: DataFrame, size: str, shards: int, tolerance: float) -> list[int]:
    """The keys at which shards 1, 2, ... begin.

    Each leaves as many bytes below it as wanted, give or take ``tolerance`` of a
    shard, or is the nearest border there is between two keys.
    """
    total = keys.agg(F.sum(size)).first()[0] or 0
    wanted = {j: total * j / shards for j in range(1, shards)}
    found: dict[int, int] = {}
    # Interval of each border still sought, by its leading bits, and the bytes below it.
    inside = dict.fromkeys(wanted, 0)
    below = dict.fromkeys(wanted, 0)
    bits = 0
    while len(found) < len(wanted):
        step = min(ROUND_BITS, KEY_BITS - bits)
        open_now = sorted({inside[j] for j in wanted if j not in found})
        rows = keys
        if bits:
            rows = keys.where(F.shiftright("_key", KEY_BITS - bits).isin(open_now))
        prefix = F.shiftright("_key", KEY_BITS - bits - step).alias("prefix")
        counts = dict(rows.groupBy(prefix).agg(F.sum(size)).collect())
        bits += step
        for j in wanted:
            if j in found:
                continue
            start, reached = inside[j] << step, below[j]
            for prefix in range(start, start + (1 << step)):
                after = reached + counts.get(prefix, 0)
                if after >= wanted[j] or prefix == start + (1 << step) - 1:
                    break
                reached = after
            near, at = min((wanted[j] - reached, prefix), (after - wanted[j], prefix + 1), key=lambda x: abs(x[0]))
            if abs(near) <= tolerance * total / shards or bits == KEY_BITS:
                found[j] = at << (KEY_BITS - bits)
            inside[j], below[j] = prefix, reached
    return [found[j] for j in sorted(found)]


def histogram_shards(
    rows: DataFrame,
    size: str,
    group: Column,
    row: list[str],
    shards: int,
    tolerance: float = 0.001,
) -> DataFrame:
    """All columns of ``rows`` with shard (0 to ``shards`` - 1) and slot, gapless
    from 0 in each shard, in order of the key.

    ``size`` holds a row's bytes, ``group`` what should stay together where the sizes
    allow it, ``row`` columns that tell rows apart; fully repeated rows are told apart
    by their place. Null groups are one group. Without rows there is no shard. Columns
    of ``rows`` named shard or slot are replaced.
    """
    keys = durable(keyed(rows.drop("shard", "slot"), group, row))
    starts = splitters(keys.select("_key", size), size, shards, tolerance)
    shard = F.lit(0)
    for start in starts:
        shard = shard + (F.col("_key") >= F.lit(start)).cast("int")
    placed = keys.withColumn("shard", shard.cast("int"))
    # The exchange. Within a range rows are in order of the key, so the rows of a
    # shard are consecutive and numbered by their place.
    ordered = placed.repartitionByRange("_key").sortWithinPartitions("_key")
    ordered = durable(ordered.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).alias("_part")
    runs = ordered.groupBy(part, "shard").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    earlier = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("_base", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    answer = ordered.withColumn("_part", F.shiftright("_at", 33)).join(
        runs.drop("_rows"), ["_part", "shard"]
    )
    slot = (F.col("_base") + F.col("_at") - F.col("_first")).alias("slot")
    return answer.select(*[c for c in rows.columns if c not in ("shard", "slot")], "shard", slot)


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; sharded rows are already in order of shard and slot."""
    sharded.write.partitionBy("shard").parquet(path)
