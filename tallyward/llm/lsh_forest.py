"""Near duplicates: an LSH forest proposes, full shingle sets decide.

Every distinct shingle set gets one label per tree, a string of min-hashes. Each
tree is a sorted order of all labels. Neighbours in an order whose labels share a
long enough prefix are candidates. How deep that prefix is follows from the region:
where few labels share two values, all of them are compared; where many do, only
those next to each other, which are those that share most. Parities of shingles by bucket
bound in how many shingles two sets differ, which drops most pairs that are no link, and
no other.

The rest are confirmed on the full sets, in two steps. First each set meets the
neighbour with the longest common prefix in every tree, a fixed number of pairs a set,
and the confirmed links are joined to components. Of all other candidates only those
between components are left to confirm, so a group of many copies does not send its
sets once for each two of them.

A label in a crowded region may have its link farther away than the window. A region
is all sets that share two values in a tree. Where one has more sets than the window
sees and these are not all linked yet, its sets are joined exactly, by prefix filter:
two sets with a link share one of the rarest shingles of each, as many as may differ.
Shingles that only sets of one component hold need no join, and passages that many
texts share are not rare. Lists of a shingle are dealt over lanes, and a block for every
two lanes passes on the pairs that sizes and parities allow. Nothing there is capped or
estimated.

Texts with equal sets are one node from the start, so a text with any number of
copies costs as much as one.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from tallyward.llm import sieve, texts
from tallyward.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES = 16
DEPTH = 6
LEAST_DEPTH = 2
WINDOW = 8
# Sets of a lane, of which a block of one rare shingle holds two.
LANE_SETS = 512
# Shingles that a task turns over at once.
SLICE = 1_000_000
# Of its listed shingles the first that a set carries, so that two sets are paired once as
# far as these tell.
HEAD = 8
# Buckets of which a set's sketch holds a bit each, to bound how far two sets differ.
BUCKET_BITS = 9
ROWS_A_TASK = 50_000
LABEL = 4 * DEPTH


def _parities(own: np.ndarray) -> bytes:
    """For each bucket whether an odd number of the set's shingles falls into it."""
    buckets = (own >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    return np.packbits(np.bincount(buckets, minlength=1 << BUCKET_BITS) & 1).tobytes()


def _possible(sizes: np.ndarray, spread: np.ndarray, one, two, share: int) -> np.ndarray:
    """Whether sizes and parities allow a link: where two parities differ, so do the sets."""
    total = sizes[one] + sizes[two]
    apart = np.bitwise_count(spread[one] ^ spread[two]).sum(axis=1, dtype=np.int64)
    fit = 100 * np.minimum(sizes[one], sizes[two]) >= share * np.maximum(sizes[one], sizes[two])
    return fit & ((100 + share) * (total - apart) >= 2 * share * total)


def _sketches(rows: pa.Table) -> np.ndarray:
    held = b"".join(rows.column("spread").to_pylist())
    return np.frombuffer(held, np.uint64).reshape(-1, (1 << BUCKET_BITS) // 64)


def _signatures(width: int):
    """Task code: shingle count, id of the set, the labels of all trees, and the parities
    of the buckets."""

    def min_hashes(own: np.ndarray) -> np.ndarray:
        factor = (texts.seeded(TREES * DEPTH, 3) | np.uint64(1))[:, None]
        least = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint64)
        for start in range(0, len(own), 2048):
            values = (factor * own[None, start : start + 2048]) >> np.uint64(32)
            np.minimum(least, values.min(axis=1), out=least)
        return least.astype(">u4")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in texts.blocks(batches):
            hashes, counts = texts.word_hashes(*texts.utf8(batch.column("text")))
            sizes, ids, labels, spreads = [], [], [], []
            for own in texts.shingle_sets(hashes, counts, width):
                sizes.append(len(own))
                ids.append(hashlib.md5(own.tobytes()).digest() if len(own) else None)
                labels.append(min_hashes(own).tobytes() if len(own) else None)
                spreads.append(_parities(own))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(ids, pa.binary()),
                    pa.array(labels, pa.binary()),
                    pa.array(spreads, pa.binary()),
                ],
                ["doc_id", "n_shingles", "set_id", "labels", "spread"],
            )

    return sign


def _full_sets(width: int):
    """Task code: the shingles of a text, with the id of their set."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in texts.blocks(batches):
            hashes, counts = texts.word_hashes(*texts.utf8(batch.column("text")))
            packed = [own.tobytes() for own in texts.shingle_sets(hashes, counts, width)]
            ids = [hashlib.md5(p).digest() for p in packed]
            columns = [pa.array(ids, pa.binary()), pa.array(packed, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["set_id", "shingles"])

    return gather


def _neighbours(rows: pa.Table, share: int, window: int, least: int):
    """Places of neighbours in one sorted run of labels whose sizes and parities allow a
    link."""
    labels = np.frombuffer(b"".join(rows.column("label").to_pylist()), ">u4").reshape(-1, DEPTH)
    labels, tree = labels.astype(np.uint32), rows.column("tree").to_numpy()
    sizes = rows.column("n_shingles").to_numpy()
    spread = _sketches(rows)
    for step in range(1, min(window, len(labels) - 1) + 1):
        near = (tree[:-step] == tree[step:]) & (labels[:-step, :least] == labels[step:, :least]).all(axis=1)
        at = np.flatnonzero(near)
        at = at[_possible(sizes, spread, at, at + step, share)]
        yield at, at + step


def _closest(rows: pa.Table) -> np.ndarray:
    """Whether a row and the next one have, for one of the two, the longest common prefix
    of all; what lies beyond the rows counts as shorter."""
    labels = np.frombuffer(b"".join(rows.column("label").to_pylist()), ">u4").reshape(-1, DEPTH)
    tree = rows.column("tree").to_numpy()
    depth = np.logical_and.accumulate(labels[:-1] == labels[1:], axis=1).sum(axis=1)
    depth[tree[:-1] != tree[1:]] = 0
    around = np.concatenate(([0], depth, [0]))
    longest = (depth >= around[:-2]) | (depth >= around[2:])
    return np.append(longest, False)


def _pairs(rows: pa.Table, found) -> pa.RecordBatch:
    ids = np.array(rows.column("set_id").to_pylist(), dtype=object)
    closest = _closest(rows)
    left, right, first = [], [], []
    for one, two in found:
        a, b = ids[one], ids[two]
        swap = a > b
        left.extend(np.where(swap, b, a))
        right.extend(np.where(swap, a, b))
        first.extend((two - one == 1) & closest[one])
    columns = [pa.array(left, pa.binary()), pa.array(right, pa.binary()), pa.array(first, pa.bool_())]
    return pa.RecordBatch.from_arrays(columns, ["a", "b", "closest"])


PAIRS = "a binary, b binary, closest boolean"


def _sorted_run(share: int, window: int, least: int, columns: str):
    """Task code over one range of the sorted orders: candidate pairs, and the rows
    at either end, which have neighbours in the next range."""
    edge = f"{PAIRS}, border int, {columns}"
    names = [c.split()[0] for c in columns.split(", ")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        kept, head = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            # Rows of the batch before, for neighbours across the two.
            table = table if kept is None else pa.concat_tables([kept, table])
            fresh = 0 if kept is None else kept.num_rows
            if head is None or head.num_rows < window:
                head = table.slice(0, window)
            new = (
                (a[b >= fresh], b[b >= fresh]) for a, b in _neighbours(table, share, window, least)
            )
            yield widened(_pairs(table, new), None, 0)
            kept = table.slice(max(0, table.num_rows - window))
        if kept is not None:
            yield widened(None, head, place)
            yield widened(None, kept, place + 1)

    def widened(pairs, rows, border):
        size = pairs.num_rows if pairs is not None else rows.num_rows
        left = [pa.nulls(size, t) for t in (pa.binary(), pa.binary(), pa.bool_())]
        right = [pa.nulls(size, t) for t in (pa.int32(), *types)]
        if pairs is not None:
            left = pairs.columns
        if rows is not None:
            own = [rows.column(n).combine_chunks() for n in names]
            right = [pa.array(np.full(size, border, np.int32)), *own]
        return pa.RecordBatch.from_arrays([*left, *right], ["a", "b", "closest", "border", *names])

    return run, edge


def _across(share: int, window: int, least: int):
    """Task code: neighbours on the two sides of a border between ranges."""

    def join(table: pa.Table) -> pa.Table:
        order = [("tree", "ascending"), ("label", "ascending"), ("set_id", "ascending")]
        # A short range sends a row to a border once as head and once as tail.
        table = table.sort_by(order)
        return pa.Table.from_batches([_pairs(table, _neighbours(table, share, window, least))])

    return join


def _usable(sets: DataFrame, share: int) -> DataFrame:
    """Below four shingles no two different sets share four fifths."""
    return sets.where(F.col("n_shingles") * (100 - share) >= share)


def candidates(sets: DataFrame, share: int, window: int = WINDOW, least: int = LEAST_DEPTH) -> DataFrame:
    """Pairs (a, b) of set ids that some tree puts within ``window`` of each other with
    ``least`` values shared, but for those whose sizes or parities rule a link out, and
    whether one of the two is the other's closest in some tree; from set_id, n_shingles,
    labels and spread, one row per set."""
    columns = "tree int, label binary, set_id binary, n_shingles long, spread binary"
    names = [c.split()[0] for c in columns.split(", ")]
    usable = _usable(sets, share)
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    rows = usable.select("*", tree.alias("tree")).withColumn(
        "label", F.expr(f"substring(labels, tree * {LABEL} + 1, {LABEL})")
    )
    order = ["tree", "label", "set_id"]
    parts = max(1, -(-TREES * usable.count() // ROWS_A_TASK))
    run, schema = _sorted_run(share, window, least, columns)
    ordered = rows.select(*names).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    found = durable(ordered.mapInArrow(run, schema))
    edges = found.where(F.col("border").isNotNull()).select("border", *names)
    crossing = edges.groupBy("border").applyInArrow(_across(share, window, least), PAIRS)
    inside = found.where(F.col("a").isNotNull()).select("a", "b", "closest")
    both = inside.unionByName(crossing).where(F.col("a") != F.col("b"))
    return both.groupBy("a", "b").agg(F.max("closest").alias("closest"))


def _overlap(share: int):
    """Task code: which pairs really share enough of their union."""

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            keep = []
            for i in range(batch.num_rows):
                one = np.frombuffer(left[i].as_buffer(), np.uint64)
                two = np.frombuffer(right[i].as_buffer(), np.uint64)
                if len(one) > len(two):
                    one, two = two, one
                at = np.minimum(np.searchsorted(two, one), len(two) - 1)
                common = int((two[at] == one).sum())
                keep.append(100 * common >= share * (len(one) + len(two) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return confirm


def _slices(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The shingles of the sets, a slice at a time, with the key of the set of each."""
    for batch in batches:
        held = batch.column("shingles")
        sizes = pc.binary_length(held).to_numpy(zero_copy_only=False).astype(np.int64) // 8
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        places = np.concatenate(([0], np.cumsum(sizes)))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(places, places[start] + SLICE, side="right")) - 1)
            values = np.frombuffer(b"".join(held[start:end].to_pylist()), np.int64)
            yield values, np.repeat(keys[start:end], sizes[start:end])
            start = end


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: how many sets hold each shingle, and the least and largest root of them."""
    for values, roots in _slices(batches, "root"):
        order = np.argsort(values, kind="stable")
        values, roots = values[order], roots[order]
        starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
        count = np.diff(np.append(starts, len(values)))
        low, high = np.minimum.reduceat(roots, starts), np.maximum.reduceat(roots, starts)
        columns = [pa.array(c) for c in (values[starts], count, low, high)]
        yield pa.RecordBatch.from_arrays(columns, ["shingle", "n", "low", "high"])


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: one row per set and shingle."""
    for values, nodes in _slices(batches, "node"):
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(values)], ["node", "shingle"])


def _heads(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The first listed shingles of each set, a row each, and which places are taken."""
    held = rows.column("head").combine_chunks()
    taken = np.arange(HEAD) < pc.list_value_length(held).to_numpy(zero_copy_only=False)[:, None]
    heads = np.zeros(taken.shape, np.int64)
    heads[taken] = held.flatten().to_numpy(zero_copy_only=False)
    return heads, taken


def _first_here(heads: tuple[np.ndarray, np.ndarray], one: int, two: np.ndarray, shingle: int) -> np.ndarray:
    """Whether the set ``one`` and each of ``two`` meet at ``shingle`` first, as far as
    their first shingles tell. All lists have one order, so a shingle that both have there
    comes before others, and the two meet at it as well."""
    values, taken = heads
    own = values[one, taken[one]]
    both = ((values[two][:, None, :] == own[:, None]) & taken[two][:, None, :]).any(axis=2)
    return ~both.any(axis=1) | (own[both.argmax(axis=1)] == shingle)


def _runs(share: int):
    """Task code over blocks in order (rows of one shingle and two lanes): pairs of sets
    of different roots whose sizes and parities allow a link, if this can be the first
    shingle where they meet and enough shingles come after it."""

    def paired(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        ids = rows.column("set_id").to_pylist()
        roots, lanes, sizes = (rows.column(c).to_numpy() for c in ("root", "lane", "n_shingles"))
        shingles, rests, one, two = (rows.column(c).to_numpy() for c in ("shingle", "rest", "one", "two"))
        spread, heads = _sketches(rows), _heads(rows)
        left, right = [], []
        for start, end in zip(starts, np.append(starts[1:], rows.num_rows), strict=True):
            if (roots[start:end] == roots[start]).all():
                continue
            for i in range(start, end - 1):
                at = np.arange(i + 1, end)
                keep = roots[at] != roots[i]
                # Each lane has met itself in a block of its own.
                if one[start] != two[start]:
                    keep &= lanes[at] != lanes[i]
                at = at[keep]
                common = 1 + np.minimum(rests[at], rests[i])
                at = at[(100 + share) * common >= share * (sizes[at] + sizes[i])]
                at = at[_possible(sizes, spread, at, np.full(len(at), i), share)]
                for j in at[_first_here(heads, i, at, shingles[i])]:
                    left.append(min(ids[i], ids[j]))
                    right.append(max(ids[i], ids[j]))
        return pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if kept is None else pa.concat_tables([kept, table])
            keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in ("shingle", "one", "two")])
            new = np.concatenate(([True], (keys[:, 1:] != keys[:, :-1]).any(axis=0)))
            starts = np.flatnonzero(new)
            # The last block may go on in the next batch.
            kept = table.slice(starts[-1])
            if len(starts) > 1:
                yield paired(table.slice(0, starts[-1]), starts[:-1])
        if kept is not None:
            yield paired(kept, np.array([0]))

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link, root the least node reachable.

    Large-star and small-star rounds: each hangs neighbours under the least node
    known, until nothing moves. A hub is a key with many rows on one side of a join
    only, and its least neighbour comes from a two-phase minimum.
    """

    def least(edges: DataFrame) -> DataFrame:
        return durable(edges.groupBy("u").agg(F.min("v").alias("m")))

    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    before, edges = None, durable(links.where("u <> v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hung = both.join(least(both), "u").where("v > u")
        large = durable(
            hung.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()
        )
        roots = least(large)
        small = large.join(roots, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        seen = Observation()
        edges = (
            small.unionByName(roots.select("u", F.col("m").alias("v")))
            .distinct()
            .observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        )
        edges = durable(edges)
        state = (seen.get["n"], seen.get["h"])
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    width: int = 5,
    share: int = 80,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document.

    Words are separated by ASCII white space, A-Z lower-cased; sets hold the
    distinct shingles of ``width`` words, or the whole sequence where a text has
    fewer. Documents with ``100 * intersection >= share * union`` are linked;
    component_id is the least id reachable over links. Every document whose id is
    that id is kept.

    Documents without a word, or with a null text, have no shingle and stand alone.
    Repeated rows are copies of each other; rows with one id are kept or left
    together. A null id counts as no id: such a document gets a component_id from its
    links only, and is kept if it has none. Runs jobs: signatures, candidates, confirmed links and the rounds
    of the component search are tables in the checkpoint folder.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = docs.schema[doc_id].dataType.simpleString()
    signed = durable(
        source.mapInArrow(
            _signatures(width),
            f"doc_id {id_type}, n_shingles long, set_id binary, labels binary, spread binary",
        )
    )
    sets = durable(
        signed.where("set_id IS NOT NULL")
        .groupBy("set_id")
        .agg(F.min("doc_id").alias("least_id"), *[F.first(c).alias(c) for c in ("n_shingles", "labels", "spread")])
    )
    regions = durable(_regions(sets, share))
    # Sets that share no region have no candidate.
    meeting = durable(regions.select("set_id").distinct().select(F.xxhash64("set_id")))
    pairs = durable(candidates(sieve.passed(sets, F.xxhash64("set_id"), meeting), share))
    crowded = regions.where(F.col("n") > WINDOW + 1).drop("n")
    full = _gathered(source, sets, pairs, crowded, width)
    found = components(_confirmed(full, pairs.where("closest"), share))
    others = _apart(pairs.where("NOT closest"), found)
    others = others.unionByName(_met(full, sets, crowded, found, share)).distinct()
    found = _with_links(found, durable(_confirmed(full, others, share)))
    named = found.join(sets.select(F.col("set_id").alias("node"), "least_id"), "node")
    roots = sets.select(F.col("set_id").alias("root"), F.col("least_id").alias("own_id"))
    least = named.groupBy("root").agg(F.min("least_id").alias("linked_id")).join(roots, "root")
    least = durable(least.select("root", F.least("linked_id", "own_id").alias("component_id")))
    members = found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())
    known = durable(members.join(least, "root").select(F.col("node").alias("set_id"), "component_id"))
    everyone = sets.join(known, "set_id", "left").select(
        "set_id", F.coalesce("component_id", "least_id").alias("component_id")
    )
    everyone = durable(everyone)
    narrow = signed.select("doc_id", "n_shingles", "set_id")
    answer = narrow.join(everyone, "set_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )
    return answer.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _with_links(found: DataFrame, links: DataFrame) -> DataFrame:
    """Components with further links (a, b)."""
    if links.isEmpty():
        return found
    known = found.select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(links.unionByName(known))


def _regions(sets: DataFrame, share: int) -> DataFrame:
    """region, set_id and n_shingles of every set that is not alone in a region, with the
    number n of sets there."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1)))
    rows = _usable(sets, share).select("set_id", "n_shingles", "labels", tree.alias("tree"))
    # Regions with one hash are searched as one.
    prefix = F.expr(f"substring(labels, tree * {LABEL} + 1, {4 * LEAST_DEPTH})")
    rows = rows.select(F.xxhash64("tree", prefix).alias("region"), "set_id", "n_shingles")
    return rows.join(rows.groupBy("region").agg(F.count("*").alias("n")).where("n > 1"), "region")


def _gathered(source: DataFrame, sets: DataFrame, pairs: DataFrame, crowded: DataFrame, width: int) -> DataFrame:
    """set_id and shingles of every set with a candidate or in a crowded region, built
    again from one text each."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("set_id"))
    wanted = ends.unionByName(crowded.select("set_id")).distinct()
    wanted = durable(sets.select("set_id", "least_id").join(wanted, "set_id"))
    # A null id is looked up like any other.
    key = lambda c: F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("")))
    # Texts stay in their tasks, only sets move.
    held = sieve.passed(source, key("doc_id"), wanted.select(key("least_id"))).select("text")
    full = held.mapInArrow(_full_sets(width), "set_id binary, shingles binary")
    return durable(full.join(wanted.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"]))


def _apart(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """The pairs whose ends ``found`` has in different components."""
    ends = lambda c: found.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    named = pairs.join(ends("a"), "a", "left").join(ends("b"), "b", "left")
    roots = [F.coalesce(f"{c}_root", c) for c in ("a", "b")]
    return named.where(roots[0] != roots[1]).select("a", "b")


def _met(full: DataFrame, sets: DataFrame, crowded: DataFrame, found: DataFrame, share: int) -> DataFrame:
    """Pairs (a, b) between components of ``found`` with every link that two sets of a
    crowded region have, and others that sizes and parities allow.

    Shingles are ordered by the number of sets that hold them, after those that sets of
    one component alone hold. Of n shingles a set needs ``share`` in a hundred in
    common with another, so it lists its first ones, one more than it can spare.
    """
    roots = found.select(F.col("node").alias("set_id"), "root")
    rows = crowded.join(roots, "set_id", "left")
    rows = durable(rows.withColumn("root", F.xxhash64(F.coalesce("root", "set_id"))))
    regions = rows.groupBy("region").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    apart = rows.join(regions.where("low <> high"), "region", "left_semi")
    apart = apart.select("set_id", "root", "n_shingles").distinct()
    apart = durable(apart.withColumn("node", F.xxhash64("set_id")))
    near = sieve.passed(full, F.xxhash64("set_id"), apart.select("node"))
    held = durable(apart.join(near, "set_id").select("node", "root", "shingles"))
    counts = held.select("root", "shingles").mapInArrow(_holders, "shingle long, n long, low long, high long")
    counts = counts.groupBy("shingle").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    counts = counts.where("low <> high").select("shingle", "n")
    listed = held.select("node", "shingles").mapInArrow(_listed, "node long, shingle long").join(counts, "shingle")
    own = Window.partitionBy("node")
    listed = listed.select(
        "node",
        "shingle",
        F.row_number().over(own.orderBy("n", "shingle")).alias("place"),
        F.count("*").over(own).alias("joined"),
    )
    needed = F.ceil(F.col("n_shingles") * share / 100)
    first = listed.join(apart, "node").where(F.col("place") <= F.col("joined") + 1 - needed)
    first = first.select("shingle", "node", "root", "place", (F.col("joined") - F.col("place")).alias("rest"))
    first = durable(first)
    lists = first.groupBy("shingle").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"))
    lists = lists.where("low <> high").select("shingle", F.ceil(F.col("n") / LANE_SETS).cast("int").alias("lanes"))
    dealt = first.select("shingle", "node", "rest").join(lists, "shingle")
    dealt = dealt.withColumn("lane", F.expr("cast(pmod(xxhash64(node), lanes) AS int)"))
    other = F.explode(F.sequence(F.lit(0), F.col("lanes") - 1))
    dealt = dealt.select("shingle", "node", "rest", "lane", other.alias("other"))
    block = ["shingle", "one", "two"]
    head = F.sort_array(F.collect_list(F.struct("place", "shingle"))).getField("shingle")
    heads = first.where(F.col("place") <= HEAD).groupBy("node").agg(head.alias("head"))
    facts = apart.join(sets.select("set_id", "spread"), "set_id").join(heads, "node")
    rows = dealt.join(facts, "node").select(
        "shingle",
        F.least("lane", "other").alias("one"),
        F.greatest("lane", "other").alias("two"),
        "lane",
        "set_id",
        "root",
        "n_shingles",
        "spread",
        "rest",
        "head",
    )
    return rows.repartition(*block).sortWithinPartitions(*block).mapInArrow(_runs(share), "a binary, b binary")


def _confirmed(full: DataFrame, pairs: DataFrame, share: int) -> DataFrame:
    """The candidate pairs that hold on full sets."""
    left = full.select(F.col("set_id").alias("a"), F.col("shingles").alias("left"))
    right = full.select(F.col("set_id").alias("b"), F.col("shingles").alias("right"))
    both = pairs.join(left, "a").join(right, "b")
    return both.mapInArrow(_overlap(share), "a binary, b binary")
