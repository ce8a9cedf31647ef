"""Nearest neighbours by multiprobe p-stable hashing.

A table hashes a vector by a few random projections, each cut into intervals of one
width. Every vector is in one bucket of each table. A query visits its own bucket and
then those it would fall into if it moved a little, in the order in which they are
likely to hold its neighbours: the order of the squared distances to the interval ends
that have to be crossed. What a visit finds is compared exactly, and the best of all
tables and visits are merged.

The number of projections and the width are fitted on a bounded sample, until its own
neighbours are found often enough; every vector is indexed.
"""

import heapq
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyward.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TABLES = 12
PROBES = 24
SAMPLE = 8192
SAMPLE_QUERIES = 128
BLOCK_ROWS = 256
# Queries whose best are held at once by a task.
HELD = 20_000
# Queries compared with all vectors in one pass, where visits have found too few.
PASS = 2000
# Projections and widths tried, from the most selective: fixed values, in multiples of
# the distance to the k-th neighbour.
CHOICES = tuple((m, w) for m in (6, 5, 4, 3, 2) for w in (0.8, 1.0, 1.25, 1.6)) + ((1, 2.0), (1, 4.0))


def _matrix(column: pa.Array) -> np.ndarray:
    rows = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(rows, -1)


class Hashing:
    """The projections of all tables."""

    def __init__(self, width: float, directions: np.ndarray, shifts: np.ndarray):
        self.width, self.directions, self.shifts = width, directions, shifts

    @classmethod
    def drawn(cls, dimensions: int, projections: int, width: float) -> "Hashing":
        random = np.random.default_rng(20240601)
        directions = random.standard_normal((dimensions, TABLES * projections))
        return cls(width, directions, random.uniform(0.0, 1.0, TABLES * projections))

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """Where each vector lies on each projection, in intervals: [row, table, projection]."""
        found = vectors @ self.directions / self.width + self.shifts
        return found.reshape(len(vectors), TABLES, -1)


def bucket(cells: np.ndarray) -> np.ndarray:
    """One number for the interval numbers of a table's projections."""
    key = np.zeros(cells.shape[:-1], np.uint64)
    for i in range(cells.shape[-1]):
        key = (key ^ cells[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def visits(projections: int, probes: int) -> list[tuple[int, ...]]:
    """Sets of moves in the order of their expected cost.

    Moves are numbered by their rank among the 2m distances to interval ends; the
    expected square of the j-th of m such distances is known, so the order needs no data.
    Ranks j and 2m + 1 - j are the two ends of one projection and exclude each other.
    """
    m = projections
    expected = [0.0] * (2 * m + 1)
    for j in range(1, m + 1):
        expected[j] = j * (j + 1) / (4.0 * (m + 1) * (m + 2))
        expected[2 * m + 1 - j] = 1.0 - j / (m + 1.0) + expected[j]
    found: list[tuple[int, ...]] = [()]
    heap = [(expected[1], (1,))]
    while heap and len(found) < probes:
        total, moves = heapq.heappop(heap)
        if len({min(j, 2 * m + 1 - j) for j in moves}) == len(moves):
            found.append(moves)
        last = moves[-1]
        if last < 2 * m:
            heapq.heappush(heap, (total - expected[last] + expected[last + 1], (*moves[:-1], last + 1)))
            heapq.heappush(heap, (total + expected[last + 1], (*moves, last + 1)))
    return found


def probed(places: np.ndarray, order: list[tuple[int, ...]]) -> np.ndarray:
    """Buckets to visit: [row, table, visit], the own one first."""
    cells = np.floor(places)
    within = places - cells
    ends = np.concatenate((within, 1.0 - within), axis=-1)
    ranked = np.argsort(ends, axis=-1, kind="stable")
    m = places.shape[-1]
    out = np.zeros((*places.shape[:-1], len(order)), np.int64)
    for number, moves in enumerate(order):
        moved = cells.copy()
        for j in moves:
            end = ranked[..., j - 1 : j]
            step = np.where(end < m, -1.0, 1.0)
            np.put_along_axis(moved, end % m, np.take_along_axis(moved, end % m, -1) + step, -1)
        out[..., number] = bucket(moved)
    return out


def squared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Squared distances, summed over differences."""
    return ((left - right) ** 2).sum(axis=-1)


def fitted(vectors: np.ndarray, k: int, target: float) -> Hashing:
    """The most selective hashing that finds ``target`` of the nearest k of some sample
    vectors among all sample vectors. A sample is sparser than what it is taken from, so
    its neighbours are farther and harder to find."""
    queries = vectors[:: max(1, len(vectors) // SAMPLE_QUERIES)][:SAMPLE_QUERIES]
    gaps = np.stack([squared(vectors, q) for q in queries])
    near = np.argsort(gaps, axis=1, kind="stable")[:, 1 : k + 1]
    reach = float(np.sqrt(np.take_along_axis(gaps, near[:, -1:], 1)).mean()) if near.size else 1.0
    for m, w in CHOICES:
        hashing = Hashing.drawn(vectors.shape[1], m, max(w * reach, 1e-9))
        own = bucket(np.floor(hashing.places(vectors)))
        asked = probed(hashing.places(queries), visits(m, PROBES))
        hits = [
            np.any([np.isin(own[near[q], t], asked[q, t]) for t in range(TABLES)], axis=0)
            for q in range(len(queries))
        ]
        if not near.size or np.mean(hits) >= target:
            break
    return hashing


def _packed(table: np.ndarray, keys: np.ndarray, ids: np.ndarray, vectors: np.ndarray, names: list[str]):
    """Rows of one bucket each, at most ``BLOCK_ROWS`` vectors long."""
    order = np.lexsort((ids, keys, table))
    table, keys, ids, vectors = table[order], keys[order], ids[order], vectors[order]
    fresh = np.flatnonzero((np.diff(keys) != 0) | (np.diff(table) != 0)) + 1
    starts = np.concatenate(([0], fresh, [len(keys)])) if len(keys) else np.zeros(1, int)
    rows: list[tuple] = []
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        for i in range(a, b, BLOCK_ROWS):
            j = min(b, i + BLOCK_ROWS)
            rows.append((int(table[i]), int(keys[i]), ids[i:j].tobytes(), vectors[i:j].tobytes()))
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]
    parts = zip(*rows, strict=True) if rows else ([], [], [], [])
    columns = [pa.array(list(c), kind) for c, kind in zip(parts, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names)


def _indexing(shared, names: list[str], order: list[tuple[int, ...]] | None):
    """Task code: vectors to the buckets they are in, or queries to those they visit."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashing = Hashing(*shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("_id").to_numpy()
            vectors = _matrix(batch.column("_vector"))
            places = hashing.places(vectors)
            keys = bucket(np.floor(places))[..., None] if order is None else probed(places, order)
            row, table, _ = np.indices(keys.shape)
            yield _packed(table.ravel(), keys.ravel(), ids[row.ravel()], vectors[row.ravel()], names)

    return index


def _merging(width: int, k: int):
    """Task code: the best of all visits of a task, for each query."""

    def merged(best: dict[int, dict[int, float]]) -> pa.RecordBatch:
        rows = [(q, i, d) for q, found in best.items() for i, d in found.items()]
        parts = zip(*rows, strict=True) if rows else ([], [], [])
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        columns = [pa.array(list(c), kind) for c, kind in zip(parts, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "gap"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, dict[int, float]] = {}
        for batch in batches:
            for q_ids, q_vectors, ids, vectors in zip(*batch.to_pydict().values(), strict=True):
                asked, queries = np.frombuffer(q_ids, np.int64), np.frombuffer(q_vectors).reshape(-1, width)
                own, block = np.frombuffer(ids, np.int64), np.frombuffer(vectors).reshape(-1, width)
                for q, query in zip(asked.tolist(), queries, strict=True):
                    gaps = squared(block, query)
                    held = best.setdefault(q, {})
                    worst = max(held.values()) if len(held) >= k else np.inf
                    for at in np.flatnonzero((gaps <= worst) & (own != q)):
                        held[int(own[at])] = float(gaps[at])
                    if len(held) > k:
                        best[q] = dict(sorted(held.items(), key=lambda x: (x[1], x[0]))[:k])
            if len(best) > HELD:
                yield merged(best)
                best = {}
        yield merged(best)

    return merge


def _scanning(shared, k: int):
    """Task code: the best of a task's vectors for each of a bounded set of queries."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, queries = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, block = batch.column("_id").to_numpy(), _matrix(batch.column("_vector"))
            rows = []
            for q, query in zip(asked.tolist(), queries, strict=True):
                gaps = squared(block, query)
                gaps[ids == q] = np.inf
                order = np.lexsort((ids, gaps))[: k + 1]
                rows += [(q, int(ids[i]), float(gaps[i])) for i in order if gaps[i] < np.inf]
            parts = zip(*rows, strict=True) if rows else ([], [], [])
            kinds = [pa.int64(), pa.int64(), pa.float64()]
            columns = [pa.array(list(c), kind) for c, kind in zip(parts, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "gap"])

    return scan


def _scanned(short: DataFrame, vectors: DataFrame, k: int) -> list[DataFrame]:
    """Every vector against the queries that visits have not served, a pass for each
    ``PASS`` of them."""
    found, last = [], None
    while True:
        rows = short if last is None else short.where(F.col("_id") > last)
        rows = rows.orderBy("_id").limit(PASS).collect()
        if not rows:
            return found
        last = rows[-1][0]
        queries = (np.array([r[0] for r in rows]), np.array([r[1] for r in rows]))
        shared = vectors.sparkSession.sparkContext.broadcast(queries)
        found.append(vectors.mapInArrow(_scanning(shared, k), "query_id long, vec_id long, gap double"))


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """_id and _vector in doubles; without vectors that are null, all zero, or have a
    null, infinite or undefined component, and without null ids."""
    vector = F.transform(F.col(embedding), lambda x: x.cast("double"))
    good = F.forall("_vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(vec_id).cast("long").alias("_id"), vector.alias("_vector"))
    return rows.where(
        F.col("_id").isNotNull()
        & F.coalesce(good, F.lit(False))
        & F.coalesce(F.exists("_vector", lambda x: x != 0.0), F.lit(False))
    )


def nearest(
    queries: DataFrame,
    vectors: DataFrame,
    k: int = 10,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    target: float = 0.97,
) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest vectors found for each query,
    nearest first, ties to the smaller id; score is the Euclidean distance in doubles.

    A query's own id is left out. Vectors that are null, zero, or have a null or
    non-finite component take no part, nor do those of another width than the first.
    Repeated ids count once. ``target`` is the share of sample neighbours that the fitted
    hashing has to find. A query whose visits find fewer than k vectors is compared with
    all of them. Runs jobs: the fit, on at most ``SAMPLE`` vectors, and the visits.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    held, asked = usable(vectors, vec_id, embedding), usable(queries, vec_id, embedding)
    sample = held.orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE).select("_vector").collect()
    if not sample:
        return spark.createDataFrame([], schema)
    width = len(sample[0][0])
    hashing = fitted(np.array([r[0] for r in sample if len(r[0]) == width]), k, target)
    shared = spark.sparkContext.broadcast((hashing.width, hashing.directions, hashing.shifts))
    order = visits(hashing.directions.shape[1] // TABLES, PROBES)
    fits = F.size("_vector") == width
    kinds = "table int, bucket long, {0}ids binary, {0}vectors binary"
    index = held.where(fits).mapInArrow(
        _indexing(shared, ["table", "bucket", "ids", "vectors"], None), kinds.format("")
    )
    looks = asked.where(fits).mapInArrow(
        _indexing(shared, ["table", "bucket", "q_ids", "q_vectors"], order), kinds.format("q_")
    )
    met = looks.join(index, ["table", "bucket"]).select("q_ids", "q_vectors", "ids", "vectors")
    found = met.mapInArrow(_merging(width, k), "query_id long, vec_id long, gap double")
    once = durable(found.groupBy("query_id", "vec_id").agg(F.min("gap").alias("gap")))
    served = once.groupBy("query_id").agg(F.count("*").alias("_found"))
    most = min(k, held.where(fits).select("_id").distinct().count())
    short = asked.where(fits).join(served, F.col("_id") == F.col("query_id"), "left")
    short = durable(short.where(F.coalesce("_found", F.lit(0)) < most).select("_id", "_vector"))
    for late in _scanned(short, held.where(fits), k):
        once = once.unionByName(late)
    once = once.groupBy("query_id", "vec_id").agg(F.min("gap").alias("gap"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("gap", "vec_id"))
    best = once.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", F.sqrt("gap").alias("score"))
