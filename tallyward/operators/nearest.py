"""Exact nearest neighbours by squared Euclidean distance.

One question against a corpus is a scan and a top-k. Many questions against a
corpus is a block join in two passes. Vectors are packed into blocks of cells, which
halve the space along its widest dimension again and again. First each query block meets the blocks of its own cell, which gives every
query a distance that its answer cannot exceed. Then ranges of distances to all
pivots tell, block by block, which other blocks may hold something nearer (triangle
inequality); only those are compared. Nothing is sampled away: every skipped block is
proven to hold no nearer vector.

Rows are brought together by cell before they are packed, and those of a cell are halved
along their widest dimension until they fit a block, so there are about as many blocks as
full ones and cells, however many tasks there are, and each covers little space. Pairs of
blocks never go through a shuffle: a task of the second pass reads a share of the query
blocks and a share of the corpus blocks and pairs them there, so what is written grows as
the vectors do, while the comparing is quadratic where vectors do not cluster.

A task gets blocks in bundles. For a query block it goes through a bundle's blocks from
the closest box on, with the queries that the box may serve, and bounds fall as answers
turn up. Vectors are compared by matrix product in single precision, with room for its
rounding; what is left is compared in doubles. A task hands on at most k rows per query
of what it has seen of the corpus, and ties.

A corpus that is asked more than once is packed once: :func:`corpus_index` keeps blocks,
ranges and pivots as tables under the corpus's fingerprint, and opens them where they
are there already.
"""

import hashlib
import math
import os
import sys
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.session import checkpoint_folder, durable, exists, written
from tallyward.sources.tables import fingerprint

# Task code travels with the tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS = 512
MAX_PROBES = 2048
LANE_BLOCKS = 64
# Rows that a task packs.
PACKED_ROWS = 32_768
# Blocks of a cell that a task holds before it packs them.
CELL_BLOCKS = 32
# Blocks of a share of the queries, unless that makes too many shares; one of the corpus
# has a few times as many. A task pairs two.
SHARE_BLOCKS = 32
CORPUS_SHARE = 4
MAX_SHARES = 64
# Bounds a bundle of blocks.
BUNDLE_BLOCKS = 32
BUNDLE_BYTES = 4_000_000
# Pivots to which the driver and the tasks know the distances of whole cells.
CELL_PIVOTS = 64
# Bounds what one copy of the pivots may hold on the driver and in a task.
MAX_PROBE_VALUES = 4_000_000


def squared_distance(left: Column, right: Column) -> Column:
    """Sum of squared differences, in doubles, from the first dimension on."""
    gaps = F.zip_with(left, right, lambda a, b: a.cast("double") - b.cast("double"))
    return F.aggregate(gaps, F.lit(0.0), lambda total, gap: total + gap * gap)


def nearest_to(
    corpus: DataFrame,
    vector: Sequence[float],
    k: int = 3,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """The k rows nearest to one vector, nearest first, ties by id."""
    question = F.array(*[F.lit(float(v)) for v in vector])
    scored = corpus.where(_usable(F.col(embedding))).withColumn(
        "distance", squared_distance(question, F.col(embedding))
    )
    best = scored.orderBy("distance", vec_id).limit(k)
    rank = F.row_number().over(Window.orderBy("distance", vec_id))
    return best.withColumn("rank", rank)


def _unpacked(packed: bytes, stored: str, width: int) -> np.ndarray:
    return np.frombuffer(packed, stored).reshape(-1, width).astype(np.float64)


def _matrix(vectors) -> np.ndarray:
    return np.array([np.asarray(v, dtype=np.float64) for v in vectors])


def _approximate(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by matrix product, and a bound on their error."""
    left_norm = np.einsum("ij,ij->i", left, left)
    right_norm = np.einsum("ij,ij->i", right, right)
    squared = left_norm[:, None] + right_norm[None, :] - 2.0 * (left @ right.T)
    scale = left_norm.max(initial=0.0) + right_norm.max(initial=0.0)
    slack = 16.0 * (left.shape[1] + 4) * np.finfo(np.float64).eps * scale
    return np.maximum(squared, 0.0), float(slack)


def _distances(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, float]:
    """Plain distances and a bound on their error."""
    squared, slack = _approximate(left, right)
    return np.sqrt(squared), math.sqrt(slack)


def _probes(corpus: DataFrame) -> tuple[np.ndarray, int]:
    """A bounded number of corpus vectors, the same ones on every run, and the
    corpus size; both from one pass. Their number is bounded in values, too, before
    any is fetched; vectors of different widths are refused."""
    known = corpus.agg(
        F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))
    ).first()
    rows, narrow, width = known
    if not rows:
        return np.zeros((0, 0)), 0
    if narrow != width:
        raise ValueError(f"Vectors of different widths: {narrow} and {width}")
    most = max(1, min(MAX_PROBES, MAX_PROBE_VALUES // max(1, width)))
    order = F.xxhash64("_vec_id", "embedding")
    # In one task: a limit that is collected as it is brings as many rows of every task.
    found = corpus.orderBy(order, "_vec_id").limit(most).select("embedding").coalesce(1).collect()
    return _matrix(r[0] for r in found), rows


def _vectors(column: pa.Array) -> np.ndarray:
    """A column of vectors as a matrix."""
    widths = pc.unique(pc.list_value_length(column)).to_pylist()
    if len(widths) != 1:
        raise ValueError(f"Vectors of different widths: {sorted(widths)}")
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), widths[0])


def _halves(probes: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Where to halve the space, level by level, into at most so many cells: dimensions and
    borders, so that cells hold about as many probes each."""
    dimensions, borders, groups = [], [], [probes]
    while 2 * len(groups) <= cells:
        halved = []
        for group in groups:
            along = int(np.ptp(group, axis=0).argmax()) if len(group) else 0
            border = float(np.median(group[:, along])) if len(group) else 0.0
            dimensions.append(along)
            borders.append(border)
            above = group[:, along] > border
            halved += [group[~above], group[above]]
        groups = halved
    return np.array(dimensions, np.int64), np.array(borders)


def _cell(dimensions: np.ndarray, borders: np.ndarray):
    """Task code: rows with the number of their cell. Neighbours have close numbers."""
    levels = (len(borders) + 1).bit_length() - 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors, cell = _vectors(batch["embedding"]), np.zeros(batch.num_rows, np.int64)
            for level in range(levels):
                node = cell + (1 << level) - 1
                values = np.take_along_axis(vectors, dimensions[node][:, None], axis=1)[:, 0]
                cell = 2 * cell + (values > borders[node])
            yield batch.append_column("cell", pa.array(cell.astype(np.int32)))

    return place


def _placed(rows: DataFrame, probes: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """Rows with their cell, of as many cells as pivots or fewer."""
    placed = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])
    return rows.mapInArrow(_cell(*_halves(probes, len(pivots))), placed)


def _by_cell(placed: DataFrame, count: int) -> DataFrame:
    """Rows of a cell together. A crowded cell takes several tasks."""
    parts = max(1, -(-count // PACKED_ROWS))
    return placed.repartitionByRange(parts, "cell", "_vec_id")


def _halved(vectors: np.ndarray, rows: int) -> list[np.ndarray]:
    """Rows in groups of at most so many, as few as they fit in, each covering little space."""
    done, left = [], [np.arange(len(vectors))]
    while left:
        group = left.pop()
        if len(group) <= rows:
            done.append(group)
            continue
        held = vectors[group]
        along = held[:, np.ptp(held, axis=0).argmax()]
        half = -(-len(group) // rows) // 2 * rows
        order = np.argpartition(along, half)
        left += [group[order[half:]], group[order[:half]]]
    return done


def _listed(values: pa.Array) -> pa.Array:
    """One row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _flat(table: pa.Table, name: str) -> pa.Array:
    column = table[name]
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _pack(describe, stored: str, carried: Sequence[str]):
    """Task code: rows to blocks of vectors that share their cell.

    ``describe(block, vectors, cell)`` adds what a block has to tell about itself.
    Buffers hold less than so many blocks per cell.
    """

    def emit(cell: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, vectors = _flat(rows, "_vec_id"), _vectors(_flat(rows, "embedding"))
        # By id, so that a place in the block stands for the id among ties.
        rank = np.empty(len(ids), np.int64)
        rank[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        for group in _halved(vectors, BLOCK_ROWS):
            group = group[rank[group].argsort()]
            at = pa.array(group)
            known = {"_bound": rows["_bound"].to_numpy()[group]} if "_bound" in rows.column_names else {}
            block = {
                "ids": _listed(ids.take(at)),
                "vectors": pa.array([vectors[group].astype(stored).tobytes()], pa.binary()),
                **{c: _listed(_flat(rows, c).take(at)) for c in carried},
                **describe(pd.DataFrame(known, index=range(len(group))), vectors[group], cell),
            }
            yield pa.RecordBatch.from_pydict(block)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[pa.Table]] = {}
        for batch in batches:
            cells = batch["cell"].to_numpy()
            rows = pa.Table.from_batches([batch])
            for cell in np.unique(cells):
                kept = waiting.setdefault(int(cell), [])
                kept.append(rows.take(pa.array(np.flatnonzero(cells == cell))))
                if sum(x.num_rows for x in kept) >= CELL_BLOCKS * BLOCK_ROWS:
                    yield from emit(int(cell), pa.concat_tables(waiting.pop(int(cell))))
        for cell, kept in waiting.items():
            yield from emit(cell, pa.concat_tables(kept))

    return pack


def _bundled(names: Sequence[str], carried: Sequence[str], pack=None):
    """Task code: blocks, or rows that ``pack`` makes blocks of, to rows of many blocks.

    A row tells the number of vectors (``sizes``) and the cell (``cells``) of each block,
    and the order of its vectors by id. Of the blocks' columns it keeps those in ``names``.
    """

    def emit(blocks: pa.Table) -> pa.RecordBatch:
        joined = lambda c: pa.array([b"".join(blocks[c].to_pylist())], pa.binary())
        narrow = lambda v: pa.array([np.asarray(v, np.int32).tobytes()], pa.binary())
        ids = _flat(blocks, "ids").flatten()
        order = np.empty(len(ids), np.int32)
        order[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids), dtype=np.int32)
        row = {
            "key": pa.array([_key()]),
            "ids": _listed(ids),
            "vectors": joined("vectors"),
            "bounds": joined("bounds") if "bounds" in names else None,
            "sizes": narrow(pc.list_value_length(_flat(blocks, "ids")).to_numpy()),
            "cells": narrow(blocks["cell"].to_numpy()),
            "order": narrow(order),
            **{c: _listed(_flat(blocks, c).flatten()) for c in carried},
        }
        if "targets" in names:
            row["targets"] = _listed(pc.unique(_flat(blocks, "targets").flatten()))
        if "held" in names:
            row["held"] = _listed(pc.unique(_flat(blocks, "cell")))
        return pa.RecordBatch.from_pydict({n: row[n] for n in names})

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in pack(batches) if pack else batches:
            for at in range(batch.num_rows):
                block = batch.slice(at, 1)
                waiting.append(block)
                size += len(block["vectors"][0].as_buffer())
                if len(waiting) >= BUNDLE_BLOCKS or size >= BUNDLE_BYTES:
                    yield emit(pa.Table.from_batches(waiting))
                    waiting, size = [], 0
        if waiting:
            yield emit(pa.Table.from_batches(waiting))

    return bundle


def _key() -> int:
    """Tells a row from its neighbours."""
    return int.from_bytes(os.urandom(8), "big") >> 1


def _ranges(vectors: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest distance of a block to each pivot."""
    gaps, slack = _distances(vectors, pivots)
    return gaps.min(axis=0) - slack, gaps.max(axis=0) + slack


def _corpus_block(pivots: np.ndarray):
    """Where a corpus block lies: its cell, and its distances to the pivots."""

    def describe(block: pd.DataFrame, vectors: np.ndarray, cell: int) -> dict:
        low, high = _ranges(vectors, pivots)
        return {"cell": pa.array([cell], pa.int32()), "low": pa.array([low]), "high": pa.array([high])}

    return describe


def _probe_bounds(vectors: np.ndarray, probes: np.ndarray, rank: int) -> np.ndarray:
    """What the probes tell about the answers: ``rank`` of them are no farther away."""
    if len(probes) < rank or not len(vectors):
        return np.full(len(vectors), np.inf)
    near, slack = _distances(vectors, probes)
    return np.partition(near, rank - 1, axis=1)[:, rank - 1] + slack


def _first_block(block: pd.DataFrame, vectors: np.ndarray, cell: int) -> dict:
    """A query block for its own cell, of which nothing is known yet."""
    bounds = np.full(len(vectors), np.inf).astype("<f8").tobytes()
    return {
        "cell": pa.array([cell], pa.int32()),
        "key": pa.array([_key()]),
        "bounds": pa.array([bounds], pa.binary()),
    }


def _second_block(pivots: np.ndarray, probes: np.ndarray, rank: int, cells: dict[int, tuple]):
    """A query block with its bounds and the other cells that may hold a nearer vector than
    it has. Cells are known by their first few pivots."""
    numbers = np.array(list(cells), np.int32)
    lows = np.array([low for low, _ in cells.values()])
    highs = np.array([high for _, high in cells.values()])

    def describe(block: pd.DataFrame, vectors: np.ndarray, own: int) -> dict:
        low, high = _ranges(vectors, pivots[: lows.shape[1]])
        bounds = block["_bound"].to_numpy(np.float64).copy()
        # Queries whose own cell holds too few vectors.
        open_now = np.isinf(bounds)
        bounds[open_now] = _probe_bounds(vectors[open_now], probes, rank)
        apart = np.maximum((low - highs).max(axis=1), (lows - high).max(axis=1))
        targets = numbers[(apart <= bounds.max()) & (numbers != own)]
        return {
            "bounds": pa.array([bounds.astype("<f8").tobytes()], pa.binary()),
            "cell": pa.array([own], pa.int32()),
            "targets": _listed(pa.array(targets, pa.int32())),
        }

    return describe


def _best(q: np.ndarray, c: np.ndarray, distance: np.ndarray, k: int) -> np.ndarray:
    """Which of the found pairs are among the k nearest of their query, ties
    going to the lower place in the block."""
    order = np.lexsort((c, distance, q))
    grouped = q[order]
    first = np.searchsorted(grouped, grouped, side="left")
    return order[np.arange(len(order)) - first < k]


def _lower(best: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Takes values in among the least of their rows."""
    order = np.lexsort((values, rows))
    rows, values = rows[order], values[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    kept = place < best.shape[1]
    touched, at = np.unique(rows[kept], return_inverse=True)
    fresh = np.full((len(touched), best.shape[1]), np.inf)
    fresh[at, place[kept]] = values[kept]
    best[touched] = np.sort(np.concatenate([best[touched], fresh], axis=1), axis=1)[:, : best.shape[1]]


def _places(flags: np.ndarray) -> np.ndarray:
    """Where flags are set, in order; fast where few of many are."""
    flags = flags.ravel()
    if len(flags) < FEW_FLAGS or not flags.any():
        return np.flatnonzero(flags)
    whole = len(flags) // 8 * 8
    words = np.flatnonzero(flags[:whole].view(np.uint64) != 0)
    if 32 * len(words) > whole:
        return np.flatnonzero(flags)
    at = np.flatnonzero(flags[:whole].reshape(-1, 8)[words])
    return np.concatenate([words[at >> 3] * 8 + (at & 7), np.flatnonzero(flags[whole:]) + whole])


class _Blocks:
    """The blocks of a row: vectors in doubles, squared lengths, and for each block the
    place of its vectors, its cell and its box."""

    def __init__(self, packed: bytes, stored: str, width: int, sizes: bytes | None, cells: bytes | None):
        self.vectors = _unpacked(packed, stored, width)
        self.norms = np.einsum("ij,ij->i", self.vectors, self.vectors)
        sizes = np.array([len(self.vectors)]) if sizes is None else np.frombuffer(sizes, np.int32)
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.cells = np.zeros(len(sizes), np.int32) if cells is None else np.frombuffer(cells, np.int32)
        self.low = np.minimum.reduceat(self.vectors, self.starts, axis=0)
        self.high = np.maximum.reduceat(self.vectors, self.starts, axis=0)
        self.reach = float(self.norms.max())
        self._factors: dict = {}

    def factors(self, kind: type, query: bool) -> np.ndarray:
        """What multiplies to the squared distance less the query's squared length."""
        if kind not in self._factors:
            made = np.empty((len(self.vectors), self.vectors.shape[1] + 1), kind)
            made[:, :-1] = -2.0 * self.vectors if query else self.vectors
            made[:, -1] = 1.0 if query else self.norms
            self._factors[kind] = made
        return self._factors[kind]


# Squared lengths between which single precision neither overflows nor underflows.
SINGLE = (1e-20, 1e30)
# So many flags are looked through in one step.
FEW_FLAGS = 65_536
# Boxes are asked query by query, so many at once, as long as that spares this share of
# the comparisons.
SPARED, SPARED_AFTER, ASKED_BOXES = 0.1, 64, 256


class _Search:
    """The answers of one row of query blocks in what a task sees of the corpus."""

    def __init__(self, queries: _Blocks, ids: pa.Array, bounds: bytes, k: int):
        self.queries, self.ids = queries, ids
        with np.errstate(over="ignore"):
            # No answer is farther than this, in squares.
            self.upper = np.square(np.frombuffer(bounds, "<f8")) * (1 + 1e-9)
        self.best = np.full((len(queries.vectors), k), np.inf)
        self.found: list[tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]] = []
        self.held = 0
        self._known: np.ndarray | None = None

    @property
    def known(self) -> np.ndarray:
        if self._known is None:
            self._known = self.ids.to_numpy(zero_copy_only=False)
        return self._known

    def add(self, rows: np.ndarray, distance: np.ndarray, columns: dict[str, pa.Array]) -> None:
        _lower(self.best, rows, distance)
        self.upper = np.minimum(self.upper, self.best[:, -1] * (1 + 1e-9))
        self.found.append((rows, distance, columns))
        self.held += len(rows)
        # What later answers have ruled out is not held for long.
        if self.held > 8 * self.best.size:
            self.found = [self.answers()]
            self.held = len(self.found[0][0])

    def answers(self) -> tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]:
        """Rows among the k nearest, and those that tie with the last of them."""
        rows = np.concatenate([f[0] for f in self.found])
        distance = np.concatenate([f[1] for f in self.found])
        kept = np.flatnonzero(distance <= self.best[rows, -1])
        columns = {n: pa.concat_arrays([f[2][n] for f in self.found]).take(pa.array(kept)) for n in self.found[0][2]}
        return rows[kept], distance[kept], columns


def _compare(width: int, stored: str, k: int, carried: Sequence[str], skip_same_id: bool, names: Sequence[str], others: bool):
    """Task code: for each row of query and corpus blocks, the k nearest rows per query.

    The matrix product picks the candidates, with room for its rounding; their
    distances are then summed dimension by dimension, as in one question. With
    ``others``, blocks of the same cell have met before. Rows of the same query blocks
    come one after another, and are answered together. The last row tells, in place of an
    answer, how many pairs of blocks were compared.
    """
    spared = np.zeros(3)  # comparisons in all, spared by boxes, boxes asked

    def exact(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        gaps = np.ascontiguousarray((left - right).T)
        gaps *= gaps
        total = np.zeros(len(left))
        for gap in gaps:
            total += gap
        return total

    def to_boxes(vectors: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray | None:
        """Squared distances of queries to boxes; None where boxes spare too little."""
        if spared[2] >= SPARED_AFTER and spared[1] < SPARED * spared[0]:
            return None
        total = np.zeros((len(low), len(vectors)))
        for at, floor, roof in zip(vectors.T, low.T, high.T):
            gaps = np.maximum(floor[:, None] - at, at - roof[:, None])
            np.maximum(gaps, 0.0, out=gaps)
            gaps *= gaps
            total += gaps
        return total * (1 - 1e-9)

    def candidates(search: _Search, corpus: _Blocks, corpus_ids: np.ndarray | None):
        """Places of queries and vectors, and no more than the squared distance of each, which
        later candidates may have ruled out; how many pairs of blocks were compared."""
        queries = search.queries
        scale = queries.reach + corpus.reach
        kind = np.float32 if SINGLE[0] < scale < SINGLE[1] else np.float64
        left, right = queries.factors(kind, True), corpus.factors(kind, False)
        slack = 2.0 * (width + 8) * float(np.finfo(kind).eps) * scale
        best, found, pairs = search.best.copy(), [], 0
        for own, (start, end) in enumerate(zip(queries.starts, queries.ends)):
            upper = search.upper[start:end]
            gaps = np.maximum(corpus.low - queries.high[own], queries.low[own] - corpus.high)
            np.maximum(gaps, 0.0, out=gaps)
            apart = np.einsum("ij,ij->i", gaps, gaps) * (1 - 1e-9)
            met = apart <= upper.max()
            if others:
                met &= corpus.cells != queries.cells[own]
            met = np.flatnonzero(met)
            met = met[apart[met].argsort(kind="stable")]
            norms = queries.norms[start:end]
            limits, boxes, waiting, count = None, None, [], 0
            for turn, block in enumerate(met):
                if apart[block] > upper.max():
                    break
                if turn % ASKED_BOXES == 0:
                    these = met[turn : turn + ASKED_BOXES]
                    boxes = to_boxes(queries.vectors[start:end], corpus.low[these], corpus.high[these])
                asked, factors = None, left[start:end]
                if boxes is not None:
                    asked = np.flatnonzero(boxes[turn % ASKED_BOXES] <= upper)
                    spared[:] += end - start, end - start - len(asked), 1
                    if not len(asked):
                        continue
                    if len(asked) == end - start:
                        asked = None
                    else:
                        factors = factors[asked]
                pairs += 1
                first, last = corpus.starts[block], corpus.ends[block]
                rough = factors @ right[first:last].T
                if limits is None:
                    with np.errstate(over="ignore"):
                        limits = np.nextafter((upper - norms + slack).astype(kind), kind(np.inf))
                limit = limits if asked is None else limits[asked]
                hits = _places(rough <= limit[:, None])
                if len(hits) > 8 * k * len(factors) + 64 and last - first > k:
                    if corpus_ids is not None:
                        known = search.known[start:end] if asked is None else search.known[start:end][asked]
                        rough[known[:, None] == corpus_ids[first:last][None, :]] = np.inf
                    last_of = np.partition(rough, k - 1, axis=1)[:, k - 1] + kind(2.0 * slack)
                    limit = np.minimum(limit, np.nextafter(last_of, kind(np.inf)))
                    hits = _places((rough <= limit[:, None]) & np.isfinite(rough))
                if not len(hits):
                    continue
                q, c = np.divmod(hits, last - first)
                value = rough.ravel()[hits]
                q, c = q if asked is None else asked[q], c + first
                value = value + norms[q] + slack
                if corpus_ids is not None:
                    kept = np.flatnonzero(search.known[start:end][q] != corpus_ids[c])
                    q, c, value = q[kept], c[kept], value[kept]
                if not len(q):
                    continue
                found.append((q + start, c, value - 2.0 * slack))
                waiting.append((q, value))
                count += len(q)
                # At once where that spares comparisons, else when it is worth the while.
                if boxes is not None or count >= end - start:
                    part = best[start:end]
                    _lower(part, *(np.concatenate(x) for x in zip(*waiting)))
                    np.minimum(upper, part[:, -1], out=upper)
                    limits, waiting, count = None, [], 0
        if not found:
            return None, pairs
        return tuple(np.concatenate(part) for part in zip(*found)), pairs

    def meet(search: _Search, row: dict) -> int:
        corpus = _Blocks(row["vectors"], stored, width, row.get("sizes"), row.get("cells"))
        ids = row["ids"]
        found, pairs = candidates(search, corpus, ids.to_numpy(zero_copy_only=False) if skip_same_id else None)
        if found is None:
            return pairs
        q, c, least = found
        kept = np.flatnonzero(least <= search.upper[q])
        q, c = q[kept], c[kept]
        step = max(1, 500_000 // width)
        slices = [slice(at, at + step) for at in range(0, len(q), step)]
        if not slices:
            return pairs
        distance = np.concatenate([exact(search.queries.vectors[q[s]], corpus.vectors[c[s]]) for s in slices])
        order = np.frombuffer(row["order"], np.int32)[c] if "order" in row else c
        kept = _best(q, order, distance, k)
        at = pa.array(c[kept])
        search.add(q[kept], distance[kept], {n: row[n].take(at) for n in ("ids", *carried)})
        return pairs

    def told(search: _Search | None) -> Iterator[pa.RecordBatch]:
        if search is not None and search.found:
            rows, distance, columns = search.answers()
            told = {
                "query_id": search.ids.take(pa.array(rows)),
                "vec_id": columns["ids"],
                "distance": pa.array(distance),
                **{n: columns[n] for n in carried},
                "pairs": pa.nulls(len(rows), pa.int64()),
            }
            yield pa.RecordBatch.from_pydict({n: told[n] for n in names})

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, key, pairs, types = None, None, 0, None
        for batch in batches:
            for at in range(batch.num_rows):
                row = {}
                for n in batch.schema.names:
                    cell = batch[n][at]
                    row[n] = cell.values if isinstance(cell, pa.ListScalar) else cell.as_py()
                types = types or {"query_id": row["q_ids"].type, "vec_id": row["ids"].type, **{n: row[n].type for n in carried}}
                if row["key"] != key:
                    yield from told(search)
                    queries = _Blocks(row["q_vectors"], stored, width, row.get("q_sizes"), row.get("q_cells"))
                    search, key = _Search(queries, row["q_ids"], row["bounds"], k), row["key"]
                pairs += meet(search, row)
        yield from told(search)
        if "pairs" in names and types is not None:
            last = {n: pa.nulls(1, t) for n, t in types.items()}
            last |= {"distance": pa.nulls(1, pa.float64()), "pairs": pa.array([pairs], pa.int64())}
            yield pa.RecordBatch.from_pydict({n: last[n] for n in names})

    return compare


def _usable(vector: Column) -> Column:
    """Whether a vector is there, with every element a finite number."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False))


def _ready(df: DataFrame, vec_id: str, embedding: str, carried: Sequence[str]) -> DataFrame:
    return df.where(_usable(F.col(embedding))).select(
        F.col(vec_id).alias("_vec_id"),
        F.col(embedding).alias("embedding"),
        # What is listed in a block may have nulls within, as far as types tell.
        *[F.col(c).cast(df.schema[c].dataType.simpleString()) for c in carried],
    )


def _few_copies(corpus: DataFrame, keep: int) -> DataFrame:
    """At most ``keep`` rows of each distinct vector, those with the lowest ids.

    Ties are ranked by id, so further copies can be in no answer. The limit is
    applied before the shuffle too, so a vector that fills a third of the table
    arrives as a handful of rows per task.
    """
    order = Window.partitionBy("embedding").orderBy("_vec_id")
    return (
        corpus.withColumn("_copy", F.row_number().over(order))
        .where(F.col("_copy") <= keep)
        .drop("_copy")
    )


@dataclass(frozen=True)
class Index:
    """A packed corpus: its blocks as a table, and what the driver knows of them: the
    ranges of each cell and its number of blocks. A corpus without a usable vector has no
    blocks."""

    blocks: DataFrame | None
    pivots: np.ndarray
    probes: np.ndarray
    cells: dict[int, tuple]
    sizes: dict[int, int]
    stored: str
    keep: int
    carry: tuple[str, ...]


def _packed(corpus: DataFrame, keep: int, vec_id: str, embedding: str, carry: Sequence[str], save=durable) -> Index:
    """The corpus in blocks, which ``save`` writes."""
    schema = corpus.schema
    held = _ready(corpus, vec_id, embedding, carry)
    element = schema[embedding].dataType.elementType
    stored = "<f4" if isinstance(element, T.FloatType) else "<f8"
    probes, rows = _probes(held)
    if not len(probes):
        return Index(None, probes, probes, {}, {}, stored, keep, tuple(carry))
    # In the order of the probes, so that the first few are spread as all are.
    pivots = probes[np.sort(np.unique(probes, axis=0, return_index=True)[1])]
    pivots = pivots[: max(1, int(math.sqrt(rows) / 2))]
    id_type = schema[vec_id].dataType.simpleString()
    carried = "".join(f", {c} array<{schema[c].dataType.simpleString()}>" for c in carry)
    ranges = "low array<double>, high array<double>"
    blocks = _by_cell(_placed(_few_copies(held, keep), probes, pivots), rows).mapInArrow(
        _pack(_corpus_block(pivots[:CELL_PIVOTS]), stored, carry),
        f"ids array<{id_type}>, vectors binary{carried}, cell int, {ranges}",
    )
    # The packed corpus is read for its ranges, and in both passes.
    blocks = save(blocks.withColumn("block", F.xxhash64("ids")))
    cells, sizes = _cells(blocks, min(len(pivots), CELL_PIVOTS))
    return Index(blocks, pivots, probes, cells, sizes, stored, keep, tuple(carry))


def corpus_index(
    corpus: DataFrame,
    k: int = 3,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    carry: Sequence[str] = (),
    folder: str | None = None,
) -> Index:
    """The index of a corpus for up to ``k`` answers to a query, from ``folder`` if it is
    there, else packed and written there.

    An index goes by the fingerprint of ids, vectors and carried columns, so a changed
    corpus is packed anew and an unchanged one is read once, for its fingerprint. Its last
    table names the others, so a half-written index is none. Without a ``folder`` it is
    kept in the checkpoint folder until :func:`tallyward.session.drop_durable`.
    """
    spark = corpus.sparkSession
    keep = k + 1
    known = corpus.select(vec_id, embedding, *carry)
    seen = fingerprint(known.withColumn(embedding, F.to_json(embedding))).first()
    said = (ABOUT, known.schema.json(), seen["row_count"], seen["fingerprint"], keep)
    place = f"{folder or checkpoint_folder(spark)}/corpus-{hashlib.md5(repr(said).encode()).hexdigest()}"
    if exists(spark, f"{place}/about/_SUCCESS"):
        return _opened(spark, place, keep, carry)
    name = f"blocks-{uuid.uuid4().hex}"

    def save(blocks: DataFrame) -> DataFrame:
        blocks.write.parquet(f"{place}/{name}")
        return spark.read.schema(blocks.schema).parquet(f"{place}/{name}")

    if folder is None:
        written(place)
    index = _packed(corpus, keep, vec_id, embedding, carry, save)
    packed = lambda m: bytearray(np.ascontiguousarray(m, "<f8").tobytes())
    cells = [(cell, index.sizes[cell], packed(low), packed(high)) for cell, (low, high) in index.cells.items()]
    about = (name if index.blocks is not None else None, index.stored, index.probes.shape[1])
    row = [(*about, packed(index.pivots), packed(index.probes), cells)]
    spark.createDataFrame(row, ABOUT).coalesce(1).write.mode("overwrite").parquet(f"{place}/about")
    return index


ABOUT = (
    "blocks string, stored string, width int, pivots binary, probes binary, "
    "cells array<struct<cell int, blocks long, low binary, high binary>>"
)


def _opened(spark: SparkSession, place: str, keep: int, carry: Sequence[str]) -> Index:
    about = spark.read.schema(ABOUT).parquet(f"{place}/about").first()
    matrix = lambda packed: np.frombuffer(packed, "<f8").reshape(-1, about.width)
    if about.blocks is None:
        return Index(None, np.zeros((0, 0)), np.zeros((0, 0)), {}, {}, about.stored, keep, tuple(carry))
    cells = {c.cell: (np.frombuffer(c.low, "<f8"), np.frombuffer(c.high, "<f8")) for c in about.cells}
    sizes = {c.cell: c.blocks for c in about.cells}
    blocks = spark.read.parquet(f"{place}/{about.blocks}")
    return Index(blocks, matrix(about.pivots), matrix(about.probes), cells, sizes, about.stored, keep, tuple(carry))


def nearest(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 3,
    query_id: str = "vec_id",
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    carry: Sequence[str] = (),
    skip_same_id: bool = False,
    watch: Observation | None = None,
    index: "Index | None" = None,
) -> DataFrame:
    """The k nearest corpus rows of every query: query_id, rank, vec_id, distance
    and the corpus columns named in ``carry``.

    ``skip_same_id`` leaves a query out of its own answer. Ids are unique in
    each table. Vectors that are NULL or have an element that is NULL or not
    finite are no neighbour of any query; as queries they get one row with a
    NULL rank. Vectors of different widths are an error. Calling this runs
    jobs: it picks a few thousand probe vectors at most, writes the packed
    corpus to the checkpoint folder and makes the first pass. With an ``index``
    of the corpus, see :func:`corpus_index`, neither is the corpus read nor packed.
    ``watch`` observes the ``pairs`` of blocks that the second pass compares.
    """
    schema = corpus.schema
    answer = _answer_schema(queries, query_id, schema, vec_id, carry)
    asked = _ready(queries, query_id, embedding, ())
    names = answer.fieldNames()
    blanks = [F.lit(None).cast(answer[n].dataType).alias(n) for n in names[1:]]
    unanswered = queries.where(~_usable(F.col(embedding))).select(
        F.col(query_id).alias("query_id"), *blanks
    )
    wanted = k + int(skip_same_id)
    if index is None:
        index = _packed(corpus, wanted, vec_id, embedding, carry)
    elif index.keep < wanted or not set(carry) <= set(index.carry):
        raise ValueError(f"The index answers up to {index.keep} rows and carries {index.carry}")
    if index.blocks is None:
        return unanswered
    blocks, pivots, probes, stored = index.blocks, index.pivots, index.probes, index.stored
    width = probes.shape[1]
    # A query keeps its cell: blocks of the cell are left out of the second pass.
    placed = durable(_placed(asked, probes, pivots))
    count = placed.count()
    query_type = queries.schema[query_id].dataType.simpleString()
    lanes = _lanes(index.sizes)
    # What a list holds may be NULL, as far as types tell.
    nullable = lambda dtype: T._parse_datatype_string(dtype.simpleString())
    partial = T.StructType([T.StructField(f.name, nullable(f.dataType)) for f in answer.fields if f.name != "rank"])
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")

    def compared(met: DataFrame, others: bool, schema: T.StructType) -> DataFrame:
        task = _compare(width, stored, k, carry, skip_same_id, schema.fieldNames(), others)
        return met.mapInArrow(task, schema)

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    # A cell with many blocks is dealt over several lanes, each joined on its
    # own, so that no task gets the whole of a crowded cell.
    held = blocks.select("ids", "vectors", *carry, "cell", F.pmod("block", lanes).cast("int").alias("lane"))
    packed = f"ids array<{query_type}>, vectors binary, cell int, key long, bounds binary"
    named = ["key", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), "bounds"]
    first = _by_cell(placed, count).mapInArrow(_pack(_first_block, stored, ()), packed)
    lane = F.explode(F.sequence(F.lit(0), (lanes - 1).cast("int"))).alias("lane")
    # Never by broadcast: packed vectors are much smaller in a file than in memory.
    met = first.select(*named, "cell", lane).join(held.hint("merge"), ["cell", "lane"])
    met = met.select("key", "q_ids", "q_vectors", "bounds", "ids", "vectors", *carry)
    near = durable(ranked(compared(met, False, partial)).select(*names))

    # With k neighbours found, the answer is no farther than the last of them.
    last = near.groupBy("query_id").agg(
        F.count("*").alias("_found"), (F.sqrt(F.max("distance")) * (1 + 1e-9)).alias("_reach")
    )
    bound = F.when(F.col("_found") >= k, F.col("_reach")).otherwise(F.lit(float("inf")))
    bounded = placed.join(last, F.col("_vec_id") == F.col("query_id"), "left").select(
        "_vec_id", "embedding", "cell", F.coalesce(bound, F.lit(float("inf"))).alias("_bound")
    )
    told = "sizes binary, cells binary"
    asking = _pack(_second_block(pivots, probes, wanted, index.cells), stored, ())
    row = f"key long, ids array<{query_type}>, vectors binary, bounds binary, {told}, targets array<int>"
    second = durable(
        _by_cell(bounded, count).mapInArrow(_bundled([f.split()[0] for f in row.split(", ")], (), asking), row)
    )
    # Ids and carried columns are listed as they are in the blocks.
    row = T.StructType(
        [
            *T._parse_datatype_string(f"vectors binary, {told}, order binary, held array<int>").fields,
            *[blocks.schema[n] for n in ("ids", *carry)],
        ]
    )
    c = blocks.select("ids", "vectors", *carry, "cell").mapInArrow(_bundled(row.fieldNames(), carry), row)
    c = c.repartition(_shares(sum(index.sizes.values()), CORPUS_SHARE * SHARE_BLOCKS)).alias("c")
    q = second.repartition(_shares(-(-count // BLOCK_ROWS), SHARE_BLOCKS)).alias("q")
    # Which bundles meet is settled by the cells that they can use and hold.
    met = q.join(c.hint("shuffle_replicate_nl"), F.arrays_overlap("q.targets", "c.held"))
    of_query = [F.col(f"q.{n}").alias(f"q_{n}") for n in ("ids", "vectors", "sizes", "cells")]
    of_corpus = [F.col(f"c.{n}") for n in ("ids", "vectors", "sizes", "cells", "order", *carry)]
    met = met.select("q.key", *of_query, "q.bounds", *of_corpus)
    if watch is None:
        rest = compared(met, True, partial)
    else:
        rest = compared(met, True, T.StructType([*partial.fields, T.StructField("pairs", T.LongType())]))
        rest = rest.observe(watch, F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")).where("pairs IS NULL")
    both = near.drop("rank").unionByName(rest.select(*[n for n in names if n != "rank"]))
    return ranked(both).select(*names).unionByName(unanswered)


def _cells(blocks: DataFrame, pivots: int) -> tuple[dict[int, tuple], dict[int, int]]:
    """Ranges of distances of each cell to the first pivots, and its number of blocks.
    There are at most as many cells as pivots in all."""
    bounds = [F.min(F.get("low", F.lit(i))) for i in range(pivots)]
    bounds += [F.max(F.get("high", F.lit(i))) for i in range(pivots)]
    rows = blocks.groupBy("cell").agg(F.count("*"), F.array(*bounds)).collect()
    cells = {cell: (np.array(b[:pivots]), np.array(b[pivots:])) for cell, _, b in rows}
    return cells, {cell: count for cell, count, _ in rows}


def _lanes(sizes: dict[int, int]) -> Column:
    """Over how many lanes the blocks of a cell are dealt."""
    crowded = {cell: math.ceil(count / LANE_BLOCKS) for cell, count in sizes.items() if count > LANE_BLOCKS}
    if not crowded:
        return F.lit(1)
    spread = F.create_map(*[F.lit(v) for pair in crowded.items() for v in pair])
    return F.coalesce(spread[F.col("cell")], F.lit(1))


def _shares(blocks: int, share: int) -> int:
    return max(1, min(MAX_SHARES, math.ceil(blocks / share)))


def _answer_schema(queries, query_id, schema, vec_id, carry) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema[query_id].dataType),
            T.StructField("rank", T.IntegerType()),
            T.StructField("vec_id", schema[vec_id].dataType),
            T.StructField("distance", T.DoubleType()),
            *[T.StructField(c, schema[c].dataType) for c in carry],
        ]
    )


def citations(hits: DataFrame, columns: Sequence[str]) -> DataFrame:
    """What the first hit of each query points to."""
    return hits.where(F.col("rank") == 1).select("query_id", *columns)
