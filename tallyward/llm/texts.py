"""Texts in tasks: an Arrow column as bytes, and 64-bit hashes of its words.

Shared by the operators that read whole texts in Arrow batches. Everything works
on segments of a quarter of a megabyte and blocks of a few of them, so that a task needs
little more memory than its batch; a very long text needs some for its word hashes only.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

# Task code travels with the tasks, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SEGMENT = 250_000
BLOCK = 1_000_000
# The six ASCII white-space characters.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose every output bit depends on every input bit."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def seeded(count: int, seed: int) -> np.ndarray:
    """Fixed 64-bit values by rule, the same in every task."""
    return mixed((np.arange(1, count + 1, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0x9E3779B97F4A7C15))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins; null is empty."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, places, data = column.buffers()
    places = np.frombuffer(places, np.int64 if wide else np.int32)
    places = places[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or not len(places):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[places[0] : places[-1]], places - places[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batches, cut into slices of about ``most`` bytes of text, a row at least."""
    for batch in batches:
        _, places = utf8(batch.column(batch.schema.get_field_index(text)))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(places, places[start] + most, side="right")) - 1
            end = min(batch.num_rows, max(start + 1, end))
            yield batch.slice(start, end - start)
            start = end


def _segments(data: np.ndarray, space: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts that lie in white space or between texts."""
    start, size = 0, len(data)
    while start < size:
        end = min(size, start + SEGMENT)
        while end < size:
            gap = np.flatnonzero(space[end : end + SEGMENT])
            found = end + int(gap[0]) if len(gap) else min(size, end + SEGMENT)
            border = int(places[np.searchsorted(places, end)])
            if len(gap) or border <= found:
                end = min(found, border)
                break
            end = found
        yield start, end
        start = end


def word_hashes(data: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each white-space separated word, A-Z lower-cased, and the
    number of words of each text.

    A word's hash is a polynomial over its bytes, taken as a difference of running
    sums: equal words have equal hashes wherever they stand.
    """
    is_space = np.zeros(256, bool)
    is_space[list(SPACES)] = True
    value = seeded(256, 1)
    value[65:91] = value[97:123]
    base = 0x9E3779B97F4A7C15
    space = is_space[data]
    found, starts_at = [], []
    length = SEGMENT + 1
    power = back = None
    for start, end in _segments(data, space, places):
        if power is None or end - start + 1 > length or len(power) < end - start + 1:
            length = max(min(SEGMENT, len(data)), end - start) + 1
            power = np.cumprod(np.full(length, base, np.uint64))
            back = np.cumprod(np.full(length, pow(base, -1, 1 << 64), np.uint64))
        gap = space[start:end]
        border = np.zeros(end - start + 1, bool)
        inside = places[np.searchsorted(places, start) : np.searchsorted(places, end)]
        border[inside - start] = True
        border[-1] = border[0] = True
        before = np.concatenate(([True], gap[:-1]))
        after = np.concatenate((gap[1:], [True]))
        first = np.flatnonzero(~gap & (before | border[:-1]))
        last = np.flatnonzero(~gap & (after | border[1:]))
        running = np.zeros(end - start + 1, np.uint64)
        np.cumsum(value[data[start:end]] * power[: end - start], out=running[1:])
        found.append((running[last + 1] - running[first]) * back[first])
        starts_at.append(first + start)
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(places) - 1, np.int64)
    starts = np.concatenate(starts_at)
    counts = np.diff(np.searchsorted(starts, places, side="left"))
    return mixed(np.concatenate(found)), counts


def shingle_sets(hashes: np.ndarray, counts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingles of ``width`` words; with fewer
    words the whole sequence as one, without words none."""
    factors = seeded(width, 2) | np.uint64(1)
    ends = np.cumsum(counts)
    for end, count in zip(ends, counts, strict=True):
        own = hashes[end - count : end]
        if count >= width:
            total = np.zeros(count - width + 1, np.uint64)
            for i in range(width):
                total += own[i : count - width + 1 + i] * factors[i]
            yield np.unique(mixed(total))
        elif count:
            yield mixed(np.sum(own * factors[:count], keepdims=True) + np.uint64(count))
        else:
            yield own
