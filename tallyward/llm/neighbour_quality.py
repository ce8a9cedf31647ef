"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes two blocks of shares, of its byte pairs and of its words that repeat
the word before. A truncated SVD over a bounded sample of labelled texts turns them
into short vectors. The labelled vectors go to every task; each text is compared with
all of them in blocks, and its nearest ones vote with their similarity.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm import texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PAIR_BUCKETS = 1024
WIDTH = PAIR_BUCKETS + 2
RANK = 48
NEIGHBOURS = 25
# Labelled texts of each label at most that the space and the votes are made from.
SAMPLE = 2000
COMPARED = 512


def features(column: pa.Array) -> np.ndarray:
    """A row per text: square roots of the shares of byte pairs, and of words that
    do and do not repeat the word before. Texts without a byte pair have zeros."""
    data, places = texts.utf8(column)
    rows = len(places) - 1
    bucket = (texts.seeded(1 << 16, 4) >> np.uint64(40)).astype(np.int64) % PAIR_BUCKETS
    out = np.zeros((rows, WIDTH), np.float32)
    for row in range(rows):
        own = data[places[row] : places[row + 1]]
        counts = np.zeros(PAIR_BUCKETS, np.int64)
        for start in range(0, len(own) - 1, texts.SEGMENT):
            part = own[start : start + texts.SEGMENT + 1]
            pairs = (part[:-1].astype(np.int32) << 8) | part[1:]
            counts += np.bincount(bucket[pairs], minlength=PAIR_BUCKETS)
        out[row, :PAIR_BUCKETS] = counts / max(1, counts.sum())
    hashes, counts = texts.word_hashes(data, places)
    again = np.concatenate(([False], hashes[1:] == hashes[:-1]))[: len(hashes)]
    ends = np.cumsum(counts)
    first = (ends - counts)[counts > 0]
    again[first] = False
    total = np.concatenate(([0], np.cumsum(again)))
    repeated = total[ends] - total[ends - counts]
    out[:, PAIR_BUCKETS] = repeated / np.maximum(1, counts)
    out[:, PAIR_BUCKETS + 1] = (counts - repeated) / np.maximum(1, counts)
    return np.sqrt(out)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in texts.blocks(batches):
        rows = [r.tobytes() for r in features(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("label"), pa.array(rows, pa.binary())], ["label", "features"]
        )


# A space: the projection, the labelled vectors in it, and their labels.
Space = tuple[np.ndarray, np.ndarray, np.ndarray]


def _projected(rows: np.ndarray, projection: np.ndarray) -> np.ndarray:
    latent = rows @ projection
    return latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)


def space_of(rows: np.ndarray, labels: np.ndarray) -> Space:
    """The leading singular directions of the rows, and the rows in them."""
    if not len(rows):
        return np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0)
    _, basis = np.linalg.eigh(rows.T.astype(np.float64) @ rows)
    projection = basis[:, ::-1][:, : min(RANK, len(rows))].astype(np.float32)
    return projection, _projected(rows, projection), labels.astype(np.float64)


def scores(space: Space, rows: np.ndarray) -> np.ndarray:
    """Similarity-weighted share of label 1 among the nearest labelled texts."""
    projection, vectors, labels = space
    count = len(labels)
    prior = float(labels.mean()) if count else 0.5
    out = np.full(len(rows), prior)
    for start in range(0, len(rows) if count else 0, COMPARED):
        # Cosines as whole numbers, with the place below, so that ties are settled
        # the same way in any block.
        cosine = _projected(rows[start : start + COMPARED], projection) @ vectors.T
        order = np.rint(cosine.astype(np.float64) * 1e5).astype(np.int64) * count
        order += np.arange(count - 1, -1, -1)
        k = min(NEIGHBOURS, count)
        best = np.partition(order, count - k, axis=1)[:, count - k :]
        weight = np.maximum(best // count, 0)
        votes = (weight * labels[count - 1 - best % count]).sum(axis=1)
        total = weight.sum(axis=1)
        out[start : start + COMPARED] = np.where(total > 0, votes / np.maximum(total, 1), prior)
    return np.clip(out, 0.0, 1.0)


def fitted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Space:
    """A space from at most ``SAMPLE`` texts of each label, those with the lowest
    hash of their id. ``labels`` has doc_id and label (0 or 1); null labels and ids
    are left out, an id with both labels counts as 0, of rows with one id the least text
    is taken."""
    known = (
        labels.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.min("label").cast("int").alias("label"))
    )
    order = [F.xxhash64("doc_id"), "doc_id"]
    sample = known.where("label = 0").orderBy(*order).limit(SAMPLE)
    sample = sample.unionByName(known.where("label = 1").orderBy(*order).limit(SAMPLE))
    # A few thousand ids by the limit above.
    held = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(
        F.broadcast(sample), "doc_id"
    )
    # One text an id, so that there are no more rows than sampled ids.
    held = held.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    rows = held.select("label", "text").mapInArrow(_featured, "label int, features binary")
    rows = rows.orderBy("features", "label").collect()
    found = np.array([np.frombuffer(r.features, np.float32) for r in rows], np.float32)
    return space_of(found.reshape(-1, WIDTH), np.array([r.label for r in rows], np.int64))


def _voting(space, text: str, keep: bool):
    """Task code: a score for every text."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.blocks(batches, text):
            found = scores(space.value, features(batch.column(text)))
            names = [n for n in batch.schema.names if keep or n != text]
            kept = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found)], [*names, "score"])

    return vote


def scored(docs: DataFrame, space: Space, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in ``carry`` with score, the weight of label 1 among the
    labelled texts nearest to the text, 0 to 1.

    Null, empty and one-byte texts resemble nothing by byte pairs; a text that has no
    similar labelled text at all gets the share of label 1 in the sample, 0.5 if there
    is no sample. Equal texts have equal scores. Carried columns named score are not
    allowed.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(space)
    keep = text in carry
    rows = docs.select(*carry) if keep else docs.select(*carry, F.col(text).alias("_text"))
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    vote = _voting(shared, text if keep else "_text", keep)
    return rows.mapInArrow(vote, f"{schema}, score double")
