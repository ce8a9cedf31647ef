"""Sequences of bounded length with little padding and balanced attention cost.

A block of documents is tokenised and packed inside its task, so tokens never move.
Within a block documents go by descending length to the sequence of least cost that
has room, where a piece of n tokens costs n for its linear and n * n / window for its
quadratic part. A document that fits nowhere whole is cut over the room that is left.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm import texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_TOKENS = 1_000_000
# What a worker remembers: bytes of words and of their ids, some 100 a word on top.
BYTES_KEPT = 64_000_000
BYTES_A_WORD = 100
END_OF_TEXT = 2


def cost(length: int, window: int) -> float:
    """Linear and quadratic attention cost of a piece, in tokens."""
    return length + length * length / window


def balanced(lengths: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece.

    As few sequences as the tokens need; their costs are kept near each other.
    """
    import heapq

    pieces = []
    order = []
    sequences = -(-sum(lengths) // capacity)
    full = 0
    for document, length in enumerate(lengths):
        whole = length // capacity
        pieces += [(document, i * capacity, capacity, full + i, 0) for i in range(whole)]
        full += whole
        if length % capacity:
            order.append((-(length % capacity), document, whole * capacity))
    order.sort()
    used = [0] * (sequences - full)
    spent = [0.0] * (sequences - full)
    heap = [(0.0, s) for s in range(len(used))]
    late = []
    for minus, document, start in order:
        length, aside = -minus, []
        while heap and used[heap[0][1]] + length > capacity:
            aside.append(heapq.heappop(heap))
        if heap:
            _, s = heapq.heappop(heap)
            pieces.append((document, start, length, full + s, used[s]))
            used[s] += length
            spent[s] += cost(length, capacity)
            aside.append((spent[s], s))
        else:
            late.append((document, start, length))
        for entry in aside:
            if used[entry[1]] < capacity:
                heapq.heappush(heap, entry)
    # What fits nowhere whole fills the room that is left, cheapest sequence first.
    for document, start, length in late:
        while length:
            _, s = heapq.heappop(heap)
            part = min(length, capacity - used[s])
            pieces.append((document, start, part, full + s, used[s]))
            used[s] += part
            spent[s] += cost(part, capacity)
            start, length = start + part, length - part
            if used[s] < capacity:
                heapq.heappush(heap, (spent[s], s))
    return pieces


class Words:
    """Token ids of words, remembered by word for as long as the worker lives.

    The tokenizer drops white space and never joins across it, so a text's ids are
    those of its words in turn. Nor does it join an ASCII letter and a sign, so a word of
    such letters with a comma or full stop at its end is that word and the sign. Other
    letters may become several characters in the tokenizer, so their words go to it whole.
    """

    def __init__(self, path: str):
        # Task code is sent anew with each task; what it remembers stays here.
        kept = sys.__dict__.setdefault("tallyward_words", {})
        if path not in kept:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            kept[path] = Tokenizer.from_file(path), {}, [0]
        self.tokenizer, self.known, self.held = kept[path]

    def _remember(self, word: bytes, ids: bytes) -> None:
        self.known[word] = ids
        self.held[0] += len(word) + len(ids) + BYTES_A_WORD

    def _learn(self, fresh: set[bytes]) -> None:
        ended = {w for w in fresh if w[-1:] in (b",", b".") and w[:-1].isalpha()}
        plain = (fresh - ended).union(w[:-1] for w in ended)
        plain = list(plain.union((b",", b".")).difference(self.known))
        for start in range(0, len(plain), 10_000):
            part = plain[start : start + 10_000]
            found = self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)
            for word, entry in zip(part, found, strict=True):
                self._remember(word, np.array(entry.ids, "<u4").tobytes())
        for word in ended:
            self._remember(word, self.known[word[:-1]] + self.known[word[-1:]])

    def ids(self, words: list[bytes]) -> bytes:
        """Their ids, four bytes each."""
        fresh = set(words).difference(self.known)
        if fresh:
            if self.held[0] > BYTES_KEPT:
                self.known.clear()
                self.held[0] = 0
                fresh = set(words)
            self._learn(fresh)
        return b"".join(map(self.known.__getitem__, words))


def _tokens(words: Words, text: bytes) -> np.ndarray:
    parts = []
    # A special token's name in capitals is ordinary text.
    split = (text if b"<|" in text else text.lower()).split()
    for start in range(0, len(split), 10_000):
        parts.append(words.ids(split[start : start + 10_000]))
    parts.append(END_OF_TEXT.to_bytes(4, "little"))
    return np.frombuffer(b"".join(parts), "<u4")


def _packing(path: str, capacity: int, id_type: pa.DataType, with_ids: bool):
    """Task code: documents to pieces, block by block."""

    def emit(ids: list, tokens: list[np.ndarray], first: int) -> tuple[pa.RecordBatch, int]:
        import zlib

        pieces = balanced([len(t) for t in tokens], capacity)
        document, start, length, sequence, offset = (list(c) for c in zip(*pieces, strict=True))
        own = [tokens[d][s : s + n] for d, s, n in zip(document, start, length, strict=True)]
        columns = [
            pa.array([ids[d] for d in document], id_type),
            pa.array(start, pa.int64()),
            pa.array(length, pa.int64()),
            pa.array([zlib.crc32(t) for t in own], pa.int64()),
            pa.array([len(tokens[d]) for d in document], pa.int64()),
            pa.array([first + s for s in sequence], pa.int64()),
            pa.array(offset, pa.int64()),
        ]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        if with_ids:
            columns.append(pa.array([t.astype(np.int32) for t in own], pa.list_(pa.int32())))
            names.append("ids")
        return pa.RecordBatch.from_arrays(columns, names), max(sequence) + 1

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(path)
        first = TaskContext.get().partitionId() << 32
        ids, tokens, held = [], [], 0
        for batch in texts.blocks(batches):
            names = batch.column("doc_id").to_pylist()
            data, places = texts.utf8(batch.column("text"))
            for i, name in enumerate(names):
                found = _tokens(words, data[places[i] : places[i + 1]].tobytes())
                ids.append(name)
                tokens.append(found)
                held += len(found)
                if held >= BLOCK_TOKENS:
                    rows, used = emit(ids, tokens, first)
                    yield rows
                    first += used
                    ids, tokens, held = [], [], 0
        if ids:
            yield emit(ids, tokens, first)[0]

    return pack


def packed(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 4096,
    doc_id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """The pieces of every document: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset, and ids if asked for.

    A document is its ids and then id 2; null and empty texts are id 2 alone. A
    sequence holds at most ``capacity`` ids, its pieces follow each other without a gap.
    Every block of about a million ids leaves less than one sequence of room, which is
    padding. Repeated rows are documents of their own. ``tokenizer`` is the path of a
    tokenizer that drops white space, present on every executor.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    spark_type = docs.schema[doc_id].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    schema = (
        f"doc_id {spark_type.simpleString()}, start long, length long, ids_crc32 long, "
        "doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    )
    return source.mapInArrow(_packing(tokenizer, capacity, to_arrow_type(spark_type), with_ids), schema)
