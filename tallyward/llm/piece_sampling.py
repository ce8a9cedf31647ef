"""Distinct sampled segmentations of a text into vocabulary pieces.

A text's lattice has an edge for every piece that spells the characters between two
places. Its segmentations form a tree: a path from the root adds an edge at a time,
and the mass below a prefix is known from a backward pass. Gumbel noise perturbs the
log-probability of every segmentation; perturbed A-star search visits subtrees in the
order of their largest perturbed value, drawn from the top down, so the first k
segmentations it completes are a sample of k without replacement.

The search keeps, for each completed path, what its siblings hold at every place: one
subtree with the mass that was left aside and a value below the path's own. The best
of these is split next. Random numbers are a hash of the row's key and the place, so
the same row has the same samples in any task.
"""

import heapq
import math
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm import texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE = "▁"
BATCH_BYTES = 1_000_000
CHUNKS_KEPT = 100_000
# What spelling a character by its bytes weighs; it has no other spelling.
BYTES_WEIGHT = 20.0


class Vocabulary:
    """Pieces by text, their weights and their bytes."""

    def __init__(self, path: str, alpha: float):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes] = []
        self.byte_ids = [0] * 256
        self.weights: dict[str, tuple[int, float]] = {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.bytes.append(bytes([value]))
                continue
            usable = not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
            self.bytes.append(piece.replace(SPACE, " ").encode() if usable else b"")
            if usable:
                # Scores are ranks; the weight falls with the logarithm of the rank.
                self.weights[piece] = (i, -alpha * math.log1p(-model.get_score(i)))
        self.longest = max(map(len, self.weights))

    def decode(self, ids) -> bytes:
        """The text of a segmentation."""
        found = b"".join([self.bytes[i] for i in ids])
        return found[1:] if found[:1] == b" " else found

    def lattice(self, chunk: str) -> tuple[list, list, list, list]:
        """Edges by place: how many, and their ids, targets and probabilities.

        Places are between characters; further ones, numbered after them, are between
        the bytes of a character that no piece spells. A target of -1 is the end.
        """
        size = len(chunk)
        mass = [0.0] * (size + 1)
        edges: list[list[tuple[int, int, float]]] = [[] for _ in range(size)]
        chains: list[list[tuple[int, int, float]]] = []
        for place in range(size - 1, -1, -1):
            own = edges[place]
            for end in range(place + 1, min(size, place + self.longest) + 1):
                known = self.weights.get(chunk[place:end])
                if known is not None:
                    own.append((known[0], end if end < size else -1, known[1] + mass[end]))
            if chunk[place] not in self.weights:
                target = place + 1 if place + 1 < size else -1
                ids = [self.byte_ids[b] for b in chunk[place].encode()]
                for i in reversed(ids[1:]):
                    chains.append([(i, target, 1.0)])
                    target = size + len(chains) - 1
                own.append((ids[0], target, mass[place + 1] - BYTES_WEIGHT))
            top = max(e[2] for e in own)
            mass[place] = top + math.log(sum(math.exp(e[2] - top) for e in own))
            edges[place] = [(i, t, math.exp(w - mass[place])) for i, t, w in own]
        places = edges + chains
        return (
            [len(p) for p in places],
            [e[0] for p in places for e in p],
            [e[1] for p in places for e in p],
            [e[2] for p in places for e in p],
        )


class Lattices:
    """The lattices of all distinct chunks of some texts, as flat arrays."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.start: dict[str, int] = {}
        self.first = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)
        self.target = np.zeros(0, np.int64)
        self.probability = np.zeros(0)
        self.source = np.zeros(0, np.int64)
        self.reached = np.zeros(0)

    def add(self, chunks: set[str]) -> None:
        fresh = [c for c in chunks if c not in self.start]
        if len(self.start) + len(fresh) > CHUNKS_KEPT:
            self.clear()
            fresh = list(chunks)
        if not fresh:
            return
        counts, ids, targets, shares = [], [], [], []
        base = len(self.first) - 1
        for chunk in fresh:
            c, i, t, p = self.vocabulary.lattice(chunk)
            self.start[chunk] = base
            counts += c
            ids += i
            targets += [base + x if x >= 0 else -1 for x in t]
            shares += p
            base += len(c)
        counts, shares = np.array(counts), np.array(shares)
        old = len(self.first) - 1
        source = np.repeat(np.arange(old, base), counts)
        first = np.concatenate(([0], np.cumsum(counts)))
        running = np.concatenate(([0.0], np.cumsum(shares)))
        within = running[1:] - np.repeat(running[first[:-1]], counts)
        self.first = np.concatenate((self.first[:-1], self.first[-1] + first))
        self.ids = np.concatenate((self.ids, np.array(ids, np.int32)))
        self.target = np.concatenate((self.target, np.array(targets, np.int64)))
        self.probability = np.concatenate((self.probability, np.minimum(shares, 1.0)))
        self.source = np.concatenate((self.source, source))
        self.reached = np.concatenate((self.reached, source + within))

    def walk(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From each node to the end, an edge at a time by its probability; all edges
        in the order of the nodes, and how many each took."""
        live, at, step = np.arange(len(nodes)), nodes, 0
        owners, edges = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(live):
            found = np.searchsorted(self.reached, at + _uniform(seeds[live], step), side="right")
            found = np.clip(found, self.first[at], self.first[at + 1] - 1)
            owners.append(live)
            edges.append(found)
            at = self.target[found]
            live, at, step = live[at >= 0], at[at >= 0], step + 1
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return np.concatenate(edges)[order], np.bincount(owner, minlength=len(nodes))


def _uniform(seeds: np.ndarray, salt: int) -> np.ndarray:
    """Between 0 and 1, neither included."""
    drawn = texts.mixed(seeds + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
    return ((drawn >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52


def _below(location, limit, uniform):
    """A Gumbel variable at a location, given that it is below a limit."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        return location - np.log(np.exp(location - limit) - np.log(uniform))


class Search:
    """The frontier of one text."""

    def __init__(self, seed: int, chunks: np.ndarray):
        self.seed = seed
        self.chunks = chunks
        self.frontier: list[tuple] = []
        self.paths: list[tuple[np.ndarray, np.ndarray]] = []
        self.samples: list[tuple[np.ndarray, float, float]] = []
        self.pending = None

    def seeds(self, first: int, count: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            base = np.uint64(self.seed) + np.uint64(len(self.samples)) * np.uint64(0xD1B54A32D192ED03)
            places = np.arange(first, first + count, dtype=np.uint64)
            return texts.mixed(base + places * np.uint64(0xABC98388FB8FAC03))

    def begin(self) -> tuple[np.ndarray, np.ndarray]:
        seeds = self.seeds(0, len(self.chunks))
        root = float(-np.log(-np.log(_uniform(np.array([self.seed], np.uint64), 7)[0])))
        none = np.zeros(0, np.int64)
        self.pending = (root, 0.0, none, none)
        return self.chunks, seeds

    def split(self, lattices: Lattices) -> tuple[np.ndarray, np.ndarray] | None:
        """Takes the best subtree, picks one edge of it, and says where to walk on."""
        if not self.frontier:
            return None
        minus, _, path, step, before, taken = heapq.heappop(self.frontier)
        value = -minus
        edges, counts = self.paths[path]
        node = int(lattices.source[edges[step]])
        left = [e for e in range(lattices.first[node], lattices.first[node + 1]) if e not in taken]
        shares = lattices.probability[left]
        ends = np.cumsum(shares)
        seed = self.seeds(step, 1) ^ np.uint64(len(taken))
        chosen = min(int(np.searchsorted(ends, _uniform(seed, 11)[0] * ends[-1], side="right")), len(left) - 1)
        edge = left[chosen]
        if len(left) > 1:
            rest = before + float(np.log(max(ends[-1] - shares[chosen], 1e-300)))
            aside = float(_below(rest, value, _uniform(seed, 13)[0]))
            heapq.heappush(self.frontier, (-aside, len(self.samples), path, step, before, taken | {edge}))
        starts = np.cumsum(counts) - counts
        chunk = int(np.searchsorted(starts, step, side="right")) - 1
        head = np.append(edges[:step], edge)
        head_counts = np.append(counts[:chunk], step - starts[chunk] + 1)
        after = before + float(np.log(lattices.probability[edge]))
        self.pending = (value, after, head, head_counts)
        nodes = self.chunks[chunk + 1 :]
        target = lattices.target[edge]
        if target >= 0:
            nodes = np.append(target, nodes)
        seeds = self.seeds(chunk + 1 - int(target >= 0), len(nodes))
        return nodes, seeds

    def finish(self, lattices: Lattices, edges: np.ndarray, counts: np.ndarray, most: int) -> None:
        """Adds a completed path, and the best of the subtrees it left aside."""
        value, before, head, head_counts = self.pending
        shares = lattices.probability[edges]
        reached = before + np.concatenate(([0.0], np.cumsum(np.log(shares))))
        with np.errstate(divide="ignore"):
            rest = reached[:-1] + np.log(np.where(shares < 1.0 - 1e-14, 1.0 - shares, 0.0))
        seed = self.seeds(1 << 40, len(edges))
        aside = _below(rest, value, _uniform(seed, 17))
        joined = len(head) > 0 and len(head_counts) + len(counts) > len(self.chunks)
        if joined:
            whole_counts = np.concatenate((head_counts, counts))
            whole_counts[len(head_counts)] += whole_counts[len(head_counts) - 1]
            whole_counts = np.delete(whole_counts, len(head_counts) - 1)
        else:
            whole_counts = np.concatenate((head_counts, counts))
        whole = np.concatenate((head, edges))
        path = len(self.paths)
        self.paths.append((whole, whole_counts))
        self.samples.append((whole, float(reached[-1]), value))
        best = np.argsort(-aside, kind="stable")[:most]
        for i in best:
            if aside[i] > -np.inf:
                place = len(head) + int(i)
                heapq.heappush(
                    self.frontier,
                    (-float(aside[i]), len(self.samples), path, place, float(reached[i]), frozenset([int(edges[i])])),
                )

    def threshold(self) -> float:
        return -self.frontier[0][0] if self.frontier else -np.inf


def _chunks(text: str) -> list[str]:
    """Runs that no piece crosses: a space begins one, a line break is one."""
    if not text:
        return []
    return re.findall(f"{SPACE}+[^{SPACE}\n]*|\n|[^{SPACE}\n]+", SPACE + text.replace(" ", SPACE))


def sampled(lattices: Lattices, bodies: list[str], seeds: list[int], k: int) -> list[Search]:
    """Every text's search, with its samples in the order they were found."""
    parts = [_chunks(b) for b in bodies]
    lattices.add({c for p in parts for c in p})
    searches = [
        Search(s % (1 << 64), np.array([lattices.start[c] for c in p], np.int64))
        for s, p in zip(seeds, parts, strict=True)
    ]
    open_now, jobs = searches, [s.begin() for s in searches]
    for done in range(1, k + 1):
        nodes = np.concatenate([j[0] for j in jobs]) if jobs else np.zeros(0, np.int64)
        drawn = np.concatenate([j[1] for j in jobs]) if jobs else np.zeros(0, np.uint64)
        edges, counts = lattices.walk(nodes, drawn)
        ends = np.concatenate(([0], np.cumsum(counts)))
        place = 0
        for search, (own, _) in zip(open_now, jobs, strict=True):
            size = len(own)
            a, b = ends[place], ends[place + size]
            search.finish(lattices, edges[a:b], counts[place : place + size], k + 1 - done)
            place += size
        if done < k:
            found = [(s, s.split(lattices)) for s in open_now]
            open_now = [s for s, job in found if job is not None]
            jobs = [job for _, job in found if job is not None]
    return searches


def _sampling(model: str, alpha: float, k: int, names: list[str], with_ids: bool):
    """Task code: the samples of every text."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        lattices = Lattices(Vocabulary(model, alpha))
        for batch in texts.blocks(batches, "_text", BATCH_BYTES):
            bodies = [t or "" for t in batch.column("_text").to_pylist()]
            searches = sampled(lattices, bodies, batch.column("_seed").to_pylist(), k)
            rows, numbers, ids, sums, logs, values, chances, decoded = [], [], [], [], [], [], [], []
            for row, search in enumerate(searches):
                limit = search.threshold()
                for number, (edges, log_p, value) in enumerate(search.samples):
                    own = lattices.ids[edges]
                    rows.append(row)
                    numbers.append(number)
                    ids.append(own)
                    sums.append(zlib.crc32(own.astype("<u4").tobytes()))
                    logs.append(log_p)
                    values.append(value)
                    chances.append(log_inclusion(log_p, limit))
                    decoded.append(zlib.crc32(lattices.vocabulary.decode(own.tolist())))
            kept = batch.select(names).take(pa.array(rows, pa.int64()))
            columns = [
                pa.array(numbers, pa.int32()),
                pa.array([len(i) for i in ids], pa.int64()),
                pa.array(sums, pa.int64()),
                pa.array(logs, pa.float64()),
                pa.array(values, pa.float64()),
                pa.array(chances, pa.float64()),
                pa.array(decoded, pa.int64()),
            ]
            labels = [*names, "sample", "n_pieces", "ids_crc32", "log_prob", "perturbed", "log_inclusion", "decoded_crc32"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                labels.append("ids")
            yield pa.RecordBatch.from_arrays([*kept.columns, *columns], labels)

    return sample


def log_inclusion(log_p: float, limit: float) -> float:
    """Log of the chance that a segmentation's perturbed value exceeds the limit."""
    rate = log_p - limit
    if rate == np.inf:
        return 0.0
    # For a small rate 1 - exp(-r) is r, which keeps tiny chances from vanishing.
    return rate if rate < -30 else math.log(-math.expm1(-math.exp(min(rate, 700.0))))


def sample_pieces(
    rows: DataFrame,
    text: str,
    key: list[str],
    model: str,
    k: int = 3,
    alpha: float = 0.3,
    with_ids: bool = False,
) -> DataFrame:
    """Up to ``k`` distinct segmentations of each text, drawn without replacement:
    the key columns, sample (0 is the largest perturbed value), n_pieces, ids_crc32
    (little-endian unsigned 32-bit ids), log_prob, perturbed, log_inclusion (log of the
    inclusion probability at the threshold of the next segmentation) and decoded_crc32,
    that of the text the pieces spell; with ids on request.

    A piece weighs ``-alpha * log(1 + rank)``. A text with fewer segmentations has all
    of them, with log_inclusion 0. Null and empty texts have the empty segmentation.
    Seeds come from the key, so repeated rows have the same samples. U+2581 stands for a
    space and is decoded as one.
    """
    named = [F.col(c) for c in key]
    source = rows.select(*named, F.xxhash64(*named).alias("_seed"), F.col(text).alias("_text"))
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key)
    schema = (
        f"{types}, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, "
        "log_inclusion double, decoded_crc32 long" + (", ids array<int>" if with_ids else "")
    )
    return source.mapInArrow(_sampling(model, alpha, k, key, with_ids), schema)


def _decoding(model: str, names: list[str]):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(model, 1.0)
        for batch in batches:
            found = [vocabulary.decode(i or []).decode("utf-8", "replace") for i in batch.column("_ids").to_pylist()]
            kept = batch.select(names)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.string())], [*names, "text"])

    return decode


def decode_pieces(rows: DataFrame, ids: str, key: list[str], model: str) -> DataFrame:
    """The key columns and the text that each row's ids spell; null ids spell nothing."""
    source = rows.select(*key, F.col(ids).alias("_ids"))
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key)
    return source.mapInArrow(_decoding(model, key), f"{types}, text string")
