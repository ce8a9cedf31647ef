"""Cheapest repair of conversations, by a dynamic program over a grammar.

A conversation is a string of symbols: each row's role and first fault. Strings recur
across conversations, and so do parts of them. Re-Pair replaces the most frequent
pairs of symbols by rules until no pair comes twice, over all strings of a batch. The
repair is an automaton of four states (nothing yet, after system, user, assistant), so a
symbol is a 4 x 4 matrix: the least cost from state to state, and the edits that reach it.
A rule's matrix is the min-plus product of its two sides, worked out once, bottom up,
and used wherever the rule stands. Edits are ropes: a product joins two ropes without
copying them, and compares two of equal cost by the hashes of their parts.

Rows of a conversation meet by spans of its turns, and only their roles, faults and a
hash of their text. Matrices of spans are multiplied 64 at a time, so a conversation
of any length is spread over tasks. Its repaired text goes through one hash function,
which has to read it in order: one task streams it, row by row.
"""

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.session import durable

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# The characters between words, as SQL text.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPAN = 1024
FAN_IN = 64
NO_TURN = -(1 << 63)
# States: nothing yet, and the initial of the last role.
STATES = 4
START, SYSTEM, USER, ASSISTANT = range(STATES)
ENDS = (START, ASSISTANT)
MOVES = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1


class Rope:
    """A string as the join of two others; equal strings have equal keys."""

    __slots__ = ("size", "key", "left", "right")
    PRIME = (1 << 61) - 1
    BASE = 1_000_003

    def __init__(self, size, key, left=None, right=None):
        self.size, self.key, self.left, self.right = size, key, left, right

    @staticmethod
    def of(text: str) -> "Rope":
        whole = Rope(0, 0)
        for letter in text:
            whole = whole + Rope(1, ord(letter))
        return whole

    def __add__(self, other: "Rope") -> "Rope":
        if not self.size or not other.size:
            return self if self.size else other
        key = (self.key * pow(Rope.BASE, other.size, Rope.PRIME) + other.key) % Rope.PRIME
        return Rope(self.size + other.size, key, self, other)

    def __lt__(self, other: "Rope") -> bool:
        ours, theirs = [self], [other]
        while ours and theirs:
            one, two = ours.pop(), theirs.pop()
            if one.size == two.size and one.key == two.key:
                continue
            if one.size <= 1 and two.size <= 1:
                return (one.size, one.key) < (two.size, two.key)
            for part, stack, longer in ((one, ours, one.size >= two.size), (two, theirs, two.size > one.size)):
                stack += [part.right, part.left] if longer else [part]
        return bool(theirs)

    def __str__(self) -> str:
        letters, todo = [], [self]
        while todo:
            part = todo.pop()
            if part.left is not None:
                todo += [part.right, part.left]
            elif part.size:
                letters.append(chr(part.key))
        return "".join(letters)


# A matrix is a tuple of 16 entries, row by row; an entry is (cost, rope) or None.
def product(one: tuple, two: tuple) -> tuple:
    """Min-plus product; of equal costs the least edits."""
    found = []
    for p in range(STATES):
        for q in range(STATES):
            best = None
            for mid in range(STATES):
                left, right = one[p * STATES + mid], two[mid * STATES + q]
                if left is None or right is None:
                    continue
                cost = left[0] + right[0]
                if best is None or cost <= best[0]:
                    edits = left[1] + right[1]
                    if best is None or cost < best[0] or edits < best[1]:
                        best = cost, edits
            found.append(best)
    return tuple(found)


def inserts() -> tuple:
    """From state to state by inserted rows alone."""
    found = [None] * STATES**2
    for p in range(STATES):
        state, edits = p, Rope.of("")
        for count in range(STATES):
            at = p * STATES + state
            if found[at] is None:
                found[at] = (INSERT * count, edits)
            state = ASSISTANT if state == USER else USER
            edits = edits + Rope.of("I")
    return tuple(found)


def terminal(role: str, fault: str) -> tuple:
    """One row, after any inserted ones. ``role`` is s, u, a or x for any other; ``fault``
    b (blank), d (duplicate), t (truncated) or o."""
    found: list = [None] * STATES**2

    def offer(p: int, q: int, cost: int, edit: str) -> None:
        had = found[p * STATES + q]
        if had is None or (cost, edit) < (had[0], str(had[1])):
            found[p * STATES + q] = (cost, Rope.of(edit))

    more = TRUNCATED if fault == "t" else 0
    for p in range(STATES):
        offer(p, p, DELETE, "D")
        if fault in "bd":
            continue
        for to in "ua":
            if p in MOVES[to]:
                offer(p, MOVES[to][p], REROLE + more, "R")
        if role in MOVES and p in MOVES[role]:
            offer(p, MOVES[role][p], KEEP + more, "K")
    return product(inserts(), tuple(found))


SYMBOLS = [r + f for r in "suax" for f in "bdto"]


def grammar(strings: list[np.ndarray]) -> tuple[list[tuple[int, int]], list[np.ndarray]]:
    """Re-Pair over all strings: rules, numbered from ``len(SYMBOLS)``, and the strings in
    rules. Each round replaces the most frequent pair, and with it those that share no
    symbol with a more frequent one."""
    if not strings:
        return [], []
    lengths = [len(s) for s in strings]
    data = np.full(sum(lengths) + len(strings), -1, np.int64)
    ends = np.cumsum(np.array(lengths) + 1)
    inside = np.ones(len(data), bool)
    inside[ends - 1] = False
    data[inside] = np.concatenate(strings)
    rules: list[tuple[int, int]] = []
    while True:
        many = len(SYMBOLS) + len(rules)
        pairs = np.where((data[:-1] >= 0) & (data[1:] >= 0), data[:-1] * many + data[1:], -1)
        codes, counts = np.unique(pairs[pairs >= 0], return_counts=True)
        order = np.lexsort((codes, -counts))
        order = order[counts[order] >= 2]
        used: set[int] = set()
        taken: list[int] = []
        for code in codes[order].tolist():
            both = divmod(code, many)
            if used.isdisjoint(both):
                used.update(both)
                taken.append(code)
        if not taken:
            break
        at = np.flatnonzero(np.isin(pairs, taken))
        # In a run of one symbol every other pair counts.
        run = np.concatenate(([True], np.diff(at) > 1))
        start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - start) % 2 == 0]
        names = {code: many + i for i, code in enumerate(taken)}
        rules += [divmod(code, many) for code in taken]
        data[at] = [names[c] for c in pairs[at].tolist()]
        data = np.delete(data, at + 1)
    cuts = np.flatnonzero(data < 0)
    return rules, [part[part >= 0] for part in np.split(data, cuts + 1)[:-1]]


def evaluated(strings: list[str]) -> list[tuple]:
    """The matrix of each string of symbols, two characters a symbol."""
    number = {s: i for i, s in enumerate(SYMBOLS)}
    coded = [np.array([number[s[i : i + 2]] for i in range(0, len(s), 2)], np.int64) for s in strings]
    rules, parts = grammar(coded)
    known = [terminal(*s) for s in SYMBOLS]
    for one, two in rules:
        known.append(product(known[one], known[two]))
    found = []
    for part in parts:
        whole = known[part[0]]
        for symbol in part[1:]:
            whole = product(whole, known[symbol])
        found.append(whole)
    return found


def best_edits(whole: tuple) -> tuple[int, str]:
    """Cost and edits from the start to an end of the pattern."""
    closed = product(whole, inserts())
    cost, edits = min((closed[START * STATES + q] for q in ENDS if closed[START * STATES + q]), key=lambda e: (e[0], str(e[1])))
    return cost, str(edits)


MATRIX = "costs array<int>, edits array<string>"
SPAN_ROW = f"conv string, span long, low long, high long, turns long, head string, tail string, illegal long, blank long, duplicate long, truncated long, {MATRIX}"


def _unpacked(costs: list, edits: list) -> tuple:
    return tuple(None if c is None else (c, Rope.of(e)) for c, e in zip(costs, edits, strict=True))


def _packed(whole: tuple) -> tuple[list, list]:
    return [e and e[0] for e in whole], [e and str(e[1]) for e in whole]


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string())}
    names, types = zip(*[c.split() for c in SPAN_ROW.split(", ")], strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), kinds[t]) for c, t in zip(columns, types, strict=True)], list(names)
    )


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: the matrix and the counts of each span; strings that are equal are
    worked out once."""
    for batch in batches:
        rows = batch.to_pylist()
        strings = sorted({r["symbols"] for r in rows})
        known = {s: _packed(m) for s, m in zip(strings, evaluated(strings), strict=True)}
        found = []
        for r in rows:
            roles, faults = r["symbols"][::2], r["symbols"][1::2]
            illegal = sum(roles[i : i + 2] not in LEGAL for i in range(len(roles) - 1))
            counts = [faults.count(f) for f in "bdt"]
            own = (r["conv"], r["span"], r["low"], r["high"], r["turns"], roles[0], roles[-1], illegal)
            found.append((*own, *counts, *known[r["symbols"]]))
        yield _arrow(found)


def _joined(table: pa.Table) -> pa.Table:
    """Task code: up to 64 spans of a conversation as one."""
    rows = table.sort_by("first_span").to_pylist()
    whole, illegal = None, 0
    for i, r in enumerate(rows):
        own = _unpacked(r["costs"], r["edits"])
        whole = own if whole is None else product(whole, own)
        illegal += r["illegal"] + (i > 0 and rows[i - 1]["tail"] + r["head"] not in LEGAL)
    total = lambda name: sum(r[name] for r in rows)
    some = lambda name: [r[name] for r in rows if r[name] is not None] or [None]
    ends = (min(some("low")), max(some("high"))) if some("low") != [None] else (None, None)
    one = (rows[0]["conv"], rows[0]["span"], *ends, total("turns"), rows[0]["head"], rows[-1]["tail"])
    counts = (illegal, total("blank"), total("duplicate"), total("truncated"))
    return pa.Table.from_batches([_arrow([(*one, *counts, *_packed(whole))])])


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code: cost and audit of whole conversations."""
    for batch in batches:
        costs, edits = (batch.column(n).to_pylist() for n in ("costs", "edits"))
        shared: dict[tuple, tuple] = {}
        found = []
        for c, e in zip(costs, edits, strict=True):
            key = (*c, *e)
            if key not in shared:
                shared[key] = best_edits(_unpacked(c, e))
            found.append(shared[key])
        kept = batch.select(["conv", "low", "high", "turns", "illegal", "blank", "duplicate", "truncated"])
        yield pa.RecordBatch.from_arrays(
            [*kept.columns, pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())],
            [*kept.schema.names, "cost", "audit"],
        )


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Task code over rows in order, each conversation led by its audit: the hash of the
    repaired conversation, which is never held."""
    import hashlib

    conv = audit = digest = None
    place = state = lines = 0

    def line(role: str, text: str) -> None:
        nonlocal lines, state
        digest.update((("\n" if lines else "") + f"{role}:{text}").encode())
        lines += 1
        state = MOVES[role[0]][state]

    def next_role() -> str:
        return "assistant" if state == USER else "user"

    def pass_inserts() -> None:
        nonlocal place
        while place < len(audit) and audit[place] == "I":
            line(next_role(), "")
            place += 1

    for batch in batches:
        done = []
        columns = [batch.column(n).to_pylist() for n in ("conv", "audit", "role", "text")]
        for name, edits, role, text in zip(*columns, strict=True):
            if edits is not None:
                if conv is not None:
                    pass_inserts()
                    done.append((conv, digest.hexdigest()))
                conv, audit, digest = name, edits, hashlib.sha256()
                place = state = lines = 0
                continue
            pass_inserts()
            edit = audit[place]
            place += 1
            if edit != "D":
                line(role if edit == "K" else next_role(), text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in zip(*done, strict=True)], ["conv", "sha"])
    if conv is not None:
        pass_inserts()
        yield pa.RecordBatch.from_arrays([pa.array([conv]), pa.array([digest.hexdigest()])], ["conv", "sha"])


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copy after a fixed damage: by the CRC of
    ``conv_id:turn`` modulo 20 a row is 0 dropped, 1 emptied, 2 freed of ``.!?``, 3 given
    twice or 4 made a user's. A null counts as one space, but in conv_id and turn only
    for the CRC."""
    space = F.lit(" ")
    said = lambda c: F.coalesce(F.col(c).cast("string"), space)
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.sequence(F.lit(0), F.when(F.col("kind") == 3, 1).otherwise(0))
    return rows.where("kind <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        F.explode(copies).alias("copy"),
    )


def _key() -> Column:
    """The conversation's id as text, no two alike; null has a key too."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("-"))


def _symbols(rows: DataFrame) -> DataFrame:
    """conv, span, low, high, turns and symbols of every span of a conversation."""
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACES)), F.lit(1))
    narrow = rows.select("conv", "place", "role", "hash", "copy", last.alias("last"))
    keys = ["conv", "place", "role", "hash"]
    first = narrow.groupBy("conv", "role", "hash").agg(F.min("place").alias("place"), F.lit(True).alias("first"))
    marked = narrow.join(first, keys, "left")
    span = F.floor(F.col("place") / SPAN).cast("long").alias("span")
    row = F.struct("place", "role", "hash", "copy", "first", "last")
    spans = marked.groupBy("conv", span).agg(F.sort_array(F.collect_list(row)).alias("rows"))

    def symbol(x: Column, i: Column) -> Column:
        before = F.get("rows", i - 1)
        again = (x["place"] == before["place"]) & (x["role"] == before["role"]) & (x["hash"] == before["hash"])
        initial = F.left(x["role"], F.lit(1))
        fault = (
            F.when(x["last"] == "", "b")
            .when(x["first"].isNull() | F.coalesce(again, F.lit(False)), "d")
            .when(~x["last"].isin(".", "!", "?"), "t")
            .otherwise("o")
        )
        return F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("x"), fault)

    turns = F.array_distinct(F.filter(F.transform("rows", lambda x: x["place"]), lambda p: p != NO_TURN))
    return spans.select(
        "conv",
        "span",
        F.array_min(turns).alias("low"),
        F.array_max(turns).alias("high"),
        F.size(turns).cast("long").alias("turns"),
        F.array_join(F.transform("rows", symbol), "").alias("symbols"),
    )


def _whole(spans: DataFrame) -> DataFrame:
    """One row a conversation: its spans multiplied in order, 64 at a time."""
    dated = F.when(F.col("span") > NO_TURN // SPAN, F.col("span"))
    counts = spans.groupBy("conv").agg(F.count("*").alias("n"), F.min(dated).alias("least"))
    counts = durable(counts.where("n > 1").drop("n"))
    if counts.isEmpty():
        return spans
    alone, level = spans.join(counts, "conv", "left_anti"), spans.join(counts, "conv")
    # From 0, the rows without a turn, so that in the end all are in span 0.
    place = F.coalesce(dated - F.col("least") + 1, F.lit(0))
    level = level.withColumn("span", place).drop("least")
    names = level.columns
    while not level.groupBy("conv").count().where("count > 1").isEmpty():
        level = level.withColumn("first_span", F.col("span"))
        level = level.withColumn("span", F.call_function("div", F.col("span"), F.lit(FAN_IN)))
        level = durable(level.groupBy("conv", "span").applyInArrow(_joined, SPAN_ROW).select(*names))
    return alone.unionByName(level.select(*alone.columns))


def repaired(conversations: DataFrame, damage=damaged) -> DataFrame:
    """One row per conv_id of ``conversations`` (conv_id, turn, role, text): gaps, blank,
    duplicate, truncated, illegal, cost, audit and repaired_sha256.

    ``damage`` is applied to the rows first; it returns conv_id, turn, role, text and
    copy. Rows go by turn, nulls first, then by role, a hash of the text, and copy. A row's
    first fault counts: blank, a copy of an earlier row, or not ending in ``.!?``. Edits are
    K keep (0), R change the role (2), D delete (3, required for the first two faults) and
    I insert an empty row (2), one more for a truncated row that stays; the cheapest that
    give system at most, then user and assistant in turns, or nothing; of equal ones the
    first in alphabetical order. A null conv_id is a conversation. One without rows after
    the damage has zeros, an empty audit and the hash of nothing. Rows of one turn of a
    conversation meet in one task. Runs jobs.
    """
    ids = conversations.select("conv_id", _key().alias("conv")).distinct()
    place = F.coalesce(F.col("turn").cast("long"), F.lit(NO_TURN))
    rows = damage(conversations).select(
        _key().alias("conv"), place.alias("place"), "role", "text", F.md5(F.col("text").cast("binary")).alias("hash"), "copy"
    )
    spans = durable(_symbols(rows).mapInArrow(_spans, SPAN_ROW))
    closed = _whole(spans).mapInArrow(
        _closed,
        "conv string, low long, high long, turns long, illegal long, blank long, duplicate long, truncated long, cost long, audit string",
    )
    closed = durable(closed)
    led = closed.select("conv", F.lit(NO_TURN).alias("place"), F.lit(0).alias("kind"), "audit")
    said = rows.select("*", F.lit(1).alias("kind")).unionByName(led, allowMissingColumns=True)
    ordered = said.repartition("conv").sortWithinPartitions("conv", "kind", "place", "role", "hash", "copy")
    hashed = ordered.select("conv", "audit", "role", "text").mapInArrow(_repaired, "conv string, sha string")
    answer = ids.join(closed, "conv", "left").join(hashed, "conv", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return answer.select(
        "conv_id",
        zero(F.col("high") - F.col("low") + 1 - F.col("turns")).alias("gaps"),
        *[zero(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
