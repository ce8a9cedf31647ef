"""Licence notices in whole texts, also with a few edits.

A notice with at most k edits, cut into k + 1 pieces, has a piece without an edit.
The pieces are exact seeds: only around a seed does the regex library look for the
whole notice with bounded errors, and reports what it found and where. Phrases that
have to stand exactly are found by their words.
"""

import re
import sys
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm import texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Phrases with their labels, and notices with label and most edits.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
NOTICES = (
    ("this work is licensed under the gnu general public license", "gpl", 4),
    ("this program is free software you can redistribute it and or modify it", "gpl", 5),
    ("gnu lesser general public license", "lgpl", 2),
    ("licensed under the apache license version 2 0", "apache", 3),
    ("released under the mit license", "mit", 2),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 5),
    ("redistribution and use in source and binary forms", "bsd", 4),
    ("mozilla public license", "mpl", 1),
    ("licensed under cc by nc 4 0", "cc-by-nc", 2),
    ("licensed under cc by 4 0", "cc-by", 1),
    ("all rights reserved", "proprietary", 1),
)

SPAN = "array<struct<label:string,first_word:long,last_word:long,start:long,end:long,edits:int>>"


def seeds(notice: str, edits: int) -> list[tuple[int, bytes]]:
    """``edits`` + 1 consecutive pieces of a notice, with their places."""
    cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b].encode()) for a, b in zip(cuts, cuts[1:], strict=False)]


def _runs(hits: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """Sorted hits, cut where none reaches across."""
    run, reach = [], 0
    for hit in hits:
        if run and hit[0] >= reach:
            yield run
            run, reach = [], 0
        run.append(hit)
        reach = max(reach, hit[1])
    if run:
        yield run


class Scanner:
    """Finds phrases and notices in one text."""

    def __init__(self, phrases, notices):
        import regex

        # A-Z to a-z, ASCII that is no letter or digit to a space.
        self.table = bytes(
            c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32
            for c in range(256)
        )
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases]
        self.notices = [
            (
                seeds(n, edits),
                regex.compile(rb"(?b)(?<= )(?:%s){e<=%d}(?= )" % (regex.escape(n.encode(), special_only=True, literal_spaces=True), edits)),
                label,
                len(n),
                edits,
            )
            for n, label, edits in notices
        ]

    def places(self, words: bytes, phrase: bytes) -> list[int]:
        found, at = [], words.find(phrase)
        while at >= 0:
            found.append(at + 1)
            at = words.find(phrase, at + 1)
        return found

    def fuzzy(self, words: bytes) -> list[tuple[str, int, int, int, int]]:
        """(label, start, end, edits, length of the notice) of every notice found.

        Windows around seeds are searched one by one, in order, each from where the last
        match of the notice ends, so the work grows with the number of seeds."""
        found = []
        for pieces, pattern, label, length, edits in self.notices:
            windows = set()
            for offset, piece in pieces:
                at = words.find(piece)
                while at >= 0:
                    start = max(0, at - offset - edits - 1)
                    windows.add((start, min(len(words), at - offset + length + edits + 1)))
                    at = words.find(piece, at + 1)
            hits = set()
            for start, end in windows:
                match = pattern.search(words, start, end) if end - start >= length - edits else None
                if match:
                    hits.add((match.start(), match.end(), sum(match.fuzzy_counts)))
            # Of matches that overlap in a run of them, the one with least edits goes first.
            for run in _runs(sorted(hits)):
                taken: list[tuple[int, int, int]] = []
                for hit in sorted(run, key=lambda h: (h[2], h[0] - h[1], h[0])):
                    at = bisect_left(taken, hit)
                    free = at == 0 or taken[at - 1][1] <= hit[0]
                    if free and (at == len(taken) or hit[1] <= taken[at][0]):
                        taken.insert(at, hit)
                found += [(label, *hit, length) for hit in taken]
        return found

    def scan(self, text: bytes) -> dict:
        split = text.translate(self.table).split(b" ")
        split = [w for w in split if w]
        words = b" " + b" ".join(split) + b" "
        starts, labels = [], set()
        for phrase, label in self.phrases:
            places = self.places(words, phrase)
            starts += places
            if places:
                labels.add(label)
        near = self.fuzzy(words)
        # Before every word there is one space more.
        gaps = np.flatnonzero(np.frombuffer(words, np.uint8) == 32) if starts or near else None
        number = lambda at: int(np.searchsorted(gaps, at)) - 1
        spans = []
        if near:
            bounds = self._bounds(text)
            for label, start, end, edits, _ in near:
                first, last = number(start), number(end)
                begin, finish = bounds(first)[0], bounds(last)[1]
                spans.append((label, first, last, begin, finish, edits))
        score = max([1.0 - n[3] / n[4] for n in near] + [1.0] * bool(starts), default=0.0)
        return {
            "n_words": len(split),
            "n_base": len(starts),
            "first_word": number(min(starts)) if starts else None,
            "last_word": number(max(starts)) if starts else None,
            "base_labels": ",".join(sorted(labels)),
            "labels": ",".join(sorted(labels | {n[0] for n in near})),
            "score": score,
            "spans": sorted(spans),
        }

    def _bounds(self, text: bytes):
        """Where a word, by number, begins and ends in the text, in code points."""
        found = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(self.table))]
        # Code points before a byte: bytes that do not go on with one.
        points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
        return lambda i: tuple(int(points[at]) for at in found[i])


FIELDS = (
    ("n_words", "long", pa.int64()),
    ("n_base", "long", pa.int64()),
    ("first_word", "long", pa.int64()),
    ("last_word", "long", pa.int64()),
    ("base_labels", "string", pa.string()),
    ("labels", "string", pa.string()),
    ("score", "double", pa.float64()),
)
SPAN_TYPE = pa.list_(
    pa.struct(
        [
            ("label", pa.string()),
            ("first_word", pa.int64()),
            ("last_word", pa.int64()),
            ("start", pa.int64()),
            ("end", pa.int64()),
            ("edits", pa.int32()),
        ]
    )
)


def _scanning(phrases, notices, names: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices)
        keys = [f.name for f in SPAN_TYPE.value_type]
        for batch in texts.blocks(batches, "_text"):
            data, places = texts.utf8(batch.column("_text"))
            rows = [scanner.scan(data[a:b].tobytes()) for a, b in zip(places, places[1:], strict=False)]
            spans = [[dict(zip(keys, s, strict=True)) for s in r["spans"]] for r in rows]
            columns = [pa.array([r[n] for r in rows], kind) for n, _, kind in FIELDS]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], *columns, pa.array(spans, SPAN_TYPE)],
                [*names, *[n for n, _, _ in FIELDS], "spans"],
            )

    return scan


def scanned(
    docs: DataFrame,
    text: str = "text",
    carry: tuple[str, ...] = ("doc_id",),
    phrases=PHRASES,
    notices=NOTICES,
) -> DataFrame:
    """The columns named in ``carry`` with n_words, n_base, first_word, last_word,
    base_labels, labels, score and spans.

    A-Z is lower-cased; words are runs of letters, digits and non-ASCII characters. The
    base counts all places where a phrase's words follow each other. Spans are the
    notices found with at most their number of edits, by word and by code point; they
    add their labels. The score is 1 for an exact phrase, else 1 less the edits per
    character of the best notice, 0 for none. Null and empty texts have no word. Rows
    are judged one by one, so repeated rows are judged alike.
    """
    source = docs.select(*carry, F.col(text).alias("_text"))
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    fields = ", ".join(f"{n} {kind}" for n, kind, _ in FIELDS)
    return source.mapInArrow(_scanning(phrases, notices, list(carry)), f"{types}, {fields}, spans {SPAN}")
