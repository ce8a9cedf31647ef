"""The filter audit against brute force over every order of the filters."""

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from tallyward.llm import filter_audit

SCHEMA = "doc_id long, text string, lang string, mask int, hash string, part string"
LABELS = "doc_id long, quality int, toxic int"
NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failing(doc, docs):
    name, text = doc[0], doc[1] or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": re.search(r"[#$%&*|]", text) is not None,
        "E": name is not None and any(o[0] is not None and o[0] < name and (o[1] or "") == text for o in docs),
    }
    return {f for f, failed in fails.items() if failed}


def expected(docs, labels):
    good = {i for i, quality, _ in labels if quality == 1}
    toxic = {i for i, _, bad in labels if bad == 1}
    fails = [failing(d, docs) for d in docs]
    answer = {}
    for part in {d[2] or "" for d in docs}:
        own = [i for i, d in enumerate(docs) if (d[2] or "") == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = set(own)
            for step, letter in enumerate(order, 1):
                out = {i for i in left if letter in fails[i]}
                gone = set(own) - left
                left = left - out
                shapley[letter] += len(out)
                answer[part, "".join(order), step] = [
                    len(left),
                    len(out),
                    sum(letter in fails[i] for i in gone),
                    sum(fails[i] == {letter} for i in own),
                    sum(docs[i][0] in good for i in out),
                    sum(docs[i][0] in toxic for i in out),
                ]
        for order in itertools.permutations("ABCDE"):
            for step, letter in enumerate(order, 1):
                answer[part, "".join(order), step].append(shapley[letter])
    return answer


def found(spark, docs, labels):
    rows = spark.createDataFrame([(*d, 1, "h", "p") for d in docs], SCHEMA)
    marks = spark.createDataFrame(labels, LABELS)
    answer = filter_audit.audited(rows, marks).collect()
    assert len({(r.part, r.filter_order, r.step) for r in answer}) == len(answer)
    return {(r.part, r.filter_order, r.step): [r[n] for n in NAMES] for r in answer}


@pytest.fixture(scope="module")
def docs():
    pick = random.Random(11)
    long = [" ".join(f"w{i}" for i in range(240)), " ".join(["same"] * 300), "Ä" * 1000 + " " + "b c " * 150]
    kinds = [*long, long[0] + " # sign", long[0] + " CAPITALS" * 9, "short", "short $", "SHORT", "", " \t\n", None]
    return [(i, pick.choice(kinds), pick.choice(["en", "de", "", None])) for i in range(80)]


def test_against_every_order(spark, docs):
    labels = [(i, i % 2, i % 3 == 0) for i in range(0, 80, 2)]
    labels = [(i, q, int(t)) for i, q, t in labels] + [(4, 1, None), (4, 0, 1), (5, None, None), (999, 1, 1)]
    assert found(spark, docs, labels) == expected(docs, labels)


def test_nulls_repeated_rows_and_long_text(spark):
    docs = [(None, "a copy", "en"), (1, "a copy", "en"), (1, "a copy", "en"), (2, "a copy", "en"), (None, None, None)]
    docs += [(3, "x" * 2_000_000, "en"), (4, "x" * 2_000_000, "en"), (5, "word " * 400_000, "en"), (1, "short", "en")]
    assert found(spark, docs, []) == expected(docs, [])


def test_empty_tables(spark):
    assert found(spark, [], []) == {}
    assert found(spark, [], [(1, 1, 1)]) == {}


def test_sketch_never_clears_a_repeat(spark):
    """Full or not, it clears no hash that came twice; with room it clears most others."""
    pick = np.random.default_rng(2)
    once, twice = pick.integers(-(2**63), 2**63 - 1, 20_000), pick.integers(-(2**63), 2**63 - 1, 500)
    keys = np.concatenate([once, twice, twice])
    pick.shuffle(keys)
    rows = spark.createDataFrame([(int(k),) for k in keys], "hash long").repartition(7)
    for told, most in ((len(keys), 0.06), (10, 0.25)):
        maybe = filter_audit.possible_repeat(spark, filter_audit.repeat_sketch(rows, told))
        kept = {r.hash for r in rows.where(maybe("hash")).collect()}
        assert set(twice.tolist()) <= kept
        assert len(kept) - len(set(twice.tolist())) < most * len(once)


def test_full_sketch_changes_no_result(spark, docs, monkeypatch):
    monkeypatch.setattr(filter_audit, "possible_repeat", lambda spark, sketch: lambda c: filter_audit.F.lit(True))
    assert found(spark, docs, []) == expected(docs, [])
