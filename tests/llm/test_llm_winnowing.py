"""Winnowing against a brute-force version over whole texts."""

import hashlib
import random
import re

from tallyward.llm import registry, winnowing

SCHEMA = "doc_id long, text string, next_text string, span string, guest int"


def picks(text, gram=5, window=8):
    words = re.findall(r"[^\x20\x09-\x0D]{1,16}", text)
    codes = [int(hashlib.md5(w.encode()).hexdigest()[:7], 16) + 1 for w in words]
    runs = []
    for at in range(max(len(codes) - gram + 1, min(len(codes), 1))):
        total = codes[at]
        for step in range(1, gram):
            total = (total * 1_000_003 + (codes[at + step] if at + step < len(codes) else 0)) % (2**31 - 1)
        runs.append(total)
    found = []
    for at in range(max(len(runs) - window + 1, min(len(runs), 1))):
        part = runs[at : at + window]
        place = max(i for i, v in enumerate(part) if v == min(part)) + at
        if (runs[place], place) not in found[-1:]:
            found.append((runs[place], place))
    return found


def likeness(one, two):
    one, two = {h for h, _ in one}, {h for h, _ in two}
    return len(one & two) / len(one | two) if one | two else 1.0


def expected(docs):
    order = sorted(((i, t or "") for i, t in docs), key=lambda d: d[0] if d[0] is not None else -(10**18), reverse=True)
    answer = {}
    for place, (name, text) in enumerate(order):
        after = order[(place + 1) % len(order)][1]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, again = picks(text), picks(edited)
        answer[name] = (
            len(text),
            hashlib.sha256(edited.encode()).hexdigest(),
            " ".join(f"{h:x}:{p}" for h, p in own),
            " ".join(f"{h:x}:{p}" for h, p in again),
            likeness(own, again),
            likeness(own, picks(after)),
        )
    return answer


def as_dict(rows):
    return {r.doc_id: tuple(r)[1:] for r in rows}


def odd_docs():
    pick = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "ünï", "x" * 40, "€uro"]
    docs = [(7 * i - 20, " ".join(pick.choices(words, k=pick.randrange(0, 60)))) for i in range(40)]
    docs += [(1000, None), (1001, ""), (1002, " \t\n"), (1003, "one"), (10**15, "same old song " * 30)]
    return docs + [(-(10**12), "same old song " * 30), (None, "no id " * 9), (2000, "w" * 300_000)]


def test_against_brute_force_with_odd_rows(spark):
    docs = odd_docs()
    rows = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in docs], SCHEMA)
    found = winnowing.fingerprinted(rows).collect()
    assert len(found) == len(docs)
    assert as_dict(found) == expected(docs)


def test_spans_change_nothing(spark, monkeypatch):
    docs = odd_docs()
    monkeypatch.setattr(winnowing, "SPAN_BYTES", 400)
    rows = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in docs], SCHEMA)
    assert as_dict(winnowing.fingerprinted(rows).collect()) == expected(docs)


def test_repeated_rows_and_ids(spark):
    docs = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "other words than those before"), (2, "z")]
    rows = spark.createDataFrame([(i, t, None, None, None) for i, t in docs], SCHEMA)
    found = winnowing.fingerprinted(rows).collect()
    assert sorted(r.n_chars for r in found) == [1, 13, 13, 29]
    prints = {r.fingerprint for r in found if r.n_chars == 13}
    assert len(prints) == 1


def test_empty_table_and_single_document(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert winnowing.fingerprinted(nothing).collect() == []
    one = spark.createDataFrame([(5, "abc def", None, None, None)], SCHEMA)
    assert as_dict(winnowing.fingerprinted(one).collect()) == expected([(5, "abc def")])


def test_shared_passage_shares_a_hash(spark):
    """Twelve tokens in a row, one run and a window, are always found."""
    pick = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(12))
    docs = []
    for name in range(60):
        words = [f"w{pick.randrange(10**6)}" for _ in range(pick.randrange(0, 50))]
        words.insert(pick.randrange(len(words) + 1), passage)
        docs.append((name, " ".join(words)))
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    found = winnowing.fingerprinted(rows).collect()
    sets = [{part.split(":")[0] for part in r.fingerprint.split()} for r in found]
    assert all(a & b for a in sets for b in sets)


def test_registered_query_covers_the_table(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text").collect()
    found = as_dict(registry.REGISTRY["op11_winnowing"](spark, tables).collect())
    assert found == expected([tuple(d) for d in docs])
