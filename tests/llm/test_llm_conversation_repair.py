"""Conversation repair against a plain search over edits, row by row."""

import hashlib
import itertools
import random
import re
import zlib
from functools import cache

import numpy as np
import pytest

from tallyward.llm import conversation_repair as repair
from tallyward.llm import registry

SCHEMA = "conv_id long, turn long, role string, text string, span int, audit string"
PATTERN = re.compile(r"(s?(ua)+)?")
NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    found = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        elif kind == 2:
            text = re.sub("[.!?]", "", text)
        elif kind == 4:
            role = "user"
        found += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return found


def cheapest(symbols):
    """Least (cost, edits) over all edits, by recursion on rows and roles so far."""

    @cache
    def rest(i, last, inserted):
        found = []
        steps = {"s": "u", "u": "a", "a": "u", "": "u"}
        if inserted < 2:
            cost, edits = rest(i, steps[last], inserted + 1)
            found.append((cost + 2, "I" + edits))
        if i == len(symbols):
            return min([*found, (0 if last in ("", "a") else 10**9, "")])
        role, fault = symbols[i]
        more = int(fault == "t")
        cost, edits = rest(i + 1, last, 0)
        found.append((cost + 3, "D" + edits))
        if fault not in "bd":
            cost, edits = rest(i + 1, steps[last], 0)
            found.append((cost + 2 + more, "R" + edits))
            if role == steps[last] or (role == "s" and last == ""):
                cost, edits = rest(i + 1, role, 0)
                found.append((cost + more, "K" + edits))
        return min(found)

    return rest(0, "", 0)


def expected(rows):
    answer = {}
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        own = [r for r in after if r[0] == conv]
        own.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        seen, symbols, counts = set(), [], dict.fromkeys("bdto", 0)
        for _, _, role, text in own:
            words = NOT_SPACE.findall(text)
            fault = "b" if not words else "d" if (role, text) in seen else "o" if words[-1] in ".!?" else "t"
            seen.add((role, text))
            counts[fault] += 1
            symbols.append((role[:1] if role[:1] in ("s", "u", "a") else "x", fault))
        cost, audit = cheapest(tuple(symbols))
        lines, place, last = [], 0, ""
        for edit in audit:
            role = "assistant" if last == "u" else "user"
            if edit == "I":
                lines.append(f"{role}:")
            else:
                _, _, own_role, text = own[place]
                place += 1
                if edit == "D":
                    continue
                lines.append(f"{own_role if edit == 'K' else role}:{text}")
            last = lines[-1][0]
        assert PATTERN.fullmatch("".join(line[0] for line in lines))
        turns = [r[1] for r in own if r[1] is not None]
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(symbols))
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        answer[conv] = (gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, digest)
    return answer


def found(spark, rows):
    given = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5)
    answer = repair.repaired(given).collect()
    assert len({r.conv_id for r in answer}) == len(answer)
    return {r.conv_id: tuple(r)[1:] for r in answer}


def test_edits_against_all_short_strings():
    """Every string of up to three symbols, and random longer ones, share one grammar."""
    pick = random.Random(7)
    strings = [s for n in (1, 2, 3) for s in itertools.product(repair.SYMBOLS, repeat=n)]
    strings += [tuple(pick.choices(repair.SYMBOLS, k=pick.randrange(4, 40))) for _ in range(400)]
    found = repair.evaluated(["".join(s) for s in strings])
    for string, matrix in zip(strings, found, strict=True):
        assert repair.best_edits(matrix) == cheapest(string)


def test_grammar_gives_the_strings_back():
    pick = np.random.default_rng(1)
    strings = [pick.integers(0, 3, n) for n in (1, 2, 7, 50, 50, 400)] + [np.zeros(9, int), np.zeros(1, int)]
    rules, parts = repair.grammar(strings)

    def expand(symbol):
        if symbol < len(repair.SYMBOLS):
            return [symbol]
        return [t for s in rules[symbol - len(repair.SYMBOLS)] for t in expand(s)]

    assert [[t for s in part for t in expand(s)] for part in parts] == [s.tolist() for s in strings]
    pairs = [p for part in parts for p in itertools.pairwise(part.tolist()) if p[0] != p[1]]
    assert len(pairs) == len(set(pairs))


def test_ropes_compare_as_strings():
    pick = random.Random(3)
    texts = ["".join(pick.choices("DIK", k=pick.randrange(9))) for _ in range(60)]
    ropes = [repair.Rope.of(t[: len(t) // 2]) + repair.Rope.of(t[len(t) // 2 :]) for t in texts]
    assert [str(r) for r in ropes] == texts
    for (a, x), (b, y) in itertools.product(zip(texts, ropes, strict=True), repeat=2):
        assert (x < y) == (a < b)


def odd_rows():
    pick = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None, "use", "User"]
    said = ["Yes.", "No!", "well", "", " \t", None, "Why? ", "Ünï.", "Yes.\n"]
    rows = []
    for conv in range(150):
        for turn in range(pick.randrange(1, 12)):
            rows.append((conv, turn * pick.choice([1, 1, 3]), pick.choices(roles, [9, 9, 2, 1, 1, 1, 1, 1])[0], pick.choice(said)))
    rows += [(None, None, "user", "No id."), (None, 3, "user", "No id."), (500, None, None, None), (501, None, "user", "Hm.")]
    rows += [(502, -5000, "user", "Far."), (502, 5000, "assistant", "Apart."), (502, 10**12, "user", "x" * 2_000_000)]
    return rows + rows[:40]


def test_against_brute_force_with_odd_rows(spark):
    rows = odd_rows()
    assert found(spark, rows) == expected(rows)


def test_long_conversation_over_many_spans(spark, monkeypatch):
    monkeypatch.setattr(repair, "SPAN", 4)
    monkeypatch.setattr(repair, "FAN_IN", 3)
    pick = random.Random(9)
    rows = [(1, t, pick.choice(["user", "assistant"]), pick.choice(["A.", "b", "C!", f"D{t}."])) for t in range(300)]
    rows += [(2, 0, "user", "Hi."), (2, 1, "assistant", "Hi.")]
    assert found(spark, rows) == expected(rows)


def test_empty_table_and_all_dropped(spark):
    assert found(spark, []) == {}
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert found(spark, [(gone, 0, "user", "Hi.")]) == {gone: (0, 0, 0, 0, 0, 0, "", nothing)}


def test_registered_query_covers_the_table(spark, tables):
    rows = [tuple(r) for r in spark.read.parquet(f"{tables}/conversations.parquet").collect()]
    answer = registry.REGISTRY["op13_conversation_repair"](spark, tables).collect()
    assert {r.conv_id: tuple(r)[1:] for r in answer} == expected(rows)


@pytest.mark.parametrize("symbols, edits", [((), (0, "")), ((("u", "o"),), (2, "KI")), ((("x", "o"),), (3, "D"))])
def test_small_cases(symbols, edits):
    assert cheapest(symbols) == edits
