"""Sharding, rules, classifier, near duplicates, packing and notices against brute force."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyward.llm import (
    adaptive_rules,
    license_scan,
    lsh_forest,
    neighbour_quality,
    packing,
    registry,
    sharding,
)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "alpha beta gamma delta " * 5000
DOCS = [
    (1, "one two three four five six", "en", "a", "x"),
    (2, "one two three four five six", "en", "a", "y"),
    (3, None, None, None, None),
    (4, "", "en", None, "x"),
    (5, " \t\n", None, "a", "x"),
    (6, LONG, "en", "a", "x"),
    (7, "Ünïcode words ###\nagain\nagain\n\n x", "de", "b", "x"),
    (7, "Ünïcode words ###\nagain\nagain\n\n x", "de", "b", "x"),
    (None, "no id here at all", "en", "a", "x"),
    (9, "w" * 3_000_000, "en", "a", "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, kept string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(DOCS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark, tables):
    rows = spark.read.parquet(f"{tables}/documents.parquet").collect()
    return {r.doc_id: r for r in rows}


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def rule_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {
        i + j
        for i in range(len(words) - 2)
        if windows[tuple(words[i : i + 3])] > 1
        for j in range(3)
    }
    lines = [line for line in text.split("\n") if WORD.search(line)]
    return (
        len(words),
        sum(map(len, words)),
        sum(text.count(c) for c in "#*$%&|<>"),
        len(lines) - len(set(lines)),
        len(repeated),
    )


# Sharding


def test_shards_are_whole_and_near_equal(spark, tables, documents):
    rows = registry.op1_histogram_shards(spark, tables).collect()
    assert Counter(r.doc_id for r in rows) == Counter(list(documents))
    total = Counter()
    for r in rows:
        data = (documents[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        total[r.shard] += r["size"]
    for shard in total:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))
    largest = max(r["size"] for r in rows)
    mean = sum(total.values()) / 40
    assert set(total) <= set(range(40))
    assert max(total.values()) <= mean + 2 * largest


def test_a_group_with_most_rows_is_cut(spark):
    rows = spark.range(20_000).select(
        F.col("id").alias("doc_id"), F.lit(100).cast("long").alias("size"),
        F.when(F.col("id") < 15_000, F.lit("copy")).otherwise(F.col("id").cast("string")).alias("text"),
        F.lit(9).alias("shard"), F.lit("z").alias("slot"),
    )
    placed = sharding.histogram_shards(rows, "size", F.col("text"), ["doc_id"], 8)
    counts = {r.shard: r["count"] for r in placed.groupBy("shard").count().collect()}
    assert set(counts) == set(range(8))
    assert max(counts.values()) - min(counts.values()) <= 0.01 * 2500
    # Copies stay together: only shards at the ends of the run hold other texts too.
    mixed = placed.groupBy("shard").agg(F.countDistinct(F.col("text") == "copy").alias("n"))
    assert mixed.where("n > 1").count() <= 2


def test_shards_of_repeated_rows_and_of_none(spark):
    same = spark.createDataFrame([(1, 10, "a")] * 40, "doc_id long, size long, text string")
    placed = sharding.histogram_shards(same, "size", F.col("text"), ["doc_id"], 4)
    assert sorted(r["count"] for r in placed.groupBy("shard").count().collect()) == [10] * 4
    empty = sharding.histogram_shards(same.limit(0), "size", F.col("text"), ["doc_id"], 4)
    assert empty.collect() == []
    nulls = spark.createDataFrame([(None, 16, None)] * 3, "doc_id long, size long, text string")
    assert sharding.histogram_shards(nulls, "size", F.col("text"), ["doc_id"], 2).count() == 3


# Rules


def test_counts_equal_brute_force(spark, tables, documents, odd):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for r in registry.op3_adaptive_rules(spark, tables).collect():
        assert tuple(r[n] for n in names) == rule_counts(documents[r.doc_id].text), r.doc_id
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    for r in adaptive_rules.counted(odd).collect():
        if r.doc_id != 9:
            assert tuple(r[n] for n in names) == rule_counts(r.text), r.doc_id


def test_no_window_of_a_very_long_text_is_taken_for_another(spark):
    # All words differ, so nothing is repeated; with 42 bits of the hash, windows agree.
    body = "array_join(transform(sequence(1, 4190000), i -> concat('w', i)), ' ')"
    row = adaptive_rules.counted(spark.range(1).select(F.expr(body).alias("text"))).first()
    assert (row.n_words, row.n_repeat_words) == (4_190_000, 0)


def test_limits_follow_the_group(spark):
    # In source b every document has many symbols, so there they are no fault.
    rows = []
    for i in range(200):
        words = [f"w{i}x{j}" for j in range(60)]
        rows.append((i, " ".join(words if i % 2 == 0 or i % 50 == 1 else [w + "#" for w in words]), "en", "ab"[i % 2]))
    rows += [(1000 + i, " ".join(f"v{i}x{j}#" for j in range(60)), "en", "a") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in adaptive_rules.judged(docs).collect()}
    assert all(kept[i] for i in range(0, 200, 2))
    assert all(kept[i] for i in range(3, 50, 2))
    assert not any(kept[1000 + i] for i in range(3))


def test_limits_equal_exact_quantiles(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    measured = adaptive_rules._measured(adaptive_rules.counted(docs)).cache()
    parts = adaptive_rules.sketches(measured, ["lang", "source"])
    limits = {(r.lang, r.source): r.limits for r in adaptive_rules.limits(parts, ["lang", "source"]).collect()}
    failed = lambda r: r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
    rows = [r for r in measured.collect() if not failed(r)]

    def quantile(values, share):
        values = sorted(values)
        return values[max(0, int(np.ceil(share * len(values))) - 1)]

    assert limits
    for (lang, source), found in limits.items():
        own = [r for r in rows if (r.lang, r.source) == (lang, source)]
        wide = [r for r in rows if r.lang == lang]
        group = own if len(own) >= 30 else wide if len(wide) >= 30 else rows
        for m, (side, rank, spreads, room) in adaptive_rules.MEASURES.items():
            values = [r[m] for r in group]
            middle = quantile(values, 0.5)
            reach = max(spreads * abs(quantile(values, rank) - middle), room)
            low, high = found[f"{m}_low"], found[f"{m}_high"]
            assert low == (-np.inf if side == "high" else pytest.approx(middle - reach))
            assert high == (np.inf if side == "low" else pytest.approx(middle + reach))


def test_sketches_set_the_limits_not_the_least_rooms(spark, tables):
    docs = spark.read.parquet(f"{tables.replace('0.001', '0.01')}/documents.parquet")
    measured = adaptive_rules._measured(adaptive_rules.counted(docs)).cache()
    parts = adaptive_rules.sketches(measured, ["lang", "source"])
    own = [r.limits for r in adaptive_rules.limits(parts, ["lang", "source"]).collect()]
    for m in ("sign_share", "word_length", "repeat_share"):
        assert sum(f[f"{m}_own"] for f in own) >= 0.9 * len(own), m
    # In another corpus, with a sign after every other word, each limit is another one.
    spoken = docs.withColumn("text", F.regexp_replace("text", " (\\S+) (\\S+) (\\S+)", " $1-! $2$3 $1-! $2$3"))
    measured = adaptive_rules._measured(adaptive_rules.counted(spoken)).cache()
    parts = adaptive_rules.sketches(measured, ["lang", "source"])
    other = [r.limits for r in adaptive_rules.limits(parts, ["lang", "source"]).collect()]
    for name in ("sign_share_high", "word_length_low", "word_length_high", "repeat_share_high"):
        assert not {f[name] for f in own} & {f[name] for f in other}, name


def test_good_documents_stay_and_bad_ones_go(spark, tables):
    folder = tables.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in registry.op3_adaptive_rules(spark, folder).collect() if not r.base_failed]
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1]
    bad = [r.kept for r in rows if labels.get(r.doc_id) == 0]
    assert sum(good) >= 0.98 * len(good)
    assert sum(bad) <= 0.1 * len(bad)


def test_rules_of_odd_rows(spark, odd, nothing):
    found = adaptive_rules.judged(odd)
    rows = found.collect()
    assert len(rows) == len(DOCS)
    assert all(not r.kept for r in rows if not (r.n_words >= 50))
    assert "_given_kept" in found.columns
    assert adaptive_rules.judged(nothing).collect() == []


# Classifier


def test_classifier_on_held_out_labels(spark, tables):
    docs = spark.read.parquet(f"{tables.replace('0.001', '0.01')}/documents.parquet")
    folder = tables.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = registry.op2_neighbour_quality(spark, folder).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in held)
    assert right >= 0.95 * len(held)


def test_votes_equal_brute_force(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0), (6, 1), (7, 0), (8, 1), (None, 1), (4, None)], "doc_id long, label int")
    space = neighbour_quality.fitted(odd, labels)
    projection, vectors, known = space
    assert len(vectors) == 5
    import pyarrow as pa

    bodies = [d[1] for d in DOCS]
    rows = neighbour_quality.features(pa.array(bodies))
    latent = neighbour_quality._projected(rows, projection)
    found = [r.score for r in neighbour_quality.scored(odd.coalesce(1), space).collect()]
    for vector, score in zip(latent, found, strict=True):
        cosine = np.maximum(np.rint((vectors @ vector).astype(float) * 1e5), 0)
        expected = (cosine * known).sum() / cosine.sum() if cosine.sum() else known.mean()
        assert score == pytest.approx(expected, abs=1e-4)
    assert found[0] == found[1]


def test_classifier_without_labels_or_documents(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, label int")
    space = neighbour_quality.fitted(odd, none)
    assert {r.score for r in neighbour_quality.scored(odd, space).collect()} == {0.5}
    assert neighbour_quality.scored(nothing, space).collect() == []


# Near duplicates


def components(texts, width, share=80):
    sets = {}
    for key, text in texts.items():
        words = WORD.findall(lowered(text))
        whole = {tuple(words)} if words else set()
        sets[key] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or whole
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= share * (len(sets[a]) + len(sets[b]) - common):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in sets}


def test_components_equal_brute_force(spark, tables, documents):
    expected = components({k: r.text for k, r in documents.items()}, 4)
    rows = registry.op6_lsh_forest(spark, tables).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == expected
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_a_large_region_of_near_copies(spark):
    # Hundreds of variants of one text, one group at the edge of likeness, and copies.
    base = [f"t{i}" for i in range(120)]
    texts = {}
    for i in range(300):
        words = list(base)
        words[i % 120] = f"x{i}"
        texts[i] = " ".join(words)
    for i in range(300, 320):
        texts[i] = " ".join(f"u{i}y{j}" for j in range(60))
    for i in range(320, 340):
        texts[i] = texts[i - 20] + " tail" * (i % 4)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in lsh_forest.near_duplicates(docs, width=5).collect()}
    assert found == components(texts, 5)


def test_a_star_of_variants_linked_only_with_their_base(spark):
    # Seven words of 400 replaced: 0.838 to the base, about 0.7 to other variants.
    base, chosen = [f"t{i}" for i in range(400)], random.Random(5)
    texts = {0: " ".join(base)}
    for i in range(1, 3001):
        words = list(base)
        for k in chosen.sample(range(1, 66), 7):
            words[6 * k] = f"x{i}y{k}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(8)
    found = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(docs, width=5).collect()}
    assert found == dict.fromkeys(texts, 0)


def crowd_links(spark, own, roots):
    """Confirmed pairs, by place, between sets of one crowded region."""
    ids = [b"%04d" % i for i in range(len(own))]
    sizes = [len(s) for s in own]
    full = spark.createDataFrame([(i, s.tobytes()) for i, s in zip(ids, own, strict=True)], "set_id binary, shingles binary")
    rows = [(i, n, lsh_forest._parities(s)) for i, n, s in zip(ids, sizes, own, strict=True)]
    sets = spark.createDataFrame(rows, "set_id binary, n_shingles long, spread binary")
    crowded = spark.createDataFrame([(7, i, n) for i, n in zip(ids, sizes, strict=True)], "region long, set_id binary, n_shingles long")
    linked = [(ids[i], ids[r]) for i, r in enumerate(roots) if r is not None]
    found = spark.createDataFrame(linked, "node binary, root binary")
    pairs = lsh_forest._met(full, sets, crowded, found, 80).distinct()
    return {(int(r.a), int(r.b)) for r in lsh_forest._confirmed(full, pairs, 80).collect()}


def test_sets_of_a_crowded_region_are_compared_past_a_component(spark):
    # Links count on full sets, past any number of sets of one component.
    shared = np.arange(1, 401, dtype=np.uint64)
    sets = [shared] * 200 + [np.concatenate((shared[:356], np.arange(1000, 1044, dtype=np.uint64)))]
    sets += [np.concatenate((shared[:355], np.arange(2000, 2045, dtype=np.uint64)))]
    # 356 of 444 are enough, 355 of 445 are not.
    assert crowd_links(spark, sets, [0] * 200 + [None] * 2) == {(i, 200) for i in range(200)}


def test_a_component_in_between_hides_no_link(spark):
    own = [np.arange(k, k + 100, dtype=np.uint64) for k in (1, 5001, 11)]
    # 90 of 110 are shared, and 300 sets of one component lie in between.
    assert crowd_links(spark, [own[0], *[own[1]] * 300, own[2]], [None, *[1] * 300, None]) == {(0, 301)}


@pytest.mark.parametrize("lane", [3, 512])
def test_a_crowded_region_over_lanes_equals_brute_force(spark, monkeypatch, lane):
    monkeypatch.setattr(lsh_forest, "LANE_SETS", lane)
    pick = np.random.default_rng(4)
    passage = pick.integers(0, 2**64, 60, dtype=np.uint64)
    sets = []
    for size in (40, 90, 200):
        base = pick.integers(0, 2**64, size, dtype=np.uint64)
        for _ in range(30):
            kept = base[pick.random(size) > pick.choice([0, 0.05, 0.1, 0.15])]
            fresh = pick.integers(0, 2**64, int(pick.integers(0, size // 8)), dtype=np.uint64)
            sets.append(np.unique(np.concatenate((passage, kept, fresh))))
    roots = [0 if i < 8 else 40 if 40 <= i < 44 else None for i in range(len(sets))]
    wanted = set()
    for a, b in combinations(range(len(sets)), 2):
        common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        same = roots[a] is not None and roots[a] == roots[b]
        if not same and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            wanted.add((a, b))
    assert len(wanted) > 200
    assert crowd_links(spark, sets, roots) == wanted


def test_near_duplicates_of_odd_rows(spark, odd, nothing):
    rows = lsh_forest.near_duplicates(odd, width=4).collect()
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert found[1] == [(3, 1, True)] and found[2] == [(3, 1, False)]
    assert found[3] == [(0, 3, True)] and found[4] == [(0, 4, True)] and found[5] == [(0, 5, True)]
    assert found[6] == [(4, 6, True)]
    assert len(found[7]) == 2 and len(set(found[7])) == 1
    assert found[None] == [(2, None, True)]
    assert lsh_forest.near_duplicates(nothing).collect() == []


# Packing


def test_packing_round_trip(spark, tables, documents, odd):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path(registry.TOKENIZER)
    tokenizer = Tokenizer.from_file(path)
    found = packing.packed(spark.read.parquet(f"{tables}/documents.parquet"), path, with_ids=True).collect()
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(documents)
    for key, pieces in by_doc.items():
        ids = tokenizer.encode(documents[key].text or "", add_special_tokens=False).ids + [2]
        place = 0
        for r in sorted(pieces, key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.length) == (place, len(ids), len(r.ids))
            assert r.ids == ids[place : place + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
            place += r.length
        assert place == len(ids)
    for pieces in by_sequence.values():
        place = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == place
            place += r.length
        assert place <= 4096
    assert len(by_sequence) * 4096 < 1.05 * sum(r.length for r in found)
    small = packing.packed(odd.where("doc_id is null or doc_id < 6"), path).collect()
    assert {r.doc_id: r.doc_tokens for r in small if r.doc_id in (3, 4, 5)} == {3: 1, 4: 1, 5: 1}


def test_costs_are_balanced():
    lengths = [int(x) for x in np.random.default_rng(0).integers(1, 3000, 500)]
    pieces = packing.balanced(lengths, 4096)
    covered, spent, used = Counter(), Counter(), Counter()
    for document, _, length, sequence, offset in pieces:
        assert offset == used[sequence]
        covered[document] += length
        spent[sequence] += packing.cost(length, 4096)
        used[sequence] += length
    assert [covered[i] for i in range(500)] == lengths
    assert len(used) == -(-sum(lengths) // 4096) and max(used.values()) <= 4096
    costs = sorted(spent.values())
    assert costs[len(costs) // 20] > 0.75 * costs[-1]


@pytest.mark.parametrize("text", ["A\x0bb!\x0b!", "!\x1c!", "İ Σ ΣΣ'S don't", "Å x", "<|ENDOFTEXT|> <|endoftext|>a", "a　b !"])
def test_words_give_the_ids_of_the_text(text):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path(registry.TOKENIZER)
    expected = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids + [2]
    assert packing._tokens(packing.Words(path), text.encode()).tolist() == expected


def test_signs_after_every_letter():
    """Some letters become several characters, the last of which joins a sign."""
    from tokenizers import Tokenizer

    path = registry.tokenizer_path(registry.TOKENIZER)
    tokenizer, words = Tokenizer.from_file(path), packing.Words(path)
    letters = [chr(c) for c in range(0x30000) if chr(c).isalpha()]
    for sign in ".,":
        for start in range(0, len(letters), 5000):
            texts = ["ab" + letter + sign for letter in letters[start : start + 5000]]
            wanted = tokenizer.encode_batch(texts, add_special_tokens=False)
            found = [packing._tokens(words, t.encode()).tolist() for t in texts]
            assert found == [[*w.ids, 2] for w in wanted]


def test_what_a_worker_remembers_is_bounded(monkeypatch):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path(registry.TOKENIZER)
    tokenizer, words = Tokenizer.from_file(path), packing.Words(path)
    monkeypatch.setattr(packing, "BYTES_KEPT", 3000)
    for i in range(40):
        text = f"{'x' * 500}{i} y{i}, z{i}."
        assert packing._tokens(words, text.encode()).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]
        assert len(words.known) < 40 or i == 0


def test_packing_long_texts(odd):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path(registry.TOKENIZER)
    tokenizer = Tokenizer.from_file(path)
    rows = packing.packed(odd, path, with_ids=True).collect()
    for key, text in ((6, LONG), (9, "w" * 3_000_000), (None, "no id here at all")):
        own = sorted((r.start, r.ids) for r in rows if r.doc_id == key)
        assert [i for _, ids in own for i in ids] == [*tokenizer.encode(text, add_special_tokens=False).ids, 2]


def test_packing_nothing(nothing):
    assert packing.packed(nothing, registry.tokenizer_path(registry.TOKENIZER)).collect() == []


# Licence notices

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_places(text):
    words = TERM.findall(lowered(text))
    starts, labels = [], set()
    for phrase, label in license_scan.PHRASES:
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i : i + len(parts)] == parts:
                starts.append(i)
                labels.add(label)
    first, last = (min(starts), max(starts)) if starts else (None, None)
    return len(words), len(starts), first, last, ",".join(sorted(labels))


def test_phrases_equal_brute_force(spark, tables, documents, odd):
    for r in registry.op5_license_notices(spark, tables).collect():
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
        assert got == base_places(documents[r.doc_id].text)
        assert 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert len(license_scan.scanned(odd).collect()) == len(DOCS)


def test_notices_with_edits(spark):
    rows = [
        (1, "Text. Relesed under the MIT Licence!! and more"),
        (2, "Licensed under CC BY-NC 4.0."),
        (3, "ÄÖ ü permission  is\nhereby granted, fre of charge, to any persn obtaining a copy"),
        (4, "mit\n-license; MIT LICENSE and summit license"),
        (5, "a clean text about licensing nothing at all"),
        (6, "Released under the MIT license"),
        (7, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in license_scan.scanned(docs).collect()}
    assert found[1].labels == "mit" and found[1].n_base == 0
    span = found[1].spans[0]
    assert span.label == "mit" and span.edits == 2
    assert rows[0][1][span.start : span.end] == "Relesed under the MIT Licence"
    assert found[2].base_labels == "cc-by" and found[2].labels == "cc-by,cc-by-nc"
    assert found[3].labels == "mit" and found[3].spans[0].edits == 2
    assert rows[2][1][found[3].spans[0].start : found[3].spans[0].end].startswith("permission")
    assert (found[4].n_base, found[4].first_word, found[4].last_word) == (2, 0, 2)
    assert (found[5].labels, found[5].score, found[5].spans) == ("", 0.0, [])
    assert found[6].score == 1.0
    assert (found[7].n_words, found[7].first_word, found[7].labels) == (0, None, "")


def test_thousands_of_edited_notices_in_one_text():
    """Each is found in its place, and twice as many take about twice the time."""
    import time

    scanner = license_scan.Scanner(license_scan.PHRASES, license_scan.NOTICES)
    spent = []
    for many in (2000, 20_000):
        text = "".join(f"é{i} Relesed under the MIT license, w{i}. " for i in range(many))
        before = time.process_time()
        spans = [s for s in scanner.scan(text.encode())["spans"] if s[0] == "mit"]
        spent.append(time.process_time() - before)
        assert len(spans) == many
        assert all(text[s[3] : s[4]] == "Relesed under the MIT license" and s[5] == 1 for s in spans)
        assert [s[1] for s in spans] == [1 + 7 * i for i in range(many)]
    assert spent[1] < 30 * max(spent[0], 0.05)


def test_spans_of_the_query_lie_in_the_texts(spark, tables, documents):
    rows = registry.op5_license_notices(spark, tables).where("size(spans) > 0").collect()
    assert rows
    for r in rows:
        text = documents[r.doc_id].text
        for span in r.spans:
            assert len(TERM.findall(lowered(text[span.start : span.end]))) == span.last_word - span.first_word + 1
            assert span.label in r.labels.split(",")


def test_a_notice_with_more_edits_before_a_better_one():
    scanner = license_scan.Scanner(license_scan.PHRASES, license_scan.NOTICES)
    spans = scanner.scan(b"the mozila public license mozilla public license end")["spans"]
    assert [(s[0], s[1], s[2], s[5]) for s in spans] == [("mpl", 1, 3, 1), ("mpl", 4, 6, 0)]


def test_parities_rule_out_no_link():
    """Of neighbours in a run, every pair at four fifths or more stays, large sets included."""
    pick = np.random.default_rng(12)
    sets = []
    for size in (4, 9, 40, 300, 3000, 40_000):
        base = pick.integers(0, 2**63, size, dtype=np.uint64)
        for share in (0, 0.05, 0.11, 0.12, 0.3, 1):
            fresh = int(size * share)
            sets.append(np.unique(np.concatenate([base[fresh:], pick.integers(0, 2**63, fresh, dtype=np.uint64)])))
    spreads = [lsh_forest._parities(s) for s in sets]
    rows = pa.table(
        {
            "label": pa.array([bytes(lsh_forest.LABEL)] * len(sets)),
            "tree": pa.array([0] * len(sets), pa.int32()),
            "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
            "spread": pa.array(spreads),
        }
    )
    near = lsh_forest._neighbours(rows, 80, len(sets), 2)
    found = {(int(a), int(b)) for one, two in near for a, b in zip(one, two, strict=True)}
    wanted = set()
    for a, b in combinations(range(len(sets)), 2):
        common = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
        if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            wanted.add((a, b))
    assert wanted and wanted <= found
    assert len(found) < len(sets) * (len(sets) - 1) // 2
