"""Archives, URL verdicts, neighbour search and piece sampling against brute force."""

import base64
import hashlib
import zlib
from collections import Counter
from math import exp, log

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyward.llm import multiprobe, piece_sampling, registry, url_filter, warc

PAGES = [
    (1, "http://a.example.com/x?q=1", "<p>one</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n", "z"),
    (2, "https://b.example.net/es/", "same", "z"),
    (3, None, "same", "z"),
    (4, "no host", None, "z"),
    (5, "http://evil\r\nX: y/", "", "z"),
    (6, "http://WWW.Spam-Farm.org/A/?utm_source=f&b=2&a=1#t", "ü" * 200_000, "z"),
    (6, "http://WWW.Spam-Farm.org/A/?utm_source=f&b=2&a=1#t", "ü" * 200_000, "z"),
    (None, "http://spam-farm.org/A?a=1&b=2", "same", "z"),
]
PAGE = "page_id long, url string, html string, payload string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(PAGES, PAGE)


def archived(spark, pages, folder):
    warc.write(warc.captures(pages), folder)
    return warc.transactions(warc.read(spark, folder))


# Archives


def test_pages_come_back(spark, odd, tmp_path):
    rows = archived(spark, odd, str(tmp_path / "w")).collect()
    assert len(rows) == len(PAGES)
    for r in rows:
        page = r.metadata.fields.get("page")
        _, url, html, _ = next(p for p in PAGES if str(p[0]) == (page or "None"))
        body = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert r.response.digest == digest
        assert int(r.metadata.fields["payloadlength"]) == len(body)
        assert r.request.method == "GET"
        if r.response.type == "response":
            assert bytes(r.response.payload) == body and r.response.payload_digest == digest
    kinds = Counter((r.metadata.fields.get("page"), r.response.type, r.metadata.fields.get("referstopage")) for r in rows)
    assert kinds == Counter(
        [
            ("1", "response", None), ("2", "response", None), ("3", "revisit", "2"),
            ("4", "response", None), ("5", "revisit", "4"), ("6", "response", None),
            ("6", "response", None), (None, "revisit", "2"),
        ]
    )
    by_id = {r.record_id: r for r in rows}
    for r in rows:
        if r.response.type == "revisit":
            assert by_id[r.response.refers_to].response.type == "response"


def test_missing_records_stay_visible(spark, odd, tmp_path):
    warc.write(warc.captures(odd.where("page_id = 1 or page_id = 2")), str(tmp_path / "w"))
    records = warc.read(spark, str(tmp_path / "w")).cache()
    alone = warc.transactions(records.where("type = 'request'")).collect()
    assert len(alone) == 2 and all(r.response is None and r.metadata is None for r in alone)
    bare = warc.transactions(records.where("type = 'response'")).collect()
    assert len(bare) == 2 and all(r.request is None for r in bare)


def test_no_pages(spark, odd, tmp_path):
    assert archived(spark, odd.limit(0), str(tmp_path / "w")).collect() == []


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, tables, name):
    engine = duckdb.connect()
    for table in ("pages", "documents", "embeddings", "labels"):
        engine.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tables}/{table}.parquet'")
    df = registry.REGISTRY[name](spark, tables)
    result = engine.execute(registry.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    expected = sorted(map(repr, result.fetchall()))
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == expected


# URL verdicts


def test_canonical_forms_meet(spark):
    forms = [
        "http://www.Example.com:80/a/?utm_source=x&b=2&a=1#top",
        "https://example.com/a?a=1&b=2",
        "https://example.com/a/?ref=me&a=1&b=2",
    ]
    df = spark.createDataFrame([(u,) for u in forms], "url string")
    assert df.select(url_filter.canonical(F.col("url"))).distinct().count() == 1
    none = spark.createDataFrame([(None,), ("no scheme",), ("http:///x",)], "url string")
    assert {r[0] for r in none.select(url_filter.canonical(F.col("url"))).collect()} == {None}


def test_longest_rule_wins_and_the_list_decides_the_rest(spark, odd):
    rows = [
        (1, "http://x.example.com/en/1"), (2, "http://www.example.com/en/1"), (3, "http://a.www.example.com/en/"),
        (4, "http://notexample.com/en/"), (5, "http://example.net/es/q"), (6, "http://example.net/en/"),
        (7, "http://com"), (8, "HTTP://EXAMPLE.COM/EN/"), (9, "http://l.org/a?x=1"), (10, "http://m.org/"), (11, None), (12, "junk"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    listed = spark.createDataFrame([("l.org/a?x=1",), ("l.org/a?x=1",), (None,)], "canonical string")
    found = {r.page_id: (r.rule, r.verdict, r.listed) for r in url_filter.judged(pages, registry.RULES, listed).collect()}
    assert found == {
        1: ("example.com/en/", "block", False), 2: ("www.example.com/en/", "allow", False),
        3: ("www.example.com/en/", "allow", False), 4: ("com/", "allow", False), 5: ("net/es/", "block", False),
        6: (None, "allow", False), 7: (None, "allow", False), 8: ("com/", "allow", False),
        9: (None, "block", True), 10: (None, "allow", False), 11: (None, "allow", False), 12: (None, "allow", False),
    }
    spam = url_filter.judged(odd, registry.RULES, registry.spam_urls(odd)).collect()
    assert Counter(r.verdict for r in spam) == {"block": 4, "allow": 4}
    nothing = url_filter.judged(odd.limit(0), registry.RULES, registry.spam_urls(odd)).collect()
    assert nothing == []
    assert len(url_filter.judged(odd, [], listed.limit(0)).collect()) == len(PAGES)


def test_verdicts_of_the_query_need_the_list_and_the_join(spark, tables, monkeypatch):
    folder = tables.replace("0.001", "0.1")
    verdicts = lambda: {r.page_id: r.verdict for r in registry.op9_url_filter(spark, folder).where("rule IS NULL").collect()}
    right = verdicts()
    blocked = {p for p, v in right.items() if v == "block"}
    assert 0.02 * len(right) < len(blocked) < 0.5 * len(right)
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    named = {r.page_id for r in pages.where("split_part(split_part(url, '://', 2), '/', 1) LIKE '%spam%'").collect()}
    assert len(blocked - named) > len(blocked) / 2
    # A filter that passes all leaves the verdicts to the join; one that passes none allows all.
    whole = url_filter.bloom
    monkeypatch.setattr(url_filter, "bloom", lambda *a: np.full_like(whole(*a), 0xFFFFFFFF))
    assert verdicts() == right
    monkeypatch.setattr(url_filter, "bloom", lambda *a: np.zeros_like(whole(*a)))
    assert set(verdicts().values()) == {"allow"}


def test_filter_has_no_false_negative_and_few_positives(spark, monkeypatch):
    listed = spark.range(5000).select(F.concat(F.lit("l.org/"), "id").alias("canonical"))
    others = spark.range(5000).select(F.concat(F.lit("m.org/"), "id").alias("canonical"))
    for blocks, most in ((url_filter.MOST_BLOCKS, 0.02), (16, 1.0)):
        monkeypatch.setattr(url_filter, "MOST_BLOCKS", blocks)
        table = url_filter.bloom(listed, "canonical")
        assert len(table) <= blocks
        ask = url_filter._possible(spark.sparkContext.broadcast(table))
        count = lambda df: df.where(ask(F.xxhash64("canonical"))).count()
        assert count(listed) == 5000
        assert count(others) <= most * 5000


# Neighbours


def test_recall_and_exact_scores(spark, tables):
    folder = tables.replace("0.001", "0.1")
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids = np.array([r.vec_id for r in rows])
    vectors = np.array([r.embedding for r in rows], np.float64)
    found = {}
    for r in registry.op8_multiprobe(spark, folder).collect():
        found.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for q in ids[ids % 100 == 0]:
        gaps = np.sqrt(((vectors - vectors[ids == q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, gaps)) if ids[i] != q][:10]
        own = found[q]
        assert sorted(own) == list(range(1, 11))
        listed = [own[i] for i in range(1, 11)]
        assert listed == sorted(listed, key=lambda x: (x[1], x[0]))
        for vec, score in listed:
            assert score == pytest.approx(float(gaps[ids == vec][0]), abs=1e-12)
        hits += len({ids[i] for i in order} & {v for v, _ in listed})
    assert hits >= 0.9 * 10 * len(found)


def test_odd_vectors_ties_and_outliers(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 5), (1, [1.0, 0.0], 5), (2, [1.0, 0.0], 5), (3, [1.0, 0.1], 5), (4, None, 5),
        (5, [0.0, 0.0], 5), (6, [nan, 1.0], 5), (7, [inf, 1.0], 5), (8, [None, 1.0], 5), (9, [1.0], 5),
        (100, [1e6, 1e6], 5), (None, [1.0, 1.0], 5), (3, [1.0, 0.1], 5), (200, [nan, nan], 5),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    found = multiprobe.nearest(df.where("vec_id % 100 = 0"), df, k=3)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got[0] == [(1, 0.0), (2, 0.0), (3, pytest.approx(0.1))]
    assert [v for v, _ in got[100]] == [3, 0, 1]
    assert set(got) == {0, 100}
    assert multiprobe.nearest(df.limit(0), df).collect() == []
    assert multiprobe.nearest(df, df.limit(0)).collect() == []


def test_a_vector_with_very_many_copies(spark):
    copies = spark.range(3000).select(F.col("id").alias("vec_id"), F.array(F.lit(0.5), F.lit(0.25)).alias("embedding"))
    found = multiprobe.nearest(copies.where("vec_id % 1000 = 0"), copies, k=4).collect()
    assert {(r.query_id, r.vec_id) for r in found if r.query_id == 0} == {(0, 1), (0, 2), (0, 3), (0, 4)}
    assert {r.vec_id for r in found if r.query_id == 2000} == {0, 1, 2, 3}


def test_visits_come_in_the_order_of_their_cost():
    order = multiprobe.visits(3, 20)
    assert order[0] == () and order[1] == (1,) and len(order) == len(set(order)) == 20
    for moves in order:
        assert len({min(j, 7 - j) for j in moves}) == len(moves)


# Pieces


@pytest.fixture(scope="module")
def lattices():
    path = registry.tokenizer_path(registry.PIECES)
    return piece_sampling.Lattices(piece_sampling.Vocabulary(path, 0.3))


def enumerated(lattices, node):
    for edge in range(lattices.first[node], lattices.first[node + 1]):
        target = lattices.target[edge]
        for rest, p in enumerated(lattices, target) if target >= 0 else [((), 1.0)]:
            yield (edge, *rest), p * lattices.probability[edge]


def test_samples_follow_the_distribution(lattices):
    text, runs = "the a", 6000
    seeds = [int(s) for s in piece_sampling.texts.seeded(runs, 99)]
    searches = piece_sampling.sampled(lattices, [text] * runs, seeds, 3)
    whole = {(): 1.0}
    for chunk in piece_sampling._chunks(text):
        own = dict(enumerated(lattices, lattices.start[chunk]))
        whole = {a + b: p * q for a, p in whole.items() for b, q in own.items()}
    assert sum(whole.values()) == pytest.approx(1)
    first = Counter(tuple(s.samples[0][0].tolist()) for s in searches)
    second = Counter(tuple(s.samples[1][0].tolist()) for s in searches)
    for path, p in whole.items():
        after = sum(q * p / (1 - q) for other, q in whole.items() if other != path)
        assert first[path] / runs == pytest.approx(p, abs=0.025)
        assert second[path] / runs == pytest.approx(after, abs=0.025)
    weights = []
    for s in searches:
        assert len({tuple(e.tolist()) for e, _, _ in s.samples}) == 3
        values = [v for _, _, v in s.samples] + [s.threshold()]
        assert values == sorted(values, reverse=True)
        for edges, log_p, _ in s.samples:
            assert log_p == pytest.approx(log(whole[tuple(edges.tolist())]))
        weights.append(sum(exp(p - piece_sampling.log_inclusion(p, s.threshold())) for _, p, _ in s.samples))
    # Inclusion scores make unbiased estimates: here of the total probability.
    assert np.mean(weights) == pytest.approx(1, abs=0.02)


def test_texts_come_back_from_their_pieces(spark, lattices):
    bodies = ["a  b\nc\t d ", "héé 漢🙂🙂 x", "   ", "\n\n", "", None, "x" * 50_000, "plain words " * 2000]
    rows = spark.createDataFrame(list(enumerate(bodies)) + [(0, bodies[0])], "key int, text string")
    model = registry.tokenizer_path(registry.PIECES)
    found = piece_sampling.sample_pieces(rows, "text", ["key"], model, k=3, with_ids=True).collect()
    by_key = {}
    for r in found:
        by_key.setdefault(r.key, []).append(r)
        body = (bodies[r.key] or "").encode()
        assert r.decoded_crc32 == zlib.crc32(body)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.n_pieces == len(r.ids)
    assert [len(by_key[k]) for k in (3, 4, 5)] == [1, 1, 1]
    assert all(r.log_inclusion == 0 for k in (3, 4, 5) for r in by_key[k])
    # The repeated row has the samples of the first.
    assert Counter(tuple(r.ids) for r in by_key[0]).most_common()[-1][1] == 2
    text = piece_sampling.decode_pieces(spark.createDataFrame(found), "ids", ["key"], model)
    assert {(r.key, r.text) for r in text.collect()} == {(i, b or "") for i, b in enumerate(bodies)}
    apart = piece_sampling.sample_pieces(rows.where("key = 7"), "text", ["key"], model, k=3, with_ids=True).collect()
    assert [r.ids for r in apart] == [r.ids for r in by_key[7]]
    assert piece_sampling.sample_pieces(rows.limit(0), "text", ["key"], model).collect() == []


def test_the_query_gives_three_samples_a_turn(spark, tables):
    turns = spark.read.parquet(f"{tables}/conversations.parquet").collect()
    expected = {(t.conv_id, t.turn, t.role): zlib.crc32((t.text or "").encode()) for t in turns}
    seen = Counter()
    for r in registry.op10_piece_sampling(spark, tables).collect():
        key = (r.conv_id, r.turn, r.role)
        assert r.decoded_crc32 == expected[key] and r.log_inclusion <= 0
        seen[key] += 1
    assert set(seen) == set(expected) and set(seen.values()) <= {1, 2, 3}
