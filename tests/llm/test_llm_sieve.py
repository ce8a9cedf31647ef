"""The filter of keys, and what it keeps from moving."""

import corpus_pipeline as pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyward.llm import lsh_forest, sieve


@pytest.fixture
def large(spark):
    """No table counts as small enough to be broadcast unasked."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffled(df):
    """How many rows the exchanges of a query have written."""
    df.collect()
    total, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        plan = plans.pop()
        name = plan.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            plans.append(plan.executedPlan())
        elif name.startswith("ShuffleQueryStage"):
            plans.append(plan.plan())
        if name == "Exchange":
            total += plan.metrics().apply("shuffleRecordsWritten").value()
        children = plan.children()
        plans += [children.apply(i) for i in range(children.size())]
    return total


@pytest.mark.parametrize("count", [0, 1, 3000])
def test_listed_keys_pass_and_most_others_do_not(spark, count):
    rows = spark.range(20_000).withColumn("id", F.when(F.col("id") != 9, F.col("id")))
    listed = spark.range(count).select(F.xxhash64("id"))
    found = {r.id for r in sieve.passed(rows, F.xxhash64("id"), listed).collect()}
    assert set(range(count)) - {9} <= found
    assert len(found) < count + 200


def test_a_full_filter_passes_all_listed(spark, monkeypatch):
    monkeypatch.setattr(sieve, "MOST_BLOCKS", 2)
    rows = spark.range(500)
    listed = rows.where("id % 5 = 0").select(F.xxhash64("id"))
    found = {r.id for r in sieve.passed(rows, F.xxhash64("id"), listed).collect()}
    assert set(range(0, 500, 5)) <= found


def test_a_null_key_is_a_key(spark):
    rows = spark.createDataFrame([(None,), (1,)], "id long")
    listed = rows.where("id IS NULL").select(F.xxhash64("id"))
    marks = {r.id: r.hit for r in sieve.marked(rows, F.xxhash64("id"), listed, "hit").collect()}
    assert marks[None]


def test_only_texts_in_doubt_move_in_dedup(large):
    """2,000 documents, 50 of them copies, one id twice: before, every text moved."""
    texts = [(i, " ".join(f"w{i}x{j}" for j in range(30)), "en", "s") for i in range(1950)]
    texts += [(1950 + i, texts[i][1], "en", "s") for i in range(50)] + [texts[7]]
    docs = large.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    kept = pipeline.dedup(large, docs, "")
    assert shuffled(kept) < 100
    assert sorted(r.doc_id for r in kept.collect()) == list(range(1950))


def test_only_wanted_texts_move_to_be_gathered(large, monkeypatch):
    monkeypatch.setattr(lsh_forest, "durable", lambda df: df)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(2000)]
    source = large.createDataFrame(rows, "doc_id long, text string")
    signed = source.mapInArrow(
        lsh_forest._signatures(5), "doc_id long, n_shingles long, set_id binary, labels binary, spread binary"
    )
    sets = large.createDataFrame(
        signed.where("doc_id % 100 = 3").withColumnRenamed("doc_id", "least_id").collect(),
        "least_id long, n_shingles long, set_id binary, labels binary, spread binary",
    )
    ids = sorted(r.set_id for r in sets.collect())
    pairs = large.createDataFrame(list(zip(ids[::2], ids[1::2], strict=True)), "a binary, b binary")
    crowded = large.createDataFrame([], "region long, set_id binary, n_shingles long")
    full = lsh_forest._gathered(source, sets, pairs, crowded, 5)
    assert shuffled(full) < 300
    found = {bytes(r.set_id): len(r.shingles) // 8 for r in full.collect()}
    assert found == dict.fromkeys(map(bytes, ids), 26)


def test_sets_of_a_region_are_paired_once(spark, monkeypatch):
    """Variants of one text, each like the others by about 0.7: before, a pair came for every
    rare shingle that its two sets share."""
    pick = np.random.default_rng(8)
    base = pick.integers(0, 2**64, 400, dtype=np.uint64)
    own = [np.unique(np.concatenate((pick.permutation(base)[:365], pick.integers(0, 2**64, 40, dtype=np.uint64)))) for _ in range(80)]
    ids = [b"%04d" % i for i in range(len(own))]
    sizes = [len(s) for s in own]
    full = spark.createDataFrame([(i, s.tobytes()) for i, s in zip(ids, own, strict=True)], "set_id binary, shingles binary")
    sets = [(i, n, lsh_forest._parities(s)) for i, n, s in zip(ids, sizes, own, strict=True)]
    sets = spark.createDataFrame(sets, "set_id binary, n_shingles long, spread binary")
    crowded = spark.createDataFrame([(7, i, n) for i, n in zip(ids, sizes, strict=True)], "region long, set_id binary, n_shingles long")
    found = spark.createDataFrame([], "node binary, root binary")
    # Every size and parity allows a link, so places alone decide.
    monkeypatch.setattr(lsh_forest, "_possible", lambda sizes, spread, one, two, share: np.ones(len(one), bool))
    rows = lsh_forest._met(full, sets, crowded, found, 70).collect()
    links = {
        (ids[a], ids[b])
        for a in range(80)
        for b in range(a + 1, 80)
        if 100 * (n := len(np.intersect1d(own[a], own[b]))) >= 70 * (sizes[a] + sizes[b] - n)
    }
    pairs = {(bytes(r.a), bytes(r.b)) for r in rows}
    assert links and links <= pairs
    assert len(rows) < 3 * len(pairs)
