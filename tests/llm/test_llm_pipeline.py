"""The corpus pipeline: each stage on odd rows and clashing names, and all of it."""

import random
import re

import corpus_pipeline as pipeline
import pytest

CLASHES = "score int, n_words string, kept string, _kept int, limits string, set_id int, label string"
SCHEMA = f"doc_id long, text string, lang string, source string, {CLASHES}"
MORE = (7, "given", "yes", 8, "none", 9, "mine")


def prose(pick, words):
    return " ".join(pick.choices([f"word{i}" for i in range(400)], k=words)) + "."


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(4)
    good = [(i, prose(pick, 120), "en", f"s{i % 3}") for i in range(60)]
    junk = [(100 + i, "$# %& " * 40 + "zzzz qqqq " * 30, "en", "s0") for i in range(20)]
    copies = [(200 + i, good[i][1], "de", None) for i in range(10)]
    near = [(300 + i, good[i][1] + " tail", None, "s1") for i in range(10)]
    odd = [(400, None, "en", "s0"), (401, "", None, None), (402, " \t", "en", "s0"), (None, prose(pick, 90), "en", "s1")]
    long = [(403, prose(pick, 60_000), "en", "s2")]
    again = [good[20], good[20], (21, prose(pick, 100), "en", "s0")]
    return [(*r, *MORE) for r in good + junk + copies + near + odd + long + again]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{place}/documents.parquet")
    labels = [(i, int(i < 60), 0) for i in [*range(60), *range(100, 120)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{place}/labels.parquet")
    return place


def as_rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


@pytest.mark.parametrize("name, stage", pipeline.STAGES[:-1])
def test_stage_hands_on_whole_rows(spark, folder, rows, name, stage):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = stage(spark, docs, folder)
    assert kept.schema.simpleString() == docs.schema.simpleString()
    given = sorted(map(repr, rows))
    found = as_rows(kept)
    assert set(found) <= set(given) and len(found) < len(given)


@pytest.mark.parametrize("name, stage", pipeline.STAGES)
def test_stage_on_an_empty_table(spark, folder, name, stage):
    nothing = spark.createDataFrame([], SCHEMA)
    assert stage(spark, nothing, folder).collect() == []


def test_classifier_drops_junk_only(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in pipeline.classify(spark, docs, folder).collect()}
    assert not kept & set(range(100, 120))
    assert set(range(60)) <= kept


def test_dedup_against_brute_force(spark, folder, rows):
    """Least ids of groups at four fifths of all shingles of five words."""

    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        if not words:
            return frozenset()
        return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))

    docs = sorted({r[:2] for r in rows}, key=lambda d: (d[0] is None, d[0] or 0))
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    wanted = {docs[i] for i in range(len(docs)) if docs[root[i]][0] == docs[i][0]}
    table = spark.read.parquet(f"{folder}/documents.parquet")
    found = [tuple(r)[:2] for r in pipeline.dedup(spark, table, folder).collect()]
    assert sorted(map(repr, found)) == sorted(map(repr, wanted))


def test_run_is_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    names = ["doc_id", "doc_tokens"]
    wanted = pipeline.pack(spark, docs, folder).select(*names).distinct()
    found = pipeline.run(spark, folder)
    assert as_rows(found.select(*names).distinct()) == as_rows(wanted)
    # Two texts have the id 21.
    lengths = found.where("doc_id <> 21").groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in lengths)
