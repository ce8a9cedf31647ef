import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyward.operators import nearest, scorecards
from tallyward.plans.queries import REGISTRY
from tallyward.session import drop_durable


def vectors(count, width=6, seed=0, clusters=4):
    dice = np.random.default_rng(seed)
    centres = dice.normal(size=(clusters, width)) * 20
    points = centres[dice.integers(clusters, size=count)] + dice.normal(size=(count, width))
    return points.round(2)


def frame(spark, points, start=0):
    rows = [(start + i, [float(x) for x in p], int(i % 3)) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")


def brute(queries, corpus, k, skip):
    found = {}
    for q, left in enumerate(queries):
        gaps = [
            (sum((float(a) - float(b)) ** 2 for a, b in zip(left, right)), c)
            for c, right in enumerate(corpus)
            if not (skip and c == q)
        ]
        found[q] = [(c, pytest.approx(g, abs=1e-9)) for g, c in sorted(gaps)[:k]]
    return found


def answers(df):
    got = {}
    for r in df.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.distance))
        assert r["rank"] == len(got[r.query_id])
    return got


@pytest.fixture(params=["10MB", "-1"])
def threshold(spark, request):
    """Every join once by broadcast and once by shuffle."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(name, request.param)
    yield request.param
    spark.conf.unset(name)


@pytest.mark.parametrize("skip", [True, False])
def test_join_equals_brute_force(spark, monkeypatch, threshold, skip):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 16)
    monkeypatch.setattr(nearest, "LANE_BLOCKS", 2)
    monkeypatch.setattr(nearest, "MAX_PROBES", 40)
    points = vectors(300)
    df = frame(spark, points).repartition(4)
    got = answers(nearest.nearest(df, df, k=4, skip_same_id=skip))
    assert got == brute(points, points, 4, skip)


def test_copies_that_fill_a_third_of_the_table(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 16)
    points = vectors(240)
    points[::3] = points[0]
    df = frame(spark, points).repartition(4)
    got = answers(nearest.nearest(df, df, k=3, skip_same_id=True))
    assert got == brute(points, points, 3, True)


def test_two_tables_and_carried_columns(spark):
    corpus, asked = vectors(90), vectors(20, seed=5)
    hits = nearest.nearest(frame(spark, asked), frame(spark, corpus), k=2, carry=["label"])
    assert answers(hits) == brute(asked, corpus, 2, False)
    assert all(r.label == r.vec_id % 3 for r in hits.collect())


def test_fewer_rows_than_asked_for(spark):
    points = vectors(2)
    df = frame(spark, points)
    assert answers(nearest.nearest(df, df, k=5, skip_same_id=True)) == brute(points, points, 5, True)
    assert nearest.nearest(df, df.limit(0), k=5).count() == 0


def test_text_ids(spark):
    df = frame(spark, vectors(40)).withColumn("vec_id", F.concat(F.lit("v"), "vec_id"))
    first = nearest.nearest(df, df, k=1).collect()
    assert all(r.query_id == r.vec_id and r.distance == 0.0 for r in first)


def test_far_cells_are_left_out_before_the_join(spark):
    """Well separated groups: query blocks go to their own cells only."""
    points = vectors(400, clusters=3, seed=2)
    probes = nearest._matrix(points[:60])
    pivots = np.unique(probes, axis=0)[:6]
    gaps, _ = nearest._distances(points, pivots)
    own = gaps.argmin(axis=1)
    cells = {c: nearest._ranges(points[own == c], pivots) for c in range(6) if (own == c).any()}
    block = points[own == own[0]]
    near = np.sort(nearest._distances(block, block)[0], axis=1)[:, 4]
    told = nearest._second_block(pivots, probes, 4, cells)(pd.DataFrame({"_bound": near}), block, own[0])
    # Its own cell has been compared in the first pass.
    reached = set(told["targets"][0])
    assert own[0] not in reached and len(reached) < len(cells) - 1


def test_one_question(spark):
    points = vectors(50)
    df = frame(spark, points).repartition(3)
    best = nearest.nearest_to(df, points[7], k=3).orderBy("rank").collect()
    assert [(r.vec_id, r.distance) for r in best] == brute(points[7:8], points, 3, False)[0]


def test_citations_are_first_hits(spark):
    hits = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], ["query_id", "rank", "section"])
    assert sorted(map(tuple, nearest.citations(hits, ["section"]).collect())) == [(1, "a"), (2, "c")]


def test_retrieval_scores(spark):
    rows = [
        (1, 1, "x", "x"),
        (1, 2, "y", "x"),
        (2, 1, "y", "x"),
        (2, 3, "x", "x"),
        (3, 1, "y", "x"),
        (3, 4, "x", "x"),
        (4, None, None, "x"),
    ]
    hits = spark.createDataFrame(rows, "query_id int, rank int, section string, expected string")
    score = scorecards.retrieval_scorecard(hits, F.col("section") == F.col("expected")).first()
    assert tuple(score) == (4, 1, 2, 25.0, 50.0)


def test_scores_by_strategy(spark):
    rows = [("s", 1, 1, "has A"), ("f", 1, 1, "has B"), ("f", 1, 3, "has A")]
    hits = spark.createDataFrame(rows, "strategy string, query_id int, rank int, text string")
    got = scorecards.retrieval_scorecard(hits, F.contains("text", F.lit("A")), by=["strategy"])
    assert {r.strategy: (r.top1_correct, r.top3_correct) for r in got.collect()} == {
        "s": (1, 1),
        "f": (0, 1),
    }


def test_majority_label(spark):
    rows = [(1, 1, "a"), (1, 2, "b"), (1, 3, "b"), (2, 1, "c"), (2, 2, "a"), (2, 3, "b")]
    hits = spark.createDataFrame(rows, "query_id int, rank int, label string")
    assert dict(map(tuple, scorecards.majority_label(hits).collect())) == {1: "b", 2: "c"}


def test_routing_scores(spark):
    rows = [("analyze", "analyze")] * 3 + [("define", "analyze")] + [("define", "define")] * 4
    got = scorecards.routing_scorecard(spark.createDataFrame(rows, ["expected", "actual"])).collect()
    assert {(r.expected, r.actual): r.cases for r in got} == {
        ("analyze", "analyze"): 3,
        ("define", "analyze"): 1,
        ("define", "define"): 4,
    }
    assert {r.overall_percent for r in got} == {87.5}


def test_unusable_vectors_spoil_nothing(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i), 1.0]) for i in range(61)]
    bad = [(100, [nan, 1.0]), (101, [None, 1.0]), (102, None), (103, [inf, 0.0])]
    df = spark.createDataFrame(good + bad, "vec_id int, embedding array<double>")
    got = {}
    for r in nearest.nearest(df, df, k=2, skip_same_id=True).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert all(got[i] == [(None, None)] for i, _ in bad)
    assert sorted(got[0]) == [(1, 1), (2, 2)] and sorted(got[30]) == [(1, 29), (2, 31)]
    assert len(got) == 65
    assert nearest.nearest_to(df, [3.0, 1.0], k=1).first().vec_id == 3
    only_bad = df.where("vec_id >= 100")
    assert {r["rank"] for r in nearest.nearest(df, only_bad).collect()} == {None}


def test_widths_must_agree(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id int, embedding array<double>")
    with pytest.raises(ValueError, match="widths"):
        nearest.nearest(df, df)


def test_far_blocks_are_not_compared(spark, monkeypatch):
    from pyspark.sql import Observation

    monkeypatch.setattr(nearest, "BLOCK_ROWS", 16)
    dice = np.random.default_rng(3)
    centres = dice.normal(size=(8, 8)) * 100
    points = (centres[np.arange(4000) % 8] + dice.normal(size=(4000, 8))).round(3)
    corpus = frame(spark, points)
    watch = Observation()
    found = nearest.nearest(corpus, corpus, k=3, skip_same_id=True, watch=watch).collect()
    blocks = 4000 / 16
    # All pairs of blocks would be blocks squared at least; a cluster's own are an eighth.
    assert watch.get["pairs"] < 0.35 * blocks * blocks
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    for q in range(0, 4000, 250):
        gaps = ((points - points[q]) ** 2).sum(axis=1)
        gaps[q] = np.inf
        assert got[q] == list(np.lexsort((np.arange(4000), gaps))[:3])


def _counted_packings(monkeypatch):
    packings = []
    packed = nearest._packed
    monkeypatch.setattr(nearest, "_packed", lambda *a, **o: packings.append(1) or packed(*a, **o))
    return packings


def test_scorecards_and_citations_pack_the_corpus_once(spark, tables, monkeypatch):
    drop_durable(spark)
    packings = _counted_packings(monkeypatch)
    names = ("knn_top3", "knn_citation", "retrieval_scorecard", "routing_scorecard")
    first = [sorted(map(tuple, REGISTRY[n](spark, tables).collect())) for n in names]
    assert packings == [1]
    # Dropped with the other tables, so the next one packs again, to the same answers.
    drop_durable(spark)
    assert sorted(map(tuple, REGISTRY["knn_top3"](spark, tables).collect())) == first[0]
    assert packings == [1, 1]


def test_saved_index_answers_as_the_corpus_does(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist(), f"name {i % 7}") for i in range(400)]
    rows += [(1000 + i, rows[3][1], "copy") for i in range(50)] + [(2000, None, "none")]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<double>, name string")
    folder = str(tmp_path / "index")
    packings = _counted_packings(monkeypatch)
    for k, skip in ((5, False), (2, True), (5, True)):
        index = nearest.corpus_index(corpus, k=5, carry=["name"], folder=folder)
        found = nearest.nearest(corpus, corpus, k, carry=["name"], skip_same_id=skip, index=index)
        plain = nearest.nearest(corpus, corpus, k, carry=["name"], skip_same_id=skip)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, plain.collect()))
    # One for the index, one for each search without it.
    assert len(packings) == 4
    drop_durable(spark)
    nearest.corpus_index(corpus, k=5, carry=["name"], folder=folder)
    assert len(packings) == 4


@pytest.mark.parametrize("change", ["vector", "id", "carried", "gone", "more"])
def test_changed_corpus_is_packed_anew(spark, tmp_path, monkeypatch, change):
    columns = "vec_id long, embedding array<float>, name string"
    rows = [(i, [float(i), 1.0], "n") for i in range(20)]
    folder = str(tmp_path / "index")
    packings = _counted_packings(monkeypatch)
    nearest.corpus_index(spark.createDataFrame(rows, columns), carry=["name"], folder=folder)
    nearest.corpus_index(spark.createDataFrame(rows[::-1], columns), carry=["name"], folder=folder)
    assert len(packings) == 1
    other = {
        "vector": [*rows[:-1], (19, [19.0, 1.5], "n")],
        "id": [*rows[:-1], (99, [19.0, 1.0], "n")],
        "carried": [*rows[:-1], (19, [19.0, 1.0], "other")],
        "gone": rows[:-1],
        "more": [*rows, rows[-1]],
    }[change]
    index = nearest.corpus_index(spark.createDataFrame(other, columns), carry=["name"], folder=folder)
    assert len(packings) == 2
    found = nearest.nearest(spark.createDataFrame([(0, [19.0, 1.5])], "vec_id long, embedding array<float>"), spark.createDataFrame(other, columns), k=1, carry=["name"], index=index).first()
    assert found.vec_id == {"id": 99, "gone": 18}.get(change, 19)


def test_index_of_an_empty_corpus_and_too_small_an_index(spark, tmp_path):
    columns = "vec_id long, embedding array<double>"
    nothing = spark.createDataFrame([(1, None)], columns)
    asked = spark.createDataFrame([(7, [1.0, 2.0])], columns)
    for _ in range(2):
        index = nearest.corpus_index(nothing, folder=str(tmp_path))
        assert nearest.nearest(asked, nothing, index=index).collect() == []
    corpus = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(9)], columns)
    index = nearest.corpus_index(corpus, k=2, folder=str(tmp_path))
    with pytest.raises(ValueError, match="answers up to 3"):
        nearest.nearest(asked, corpus, k=4, index=index)


def test_half_written_index_is_none(spark, tmp_path, monkeypatch):
    corpus = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(9)], "vec_id long, embedding array<double>")
    monkeypatch.setattr(nearest, "ABOUT", "no schema")
    with pytest.raises(Exception):
        nearest.corpus_index(corpus, folder=str(tmp_path))
    monkeypatch.undo()
    packings = _counted_packings(monkeypatch)
    nearest.corpus_index(corpus, folder=str(tmp_path))
    assert packings == [1]


def test_pairs_of_blocks_are_not_shuffled_and_blocks_are_not_broken_by_tasks(spark, monkeypatch):
    """Vectors that do not cluster: every block meets most others, and still only rows move."""
    from pyspark.sql import Observation

    monkeypatch.setattr(nearest, "BLOCK_ROWS", 16)
    monkeypatch.setattr(nearest, "SHARE_BLOCKS", 4)
    points = np.random.default_rng(5).normal(size=(600, 8)).round(2)
    df = frame(spark, points).repartition(24)
    watch = Observation()
    found = nearest.nearest(df, df, k=3, skip_same_id=True, watch=watch)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
    assert answers(found) == brute(points, points, 3, True)
    index = nearest._packed(df, 4, "vec_id", "embedding", ())
    cells = len(index.sizes)
    assert sum(index.sizes.values()) <= 600 // 16 + cells
    assert watch.get["pairs"] <= (600 // 16 + cells) ** 2


def test_driver_holds_few_ranges_of_cells(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL_PIVOTS", 3)
    points = vectors(900)
    df = frame(spark, points)
    index = nearest._packed(df, 4, "vec_id", "embedding", ())
    assert len(index.pivots) == 15 and {len(low) for low, _ in index.cells.values()} == {3}
    assert answers(nearest.nearest(df, df, k=3, skip_same_id=True, index=nearest.corpus_index(df))) == brute(points, points, 3, True)


def test_blocks_cover_little_space(spark, monkeypatch):
    """Points without clusters in few dimensions: a query block meets its surroundings only."""
    from pyspark.sql import Observation

    monkeypatch.setattr(nearest, "BLOCK_ROWS", 16)
    points = np.random.default_rng(11).random(size=(4000, 3)).round(4)
    df = frame(spark, points).repartition(4)
    watch = Observation()
    got = answers(nearest.nearest(df, df, k=3, skip_same_id=True, watch=watch))
    assert watch.get["pairs"] < 0.1 * (4000 / 16) ** 2
    for q in range(0, 4000, 250):
        gaps = ((points - points[q]) ** 2).sum(axis=1)
        gaps[q] = np.inf
        assert [c for c, _ in got[q]] == list(np.lexsort((np.arange(4000), gaps))[:3])


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1e-7, 1000.0), (1e-30, 0.0), (1e60, 0.0)])
def test_single_precision_decides_nothing(spark, monkeypatch, scale, shift):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 16)
    points = np.random.default_rng(12).normal(size=(300, 5)) * scale + shift
    df = frame(spark, points).repartition(3)
    got = answers(nearest.nearest(df, df, k=3, skip_same_id=True))
    wanted = brute(points, points, 3, True)
    assert {q: [c for c, _ in hits] for q, hits in got.items()} == {
        q: [c for c, _ in hits] for q, hits in wanted.items()
    }


@pytest.mark.parametrize("skip", [True, False])
def test_ties_go_by_id_over_blocks_bundles_and_shares(spark, monkeypatch, skip):
    for name in ("BLOCK_ROWS", "BUNDLE_BLOCKS", "SHARE_BLOCKS", "CORPUS_SHARE", "PACKED_ROWS"):
        monkeypatch.setattr(nearest, name, {"BLOCK_ROWS": 8, "PACKED_ROWS": 64}.get(name, 2))
    points = np.array([(float(x), float(y)) for x in range(18) for y in range(18)])
    points = np.concatenate([points, points[:60], points[:20]])[np.random.default_rng(13).permutation(404)]
    names = [f"n{i:03d}" for i in range(404)]
    rows = [(n, p.tolist()) for n, p in zip(names, points)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>").repartition(5)
    got = answers(nearest.nearest(df, df, k=3, skip_same_id=skip))
    wanted = brute(points, points, 3, skip)
    assert got == {names[q]: [(names[c], d) for c, d in hits] for q, hits in wanted.items()}


def test_a_task_hands_on_k_rows_per_query_of_all_it_has_seen():
    import pyarrow as pa

    points = np.random.default_rng(14).normal(size=(256, 4))
    packed = lambda v: pa.array([v.astype("<f8").tobytes()], pa.binary())
    asked = {
        "key": pa.array([7]),
        "q_ids": nearest._listed(pa.array(range(20))),
        "q_vectors": packed(points[:20]),
        "bounds": packed(np.full(20, np.inf)),
    }
    rows = [
        pa.RecordBatch.from_pydict(
            {**asked, "ids": nearest._listed(pa.array(range(at, at + 32))), "vectors": packed(points[at : at + 32])}
        )
        for at in range(0, 256, 32)
    ]
    names = ["query_id", "vec_id", "distance"]
    told = nearest._compare(4, "<f8", 3, (), True, names, False)(iter(rows))
    found = pa.Table.from_batches(told).to_pylist()
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["distance"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["distance"]))
    assert got == {q: hits for q, hits in brute(points, points, 3, True).items() if q < 20}


@pytest.mark.parametrize("size", [0, 7, 4096, 80_003])
@pytest.mark.parametrize("share", [0.0, 1e-4, 0.3, 1.0])
def test_places_of_flags(size, share):
    flags = np.random.default_rng(size).random(size) < share
    assert nearest._places(flags).tolist() == np.flatnonzero(flags).tolist()
