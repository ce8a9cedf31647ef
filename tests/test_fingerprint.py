"""Fingerprints by position, and required columns by presence."""

import random

import pytest
from pyspark.sql import functions as F

from rows import COLUMNS, clean
from tallyward.operators import quality
from tallyward.sources import tables

SCHEMA = "at long, text string, n int"


def digest(rows, prime, base):
    import hashlib

    cell = lambda v: "-" if v is None else f"{len(str(v))}:{v}"
    value = lambda r: int(hashlib.md5("".join(map(cell, r[1:])).encode()).hexdigest()[:15], 16)
    return sum(value(r) * pow(base, r[0] or 0, prime) for r in rows) % prime


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(2)
    rows = [(i, pick.choice(["a", "bb", "", None, "ü"]) , pick.randrange(9)) for i in range(500)]
    return rows + [(10**15, "far", 1), (None, "nowhere", 2), (7, "again", 3)]


def test_against_a_plain_polynomial(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    wanted = "-".join(str(digest(rows, *p)) for p in tables.POLYNOMIALS)
    for span in (1, 7, 4096):
        found = tables.ordered_fingerprint(df.repartition(span % 9 + 1), "at", span).first()
        assert tuple(found) == (len(rows), wanted)


def test_swapped_rows_change_it_and_the_span_tells_where(spark, rows):
    other = list(rows)
    (a, *one), (b, *two) = other[130], other[135]
    assert one != two
    other[130], other[135] = (a, *two), (b, *one)
    left, right = (spark.createDataFrame(r, SCHEMA) for r in (rows, other))
    assert tables.fingerprint(left.drop("at")).first() == tables.fingerprint(right.drop("at")).first()
    assert tables.ordered_fingerprint(left, "at").first() != tables.ordered_fingerprint(right, "at").first()
    spans = [{tuple(r) for r in tables.span_digests(df, "at", 64).collect()} for df in (left, right)]
    assert {r[0] for r in spans[0] ^ spans[1]} == {2}


def test_appended_batch_joins_kept_digests(spark, rows):
    df = spark.createDataFrame(rows[:500], SCHEMA)
    kept, fresh = (tables.span_digests(df.where(c), "at", 100) for c in ("at < 300", "at >= 300"))
    both = tables.joined_digests(kept.unionByName(fresh), 100).first()
    assert both == tables.ordered_fingerprint(df, "at").first()


def test_nothing_to_digest(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert tuple(tables.ordered_fingerprint(nothing, "at").first()) == (0, "0-0")
    assert tables.span_digests(nothing, "at").collect() == []


def test_wholly_missing_columns(spark):
    df = spark.createDataFrame(clean(3, 2), COLUMNS).withColumn("source", F.col("location_id"))
    blank = F.when(F.col("source") != "LOC-002", F.col("region"))
    partly = F.when(F.month("month") == 1, F.col("revenue"))
    df = df.withColumn("region", blank).withColumn("revenue", partly).drop("volume")
    found = {(i.source, i.column_name, i.rule_order) for i in quality.wholly_missing_columns(df).collect()}
    assert found == {(f"LOC-00{i}", "volume", 1) for i in (1, 2, 3)} | {("LOC-002", "region", 1)}
    assert quality.wholly_missing_columns(df.limit(0)).collect() == []
