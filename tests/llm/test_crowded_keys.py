"""Many rows of one key, or of none: cut by the hashes of their texts, in one order all the same."""

import hashlib

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import catalog, winnow
from glyphmill.llm.ranges import parts

SCHEMA = "doc_id bigint, text string"


def rows(nulls, alike, others):
    keys = [None] * nulls + [500] * alike + [3 * i for i in range(others)]
    return [(k, f"Text number {i} with words {i * 7919 % 101} enough for a window or two" if i % 17 else None) for i, k in enumerate(keys)]


@pytest.mark.parametrize("nulls,alike,others", [(300, 0, 60), (0, 300, 60), (200, 200, 200), (300, 0, 0), (3, 2, 300), (1, 0, 0)])
def test_parts_follow_one_order(spark, nulls, alike, others):
    made = spark.createDataFrame(rows(nulls, alike, others), SCHEMA).withColumn("tie", F.xxhash64("text")).withColumn("own_size", F.lit(1))
    dealt, n = parts(made, "doc_id", "tie", 10)
    got = dealt.collect()
    assert len(got) == nulls + alike + others and dealt.columns[:4] == made.columns and {r["part"] for r in got} <= set(range(n))
    order = sorted(got, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["tie"]))
    assert [r["part"] for r in order] == sorted(r["part"] for r in got)
    sizes = [sum(r["part"] == p for r in got) for p in range(n)]
    assert max(sizes) <= 60  # 1/17 of the rows have no text, so one tie
    for p in range(n):
        own = [r for r in order if r["part"] == p]
        assert not own or own[0]["starts"]


@pytest.mark.parametrize("nulls,alike,others", [(120, 200, 80), (0, 300, 0)])
def test_edited_texts_of_crowded_keys(spark, nulls, alike, others):
    given = rows(nulls, alike, others)
    df = spark.createDataFrame(given, SCHEMA)
    ties = {r["text"]: r["tie"] for r in df.select(F.coalesce("text", F.lit("")).alias("text")).distinct().withColumn("tie", F.xxhash64("text")).collect()}
    order = sorted(((k, t or "") for k, t in given), key=lambda r: (r[0] is not None, r[0] or 0, ties[r[1]]))
    want = []
    for (k, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        want.append((k, len(t), hashlib.sha256((t[: len(t) - len(t) // 2] + following[: len(t) // 2]).encode()).hexdigest()))
    got = [(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in winnow.edited_fingerprints(df, rows_per_range=10).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_texts_are_moved_once(spark, data):
    plan = catalog.op7_fingerprints(spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "REPARTITION_BY_NUM" in plan
