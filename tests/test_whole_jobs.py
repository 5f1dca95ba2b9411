"""Queries that once did less than their whole job."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from panelfx.operators import profile, resample


def test_distinct_values_are_all_counted(spark):
    df = spark.range(500).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b"), F.lit(None).cast("string").alias("c"), (F.col("id") % 11).alias("year_x"),
                                 F.when(F.col("id") % 2 == 0, F.lit(0.0)).otherwise(F.lit(-0.0)).alias("z")).repartition(3)
    found = profile.dummy_columns(df, df.columns, count_all=True)
    assert {r.variable: (r.n_distinct, r.is_dummy) for r in found.collect()} == {"a": (500, 0), "b": (7, 1), "c": (0, 1), "year_x": (11, 1), "z": (1, 1)}
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()


def test_dummy_columns_counts_past_the_threshold():
    assert "least(count" not in E.oracle_sql()["dummy_columns"]


def test_each_replicate_has_a_hash_of_its_own(spark):
    df = spark.range(30).select("id", (F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("y"))
    got = {(r.g, r.b): (r.w, r.wy) for r in resample.bootstrap_sums(df, {"w": F.lit(1.0), "wy": F.col("y")}, 6, 9, ["id"], ["g"], own_hash=True).collect()}
    cdf = np.array(resample.poisson1_cdf())
    for g in (0, 1):
        for b in range(1, 7):
            u = [(int(hashlib.md5(f"9:{b}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52 for i in range(g, 30, 2)]
            w = np.searchsorted(cdf, u, side="right")
            assert got[g, b] == pytest.approx((w.sum(), w @ np.arange(g, 30, 2)))


def test_outcomes_shuffle_no_rows_by_a_few_groups(spark):
    from panelfx.operators import production
    df = spark.range(400).select("id", (F.col("id") % 2).alias("imp"), (F.rand(1) * 5).alias("y"), (F.rand(2) * 5).alias("k"), (F.rand(3) * 5).alias("l"), (F.rand(4) * 5).alias("m"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        first, _ = production.productivity_stage1(df, ["imp"])
        second, _ = production.productivity_stage2(first, ["imp"])
        for found in (first, second):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_the_pipeline_cuts_similar_passages_behind_a_fragment(spark):
    import random

    import corpus_pipeline
    from llm.test_compact_windows import changed, prose
    rng = random.Random(29)
    rows, size = [], {}
    for _ in range(60):
        passage = prose(rng, rng.randint(55, 120))
        at = rng.randint(0, len(passage) - 45)
        for part in (passage[at:at + 45], passage, changed(rng, passage)):
            words, x = prose(rng, 150), rng.randint(0, 150)
            rows.append((len(rows), " ".join(words[:x] + part + words[x:])))
        size[len(rows) - 1] = len(rows[-1][1].split()) - 150
    kept = {r.doc_id: len(r.text.split()) for r in corpus_pipeline.passage_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    for d, text in rows:
        assert (kept[d] <= len(text.split()) - 0.8 * size[d]) if d in size else kept[d] == len(text.split())


def test_inner_scope_leaves_the_outer_one(spark):
    from panelfx.session import scratch_tables, stored
    with scratch_tables() as outer:
        with scratch_tables() as inner:
            stored(spark.range(1), "both")
        stored(spark.range(1), "outer-only")
    assert len(inner) == 1 and len(outer) == 2
