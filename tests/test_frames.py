"""Frames by value against Spark's own sliding frames."""

import math

import numpy as np
from pyspark.sql import functions as F

from gridloom.operators import frames
from gridloom.plans import catalog

SF = "/root/testdata/sf0.001"


def compared(spark, rows, before=500, after=500):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, status string, price double")
    df.createOrReplaceTempView("prices")
    want = spark.sql(f"SELECT id, count(*) OVER (PARTITION BY status ORDER BY price RANGE BETWEEN {before} PRECEDING AND {after} FOLLOWING) AS near FROM prices")
    got = frames.near_counts(df, ["status"], "price", before, after, "near")
    assert got.columns == ["id", "status", "price", "near"]
    assert sorted(got.select("id", "near").collect()) == sorted(want.collect())


def test_counts_of_odd_values(spark):
    odd = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, 500.0, -500.0, 1000.0, 499.99999999999994, 500.00000000000006, 1e300, -1e300, 1e17, 1e17 + 500, 0.1, 500.1, 1000.1, 5e-324]
    rows = [(s, p) for s in ("a", "b", None, "") for p in odd for _ in range(1 + (s == "b"))]
    compared(spark, rows)
    compared(spark, rows, 0, 0.1)
    compared(spark, [])
    compared(spark, [(None, None), ("a", None), ("a", None)])
    compared(spark, [("a", math.nan), ("a", math.inf), ("b", -0.0), ("b", 0.0)])


def test_counts_of_random_values(spark):
    rng = np.random.default_rng(5)
    spread = [("ab"[int(x > 300)], float(x)) for x in np.round(rng.exponential(2000, 1500), 1)]
    compared(spark, spread)
    compared(spark, spread, 3, 70.5)
    # every frame holds all, and both ends lie outside the values
    compared(spark, [("a", float(x)) for x in rng.random(800)])
    # most rows are one value
    compared(spark, [("a", 7.25)] * 600 + [("a", float(x)) for x in rng.normal(0, 400, 300)])


def test_no_task_counts_frames_row_by_row(spark):
    # 60,000 rows in each other's frames are 3,600,000,000 steps for a sliding frame, in one task
    df = spark.range(60_000).select(F.col("id"), F.lit("O").alias("status"), (F.col("id") % 59_999 / 200).alias("price"))
    assert frames.near_counts(df, ["status"], "price", 500, 500, "near").agg(F.min("near"), F.max("near"), F.count("*")).first() == (60_000, 60_000, 60_000)
    plan = catalog.QUERIES["window_range_frame"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame" not in plan and "__part" in plan


def test_rows_of_one_group_are_dealt_evenly(spark):
    for price in ((F.rand(3) * 1e6), F.rand(4), F.when(F.rand(5) < 0.9, 12.5).otherwise(F.rand(6) * 100)):
        df = spark.range(40_000).select(F.lit("O").alias("status"), price.alias("price")).localCheckpoint()
        sizes = frames.dealt(df, ["status"], "price", 500, 500).groupBy("__part").count().agg(F.max("count"), F.sum("count")).first()
        assert sizes[0] < sizes[1] / 30
