"""Gridded operations against numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.operators import geo


def test_projection_there_and_back(spark):
    points = spark.createDataFrame([(9.0 + i / 2, 40.0 + j) for i in range(12) for j in range(12)], "lon double, lat double")
    xy = points.withColumn("p", geo.lonlat_to_utm(F.col("lon"), F.col("lat"), 32))
    back = xy.withColumn("q", geo.utm_to_lonlat(F.col("p.x"), F.col("p.y"), 32)).select("lon", "lat", "q.lon", "q.lat").toPandas()
    assert np.abs(back.iloc[:, 0] - back.iloc[:, 2]).max() < 1e-8 and np.abs(back.iloc[:, 1] - back.iloc[:, 3]).max() < 1e-8
    # on the central meridian x is the false easting and y the scaled meridian arc: 45 degrees north are 4 984 944.38 m of arc
    on = spark.createDataFrame([(9.0, 45.0)], "lon double, lat double").select(geo.lonlat_to_utm(F.col("lon"), F.col("lat"), 32).alias("p")).first().p
    assert on.x == pytest.approx(500_000, abs=1e-6) and on.y == pytest.approx(0.9996 * 4_984_944.378, abs=0.01)


def test_bilinear_regrid_and_warp(spark):
    ax, ay = np.arange(0.0, 5), np.arange(10.0, 14)
    plane = lambda x, y: 2 * x - 3 * y + 1
    source = spark.createDataFrame([(float(x), float(y), float(plane(x, y))) for x in ax for y in ay], "x double, y double, v double")
    rng = np.random.default_rng(1)
    pts = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.uniform(0, 4, 50), rng.uniform(10, 13, 50), strict=True))] + [(99, 7.0, 11.0)]
    weights = geo.bilinear_weights(spark.createDataFrame(pts, "cell int, x double, y double"), ax, ay, "x", "y")
    got = {r.cell: r.v for r in geo.regrid(source, weights, "v", {"x": "src_x", "y": "src_y"}, ["cell"]).collect()}
    assert 99 not in got and len(got) == 50
    assert all(got[i] == pytest.approx(plane(a, b), abs=1e-9) for i, a, b in pts[:50])
    assert [w for _, _, w in geo.axis_weights(ax, [1.25])] == [0.75, 0.25]
    gx, gy = np.arange(499_000.0, 502_000, 1000), np.arange(4_982_000.0, 4_985_000, 1000)
    grid = spark.createDataFrame([(float(x), float(y), float(x + 2 * y)) for x in gx for y in gy], "x double, y double, v double")
    at = spark.createDataFrame([(1, 9.001, 45.0), (2, 20.0, 45.0)], "cell int, lon double, lat double")
    p = at.where("cell = 1").select(geo.lonlat_to_utm(F.col("lon"), F.col("lat"), 32).alias("p")).first().p
    found = geo.warp(grid, at, gx, gy, "v", 32, ["cell"]).collect()
    assert len(found) == 1 and found[0].v == pytest.approx(p.x + 2 * p.y, abs=1e-4)


def test_weights_on_uneven_axes(spark):
    rng = np.random.default_rng(3)
    ax, ay = np.sort(rng.random(40)) ** 4 * 100, np.array([0.0, 1e-3, 5, 5.5, 90])
    values = rng.random((40, 5))
    source = spark.createDataFrame([(float(x), float(y), float(values[i, j])) for i, x in enumerate(ax) for j, y in enumerate(ay)], "x double, y double, v double")
    pts = [(n, float(rng.uniform(ax[0], ax[-1])), float(rng.uniform(0, 90))) for n in range(80)] + [(100 + i, float(x), 5.0) for i, x in enumerate(ax)] + [(300, float(ax[-1]) + 1, 1.0)]
    got = {r.cell: r.v for r in geo.regrid(source, geo.bilinear_weights(spark.createDataFrame(pts, "cell int, x double, y double"), ax, ay, "x", "y"), "v", {"x": "src_x", "y": "src_y"}, ["cell"]).collect()}

    def plain(x, y):
        i, j = (int(np.clip(np.searchsorted(a, c) - 1, 0, len(a) - 2)) for a, c in ((ax, x), (ay, y)))
        h, k = (x - ax[i]) / (ax[i + 1] - ax[i]), (y - ay[j]) / (ay[j + 1] - ay[j])
        return (values[i, j] * (1 - k) + values[i, j + 1] * k) * (1 - h) + (values[i + 1, j] * (1 - k) + values[i + 1, j + 1] * k) * h

    assert set(got) == {n for n, _, _ in pts} - {300}
    assert all(got[n] == pytest.approx(plain(x, y), abs=1e-9) for n, x, y in pts[:-1])
    beyond = geo.bilinear_weights(spark.createDataFrame([(1, float(ax[-1]) + 1, 1.0)], "cell int, x double, y double"), ax, ay, "x", "y", outside="extend")
    assert sum(r.weight for r in beyond.collect()) == pytest.approx(1) and beyond.count() == 4


def test_many_and_unbounded_regions(spark):
    df = spark.range(400).selectExpr("CAST(id % 40 AS DOUBLE) AS lat", "CAST(id % 9 AS DOUBLE) AS lon", "CAST(id AS DOUBLE) AS v")
    rows = [(i, float(i % 50) - 5, float(i % 50), 0.0, 4.0) for i in range(300)] + [(1000, -1e9, 1e9, -1e9, 1e9)]
    regions = spark.createDataFrame(rows, "region int, lat_min double, lat_max double, lon_min double, lon_max double")
    got = {r.region: r.n for r in geo.zonal_statistics(df, regions, "v").collect()}
    cells = [(i % 40, i % 9) for i in range(400)]
    want = {r: sum(a <= x <= b and c <= y <= d for x, y in cells) for r, a, b, c, d in rows}
    assert got == {r: n for r, n in want.items() if n}


def test_both_anomalies_and_both_range_joins(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"lat": rng.integers(0, 4, 200) * 1.0, "lon": rng.random(200) * 9, "time": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 72, 200), "h"), "v": rng.random(200)})
    df = spark.createDataFrame(frame)
    a, b = (f(df, "v", ["lat"], "time").toPandas().sort_values(["lat", "lon"]).anomaly.to_numpy() for f in (geo.anomaly, geo.anomaly_by_join))
    np.testing.assert_allclose(a, b)
    want = frame.v - frame.groupby(["lat", frame.time.dt.hour]).v.transform("mean")
    np.testing.assert_allclose(np.sort(a), np.sort(want))
    regions = spark.createDataFrame([(1, 0.0, 2.0, 0.0, 5.0), (2, 1.0, 3.0, 2.0, 9.0)], "region int, lat_min double, lat_max double, lon_min double, lon_max double")
    x, y = (sorted(map(tuple, geo.zonal_statistics(df, regions, "v", bin_size=s).withColumn("v", F.round("v", 9)).collect())) for s in (None, 0.7))
    assert x == y and x[0][2] == int(((frame.lat <= 2) & (frame.lon <= 5)).sum())


def test_streams_of_chunks(spark, tmp_path):
    from gridloom.streaming.windows import chunk_stream, windowed_mean

    df = spark.range(48).selectExpr("CAST(TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(0, CAST(id AS INT)) AS TIMESTAMP_LTZ) AS ts", "id % 2 AS cell", "CAST(id AS DOUBLE) AS v")
    df.write.parquet(str(tmp_path / "in"))
    means = windowed_mean(chunk_stream(spark, str(tmp_path / "in"), df.schema), "v", ["cell"], "ts", "1 day")
    q = means.writeStream.format("memory").queryName("means").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("means").count() == 4
