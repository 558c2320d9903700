"""Operations on gridded tables as projections, groupings and joins."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a region or weight table, counted beforehand, up to which it is broadcast.
BROADCAST_ROWS = 200_000
#: Regions up to which every cell is held against each; bands that the cells' extent is cut into, at most.
FEW, MOST_BANDS = 256, 4096


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint, if it has few rows; counting stops behind most."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), as for NDVI; null where both cancel out."""
    return F.try_divide(a - b, a + b)


def climatology(df: DataFrame, value: str, by: list[str], time: str, part: str = "HOUR") -> DataFrame:
    """Mean of value by cell and part of the time."""
    return df.groupBy(*by, F.date_part(F.lit(part), time).cast("int").alias(part.lower())).agg(F.avg(value).alias(value))


def zonal_mean(df: DataFrame, value: str, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg(value).alias(value))


def anomaly(df: DataFrame, value: str, by: list[str], time: str, part: str = "HOUR") -> DataFrame:
    """df with anomaly: value less its climatology. One shuffle, where the join with the climatology takes two; a cell's rows of one part are one group."""
    key = F.date_part(F.lit(part), time)
    return df.withColumn("anomaly", F.col(value) - F.avg(value).over(Window.partitionBy(*by, key)))


def anomaly_by_join(df: DataFrame, value: str, by: list[str], time: str, part: str = "HOUR") -> DataFrame:
    """The same by a join with the climatology; for few cells with very many rows each, as it aggregates before it shuffles."""
    mean = climatology(df, value, by, time, part).withColumnRenamed(value, "__mean")
    key = F.date_part(F.lit(part), time).cast("int")
    joined = df.withColumn(part.lower(), key).join(mean, [*by, part.lower()])
    return joined.withColumn("anomaly", F.col(value) - F.col("__mean")).drop("__mean", part.lower())


def rmse(forecast: Column, truth: Column) -> Column:
    return F.sqrt(F.avg(F.power(forecast.cast("double") - truth, 2)))


def forecast_skill(forecast: DataFrame, truth: DataFrame, value: str, by: list[str], cell: list[str], time: str = "time", lead: str = "lead") -> DataFrame:
    """RMSE by model and lead: forecasts made at time for time + lead, against what was seen then."""
    f = forecast.withColumn("__at", F.col(time) + F.col(lead))
    t = truth.select(*cell, F.col(time).alias("__at"), F.col(value).alias("__seen"))
    return f.join(t, [*cell, "__at"]).groupBy(*by, lead).agg(rmse(F.col(value), F.col("__seen")).alias("rmse"))


def zonal_statistics(df: DataFrame, regions: DataFrame, value: str, lat: str = "lat", lon: str = "lon", region: str = "region", bin_size: float | None = None) -> DataFrame:
    """Mean and count of value by boxes (lat_min, lat_max, lon_min, lon_max). Up to FEW regions are broadcast; with bin_size, or with more, boxes and cells meet by latitude bands, of that height or of the boxes' mean height, and MOST_BANDS at most within the cells' own extent."""
    inside = F.col(lat).between(F.col("lat_min"), F.col("lat_max")) & F.col(lon).between(F.col("lon_min"), F.col("lon_max"))
    if bin_size is None and regions.limit(FEW + 1).count() <= FEW:
        met = df.join(F.broadcast(regions), inside)
    else:
        low, high = df.agg(F.min(lat).cast("double"), F.max(lat).cast("double")).first()
        if low is None:
            low = high = 0.0
        clipped = regions.withColumns({"__low": F.greatest(F.col("lat_min").cast("double"), F.lit(low)), "__high": F.least(F.col("lat_max").cast("double"), F.lit(high))}).where("__low <= __high")
        height = bin_size or clipped.agg(F.avg(F.col("__high") - F.col("__low"))).first()[0] or 0.0
        step = max(height, (high - low) / MOST_BANDS) or 1.0
        band = lambda c: F.floor((c - F.lit(low)) / step)
        boxes = clipped.withColumn("__band", F.explode(F.sequence(band(F.col("__low")), band(F.col("__high"))))).drop("__low", "__high")
        met = df.withColumn("__band", band(F.col(lat))).join(boxes, "__band").where(inside)
    return met.groupBy(region).agg(F.avg(value).alias(value), F.count("*").alias("n"))


# Transverse Mercator on WGS 84 by Krüger's series.
A, FLAT = 6_378_137.0, 1 / 298.257_223_563
N = FLAT / (2 - FLAT)
RADIUS, SCALE, EAST = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64), 0.9996, 500_000.0
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)
BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96, N**2 / 48 + N**3 / 15, 17 * N**3 / 480)
DELTA = (2 * N - 2 * N**2 / 3 - 2 * N**3, 7 * N**2 / 3 - 8 * N**3 / 5, 56 * N**3 / 15)


def central_meridian(zone: int) -> float:
    return 6 * zone - 183.0


def utm_to_lonlat(x: Column, y: Column, zone: int, south: bool = False) -> Column:
    """Struct of lon and lat in degrees, all inside generated code."""
    xi, eta = (y - (1e7 if south else 0.0)) / (SCALE * RADIUS), (x - EAST) / (SCALE * RADIUS)
    terms = [(b, 2 * (j + 1)) for j, b in enumerate(BETA)]
    u = reduce(lambda s, t: s - t[0] * F.sin(t[1] * xi) * F.cosh(t[1] * eta), terms, xi)
    v = reduce(lambda s, t: s - t[0] * F.cos(t[1] * xi) * F.sinh(t[1] * eta), terms, eta)
    chi = F.asin(F.sin(u) / F.cosh(v))
    lat = reduce(lambda s, t: s + t[0] * F.sin(t[1] * chi), [(d, 2 * (j + 1)) for j, d in enumerate(DELTA)], chi)
    lon = F.lit(math.radians(central_meridian(zone))) + F.atan2(F.sinh(v), F.cos(u))
    return F.struct(F.degrees(lon).alias("lon"), F.degrees(lat).alias("lat"))


def lonlat_to_utm(lon: Column, lat: Column, zone: int, south: bool = False) -> Column:
    """Struct of x and y in metres."""
    phi, rel, e = F.radians(lat), F.radians(lon) - math.radians(central_meridian(zone)), 2 * math.sqrt(N) / (1 + N)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    u, v = F.atan2(t, F.cos(rel)), F.atanh(F.sin(rel) / F.sqrt(1 + t * t))
    terms = [(a, 2 * (j + 1)) for j, a in enumerate(ALPHA)]
    x = reduce(lambda s, k: s + k[0] * F.cos(k[1] * u) * F.sinh(k[1] * v), terms, v)
    y = reduce(lambda s, k: s + k[0] * F.sin(k[1] * u) * F.cosh(k[1] * v), terms, u)
    return F.struct((EAST + SCALE * RADIUS * x).alias("x"), ((1e7 if south else 0.0) + SCALE * RADIUS * y).alias("y"))


def axis_weights(axis: np.ndarray, targets: np.ndarray) -> list[tuple[float, float, float]]:
    """(target, neighbour, weight): linear interpolation on an ascending axis, two rows a target, weights of 0 kept."""
    axis, out = np.asarray(axis, float), []
    for t in np.asarray(targets, float).tolist():
        i = min(max(int(np.searchsorted(axis, t)) - 1, 0), len(axis) - 2)
        h = (t - axis[i]) / (axis[i + 1] - axis[i])
        out += [(t, float(axis[i]), 1 - h), (t, float(axis[i + 1]), h)]
    return out


def axis_cells(spark: SparkSession, axis: np.ndarray) -> tuple[DataFrame, float, float]:
    """(__bin, __low, __high) for the intervals of an ascending axis, in each of the equal bins that they reach into; the first bin's start and the bins' width. Intervals of a regular axis have a bin each, and one more at a common edge; of any axis there are no more than three rows an interval on average."""
    axis = np.asarray(axis, float)
    if len(axis) < 2 or (np.diff(axis) <= 0).any():
        raise ValueError("an axis of two ascending values at least is needed")
    width = (axis[-1] - axis[0]) / (len(axis) - 1)
    spot = np.clip(np.floor((axis - axis[0]) / width), 0, len(axis) - 2).astype(np.int64)
    n = spot[1:] - spot[:-1] + 1
    row = np.repeat(np.arange(len(n)), n)
    bins = spot[:-1][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return spark.createDataFrame(pa.table({"__bin": bins, "__low": axis[:-1][row], "__high": axis[1:][row]})), float(axis[0]), float(width)


def bilinear_weights(points: DataFrame, axis_a: np.ndarray, axis_b: np.ndarray, a: str, b: str, outside: str = "drop") -> DataFrame:
    """points with src_<a>, src_<b>, weight: four rows a point, on two ascending axes whose intervals meet the points by equal bins. A point on a grid line belongs to the interval that ends there, the first line's to the one that starts there; points off the grid give no rows, or, with outside "extend", weights that go on from its edge."""
    for name, axis in ((a, axis_a), (b, axis_b)):
        cells, start, width = axis_cells(points.sparkSession, axis)
        first, last, c = float(axis[0]), float(axis[-1]), F.col(name)
        if outside == "drop":
            points = points.where(c.between(first, last))
        held = F.greatest(F.least(c, F.lit(last)), F.lit(first))
        points = points.withColumn("__c", held).withColumn("__bin", F.least(F.greatest(F.floor((F.col("__c") - start) / width), F.lit(0)), F.lit(len(axis) - 2)))
        cells = F.broadcast(cells) if len(axis) <= BROADCAST_ROWS else cells
        within = ((F.col("__c") > F.col("__low")) | ((F.col("__c") == F.lit(first)) & (F.col("__low") == F.lit(first)))) & (F.col("__c") <= F.col("__high"))
        points = points.join(cells, "__bin").where(within)
        h = (c - F.col("__low")) / (F.col("__high") - F.col("__low"))
        pair = F.array(F.struct(F.col("__low").alias("at"), (1 - h).alias("w")), F.struct(F.col("__high").alias("at"), h.alias("w")))
        points = points.withColumn("__x", F.explode(pair)).withColumn(f"src_{name}", F.col("__x.at")).withColumn(f"__w_{name}", F.col("__x.w")).drop("__bin", "__c", "__low", "__high", "__x")
    return points.withColumn("weight", F.col(f"__w_{a}") * F.col(f"__w_{b}")).drop(f"__w_{a}", f"__w_{b}")


def regrid(source: DataFrame, weights: DataFrame, value: str, on: dict[str, str], by: list[str]) -> DataFrame:
    """Sum of value times weight by target cell; on maps source columns to those of weights. Keys meet bit by bit."""
    met = source.join(small(weights), reduce(lambda x, y: x & y, (source[s] == weights[w] for s, w in on.items())))
    return met.groupBy(*(weights[c] for c in by)).agg(F.sum(F.col(value) * F.col("weight")).alias(value))


def warp(source: DataFrame, targets: DataFrame, axis_x: np.ndarray, axis_y: np.ndarray, value: str, zone: int, cell: list[str], lon: str = "lon", lat: str = "lat", south: bool = False) -> DataFrame:
    """value of a UTM grid (x, y) at targets given by longitude and latitude; targets off the grid give no rows."""
    # a generator keeps the optimiser from writing the projection out for each use of x and y
    xy = targets.select(*cell, F.inline(F.array(lonlat_to_utm(F.col(lon), F.col(lat), zone, south))))
    return regrid(source, bilinear_weights(xy, axis_x, axis_y, "x", "y"), value, {"x": "src_x", "y": "src_y"}, cell)
