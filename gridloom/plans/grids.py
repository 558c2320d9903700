"""Queries through registered datasets: the driver's tables as arrays, by way of the grid source, and back; each with the DuckDB text it is held against.

The dataset `cells` has the mean value (missing where there is none) and the number of events by day, hour and kind; `levels` has order totals by month of a 360-day calendar and priority.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..calendars import CalDate
from ..context import GridContext
from ..dataset import BlockVar, GridDataset, explode
from ..frame import scatter
from ..operators import geo
from ..sources.batches import from_map, from_map_batched, read_grid, whole_batch
from ..sources.parquet_store import write_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CELLS = """seen AS (SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, CAST(date_part('hour', ts) AS BIGINT) AS hour, event_type AS kind, avg(value) AS value, count(*) AS n FROM events GROUP BY 1, 2, 3),
cells AS (SELECT d.day, h.hour, k.kind, s.value, CAST(coalesce(s.n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT day FROM seen) AS d CROSS JOIN (SELECT DISTINCT hour FROM seen) AS h CROSS JOIN (SELECT DISTINCT kind FROM seen) AS k LEFT JOIN seen AS s ON s.day = d.day AND s.hour = h.hour AND s.kind = k.kind)"""
#: Offsets of the first days of months of the year 2000 with 30 days each.
LEVELS = """levels AS (SELECT CAST((10800 + 30 * (date_part('month', o_orderdate) - 1)) * 86400000000 AS BIGINT) AS time, o_orderpriority AS level, sum(o_totalprice) AS total FROM orders GROUP BY 1, 2)"""


def _folder(spark: SparkSession) -> str:
    """Where stores go: below spark.checkpoint.dir, as far as that is a mounted path; a temporary folder only for Spark in local mode."""
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://")
    return tempfile.mkdtemp(prefix="gridloom-", dir=shared if shared.startswith("/") and not spark.sparkContext.master.startswith("local[") else None)


def cells_of(spark: SparkSession, sf_dir: str) -> GridDataset:
    found = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), F.date_part(F.lit("hour"), "ts").cast("long").alias("hour"), F.col("event_type").alias("kind")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    ds = scatter(found.orderBy("day", "hour", "kind").toArrow(), ["day", "hour", "kind"], ["value", "n"], np.nan)
    ds.data["n"].values = np.nan_to_num(ds.data["n"].values).astype(np.int64)
    ds.coords["kind"].values = ds.coords["kind"].values.astype(str)
    ds.data["value"].attrs, ds.attrs = {"unit": "1"}, {"title": "events"}
    return ds


def levels_of(spark: SparkSession, sf_dir: str) -> GridDataset:
    found = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.month("o_orderdate").alias("m"), F.col("o_orderpriority").alias("level")).agg(F.sum("o_totalprice").alias("total"))
    ds = scatter(found.orderBy("m", "level").toArrow(), ["m", "level"], ["total"])
    months = np.array([CalDate(2000, int(m), calendar="360_day") for m in ds.coords["m"].values], dtype=object)
    return GridDataset({"total": (("time", "level"), ds.data["total"].values)}, {"time": months, "level": ds.coords["level"].values.astype(str)})


def context(spark: SparkSession, sf_dir: str, levels: bool = False) -> GridContext:
    ctx = GridContext(spark, _folder(spark)).from_dataset("cells", cells_of(spark, sf_dir), chunks={"day": 5, "hour": 12})
    return ctx.from_dataset("levels", levels_of(spark, sf_dir), chunks={"time": 3}) if levels else ctx


def over_cells(name: str, query: str, params: dict | None = None) -> None:
    """The same text over the registered datasets and over plain tables."""
    oracle = query
    for k, v in (params or {}).items():
        oracle = oracle.replace(f"${k}", repr(v))
    levels = "levels" in query

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return context(spark, sf_dir, levels).sql(query, params).df

    QUERIES[name], ORACLES[name] = run, f"WITH {CELLS}{', ' + LEVELS if levels else ''} {oracle}"


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, f"WITH {CELLS} {oracle}" if "cells" in oracle else oracle
        return f

    return add


def rows_of(spark: SparkSession, ds: GridDataset) -> DataFrame:
    """A dataset's cells as rows again."""
    return spark.createDataFrame(pa.Table.from_batches([whole_batch(ds)]))


# registration, projection, pruning
over_cells("grid_scan", "SELECT day, hour, kind, round(value, 6) AS value, n FROM cells")
over_cells("grid_count", "SELECT count(*) AS n FROM cells")
over_cells("grid_bounds", "SELECT min(day) AS first_day, max(day) AS last_day, min(hour) AS low, max(hour) AS high, count(hour) AS n FROM cells")
over_cells("grid_missing", "SELECT kind, count(*) AS n, count(value) AS n_held, count(*) FILTER (WHERE value IS NULL) AS n_missing, round(avg(value), 6) AS mean FROM cells GROUP BY kind")
over_cells("grid_is_null", "SELECT day, hour, kind, n FROM cells WHERE value IS NULL")
over_cells("grid_dims_only", "SELECT DISTINCT hour, kind FROM cells")
over_cells("grid_one_variable", "SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY kind")
over_cells("grid_prune_range", "SELECT hour, kind, CAST(sum(n) AS BIGINT) AS n FROM cells WHERE day BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00' GROUP BY hour, kind")
over_cells("grid_prune_flipped", "SELECT day, kind, n FROM cells WHERE 20 <= hour AND TIMESTAMP '2024-01-20 00:00:00' > day")
over_cells("grid_prune_or", "SELECT day, hour, kind, n FROM cells WHERE day < TIMESTAMP '2024-01-03 00:00:00' OR day >= TIMESTAMP '2024-01-28 00:00:00'")
over_cells("grid_prune_or_dims", "SELECT day, hour, kind, n FROM cells WHERE (day = TIMESTAMP '2024-01-05 00:00:00' AND hour < 6) OR (day > TIMESTAMP '2024-01-27 00:00:00' AND hour = 23)")
over_cells("grid_prune_in", "SELECT day, hour, kind, n FROM cells WHERE hour IN (1, 5, 22) AND NOT (day = TIMESTAMP '2024-01-02 00:00:00')")
over_cells("grid_prune_all", "SELECT day, hour, kind, n FROM cells WHERE hour > 100")
over_cells("grid_string_axis", "SELECT day, hour, n FROM cells WHERE kind = 'click' AND n > 0")
over_cells("grid_quoted_params", 'SELECT "day", "hour", "kind", "n" FROM cells WHERE "hour" >= $low AND "n" >= $least', {"low": 18, "least": 2})
over_cells("grid_nulls_order", "SELECT day, hour, kind, round(value, 6) AS value FROM cells ORDER BY value ASC NULLS FIRST, day, hour, kind LIMIT 40")
over_cells("grid_nulls_last", "SELECT day, hour, kind, round(value, 6) AS value FROM cells ORDER BY value DESC NULLS LAST, day, hour, kind LIMIT 40 OFFSET 3")

# joins, windows and sets over datasets
over_cells("grid_anomaly", "WITH c AS (SELECT hour, kind, avg(value) AS mean FROM cells GROUP BY hour, kind) SELECT x.day, x.hour, x.kind, round(x.value - c.mean, 6) AS anomaly FROM cells AS x JOIN c ON x.hour = c.hour AND x.kind = c.kind".replace("WITH c AS (SELECT hour, kind, avg(value) AS mean FROM cells GROUP BY hour, kind) SELECT", "SELECT").replace("JOIN c ON", "JOIN (SELECT hour, kind, avg(value) AS mean FROM cells GROUP BY hour, kind) AS c ON"))
over_cells("grid_window", "SELECT day, hour, kind, round(avg(value) OVER (PARTITION BY hour, kind ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS mean3 FROM cells")
over_cells("grid_stacked", "SELECT 'n' AS variable, day, hour, kind, CAST(n AS DOUBLE) AS v FROM cells WHERE hour = 0 UNION ALL SELECT 'value' AS variable, day, hour, kind, round(value, 6) AS v FROM cells WHERE hour = 0")
over_cells("grid_two_datasets", "SELECT l.level, CAST(sum(c.n) AS BIGINT) AS n FROM cells AS c JOIN (SELECT level, row_number() OVER (ORDER BY level) - 1 AS hour FROM (SELECT DISTINCT level FROM levels) AS d) AS l ON c.hour = l.hour GROUP BY l.level")
over_cells("grid_calendar_offsets", "SELECT time, level, round(total, 2) AS total FROM levels")


@query(f"{LEVELS.join(['WITH ', ''])} SELECT time, level, round(total, 2) AS total FROM levels WHERE time >= 948672000000000")
def grid_cftime_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context(spark, sf_dir, True).sql("SELECT time, level, round(total, 2) AS total FROM levels WHERE time >= cftime('2000-07-01')").df


@query(f"{LEVELS.join(['WITH ', ''])} SELECT CAST(time // 86400000000 AS BIGINT) AS days, level FROM levels WHERE level LIKE '%HIGH%'")
def grid_cftime_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cftime() of a column: the vectorised function."""
    ctx = context(spark, sf_dir, True)
    ctx.register_table("months", spark.range(1, 13).select(F.format_string("2000-%02d-01", F.col("id").cast("int")).alias("text")))
    return ctx.sql("SELECT m.t DIV 86400000000 AS days, l.level FROM (SELECT cftime(text) AS t FROM months) AS m JOIN levels AS l ON l.time = m.t WHERE l.level LIKE '%HIGH%'").df


@query("SELECT hour, kind, round(value * 2, 6) AS double, round(sqrt(value), 6) AS root FROM cells WHERE day = TIMESTAMP '2024-01-04 00:00:00'")
def grid_struct_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's function that gives a struct, and its fields."""
    ctx = context(spark, sf_dir)

    @F.pandas_udf("double double, root double")
    def both(v: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"double": v * 2, "root": v**0.5})

    ctx.register_udf("both_of", both)
    return ctx.sql("SELECT hour, kind, round(p['double'], 6) AS double, round(p.root, 6) AS root FROM (SELECT hour, kind, both_of(value) AS p FROM cells WHERE day = TIMESTAMP '2024-01-04 00:00:00')").df


# and back
@query("SELECT day, hour, kind, round(value, 6) AS value, n FROM cells")
def grid_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = context(spark, sf_dir).sql("SELECT * FROM cells").to_dataset(chunks=None)
    return rows_of(spark, back).withColumn("value", F.round("value", 6))


@query("SELECT hour, kind, round(avg(value), 6) AS value FROM cells GROUP BY hour, kind")
def grid_climatology_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    ds = context(spark, sf_dir).sql("SELECT hour, kind, round(avg(value), 6) AS value FROM cells GROUP BY hour, kind").to_dataset(dims=["hour", "kind"], template="cells")
    assert ds.data["value"].attrs == {"unit": "1"} and ds.attrs == {"title": "events"}
    return rows_of(spark, ds)


@query("SELECT day, hour, kind, n FROM cells WHERE day >= TIMESTAMP '2024-01-11 00:00:00' AND day < TIMESTAMP '2024-01-14 00:00:00' AND hour IN (2, 13)")
def grid_lazy_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lazy result, of which only a block is asked for."""
    ds = context(spark, sf_dir).sql("SELECT day, hour, kind, n FROM cells").to_dataset(chunks={"day": 10})
    days, hours = ds.coords["day"].values, np.array([2, 13])
    at = np.flatnonzero((days >= np.datetime64("2024-01-11")) & (days < np.datetime64("2024-01-14")))
    part = ds.data["n"][slice(int(at[0]), int(at[-1]) + 1), np.searchsorted(ds.coords["hour"].values, hours)]
    return rows_of(spark, GridDataset({"n": (("day", "hour", "kind"), part)}, {"day": days[at], "hour": hours, "kind": ds.coords["kind"].values.astype(str)}))


@query("SELECT day, hour, kind, CASE WHEN hour < 6 THEN n ELSE -1 END AS n FROM cells")
def grid_sparse_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part of the cells on the axes of the whole, with a fill value."""
    return rows_of(spark, context(spark, sf_dir).sql("SELECT day, hour, kind, n FROM cells WHERE hour < 6").to_dataset(template="cells", sparsity="template", fill_value=-1, chunks=None))


@query("SELECT kind, CAST(dense_rank() OVER (ORDER BY hour DESC) - 1 AS BIGINT) AS place, hour FROM (SELECT DISTINCT kind, hour FROM cells)")
def grid_dim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ORDER BY gives the order of an axis."""
    ds = context(spark, sf_dir).sql("SELECT kind, hour, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY kind, hour ORDER BY hour DESC, kind").to_dataset(dims=["kind", "hour"], chunks=None)
    return spark.createDataFrame(pd.DataFrame([(str(k), i, int(h)) for k in ds.coords["kind"].values for i, h in enumerate(ds.coords["hour"].values)], columns=["kind", "place", "hour"]))


@query("SELECT CAST(count(*) AS BIGINT) AS cells, CAST((SELECT count(DISTINCT kind) FROM cells) AS BIGINT) AS kinds, CAST((SELECT sum(n) FROM cells) AS BIGINT) AS events, CAST(7 AS BIGINT) AS run FROM cells")
def grid_mixed_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variables of several sets of dimensions: a database with a table for each."""
    ds = cells_of(spark, sf_dir)
    ds.data["weight"] = GridDataset({"w": (("kind",), np.ones(ds.sizes["kind"]))}).data["w"]
    ds.data["run"] = GridDataset({"r": ((), np.int64(7))}).data["r"]
    ctx = GridContext(spark, _folder(spark)).from_dataset("events_grid", GridDataset(ds.data, ds.coords), table_names={("kind",): "weights"}, chunks={"day": 10})
    return ctx.sql("SELECT CAST(count(*) AS BIGINT) AS cells, CAST(count(DISTINCT c.kind) AS BIGINT) AS kinds, CAST(sum(c.n * w.weight) AS BIGINT) AS events, max(s.run) AS run FROM events_grid.day_hour_kind AS c JOIN events_grid.weights AS w ON c.kind = w.kind CROSS JOIN events_grid.scalar AS s").df


# lazy sources
def _made(cuts: tuple[slice, ...]) -> np.ndarray:
    return (np.arange(cuts[0].start, cuts[0].stop)[:, None] * 10 + np.arange(cuts[1].start, cuts[1].stop)[None, :]).astype(float)


@query("SELECT CAST(a.i AS BIGINT) AS x, CAST(b.i AS BIGINT) AS y, CAST(a.i * 10 + b.i AS DOUBLE) AS v FROM range(40000000, 40000050) AS a(i), range(3, 6) AS b(i)")
def grid_lazy_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two billion cells, 16 GB, that only exist where a query looks at them."""
    big = GridDataset({"v": BlockVar(("x", "y"), (50_000_000, 40), float, _made)}, {"x": np.arange(50_000_000), "y": np.arange(40)})
    ctx = GridContext(spark, _folder(spark)).from_dataset("big", big, chunks={"x": 100_000})
    assert ctx.sql("SELECT count(*) AS n FROM big").collect()[0].n == 2_000_000_000
    return ctx.sql("SELECT x, y, v FROM big WHERE x >= 40000000 AND x < 40000050 AND y IN (3, 4, 5)").df


def _part(day: np.datetime64, table: pa.Table):
    return table.to_batches()


@query("SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM cells WHERE day <= TIMESTAMP '2024-01-02 00:00:00' OR day > TIMESTAMP '2024-01-29 00:00:00' GROUP BY kind")
def grid_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of streams, one a day, of which bounds leave out most."""
    ds = cells_of(spark, sf_dir)
    schema = T.StructType().add("day", "timestamp_ntz").add("hour", "long").add("kind", "string").add("n", "long")
    parts = ((partial(_part, day, pa.Table.from_batches([whole_batch(block)]).select(schema.names)), {"day": (day, day)}, int(np.prod(block.data["n"].shape))) for block in explode(ds, {"day": 1}) for day in block.coords["day"].values)
    ctx = GridContext(spark, _folder(spark)).from_parts("streams", parts, schema)
    return ctx.sql("SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM streams WHERE day <= TIMESTAMP '2024-01-02 00:00:00' OR day > TIMESTAMP '2024-01-29 00:00:00' GROUP BY kind").df


@query("SELECT day, hour, kind, n FROM cells")
def grid_arrow_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dataset as a stream of batches, once."""
    return spark.createDataFrame(read_grid(cells_of(spark, sf_dir), {"day": 7}).read_all().select(["day", "hour", "kind", "n"]))


def _daily(block: GridDataset) -> pd.DataFrame:
    return block.to_pandas().groupby(["day", "kind"], as_index=False)["n"].sum()


@query("SELECT day, kind, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY day, kind")
def grid_from_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(from_map(_daily, explode(cells_of(spark, sf_dir), {"day": 3})))


@query("SELECT day, kind, CAST(sum(n) AS BIGINT) AS n FROM cells GROUP BY day, kind")
def grid_from_map_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = pa.schema([("day", pa.timestamp("us")), ("kind", pa.string()), ("n", pa.int64())])
    return spark.createDataFrame(from_map_batched(_daily, explode(cells_of(spark, sf_dir), {"day": 3}), schema=schema).read_all())


@query("SELECT kind, round(avg(value), 6) AS value FROM cells WHERE day >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY kind")
def grid_parquet_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = _folder(spark)
    stored = write_parquet(spark, cells_of(spark, sf_dir), f"file://{place}/rows", f"{place}/arrays", {"day": 10})
    return stored.where("day >= TIMESTAMP_NTZ '2024-01-20 00:00:00'").groupBy("kind").agg(F.round(F.avg("value"), 6).alias("value"))


@query("SELECT day, hour, kind, n FROM cells WHERE n > 1")
def grid_batch_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(context(spark, sf_dir).sql("SELECT day, hour, kind, n FROM cells WHERE n > 1").toArrow())


@query("SELECT kind, hour, n FROM cells WHERE day = TIMESTAMP '2024-01-15 00:00:00'")
def grid_pandas_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(context(spark, sf_dir).sql("SELECT kind, hour, n FROM cells WHERE day = TIMESTAMP '2024-01-15 00:00:00'").to_pandas())


# weights and warping
@query("""SELECT t.cell, round(sum(s.v * t.wa * t.wb), 6) AS v FROM (
  SELECT cell, a.at AS a, a.w AS wa, b.at AS b, b.w AS wb FROM (
    SELECT cell, unnest([{'at': ia, 'w': 1 - (x - ia)}, {'at': ia + 1, 'w': x - ia}]) AS a, y, ib FROM (
      SELECT cell, x, y, least(greatest(ceil(x) - 1, 0), 22) AS ia, least(greatest(ceil(y) - 1, 0), 6) AS ib FROM (
        SELECT CAST(i AS BIGINT) AS cell, (i * 37 % 231) / 10.0 AS x, (i * 13 % 71) / 10.0 AS y FROM range(60) AS r(i)))) AS p,
    LATERAL (SELECT unnest([{'at': ib, 'w': 1 - (y - ib)}, {'at': ib + 1, 'w': y - ib}]) AS b)) AS t
JOIN (SELECT CAST(hour AS DOUBLE) AS a, CAST(date_part('day', day) - 1 AS DOUBLE) AS b, CAST(sum(n) AS DOUBLE) AS v FROM cells GROUP BY 1, 2) AS s ON s.a = t.a AND s.b = t.b GROUP BY t.cell""")
def grid_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of scattered points on a grid of hours and days, generated and applied."""
    source = context(spark, sf_dir).sql("SELECT CAST(hour AS DOUBLE) AS hour, CAST(day(day) - 1 AS DOUBLE) AS day, CAST(sum(n) AS DOUBLE) AS v FROM cells GROUP BY 1, 2").df
    points = spark.range(60).select(F.col("id").alias("cell"), (F.col("id") * 37 % 231 / 10).alias("hour"), (F.col("id") * 13 % 71 / 10).alias("day"))
    weights = geo.bilinear_weights(points, np.arange(24.0), np.arange(8.0), "hour", "day").select("cell", "src_hour", "src_day", "weight")
    return geo.regrid(source, weights, "v", {"hour": "src_hour", "day": "src_day"}, ["cell"]).select("cell", F.round("v", 6).alias("v"))


@query("SELECT CAST(i AS BIGINT) AS cell, round(2 * (440000.0 + 1500 * (i % 60)) + 3 * (5400000.0 + 1500 * (i // 60)), 2) AS v FROM range(3600) AS r(i)")
def grid_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A UTM grid of a plane, warped to points whose longitude and latitude come from the inverse projection: bilinear interpolation gives the plane's own values back."""
    axis_x, axis_y = 430_000.0 + 2000 * np.arange(60), 5_390_000.0 + 2000 * np.arange(60)
    plane = GridDataset({"v": (("y", "x"), 2 * axis_x[None, :] + 3 * axis_y[:, None])}, {"y": axis_y, "x": axis_x})
    ctx = GridContext(spark, _folder(spark)).from_dataset("plane", plane, chunks={"y": 20})
    at = F.col("id")
    targets = spark.range(3600).select(at.alias("cell"), F.inline(F.array(geo.utm_to_lonlat(440_000.0 + 1500 * (at % 60), 5_400_000.0 + 1500 * F.floor(at / 60), 33))))
    return geo.warp(ctx.read("plane"), targets, axis_x, axis_y, "v", 33, ["cell"]).select("cell", F.round("v", 2).alias("v"))
