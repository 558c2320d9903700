"""Arrays to tables and back."""

import datetime as dt
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import datasource as D

from gridloom import calendars as cal
from gridloom.context import GridContext, dialect
from gridloom.dataset import GridDataset, block_slices, explode, resolve_chunks
from gridloom.sources.batches import GridBatchReader, block_batches, from_map, from_map_batched, read_grid, whole_batch
from gridloom.sources.grid import GridReader, may_hold, write_store
from gridloom.sources.parquet_store import analyzed_table, open_npz, save_npz, write_parquet
from gridloom.types import infer_schema

DAYS = (np.datetime64("2000-01-01") + np.arange(100).astype("timedelta64[D]")).astype("datetime64[us]")


def air(nan=False):
    rng = np.random.default_rng(0)
    a = rng.normal(size=(100, 5))
    if nan:
        a[3, 2] = np.nan
    return GridDataset({"air": (("time", "lat"), a, {"unit": "K"}), "rain": (("time", "lat"), rng.random((100, 5)).astype("f4"))}, {"time": DAYS, "lat": np.array([50.0, 40, 30, 20, 10]), "run": ((), np.int64(7))}, {"title": "x"})


@pytest.fixture
def ctx(spark):
    with GridContext(spark) as c:
        yield c


def test_round_trip_keeps_everything(ctx):
    ds = air(nan=True)
    ctx.from_dataset("air", ds, chunks={"time": 25})
    for chunks in (None, "inherit", {"time": 30}, "auto"):
        back = ctx.sql("SELECT * FROM air").to_dataset(chunks=chunks)
        assert back.equals(ds) and back.attrs == ds.attrs and back.data["air"].attrs == {"unit": "K"}


def test_missing_values_are_null(ctx):
    ctx.from_dataset("air", air(nan=True), chunks={"time": 25})
    got = ctx.sql("SELECT count(*) n, count(air) c, count(*) FILTER (WHERE air IS NULL) z, avg(air) a FROM air").collect()[0]
    assert (got.n, got.c, got.z) == (500, 499, 1) and got.a == pytest.approx(np.nanmean(air(nan=True).data["air"].values))


@pytest.mark.parametrize("filters,kept", [
    ([D.GreaterThan(("time",), dt.datetime(2000, 3, 20))], 1),
    ([D.LessThan(("time",), dt.datetime(2000, 1, 10))], 1),
    ([D.GreaterThanOrEqual(("time",), dt.datetime(2000, 2, 15)), D.LessThanOrEqual(("time",), dt.datetime(2000, 3, 15))], 2),
    ([D.GreaterThan(("lat",), 100.0)], 0),
    ([D.EqualTo(("time",), dt.datetime(2000, 1, 5))], 1),
    ([D.In(("time",), (dt.datetime(2000, 1, 5), dt.datetime(2000, 4, 1)))], 2),
    ([D.In(("lat",), ("x",))], 4),
    ([D.Not(D.EqualTo(("lat",), 30.0))], 4),
    ([D.GreaterThan(("air",), 1e9)], 4),
])
def test_pruning(tmp_path, filters, kept):
    reader = GridReader(write_store(air(), str(tmp_path / "s"), {"time": 25}), None)
    reader.pushFilters(filters)
    assert len(reader.partitions()) == kept


def test_unequal_prunes_only_single_points():
    assert not may_hold(D.Not(D.EqualTo(("x",), 3)), {"x": [3, 3]}, set())
    assert may_hold(D.Not(D.EqualTo(("x",), 3)), {"x": [3, 4]}, set())


def test_all_pruned_gives_no_rows(ctx):
    ctx.from_dataset("air", air(), chunks={"time": 25})
    assert ctx.sql("SELECT * FROM air WHERE lat > 100").count() == 0
    assert ctx.sql("SELECT count(*) n FROM air WHERE time >= '2000-02-15' AND time <= '2000-03-15'").collect()[0].n == 30 * 5


def test_only_used_columns_are_read(tmp_path):
    place = write_store(air(), str(tmp_path / "s"), {"time": 25})
    os.remove(f"{place}/3.npy")  # rain
    reader = GridReader(place, ["time", "lat", "air"])
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 500


def test_results_keep_order_of_dimensions(ctx):
    ctx.from_dataset("air", air(), chunks={"time": 25})
    up = ctx.sql("SELECT lat, avg(air) AS air FROM air GROUP BY lat ORDER BY lat").to_dataset(dims=["lat"], chunks=None)
    assert list(up.coords["lat"].values) == [10, 20, 30, 40, 50]
    whole = ctx.sql("SELECT lat, time, air FROM air ORDER BY time").to_dataset(chunks={"time": 10})
    assert list(whole.coords["lat"].values) == [50, 40, 30, 20, 10]


def test_lazy_indexing(ctx):
    ds = air()
    ctx.from_dataset("air", ds, chunks={"time": 25})
    lazy = ctx.sql("SELECT * FROM air").to_dataset(chunks={"time": 25}).data["air"]
    a = ds.data["air"].values
    for key in ((3, 2), (slice(10, 20), slice(None)), (np.array([5, 1, 5]), 0), (slice(0, 0), 1), (slice(None, None, 7), np.array([4, 0]))):
        np.testing.assert_array_equal(lazy[key], a[key] if not (isinstance(key[0], slice) and isinstance(key[1], np.ndarray)) else a[key[0]][:, key[1]])


def test_sparse_results(ctx):
    ds = GridDataset({"v": (("lat", "lon"), np.arange(6).reshape(3, 2))}, {"lat": np.array([1, 2, 3]), "lon": np.array([10, 11])})
    ctx.from_dataset("g", ds, chunks={"lat": 3})
    some = ctx.sql("SELECT lat, lon, v + 1 AS v FROM g WHERE lat <> 3")
    assert some.to_dataset().data["v"].values.shape == (2, 2)
    full = some.to_dataset(sparsity="template").data["v"].values
    assert full.dtype.kind == "f" and np.isnan(full[2]).all()
    typed = some.to_dataset(sparsity="template", fill_value=-1).data["v"].values
    assert typed.dtype.kind == "i" and (typed[2] == -1).all()
    holes = ctx.sql("SELECT lat, lon, v FROM g WHERE v <> 0").to_dataset(fill_value=-9).data["v"].values
    assert sorted(holes.ravel()) == [-9, 1, 2, 3, 4, 5]
    with pytest.raises(ValueError, match="several rows"):
        ctx.sql("SELECT lat, lon, v FROM g UNION ALL SELECT lat, lon, v FROM g").to_dataset(chunks=None)
    with pytest.raises(ValueError, match="sparsity"):
        some.to_dataset(sparsity="x")
    with pytest.raises(ValueError, match="not a registered"):
        some.to_dataset(template="nope")
    with pytest.raises(ValueError, match="inferred"):
        ctx.sql("SELECT v FROM g").to_dataset()


def test_mixed_dimensions_become_a_database(ctx):
    ds = GridDataset({"t2": (("time", "lat"), np.zeros((2, 3))), "p": (("time", "lat", "level"), np.ones((2, 3, 2))), "proj": ((), np.int64(4))}, {"time": DAYS[:2], "lat": np.arange(3.0), "level": np.array([500, 1000])})
    ctx.from_dataset("mix", ds, table_names={("time", "lat"): "surface"}, chunks={"time": 1})
    assert sorted(ctx.table_names("mix")) == ["scalar", "surface", "time_lat_level"]
    assert ctx.sql("SELECT count(*) n FROM mix.surface").collect()[0].n == 6
    assert ctx.sql("SELECT sum(p) s FROM mix.time_lat_level").collect()[0].s == 12
    assert ctx.sql("SELECT proj FROM mix.scalar").collect()[0].proj == 4


def test_strings_and_axes_without_coordinates(ctx):
    ctx.from_dataset("s", GridDataset({"score": (("student", "subject"), np.arange(6.0).reshape(3, 2))}, {"student": np.array(["a", "b", "c"]), "subject": np.array(["m", "n"])}), chunks={"student": 1})
    assert ctx.sql("SELECT score FROM s WHERE student = 'b' AND subject = 'n'").collect()[0].score == 3
    ctx.from_dataset("st", GridDataset({"name": (("station",), np.array(["x", "y"])), "z": (("station",), np.array([1, 2]))}), chunks={"station": 2})
    assert ctx.sql("SELECT * FROM st").columns == ["name", "z"]


def test_empty_axes(ctx):
    ctx.from_dataset("e", GridDataset({"v": (("time", "lat"), np.zeros((0, 0)))}, {"time": DAYS[:0], "lat": np.zeros(0)}), chunks={"time": 10})
    assert ctx.sql("SELECT * FROM e").count() == 0


def test_climate_calendar(ctx):
    times = np.array([cal.CalDate(2000, m, calendar="360_day") for m in range(1, 13)], dtype=object)
    ctx.from_dataset("c", GridDataset({"temp": (("time",), np.arange(12, dtype="f4"))}, {"time": times}), chunks={"time": 6})
    assert ctx.sql("SELECT * FROM c WHERE time >= cftime('2000-07-01')").count() == 6
    assert ctx.sql("SELECT cftime(x) AS v FROM VALUES ('2000-07-01'), (NULL) AS t(x) ORDER BY v").collect()[1].v == 948_672_000_000_000
    assert cal.date2num(cal.parse("2000-03-01", "julian"), "days since 2000-02-01") == 29
    assert cal.date2num(cal.parse("2001-01-01", "noleap"), "days since 2000-01-01") == 365
    assert cal.date2num(cal.parse("1582-10-15", "standard"), "days since 1582-10-04") == 1
    assert cal.day_number(2024, 2, 29, "proleptic_gregorian") == (dt.date(2024, 2, 29) - dt.date(1970, 1, 1)).days


def test_sql_faults_are_raised_at_once(ctx):
    ctx.from_dataset("air", air(), chunks={"time": 25})
    for text in ("SELECT nope FROM air", "SELECT * FROM nowhere"):
        with pytest.raises(AnalysisException):
            ctx.sql(text)
    with pytest.raises(ParseException):
        ctx.sql("SELEC * FROM air")
    with pytest.raises(ValueError):
        ctx.sql("SELECT * FROM air WHERE")


def test_dialect():
    assert dialect("""SELECT "2m_t", '"no" $x' FROM t WHERE a = $p -- "c" """) == """SELECT `2m_t`, '"no" $x' FROM t WHERE a = :p -- "c" """


def test_chunks():
    ds = GridDataset({"v": (("x", "y"), np.zeros((7, 6)))}, {"x": np.arange(7), "y": np.arange(6)})
    assert resolve_chunks(ds, {"x": 3, "z": 1}) == {"x": (3, 3, 1), "y": (6,)}
    assert resolve_chunks(ds, {"x": 0}) == {"x": (7,), "y": (6,)} and resolve_chunks(ds, {"x": 99})["x"] == (7,)
    assert len(list(explode(ds, {"x": 3, "y": 2}))) == 9
    with pytest.raises(AssertionError):
        list(block_slices(ds))
    assert list(block_slices(GridDataset({"s": ((), 1.0)}))) == [{}]


def test_batches_agree_and_stream_once():
    ds = air(nan=True)
    whole = whole_batch(ds)
    assert pa.Table.from_batches(block_batches(ds, infer_schema(ds), 64)).combine_chunks().to_batches()[0].equals(whole)
    assert read_grid(ds, {"time": 30}).read_all().num_rows == 500
    reader = GridBatchReader(ds, {"time": 30})
    reader.to_reader().read_all()
    with pytest.raises(RuntimeError, match="consumed"):
        reader.to_reader()
    mixed = GridDataset({"a": (("x",), np.zeros(2)), "b": ((), 1.0)})
    with pytest.raises(ValueError):
        GridBatchReader(mixed)


def test_from_map():
    assert from_map(lambda a, b, c: {"v": [a + b + c]}, [1, 2], [10, 20], args=(100,))["v"].to_pylist() == [111, 122]
    with pytest.raises(ValueError):
        from_map(lambda a: a, [])
    assert from_map_batched(lambda a: {"v": [a]}, [], schema=pa.schema([("v", pa.int64())])).read_all().num_rows == 0


def test_types_that_spark_lacks_are_widened(ctx):
    ds = GridDataset({f"v{k}": (("x",), np.array([0, 1, 2]).astype(k)) for k in ("u1", "u2", "u4", "u8", "f2", "b1", "i1")}, {"x": np.arange(3)})
    ctx.from_dataset("w", ds, chunks={"x": 2})
    assert [int(x) for x in ctx.sql("SELECT sum(vu1) a, sum(vu2) b, sum(vu4) c, sum(vu8) d, sum(vf2) e FROM w").collect()[0]] == [3] * 5
    with pytest.raises(ValueError, match="microseconds"):
        ctx.from_dataset("ns", GridDataset({"v": (("t",), np.zeros(1))}, {"t": np.array([1500], "datetime64[ns]")}), chunks={"t": 1})
    with pytest.raises(TypeError):
        infer_schema(GridDataset({"v": (("x",), np.zeros(3, complex))}))


def test_stores(spark, tmp_path):
    ds = air()
    df = write_parquet(spark, ds, str(tmp_path / "p"), str(tmp_path / "s"), {"time": 25})
    assert df.count() == 500
    t = analyzed_table(spark, "analyzed_air", str(tmp_path / "p"))
    assert "rowCount=500" in t._jdf.queryExecution().optimizedPlan().stats().toString()
    spark.sql("DROP TABLE analyzed_air")
    save_npz(ds, str(tmp_path / "a.npz"))
    assert open_npz(str(tmp_path / "a.npz"), {"time": 25}).equals(ds)


def test_small_tables_are_the_build_side(ctx, monkeypatch):
    import gridloom.context as c

    monkeypatch.setattr(c, "SMALL_BYTES", 2000)
    ctx.from_dataset("big", air(), chunks={"time": 25})
    ctx.from_dataset("small", GridDataset({"w": (("lat",), np.arange(5.0))}, {"lat": np.array([50.0, 40, 30, 20, 10])}), chunks={"lat": 5})
    assert ctx.size("big")[0] == 500 and ctx.size("small") == (5, 80)
    joined = ctx.sql("SELECT sum(air * w) AS s FROM big JOIN small ON big.lat = small.lat")
    plan = joined.df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BuildRight" in plan
    assert joined.collect()[0].s == pytest.approx(float((air().data["air"].values * np.arange(5.0)).sum()))


@pytest.mark.parametrize("where,kept", [
    ("time < '2000-01-10' OR time > '2000-04-05'", 2), ("(time < '2000-01-10' AND lat > 45) OR (time > '2000-04-05' AND lat > 100)", 1), ("lat > 100 OR lat < 0", 0),
    ("air > 5 OR time < '2000-01-10'", 4), ("time < '2000-01-10' OR abs(lat) > 1", 4), ("NOT (time >= '2000-01-10')", 1), ("time IN ('2000-01-03', '2000-03-01')", 2),
])
def test_conditions_of_a_plan_prune(ctx, where, kept):
    from gridloom import conditions

    ctx.from_dataset("air", air(), chunks={"time": 25})
    df = ctx.spark.sql(f"SELECT * FROM air WHERE {where}")
    (path, told), = conditions.scans(df)
    reader = GridReader(path, None, told)
    assert path == ctx.stores["air"] and len(reader.partitions()) == kept
    assert ctx.sql(f"SELECT count(*) n FROM air WHERE {where}").collect()[0].n == df.count()


def test_counts_and_bounds_need_no_scan(ctx):
    ds = air(nan=True)
    ctx.from_dataset("air", ds, chunks={"time": 25})
    got = ctx.sql("SELECT count(*) AS n, min(time) AS a, max(time) AS b, min(lat) AS c, count(lat) AS d FROM air")
    assert "grid" not in got.df._jdf.queryExecution().executedPlan().toString()
    assert tuple(got.collect()[0]) == (500, dt.datetime(2000, 1, 1), dt.datetime(2000, 4, 9), 10.0, 500)
    assert [f.dataType for f in got.df.schema] == [f.dataType for f in ctx.spark.sql("SELECT count(*) AS n, min(time) AS a, max(time) AS b, min(lat) AS c, count(lat) AS d FROM air").schema]
    assert ctx.statistics("air")["rows"] == 500 and ctx.statistics("air")["columns"]["lat"] == (10.0, 50.0, 0)
    for text, want in (("SELECT count(air) AS n FROM air", 499), ("SELECT count(*) AS n FROM air WHERE lat > 20", 300), ("SELECT count(DISTINCT lat) AS n FROM air", 5), ("SELECT count(*) FILTER (WHERE lat > 20) AS n FROM air", 300), ("SELECT count(*) AS n FROM (SELECT lat FROM air LIMIT 7)", 7)):
        assert ctx.sql(text).collect()[0].n == want


def test_queries_leave_the_session_alone(ctx, spark):
    ctx.from_dataset("air", air(), chunks={"time": 25})
    before = {t.name for t in spark.catalog.listTables()}
    assert ctx.sql("WITH air2 AS (SELECT * FROM air) SELECT count(lat + 1) n FROM air2").collect()[0].n == 500
    assert ctx.sql("WITH air AS (SELECT 1 AS lat) SELECT sum(lat) n FROM air").collect()[0].n == 1
    assert ctx.sql("(SELECT max(air) m FROM air)").collect()[0].m == air().data["air"].values.max()
    assert ctx.sql("FROM air SELECT count(rain * 2) AS n").collect()[0].n == 500
    assert {t.name for t in spark.catalog.listTables()} == before and len(spark.table("air").columns) == 4


def _block(cuts):
    return np.arange(cuts[0].start, cuts[0].stop)[:, None] * 1.0 + np.zeros(cuts[1].stop - cuts[1].start)[None, :]


def test_blocks_that_are_never_whole(ctx, tmp_path):
    from gridloom.dataset import BlockVar, open_npy

    big = BlockVar(("x", "y"), (10_000_000, 1000), float, _block)
    ds = GridDataset({"v": big}, {"x": np.arange(10_000_000), "y": np.arange(1000)})
    ctx.from_dataset("big", ds, chunks={"x": 5000})
    assert ctx.sql("SELECT count(*) AS n FROM big").collect()[0].n == 10**10
    assert ctx.sql("SELECT sum(v) s FROM big WHERE x BETWEEN 7000000 AND 7000001 AND y = 3").collect()[0].s == 14_000_001
    part = ds.isel({"x": slice(100, 110), "y": slice(2, 4)})
    assert isinstance(part.data["v"], BlockVar) and part.data["v"].values[3].tolist() == [103.0, 103.0]
    assert isinstance(part.isel({"x": slice(1, 3)}).data["v"], BlockVar) and part.isel({"x": slice(1, 3)}).data["v"].values[0, 0] == 101
    np.save(tmp_path / "a.npy", np.arange(12.0).reshape(4, 3))
    ctx.from_dataset("mapped", GridDataset({"w": open_npy(("a", "b"), str(tmp_path / "a.npy"))}, {"a": np.arange(4), "b": np.arange(3)}), chunks={"a": 2})
    assert ctx.sql("SELECT sum(w) s FROM mapped WHERE a >= 2").collect()[0].s == sum(range(6, 12))
    with pytest.raises(ValueError, match="shape"):
        BlockVar(("x",), (5,), float, lambda cuts: np.zeros(3)).values


def test_parts(ctx):
    from pyspark.sql.types import StructType

    schema = StructType().add("x", "long").add("v", "double")
    made = lambda lo: lambda: [pa.RecordBatch.from_pydict({"x": pa.array(range(lo, lo + 10)), "v": pa.array([0.5] * 10)})]
    ctx.from_parts("p", ((made(10 * i), {"x": (10 * i, 10 * i + 9)}, 10) for i in range(5)), schema)
    assert ctx.sql("SELECT count(*) n, sum(v) s FROM p WHERE x < 10 OR x >= 45").collect()[0] == (15, 7.5)

    def fails():
        raise RuntimeError("not to be read")

    ctx.from_parts("q", [(made(0), {"x": (0, 9)}, 10), (fails, {"x": (10, 19)}, 10)], schema)
    assert ctx.sql("SELECT count(v) n FROM q WHERE x < 5 OR x > 100").collect()[0].n == 5
    for parts, error in (([], ValueError), ([(made(0), {"x": (0, 1)})], TypeError), ([("no function", {}, 1)], TypeError), ([(made(0), {"nope": (0, 1)}, 1)], TypeError)):
        with pytest.raises(error):
            ctx.from_parts("r", parts, schema)


def test_auto_chunks_count_the_widest_variable():
    from gridloom.frame import auto_chunks

    ds = GridDataset({"v": (("time", "x"), np.zeros((24, 4)))}, {"time": np.arange(24), "x": np.arange(4)}, chunks={"time": (2,) * 12, "x": (4,)})
    assert auto_chunks(ds, ds, 192) == {"time": (6, 6, 6, 6), "x": (4,)}
    narrow = GridDataset({"v": (("time", "x"), np.zeros((24, 4), "f4"))}, ds.coords, chunks=ds.chunks)
    assert auto_chunks(narrow, narrow, 192)["time"] == (12, 12) and auto_chunks(ds, None, 1) == {"time": (24,), "x": (4,)}


def test_cftime_in_literals_and_comments():
    text = "SELECT 'cftime(''2000-01-01'')' AS a, cftime('1970-01-02') AS b -- cftime('x')"
    assert cal.fold_cftime(text, cal.DEFAULT_UNITS, "360_day") == "SELECT 'cftime(''2000-01-01'')' AS a, 86400000000L AS b -- cftime('x')"


def test_commands_run_once(ctx, spark, tmp_path):
    ctx.from_dataset("air", air(), chunks={"time": 25})
    ctx.sql(f"CREATE TABLE sink (lat DOUBLE) USING parquet LOCATION '{tmp_path}/sink'")
    ctx.sql("INSERT INTO sink SELECT lat FROM air")
    assert spark.table("sink").count() == 500
    ctx.sql("DROP TABLE sink")
    assert "BatchScan grid" in ctx.sql("EXPLAIN SELECT lat FROM air").collect()[0][0]
    assert ctx.sql("SELECT 1 AS one").collect()[0].one == 1
