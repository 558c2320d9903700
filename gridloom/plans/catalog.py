"""Queries over the driver's tables, each with the DuckDB text it is held against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames, geo

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over_sql(name: str, query: str, oracle: str | None = None) -> None:
    """Spark SQL over the tables; the same text is its oracle unless DuckDB needs another."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in TABLES:
            if re.search(rf"\b{t}\b", query):
                table(spark, sf_dir, t).createOrReplaceTempView(t)
        return spark.sql(query)

    QUERIES[name], ORACLES[name] = run, oracle or query


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


# projections, filters and limits
over_sql("scan_projection", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem")
over_sql("scan_limit_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
over_sql("distinct_topk", "SELECT DISTINCT o_orderdate FROM orders ORDER BY o_orderdate DESC LIMIT 10")
over_sql("offset_limit", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10 OFFSET 5")
over_sql("sort_mixed", "SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey ASC, s_acctbal DESC, s_suppkey LIMIT 40")
over_sql("filter_cmp", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45 AND l_discount <= 0.02")
over_sql("filter_flipped", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE 48 <= l_quantity AND 1 <> l_linenumber")
over_sql("filter_between", "SELECT o_orderkey FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1997-01-01 00:00:00' AND TIMESTAMP '1997-03-31 00:00:00'")
over_sql("filter_not_between", "SELECT o_orderkey FROM orders WHERE o_totalprice NOT BETWEEN 5000 AND 400000")
over_sql("filter_in", "SELECT event_id, event_type FROM events WHERE user_id IN (1, 5, 9, 14)")
over_sql("filter_not_in", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey NOT IN (0, 3)")
over_sql("filter_or", "SELECT event_id FROM events WHERE value < 2 OR user_id = 7")
over_sql("filter_not", "SELECT event_id FROM events WHERE NOT (value > 20) AND NOT (user_id = 3)")
over_sql("filter_ts_literal", "SELECT event_id, ts FROM events WHERE ts >= '2024-01-29'")
over_sql("filter_isnull", "SELECT count(*) AS n FROM events WHERE value IS NULL")
over_sql("nan_as_null", "SELECT event_type, count(*) AS n, count(nullif(event_id % 7, 0)) AS n_left, count(*) FILTER (WHERE nullif(event_id % 7, 0) IS NULL) AS n_null FROM events GROUP BY event_type")
over_sql("cast_arith", "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS q, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
over_sql("case_when", "SELECT o_orderpriority, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band, count(*) AS n FROM orders GROUP BY 1, 2")
over_sql("coalesce_nullif", "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg FROM customer")
over_sql("is_distinct_from", "SELECT count(*) AS n FROM nation WHERE nullif(n_regionkey, 1) IS DISTINCT FROM 2")
over_sql("select_one", "SELECT 1 AS one")

# aggregates
over_sql("agg_global", "SELECT round(avg(value) - 273.15, 6) AS mean_c, count(*) AS n, round(sum(value), 4) AS total FROM events")
over_sql("agg_count_filter", "SELECT event_type, count(*) FILTER (WHERE value > 100) AS n_high, count(value) AS n FROM events GROUP BY event_type")
over_sql("agg_group", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2001-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")
over_sql("agg_min_max_ts", "SELECT event_type, min(ts) AS first_ts, max(ts) AS last_ts, min(value) AS low, max(value) AS high FROM events GROUP BY event_type")
over_sql("agg_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
over_sql("agg_count_distinct", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS n_cust FROM orders GROUP BY o_orderpriority")
over_sql("agg_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 12")
over_sql("agg_statistics", "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_tax), 6) AS cv FROM lineitem GROUP BY l_returnflag")
over_sql("agg_median", "SELECT event_type, round(median(value), 6) AS med FROM events GROUP BY event_type")
over_sql("agg_percentile", "SELECT event_type, round(percentile(value, 0.9), 6) AS p90 FROM events GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY event_type")
over_sql("agg_bool_bit", "SELECT o_orderstatus, bool_and(o_totalprice > 0) AS all_pos, bool_or(o_totalprice > 400000) AS any_big, bit_xor(o_orderkey) AS x FROM orders GROUP BY o_orderstatus")
over_sql("agg_string", "SELECT n_regionkey, array_join(array_sort(collect_list(n_name)), ',') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
over_sql("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
over_sql("rollup_query", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
over_sql("cube_query", "SELECT o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")

# joins
over_sql("join_inner", "SELECT c.c_mktsegment, count(*) AS n, round(sum(o.o_totalprice), 2) AS total FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY c.c_mktsegment")
over_sql("join_composite_float", "SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_quantity = b.l_quantity AND a.l_extendedprice = b.l_extendedprice AND a.l_orderkey = b.l_orderkey")
over_sql("join_small_build", "SELECT n.n_name, count(*) AS n FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name")
over_sql("join_left", "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey GROUP BY c.c_custkey")
over_sql("join_right_full", "SELECT r.r_name, n.n_name FROM nation n FULL OUTER JOIN region r ON n.n_regionkey = r.r_regionkey AND n.n_nationkey > 20")
over_sql("join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
over_sql("join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
over_sql("in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
over_sql("scalar_subquery", "SELECT count(*) AS n FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
over_sql("cross_join_count", "SELECT count(*) AS n FROM nation CROSS JOIN region")
over_sql("self_join_cte", "WITH m AS (SELECT user_id, avg(value) AS mean_value FROM events GROUP BY user_id) SELECT e.event_id, round(e.value - m.mean_value, 6) AS d FROM events e JOIN m ON e.user_id = m.user_id")
over_sql("lateral_join", "SELECT r.r_name, t.n_name FROM region r, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r.r_regionkey) t")
over_sql("recursive_cte", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n FROM t")

# set operations
over_sql("union_all", "SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region")
over_sql("union_distinct", "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey AS k FROM region")
over_sql("intersect_query", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey AS k FROM supplier")
over_sql("except_query", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey AS k FROM orders")
over_sql("stack_models", "SELECT 'a' AS model, event_type, round(avg(value), 6) AS v FROM events GROUP BY event_type UNION ALL SELECT 'b' AS model, event_type, round(max(value), 6) AS v FROM events GROUP BY event_type")

# windows
over_sql("window_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS dr FROM orders", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS INTEGER) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS INTEGER) AS dr FROM orders")
over_sql("window_ntile", "SELECT s_suppkey, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS q, round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS pr, round(cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS cd FROM supplier", "SELECT s_suppkey, CAST(ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) AS INTEGER) AS q, round(percent_rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS pr, round(cume_dist() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal), 6) AS cd FROM supplier")
over_sql("window_lag_lead", "SELECT event_id, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, lead(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after2, first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f, nth_value(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM events")
over_sql("window_rows_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS s FROM events")


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice RANGE BETWEEN 500 PRECEDING AND 500 FOLLOWING) AS near FROM orders")
def window_range_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return frames.near_counts(orders, ["o_orderstatus"], "o_totalprice", 500, 500, "near").select("o_orderkey", "near")


# functions
over_sql("functions_string", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, length(c_name) AS n, substring(c_name, 2, 4) AS sub, replace(c_name, '0', 'o') AS rep, trim(concat('  ', c_mktsegment, ' ')) AS t, lpad(CAST(c_custkey AS STRING), 8, '0') AS padded, reverse(c_mktsegment) AS rev, md5(c_name) AS digest FROM customer", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, CAST(length(c_name) AS INTEGER) AS n, substring(c_name, 2, 4) AS sub, replace(c_name, '0', 'o') AS rep, trim(concat('  ', c_mktsegment, ' ')) AS t, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS padded, reverse(c_mktsegment) AS rev, md5(c_name) AS digest FROM customer")
over_sql("functions_regexp", "SELECT c_custkey, regexp_replace(c_name, '[0-9]+', '#') AS r, regexp_extract(c_name, '([0-9]+)', 1) AS d FROM customer WHERE c_name RLIKE '1$'", "SELECT c_custkey, regexp_replace(c_name, '[0-9]+', '#') AS r, regexp_extract(c_name, '([0-9]+)', 1) AS d FROM customer WHERE regexp_matches(c_name, '1$')")
over_sql("functions_math", "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS s, round(power(p_size, 2), 6) AS p, round(ln(p_retailprice), 6) AS l, round(sin(p_size), 6) AS si, round(atan2(p_size, 3), 6) AS a2, abs(p_size - 20) AS ab, floor(p_retailprice) AS f, sign(p_size - 25.0) AS sg, greatest(p_size, 10) AS g FROM part", "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS s, round(power(p_size, 2), 6) AS p, round(ln(p_retailprice), 6) AS l, round(sin(p_size), 6) AS si, round(atan2(p_size, 3), 6) AS a2, abs(p_size - 20) AS ab, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(sign(p_size - 25.0) AS DOUBLE) AS sg, greatest(p_size, 10) AS g FROM part")
over_sql("date_parts", "SELECT event_id, CAST(date_part('hour', ts) AS INT) AS h, CAST(date_part('month', ts) AS INT) AS m, CAST(date_part('day', ts) AS INT) AS d, CAST(date_trunc('day', ts) AS TIMESTAMP_NTZ) AS day0 FROM events", "SELECT event_id, CAST(date_part('hour', ts) AS INT) AS h, CAST(date_part('month', ts) AS INT) AS m, CAST(date_part('day', ts) AS INT) AS d, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day0 FROM events")
over_sql("timestamp_plus_interval", "SELECT event_id, ts + INTERVAL '6' HOUR AS later FROM events")
over_sql("json_field", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
over_sql("arrays_unpivot", "SELECT vec_id, pos, component FROM embeddings LATERAL VIEW posexplode(embedding) AS pos, component", "SELECT vec_id, CAST(i - 1 AS INTEGER) AS pos, embedding[i] AS component FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)")
over_sql("arrays_repivot", "SELECT pos, label, round(avg(component), 5) AS m FROM (SELECT label, posexplode(embedding) AS (pos, component) FROM embeddings) GROUP BY pos, label", "SELECT CAST(i - 1 AS INTEGER) AS pos, label, round(avg(CAST(embedding[i] AS DOUBLE)), 5) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2")
over_sql("struct_access", "SELECT s_suppkey, named_struct('a', s_nationkey, 'b', s_acctbal)['b'] AS b FROM supplier", "SELECT s_suppkey, s_acctbal AS b FROM supplier")

# gridded operations
over_sql("annual_cycle_month", "SELECT CAST(date_part('month', o_orderdate) AS INT) AS month, round(avg(o_totalprice), 4) AS mean_price FROM orders GROUP BY 1")
over_sql("vertical_profile", "SELECT l_linenumber AS level, round(avg(l_extendedprice) - 273.15, 4) AS v FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1996-12-31 00:00:00' GROUP BY l_linenumber ORDER BY level DESC")
over_sql("point_average", "SELECT round(avg(value), 6) AS v FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-01-01 05:00:00' AND user_id BETWEEN 10 AND 60")
REGIONS = "VALUES (1, 0.0, 40.0, 0.0, 50.0), (2, 30.0, 90.0, 20.0, 400.0), (3, 100.0, 150.0, 0.0, 500.0)"


@query("SELECT CAST(date_part('hour', ts) AS INTEGER) AS hour, event_type, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")
def climatology_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.climatology(table(spark, sf_dir, "events"), "value", ["event_type"], "ts").withColumn("value", F.round("value", 6))


@query("SELECT l_orderkey, l_linenumber, round((l_extendedprice - l_quantity) / nullif(l_extendedprice + l_quantity, 0), 9) AS ndvi FROM lineitem")
def ndvi_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(geo.normalized_difference(F.col("l_extendedprice"), F.col("l_quantity")), 9).alias("ndvi"))


@query("SELECT user_id, round(avg(value), 6) AS value FROM events GROUP BY user_id")
def zonal_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.zonal_mean(table(spark, sf_dir, "events"), "value", "user_id").withColumn("value", F.round("value", 6))


ANOMALY = "SELECT event_id, round(value - avg(value) OVER (PARTITION BY event_type, date_part('hour', ts)), 6) AS anomaly FROM events"


@query(ANOMALY)
def anomaly_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.anomaly(table(spark, sf_dir, "events"), "value", ["event_type"], "ts").select("event_id", F.round("anomaly", 6).alias("anomaly"))


@query(ANOMALY)
def anomaly_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.anomaly_by_join(table(spark, sf_dir, "events"), "value", ["event_type"], "ts").select("event_id", F.round("anomaly", 6).alias("anomaly"))


@query("""WITH t AS (SELECT event_type, date_trunc('hour', ts) AS t, avg(value) AS v FROM events GROUP BY 1, 2),
f AS (SELECT event_type, t, v, unnest([1, 6, 24]) AS lead FROM t)
SELECT CAST(f.lead AS INTEGER) AS lead_hours, round(sqrt(avg(power(f.v - e.v, 2))), 6) AS rmse FROM f JOIN t e ON e.event_type = f.event_type AND e.t = f.t + to_hours(f.lead) GROUP BY f.lead""")
def forecast_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time")).agg(F.avg("value").alias("v"))
    forecast = truth.withColumn("hours", F.explode(F.array(*map(F.lit, (1, 6, 24))))).withColumn("lead", F.make_dt_interval(F.lit(0), F.col("hours")))
    found = geo.forecast_skill(forecast, truth, "v", ["hours"], ["event_type"])
    return found.select(F.col("hours").alias("lead_hours"), F.round("rmse", 6).alias("rmse"))


@query(f"""WITH r(region, lat_min, lat_max, lon_min, lon_max) AS ({REGIONS})
SELECT region, round(avg(value), 6) AS value, count(*) AS n FROM events JOIN r ON user_id BETWEEN lat_min AND lat_max AND value BETWEEN lon_min AND lon_max GROUP BY region""")
def zonal_stats_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = spark.sql(f"SELECT * FROM ({REGIONS}) AS r(region, lat_min, lat_max, lon_min, lon_max)")
    cells = table(spark, sf_dir, "events").select(F.col("user_id").cast("double").alias("lat"), F.col("value").alias("lon"), "value")
    return geo.zonal_statistics(cells, regions, "value").withColumn("value", F.round("value", 6))


@query(ORACLES["zonal_stats_range_join"])
def zonal_stats_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = spark.sql(f"SELECT * FROM ({REGIONS}) AS r(region, lat_min, lat_max, lon_min, lon_max)")
    cells = table(spark, sf_dir, "events").select(F.col("user_id").cast("double").alias("lat"), F.col("value").alias("lon"), "value")
    return geo.zonal_statistics(cells, regions, "value", bin_size=20.0).withColumn("value", F.round("value", 6))


WEIGHTS = "VALUES (0, 1, 0.25), (0, 2, 0.75), (1, 3, 0.5), (1, 4, 0.5), (2, 6, 1.0), (2, 7, 0.0)"


@query(f"""WITH w(dst, src, weight) AS ({WEIGHTS}), s AS (SELECT l_linenumber AS src, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1)
SELECT dst, round(sum(v * weight), 6) AS v FROM s JOIN w ON s.src = w.src GROUP BY dst""")
def regrid_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = spark.sql(f"SELECT dst, src AS wsrc, CAST(weight AS DOUBLE) AS weight FROM ({WEIGHTS}) AS w(dst, src, weight)")
    source = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("src")).agg(F.avg("l_extendedprice").alias("v"))
    return geo.regrid(source, weights, "v", {"src": "wsrc"}, ["dst"]).select("dst", F.round("v", 6).alias("v"))


def _inverse_sql() -> str:
    xi, eta = f"(y / {geo.SCALE * geo.RADIUS!r})", f"((x - {geo.EAST!r}) / {geo.SCALE * geo.RADIUS!r})"
    u = xi + "".join(f" - {b!r} * sin({2 * j + 2} * {xi}) * cosh({2 * j + 2} * {eta})" for j, b in enumerate(geo.BETA))
    v = eta + "".join(f" - {b!r} * cos({2 * j + 2} * {xi}) * sinh({2 * j + 2} * {eta})" for j, b in enumerate(geo.BETA))
    lat = "chi" + "".join(f" + {d!r} * sin({2 * j + 2} * chi)" for j, d in enumerate(geo.DELTA))
    return f"""WITH p AS (SELECT o_orderkey, 400000.0 + (o_custkey % 200) * 1000 AS x, 5000000.0 + (o_orderkey % 500) * 1000 AS y FROM orders),
q AS (SELECT o_orderkey, {u} AS u, {v} AS v FROM p), r AS (SELECT o_orderkey, u, v, asin(sin(u) / cosh(v)) AS chi FROM q)
SELECT o_orderkey, round(degrees(radians(15.0) + atan2(sinh(v), cos(u))), 7) AS lon, round(degrees({lat}), 7) AS lat FROM r"""


@query(_inverse_sql())
def reproject_utm(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "orders").select("o_orderkey", (400000.0 + F.col("o_custkey") % 200 * 1000).alias("x"), (5000000.0 + F.col("o_orderkey") % 500 * 1000).alias("y"))
    return points.withColumn("p", geo.utm_to_lonlat(F.col("x"), F.col("y"), 33)).select("o_orderkey", F.round("p.lon", 7).alias("lon"), F.round("p.lat", 7).alias("lat"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 250000 AND o_orderdate >= TIMESTAMP '1999-01-01 00:00:00'")
def params_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..context import dialect

    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql(dialect('SELECT "o_orderkey" FROM orders WHERE o_totalprice > $low AND o_orderdate >= CAST($start AS TIMESTAMP_NTZ)'), args={"low": 250000, "start": "1999-01-01"})
