"""Window frames by value whose work does not grow with their width."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Quantiles of the values, by which they are cut into parts.
QUANTILES = 256
#: What lies at a place, in the order of counting: what earlier parts hold, lower ends of frames, rows, upper ends of frames.
START, LOWER, ROWS, UPPER = range(4)


def dealt(df: DataFrame, by: list[str], value: str, before: float, after: float) -> DataFrame:
    """Distinct values (__v) with their rows (__n), and both ends of their frames, as places __x of a __part: parts are ranges of places.

    They are cut at quantiles of the values, and at the same moved to the ends of frames, so that no part is crowded by either. Equal rows are one place."""
    finite = df.where((F.col(value) > -math.inf) & (F.col(value) < math.inf))
    found = finite.agg(F.percentile_approx(value, [i / QUANTILES for i in range(1, QUANTILES)])).first()[0] or []
    # 0.0 so that there is a cut at all; + 0.0 leaves no -0.0, which Bucketizer would tell from 0.0
    cuts = sorted({0.0} | {x + 0.0 for q in found for x in (q - before, q, q + after) if math.isfinite(x)})
    parts = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="__x", outputCol="__part", handleInvalid="keep")
    groups = df.groupBy(*by, (F.col(value) + F.lit(0.0)).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    v, none = F.col("__v"), F.lit(0).cast("long")
    # Bucketizer takes no null; nulls are near nulls only, and get a part of their own
    places = F.array(*(F.struct(F.coalesce(x, F.lit(0.0)).alias("__x"), F.lit(kind).alias("__kind"), n.alias("__n")) for x, kind, n in ((v - before, LOWER, none), (v, ROWS, F.col("__n")), (v + after, UPPER, none))))
    return parts.transform(groups.select(*by, "__v", F.inline(places))).withColumn("__part", F.when(v.isNull(), -1).otherwise(F.col("__part").cast("int")))


def near_counts(df: DataFrame, by: list[str], value: str, before: float, after: float, name: str) -> DataFrame:
    """df with name: count(*) OVER (PARTITION BY by ORDER BY value RANGE BETWEEN before PRECEDING AND after FOLLOWING), of a double.

    Spark holds a partition of such a window in one task and counts the frame anew for each row. Here every part is counted along once; a frame's count is what lies up to its upper end, less what lies before its lower one."""
    places = dealt(df, by, value, before, after)
    earlier = F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = places.groupBy(*by, "__part").agg(F.sum("__n").alias("__n")).select(*by, "__part", F.lit(START).alias("__kind"), F.coalesce(earlier, F.lit(0)).alias("__n"))
    upto = F.sum("__n").over(Window.partitionBy(*by, "__part").orderBy("__x", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = places.unionByName(starts, allowMissingColumns=True).select(*by, "__v", "__kind", upto.alias("__upto")).where(F.col("__kind").isin(LOWER, UPPER))
    counts = ends.groupBy(*by, "__v").agg(F.sum(F.when(F.col("__kind") == UPPER, F.col("__upto")).otherwise(-F.col("__upto"))).alias(name))
    counts = counts.select(*(F.col(b).alias(f"__{i}") for i, b in enumerate(by)), "__v", name)
    same = F.col(value).eqNullSafe(F.col("__v"))
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"__{i}"))
    # from the left, as the rows themselves must not be broadcast
    return df.join(counts, same, "left").select(*df.columns, name)
