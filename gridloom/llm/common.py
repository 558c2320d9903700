"""What several operators share: word patterns, spread keys, written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a table counted beforehand is broadcast; beyond it Spark joins by a shuffle.
BROADCAST_ROWS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a temporary one only where that is unset and Spark is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="gridloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, place: str) -> DataFrame:
    """df as Parquet at place, read again: later plans start from the files, and lost executors cost no recomputation."""
    df.write.mode("overwrite").parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def delete(spark: SparkSession, *places: str) -> None:
    """Removes folders in whatever file system they are in."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for place in places:
        path = jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(conf).delete(path, True)


def group_key(name: str) -> Column:
    """A non-null string for each value of a column, null apart from every string."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("-"))


def spread(seed: int, *columns: Column) -> Column:
    """53 bits that are even over rows and the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)


def bucket(q: Column, buckets: Column) -> Column:
    """Which of so many equal ranges of spread() a value falls into; ascending with it."""
    return F.least(buckets - 1, F.floor(q.cast("double") * F.lit(2.0**-53) * buckets)).cast("long")


def joined(left: DataFrame, right: DataFrame, on: list[str], rows: int | None, how: str = "inner") -> DataFrame:
    """Joins; right is broadcast if it is known to have few rows, else Spark shuffles and splits what is skewed."""
    return left.join(F.broadcast(right) if rows is not None and rows <= BROADCAST_ROWS else right, on, how)


def numbered(docs: DataFrame, key: str, text: str, place: str) -> DataFrame:
    """docs with __doc, a number in order of key: the key itself as long as no key comes with several texts, else numbers given to (key, text), which rows that repeat share; null for null keys."""
    own = F.col(key).cast("long")
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    if docs.where(own.isNotNull()).groupBy(own.alias("__k")).count().where("count > 1").isEmpty():
        return docs.withColumn("__doc", own)
    texts = docs.select(own.alias("__k"), F.xxhash64(whole).alias("__t"), F.xxhash64(F.lit(1), whole).alias("__u")).where("__k IS NOT NULL")
    several = texts.groupBy("__k").agg((F.max(F.struct("__t", "__u")) != F.min(F.struct("__t", "__u"))).alias("several"))
    if several.where("several").isEmpty():
        return docs.withColumn("__doc", own)
    numbers = written(texts.distinct().orderBy("__k", "__t", "__u").select("*", F.monotonically_increasing_id().alias("__doc")), place)
    return docs.withColumns({"__k": own, "__t": F.xxhash64(whole), "__u": F.xxhash64(F.lit(1), whole)}).join(numbers, ["__k", "__t", "__u"], "left").drop("__k", "__t", "__u")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
