"""Sharding by proportional stratified interleaving.

Rows of each stratum are shuffled by a seeded hash and ranked; a row's place in the whole is its fractional rank within its stratum, so that every stretch of the order, and every shard cut from it, has the mixture of the whole. Ranks and places come from counts of small hash ranges and a row number within one range, so no task holds a stratum, however large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bucket, group_key, joined, spread, table


def proportional_shards(docs: DataFrame, shards: int, stratum: str = "source", key: str = "doc_id", seed: int = 20, bucket_rows: int = 4096) -> DataFrame:
    """docs with shard (0 to shards-1) and slot (gapless from 0 within its shard).

    Shards differ by one row at most, and in each, a stratum of n rows has n / shards rows, give or take two. The order depends on key, the other columns and seed only.
    Null strata are a stratum of their own; null keys and repeated rows get places like others; an empty table gives an empty one. Columns of docs named shard or slot are replaced.
    """
    docs = docs.drop("shard", "slot")
    names = docs.columns
    d = docs.withColumns({"__s": group_key(stratum), "__t": F.xxhash64(*names)}).withColumn("__q", spread(seed, F.col(key), F.col("__t")))
    strata = docs.groupBy(group_key(stratum).alias("__s")).agg(F.count("*").alias("__n"))
    # of strata only their number and the number of ranges are needed here
    total, ranges, n_strata = strata.agg(F.sum("__n"), F.sum(F.ceil(F.col("__n") / bucket_rows)), F.count("*")).first()
    if not total:
        return docs.withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")}).where(F.lit(False))
    d = joined(d, strata.withColumn("__nb", F.ceil(F.col("__n") / bucket_rows)), ["__s"], n_strata).withColumn("__b", bucket(F.col("__q"), F.col("__nb")))
    # the branches that only count read no text: column pruning drops what they don't use
    counts = d.groupBy("__s", "__b").agg(F.count("*").alias("__c"))
    before = counts.select("__s", "__b", (F.sum("__c").over(Window.partitionBy("__s").orderBy("__b")) - F.col("__c")).alias("__before"))
    d = joined(d, before, ["__s", "__b"], ranges)
    within = Window.partitionBy("__s", "__b").orderBy("__q", key, "__t")
    # a phase of its own keeps strata of one row from all falling on the same place
    phase = spread(seed + 1, F.col("__s")).cast("double") * F.lit(2.0**-53)
    d = d.withColumn("__f", (F.col("__before") + F.row_number().over(within) - 1 + phase) / F.col("__n"))
    stretches = -(-total // bucket_rows)
    d = d.withColumn("__g", F.least(F.lit(stretches - 1), F.floor(F.col("__f") * stretches)).cast("long"))
    stretch = d.groupBy("__g").agg(F.count("*").alias("__c"))
    ahead = stretch.select("__g", (F.sum("__c").over(Window.orderBy("__g")) - F.col("__c")).alias("__ahead"))
    d = joined(d, ahead, ["__g"], stretches)
    place = F.col("__ahead") + F.row_number().over(Window.partitionBy("__g").orderBy("__f", "__s", "__q", "__t")) - 1
    d = d.withColumn("__at", place.cast("long")).withColumn("shard", F.expr(f"CAST((__at * {shards}L) DIV {total}L AS INT)"))
    return d.withColumn("slot", F.expr(f"__at - (shard * {total}L + {shards - 1}L) DIV {shards}L")).select(*names, "shard", "slot")


def op6(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 39 under the law `rows`."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return proportional_shards(docs, 40).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
