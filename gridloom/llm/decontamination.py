"""Benchmark decontamination by size-partitioned MinHash containment search.

The sketch of an item of n shingles is its bottom-k MinHash, the k shingles with the least hash values, with k = floor((1 - t) n) + 1: a document that holds a share t of them lacks floor((1 - t) n) at most, so that it holds one of the sketch, however long it is. Items are partitioned by size. A partition has the largest hash that any of its sketches holds and the least number of shingles a document needs for any of its items; a document's sketch for the partition is made of its shingles up to that hash, and documents that are too short for it make none. Sketches meet in a join; what they hit are candidates, which are then confirmed on the exact shingles of both sides, as strings. All of it is column expressions, joins and groupings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, delete, joined, shared_dir, table, written



def worded(df: DataFrame, text: str = "text") -> DataFrame:
    """df with w, the lower-cased words of a text. A column of its own: written inside a lambda, the split would run again for each word."""
    return df.withColumn("w", F.regexp_extract_all(F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(WORD), F.lit(0)))


def shingles(k: int) -> Column:
    """The k-word shingles of w as strings; one of all words where there are fewer; none without words."""
    n = F.greatest(F.size("w") - k + 1, F.least(F.size("w"), F.lit(1)))
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice("w", i, k), " ")))


def hashed(df: DataFrame, k: int) -> DataFrame:
    """df (with w) with hashes, those of the k-word shingles of w in order; each word is hashed once."""
    n = F.greatest(F.size("words") - k + 1, F.least(F.size("words"), F.lit(1)))
    made = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice("words", i, k)))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("words", F.transform("w", lambda x: F.xxhash64(x))).withColumn("hashes", made)


def sketched(items: DataFrame, percent: int) -> DataFrame:
    """items (item, shingle, h, n: how many it has) with in_sketch and part, the partition: sizes double from one to the next."""
    k = F.expr(f"({100 - percent} * n) DIV 100 + 1")
    rank = F.expr("row_number() OVER (PARTITION BY item ORDER BY h, shingle)")
    return items.withColumns({"in_sketch": rank <= k, "part": F.ceil(F.log2("n")).cast("int")})


def contained_items(docs: DataFrame, benchmark: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item, n_item, n_shared): documents that hold percent % or more of an item's distinct k-word shingles.

    Items of fewer than k words are one shingle of all their words, which only documents of just these words have; items without words are in no document. Rows with equal keys count as one document, and so do items. Null keys are a key. Empty tables give an empty one. Other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    base = shared_dir(spark)
    listed = hashed(worded(benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text"))), k).select("item", F.inline(F.arrays_zip(shingles(k).alias("shingle"), F.col("hashes").alias("h")))).distinct()
    items = written(sketched(listed.withColumn("n", F.expr("count(*) OVER (PARTITION BY item)")), percent), f"{base}/items")
    n_rows = items.count()
    d = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    # 1: which documents hit which sketches; partitions are as few as doublings of a size
    parts = items.where("in_sketch").groupBy("part").agg(F.max("h").alias("most"), F.min(F.expr(f"({percent} * n + 99) DIV 100")).alias("least")).collect()
    sketch = items.where("in_sketch").select("h", "item", "part")
    enough = lambda h: reduce(lambda x, y: x | y, [(h <= p["most"]) & (F.size("hashes") >= p["least"]) for p in parts], F.lit(False))
    probes = hashed(worded(d), k).select("key", F.explode(F.array_distinct(F.filter("hashes", enough))).alias("h"))
    hits = written(joined(probes, sketch, ["h"], n_rows).select("key", "item").distinct(), f"{base}/hits")
    # 2: candidates by all shingles, as strings
    name = F.coalesce(F.col("key").cast("string"), F.lit("null"))
    near = hits.select(name.alias("name")).distinct()
    texts = joined(d.withColumn("name", name), near, ["name"], near.count(), "left_semi")
    held = worded(texts).select("key", F.explode(shingles(k)).alias("shingle"))
    found = joined(held, items.select("shingle", "item", "n"), ["shingle"], n_rows).select("key", "item", "n", "shingle").distinct()
    counted = found.groupBy("key", "item", "n").agg(F.count("*").alias("shared")).where(100 * F.col("shared") >= percent * F.col("n"))
    both = counted.join(hits.select(F.col("key").alias("k2"), F.col("item").alias("i2")), F.col("key").eqNullSafe(F.col("k2")) & F.col("item").eqNullSafe(F.col("i2")), "left_semi")
    out = written(both.select(F.col("key").alias(key), F.col("item").alias(item), F.col("n").alias("n_item"), F.col("shared").alias("n_shared")), f"{base}/found")
    delete(spark, f"{base}/items", f"{base}/hits")
    return out


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a benchmark item, with the item."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH words AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark),
sh AS (SELECT DISTINCT kind, id, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM words WHERE len(w) > 0),
items AS (SELECT id, s, count(*) OVER (PARTITION BY id) AS n FROM sh WHERE kind = 'i')
SELECT d.id AS doc_id, i.id AS item_id, i.n AS n_item, count(*) AS n_shared
FROM sh AS d JOIN items AS i ON d.s = i.s WHERE d.kind = 'd' GROUP BY d.id, i.id, i.n HAVING 100 * count(*) >= 80 * i.n
"""
