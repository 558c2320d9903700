"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents are permuted by a seeded hash and cut into blocks by equal hash ranges. A source whose target is above its size gives whole passes over its blocks first; what then remains of the target is drawn as the leading blocks of one more pass; of the last of them, documents are taken in permuted order as long as they fit, so that what is missing is less than any document left out of it. The draws of all sources are divided among output shards by a binary tree: at each node, how many draws of each source go left follows the multivariate hypergeometric law, as if all draws had been shuffled and cut in the middle, so that the quotas of the shards add up exactly. A shard's quota is a run of consecutive draws of the permuted blocks, so no two shards share one.

The driver holds one row per source (its size, target and quotas); documents are only counted, filtered and repeated by column expressions.
"""

from __future__ import annotations

import random
from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, bucket, delete, group_key, joined, shared_dir, spread, table, written

#: Weights of sources in code-point order, repeating; no source is taken more than MOST times.
WEIGHTS, MOST = (5, 2, 1), 3
#: Documents that a block holds on average, output shards.
BLOCK_ROWS, SHARDS, SEED = 512, 16, 9
#: Rows of the table for each piece that an arranged shard is shuffled in.
PIECE_ROWS = 50_000


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: list[tuple[str | None, int]], weights=WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Each source's share of all sizes by weight; what is above most times its size is shared among the others by weight, until none is above."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {name: weights[i % len(weights)] for i, (name, _) in enumerate(ordered)}
    size = dict(ordered)
    left, open_, out = float(sum(size.values())), list(size), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = [s for s in open_ if left * weight[s] / total > most * size[s]]
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        out |= {s: float(most * size[s]) for s in full}
        left -= sum(most * size[s] for s in full)
        open_ = [s for s in open_ if s not in out]
    return out


def hypergeometric(rng: random.Random, good: int, bad: int, drawn: int) -> int:
    """How many of drawn items are good, by inversion over the values within twelve deviations and 50 of the mode; what lies beyond has a chance under 1e-16."""
    low, high, n = max(0, drawn - bad), min(good, drawn), good + bad
    if low >= high:
        return low
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (n + 2)))
    reach = 50 + int(12 * (drawn * (good / n) * (bad / n) * ((n - drawn) / max(1, n - 1))) ** 0.5)
    k = np.arange(max(low, mode - reach), min(high, mode + reach) + 1, dtype=float)
    # logarithms of the ratios of neighbouring chances add up to those of the chances
    steps = np.log(good - k[:-1]) + np.log(drawn - k[:-1]) - np.log(k[1:]) - np.log(bad - drawn + k[1:])
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    chances = np.cumsum(np.exp(logs - logs.max()))
    return int(k[np.searchsorted(chances, rng.random() * chances[-1], "right")])


def quotas(draws: dict[str | None, int], shards: int, seed: int) -> dict[str | None, list[int]]:
    """For each source the draws that each shard gets; shards hold equally many draws, give or take one."""
    order = sorted(draws, key=lambda s: (s is None, s or ""))
    out: dict[str | None, list[int]] = {s: [0] * shards for s in order}

    def split(first: int, last: int, have: dict[str | None, int]) -> None:
        if last - first == 1:
            for s, n in have.items():
                out[s][first] = n
            return
        middle, total = (first + last) // 2, sum(have.values())
        room = total * (middle - first) // (last - first)
        rng, rest, left = random.Random(f"{seed}/{first}/{last}"), total, {}
        for s in order:
            left[s] = hypergeometric(rng, have[s], rest - have[s], room - sum(left.values()))
            rest -= have[s]
        split(first, middle, left)
        split(middle, last, {s: have[s] - left[s] for s in order})

    split(0, shards, draws)
    return out


def plan(sized: DataFrame, weights=WEIGHTS, most: float = MOST, block_rows: int = BLOCK_ROWS, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, int]:
    """One row per source (__s): __size, __target, __nb blocks, __full passes, and of one more pass the blocks before __cut, and in block __cut those with __q in __picked; __ends: where each shard's draws end. sized has source, size, __s, __q. The second value is the number of sources."""
    spark = sized.sparkSession
    found = sized.groupBy("__s", "source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    size, target = {r["source"]: r["size"] for r in found}, targets([(r["source"], r["size"]) for r in found], weights, most)
    schema = "__s string, __size long, __target double, __nb long, __full long, __rest double"
    rows = [(r["__s"], r["size"], target[r["source"]], -(-r["n"] // block_rows), full := int(target[r["source"]] // r["size"]) if r["size"] else 0, target[r["source"]] - full * r["size"]) for r in found]
    sources = _local(spark, rows, schema)
    placed = joined(sized, sources, ["__s"], len(rows)).withColumn("__b", bucket(F.col("__q"), F.col("__nb")))
    blocks = placed.groupBy("__s", "__b").agg(F.sum("size").alias("__w"), F.first("__rest").alias("__rest"))
    blocks = blocks.withColumn("__ahead", F.sum("__w").over(Window.partitionBy("__s").orderBy("__b")) - F.col("__w"))
    cut = blocks.where("__ahead < __rest AND __ahead + __w >= __rest").groupBy("__s").agg(F.min_by("__b", "__ahead").alias("__cut"), F.min("__ahead").alias("__ahead"))
    inside = joined(placed, cut, ["__s"], len(rows)).where("__b = __cut").groupBy("__s", "__cut", "__q").agg(F.sum("size").alias("w"), F.first(F.col("__rest") - F.col("__ahead")).alias("room"))
    block = inside.groupBy("__s", "__cut").agg(F.first("room").alias("room"), F.array_sort(F.collect_list(F.struct(F.col("__q").alias("q"), "w"))).alias("x"))
    start = F.struct(F.col("room").alias("room"), F.array().cast("array<long>").alias("q"))
    fits = lambda a, r: F.when(r["w"] <= a["room"], F.struct((a["room"] - r["w"]).alias("room"), F.concat(a["q"], F.array(r["q"])).alias("q"))).otherwise(a)
    picked = written(block.select("__s", "__cut", F.aggregate("x", start, fits)["q"].alias("__picked")), shared_dir(spark))
    cuts = {r["__s"]: (r["__cut"], r["n"]) for r in picked.select("__s", "__cut", F.size("__picked").alias("n")).collect()}
    draws = {r[0]: r[4] * r[3] + (cuts[r[0]][0] + (cuts[r[0]][1] > 0) if r[0] in cuts else 0) for r in rows}
    quota = quotas(draws, shards, seed)
    full = _local(spark, [(*r[:5], list(accumulate(quota[r[0]]))) for r in rows], "__s string, __size long, __target double, __nb long, __full long, __ends array<long>")
    return joined(full, picked, ["__s"], len(rows), "left"), len(rows)


def _local(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table inside the plan."""
    import json

    names = [x.split()[0] for x in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in schema.split(', '))}>>")))


def drawn(sized: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """sized with __size, __target and __draws: the numbers of the draws of its source that hold the row."""
    d = joined(sized, sources, ["__s"], n_sources).withColumn("__b", bucket(F.col("__q"), F.col("__nb")))
    again = (F.col("__b") < F.col("__cut")) | ((F.col("__b") == F.col("__cut")) & F.array_contains("__picked", F.col("__q")))
    passes = F.col("__full") + F.coalesce(again, F.lit(False)).cast("long")
    return d.withColumn("__draws", F.when(passes > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(passes - 1, F.lit(0).cast("long"))), lambda e: e * F.col("__nb") + F.col("__b"))).otherwise(F.array().cast("array<long>")))


def shard_of(draw: Column) -> Column:
    """The shard whose quota holds a draw."""
    return F.size(F.filter("__ends", lambda end: end <= draw))


def sized_rows(docs: DataFrame, text: str, source: str, key: str, seed: int) -> DataFrame:
    return docs.select(F.col(key), F.col(source).alias("source"), group_key(source).alias("__s"), words(text).alias("size"), spread(seed, F.col(key), F.xxhash64(text)).alias("__q"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights=WEIGHTS, most: float = MOST, shards: int = SHARDS, seed: int = SEED, block_rows: int = BLOCK_ROWS, arrange: bool = True) -> DataFrame:
    """docs as often as the mix takes them, with mix_shard; arrange also brings each shard together, locally shuffled.

    Sources without words get no rows. Null texts have no words and follow their source's passes; a null source is a source, last in order. Rows that are equal in key and text are taken together. An empty table gives an empty one.
    """
    docs = docs.drop("mix_shard")
    sized = written(sized_rows(docs, text, source, key, seed), shared_dir(docs.sparkSession))
    sources, n = plan(sized, weights, most, block_rows, shards, seed)
    return laid(docs, sources, n, sized.count() if arrange else None, text, source, key, shards, seed)


def laid(docs: DataFrame, sources: DataFrame, n_sources: int, rows: int | None, text: str = "text", source: str = "source", key: str = "doc_id", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The rows of docs that a plan draws, with mix_shard; each shard brought together and shuffled in pieces, by the number of rows of docs, unless that is None."""
    d = docs.withColumns({"__s": group_key(source), "__q": spread(seed, F.col(key), F.xxhash64(text))})
    d = drawn(d, sources, n_sources).withColumn("__draw", F.explode("__draws")).withColumn("mix_shard", shard_of(F.col("__draw")))
    if rows is not None:
        pieces = -(-rows // (shards * PIECE_ROWS)) + 1
        d = d.repartition(shards * pieces, "mix_shard", F.pmod("__q", F.lit(pieces))).sortWithinPartitions("mix_shard", F.xxhash64(F.lit(seed + 1), "__q", "__draw"))
    return d.select(*docs.columns, "mix_shard")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document, counted in the shards that it writes, and the first and last of them."""
    docs, base = table(spark, sf_dir, "documents").drop("mix_shard"), shared_dir(spark)
    sized = written(sized_rows(docs, "text", "source", "doc_id", SEED), f"{base}/sized")
    sources, n = plan(sized)
    mixed = written(laid(docs, sources, n, sized.count()), f"{base}/mixed")
    # rows that are equal in key and text are taken together, so each has its share of what is found
    there = sized.select("doc_id", "__q", F.lit(1).alias("one"), F.lit(None).cast("int").alias("mix_shard"))
    found = mixed.select("doc_id", spread(SEED, F.col("doc_id"), F.xxhash64("text")).alias("__q"), F.lit(0).alias("one"), "mix_shard")
    counts = there.union(found).groupBy(F.col("doc_id").alias("__k"), F.col("__q").alias("__r"))
    counts = written(counts.agg(F.sum("one").alias("__n"), F.count("mix_shard").alias("__c"), F.min("mix_shard").alias("first_shard"), F.max("mix_shard").alias("last_shard")), f"{base}/counts")
    delete(spark, f"{base}/mixed")
    d = joined(sized, sources, ["__s"], n).join(counts, (F.col("__q") == F.col("__r")) & F.col("doc_id").eqNullSafe(F.col("__k")))
    return d.select("doc_id", "size", F.col("__size").alias("source_size"), F.col("__target").alias("target"), F.expr("size * (__c div __n)").alias("taken"), "first_shard", "last_shard")
