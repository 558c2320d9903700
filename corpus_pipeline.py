"""From raw documents to shards: quality, near-duplicates, benchmark passages, mixture, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again for the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import joined, shared_dir, table, written
from gridloom.llm.decontamination import contained_items
from gridloom.llm.minhash import near_duplicates
from gridloom.llm.mixing import mix
from gridloom.llm.quality import fit, keep_good
from gridloom.llm.sharding import proportional_shards

SHARDS = 40


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but those with a doc_id in ids, a written table."""
    return joined(docs, ids, ["doc_id"], ids.count(), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on these documents and their labels, keeps; junk and toxic ones go. Null and empty texts are junk."""
    return keep_good(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: the one with the smallest doc_id. Rows with a null doc_id stay, as do rows that repeat a kept one's doc_id. Rows go by doc_id: where one comes with two texts and either is a copy of a smaller doc_id's, both go, also a text that no other row has."""
    found = near_duplicates(docs, k=5, percent=80)
    return _without(docs, written(found.where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct(), shared_dir(spark)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 80 % of the five-word shingles of every benchmark item."""
    found = contained_items(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, written(found.where("doc_id IS NOT NULL").select("doc_id").distinct(), shared_dir(spark)))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them: none to three times."""
    return mix(docs, arrange=False).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in shards 0 to 39 of the same mixture, with their slots."""
    return proportional_shards(docs, SHARDS)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: Training a classifier, near-duplicate groups and seeded draws are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, docs = shared_dir(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"{base}/{name}")
    return docs.withColumn("slot", F.col("slot").cast("long"))
