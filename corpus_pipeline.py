"""A training corpus from ``documents`` in five stages; each takes (spark, docs, sf_dir) and returns what it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.decontaminate import drop_contaminated
from lodestone.llm.minhash import drop_near_duplicates
from lodestone.llm.mixing import mixed_rows
from lodestone.llm.ngram_quality import keep_quality
from lodestone.llm.sharding import shard
from lodestone.llm.shared import new_path, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WEIGHTS, SHARE, MOST, SHARDS = (3, 1, 2), 1.5, 2.0, 16


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity, and that of their worst word, are within the limits of their language; the model is trained on labelled trusted ones."""
    return keep_quality(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near-duplicates, once; rows without a doc_id stay."""
    return drop_near_duplicates(docs, percent=80, size=5, bands=32, rows=4).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item within a fifth of its words."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them, none more than twice; a document then has that many rows."""
    return mixed_rows(docs.select(*COLUMNS), WEIGHTS, SHARE, MOST)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each row, every shard in the mixture of the whole."""
    return shard(docs, SHARDS)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The first stage scores with a trained model, which SQL doesn't express; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            path = new_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
