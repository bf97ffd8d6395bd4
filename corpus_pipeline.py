"""A training corpus from ``documents``: filtered, deduplicated, mixed and packed.

Part of the subpackage ``storyatlas.llm``.  Each stage reads what its
predecessor kept; all but the last return whole documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storyatlas.llm.dedup import drop_exact_duplicates
from storyatlas.llm.jaccard import drop_near_duplicates
from storyatlas.llm.mixing import mixed_documents
from storyatlas.llm.packing import pack_best_fit
from storyatlas.llm.quality import keep_quality
from storyatlas.llm.queries import vocabulary
from storyatlas.llm.scratch import store

#: Text that a worker encodes at once; less than by default, as executors have held all other stages before.
SLICE_BYTES = 1 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_exact_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicate links."""
    return drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    return mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences."""
    return pack_best_fit(docs, vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096, slice_bytes=SLICE_BYTES)


STAGES = [("quality", quality), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: The classifier and the tokenizer are beyond SQL; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
