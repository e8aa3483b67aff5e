"""A corpus in five stages: language, exact copies, near copies, source mix, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet in the shared checkpoint folder and read again as the next stage's
``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexfold.llm import bpe, grace_dedup, language_id, mixing, simhash_tiles
from lexfold.llm.common import bucket_of, ensure_checkpoint_dir, table
from lexfold.llm.queries import tokenizer_file

#: A document whose language is less certain than this goes.
LEAST_SCORE = 0.5
#: Near copies: words to a shingle, and the share of shingles that two texts have in common at least.
SHINGLE_WORDS, SIMILARITY = 5, 0.8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier, learned from the labelled ones, is sure of."""
    held = F.coalesce(bucket_of("doc_id", 4) == 2, F.lit(False))
    return language_id.keep_identified(docs, language_id.train(docs.where(~held)), LEAST_SCORE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal normalised text, the one with the smallest id."""
    return grace_dedup.dedup_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by similarity, the one with the smallest id."""
    return simhash_tiles.keep_first(docs, words=SHINGLE_WORDS, similarity=SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, shard by shard, each shard shuffled."""
    return mixing.mixed_rows(docs).select(docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document taken, with digests of the ids and of the text decoded from them."""
    return bpe.round_trip(docs, tokenizer_file())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_neardup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("bpe", tokenize),
]

#: No stage but the second can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the last stage's Parquet is left behind; an earlier one is deleted as soon as the next stage is written."""
    ensure_checkpoint_dir(spark)
    folder = os.path.join(spark.sparkContext._jsc.sc().getCheckpointDir().get(), f"pipeline-{uuid.uuid4().hex}")
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = os.path.join(folder, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            path_of(before).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path_of(before), True)
        before = path
    return docs
