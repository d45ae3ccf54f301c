"""A training corpus from raw documents: five stages, each written as Parquet and read again by the next.

Defined results: null and empty texts, and texts without letters, have no language and go with the
second stage; rows equal in id and text are one after the third; a null id or source is kept as such;
columns of any other name pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.llm import langid, mixing, neardup, packing, toxicity
from tabloom.llm._common import free_name, shared_dir
from tabloom.llm.queries import BPE, TOXIC_FROM, not_fold

LANGUAGE_FROM = 0.5
#: Cuts that a worker remembers while it packs: it shares an executor with workers of the stages before.
REMEMBERED = 500_000
#: SQL cannot express the learned stages; tests hold the stages against brute force instead.
ORACLE_SQL = None


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that are not predicted to be toxic; labels teach, and never decide."""
    index = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), not_fold(4, 2))
    name = free_name(docs, "toxic_score")
    return toxicity.scored_documents(docs, index, name).where(F.col(name) < TOXIC_FROM).drop(name)


def language_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose language is known with some certainty."""
    model = langid.fit(docs, not_fold(4, 2))
    pred, sure = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    return langid.identified_documents(docs, model, pred, sure).where((F.col(pred) != "und") & (F.col(sure) >= LANGUAGE_FROM)).drop(pred, sure)


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return neardup.one_of_each(docs, width=5, similarity=0.8)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the ratio 1, 2, 3, repeating, none over three times its size."""
    return mixing.mixed_documents(docs, weights=(1, 2, 3), most=3)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(packing.token_pieces(docs, BPE, capacity=2048, remembered=REMEMBERED), capacity=2048)


STAGES = [
    ("toxicity", toxicity_filter),
    ("language_id", language_filter),
    ("near_duplicates", near_duplicate_filter),
    ("mixing", source_mixture),
    ("packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
