"""A corpus pipeline of the training-data operators: score, filter, deduplicate, mix, pack.

Every stage but the last returns the columns that it got, whatever other columns there are and however they are named. A
null text is an empty one: it isn't toxic, has no language and so goes in the second stage. Rows without a doc_id, and rows
that share one, are documents of their own; a null source is a source. Empty tables come out empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from undula.llm import language_id, minhash, mixing, packing, toxicity
from undula.llm.common import fresh_name, read_table, written

#: A text whose language the network is less sure of than this is rejected.
LEAST_SURE = 0.35
#: Whole texts that Spark hands to a Python worker at once: a batch stands several times over in the executor's memory.
BATCH = 500


def _small_batches(spark: SparkSession) -> None:
    """From now on the session hands Python workers BATCH rows at once, or fewer, where it is set so."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic. It learns from the labels that the contract sets free; without labels
    of both kinds it calls nothing toxic."""
    _small_batches(spark)
    model = toxicity.train_on_fold(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    flag = fresh_name(docs, "tox_predicted")
    return toxicity.score_documents(docs, model).where(F.col(flag) == 0).select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: not `und`, and not below LEAST_SURE; none, where no document says its language."""
    _small_batches(spark)
    model = language_id.train_on_fold(read_table(spark, sf_dir, "documents"))
    lang, score = fresh_name(docs, "lang_pred"), fresh_name(docs, "lang_score")
    known = (F.col(lang) != language_id.UNKNOWN) & (F.col(score) >= LEAST_SURE)
    return language_id.identify(docs, model).where(known).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies: the one with the smallest doc_id, of those without any."""
    _small_batches(spark)
    return minhash.keep_one(docs, minhash.near_duplicates(docs)).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of the documents by which their sources come to their target shares, in a global shuffle. Rows that share a doc_id
    and source, also those without a doc_id, have equally many copies."""
    return mixing.mix_sources(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of 2048 tokens: one row a piece, with the doc_id of its document."""
    _small_batches(spark)
    # The workers hold what earlier stages left in them, so fewer words are remembered than by the operator alone.
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), cached=100_000, keep=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: Trained classifiers and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
