"""A training corpus from raw documents, stage by stage.

Every stage takes (spark, docs, sf_dir), works on all documents its predecessor
kept, and is written as Parquet before the next one reads it. All stages but
the last return the columns of ``documents``. An empty table passes through
every stage; what a stage does with nulls and ties is stated at its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import bpe, langid, minhash, mixing, toxicity
from kestrel.llm.common import free_name, staged, table
from kestrel.llm.queries import BPE_FILE
from kestrel.session import ship_package

# A document whose language is less sure than this is rejected.
MIN_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject texts without a letter and texts of no clear language."""
    ship_package(spark)
    pred, sure = free_name(docs, "_language"), free_name(docs, "_sure")
    seen = langid.identify(docs, langid.fit_documents(docs), docs.columns, pred_col=pred, score_col=sure)
    kept = (F.col(pred) != langid.UNKNOWN) & (F.col(sure) >= MIN_LANGUAGE_SCORE)
    return seen.filter(kept).select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject toxic texts."""
    ship_package(spark)
    chain = toxicity.fit_documents(docs, table(spark, sf_dir, "labels"))
    prefix = "_p_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    scored = toxicity.score(docs, chain, docs.columns, prefix=prefix)
    return scored.filter(F.col(prefix + "toxic") < toxicity.THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    ship_package(spark)
    return minhash.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and sample documents to the sources' target weights."""
    return mixing.repeat(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every document of the mix, and decode it again."""
    ship_package(spark)
    return bpe.encode_digests(docs, BPE_FILE)


STAGES = [("language", language), ("toxicity", toxic), ("near_duplicates", near_duplicates), ("mix", mix),
          ("tokens", tokens)]

# Trained models and token merges cannot be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
