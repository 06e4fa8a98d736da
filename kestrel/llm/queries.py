"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm import ann, bitslice, bpe, hardneg, langid, minhash, mixing, phrases, quality, tokencount, toxicity, urls, warc
from kestrel.llm.common import table
from kestrel.session import scratch_dir, ship_package

BPE_FILE = public_tokenizers.path("byte_bpe_50k.json")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return bpe.encode_digests(table(spark, sf_dir, "documents"), BPE_FILE)


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, langid.fit_documents(docs), ["doc_id"])
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("lost_chars")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.fit_documents(docs, table(spark, sf_dir, "labels"), seeds=None)
    out = toxicity.score(docs, chain, ["doc_id"])
    return out.withColumn("toxic", F.col("p_toxic") >= toxicity.THRESHOLD)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    folder = scratch_dir(spark, "warc")
    warc.write_archive(warc.plan_records(table(spark, sf_dir, "pages")), folder)
    return warc.digest_records(warc.read_archive(spark, folder))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.labelled_urls(pages, table(spark, sf_dir, "labels")))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op7_token_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", tokencount.derived_edits())
    return tokencount.count_edits(docs, BPE_FILE)


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return bitslice.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hardneg.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, moved)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return phrases.mine(table(spark, sf_dir, "documents"))


QUERIES = {
    "op13_phrases": op13_phrases,
    "op11_topk": op11_topk,
    "op12_hard_negatives": op12_hard_negatives,
    "op7_token_edits": op7_token_edits,
    "op2_ann": op2_ann,
    "op6_urls": op6_urls,
    "op4_warc": op4_warc,
    "op1_toxicity": op1_toxicity,
    "op8_near_dedup": op8_near_dedup,
    "op5_quality": op5_quality,
    "op9_mix": op9_mix,
    "op3_langid": op3_langid,
    "op10_bpe": op10_bpe,
}

ORACLE = {
    "op11_topk": bitslice.TOP_SQL,
    "op12_hard_negatives": hardneg.NEGATIVE_SQL,
    "op13_phrases": phrases.PHRASE_SQL,
    "op4_warc": warc.WARC_SQL,
    "op5_quality": quality.QUALITY_SQL,
    "op8_near_dedup": minhash.NEAR_SQL,
    "op9_mix": mixing.MIX_SQL,
}
