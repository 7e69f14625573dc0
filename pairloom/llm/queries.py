"""The registered queries of the numbered operators."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import chat, collocations, context_mixing, fim, html_crf, mixing, multiset_hash, nn_descent, resharding, sentencepiece_codec, simhash, suffix_dedup, toxicity
from pairloom.llm.common import table

#: The vocabulary file of op10.
MODEL = os.environ.get("PAIRLOOM_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def op1_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_descent.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.lm_scores(table(spark, sf_dir, "documents"))


def op5_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op8_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiset_hash.fingerprint_edits(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_digests(table(spark, sf_dir, "conversations"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.token_digests(table(spark, sf_dir, "documents"), MODEL)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_digests(table(spark, sf_dir, "documents"))


def op13_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resharding.reshard(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_nn_descent, op2_simhash, op3_toxicity, op4_context_mixing, op5_html_crf, op6_mixing, op7_suffix_dedup, op8_multiset_hash, op9_chat, op10_sentencepiece, op11_collocations, op12_fim, op13_resharding)}
ORACLE: dict[str, str] = {"op6_mixing": mixing.ORACLE, "op9_chat": chat.ORACLE, "op11_collocations": collocations.ORACLE, "op12_fim": fim.ORACLE}
