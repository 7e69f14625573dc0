"""A corpus pipeline of five stages over documents; each stage's rows are written as Parquet and read by the next.

toxicity drops documents that score 0.7 or more; simhash_dedup keeps the document of smallest doc_id of each group of near
copies (five-word shingles at a similarity of 0.8 or more, counted exactly); suffix_dedup cuts passages of 100 bytes
and more that occur earlier; mixing repeats documents so that sources meet their targets; sentencepiece encodes what is
left. Every stage but the last returns the columns of documents.

All stages hold for any rows: a null text counts as an empty one and stays null; a null doc_id is no near copy, repeats
nothing and stays; rows of one doc_id stay or go together in simhash_dedup, and are rows each elsewhere; a null source is a
source of its own; other columns, of whatever names, go along as they are; texts of any length are read whole; an empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import mixing, sentencepiece_codec, simhash, suffix_dedup, toxicity
from pairloom.llm.common import materialize, table
from pairloom.llm.queries import MODEL

#: Bytes of an Arrow batch. All stages run in one session, so each finds what those before left in the executors' memory.
ARROW = 1 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts are scored as empty. Labels of ids that docs lack teach nothing; without labels none is toxic."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels", ARROW))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without words, null ones too, are copies of each other. Of equal rows of the smallest doc_id all stay."""
    return simhash.keep_first(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay, whatever is cut; n_chars follows. Texts under 100 bytes and null ones are as they were."""
    return suffix_dedup.remove_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row is returned as often as the mix takes it, at times not at all; texts without words are taken like others."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row a document, its tokens' digest; a null text has no tokens."""
    return sentencepiece_codec.token_digests(docs, MODEL)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_dedup", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: The models, fingerprints and pieces are beyond SQL. Tests compare the operators of all stages but the first with brute-force
#: versions or the library that they stand for, the first with held-out labels, and each stage with its operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage: doc_id (once per copy that the mix takes) and its tokens' digest."""
    docs = table(spark, sf_dir, "documents", ARROW)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs)
    return docs
