"""From raw documents to token ids: each stage applies one operator to all that its predecessor kept.

In every stage null and empty texts are texts like any other, texts of any length are handled whole, ties go by the ids named
below, an empty table gives an empty one, and columns besides those of documents pass through unless a name is
reserved (``__exact_``, ``__near_``, ``__mix_``).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from grantstar.llm.bloom_dedup import drop_exact_copies
from grantstar.llm.common import read_table, stored
from grantstar.llm.curriculum import mix_documents
from grantstar.llm.sentencepiece_codec import codec_digests
from grantstar.llm.simhash_index import drop_near_copies
from grantstar.llm.toxic_crf import drop_toxic
from grantstar.session import tune

PIECES = public_tokenizers.path("piece_bpe_32k.model")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the field, trained on the labels, scores as toxic go. Null and empty texts score as texts without
    a toxic word; repeated rows go or stay together; without labels the score is the same for all."""
    tune(spark)
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal texts the document with the largest doc_id stays, null being the smallest; of rows that
    agree in id and text one stays. Null and empty texts are equal."""
    tune(spark)
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays; of rows that share it, the one with the smallest
    text hash. Texts without words are copies of each other."""
    tune(spark)
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as its source's schedule takes it, at most three times, in training order. A null source is a
    source; documents without words are taken with their source."""
    tune(spark)
    return mix_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each document, with digests of ids, decoded text and byte spans. A null text counts as empty; repeated
    rows each get a row."""
    tune(spark)
    return codec_digests(docs, PIECES, with_ids=True)


STAGES = [
    ("toxicity", toxicity),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", encoding),
]

#: SQL cannot express the first, third and last stage; the chain is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    docs = read_table(tune(spark), sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage{at}")
    return docs
