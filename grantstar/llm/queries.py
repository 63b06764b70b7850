"""The registered queries of the package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from grantstar.llm.backoff_lm import scored
from grantstar.llm.bloom_dedup import exact_copies
from grantstar.llm.chunk_dedup import repeated_spans
from grantstar.llm.common import read_table
from grantstar.llm.curriculum import mixed
from grantstar.llm.line_quality import STRICT, line_quality
from grantstar.llm.merkle_proofs import verified_manifest
from grantstar.llm.periodic_runs import periodic_runs, run_digests, with_planted_runs
from grantstar.llm.rule_ensemble import scored_quality
from grantstar.llm.secret_scan import secret_spans, span_digests
from grantstar.llm.sentencepiece_codec import codec_digests
from grantstar.llm.simhash_index import near_copies
from grantstar.llm.token_lengths import context_limits, length_histogram
from grantstar.llm.toxic_crf import scored_documents
from grantstar.session import tune

PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _over_documents(name: str):
    def named(build: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        QUERIES[name] = lambda spark, folder: build(read_table(tune(spark), folder, "documents"))
        return build

    return named


@_over_documents("op1_line_frequency")
def _op1(docs: DataFrame) -> DataFrame:
    return line_quality(docs)


@_over_documents("strict_line_frequency")
def _op1_strict(docs: DataFrame) -> DataFrame:
    return line_quality(docs, STRICT)


@_over_documents("op2_chunk_dedup")
def _op2(docs: DataFrame) -> DataFrame:
    found = repeated_spans(docs)
    texts = F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"]))
    return found.drop("cuts").withColumn("spans", F.array_join(texts, ","))


@_over_documents("op3_sentencepiece")
def _op3(docs: DataFrame) -> DataFrame:
    return codec_digests(docs, PIECES)


@_over_documents("op4_bloom_dedup")
def _op4(docs: DataFrame) -> DataFrame:
    return exact_copies(docs)


@_over_documents("op5_secret_scan")
def _op5(docs: DataFrame) -> DataFrame:
    return span_digests(secret_spans(docs))


@_over_documents("op6_backoff_lm")
def _op6(docs: DataFrame) -> DataFrame:
    return scored(docs)


@_over_documents("op7_curriculum")
def _op7(docs: DataFrame) -> DataFrame:
    mix = mixed(docs).drop("turn", "passes", "offset", "source")
    at = F.round("position", 6)
    return mix.withColumn("target", F.round("target", 6)).withColumn("position", at).orderBy("position", "doc_id")


@_over_documents("op8_simhash")
def _op8(docs: DataFrame) -> DataFrame:
    return near_copies(docs)


@_over_documents("op9_token_lengths")
def _op9(docs: DataFrame) -> DataFrame:
    return context_limits(length_histogram(docs, RANKS, public_tokenizers.PATTERN))


@_over_documents("op11_merkle_proofs")
def _op11(docs: DataFrame) -> DataFrame:
    return verified_manifest(docs)


@_over_documents("op12_periodic_runs")
def _op12(docs: DataFrame) -> DataFrame:
    return run_digests(periodic_runs(with_planted_runs(docs)))


def _op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(tune(spark), folder, "documents")
    return scored_documents(docs, read_table(spark, folder, "labels"))


QUERIES["op10_toxic_crf"] = _op10


def _op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(tune(spark), folder, "documents")
    return scored_quality(docs, read_table(spark, folder, "labels"))


QUERIES["op13_rule_ensemble"] = _op13
