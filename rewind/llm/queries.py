"""The registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import oracle, pii
from .bpe import digests, encode_documents
from .common import documents
from .lattice_lm import score_documents
from .ngram_join import ngram_components
from .packing import pack, piece_digests
from .quality import quality_verdicts
from .sharding import byte_shards
from .tiff import media_round_trip
from .token_counts import token_counts
from .toxicity import toxicity


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards(documents(spark, sf_dir), n_shards=40)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(documents(spark, sf_dir), policy="v1")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pii.span_digests(pii.spans(docs, pii.fit(docs)))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_round_trip(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), length=4096, end_id=2))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(documents(spark, sf_dir), width=4, percent=85)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_sharding, op3_byte_bpe, op4_toxicity, op5_quality_rules, op6_pii, op7_media_columns, op8_packing, op9_lm_scoring, op10_ngram_join)
}

#: The other queries tokenise, learn or write formats, which SQL does not express: they are tested by brute force.
ORACLE_SQL: dict[str, str] = {"op2_sharding": oracle.SHARDING, "op5_quality_rules": oracle.QUALITY, "op10_ngram_join": oracle.NGRAM_JOIN}
