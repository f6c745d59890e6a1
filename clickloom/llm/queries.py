"""Registered queries: each applies one operator, with production parameters,
to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from clickloom.llm import bpe, merkle, neardup, neighbours, packing, ppm, search, sharding, substrings, tokencount, toxicity, trie, warc
from clickloom.llm.common import crc_rest, documents
from clickloom.llm.oracle import SQL


def op1_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.similar_documents(documents(spark, sf_dir))


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.group_documents(documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(documents(spark, sf_dir), path, public_tokenizers.PATTERN, digests=True)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(documents(spark, sf_dir), path, public_tokenizers.PATTERN, end_id=2)


def op5_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(documents(spark, sf_dir), crc_rest("doc_id", 7) == 2)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest_documents(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(documents(spark, sf_dir), documents(spark, sf_dir, "labels"))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search_embeddings(documents(spark, sf_dir, "embeddings"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(documents(spark, sf_dir))


def op10_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(documents(spark, sf_dir, "pages")))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.shared_trie(documents(spark, sf_dir, "conversations"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.check_documents(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_search": op1_search,
    "op2_neardup": op2_neardup,
    "op3_bpe": op3_bpe,
    "op4_packing": op4_packing,
    "op5_ppm": op5_ppm,
    "op6_substrings": op6_substrings,
    "op7_toxicity": op7_toxicity,
    "op8_neighbours": op8_neighbours,
    "op9_sharding": op9_sharding,
    "op10_warc_derivatives": op10_warc_derivatives,
    "op11_trie": op11_trie,
    "op12_token_counts": op12_token_counts,
    "op13_merkle": op13_merkle,
}

__all__ = ["QUERIES", "SQL"]
