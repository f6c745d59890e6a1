"""Corpus pipeline: clean a document table and pack it for training.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver of a
run writes it as Parquet and hands the reread table to the next stage.  All
stages but the last return the columns of ``docs``.

1. ``toxicity``: documents that the noisy-or model calls toxic go;
2. ``near_duplicates``: one document of each group stays, that of the least id;
   documents are linked from 80 per cent of common five-word shingles on;
3. ``substrings``: passages of 20 words that stand earlier in the corpus go;
   other texts stay byte for byte, and no row goes;
4. ``packing``: all texts as token pieces in sequences of at most 1024.

Rows with a NULL text pass the first three stages; rows with a NULL doc_id
belong to no group; rows that repeat a doc_id are one document, of which the
second stage keeps one row.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.llm import neardup, packing, substrings
from clickloom.llm import toxicity as tox
from clickloom.llm.common import bound_batches, documents, fresh

#: Documents with so many per cent of common shingles are near duplicates.
NEAR_PERCENT = 80


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = tox.fit(docs, documents(spark, sf_dir, "labels"))
    names = tuple(fresh(docs, c) for c in ("tox_score", "tox_predicted", "tox_offending"))
    return tox.score(docs, model, names=names).filter(F.col(names[1]) == 0).select(*[f"`{c}`" for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    stay = neardup.group_documents(docs, NEAR_PERCENT).filter("kept and doc_id is not null").select("doc_id").distinct()
    row = fresh(docs, "_row")
    one = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    named = docs.join(stay.hint("merge"), "doc_id", "left_semi").withColumn(row, F.row_number().over(one)).filter(F.col(row) == 1)
    return named.select(*[f"`{c}`" for c in docs.columns]).unionByName(docs.filter("doc_id is null"))


def substring_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    cleaned = substrings.remove_repeats(docs)
    return cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))) if "n_chars" in docs.columns else cleaned


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("substring_duplicates", substring_duplicates), ("packing", pack)]

#: Model fits and tokenizers have no SQL form; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
