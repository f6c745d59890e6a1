"""Every registered query on the smallest tables, against SQL where it has one."""

import os
import sys

import duckdb
import pytest

from clickloom.llm.queries import QUERIES, SQL

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
from oracle_check import TABLES, digest  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_names():
    assert [k.split("_")[0] for k in QUERIES] == [f"op{n}" for n in range(1, 14)] and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_matches_sql(spark, key):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[key](spark, SF)
    got = digest(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(SQL[key])
    want = digest([d[0] for d in res.description], res.fetchall())
    assert got[0] == want[0] and sorted(got[1]) == sorted(want[1])


@pytest.mark.parametrize(
    "key,columns",
    [
        ("op2_neardup", ["doc_id", "n_shingles", "component_id", "kept"]),
        ("op3_bpe", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]),
        ("op4_packing", ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]),
        ("op5_ppm", ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]),
        ("op6_substrings", ["doc_id", "n_words", "n_removed", "kept_sha256"]),
        ("op7_toxicity", ["doc_id", "held_out", "score", "predicted"]),
        ("op12_token_counts", ["doc_id", "n_bytes", "n_tokens", "over_limit"]),
        ("op13_merkle", ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]),
        ("op9_sharding", ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]),
    ],
)
def test_contract_columns_and_rows(spark, key, columns):
    df = QUERIES[key](spark, SF)
    assert df.columns[: len(columns)] == columns
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert df.select("doc_id").distinct().count() == docs.count()
