"""Ordered merge of ad snapshots, JSON posts, and the export's fallback."""

import datetime as dt
import json
import os

import numpy as np
import pytest

from clickloom.functions.agg import exact_percentiles, narrowed
from clickloom.plans import catalog as C
from clickloom.plans import export as EXP
from clickloom.sources.ads import ingest_ads_json, upsert_table

SF = "/root/testdata/sf0.001"
SCHEMA = "account_id string, date_start date, ad_id string, spend double, posted int"
DAY = dt.date(2024, 1, 1)


def stored(spark, path):
    return {r.ad_id: r.spend for r in spark.read.parquet(path).collect()}


@pytest.mark.parametrize("flip", [False, True])
def test_last_posted_row_of_a_batch_wins_in_any_order(spark, tmpdir_path, flip):
    rows = [("a", DAY, "x", 9.0, 1), ("a", DAY, "x", 2.0, 2), ("a", DAY, "y", 5.0, 7), ("a", DAY, "y", 4.0, 3)]
    upsert_table(spark, f"{tmpdir_path}/t", spark.createDataFrame(rows[::-1] if flip else rows, SCHEMA), dt.datetime(2024, 1, 2))
    assert stored(spark, f"{tmpdir_path}/t") == {"x": 2.0, "y": 5.0}
    assert "posted" not in spark.read.parquet(f"{tmpdir_path}/t").columns


@pytest.mark.parametrize("flip", [False, True])
def test_rows_without_sequence_tie_by_value(spark, tmpdir_path, flip):
    rows = [("a", DAY, "x", 1.0, 0), ("a", DAY, "x", 2.0, 0), ("a", DAY, "x", None, 0)]
    new = spark.createDataFrame(rows[::-1] if flip else rows, SCHEMA).drop("posted")
    upsert_table(spark, f"{tmpdir_path}/t", new, dt.datetime(2024, 1, 2))
    assert stored(spark, f"{tmpdir_path}/t") == {"x": 2.0}


def test_new_rows_win_over_stored_ones_of_the_same_stamp(spark, tmpdir_path):
    for spend in (8.0, 3.0, 3.0):  # the last batch runs twice
        upsert_table(spark, f"{tmpdir_path}/t", spark.createDataFrame([("a", DAY, "x", spend, 1)], SCHEMA), dt.datetime(2024, 1, 2))
    assert stored(spark, f"{tmpdir_path}/t") == {"x": 3.0}


def test_older_stamp_loses_and_empty_batch_changes_nothing(spark, tmpdir_path):
    one = lambda v: spark.createDataFrame([("a", DAY, "x", v, 1)], SCHEMA)
    upsert_table(spark, f"{tmpdir_path}/t", one(1.0), dt.datetime(2024, 1, 5))
    upsert_table(spark, f"{tmpdir_path}/t", one(2.0), dt.datetime(2024, 1, 4))
    upsert_table(spark, f"{tmpdir_path}/t", one(7.0).limit(0), dt.datetime(2024, 1, 6))
    assert stored(spark, f"{tmpdir_path}/t") == {"x": 1.0}


def test_posted_order_over_lines_and_splits(spark, tmpdir_path):
    """The last line of a key wins, also where a file is read in many splits."""
    post = lambda i: {"rows": [{"date_start": "2024-01-01", "campaign_id": "c", "ad_id": f"k{i % 7}", "spend": i + p / 4} for p in (0, 1)]}
    with open(f"{tmpdir_path}/posts.json", "w") as f:
        f.writelines(json.dumps(post(i)) + "\n" for i in range(400))
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "4096")
        ok, bad = ingest_ads_json(spark, f"{tmpdir_path}/posts.json")
        assert ok.rdd.getNumPartitions() > 3 and bad.count() == 0
        upsert_table(spark, f"{tmpdir_path}/t", ok, dt.datetime(2024, 1, 2))
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    assert stored(spark, f"{tmpdir_path}/t") == {f"k{i % 7}": i + 0.25 for i in range(393, 400)}


def test_documents_without_rows_give_nothing(spark, tmpdir_path):
    with open(f"{tmpdir_path}/posts.json", "w") as f:
        f.write('{"rows": []}\n{}\n{"rows": null}\n{"other": 1}\n')
    ok, bad = ingest_ads_json(spark, f"{tmpdir_path}/posts.json")
    assert ok.count() == 0 and bad.count() == 0


def test_percentiles_do_not_depend_on_the_spread(spark):
    """One outlier of 1e12: few values are left to be put in order."""
    a = np.round(np.random.default_rng(5).exponential(100, 4000), 3)
    a = np.concatenate([a, np.full(1500, 3.0), [1e12, -1e12]])
    df = spark.createDataFrame([(float(x),) for x in a], "a double")
    wanted = {f"p{q}": ("a", q / 100) for q in (0, 25, 50, 75, 99, 100)}
    got = exact_percentiles(df, wanted, ranges=16).first()
    assert np.allclose([got[f"p{q}"] for q in (0, 25, 50, 75, 99, 100)], [np.quantile(a, q / 100) for q in (0, 25, 50, 75, 99, 100)])

    values, counts = np.unique(a, return_counts=True)
    table = spark.createDataFrame([("p", float(v), int(c)) for v, c in zip(values, counts, strict=True)], "name string, value double, c bigint")
    at = int(0.75 * (len(a) - 1))
    bracket = spark.createDataFrame([("p", -1e12, 1e12, 0, at, at + 1, 0.0)],
                                    "name string, lo double, hi double, start bigint, first bigint, last bigint, share double")
    left = len(values)
    for _ in range(2):
        bracket = narrowed(table, bracket, 16)
        b = bracket.first()
        now = int(((values >= b.lo) & (values <= b.hi)).sum())
        assert b.start == int(counts[values < b.lo].sum()) and now <= max(2, 2 * left / 16 * 1.5)
        left = now


def test_percentiles_of_an_empty_table(spark):
    got = exact_percentiles(spark.createDataFrame([], "a double"), {"p": ("a", 0.5)}).collect()
    assert len(got) == 1 and got[0].p is None


def test_fallback_is_taken_where_the_full_export_fails(spark, tmpdir_path):
    ev, cfg = C.events(spark, SF), C._fx_cfg()
    broken = C.ads(spark, SF).drop("spend")  # the ad blocks cannot be built
    health = {r.name: r for r in EXP.export_or_fallback(spark, ev, broken, cfg, f"{tmpdir_path}/x").collect()}
    assert not health["full_export"].ok and "spend" in health["full_export"].error
    assert health["overview_basic"].ok and health["raw_events"].rows > 0
    assert os.path.isdir(f"{tmpdir_path}/x/_fallback/event_catalog")
