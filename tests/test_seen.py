"""Seen-id index: exact answers, reads that follow the batch, retries."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from clickloom.config import UUID_PATTERN
from clickloom.session import ensure_checkpoint_dir
from clickloom.sources.events import parse_bodies, validate_events
from clickloom.streaming import ingest, seen
from clickloom.streaming.seen import SeenIds

T0 = dt.datetime(2024, 7, 1, 9, 0, 0)


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "key string")


def answers(index, spark, values, tag="now"):
    return sorted(r.key for r in index.seen(keys(spark, values), tag).collect())


def test_index_is_exact_across_pieces_and_levels(spark, tmpdir_path, monkeypatch):
    monkeypatch.setattr(seen, "FANIN", 3)
    monkeypatch.setattr(seen, "PER_BLOCK", 50)  # several blocks a bucket
    ensure_checkpoint_dir(spark)
    index = SeenIds(spark, f"{tmpdir_path}/seen", buckets=4)
    assert not index.exists() and answers(index, spark, ["a"]) == []
    stored = []
    for n in range(7):
        new = [f"k{n}-{i}" for i in range(400 if n == 0 else 5)]
        index.add(keys(spark, [*new, new[0], None]), f"q-{n}")
        stored += new
        if n in (2, 5):
            index.compact()
    asked = [*stored, *[f"other{i}" for i in range(500)], "k0-1", None]
    assert answers(index, spark, asked) == sorted(stored)
    assert answers(index, spark, ["k6-0", "k5-0"], tag="q-6") == ["k5-0"]  # its own tag is ignored
    index.add(keys(spark, ["k6-0"]), "q-6")  # a retry adds again
    assert answers(index, spark, ["k6-0"]) == ["k6-0"]


def test_filters_leave_few_keys_to_look_up(spark, tmpdir_path):
    index = SeenIds(spark, f"{tmpdir_path}/seen", buckets=4)
    index.add(spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key")), "q-0")
    new = spark.range(20_000).select(F.concat(F.lit("n"), "id").alias("key")).withColumn("bucket", seen.bucket_of("key", 4))
    assert index.maybe(new, "now").count() < 200  # about one in 300


def test_files_read_follow_the_batch(spark, tmpdir_path):
    """The same few keys read as many files after ten times the history."""
    index = SeenIds(spark, f"{tmpdir_path}/seen", buckets=32)
    batch = keys(spark, ["k1", "k2", "x1"])
    touched = sorted({r.b for r in batch.select(seen.bucket_of("key", 32).alias("b")).collect()})

    def read():
        return [len(index._read(t, touched).inputFiles()) for t in ("filters", "ids")]

    index.add(spark.range(300).select(F.concat(F.lit("k"), "id").alias("key")), "q-0")
    before = read()
    index.add(spark.range(300, 3300).select(F.concat(F.lit("k"), "id").alias("key")), "q-1")
    piece = read()
    for t in ("filters", "ids"):
        assert len(index._read(t).inputFiles()) == 2 * 32
    assert before == [len(touched)] * 2 and piece == [2 * len(touched)] * 2  # one file a bucket and piece, of 32 buckets
    assert [r.key for r in index.seen(batch, "now").orderBy("key").collect()] == ["k1", "k2"]


def body(n, shop=None, at=T0, **more):
    uuid = lambda tag, k: f"{tag:08d}-0000-4000-8000-{k:012d}"
    props = {"shopify_event_id": shop} if shop else {}
    b = dict(event_id=uuid(1, n), event_name="page_view", visitor_id=uuid(2, 1), session_id=uuid(3, 1),
             client_timestamp=at.isoformat() + "Z", page_url="https://shop.example.com/p", properties=props)
    return json.dumps(b | more)


@pytest.mark.parametrize("fails_at", ["write", "index", "never"])
def test_a_batch_that_runs_again_stores_its_rows_once(spark, tmpdir_path, monkeypatch, fails_at):
    target, dead = f"{tmpdir_path}/t", f"{tmpdir_path}/d"

    def run(epoch, bodies):
        batch = parse_bodies(spark.createDataFrame([(b, T0) for b in bodies], "body string, arrival timestamp_ntz"))
        ingest.process_batch(spark, batch, epoch, target, dead, "arrival", UUID_PATTERN, None, 30, buckets=2)

    run(0, [body(1, "s1"), body(2), body(2), "{bad"])
    second = [body(1), body(3, "s1"), body(4, "s4"), body(5, "s4"), body(6)]
    if fails_at != "never":
        step = {"write": (ingest, "stamp_attribution"), "index": (SeenIds, "add")}[fails_at]
        keep = getattr(*step)

        def fail(*a, **k):
            raise RuntimeError("lost")

        monkeypatch.setattr(*step, fail)
        with pytest.raises(RuntimeError):
            run(1, second)
        monkeypatch.setattr(*step, keep)
    run(1, second)
    run(2, [body(6), body(4, "s4"), body(7)])
    got = sorted(int(r.event_id[-2:]) for r in spark.read.parquet(target).collect())
    assert got == [1, 2, 4, 6, 7]
    assert [r.reject_reason for r in spark.read.parquet(dead).collect()] == ["invalid_json"]


def test_fields_of_another_type(spark):
    cases = {
        "number as time": dict(client_timestamp=1700000000000), "text as width": dict(screen_width="390"), "fraction": dict(screen_width=39.5),
        "whole double": dict(screen_width=390.0), "bag as text": dict(properties='{"a": 1}'), "bag as list": dict(properties=[1]),
        "number as path": dict(page_path=5), "hints": dict(page_url="https://shop.example.com/p?ct_session_id=S1&utm_source=ig"),
    }
    rejected = {"number as id": dict(event_id=5), "null url": dict(page_url=None), "object as name": dict(event_name={"a": 1})}
    late = T0 + dt.timedelta(seconds=5)
    rows = [(k, body(1, **v), late) for k, v in {**cases, **rejected}.items()]
    raw = parse_bodies(spark.createDataFrame(rows, "case string, body string, arrival timestamp_ntz"))
    ok, bad = validate_events(raw, "arrival", keep=("case",), context={"user_agent": F.lit("UA"), "country": F.lit(None)})
    got = {r.case: r for r in ok.collect()}
    assert {r.case: r.reject_reason for r in bad.collect()} == {"number as id": "invalid_identifiers", "null url": "invalid_page_url", "object as name": "invalid_event_name"}
    assert [r.event_id for r in bad.collect() if r.case == "number as id"] == ["5"]
    assert got["number as time"].client_timestamp == late and got["text as width"].screen_width is None
    assert got["fraction"].screen_width is None and got["whole double"].screen_width == 390 and got["number as path"].page_path is None
    bags = {k: json.loads(r.properties) for k, r in got.items()}
    assert "a" not in bags["bag as text"] and set(bags["bag as list"]) == {"server_context"}
    assert bags["hints"]["url_attribution_hints"] == {"ct_session_id": "S1", "utm_source": "ig", "source": "query"} and got["hints"].utm_source == "ig"
    context = bags["hints"]["server_context"]
    assert context == {"ingestion_version": 3, "origin": None, "user_agent": "UA", "client_hint_platform": None, "country": None, "region": None, "client_server_lag_ms": 5000}
    assert bags["number as time"]["server_context"]["client_server_lag_ms"] == 0
