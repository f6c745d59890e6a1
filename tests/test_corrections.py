"""Micro tables for cases that once went wrong: leaks, look-back, merging of
stamps, repeated enters, copies that differ, clicks of one millisecond, cuts."""

import datetime as dt
import json
import os

import pytest
from conftest import make_events
from pyspark.sql import functions as F

from clickloom.config import IngestLimits, normalize_days, raw_limit
from clickloom.functions.json import with_props
from clickloom.operators.attribution import stamp_attribution
from clickloom.operators.interaction import rage_clicks, section_dwell
from clickloom.plans import export as EXP
from clickloom.sources.events import insert_ignore, parse_bodies, validate_events
from clickloom.streaming.ingest import process_batch

T0 = dt.datetime(2024, 5, 1, 10, 0, 0)
RAW = ("SECRET-CHECKOUT", "SECRET-ORDER", "a@b.example", "SECRETCLICK")


def written(path):
    return "".join(open(os.path.join(d, f)).read() for d, _, names in os.walk(path) for f in names if f.endswith(".json"))


@pytest.mark.parametrize("which", ["fallback", "rich"])
def test_no_raw_identifier_leaves_the_export(spark, tmpdir_path, which):
    props = {"checkout_id": RAW[0], "order_id": RAW[1], "nested": {"email": RAW[2], "items": [{"email": RAW[2]}] * 3}, "page_type": "sales_page"}
    url = f"https://shop.example.com/checkouts/{RAW[0]}?fbclid={RAW[3]}&utm_source=ig"
    rows = [
        dict(event_name=name, client_timestamp=T0 + dt.timedelta(minutes=i), page_url=url, referrer=url, fbclid=RAW[3], properties=json.dumps(props))
        for i, name in enumerate(["page_view", "cta_impression", "buy_button_click", "add_to_cart", "checkout_started", "purchase"])
    ]
    ev = with_props(make_events(spark, rows))
    from clickloom.config import ReportConfig

    cfg = ReportConfig(as_of=T0 + dt.timedelta(days=1), days=30)
    bundle = EXP.fallback_bundle(ev, cfg) if which == "fallback" else EXP.build_bundle(ev, None, cfg)
    health = EXP.write_bundle(spark, bundle, f"{tmpdir_path}/x").collect()
    assert all(h.ok for h in health), [h for h in health if not h.ok]
    text = written(f"{tmpdir_path}/x")
    assert "sha256:" in text and not [x for x in RAW if x in text]


def test_health_finds_an_expression_that_fails(spark):
    bad = spark.range(3).select(F.raise_error(F.lit("broken cell")).alias("x"), "id")
    h = {r.name: r for r in EXP.run_isolated(spark, {"bad": bad, "good": spark.range(3)}).collect()}
    assert not h["bad"].ok and "broken cell" in h["bad"].error and (h["good"].ok, h["good"].rows) == (True, 3)


def test_stamp_replaces_a_record_that_the_client_sent(spark):
    ev = make_events(spark, [dict(event_id="p", event_name="purchase", client_timestamp=T0, properties='{"conversion_attribution":{"method":"fake"},"k":1}')])
    res = ev.select(
        "event_id", "visitor_id", "session_id", "received_at", F.lit("v").alias("attributed_visitor_id"), F.lit("s").alias("attributed_session_id"),
        F.lit("same_session").alias("method"), F.lit("x").alias("confidence"), F.lit(False).alias("cross_session"), F.lit("c").alias("checkout_id"),
        F.lit(None).cast("string").alias("order_id"), F.lit("y").alias("identifier_source"), F.lit(30).alias("lookback_days"),
    )
    text = stamp_attribution(ev, res).first().properties
    assert text.count("conversion_attribution") == 1 and json.loads(text)["k"] == 1
    assert json.loads(text)["conversion_attribution"]["method"] == "same_session"


def body(n, name, visitor, session, at, **props):
    uuid = lambda tag, k: f"{tag:08d}-0000-4000-8000-{k:012d}"
    return json.dumps(dict(event_id=uuid(1, n), event_name=name, visitor_id=uuid(2, visitor), session_id=uuid(3, session),
                           client_timestamp=at.strftime("%Y-%m-%dT%H:%M:%S.000Z"), page_url="https://shop.example.com/p", properties=props))


@pytest.mark.parametrize("cuts", [[3], [1, 2], [1, 1, 1]])
def test_stream_attribution_does_not_depend_on_the_batches(spark, tmpdir_path, cuts):
    days = [0, 25, 35]
    at = [T0 + dt.timedelta(days=d) for d in days]
    rows = [(body(1, "add_to_cart", 1, 1, at[0], checkout_id="CO1"), at[0]), (body(2, "purchase", 2, 2, at[1], checkout_id="CO1"), at[1]), (body(3, "page_view", 3, 3, at[2]), at[2])]
    k = 0
    for epoch, n in enumerate(cuts):
        batch = parse_bodies(spark.createDataFrame(rows[k : k + n], "body string, arrival timestamp_ntz"))
        from clickloom.config import UUID_PATTERN

        process_batch(spark, batch, epoch, f"{tmpdir_path}/t", f"{tmpdir_path}/d", "arrival", UUID_PATTERN, None, 30)
        k += n
    got = spark.read.parquet(f"{tmpdir_path}/t").where("event_name = 'purchase'").first()
    record = json.loads(got.properties)["conversion_attribution"]
    assert record["method"] == "checkout_id" and record["cross_session"] is True and record["session_id"].endswith("1")


def test_section_dwell_counts_from_the_first_enter(spark):
    s = lambda n: T0 + dt.timedelta(seconds=n)
    rows = [("p", "a", s(0), "enter"), ("p", "a", s(1), "enter"), ("p", "a", s(3), "exit"), ("p", "a", s(4), "exit"), ("p", "a", s(5), "enter")]
    df = spark.createDataFrame(rows, "page_instance_id string, section_key string, ts timestamp_ntz, state string")
    assert [(r.visible_ms, r.entered_at) for r in section_dwell(df).collect()] == [(3000, s(0))]


def test_rage_clicks_of_one_millisecond_are_one_anomaly(spark):
    ms = lambda n: T0 + dt.timedelta(milliseconds=n)
    rows = [("p", ms(0), 1, 1), ("p", ms(100), 2, 1), ("p", ms(200), 3, 1), ("p", ms(200), 4, 1), ("p", ms(300), 5, 1)]
    got = rage_clicks(spark.createDataFrame(rows, "page_instance_id string, ts timestamp_ntz, x int, y int")).collect()
    assert [(r.ts, r.x) for r in got] == [(ms(200), 3)]


def test_insert_ignore_keeps_the_first_copy(spark):
    h = lambda n: T0 + dt.timedelta(hours=n)
    rows = [dict(event_id="e", client_timestamp=T0, received_at=h(2), page_title="late"), dict(event_id="e", client_timestamp=T0, received_at=h(1), page_title="first"),
            dict(event_id="f", client_timestamp=T0), dict(event_id="old", client_timestamp=T0)]
    target = make_events(spark, [dict(event_id="old", client_timestamp=T0)])
    got = insert_ignore(target, make_events(spark, rows).repartition(3)).collect()
    assert {r.event_id: r.page_title for r in got} == {"e": "first", "f": None}


def test_nothing_is_cut_or_rejected_for_its_size_unless_asked(spark):
    at = T0
    long = body(1, "page_view", 1, 1, at, blob="x" * 120_000)
    raw = parse_bodies(spark.createDataFrame([(long.replace("/p", "/p" + "y" * 9000), at)], "body string, arrival timestamp_ntz"))
    ok, bad = validate_events(raw, "arrival")
    assert bad.count() == 0 and len(ok.first().page_url) > 9000
    ok, bad = validate_events(raw, "arrival", limits=IngestLimits.fixed())
    assert ok.count() == 0 and bad.first().reject_reason == "payload_too_large"
    assert normalize_days(45) == 45 and normalize_days(None) == 90 and raw_limit(None) is None and raw_limit("7") == 7
    with pytest.raises(ValueError):
        normalize_days(0)


def test_a_cluster_needs_a_shared_checkpoint_folder():
    from clickloom.session import ensure_checkpoint_dir

    class Stub:
        master = "spark://host:7077"
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

        @property
        def sparkContext(self):
            return self

        def getCheckpointDir(self):
            return None

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Stub())


def test_ads_table_is_merged_by_date(spark, tmpdir_path):
    from clickloom.sources.ads import normalize_ads, upsert_table

    def rows(*pairs):
        schema = "account_id string, date_start string, campaign_id string, campaign_name string, adset_id string, adset_name string, ad_id string, " \
            "ad_name string, creative_id string, spend string, impressions string, reach string, frequency string, clicks string, unique_clicks string, " \
            "landing_page_views string, add_to_cart string, initiate_checkout string, purchases string, purchase_value string, currency string, " \
            "actions array<struct<action_type:string,value:string>>"  # fmt: skip
        full = [("a", d, "c", None, None, None, ad, None, None, s, *["1"] * 10, "BRL", None) for d, ad, s in pairs]
        return normalize_ads(spark.createDataFrame(full, schema))[0]

    path = f"{tmpdir_path}/ads"
    upsert_table(spark, path, rows(("2024-01-01", "x", "1"), ("2024-01-02", "x", "2"), ("2024-01-02", "y", "3")), dt.datetime(2024, 1, 3))
    first = {f for f in os.listdir(f"{path}/date_start=2024-01-01") if f.endswith(".parquet")}
    upsert_table(spark, path, rows(("2024-01-02", "x", "20"), ("2024-01-05", "z", "5")), dt.datetime(2024, 1, 6))
    got = {(str(r.date_start), r.ad_id): (r.spend, r.ingested_at.day) for r in spark.read.parquet(path).collect()}
    assert got == {("2024-01-01", "x"): (1.0, 3), ("2024-01-02", "x"): (20.0, 6), ("2024-01-02", "y"): (3.0, 3), ("2024-01-05", "z"): (5.0, 6)}
    assert {f for f in os.listdir(f"{path}/date_start=2024-01-01") if f.endswith(".parquet")} == first  # untouched


def test_exact_percentiles(spark):
    import numpy as np

    from clickloom.functions.agg import exact_percentiles

    rng = np.random.default_rng(2)
    a, b = np.round(rng.exponential(100, 501), 1), rng.integers(0, 5, 501).astype(float)
    rows = [(float(x), None if i % 7 == 0 else float(y), 3.0, None) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    df = spark.createDataFrame(rows, "a double, b double, c double, e double")
    got = exact_percentiles(df, {"p75": ("a", 0.75), "p50": ("a", 0.5), "q": ("b", 0.9), "one": ("c", 0.3), "none": ("e", 0.5)}, ranges=16).first()
    kept = [y for i, y in enumerate(b) if i % 7]
    assert np.allclose([got.p75, got.p50, got.q, got.one], [np.quantile(a, 0.75), np.quantile(a, 0.5), np.quantile(kept, 0.9), 3.0]) and got.none is None
