import datetime as dt
import json

from pyspark.sql import functions as F

from clickloom.config import IngestLimits
from clickloom.sources.events import parse_bodies, validate_events

U = "1234567{}-aaaa-4bbb-8ccc-0123456789ab"
ARR = dt.datetime(2024, 6, 1, 12, 0, 0)


def body(**kw):
    b = dict(event_id=U.format(1), event_name="page_view", visitor_id=U.format(2), session_id=U.format(3),
             client_timestamp="2024-06-01T11:59:00.000Z", page_url="https://shop.example.com/p?utm_source=ig",
             utm_source="  ", screen_width=400, properties={"internal_traffic": "true", "x": 1})
    b.update(kw)
    return json.dumps({k: v for k, v in b.items() if v is not None})


def test_reject_reasons_and_normalisation(spark):
    rows = [
        ("ok", body()),
        ("bad_id", body(visitor_id="not-a-uuid")),
        ("bad_name", body(event_name="Page View")),
        ("bad_url", body(page_url="no scheme")),
        ("space_url", body(page_url="https://shop.example.com/a b?utm_source=x y")),
        ("bad_ts", body(client_timestamp="yesterday")),
        ("no_ts", body(client_timestamp=None)),
        ("corrupt", '{"event_id": '),
        ("too_big", body(properties={"blob": "x" * 97000})),
        ("wide", body(screen_width=50000)),
    ]
    raw = spark.createDataFrame([(k, b, ARR) for k, b in rows], "case string, body string, arrival timestamp_ntz")
    ok, bad = validate_events(parse_bodies(raw), "arrival", keep=("case",), limits=IngestLimits.fixed())
    reasons = {r.case: r.reject_reason for r in bad.collect()}
    assert reasons == {"bad_id": "invalid_identifiers", "bad_name": "invalid_event_name", "bad_url": "invalid_page_url",
                       "bad_ts": "invalid_timestamp", "corrupt": "invalid_json", "too_big": "payload_too_large"}
    acc = {r.case: r for r in ok.collect()}
    assert set(acc) == {"ok", "space_url", "no_ts", "wide"}
    assert acc["ok"].utm_source == "ig"                       # blank body value -> URL hint
    assert acc["space_url"].utm_source == "x y"
    assert acc["no_ts"].client_timestamp == ARR               # missing timestamp -> arrival
    assert acc["wide"].screen_width is None and acc["ok"].screen_width == 400
    props = json.loads(acc["ok"].properties)
    assert props["internal_traffic"] is True and props["test"] is True and props["x"] == 1
