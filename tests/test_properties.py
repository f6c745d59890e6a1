"""Property checks: idempotent insert-ignore, the two-level
rollup and P1 flags equal naive distinct counts, valid rows are a subset of
all rows, sanitised output holds no raw sensitive value."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from clickloom.functions.agg import grouped_rollup, visitor_flag_counts
from clickloom.functions.sanitize import sanitize_json_text
from clickloom.sources.events import insert_ignore

T0 = dt.datetime(2024, 8, 1)


def _rows(seed, n=300):
    rnd = random.Random(seed)
    return [(i, rnd.choice(["a", "b", None]), f"v{rnd.randint(0, 9) if rnd.random() < 0.8 else 'hot'}",
             f"s{rnd.randint(0, 30)}", rnd.choice(["page_view", "purchase", "checkout_started"]))
            for i in range(n)]


SCHEMA = "event_id long, k string, visitor_id string, session_id string, event_name string"


def test_rollup_and_flags_equal_naive(spark):
    for seed in (1, 2, 3):
        df = spark.createDataFrame(_rows(seed), SCHEMA)
        got = grouped_rollup(df, ["k"], counts={"purchases": F.col("event_name") == "purchase"},
                             visitor_flags={"buyers": F.col("event_name") == "purchase"})
        naive = df.groupBy("k").agg(
            F.count(F.lit(1)).alias("events"), F.count_distinct("visitor_id").alias("unique_visitors"),
            F.count_distinct("session_id").alias("sessions"),
            F.count_if(F.col("event_name") == "purchase").alias("purchases"),
            F.count_distinct(F.when(F.col("event_name") == "purchase", F.col("visitor_id"))).alias("buyers"))
        def key(t):
            return str(t)

        assert sorted(map(tuple, got.select(*naive.columns).collect()), key=key) == sorted(map(tuple, naive.collect()), key=key)
        flags = visitor_flag_counts(df, ["k"], {"buyers": F.col("event_name") == "purchase"})
        assert sorted(((r.k, r.buyers) for r in flags.collect()), key=key) == sorted(
            ((r.k, r.buyers) for r in naive.collect()), key=key)


def test_insert_ignore_idempotent(spark):
    rows = _rows(4, 200)
    target = spark.createDataFrame(rows[:120], SCHEMA)
    batch = spark.createDataFrame(rows[100:] + rows[150:170], SCHEMA)
    new = insert_ignore(target, batch)
    assert sorted(r.event_id for r in new.collect()) == list(range(120, 200))
    assert insert_ignore(target.unionByName(new), batch).count() == 0


def test_sanitised_output_has_no_raw_sensitive_values():
    rnd = random.Random(9)
    for _ in range(200):
        secret = f"S{rnd.randint(10 ** 6, 10 ** 7)}x"
        doc = {"email": secret, "a": [{"checkout_token": secret}], "b": {"c": {"fbclid": secret}},
               "landing_page": f"https://x.example.com/p?fbclid={secret}&utm_source=s"}
        assert secret not in sanitize_json_text(json.dumps(doc))


def test_approx_switches_close_to_exact(spark):
    from clickloom.operators.reports import web_performance

    df = spark.createDataFrame(_rows(7, 2000), SCHEMA)
    exact = {r.k: r for r in grouped_rollup(df, ["k"]).collect()}
    approx = {r.k: r for r in grouped_rollup(df, ["k"], approx=True).collect()}
    for k, r in exact.items():
        assert abs(approx[k].unique_visitors - r.unique_visitors) <= max(1, 0.05 * r.unique_visitors)
        assert approx[k].events == r.events
    perf = spark.createDataFrame([("v1", "page_performance", json.dumps({"lcp_ms": str(i), "inp_ms": "5", "cls": "0.1",
                                                                          "ttfb_ms": "1", "load_ms": "2"}))
                                  for i in range(1, 401)], "visitor_id string, event_name string, properties string")
    from clickloom.functions.json import with_props

    e = web_performance(with_props(perf)).first()
    a = web_performance(with_props(perf), approx=True).first()
    assert e.p75_lcp_ms == 300.25 and abs(a.p75_lcp_ms - 300.25) <= 2
