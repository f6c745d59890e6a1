import datetime as dt
import random

from pyspark.sql import functions as F

from clickloom.operators.sessions import session_window_ids, sessionize, touch_attribution, visitor_counters

T0 = dt.datetime(2024, 1, 1, 23, 0, 0)


def brute_sessions(rows, gap_us):
    out = {}
    by_v = {}
    for eid, v, ts in rows:
        by_v.setdefault(v, []).append((ts, eid))
    for v, evs in by_v.items():
        evs.sort()
        n, prev = 0, None
        for ts, eid in evs:
            if prev is None or (ts - prev) / dt.timedelta(microseconds=1) > gap_us:
                n += 1
            out[eid] = n
            prev = ts
    return out


def test_gap_edges(spark):
    gap = dt.timedelta(minutes=30)
    us = dt.timedelta(microseconds=1)
    ts = [T0, T0 + gap - us, T0 + 2 * gap - us, T0 + 3 * gap + us, T0 + 3 * gap + us + gap]
    rows = [(i, "a", t) for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "event_id long, visitor_id string, client_timestamp timestamp_ntz")
    got = {r.event_id: r.session_no for r in sessionize(df, gap_seconds=1800).collect()}
    # gap < 30min and == 30min stay, 30min + 1us starts a new session
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2}


def test_matches_brute_force_across_buckets(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(600):
        v = "hot" if i % 3 else f"v{i % 7}"  # one visitor with two thirds of the rows
        rows.append((i, v, T0 + dt.timedelta(seconds=rnd.randint(0, 4 * 86400))))
    df = spark.createDataFrame(rows, "event_id long, visitor_id string, client_timestamp timestamp_ntz")
    for bucket in (3600, 86400):
        got = {r.event_id: r.session_no for r in sessionize(df, gap_seconds=1800, bucket_seconds=bucket).collect()}
        assert got == brute_sessions(rows, 1800 * 1_000_000)


def test_session_window_keeps_exact_gap(spark):
    rows = [(0, "a", T0), (1, "a", T0 + dt.timedelta(minutes=30)), (2, "a", T0 + dt.timedelta(minutes=61))]
    df = spark.createDataFrame(rows, "event_id long, visitor_id string, client_timestamp timestamp_ntz")
    w = session_window_ids(df).orderBy("session_start").collect()
    assert [r.events for r in w] == [2, 1]


def test_touch_attribution(spark):
    rows = [
        (1, "v", "s1", T0, None, None),
        (2, "v", "s1", T0 + dt.timedelta(minutes=1), "fb", "c1"),
        (3, "v", "s1", T0 + dt.timedelta(minutes=2), None, None),
        (4, "v", "s1", T0 + dt.timedelta(minutes=3), "google", "c2"),
        (5, "v", "s2", T0 + dt.timedelta(hours=5), None, None),
    ]
    df = spark.createDataFrame(rows, "event_id long, visitor_id string, session_id string, "
                                     "client_timestamp timestamp_ntz, utm_source string, utm_campaign string")
    t = {r.event_id: r for r in touch_attribution(df, touch_cols=("utm_source", "utm_campaign")).collect()}
    assert t[1].session_touch is None and t[1].active_touch.utm_source == "fb"  # falls back to first touch
    assert t[3].session_touch.utm_campaign == "c1"
    assert t[4].session_touch.utm_source == "google" and t[4].first_touch.utm_source == "fb"
    assert t[5].session_touch is None and t[5].active_touch.utm_campaign == "c1"


def test_visitor_counters(spark):
    rows = [
        (1, "v", "s1", T0, "page_view"), (2, "v", "s1", T0 + dt.timedelta(minutes=1), "click"),
        (3, "v", "s1", T0 + dt.timedelta(minutes=2), "page_view"), (4, "v", "s2", T0 + dt.timedelta(hours=3), "page_view"),
    ]
    df = spark.createDataFrame(rows, "event_id long, visitor_id string, session_id string, "
                                     "client_timestamp timestamp_ntz, event_name string")
    c = {r.event_id: r for r in visitor_counters(df).collect()}
    assert c[4].visit_number == 2 and c[4].returning_visitor
    assert c[3].page_view_index_in_session == 2 and c[4].page_view_index_for_visitor == 3
    assert c[2].page_view_index_in_session is None


def test_bucketed_scans_equal_plain_windows(spark):
    from pyspark.sql import Window

    from clickloom.operators.scan import next_value, prev_value, running_count, running_last

    rnd = random.Random(3)
    rows = []
    for i in range(800):
        k = "hot" if i % 2 else f"k{i % 5}"
        v = None if rnd.random() < 0.4 else f"x{i}"
        rows.append((i, k, T0 + dt.timedelta(seconds=rnd.randint(0, 5 * 86400)), v))
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp_ntz, v string")
    w = Window.partitionBy("k").orderBy("ts", "id")
    wr = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ref = df.select("id", F.lag("v").over(w).alias("p"), F.lead("v").over(w).alias("n"),
                    F.last("v", ignorenulls=True).over(wr).alias("l"),
                    F.sum(F.col("v").isNotNull().cast("long")).over(wr).alias("c"))
    got = prev_value(df, "k", "ts", "v", "p", "id", bucket_seconds=3600)
    got = next_value(got, "k", "ts", "v", "n", "id", bucket_seconds=3600)
    got = running_last(got, "k", "ts", "v", "l", "id", bucket_seconds=3600)
    got = running_count(got, "k", "ts", F.col("v").isNotNull(), "c", "id", bucket_seconds=3600)
    a = sorted(tuple(r) for r in ref.collect())
    b = sorted(tuple(r) for r in got.select("id", "p", "n", "l", "c").collect())
    assert a == b


def brute_rage(clicks, window_ms=1400, radius=48, cooldown_ms=5000):
    out = []
    by = {}
    for p, t, x, y in clicks:
        by.setdefault(p, []).append((t, x, y))
    for p, cs in by.items():
        cs.sort()
        recent, last = [], None
        for t, x, y in cs:
            now = t.timestamp() * 1000
            recent = [c for c in recent + [(now, x, y)] if now - c[0] <= window_ms]
            if len(recent) >= 3 and (last is None or now - last > cooldown_ms):
                ax, ay = x, y
                if all(((cx - ax) ** 2 + (cy - ay) ** 2) ** 0.5 <= radius for _, cx, cy in recent[-3:]):
                    last = now
                    out.append((p, t))
    return sorted(out)


def test_rage_clicks_brute_force(spark):
    from clickloom.operators.interaction import rage_clicks

    rnd = random.Random(5)
    clicks, t = [], T0
    for i in range(500):
        p = "hot" if rnd.random() < 0.7 else f"p{rnd.randint(0, 3)}"
        t = t + dt.timedelta(milliseconds=rnd.choice([100, 300, 500, 900, 1600, 4000, 7000]))
        clicks.append((p, t, rnd.choice([100, 110, 130, 300]), rnd.choice([50, 60, 200])))
    df = spark.createDataFrame(clicks, "page_instance_id string, ts timestamp_ntz, x int, y int")
    got = sorted((r.page_instance_id, r.ts) for r in rage_clicks(df).collect())
    assert got == brute_rage(clicks) and len(got) > 5
