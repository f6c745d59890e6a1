"""Session operators: sessionize (W4), session entries (W2), latest page summary
(W3), visitor counters (W5) and touch attribution (W6).

Skew: a single visitor may own a large share of all rows (bots, shared kiosks).
A plain ``Window.partitionBy(visitor)`` would put that visitor into one task.
``sessionize`` therefore scans in two levels: rows are windowed per
(visitor, time bucket) and the bucket boundaries are stitched together with a
small bucket-level table (one row per visitor-bucket).  The hot visitor is thus
spread over as many tasks as it has buckets.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def sessionize(
    df: DataFrame,
    visitor: str = "visitor_id",
    ts: str = "client_timestamp",
    tiebreak: str = "event_id",
    gap_seconds: int = 1800,
    bucket_seconds: int = 86400,
    out: str = "session_no",
) -> DataFrame:
    """Number the sessions of each visitor (1, 2, ...).

    A new session starts when the gap to the visitor's previous event is
    strictly greater than ``gap_seconds``.  Rows are ordered by (ts, tiebreak).
    """
    gap_us = int(round(float(gap_seconds) * 1_000_000))
    bucket_us = int(bucket_seconds) * 1_000_000
    t = df.withColumn("_us", _micros(ts)).withColumn("_b", F.floor(F.col("_us") / F.lit(bucket_us)))
    w_in = Window.partitionBy(visitor, "_b").orderBy("_us", tiebreak)
    t = t.withColumn("_prev", F.lag("_us").over(w_in))
    t = t.withColumn(
        "_cut",
        F.when(F.col("_prev").isNotNull() & ((F.col("_us") - F.col("_prev")) > gap_us), 1).otherwise(0),
    )
    t = t.withColumn("_cum", F.sum("_cut").over(w_in.rowsBetween(Window.unboundedPreceding, Window.currentRow)))

    # Bucket-level stitching table: one row per (visitor, bucket).
    b = t.groupBy(visitor, "_b").agg(
        F.min("_us").alias("_bmin"), F.max("_us").alias("_bmax"), F.sum("_cut").alias("_bcuts")
    )
    wb = Window.partitionBy(visitor).orderBy("_b")
    b = b.withColumn("_pmax", F.lag("_bmax").over(wb))
    b = b.withColumn(
        "_first_cut",
        F.when(F.col("_pmax").isNull() | ((F.col("_bmin") - F.col("_pmax")) > gap_us), 1).otherwise(0),
    )
    b = b.withColumn("_bnew", F.col("_first_cut") + F.col("_bcuts"))
    b = b.withColumn(
        "_offset",
        F.coalesce(F.sum("_bnew").over(wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).select(visitor, "_b", "_first_cut", "_offset")

    res = t.join(b, [visitor, "_b"], "inner")
    res = res.withColumn(out, (F.col("_offset") + F.col("_first_cut") + F.col("_cum")).cast("bigint"))
    return res.drop("_us", "_b", "_prev", "_cut", "_cum", "_first_cut", "_offset")


def session_window_ids(df: DataFrame, visitor: str = "visitor_id", ts: str = "client_timestamp",
                       gap: str = "30 minutes") -> DataFrame:
    """Sessions as windows (what Spark's ``session_window`` gives): one row per
    (visitor, session) with start, end (last event + gap) and count.  A gap of
    exactly ``gap`` keeps the events in one session.  Numbered by
    ``sessionize``, so a hot visitor is spread over its days; the aggregate
    after it combines map-side."""
    seconds = int(pd.Timedelta(gap).total_seconds())
    rows = df.select(visitor, F.col(ts).cast("timestamp").alias(ts), F.lit(0).alias("_tie"))
    rows = sessionize(rows, visitor, ts, "_tie", seconds, out="_session")
    return rows.groupBy(visitor, "_session").agg(
        F.min(ts).alias("session_start"),
        (F.max(ts) + F.expr(f"INTERVAL {seconds} SECONDS")).alias("session_end"),
        F.count(F.lit(1)).alias("events"),
    ).drop("_session")


def session_entries(df: DataFrame, cols: dict[str, Column], session: str = "session_id",
                    ts: str = "client_timestamp", tiebreak: str = "event_id") -> DataFrame:
    """First event of each session (DISTINCT ON (session) ORDER BY ts).

    Expressed as one aggregate with ``min_by`` over a struct: partial
    aggregation before the shuffle (skew-safe); Spark runs it sort-based, so
    each task sorts its rows by session.
    """
    payload = F.struct(*[c.alias(n) for n, c in cols.items()])
    order = F.struct(F.col(ts), F.col(tiebreak))
    agg = df.groupBy(session).agg(F.min_by(payload, order).alias("_e"))
    return agg.select(session, *[F.col(f"_e.{n}").alias(n) for n in cols])


def latest_by(df: DataFrame, keys: list, cols: dict[str, Column], order: list) -> DataFrame:
    """Latest row per key (DISTINCT ON keys ORDER BY order DESC) via ``max_by``."""
    payload = F.struct(*[c.alias(n) for n, c in cols.items()])
    agg = df.groupBy(*keys).agg(F.max_by(payload, F.struct(*order)).alias("_l"))
    key_names = [k if isinstance(k, str) else k._jc.toString() for k in keys]
    return agg.select(*key_names, *[F.col(f"_l.{n}").alias(n) for n in cols])


def visitor_counters(df: DataFrame, visitor: str = "visitor_id", session: str = "session_id",
                     ts: str = "client_timestamp", tiebreak: str = "event_id",
                     page_view: Column | None = None, bucket_seconds: int = 86_400) -> DataFrame:
    """Per event: visit number of its session for the visitor, page-view index in
    the session and for the visitor, first-seen time, returning flag.

    Every running count is a bucketed scan (``scan.running_count``), so a hot
    visitor or session never lands whole in one task; the visit number is a
    running count over the session table (one row per session)."""
    from clickloom.operators.scan import running_count

    pv = page_view if page_view is not None else (F.col("event_name") == "page_view")
    sessions = df.groupBy(visitor, session).agg(F.min(F.struct(F.col(ts).alias("t"), F.col(tiebreak).alias("k"))).alias("_s"))
    sessions = sessions.select(visitor, session, F.col("_s.t").alias("_st"), F.col("_s.k").alias("_sk"))
    sessions = running_count(sessions, visitor, "_st", F.lit(True), "visit_number", "_sk", bucket_seconds)
    first = df.groupBy(visitor).agg(F.min(ts).alias("first_seen_at"))
    out = df.withColumn("_pv", pv)
    out = running_count(out, session, ts, F.col("_pv"), "_pvs", tiebreak, bucket_seconds)
    out = running_count(out, visitor, ts, F.col("_pv"), "_pvv", tiebreak, bucket_seconds)
    out = out.join(sessions.select(visitor, session, "visit_number"), [visitor, session], "left") \
        .join(first, visitor, "left")
    return out.withColumn("page_view_index_in_session", F.when(F.col("_pv"), F.col("_pvs"))) \
        .withColumn("page_view_index_for_visitor", F.when(F.col("_pv"), F.col("_pvv"))) \
        .withColumn("returning_visitor", F.col("visit_number") > 1).drop("_pv", "_pvs", "_pvv")


def touch_attribution(df: DataFrame, touch_cols=("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid"),
                      visitor: str = "visitor_id", session: str = "session_id",
                      ts: str = "client_timestamp", tiebreak: str = "event_id") -> DataFrame:
    """First touch (first event of the visitor carrying any attribution value,
    kept forever), session touch (latest non-empty touch so far in the session)
    and active touch = session touch, else the event's own, else first touch.

    First touch is an aggregate (``min_by``, partial aggregation, skew-safe)
    joined back on the visitor; the session touch is a bucketed running
    ``last(ignorenulls)`` per session (``scan.running_last``).
    """
    vals = [F.when(F.trim(F.col(c)) != "", F.col(c)) for c in touch_cols]
    touch = F.when(F.greatest(*[v.isNotNull() for v in vals]),
                   F.struct(*[v.alias(c) for v, c in zip(vals, touch_cols)]))
    t = df.withColumn("_touch", touch)
    first = (t.where(F.col("_touch").isNotNull())
             .groupBy(visitor).agg(F.min_by("_touch", F.struct(ts, tiebreak)).alias("first_touch")))
    from clickloom.operators.scan import running_last

    t = running_last(t, session, ts, "_touch", "session_touch", tiebreak)
    t = t.join(first, visitor, "left")
    return t.withColumn(
        "active_touch", F.coalesce(F.col("session_touch"), F.col("_touch"), F.col("first_touch"))
    ).drop("_touch")
