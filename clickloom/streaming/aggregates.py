"""Streaming aggregates over the ingested event table (ST3, ST5-ST7).

* ``stream_dedupe`` - at-least-once input to once per key inside the watermark.
* ``stream_daily`` - daily counters; the state is one row per day, so the
  complete output mode stays small however long the stream runs.
* ``stream_sessions`` - inactivity sessions with ``session_window`` and a
  watermark (append mode: a session is emitted once it can no longer grow).
* ``stream_first_touch`` - first attribution touch per visitor kept in
  per-visitor state (``applyInPandasWithState``): emitted once, never updated.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_dedupe(df: DataFrame, key: str = "event_id", event_time: str = "received_at",
                  delay: str = "1 day") -> DataFrame:
    """ST3: drop repeated keys that arrive within the watermark delay."""
    return df.withColumn("_et", F.col(event_time).cast("timestamp")).withWatermark("_et", delay) \
        .dropDuplicatesWithinWatermark([key]).drop("_et")


def stream_daily(df: DataFrame, ts: str = "client_timestamp") -> DataFrame:
    """ST7: events, page views and purchases per UTC day (R10a re-aimed)."""
    t = df.withColumn("_t", F.col(ts).cast("timestamp"))
    g = t.groupBy(F.window("_t", "1 day").alias("w")).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(F.col("event_name") == "page_view").alias("page_views"),
        F.count_if(F.col("event_name") == "purchase").alias("purchases"),
        F.approx_count_distinct("visitor_id").alias("approx_unique_visitors"),
    )
    return g.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "events", "page_views", "purchases",
                    "approx_unique_visitors")


def stream_sessions(df: DataFrame, visitor: str = "visitor_id", ts: str = "client_timestamp",
                    gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """ST5: inactivity sessions; a gap of exactly ``gap`` stays one session."""
    t = df.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", delay)
    g = t.groupBy(F.col(visitor), F.session_window("_t", gap).alias("s")).agg(F.count(F.lit(1)).alias("events"))
    return g.select(visitor, F.col("s.start").cast("timestamp_ntz").alias("session_start"),
                    F.col("s.end").cast("timestamp_ntz").alias("session_end"), "events")


FIRST_TOUCH_OUT = ("visitor_id string, first_touch_at timestamp, first_touch_source string, "
                   "first_touch_campaign string, first_touch_fbclid string")
FIRST_TOUCH_STATE = "done boolean"


def _first_touch_fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.exists:
        return  # touch already emitted for this visitor: kept forever
    frames = [p for p in pdfs if len(p)]
    if not frames:
        return
    pdf = pd.concat(frames).sort_values(["_t", "event_id"])
    for col in ("utm_source", "utm_campaign", "fbclid"):
        pdf[col] = pdf[col].where(pdf[col].fillna("").str.strip() != "", None)
    touched = pdf[pdf[["utm_source", "utm_campaign", "fbclid"]].notna().any(axis=1)]
    if touched.empty:
        return
    row = touched.iloc[0]
    state.update((True,))
    yield pd.DataFrame([{
        "visitor_id": str(key[0]), "first_touch_at": row["_t"], "first_touch_source": row["utm_source"],
        "first_touch_campaign": row["utm_campaign"], "first_touch_fbclid": row["fbclid"],
    }])


def stream_first_touch(df: DataFrame, visitor: str = "visitor_id", ts: str = "client_timestamp") -> DataFrame:
    """ST6: first touch per visitor from a stream (state: one flag per visitor)."""
    t = df.select(F.col(visitor).cast("string").alias("visitor_id"), F.col(ts).cast("timestamp").alias("_t"),
                  F.col("event_id").cast("string").alias("event_id"), "utm_source", "utm_campaign", "fbclid")
    return t.groupBy("visitor_id").applyInPandasWithState(
        _first_touch_fn, FIRST_TOUCH_OUT, FIRST_TOUCH_STATE, "append", GroupStateTimeout.NoTimeout)
