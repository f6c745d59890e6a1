"""Skew-safe ordered scans per key.

``Window.partitionBy(key)`` sends every row of a key to one task; with a hot
key (one visitor / session / page instance holding a large share of the rows)
that task does all the work.  These helpers split each key by time bucket:

1. the row-level window runs per (key, bucket) - a hot key is spread over as
   many tasks as it has buckets;
2. a bucket-level table (one row per key and non-empty bucket) carries the
   state across bucket boundaries with a small window per key;
3. the carry is joined back on (key, bucket) - the row side is already
   partitioned by those columns, so only the small side moves.

Results are exact (identical to the single-window form); ``bucket_seconds``
only trades parallelism against the size of the carry table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucketed(df: DataFrame, ts: str, bucket_seconds: int) -> DataFrame:
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    return df.withColumn("_b", F.floor(us / F.lit(int(bucket_seconds) * 1_000_000)))


def _order(ts: str, tiebreak: str | None) -> list:
    return [ts] + ([tiebreak] if tiebreak else [])


def prev_value(df: DataFrame, key: str, ts: str, value: Column | str, out: str, tiebreak: str | None = None,
               bucket_seconds: int = 86_400) -> DataFrame:
    """``lag(value)`` over (partition by key order by ts, tiebreak)."""
    v = F.col(value) if isinstance(value, str) else value
    t = _bucketed(df.withColumn("_v", v), ts, bucket_seconds)
    w = Window.partitionBy(key, "_b").orderBy(*_order(ts, tiebreak))
    t = t.withColumn("_p", F.lag("_v").over(w)).withColumn("_first", F.row_number().over(w) == 1)
    last = F.struct(*[F.col(c) for c in _order(ts, tiebreak)], F.col("_v").alias("_v"))
    bt = t.groupBy(key, "_b").agg(F.max(last)["_v"].alias("_blast"))
    bt = bt.withColumn("_carry", F.lag("_blast").over(Window.partitionBy(key).orderBy("_b"))).select(key, "_b", "_carry")
    j = t.join(bt, [key, "_b"], "left")
    return j.withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_p"))) \
        .drop("_v", "_b", "_p", "_first", "_carry")


def next_value(df: DataFrame, key: str, ts: str, value: Column | str, out: str, tiebreak: str | None = None,
               bucket_seconds: int = 86_400) -> DataFrame:
    """``lead(value)`` over (partition by key order by ts, tiebreak)."""
    v = F.col(value) if isinstance(value, str) else value
    t = _bucketed(df.withColumn("_v", v), ts, bucket_seconds)
    w = Window.partitionBy(key, "_b").orderBy(*_order(ts, tiebreak))
    wd = Window.partitionBy(key, "_b").orderBy(*[F.desc(c) for c in _order(ts, tiebreak)])
    t = t.withColumn("_n", F.lead("_v").over(w)).withColumn("_last", F.row_number().over(wd) == 1)
    first = F.struct(*[F.col(c) for c in _order(ts, tiebreak)], F.col("_v").alias("_v"))
    bt = t.groupBy(key, "_b").agg(F.min(first)["_v"].alias("_bfirst"))
    bt = bt.withColumn("_carry", F.lead("_bfirst").over(Window.partitionBy(key).orderBy("_b"))).select(key, "_b", "_carry")
    j = t.join(bt, [key, "_b"], "left")
    return j.withColumn(out, F.when(F.col("_last"), F.col("_carry")).otherwise(F.col("_n"))) \
        .drop("_v", "_b", "_n", "_last", "_carry")


def running_last(df: DataFrame, key: str, ts: str, value: Column | str, out: str, tiebreak: str | None = None,
                 bucket_seconds: int = 86_400) -> DataFrame:
    """``last(value, ignorenulls)`` from the start of the key up to the row."""
    v = F.col(value) if isinstance(value, str) else value
    t = _bucketed(df.withColumn("_v", v), ts, bucket_seconds)
    w = Window.partitionBy(key, "_b").orderBy(*_order(ts, tiebreak)).rowsBetween(Window.unboundedPreceding,
                                                                                   Window.currentRow)
    t = t.withColumn("_in", F.last("_v", ignorenulls=True).over(w))
    last = F.when(F.col("_v").isNotNull(), F.struct(*[F.col(c) for c in _order(ts, tiebreak)], F.col("_v").alias("_v")))
    bt = t.groupBy(key, "_b").agg(F.max(last)["_v"].alias("_blast"))
    wb = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.withColumn("_carry", F.last("_blast", ignorenulls=True).over(wb)).select(key, "_b", "_carry")
    j = t.join(bt, [key, "_b"], "left")
    return j.withColumn(out, F.coalesce("_in", "_carry")).drop("_v", "_b", "_in", "_carry")


def running_count(df: DataFrame, key: str, ts: str, cond: Column, out: str, tiebreak: str | None = None,
                  bucket_seconds: int = 86_400) -> DataFrame:
    """Rows of the key up to and including this one where ``cond`` holds."""
    return running_sum(df, key, ts, F.coalesce(cond.cast("long"), F.lit(0)), out, tiebreak, bucket_seconds)


def running_sum(df: DataFrame, key: str, ts: str, value: Column, out: str, tiebreak: str | None = None,
                bucket_seconds: int = 86_400) -> DataFrame:
    """Running sum of ``value`` (integral) per key up to and including the row."""
    t = _bucketed(df.withColumn("_c", F.coalesce(value.cast("long"), F.lit(0))), ts, bucket_seconds)
    w = Window.partitionBy(key, "_b").orderBy(*_order(ts, tiebreak)).rowsBetween(Window.unboundedPreceding,
                                                                                   Window.currentRow)
    t = t.withColumn("_in", F.sum("_c").over(w))
    bt = t.groupBy(key, "_b").agg(F.sum("_c").alias("_bsum"))
    wb = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bt = bt.withColumn("_off", F.coalesce(F.sum("_bsum").over(wb), F.lit(0))).select(key, "_b", "_off")
    j = t.join(bt, [key, "_b"], "left")
    return j.withColumn(out, (F.col("_in") + F.col("_off")).cast("bigint")).drop("_c", "_b", "_in", "_off")
