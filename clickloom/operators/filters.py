"""Filters / predicates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.config import DEVICE_TYPES, EVENT_NAME_PATTERN, SCREEN_WIDTH_MAX
from clickloom.functions.json import is_true, nz, prop, with_props


def _ts(value) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, dt.datetime):
        value = value.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(str(value)).cast("timestamp_ntz")


def period_start(as_of, days: int) -> Column:
    return _ts(as_of) - F.make_dt_interval(F.lit(int(days)))


def period_filter(df: DataFrame, as_of, days: int, col: str = "received_at",
                  partition_col: str = "event_date") -> DataFrame:
    """received_at >= as_of - days.  The predicate is pushed to the Parquet
    scan; on a table partitioned by ``event_date`` (= date of received_at) the
    implied date bound prunes whole partitions as well."""
    start = period_start(as_of, days)
    out = df.where(F.col(col) >= start)
    if partition_col in df.columns:
        out = out.where(F.col(partition_col) >= F.to_date(start))
    return out


def control_surface(pattern: str | None, col: str = "page_url") -> Column:
    """URL of the operator's own UI (case-insensitive regex); FALSE when unset."""
    if not pattern:
        return F.lit(False)
    return F.col(col).rlike("(?i)" + pattern)


def test_flag() -> Column:
    return is_true(prop("test"))


def internal_flag() -> Column:
    return is_true(prop("internal_traffic"))


def valid_predicate(control_pattern: str | None) -> Column:
    """Not test, not internal, URL not the control surface.  A NULL URL yields
    NULL (row dropped), as with the SQL negated regex match."""
    ctrl = ~control_surface(control_pattern) if control_pattern else F.col("page_url").isNotNull()
    return (~test_flag()) & (~internal_flag()) & ctrl


def valid_events(ev: DataFrame, as_of, days: int = 90, control_pattern: str | None = None) -> DataFrame:
    """the base of nearly every report block."""
    ev = with_props(ev)
    return period_filter(ev, as_of, days).where(valid_predicate(control_pattern))


def production_only(ev: DataFrame) -> DataFrame:
    """F8: classification production (missing counts as production), not test/internal."""
    ev = with_props(ev)
    cls = F.coalesce(prop("traffic_classification"), F.lit("production"))
    return ev.where((cls == "production") & ~test_flag() & ~internal_flag())


def constraint_check(ev: DataFrame) -> DataFrame:
    """table CHECK constraints as boolean columns + one row of violation counts."""
    checks = {
        "bad_event_name": ~F.coalesce(F.col("event_name").rlike(EVENT_NAME_PATTERN), F.lit(False)),
        "bad_device_type": F.col("device_type").isNotNull() & ~F.col("device_type").isin(*DEVICE_TYPES),
        "bad_screen_width": F.col("screen_width").isNotNull()
        & ~F.col("screen_width").between(0, SCREEN_WIDTH_MAX),
        "missing_required": F.col("event_id").isNull() | F.col("visitor_id").isNull()
        | F.col("session_id").isNull() | F.col("client_timestamp").isNull() | F.col("page_url").isNull(),
    }
    return ev.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(c).alias(n) for n, c in checks.items()],
    )


def dedupe_consecutive_pages(ev: DataFrame, page_instance: str = "page_instance_id",
                             ts: str = "client_timestamp", tiebreak: str = "event_id") -> DataFrame:
    """drop a page view whose URL equals the previous page view's URL on the
    same page instance (null-safe comparison), with a bucketed ``lag`` per
    page instance (``scan.prev_value``)."""
    from clickloom.operators.scan import prev_value

    pv = ev.where(F.col("event_name") == "page_view")
    # rows without a page instance cannot be compared: they pass unwindowed
    # (and never gather into one NULL partition).
    loose = pv.where(F.col(page_instance).isNull())
    keyed = prev_value(pv.where(F.col(page_instance).isNotNull()), page_instance, ts, "page_url", "_prev_url", tiebreak)
    kept = keyed.where(~F.col("_prev_url").eqNullSafe(F.col("page_url"))).drop("_prev_url")
    return kept.unionByName(loose)


def has_text(c: Column) -> Column:
    return nz(c).isNotNull()
