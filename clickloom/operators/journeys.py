"""Journey segmentation blocks (R-J1..R-J4) and the traffic audit (R-A1..A5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.agg import grouped_rollup, visitor_flag_counts
from clickloom.functions.json import is_true, nz, prop, with_props
from clickloom.operators.reports import is_event

LANDING_PREFIX = "/editorial/%"


def page_type() -> Column:
    """Stored page type, else derived from event name / path."""
    path = F.col("page_path")
    ev = F.col("event_name")
    derived = (
        F.when(ev.isin("checkout_started", "purchase"), "checkout")
        .when(path.like(LANDING_PREFIX) | ev.like("funnel_%"), "funnel")
        .when(path.isin("/", "") | ev.isin("sales_page_view", "product_view", "buy_button_click", "checkout_redirect"),
              "sales_page")
        .otherwise("other")
    )
    return F.coalesce(nz(prop("page_type")), derived)


def journey_type() -> Column:
    path = F.col("page_path")
    ev = F.col("event_name")
    derived = F.when(path.like(LANDING_PREFIX) | ev.like("funnel_%"), "funnel").otherwise("unclassified")
    return F.coalesce(nz(prop("journey_type")), nz(prop("checkout_attributes.ct_journey_type")), derived)


def page_types(base: DataFrame) -> DataFrame:
    """R-J1."""
    base = with_props(base)
    d = base.select("visitor_id", "session_id", "event_name", page_type().alias("page_type"))
    r = grouped_rollup(d, ["page_type"], visitor_flags={
        "funnel_view_visitors": is_event("funnel_view"),
        "sales_page_view_visitors": is_event("sales_page_view"),
        "checkout_visitors": is_event("checkout_started"),
        "purchase_visitors": is_event("purchase"),
    })
    return r.orderBy(F.desc("unique_visitors"), F.desc("events"))


def journey_types(base: DataFrame) -> DataFrame:
    """R-J2."""
    base = with_props(base)
    d = base.select("visitor_id", "session_id", "event_name", journey_type().alias("journey_type"))
    r = grouped_rollup(d, ["journey_type"], visitor_flags={
        "checkout_visitors": is_event("checkout_started"),
        "purchase_visitors": is_event("purchase"),
    })
    return r.orderBy(F.desc("purchase_visitors"), F.desc("checkout_visitors"), F.desc("unique_visitors"))


def visitor_overlap(base: DataFrame) -> DataFrame:
    """R-J3: per-visitor flags -> 8 counts.  Three-valued logic is kept: a
    visitor whose funnel flag is NULL for every row has ``saw_funnel`` NULL and
    falls out of every group that tests it."""
    base = with_props(base)
    pt = prop("page_type")
    ev = F.col("event_name")
    v = base.groupBy("visitor_id").agg(
        F.bool_or((pt == "funnel") | F.col("page_path").like(LANDING_PREFIX) | (ev == "funnel_view")).alias("f"),
        F.bool_or((pt == "sales_page") | (ev == "sales_page_view")
                  | ev.isin("product_view", "buy_button_click", "checkout_redirect")).alias("s"),
        F.bool_or(ev == "checkout_started").alias("c"),
        F.bool_or(ev == "purchase").alias("p"),
    )
    f, s, c, p = F.col("f"), F.col("s"), F.col("c"), F.col("p")
    return v.agg(
        F.count_if(f & ~s).alias("funnel_only_visitors"),
        F.count_if(s & ~f).alias("sales_page_only_visitors"),
        F.count_if(f & s).alias("funnel_and_sales_page_visitors"),
        F.count_if(~f & ~s).alias("unclassified_visitors"),
        F.count_if(f & c).alias("funnel_touched_checkout_visitors"),
        F.count_if(f & p).alias("funnel_touched_purchase_visitors"),
        F.count_if(s & c).alias("sales_page_checkout_visitors"),
        F.count_if(s & p).alias("sales_page_purchase_visitors"),
    )


def stage_flow(base: DataFrame) -> DataFrame:
    """R-J4: ten filtered distinct-visitor counts."""
    base = with_props(base)
    jt = prop("journey_type")
    sp = is_event("sales_page_view")
    return visitor_flag_counts(base, [], {
        "funnel_visitors": is_event("funnel_view"),
        "funnel_cta_impression_visitors": is_event("funnel_cta_impression"),
        "funnel_cta_click_visitors": is_event("funnel_cta_click"),
        "sales_page_visitors": sp,
        "funnel_to_sales_visitors": sp & (jt == "funnel_to_sales"),
        "funnel_assisted_sales_visitors": sp & (jt == "funnel_assisted_sales"),
        "direct_to_sales_visitors": sp & (jt == "direct_to_sales"),
        "buy_click_visitors": is_event("buy_button_click"),
        "checkout_visitors": is_event("checkout_started"),
        "purchase_visitors": is_event("purchase"),
    }, total=None)


# ----------------------------------------------------------------- audit A1-A5
def _cls() -> Column:
    return prop("traffic_classification")


def _production() -> Column:
    return F.coalesce(_cls(), F.lit("production")) == "production"


def audit_distribution(ev: DataFrame) -> DataFrame:
    """A1: distribution by classification over the whole table."""
    d = with_props(ev).select("visitor_id", "session_id", "received_at",
                              F.coalesce(_cls(), F.lit("unclassified")).alias("traffic_classification"))
    r = grouped_rollup(d, ["traffic_classification"], mins={"first_seen_at": F.col("received_at")},
                       maxs={"last_seen_at": F.col("received_at")})
    return r.orderBy(F.desc("events"))


def audit_production(ev: DataFrame) -> DataFrame:
    """A2: what remains valid for production reports."""
    d = with_props(ev).where(_production() & ~is_true(prop("test")) & ~is_true(prop("internal_traffic")))
    r = grouped_rollup(d, [], counts={
        "page_views": is_event("page_view"),
        "checkout_events": is_event("checkout_started"),
        "purchase_events": is_event("purchase"),
    }, events="production_events", visitors="production_unique_visitors", sessions="production_sessions")
    return r


def audit_duplicates(ev: DataFrame) -> DataFrame:
    """A3: shopify ids counted more than once in production (HAVING > 1)."""
    d = with_props(ev).where(nz(prop("shopify_event_id")).isNotNull() & _production())
    return (d.groupBy(prop("shopify_event_id").alias("shopify_event_id"))
            .agg(F.count(F.lit(1)).alias("production_copies"))
            .where(F.col("production_copies") > 1)
            .orderBy(F.desc("production_copies")))


def audit_reasons(ev: DataFrame) -> DataFrame:
    """A4: exclusion reasons of non-production rows."""
    d = with_props(ev).where(~_production()).select(
        "visitor_id", "session_id",
        F.coalesce(prop("traffic_classification_reason"), F.lit("unclassified")).alias("reason"))
    return grouped_rollup(d, ["reason"], sessions=None).orderBy(F.desc("events"))


def audit_campaigns(ev: DataFrame) -> DataFrame:
    """A5: campaigns still counted as production (grouped by the labelled keys)."""
    d = with_props(ev).where(_production()).select(
        "visitor_id", "session_id", "event_name",
        F.coalesce(F.col("utm_source"), F.lit("direct")).alias("source"),
        F.coalesce(F.col("utm_campaign"), F.lit("unattributed")).alias("campaign"),
    )
    r = grouped_rollup(d, ["source", "campaign"], counts={
        "checkout_events": is_event("checkout_started"),
        "purchase_events": is_event("purchase"),
    }, sessions=None)
    return r.orderBy(F.desc("events"))
