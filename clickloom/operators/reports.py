"""Report blocks (R1-R23) over valid events.

Every function takes the silver event frame (``with_props`` applied; use
``valid_events`` first unless stated) and returns a lazily defined DataFrame.
Nothing is collected.  Group keys are the raw columns; labels for missing
values are applied after grouping, so NULL and '' stay separate groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.config import (
    CONVERSION_EVENTS,
    LABEL_DIRECT_CAMPAIGN,
    LABEL_DIRECT_SOURCE,
    LABEL_NO_REFERRER,
    LABEL_NOT_INFORMED,
    LABEL_UNKNOWN,
    TAXONOMY_KEYS,
)
from clickloom.functions.agg import combine_rows, exact_percentiles, grouped_rollup, top_k, visitor_flag_counts, zsum
from clickloom.functions.json import LINE_ITEM, guarded_number, has_any_key, loose_number, nz, prop, with_props
from clickloom.functions.stats import safe_divide
from clickloom.operators.filters import control_surface, internal_flag, period_filter, test_flag, valid_predicate
from clickloom.operators.sessions import latest_by

TS = "client_timestamp"


def is_event(*names: str) -> Column:
    ev = F.col("event_name")
    return ev == names[0] if len(names) == 1 else ev.isin(*names)


def first_touch_or(col: str, key: str | None = None) -> Column:
    """coalesce(nullif(col,''), nullif(first_touch.key,''))."""
    return F.coalesce(nz(F.col(col)), nz(prop(f"first_touch.{key or col}")))


def storage_version() -> Column:
    return F.coalesce((nz(prop("session_storage_version"))).try_cast("int"), F.lit(1))


# --------------------------------------------------------------------------- R1
def exclusion_audit(ev: DataFrame, as_of, days: int, control_pattern: str | None) -> DataFrame:
    """Counts of excluded rows in the period (categories may overlap)."""
    ev = period_filter(with_props(ev), as_of, days)
    return ev.agg(
        F.count(F.lit(1)).alias("total_rows_in_period"),
        F.count_if(test_flag()).alias("test_events"),
        F.count_if(internal_flag()).alias("internal_traffic_events"),
        F.count_if(control_surface(control_pattern)).alias("control_surface_events"),
        F.count_if(valid_predicate(control_pattern)).alias("valid_external_events"),
    )


# --------------------------------------------------------------------------- R2
_STAGE_COUNTS = {
    "page_views": "page_view",
    "cta_impressions": "cta_impression",
    "buy_clicks": "buy_button_click",
    "add_to_cart": "add_to_cart",
    "checkouts": "checkout_started",
    "purchases": "purchase",
}


def overview(base: DataFrame) -> DataFrame:
    """Global totals; a session counts as v2/v3 when any of its events has
    storage version >= 2 / >= 3 (max per session)."""
    g1 = base.groupBy("session_id", "visitor_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.min(TS).alias("_first"),
        F.max(TS).alias("_last"),
        F.max(storage_version()).alias("_ver"),
        *[F.count_if(is_event(e)).alias(f"_{n}") for n, e in _STAGE_COUNTS.items()],
    )
    return g1.agg(
        zsum(F.col("_n")).cast("bigint").alias("total_events"),
        F.count_distinct("session_id").alias("sessions"),
        F.count_distinct("visitor_id").alias("unique_visitors"),
        F.min("_first").alias("first_event_at"),
        F.max("_last").alias("latest_event_at"),
        *[zsum(F.col(f"_{n}")).cast("bigint").alias(n) for n in _STAGE_COUNTS],
        F.expr("count(DISTINCT session_id) FILTER (WHERE _ver >= 2)").alias("session_v2_sessions"),
        F.expr("count(DISTINCT session_id) FILTER (WHERE _ver >= 3)").alias("session_v3_sessions"),
    )


def overview_basic(base: DataFrame) -> DataFrame:
    """Overview without storage versions (fallback export)."""
    return overview(base).drop("session_v2_sessions", "session_v3_sessions")


def _session_table(base: DataFrame, entry_cols: dict[str, Column], extra_aggs: list[Column]) -> DataFrame:
    """One aggregate per session: entry attributes of its first event via
    ``min_by`` plus any rollup measures - no self-join."""
    payload = F.struct(*[c.alias(n) for n, c in entry_cols.items()])
    order = F.struct(F.col(TS), F.col("event_id"))
    agg = base.groupBy("session_id").agg(F.min_by(payload, order).alias("_e"), *extra_aggs)
    others = [c for c in agg.columns if c not in ("session_id", "_e")]
    return agg.select("session_id", *[F.col(f"_e.{n}").alias(n) for n in entry_cols], *others)


def overview_sessions(base: DataFrame) -> DataFrame:
    """Overview over session entries (first event of each session)."""
    s = _session_table(
        base,
        {
            "visitor_id": F.col("visitor_id"),
            "started": F.col(TS),
            "version": storage_version(),
            "campaign": first_touch_or("utm_campaign"),
            "fbclid": first_touch_or("fbclid"),
        },
        [],
    )
    per_visitor = s.groupBy("visitor_id").agg(F.count(F.lit(1)).alias("n"))
    vstats = per_visitor.agg(
        F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("max_sessions_per_visitor"),
        F.count_if(F.col("n") > 1).alias("visitors_with_multiple_sessions"),
        F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_sessions_per_visitor"),
    )
    sstats = s.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.count_distinct("visitor_id").alias("unique_visitors"),
        F.min("started").alias("first_session_at"),
        F.max("started").alias("latest_session_at"),
        F.count_if(F.col("version") >= 2).alias("session_v2_sessions"),
        F.count_if(F.col("version") >= 3).alias("session_v3_sessions"),
        F.count_if(F.col("campaign").isNotNull()).alias("attributed_sessions"),
        F.expr("count(DISTINCT visitor_id) FILTER (WHERE campaign IS NOT NULL)").alias("attributed_visitors"),
        F.count_distinct("fbclid").alias("distinct_fbclid"),
    )
    total = base.agg(F.count(F.lit(1)).alias("total_events"))
    return combine_rows(total, sstats, vstats)


# --------------------------------------------------------------------------- R3
_FUNNEL_FLAGS = {
    "page_view_visitors": "page_view",
    "cta_impression_visitors": "cta_impression",
    "buy_click_visitors": "buy_button_click",
    "add_to_cart_visitors": "add_to_cart",
    "checkout_visitors": "checkout_started",
    "purchase_visitors": "purchase",
}


def funnel_unique_visitors(base: DataFrame) -> DataFrame:
    """Distinct visitors overall and per stage (P1: per-visitor flags)."""
    return visitor_flag_counts(base, [], {n: is_event(e) for n, e in _FUNNEL_FLAGS.items()})


# --------------------------------------------------------------------------- R4
def event_catalog(base: DataFrame) -> DataFrame:
    """By event name; order events desc, name."""
    r = grouped_rollup(base, ["event_name"], mins={"first_seen_at": F.col(TS)}, maxs={"last_seen_at": F.col(TS)})
    return r.select("event_name", "events", "unique_visitors", "sessions", "first_seen_at", "last_seen_at") \
        .orderBy(F.desc("events"), "event_name")


# --------------------------------------------------------------------------- R5
def _campaign_sessions(base: DataFrame, with_click_ids: bool) -> DataFrame:
    entry = {
        "visitor_id": F.col("visitor_id"),
        "source": first_touch_or("utm_source"),
        "medium": first_touch_or("utm_medium"),
        "campaign": first_touch_or("utm_campaign"),
        "creative": first_touch_or("utm_content"),
        "term": first_touch_or("utm_term"),
    }
    flags = {
        "cta_impression": "cta_impression",
        "buy_click": "buy_button_click",
        "checkout": "checkout_started",
        "purchase": "purchase",
    }
    if with_click_ids:
        entry["fbclid"] = first_touch_or("fbclid")
        flags["add_to_cart"] = "add_to_cart"
    aggs = [F.bool_or(is_event(e)).alias(n) for n, e in flags.items()] + [F.count(F.lit(1)).alias("session_events")]
    return _session_table(base, entry, aggs)


def campaigns(base: DataFrame, with_click_ids: bool = False) -> DataFrame:
    """By the session's first-event source / medium / campaign /
    creative / term; sessions, visitors, visitors per stage, total events."""
    s = _campaign_sessions(base, with_click_ids)
    keys = ["source", "medium", "campaign", "creative", "term"]
    stages = ["cta_impression", "buy_click"] + (["add_to_cart"] if with_click_ids else []) + ["checkout", "purchase"]
    aggs = [F.count(F.lit(1)).alias("sessions"), F.count_distinct("visitor_id").alias("unique_visitors")]
    if with_click_ids:
        aggs.append(F.count_distinct("fbclid").alias("distinct_fbclid"))
    aggs += [F.expr(f"count(DISTINCT visitor_id) FILTER (WHERE coalesce({st}, false))").alias(f"{st}_visitors")
             for st in stages]
    aggs.append(zsum(F.col("session_events")).cast("bigint").alias("total_events"))
    g = s.groupBy(*keys).agg(*aggs)
    out = g.select(
        F.coalesce("source", F.lit(LABEL_DIRECT_SOURCE)).alias("source"),
        "medium",
        F.coalesce("campaign", F.lit(LABEL_DIRECT_CAMPAIGN)).alias("campaign"),
        F.coalesce("creative", F.lit(LABEL_NOT_INFORMED)).alias("creative"),
        "term",
        *[c for c in g.columns if c not in keys],
    )
    return out.orderBy(F.desc("purchase_visitors"), F.desc("checkout_visitors"), F.desc("unique_visitors"))


# --------------------------------------------------------------------------- R6
def _summary_num(key: str) -> Column:
    return F.when(is_event("session_summary"), loose_number(prop(key)))


def session_journeys(base: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per session (entry attributes + rollup); newest first."""
    entry = {
        "visitor_id": F.col("visitor_id"),
        "started_at": F.col(TS),
        "landing_page": F.col("page_url"),
        "referrer": F.col("referrer"),
        "device_type": F.col("device_type"),
        "screen_width": F.col("screen_width"),
        "language": F.col("language"),
        "source": first_touch_or("utm_source"),
        "medium": first_touch_or("utm_medium"),
        "campaign": first_touch_or("utm_campaign"),
        "creative": first_touch_or("utm_content"),
        "session_storage_version": storage_version(),
    }
    aggs = [
        F.min(TS).alias("first_event_at"),
        F.max(TS).alias("last_event_at"),
        F.count(F.lit(1)).alias("event_count"),
        F.array_join(F.array_sort(F.collect_set("event_name")), ",").alias("event_names"),
        F.bool_or(is_event("cta_impression")).alias("cta_impression"),
        F.bool_or(is_event("buy_button_click")).alias("buy_click"),
        F.bool_or(is_event("checkout_started")).alias("checkout"),
        F.bool_or(is_event("purchase")).alias("purchase"),
        F.count_if(is_event("javascript_error")).alias("javascript_errors"),
        F.count_if(is_event("session_summary")).alias("summaries"),
        F.max(_summary_num("visible_seconds")).alias("visible_seconds"),
        F.max(_summary_num("max_scroll_depth")).alias("max_scroll_depth"),
        F.max(_summary_num("sections_viewed")).alias("sections_viewed"),
    ]
    s = _session_table(base, entry, aggs)
    return top_k(s, [F.desc("started_at"), F.desc("session_id")], limit)


def latest_page_summary(base: DataFrame) -> DataFrame:
    """Latest session_summary per (session, page instance or session)."""
    summ = base.where(is_event("session_summary")).withColumn(
        "page_instance_key", F.coalesce(nz(prop("page_instance_id")), F.col("session_id").cast("string"))
    )

    def num0(k: str) -> Column:
        return F.coalesce(loose_number(prop(k)), F.lit(0.0))

    return latest_by(
        summ,
        ["session_id", "page_instance_key"],
        {
            "visible_seconds": num0("visible_seconds"),
            "duration_seconds": num0("duration_seconds"),
            "max_scroll_depth": num0("max_scroll_depth"),
            "sections_viewed": num0("sections_viewed"),
            "rage_click_count": num0("rage_click_count"),
            "dead_click_count": num0("dead_click_count"),
            "quick_exit": prop("quick_exit"),
        },
        [F.col(TS), F.col("event_id")],
    )


def session_journeys_pages(base: DataFrame, limit: int | None = None) -> DataFrame:
    """R6a plus add_to_cart, page instances and the per-page latest
    summaries summed per session (all pages quick-exit = bool_and)."""
    entry = {
        "visitor_id": F.col("visitor_id"),
        "started_at": F.col(TS),
        "landing_page": F.col("page_url"),
        "referrer": F.col("referrer"),
        "device_type": F.col("device_type"),
        "screen_width": F.col("screen_width"),
        "language": F.col("language"),
        "source": first_touch_or("utm_source"),
        "medium": first_touch_or("utm_medium"),
        "campaign": first_touch_or("utm_campaign"),
        "creative": first_touch_or("utm_content"),
        "fbclid": first_touch_or("fbclid"),
        "session_storage_version": storage_version(),
        "session_started_at": prop("session_started_at"),
    }
    aggs = [
        F.min(TS).alias("first_event_at"),
        F.max(TS).alias("last_event_at"),
        F.count(F.lit(1)).alias("event_count"),
        F.array_join(F.array_sort(F.collect_set("event_name")), ",").alias("event_names"),
        F.bool_or(is_event("cta_impression")).alias("cta_impression"),
        F.bool_or(is_event("buy_button_click")).alias("buy_click"),
        F.bool_or(is_event("add_to_cart")).alias("add_to_cart"),
        F.bool_or(is_event("checkout_started")).alias("checkout"),
        F.bool_or(is_event("purchase")).alias("purchase"),
        F.count_if(is_event("javascript_error")).alias("javascript_errors"),
        F.count_if(is_event("session_summary")).alias("summaries"),
        F.count_distinct(nz(prop("page_instance_id"))).alias("page_instances"),
    ]
    s = _session_table(base, entry, aggs)
    summ = latest_page_summary(base).groupBy("session_id").agg(
        F.sum("visible_seconds").alias("visible_seconds"),
        F.sum("duration_seconds").alias("duration_seconds"),
        F.max("max_scroll_depth").alias("max_scroll_depth"),
        F.sum("sections_viewed").alias("sections_viewed"),
        F.sum("rage_click_count").alias("rage_click_count"),
        F.sum("dead_click_count").alias("dead_click_count"),
        F.bool_and(F.col("quick_exit") == "true").alias("all_pages_quick_exit"),
    )
    # Both sides are aggregates keyed by session_id: hash-partitioned on the
    # same key, so the join adds no further shuffle of the event rows.
    j = s.join(summ, "session_id", "left")
    return top_k(j, [F.desc("started_at"), F.desc("session_id")], limit)


# --------------------------------------------------------------------------- R7
def conversion_report(base: DataFrame, limit: int | None = None, extended: bool = False) -> DataFrame:
    """Checkout / purchase rows with the stored attribution fields."""
    c = base.where(is_event(*CONVERSION_EVENTS))
    cols = [
        "event_id", "event_name", "visitor_id", F.col("session_id").alias("actual_session_id"), TS,
        "received_at", "utm_source", "utm_medium", "utm_campaign", "utm_content", "fbclid",
        F.coalesce(prop("checkout_id"), prop("checkout_token"), prop("conversion_attribution.checkout_id")).alias("checkout_id"),
        F.coalesce(prop("order_id"), prop("conversion_attribution.order_id")).alias("order_id"),
        prop("conversion_attribution.visitor_id").alias("attributed_visitor_id"),
        prop("conversion_attribution.session_id").alias("attributed_session_id"),
        prop("conversion_attribution.method").alias("attribution_method"),
        prop("conversion_attribution.confidence").alias("attribution_confidence"),
        prop("conversion_attribution.cross_session").alias("cross_session"),
    ]
    if extended:
        cols += [
            prop("conversion_attribution.identifier_source").alias("identifier_source"),
            prop("conversion_attribution.lookback_days").alias("attribution_lookback_days"),
        ]
    cols.append("properties")
    out = c.select(*cols)
    return top_k(out, [F.desc(TS), F.desc("received_at"), F.desc("event_id")], limit)


def attribution_summary(base: DataFrame) -> DataFrame:
    """Resolved / unresolved / cross-session conversion counts."""
    c = base.where(is_event(*CONVERSION_EVENTS))
    resolved = prop("conversion_attribution.session_id").isNotNull()
    return c.agg(
        F.count(F.lit(1)).alias("conversion_events"),
        F.count_if(resolved).alias("resolved_events"),
        F.count_if(~resolved).alias("unresolved_events"),
        F.count_if(prop("conversion_attribution.cross_session") == "true").alias("cross_session_events"),
    )


# --------------------------------------------------------------------------- R8
def data_quality(base: DataFrame) -> DataFrame:
    """Page-view data quality counters + summary coverage."""
    pv = base.where(is_event("page_view"))
    src = F.lower(F.coalesce(F.col("utm_source"), prop("first_touch.utm_source"), F.lit("")))
    q = pv.agg(
        F.count(F.lit(1)).alias("page_views"),
        F.count_if(F.col("visitor_id").isNull()).alias("missing_visitor_id"),
        F.count_if(F.col("session_id").isNull()).alias("missing_session_id"),
        F.count_if(nz(F.col("page_url")).isNull()).alias("missing_page_url"),
        F.count_if(nz(F.col("device_type")).isNull()).alias("missing_device_type"),
        F.count_if(nz(F.col("utm_campaign")).isNull() & nz(prop("first_touch.utm_campaign")).isNull()).alias("missing_campaign"),
        F.count_if(src.isin("facebook", "fb", "meta")
                   & nz(F.coalesce(F.col("fbclid"), prop("first_touch.fbclid"))).isNull()).alias("facebook_without_fbclid"),
        F.count_if(storage_version() >= 2).alias("v2_page_views"),
        F.count_if(storage_version() >= 3).alias("v3_page_views"),
    )
    s = base.where(is_event("session_summary")).agg(
        F.count(F.lit(1)).alias("summaries"), F.count_distinct("session_id").alias("summary_sessions")
    )
    return combine_rows(q, s)


# --------------------------------------------------------------------------- R9
def property_keys(base: DataFrame) -> DataFrame:
    """Occurrences of each top-level property key."""
    k = base.select(F.explode(F.json_object_keys("properties")).alias("key"))
    return k.groupBy("key").agg(F.count(F.lit(1)).alias("occurrences")).orderBy(F.desc("occurrences"), "key")


# --------------------------------------------------------------------------- R10
_DAILY_COUNTS = {
    "page_views": "page_view",
    "cta_impressions": "cta_impression",
    "buy_clicks": "buy_button_click",
    "checkouts": "checkout_started",
    "purchases": "purchase",
}


def daily_series(base: DataFrame, with_revenue: bool = False) -> DataFrame:
    """By UTC day of the client timestamp."""
    d = base.withColumn("day", F.date_trunc("day", F.col(TS)))
    sums = {"revenue": F.when(is_event("purchase"), loose_number(prop("value")))} if with_revenue else None
    r = grouped_rollup(d, ["day"], counts={n: is_event(e) for n, e in _DAILY_COUNTS.items()}, sums=sums)
    if with_revenue:
        r = r.withColumn("revenue", F.coalesce(F.col("revenue"), F.lit(0.0)))
    return r.orderBy("day")


# --------------------------------------------------------------------------- R11-R13
def pages(base: DataFrame, limit: int | None = None) -> DataFrame:
    """By url, path, title."""
    r = grouped_rollup(base, ["page_url", "page_path", "page_title"], counts={
        "page_views": is_event("page_view"),
        "checkouts": is_event("checkout_started"),
        "purchases": is_event("purchase"),
    })
    return top_k(r, [F.desc("unique_visitors"), F.desc("events"), F.asc_nulls_first("page_url"),
                     F.asc_nulls_first("page_path"), F.asc_nulls_first("page_title")], limit)


def pages_by_path(base: DataFrame, limit: int | None = None) -> DataFrame:
    """By path, title; top by events."""
    r = grouped_rollup(base, ["page_path", "page_title"])
    return top_k(r, [F.desc("events"), F.asc_nulls_first("page_path"), F.asc_nulls_first("page_title")], limit)


def referrers(base: DataFrame, limit: int | None = None) -> DataFrame:
    """Page views by raw referrer (NULL and '' stay separate), label after."""
    r = grouped_rollup(base.where(is_event("page_view")), ["referrer"])
    r = top_k(r, [F.desc("sessions"), F.desc("events"), F.asc_nulls_first("referrer")], limit)
    return r.select(F.coalesce(nz(F.col("referrer")), F.lit(LABEL_NO_REFERRER)).alias("referrer"),
                    "events", "unique_visitors", "sessions")


def devices(base: DataFrame, limit: int | None = None) -> DataFrame:
    """By raw device type, width, language."""
    keys = ["device_type", "screen_width", "language"]
    r = grouped_rollup(base, keys, counts={"checkouts": is_event("checkout_started"), "purchases": is_event("purchase")})
    r = top_k(r, [F.desc("unique_visitors"), F.desc("events")] + [F.asc_nulls_first(k) for k in keys], limit)
    return r.withColumn("device_type", F.coalesce("device_type", F.lit(LABEL_UNKNOWN)))


def devices_network(base: DataFrame) -> DataFrame:
    """By device, width, language, viewport, connection, country."""
    d = base.select(
        "visitor_id", "session_id", "device_type", "screen_width", "language",
        prop("viewport_width").alias("viewport_width"), prop("viewport_height").alias("viewport_height"),
        prop("effective_connection_type").alias("effective_connection_type"), prop("country").alias("country"),
    )
    keys = ["device_type", "screen_width", "language", "viewport_width", "viewport_height",
            "effective_connection_type", "country"]
    r = grouped_rollup(d, keys)
    return r.withColumn("device_type", F.coalesce("device_type", F.lit(LABEL_UNKNOWN))) \
        .orderBy(F.desc("sessions"), F.desc("events"))


# --------------------------------------------------------------------------- R14
def products(base: DataFrame) -> DataFrame:
    """By product / variant / name / currency (first line item as fallback)."""
    d = base.where(is_event("cta_impression", "buy_button_click", "add_to_cart", "checkout_started", "purchase"))
    items = prop("line_items")
    d = d.select(
        "visitor_id", "session_id", "event_name",
        F.coalesce(prop("product_id"), F.get_json_object(items, "$[0].product_id"), F.lit(LABEL_UNKNOWN)).alias("product_id"),
        F.coalesce(prop("variant_id"), F.get_json_object(items, "$[0].variant_id"), F.lit(LABEL_UNKNOWN)).alias("variant_id"),
        F.coalesce(prop("product_name"), F.get_json_object(items, "$[0].product_title"), F.lit(LABEL_UNKNOWN)).alias("product_name"),
        F.coalesce(prop("currency"), F.lit(LABEL_UNKNOWN)).alias("currency"),
        guarded_number(prop("value")).alias("_value"),
    )
    keys = ["product_id", "variant_id", "product_name", "currency"]
    r = grouped_rollup(d, keys, counts={"checkouts": is_event("checkout_started"), "purchases": is_event("purchase")},
                       sessions=None, avgs={"avg_value": F.col("_value")})
    return r.orderBy(F.desc("purchases"), F.desc("checkouts"), F.desc("unique_visitors"))


def products_line_items(base: DataFrame) -> DataFrame:
    """One row per line item (non-array values contribute nothing)."""
    raw = prop("line_items")
    arr = F.when(F.ltrim(raw).startswith("["), F.from_json(raw, LINE_ITEM))
    it = base.select("visitor_id", "session_id", F.explode(arr).alias("item"))
    d = it.select(
        "visitor_id", "session_id",
        F.col("item.product_id").alias("product_id"), F.col("item.variant_id").alias("variant_id"),
        F.col("item.product_title").alias("product_title"), F.col("item.variant_title").alias("variant_title"),
        loose_number(F.col("item.quantity")).alias("_q"), loose_number(F.col("item.price")).alias("_p"),
    )
    keys = ["product_id", "variant_id", "product_title", "variant_title"]
    r = grouped_rollup(d, keys, sums={"total_quantity": F.col("_q")}, mins={"minimum_price": F.col("_p")},
                       maxs={"maximum_price": F.col("_p")})
    r = r.withColumn("total_quantity", F.coalesce("total_quantity", F.lit(0.0)))
    return r.select(*keys, "events", "unique_visitors", "sessions", "total_quantity", "minimum_price",
                    "maximum_price").orderBy(F.desc("events"))


# --------------------------------------------------------------------------- R15
def javascript_errors(base: DataFrame, limit: int | None = None) -> DataFrame:
    """By message, file, kind."""
    d = base.where(is_event("javascript_error")).select(
        "visitor_id", "session_id", TS,
        prop("message").alias("message"), prop("filename").alias("filename"), prop("kind").alias("kind"),
    )
    keys = ["message", "filename", "kind"]
    r = grouped_rollup(d, keys, mins={"first_seen_at": F.col(TS)}, maxs={"last_seen_at": F.col(TS)})
    return top_k(r, [F.desc("events")] + [F.asc_nulls_first(k) for k in keys], limit)


# --------------------------------------------------------------------------- R16
def cta_performance(base: DataFrame) -> DataFrame:
    """By placement, element text."""
    d = base.where(is_event("cta_impression", "buy_button_click", "cta_click_context")).select(
        "visitor_id", "session_id", "event_name",
        F.coalesce(prop("placement"), F.lit(LABEL_UNKNOWN)).alias("placement"),
        F.coalesce(prop("element_text"), F.lit(LABEL_UNKNOWN)).alias("element_text"),
        guarded_number(prop("visible_ms_before_impression")).alias("_vis"),
    )
    click = is_event("buy_button_click", "cta_click_context")
    keys = ["placement", "element_text"]
    r = grouped_rollup(d, keys, counts={"impressions": is_event("cta_impression"), "clicks": click},
                       visitor_flags={"impression_visitors": is_event("cta_impression"), "click_visitors": click},
                       events=None, visitors=None, sessions=None,
                       avgs={"avg_visible_ms_before_impression": F.col("_vis")})
    return r.select(*keys, "impressions", "impression_visitors", "clicks", "click_visitors",
                    "avg_visible_ms_before_impression").orderBy(F.desc("click_visitors"), F.desc("impression_visitors"))


def cta_by_creative(base: DataFrame) -> DataFrame:
    """By placement, product, creative; averages and click rate."""
    d = base.where(is_event("cta_impression", "buy_button_click")).select(
        "visitor_id", "session_id", "event_name",
        F.coalesce(prop("placement"), F.lit(LABEL_UNKNOWN)).alias("placement"),
        F.coalesce(prop("product_id"), F.lit(LABEL_UNKNOWN)).alias("product_id"),
        F.coalesce(F.col("utm_content"), prop("first_touch.utm_content"), F.lit(LABEL_NOT_INFORMED)).alias("creative"),
        F.when(is_event("buy_button_click"), loose_number(prop("seconds_to_click"))).alias("_stc"),
        F.when(is_event("buy_button_click"), loose_number(prop("seconds_visible"))).alias("_sv"),
    )
    keys = ["placement", "product_id", "creative"]
    click = is_event("buy_button_click")
    r = grouped_rollup(d, keys, counts={"impressions": is_event("cta_impression"), "clicks": click},
                       visitor_flags={"impression_visitors": is_event("cta_impression"), "click_visitors": click},
                       events=None, visitors=None, sessions=None,
                       avgs={"avg_seconds_to_click": F.col("_stc"), "avg_visible_seconds_before_click": F.col("_sv")})
    r = r.withColumn("impression_to_click_rate", safe_divide("click_visitors", "impression_visitors"))
    return r.select(*keys, "impressions", "impression_visitors", "clicks", "click_visitors", "avg_seconds_to_click",
                    "avg_visible_seconds_before_click", "impression_to_click_rate") \
        .orderBy(F.desc("click_visitors"), F.desc("impression_visitors"))


# --------------------------------------------------------------------------- R17
def sections(base: DataFrame, engagement_only_ms: bool = False) -> DataFrame:
    """R17a (all rows, guarded) / R17b (engagement rows only, unguarded)."""
    if engagement_only_ms:
        ms = F.when(is_event("section_engagement"), loose_number(prop("visible_ms")))
    else:
        ms = guarded_number(prop("visible_ms"))
    d = base.where(is_event("section_view", "section_engagement")).select(
        "visitor_id", "session_id", "event_name",
        F.coalesce(prop("section_key"), prop("chapter"), prop("section_id"), F.lit(LABEL_UNKNOWN)).alias("section_key"),
        ms.alias("_ms"),
    )
    r = grouped_rollup(d, ["section_key"],
                       counts={"views": is_event("section_view"), "engagement_events": is_event("section_engagement")},
                       visitor_flags={"view_visitors": is_event("section_view"),
                                      "engaged_visitors": is_event("section_engagement")},
                       events=None, visitors=None, sessions=None, sums={"total_visible_ms": F.col("_ms")},
                       avgs={"avg_visible_ms": F.col("_ms")})
    return r.select("section_key", "views", "view_visitors", "engagement_events", "engaged_visitors",
                    "avg_visible_ms", "total_visible_ms") \
        .orderBy(F.desc("view_visitors"), F.desc_nulls_last("total_visible_ms"))


# --------------------------------------------------------------------------- R18
def web_performance(base: DataFrame, extended: bool = False, approx: bool = False) -> DataFrame:
    """Performance samples.  ``extended`` is the older variant (unguarded
    casts + p50 TTFB).  Percentiles are exact (= percentile_cont) and computed
    in two steps (``exact_percentiles``); ``approx`` switches to
    ``percentile_approx``."""
    num = loose_number if extended else guarded_number
    d = base.where(is_event("page_performance", "session_summary")).select(
        "visitor_id", *[num(prop(k)).alias(k) for k in ("ttfb_ms", "lcp_ms", "inp_ms", "cls", "load_ms")]
    )

    wanted = {"p50_ttfb_ms": ("ttfb_ms", 0.5)} if extended else {}
    wanted |= {"p75_lcp_ms": ("lcp_ms", 0.75), "p75_inp_ms": ("inp_ms", 0.75), "p75_cls": ("cls", 0.75)}
    plain = d.agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("visitor_id").alias("unique_visitors"),
                  F.avg("ttfb_ms").alias("avg_ttfb_ms"), F.avg("load_ms").alias("avg_load_ms"))
    if approx:
        pct = d.agg(*[F.percentile_approx(c, q, 10000).cast("double").alias(n) for n, (c, q) in wanted.items()])
    else:
        pct = exact_percentiles(d, wanted)
    return combine_rows(plain, pct).select("samples", "unique_visitors", "avg_ttfb_ms", *wanted, "avg_load_ms")


# --------------------------------------------------------------------------- R19
def interaction_anomalies(base: DataFrame, limit: int | None = None) -> DataFrame:
    """By anomaly type, element tag, element text."""
    d = base.where(is_event("interaction_anomaly")).select(
        "visitor_id", "session_id",
        F.coalesce(prop("anomaly_type"), F.lit(LABEL_UNKNOWN)).alias("anomaly_type"),
        prop("element_tag").alias("element_tag"), prop("element_text").alias("element_text"),
    )
    keys = ["anomaly_type", "element_tag", "element_text"]
    r = grouped_rollup(d, keys)
    return top_k(r, [F.desc("events")] + [F.asc_nulls_first(k) for k in keys], limit)


# --------------------------------------------------------------------------- R20
def identity_integrity(base: DataFrame, checkout_only: bool = False) -> DataFrame:
    """R20a (checkout or purchase) / R20b (checkout only, + rates and warning).

    Per-visitor flags replace the distinct-visitor join; a NULL visitor counts
    as one distinct value but never matches (as in SQL)."""
    conv_names = ("checkout_started",) if checkout_only else CONVERSION_EVENTS
    resolved = is_event(*CONVERSION_EVENTS) & nz(prop("conversion_attribution.session_id")).isNotNull()
    v = base.groupBy("visitor_id").agg(
        F.bool_or(is_event("page_view")).alias("pv"),
        F.bool_or(is_event(*conv_names)).alias("conv"),
        F.count_if(resolved).alias("resolved"),
        F.count_if(is_event(*CONVERSION_EVENTS)).alias("conv_events"),
    )
    matched = F.col("conv") & F.col("pv") & F.col("visitor_id").isNotNull()
    label = "checkout" if checkout_only else "conversion"
    out = v.agg(
        F.count_if("pv").alias("page_view_visitors"),
        F.count_if("conv").alias(f"{label}_visitors"),
        F.count_if(matched).alias(f"{label}_visitors_with_page_view"),
        F.count_if(F.col("conv") & ~matched).alias(f"orphan_{label}_visitors"),
        zsum(F.col("resolved")).cast("bigint").alias("conversions_with_resolved_attribution"),
        zsum(F.col("conv_events")).cast("bigint").alias("conversion_events"),
    )
    if checkout_only:
        out = out.select(
            "*",
            safe_divide("checkout_visitors_with_page_view", "checkout_visitors").alias("checkout_identity_match_rate"),
            safe_divide("conversions_with_resolved_attribution", "conversion_events").alias("attribution_resolution_rate"),
            F.when(F.col("orphan_checkout_visitors") > 0,
                   F.lit("checkouts whose visitor has no page_view: fix identity continuity before "
                         "computing landing-to-checkout rates")).alias("warning"),
        )
    return out


# --------------------------------------------------------------------------- R21
def time_to_conversion(base: DataFrame) -> DataFrame:
    """Per-visitor first stage times, then average transition seconds
    where the later stage is not earlier."""
    stage = {"first_page_view": "page_view", "first_cta_impression": "cta_impression",
             "first_buy_click": "buy_button_click", "first_checkout": "checkout_started",
             "first_purchase": "purchase"}
    v = base.groupBy("visitor_id").agg(*[F.min(F.when(is_event(e), F.col(TS))).alias(n) for n, e in stage.items()])

    def micros(a: str, b: str) -> Column:
        us = F.unix_micros(F.col(a).cast("timestamp")) - F.unix_micros(F.col(b).cast("timestamp"))
        return F.when(F.col(a) >= F.col(b), us)

    def secs(a: str, b: str) -> Column:  # exact integer sum, one division at the end
        return F.avg(micros(a, b)) / 1e6

    return v.agg(
        F.count_if(F.col("first_page_view").isNotNull()).alias("visitors_with_page_view"),
        F.count_if(F.col("first_checkout").isNotNull()).alias("visitors_with_checkout"),
        F.count_if(F.col("first_purchase").isNotNull()).alias("visitors_with_purchase"),
        secs("first_cta_impression", "first_page_view").alias("avg_seconds_page_to_cta"),
        secs("first_buy_click", "first_cta_impression").alias("avg_seconds_cta_to_click"),
        secs("first_checkout", "first_page_view").alias("avg_seconds_page_to_checkout"),
        secs("first_purchase", "first_checkout").alias("avg_seconds_checkout_to_purchase"),
    )


# --------------------------------------------------------------------------- R22
def visitor_cohorts(base: DataFrame) -> DataFrame:
    """Cohorts by first page-view day; share of visitors with a checkout /
    purchase within 1/7/7/30 days (inclusive interval).

    The correlated EXISTS becomes one equi-join on visitor between the
    first-touch table (one row per visitor) and the conversion rows, with the
    interval as a residual predicate; all four horizons in one pass."""
    ft = base.where(is_event("page_view")).groupBy("visitor_id").agg(F.min(TS).alias("fpv"))
    conv = base.where(is_event("checkout_started", "purchase")).select("visitor_id", "event_name", F.col(TS).alias("cts"))
    day = F.expr("INTERVAL 1 DAY")

    def within(name: str, days: int) -> Column:
        return is_event(name) & (F.col("cts") >= F.col("fpv")) & (F.col("cts") <= F.col("fpv") + days * day)

    hits = conv.join(ft, "visitor_id").groupBy("visitor_id").agg(
        F.bool_or(within("checkout_started", 1)).alias("c1"),
        F.bool_or(within("checkout_started", 7)).alias("c7"),
        F.bool_or(within("purchase", 7)).alias("p7"),
        F.bool_or(within("purchase", 30)).alias("p30"),
    )
    j = ft.join(hits, "visitor_id", "left")
    return j.groupBy(F.date_trunc("day", "fpv").alias("cohort_day")).agg(
        F.count(F.lit(1)).alias("visitors"),
        F.count_if(F.col("c1")).alias("checkout_within_1d"),
        F.count_if(F.col("c7")).alias("checkout_within_7d"),
        F.count_if(F.col("p7")).alias("purchase_within_7d"),
        F.count_if(F.col("p30")).alias("purchase_within_30d"),
    ).orderBy("cohort_day")


# --------------------------------------------------------------------------- R23
def creative_taxonomy(base: DataFrame, with_sessions: bool = False) -> DataFrame:
    """Rows carrying any taxonomy key, grouped by the eight keys."""
    d = base.where(has_any_key(TAXONOMY_KEYS)).select(
        "visitor_id", "session_id", "event_name",
        *[F.coalesce(prop(k), F.lit(LABEL_NOT_INFORMED)).alias(k) for k in TAXONOMY_KEYS],
    )
    r = grouped_rollup(d, list(TAXONOMY_KEYS),
                       visitor_flags={"checkout_visitors": is_event("checkout_started"),
                                      "purchase_visitors": is_event("purchase")},
                       sessions="sessions" if with_sessions else None)
    return r.orderBy(F.desc("purchase_visitors"), F.desc("checkout_visitors"), F.desc("unique_visitors"))


def raw_events(base: DataFrame, limit: int | None = None) -> DataFrame:
    """Bounded raw dump in ascending time (sanitise with ``sanitize_frame``)."""
    from clickloom.sources.fixtures import EVENT_COLUMNS

    cols = [c for c in EVENT_COLUMNS]
    return top_k(base.select(*cols), [F.asc(TS), F.asc("received_at"), F.asc("event_id")], limit)
