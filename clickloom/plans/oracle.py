"""DuckDB oracle SQL for the registered queries (the correctness gate).

Each statement rebuilds the fixture projection from the driver's tables
(``FX_EVENTS_DUCK`` / ``FX_ADS_DUCK``: the shared projection SQL plus the plain
window form of sessionization / upsert) and then states the report block in
straightforward SQL, the way the studied application does.
"""

from __future__ import annotations

from clickloom.sources.fixtures import FX_ADS_AS_OF, FX_ADS_DUCK, FX_AS_OF, FX_CONTROL_PATTERN, FX_EVENTS_DUCK

DAYS = 90
ADS_DAYS = 365


def jx(path: str) -> str:
    return f"json_extract_string(properties, '$.{path}')"


def nz(x: str) -> str:
    return f"NULLIF({x}, '')"


def guarded(x: str) -> str:
    return f"CASE WHEN regexp_matches(NULLIF({x}, ''), '^-?[0-9]+(\\.[0-9]+)?$') THEN CAST({x} AS DOUBLE) END"


def loose(x: str) -> str:
    return f"TRY_CAST(NULLIF({x}, '') AS DOUBLE)"


VER = f"coalesce(TRY_CAST(NULLIF({jx('session_storage_version')}, '') AS INTEGER), 1)"
NOT_TEST = f"coalesce({jx('test')}, 'false') <> 'true'"
NOT_INTERNAL = f"coalesce({jx('internal_traffic')}, 'false') <> 'true'"
CTRL = f"regexp_matches(page_url, '{FX_CONTROL_PATTERN}', 'i')"
PERIOD = f"received_at >= TIMESTAMP '{FX_AS_OF}' - INTERVAL {DAYS} DAY"


def ft(col: str, key: str | None = None) -> str:
    return f"coalesce(NULLIF({col}, ''), NULLIF({jx('first_touch.' + (key or col))}, ''))"


FX = "WITH " + FX_EVENTS_DUCK
BASE = FX + f",\nbase AS (SELECT * FROM fx WHERE {PERIOD} AND {NOT_TEST} AND {NOT_INTERNAL} AND NOT {CTRL})\n"
ADS = "WITH " + FX_ADS_DUCK + (
    f",\nads AS (SELECT * FROM fx_ads WHERE date_start >= DATE '{FX_ADS_AS_OF}' - INTERVAL {ADS_DAYS} DAY)\n"
)


def cnt(name: str, alias: str) -> str:
    return f"count(*) FILTER (WHERE event_name = '{name}') AS {alias}"


def dvis(cond: str, alias: str) -> str:
    return f"count(DISTINCT visitor_id) FILTER (WHERE {cond}) AS {alias}"


def metrics(prefix: str = "") -> str:
    p = prefix

    def sd(n, d):
        return f"CASE WHEN {p}{d} > 0 THEN round(CAST({p}{n} AS DOUBLE) / {p}{d}, 6) END"

    return ", ".join([
        sd("clicks", "impressions") + " AS ctr",
        sd("spend", "clicks") + " AS cpc",
        f"CASE WHEN {p}impressions > 0 THEN round({p}spend / {p}impressions * 1000, 4) END AS cpm",
        sd("landing_page_views", "clicks") + " AS landing_page_view_rate",
        sd("spend", "landing_page_views") + " AS cost_per_landing_page_view",
        sd("spend", "purchases") + " AS cpa",
        sd("purchase_value", "spend") + " AS roas",
    ])


SQL: dict[str, str] = {}

SQL["read_events"] = FX + "SELECT * FROM fx"

SQL["exclusion_audit"] = FX + f""",
per AS (SELECT * FROM fx WHERE {PERIOD})
SELECT count(*) AS total_rows_in_period,
  count(*) FILTER (WHERE coalesce({jx('test')}, 'false') = 'true') AS test_events,
  count(*) FILTER (WHERE coalesce({jx('internal_traffic')}, 'false') = 'true') AS internal_traffic_events,
  count(*) FILTER (WHERE {CTRL}) AS control_surface_events,
  count(*) FILTER (WHERE {NOT_TEST} AND {NOT_INTERNAL} AND NOT {CTRL}) AS valid_external_events
FROM per"""

SQL["valid_events"] = BASE + "SELECT * FROM base"

SQL["overview"] = BASE + f""",
sv AS (SELECT session_id, max({VER}) AS version FROM base GROUP BY session_id)
SELECT count(*) AS total_events, count(DISTINCT session_id) AS sessions, count(DISTINCT visitor_id) AS unique_visitors,
  min(client_timestamp) AS first_event_at, max(client_timestamp) AS latest_event_at,
  {cnt('page_view', 'page_views')}, {cnt('cta_impression', 'cta_impressions')}, {cnt('buy_button_click', 'buy_clicks')},
  {cnt('add_to_cart', 'add_to_cart')}, {cnt('checkout_started', 'checkouts')}, {cnt('purchase', 'purchases')},
  (SELECT count(*) FROM sv WHERE version >= 2) AS session_v2_sessions,
  (SELECT count(*) FROM sv WHERE version >= 3) AS session_v3_sessions
FROM base"""

SQL["overview_basic"] = BASE + f"""
SELECT count(*) AS total_events, count(DISTINCT session_id) AS sessions, count(DISTINCT visitor_id) AS unique_visitors,
  min(client_timestamp) AS first_event_at, max(client_timestamp) AS latest_event_at,
  {cnt('page_view', 'page_views')}, {cnt('cta_impression', 'cta_impressions')}, {cnt('buy_button_click', 'buy_clicks')},
  {cnt('add_to_cart', 'add_to_cart')}, {cnt('checkout_started', 'checkouts')}, {cnt('purchase', 'purchases')}
FROM base"""

SQL["overview_sessions"] = BASE + f""",
entries AS (SELECT session_id, visitor_id, client_timestamp AS first_at, {VER} AS version,
    {ft('utm_campaign')} AS campaign, {ft('fbclid')} AS fbclid
  FROM base QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY client_timestamp, event_id) = 1),
visitors AS (SELECT visitor_id, count(*) AS sessions FROM entries GROUP BY visitor_id)
SELECT (SELECT count(*) FROM base) AS total_events, count(*) AS sessions, count(DISTINCT visitor_id) AS unique_visitors,
  min(first_at) AS first_session_at, max(first_at) AS latest_session_at,
  count(*) FILTER (WHERE version >= 2) AS session_v2_sessions, count(*) FILTER (WHERE version >= 3) AS session_v3_sessions,
  count(*) FILTER (WHERE campaign IS NOT NULL) AS attributed_sessions,
  count(DISTINCT visitor_id) FILTER (WHERE campaign IS NOT NULL) AS attributed_visitors,
  count(DISTINCT fbclid) FILTER (WHERE fbclid IS NOT NULL) AS distinct_fbclid,
  (SELECT CAST(coalesce(max(sessions), 0) AS BIGINT) FROM visitors) AS max_sessions_per_visitor,
  (SELECT count(*) FROM visitors WHERE sessions > 1) AS visitors_with_multiple_sessions,
  (SELECT round(coalesce(avg(sessions), 0), 6) FROM visitors) AS avg_sessions_per_visitor
FROM entries"""

SQL["funnel_unique_visitors"] = BASE + f"""
SELECT count(DISTINCT visitor_id) AS visitors,
  {dvis("event_name = 'page_view'", 'page_view_visitors')},
  {dvis("event_name = 'cta_impression'", 'cta_impression_visitors')},
  {dvis("event_name = 'buy_button_click'", 'buy_click_visitors')},
  {dvis("event_name = 'add_to_cart'", 'add_to_cart_visitors')},
  {dvis("event_name = 'checkout_started'", 'checkout_visitors')},
  {dvis("event_name = 'purchase'", 'purchase_visitors')}
FROM base"""

SQL["event_catalog"] = BASE + """
SELECT event_name, count(*) AS events, count(DISTINCT visitor_id) AS unique_visitors,
  count(DISTINCT session_id) AS sessions, min(client_timestamp) AS first_seen_at, max(client_timestamp) AS last_seen_at
FROM base GROUP BY event_name ORDER BY events DESC, event_name"""


def _campaigns_sql(click_ids: bool) -> str:
    stages = ["cta_impression", "buy_click"] + (["add_to_cart"] if click_ids else []) + ["checkout", "purchase"]
    names = {"cta_impression": "cta_impression", "buy_click": "buy_button_click", "add_to_cart": "add_to_cart",
             "checkout": "checkout_started", "purchase": "purchase"}
    flags = ", ".join(f"bool_or(event_name = '{names[s]}') AS {s}" for s in stages)
    vis = ",\n  ".join(f"count(DISTINCT e.visitor_id) FILTER (WHERE coalesce(r.{s}, false)) AS {s}_visitors" for s in stages)
    fb_entry = f", {ft('fbclid')} AS fbclid" if click_ids else ""
    fb_out = "count(DISTINCT e.fbclid) FILTER (WHERE e.fbclid IS NOT NULL) AS distinct_fbclid,\n  " if click_ids else ""
    return BASE + f""",
entries AS (SELECT session_id, visitor_id, {ft('utm_source')} AS source, {ft('utm_medium')} AS medium,
    {ft('utm_campaign')} AS campaign, {ft('utm_content')} AS creative, {ft('utm_term')} AS term{fb_entry}
  FROM base QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY client_timestamp, event_id) = 1),
rollup AS (SELECT session_id, {flags}, count(*) AS events FROM base GROUP BY session_id)
SELECT coalesce(e.source, 'Direto / não informado') AS source, e.medium AS medium,
  coalesce(e.campaign, 'Direto / não atribuído') AS campaign, coalesce(e.creative, 'Não informado') AS creative,
  e.term AS term, count(*) AS sessions, count(DISTINCT e.visitor_id) AS unique_visitors,
  {fb_out}{vis},
  CAST(coalesce(sum(r.events), 0) AS BIGINT) AS total_events
FROM entries e LEFT JOIN rollup r ON r.session_id = e.session_id
GROUP BY e.source, e.medium, e.campaign, e.creative, e.term"""


SQL["campaigns"] = _campaigns_sql(False)
SQL["campaigns_click_ids"] = _campaigns_sql(True)


def _summary_max(key: str) -> str:
    return f"max(CASE WHEN event_name = 'session_summary' THEN {loose(jx(key))} END) AS {key}"


SQL["session_journeys"] = BASE + f""",
entries AS (SELECT session_id, visitor_id, client_timestamp AS started_at, page_url AS landing_page, referrer,
    device_type, screen_width, language, {ft('utm_source')} AS source, {ft('utm_medium')} AS medium,
    {ft('utm_campaign')} AS campaign, {ft('utm_content')} AS creative, {VER} AS session_storage_version
  FROM base QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY client_timestamp, event_id) = 1),
rollup AS (SELECT session_id, min(client_timestamp) AS first_event_at, max(client_timestamp) AS last_event_at,
    count(*) AS event_count, array_to_string(list_sort(list_distinct(list(event_name))), ',') AS event_names,
    bool_or(event_name = 'cta_impression') AS cta_impression, bool_or(event_name = 'buy_button_click') AS buy_click,
    bool_or(event_name = 'checkout_started') AS checkout, bool_or(event_name = 'purchase') AS purchase,
    count(*) FILTER (WHERE event_name = 'javascript_error') AS javascript_errors,
    count(*) FILTER (WHERE event_name = 'session_summary') AS summaries,
    {_summary_max('visible_seconds')}, {_summary_max('max_scroll_depth')}, {_summary_max('sections_viewed')}
  FROM base GROUP BY session_id)
SELECT e.*, r.* EXCLUDE (session_id) FROM entries e LEFT JOIN rollup r ON r.session_id = e.session_id
ORDER BY e.started_at DESC, e.session_id DESC"""


def _num0(key: str) -> str:
    return f"coalesce({loose(jx(key))}, 0)"


SQL["session_journeys_pages"] = BASE + f""",
entries AS (SELECT session_id, visitor_id, client_timestamp AS started_at, page_url AS landing_page, referrer,
    device_type, screen_width, language, {ft('utm_source')} AS source, {ft('utm_medium')} AS medium,
    {ft('utm_campaign')} AS campaign, {ft('utm_content')} AS creative, {ft('fbclid')} AS fbclid,
    {VER} AS session_storage_version, {jx('session_started_at')} AS session_started_at
  FROM base QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY client_timestamp, event_id) = 1),
rollup AS (SELECT session_id, min(client_timestamp) AS first_event_at, max(client_timestamp) AS last_event_at,
    count(*) AS event_count, array_to_string(list_sort(list_distinct(list(event_name))), ',') AS event_names,
    bool_or(event_name = 'cta_impression') AS cta_impression, bool_or(event_name = 'buy_button_click') AS buy_click,
    bool_or(event_name = 'add_to_cart') AS add_to_cart,
    bool_or(event_name = 'checkout_started') AS checkout, bool_or(event_name = 'purchase') AS purchase,
    count(*) FILTER (WHERE event_name = 'javascript_error') AS javascript_errors,
    count(*) FILTER (WHERE event_name = 'session_summary') AS summaries,
    count(DISTINCT NULLIF({jx('page_instance_id')}, '')) AS page_instances
  FROM base GROUP BY session_id),
lps AS (SELECT session_id, coalesce(NULLIF({jx('page_instance_id')}, ''), CAST(session_id AS VARCHAR)) AS pik,
    {_num0('visible_seconds')} AS visible_seconds, {_num0('duration_seconds')} AS duration_seconds,
    {_num0('max_scroll_depth')} AS max_scroll_depth, {_num0('sections_viewed')} AS sections_viewed,
    {_num0('rage_click_count')} AS rage_click_count, {_num0('dead_click_count')} AS dead_click_count,
    {jx('quick_exit')} AS quick_exit
  FROM base WHERE event_name = 'session_summary'
  QUALIFY row_number() OVER (PARTITION BY session_id, pik ORDER BY client_timestamp DESC, event_id DESC) = 1),
srl AS (SELECT session_id, sum(visible_seconds) AS visible_seconds, sum(duration_seconds) AS duration_seconds,
    max(max_scroll_depth) AS max_scroll_depth, sum(sections_viewed) AS sections_viewed,
    sum(rage_click_count) AS rage_click_count, sum(dead_click_count) AS dead_click_count,
    bool_and(quick_exit = 'true') AS all_pages_quick_exit
  FROM lps GROUP BY session_id)
SELECT e.*, r.* EXCLUDE (session_id), s.* EXCLUDE (session_id)
FROM entries e LEFT JOIN rollup r ON r.session_id = e.session_id LEFT JOIN srl s ON s.session_id = e.session_id
ORDER BY e.started_at DESC, e.session_id DESC"""


def _conversion_sql(extended: bool) -> str:
    ext = (f"{jx('conversion_attribution.identifier_source')} AS identifier_source,\n"
           f"  {jx('conversion_attribution.lookback_days')} AS attribution_lookback_days,\n  ") if extended else ""
    return BASE + f"""
SELECT event_id, event_name, visitor_id, session_id AS actual_session_id, client_timestamp, received_at,
  utm_source, utm_medium, utm_campaign, utm_content, fbclid,
  coalesce({jx('checkout_id')}, {jx('checkout_token')}, {jx('conversion_attribution.checkout_id')}) AS checkout_id,
  coalesce({jx('order_id')}, {jx('conversion_attribution.order_id')}) AS order_id,
  {jx('conversion_attribution.visitor_id')} AS attributed_visitor_id,
  {jx('conversion_attribution.session_id')} AS attributed_session_id,
  {jx('conversion_attribution.method')} AS attribution_method,
  {jx('conversion_attribution.confidence')} AS attribution_confidence,
  {jx('conversion_attribution.cross_session')} AS cross_session,
  {ext}properties
FROM base WHERE event_name IN ('checkout_started', 'purchase')
ORDER BY client_timestamp DESC, received_at DESC, event_id DESC"""


SQL["conversion_report"] = _conversion_sql(False)
SQL["conversion_report_ext"] = _conversion_sql(True)

SQL["attribution_summary"] = BASE + f"""
SELECT count(*) AS conversion_events,
  count(*) FILTER (WHERE {jx('conversion_attribution.session_id')} IS NOT NULL) AS resolved_events,
  count(*) FILTER (WHERE {jx('conversion_attribution.session_id')} IS NULL) AS unresolved_events,
  count(*) FILTER (WHERE {jx('conversion_attribution.cross_session')} = 'true') AS cross_session_events
FROM base WHERE event_name IN ('checkout_started', 'purchase')"""

SQL["data_quality"] = BASE + f""",
pv AS (SELECT * FROM base WHERE event_name = 'page_view')
SELECT count(*) AS page_views,
  count(*) FILTER (WHERE visitor_id IS NULL) AS missing_visitor_id,
  count(*) FILTER (WHERE session_id IS NULL) AS missing_session_id,
  count(*) FILTER (WHERE NULLIF(page_url, '') IS NULL) AS missing_page_url,
  count(*) FILTER (WHERE NULLIF(device_type, '') IS NULL) AS missing_device_type,
  count(*) FILTER (WHERE NULLIF(utm_campaign, '') IS NULL AND NULLIF({jx('first_touch.utm_campaign')}, '') IS NULL) AS missing_campaign,
  count(*) FILTER (WHERE lower(coalesce(utm_source, {jx('first_touch.utm_source')}, '')) IN ('facebook', 'fb', 'meta')
    AND NULLIF(coalesce(fbclid, {jx('first_touch.fbclid')}), '') IS NULL) AS facebook_without_fbclid,
  count(*) FILTER (WHERE {VER} >= 2) AS v2_page_views,
  count(*) FILTER (WHERE {VER} >= 3) AS v3_page_views,
  (SELECT count(*) FROM base WHERE event_name = 'session_summary') AS summaries,
  (SELECT count(DISTINCT session_id) FROM base WHERE event_name = 'session_summary') AS summary_sessions
FROM pv"""

SQL["property_keys"] = BASE + """
SELECT key, count(*) AS occurrences FROM (SELECT unnest(json_keys(properties)) AS key FROM base)
GROUP BY key ORDER BY occurrences DESC, key"""


def _daily_sql(revenue: bool) -> str:
    rev = (f",\n  round(coalesce(sum({loose(jx('value'))}) FILTER (WHERE event_name = 'purchase'), 0), 6) AS revenue"
           if revenue else "")
    return BASE + f"""
SELECT date_trunc('day', client_timestamp) AS day, count(*) AS events, count(DISTINCT visitor_id) AS unique_visitors,
  count(DISTINCT session_id) AS sessions, {cnt('page_view', 'page_views')}, {cnt('cta_impression', 'cta_impressions')},
  {cnt('buy_button_click', 'buy_clicks')}, {cnt('checkout_started', 'checkouts')}, {cnt('purchase', 'purchases')}{rev}
FROM base GROUP BY date_trunc('day', client_timestamp) ORDER BY day"""


SQL["daily_series"] = _daily_sql(False)
SQL["daily_revenue"] = _daily_sql(True)

SQL["pages"] = BASE + f"""
SELECT page_url, page_path, page_title, count(*) AS events, count(DISTINCT visitor_id) AS unique_visitors,
  count(DISTINCT session_id) AS sessions, {cnt('page_view', 'page_views')}, {cnt('checkout_started', 'checkouts')},
  {cnt('purchase', 'purchases')}
FROM base GROUP BY page_url, page_path, page_title
ORDER BY unique_visitors DESC, events DESC, page_url NULLS FIRST, page_path NULLS FIRST, page_title NULLS FIRST"""

SQL["pages_by_path"] = BASE + """
SELECT page_path, page_title, count(*) AS events, count(DISTINCT visitor_id) AS unique_visitors,
  count(DISTINCT session_id) AS sessions
FROM base GROUP BY page_path, page_title
ORDER BY events DESC, page_path NULLS FIRST, page_title NULLS FIRST"""

SQL["referrers"] = BASE + """
SELECT coalesce(NULLIF(referrer, ''), 'Sem referrer') AS referrer, events, unique_visitors, sessions FROM (
  SELECT referrer, count(*) AS events, count(DISTINCT visitor_id) AS unique_visitors, count(DISTINCT session_id) AS sessions
  FROM base WHERE event_name = 'page_view' GROUP BY referrer
  ORDER BY sessions DESC, events DESC, referrer NULLS FIRST)"""

SQL["devices"] = BASE + f"""
SELECT coalesce(device_type, 'unknown') AS device_type, screen_width, language, events, unique_visitors, sessions,
  checkouts, purchases FROM (
  SELECT device_type, screen_width, language, count(*) AS events, count(DISTINCT visitor_id) AS unique_visitors,
    count(DISTINCT session_id) AS sessions, {cnt('checkout_started', 'checkouts')}, {cnt('purchase', 'purchases')}
  FROM base GROUP BY device_type, screen_width, language
  ORDER BY unique_visitors DESC, events DESC, device_type NULLS FIRST, screen_width NULLS FIRST, language NULLS FIRST
 )"""

SQL["devices_network"] = BASE + f"""
SELECT coalesce(device_type, 'unknown') AS device_type, screen_width, language, viewport_width, viewport_height,
  effective_connection_type, country, events, unique_visitors, sessions FROM (
  SELECT device_type, screen_width, language, {jx('viewport_width')} AS viewport_width,
    {jx('viewport_height')} AS viewport_height, {jx('effective_connection_type')} AS effective_connection_type,
    {jx('country')} AS country, count(*) AS events, count(DISTINCT visitor_id) AS unique_visitors,
    count(DISTINCT session_id) AS sessions
  FROM base GROUP BY ALL)"""

SQL["products"] = BASE + f"""
SELECT coalesce({jx('product_id')}, {jx('line_items[0].product_id')}, 'unknown') AS product_id,
  coalesce({jx('variant_id')}, {jx('line_items[0].variant_id')}, 'unknown') AS variant_id,
  coalesce({jx('product_name')}, {jx('line_items[0].product_title')}, 'unknown') AS product_name,
  coalesce({jx('currency')}, 'unknown') AS currency,
  count(*) AS events, count(DISTINCT visitor_id) AS unique_visitors,
  {cnt('checkout_started', 'checkouts')}, {cnt('purchase', 'purchases')},
  round(avg({guarded(jx('value'))}), 6) AS avg_value
FROM base WHERE event_name IN ('cta_impression', 'buy_button_click', 'add_to_cart', 'checkout_started', 'purchase')
GROUP BY 1, 2, 3, 4"""

SQL["products_line_items"] = BASE + """,
items AS (SELECT visitor_id, session_id, unnest(CASE WHEN json_type(properties, '$.line_items') = 'ARRAY'
    THEN json_extract(properties, '$.line_items[*]') ELSE CAST([] AS JSON[]) END) AS item FROM base)
SELECT json_extract_string(item, '$.product_id') AS product_id, json_extract_string(item, '$.variant_id') AS variant_id,
  json_extract_string(item, '$.product_title') AS product_title, json_extract_string(item, '$.variant_title') AS variant_title,
  count(*) AS events, count(DISTINCT visitor_id) AS unique_visitors, count(DISTINCT session_id) AS sessions,
  round(coalesce(sum(TRY_CAST(NULLIF(json_extract_string(item, '$.quantity'), '') AS DOUBLE)), 0), 6) AS total_quantity,
  min(TRY_CAST(NULLIF(json_extract_string(item, '$.price'), '') AS DOUBLE)) AS minimum_price,
  max(TRY_CAST(NULLIF(json_extract_string(item, '$.price'), '') AS DOUBLE)) AS maximum_price
FROM items GROUP BY 1, 2, 3, 4 ORDER BY events DESC"""

SQL["javascript_errors"] = BASE + f"""
SELECT {jx('message')} AS message, {jx('filename')} AS filename, {jx('kind')} AS kind, count(*) AS events,
  count(DISTINCT visitor_id) AS unique_visitors, count(DISTINCT session_id) AS sessions,
  min(client_timestamp) AS first_seen_at, max(client_timestamp) AS last_seen_at
FROM base WHERE event_name = 'javascript_error' GROUP BY 1, 2, 3
ORDER BY events DESC, message NULLS FIRST, filename NULLS FIRST, kind NULLS FIRST"""

SQL["cta_performance"] = BASE + f"""
SELECT coalesce({jx('placement')}, 'unknown') AS placement, coalesce({jx('element_text')}, 'unknown') AS element_text,
  count(*) FILTER (WHERE event_name = 'cta_impression') AS impressions,
  {dvis("event_name = 'cta_impression'", 'impression_visitors')},
  count(*) FILTER (WHERE event_name IN ('buy_button_click', 'cta_click_context')) AS clicks,
  {dvis("event_name IN ('buy_button_click', 'cta_click_context')", 'click_visitors')},
  round(avg({guarded(jx('visible_ms_before_impression'))}), 6) AS avg_visible_ms_before_impression
FROM base WHERE event_name IN ('cta_impression', 'buy_button_click', 'cta_click_context') GROUP BY 1, 2"""

SQL["cta_by_creative"] = BASE + f"""
SELECT placement, product_id, creative, impressions, impression_visitors, clicks, click_visitors, avg_seconds_to_click,
  avg_visible_seconds_before_click,
  CASE WHEN impression_visitors > 0 THEN round(CAST(click_visitors AS DOUBLE) / impression_visitors, 6) END AS impression_to_click_rate
FROM (SELECT coalesce({jx('placement')}, 'unknown') AS placement, coalesce({jx('product_id')}, 'unknown') AS product_id,
  coalesce(utm_content, {jx('first_touch.utm_content')}, 'Não informado') AS creative,
  count(*) FILTER (WHERE event_name = 'cta_impression') AS impressions,
  {dvis("event_name = 'cta_impression'", 'impression_visitors')},
  count(*) FILTER (WHERE event_name = 'buy_button_click') AS clicks,
  {dvis("event_name = 'buy_button_click'", 'click_visitors')},
  round(avg({loose(jx('seconds_to_click'))}) FILTER (WHERE event_name = 'buy_button_click'), 6) AS avg_seconds_to_click,
  round(avg({loose(jx('seconds_visible'))}) FILTER (WHERE event_name = 'buy_button_click'), 6) AS avg_visible_seconds_before_click
FROM base WHERE event_name IN ('cta_impression', 'buy_button_click') GROUP BY 1, 2, 3)"""


def _sections_sql(engagement_only: bool) -> str:
    if engagement_only:
        ms = loose(jx("visible_ms"))
        flt = " FILTER (WHERE event_name = 'section_engagement')"
    else:
        ms = guarded(jx("visible_ms"))
        flt = ""
    return BASE + f"""
SELECT coalesce({jx('section_key')}, {jx('chapter')}, {jx('section_id')}, 'unknown') AS section_key,
  count(*) FILTER (WHERE event_name = 'section_view') AS views,
  {dvis("event_name = 'section_view'", 'view_visitors')},
  count(*) FILTER (WHERE event_name = 'section_engagement') AS engagement_events,
  {dvis("event_name = 'section_engagement'", 'engaged_visitors')},
  round(avg({ms}){flt}, 6) AS avg_visible_ms,
  round(sum({ms}){flt}, 6) AS total_visible_ms
FROM base WHERE event_name IN ('section_view', 'section_engagement') GROUP BY 1"""


SQL["sections"] = _sections_sql(False)
SQL["sections_engagement"] = _sections_sql(True)


def _perf_sql(extended: bool) -> str:
    f = loose if extended else guarded
    p50 = f"round(quantile_cont({f(jx('ttfb_ms'))}, 0.5), 6) AS p50_ttfb_ms,\n  " if extended else ""
    return BASE + f"""
SELECT count(*) AS samples, count(DISTINCT visitor_id) AS unique_visitors,
  round(avg({f(jx('ttfb_ms'))}), 6) AS avg_ttfb_ms,
  {p50}round(quantile_cont({f(jx('lcp_ms'))}, 0.75), 6) AS p75_lcp_ms,
  round(quantile_cont({f(jx('inp_ms'))}, 0.75), 6) AS p75_inp_ms,
  round(quantile_cont({f(jx('cls'))}, 0.75), 6) AS p75_cls,
  round(avg({f(jx('load_ms'))}), 6) AS avg_load_ms
FROM base WHERE event_name IN ('page_performance', 'session_summary')"""


SQL["web_performance"] = _perf_sql(False)
SQL["web_performance_ext"] = _perf_sql(True)

SQL["interaction_anomalies"] = BASE + f"""
SELECT coalesce({jx('anomaly_type')}, 'unknown') AS anomaly_type, {jx('element_tag')} AS element_tag,
  {jx('element_text')} AS element_text, count(*) AS events, count(DISTINCT visitor_id) AS unique_visitors,
  count(DISTINCT session_id) AS sessions
FROM base WHERE event_name = 'interaction_anomaly' GROUP BY 1, 2, 3
ORDER BY events DESC, anomaly_type NULLS FIRST, element_tag NULLS FIRST, element_text NULLS FIRST"""

SQL["identity_integrity"] = BASE + f""",
page_visitors AS (SELECT DISTINCT visitor_id FROM base WHERE event_name = 'page_view'),
conversion_visitors AS (SELECT DISTINCT visitor_id FROM base WHERE event_name IN ('checkout_started', 'purchase'))
SELECT (SELECT count(*) FROM page_visitors) AS page_view_visitors,
  (SELECT count(*) FROM conversion_visitors) AS conversion_visitors,
  count(*) FILTER (WHERE p.visitor_id IS NOT NULL) AS conversion_visitors_with_page_view,
  count(*) FILTER (WHERE p.visitor_id IS NULL) AS orphan_conversion_visitors,
  (SELECT count(*) FROM base WHERE event_name IN ('checkout_started', 'purchase')
    AND NULLIF({jx('conversion_attribution.session_id')}, '') IS NOT NULL) AS conversions_with_resolved_attribution,
  (SELECT count(*) FROM base WHERE event_name IN ('checkout_started', 'purchase')) AS conversion_events
FROM conversion_visitors c LEFT JOIN page_visitors p ON p.visitor_id = c.visitor_id"""

SQL["identity_continuity"] = BASE + f""",
page_visitors AS (SELECT DISTINCT visitor_id FROM base WHERE event_name = 'page_view'),
checkout_visitors AS (SELECT DISTINCT visitor_id FROM base WHERE event_name = 'checkout_started'),
x AS (SELECT (SELECT count(*) FROM page_visitors) AS page_view_visitors,
  (SELECT count(*) FROM checkout_visitors) AS checkout_visitors,
  count(*) FILTER (WHERE p.visitor_id IS NOT NULL) AS checkout_visitors_with_page_view,
  count(*) FILTER (WHERE p.visitor_id IS NULL) AS orphan_checkout_visitors,
  (SELECT count(*) FROM base WHERE event_name IN ('checkout_started', 'purchase')
    AND NULLIF({jx('conversion_attribution.session_id')}, '') IS NOT NULL) AS conversions_with_resolved_attribution,
  (SELECT count(*) FROM base WHERE event_name IN ('checkout_started', 'purchase')) AS conversion_events
FROM checkout_visitors c LEFT JOIN page_visitors p ON p.visitor_id = c.visitor_id)
SELECT *, CASE WHEN checkout_visitors > 0 THEN round(CAST(checkout_visitors_with_page_view AS DOUBLE) / checkout_visitors, 6) END AS checkout_identity_match_rate,
  CASE WHEN conversion_events > 0 THEN round(CAST(conversions_with_resolved_attribution AS DOUBLE) / conversion_events, 6) END AS attribution_resolution_rate,
  CASE WHEN orphan_checkout_visitors > 0 THEN 'checkouts whose visitor has no page_view: fix identity continuity before computing landing-to-checkout rates' END AS warning
FROM x"""


def _avg_secs(a: str, b: str, alias: str) -> str:
    return (f"round(avg(epoch_us({a}) - epoch_us({b})) FILTER (WHERE {a} >= {b}) / 1e6, 6) AS {alias}")


SQL["time_to_conversion"] = BASE + f""",
vt AS (SELECT visitor_id,
  min(client_timestamp) FILTER (WHERE event_name = 'page_view') AS first_page_view,
  min(client_timestamp) FILTER (WHERE event_name = 'cta_impression') AS first_cta_impression,
  min(client_timestamp) FILTER (WHERE event_name = 'buy_button_click') AS first_buy_click,
  min(client_timestamp) FILTER (WHERE event_name = 'checkout_started') AS first_checkout,
  min(client_timestamp) FILTER (WHERE event_name = 'purchase') AS first_purchase
  FROM base GROUP BY visitor_id)
SELECT count(*) FILTER (WHERE first_page_view IS NOT NULL) AS visitors_with_page_view,
  count(*) FILTER (WHERE first_checkout IS NOT NULL) AS visitors_with_checkout,
  count(*) FILTER (WHERE first_purchase IS NOT NULL) AS visitors_with_purchase,
  {_avg_secs('first_cta_impression', 'first_page_view', 'avg_seconds_page_to_cta')},
  {_avg_secs('first_buy_click', 'first_cta_impression', 'avg_seconds_cta_to_click')},
  {_avg_secs('first_checkout', 'first_page_view', 'avg_seconds_page_to_checkout')},
  {_avg_secs('first_purchase', 'first_checkout', 'avg_seconds_checkout_to_purchase')}
FROM vt"""


def _exists(name: str, days: int) -> str:
    return (f"EXISTS (SELECT 1 FROM base b WHERE b.visitor_id = f.visitor_id AND b.event_name = '{name}' "
            f"AND b.client_timestamp BETWEEN f.first_page_view AND f.first_page_view + INTERVAL {days} DAY)")


SQL["visitor_cohorts"] = BASE + f""",
first_touch AS (SELECT visitor_id, min(client_timestamp) AS first_page_view FROM base WHERE event_name = 'page_view'
  GROUP BY visitor_id)
SELECT date_trunc('day', f.first_page_view) AS cohort_day, count(*) AS visitors,
  count(*) FILTER (WHERE {_exists('checkout_started', 1)}) AS checkout_within_1d,
  count(*) FILTER (WHERE {_exists('checkout_started', 7)}) AS checkout_within_7d,
  count(*) FILTER (WHERE {_exists('purchase', 7)}) AS purchase_within_7d,
  count(*) FILTER (WHERE {_exists('purchase', 30)}) AS purchase_within_30d
FROM first_touch f GROUP BY 1 ORDER BY 1"""

_TAX = ("concept", "hook", "sales_message", "format", "angle", "awareness_level", "landing_version", "offer_version")


def _taxonomy_sql(sessions: bool) -> str:
    keys = ",\n  ".join(f"coalesce({jx(k)}, 'Não informado') AS {k}" for k in _TAX)
    anykey = "list_has_any(json_keys(properties), [" + ", ".join(f"'{k}'" for k in _TAX) + "])"
    sess = "count(DISTINCT session_id) AS sessions,\n  " if sessions else ""
    return BASE + f"""
SELECT {keys},
  count(*) AS events, count(DISTINCT visitor_id) AS unique_visitors, {sess}
  {dvis("event_name = 'checkout_started'", 'checkout_visitors')},
  {dvis("event_name = 'purchase'", 'purchase_visitors')}
FROM base WHERE {anykey} GROUP BY 1, 2, 3, 4, 5, 6, 7, 8"""


SQL["creative_taxonomy"] = _taxonomy_sql(False)
SQL["creative_taxonomy_sessions"] = _taxonomy_sql(True)

SQL["raw_events"] = BASE + f"""
SELECT event_id, event_name, visitor_id, session_id, client_timestamp, received_at, page_url, page_path, page_title,
  referrer, utm_source, utm_medium, utm_campaign, utm_content, utm_term, fbclid, device_type, screen_width, language,
  properties
FROM base ORDER BY client_timestamp, received_at, event_id"""

# ------------------------------------------------------------------ journeys
_PAGE_TYPE = f"""coalesce(NULLIF({jx('page_type')}, ''), CASE
    WHEN event_name IN ('checkout_started', 'purchase') THEN 'checkout'
    WHEN page_path LIKE '/editorial/%' OR event_name LIKE 'funnel_%' THEN 'funnel'
    WHEN page_path IN ('/', '') OR event_name IN ('sales_page_view', 'product_view', 'buy_button_click', 'checkout_redirect') THEN 'sales_page'
    ELSE 'other' END)"""
_JOURNEY_TYPE = f"""coalesce(NULLIF({jx('journey_type')}, ''), NULLIF({jx('checkout_attributes.ct_journey_type')}, ''),
    CASE WHEN page_path LIKE '/editorial/%' OR event_name LIKE 'funnel_%' THEN 'funnel' ELSE 'unclassified' END)"""

SQL["page_types"] = BASE + f""",
c AS (SELECT visitor_id, session_id, event_name, {_PAGE_TYPE} AS page_type FROM base)
SELECT page_type, count(*) AS events, count(DISTINCT visitor_id) AS unique_visitors, count(DISTINCT session_id) AS sessions,
  {dvis("event_name = 'funnel_view'", 'funnel_view_visitors')},
  {dvis("event_name = 'sales_page_view'", 'sales_page_view_visitors')},
  {dvis("event_name = 'checkout_started'", 'checkout_visitors')},
  {dvis("event_name = 'purchase'", 'purchase_visitors')}
FROM c GROUP BY page_type"""

SQL["journey_types"] = BASE + f""",
c AS (SELECT visitor_id, session_id, event_name, {_JOURNEY_TYPE} AS journey_type FROM base)
SELECT journey_type, count(*) AS events, count(DISTINCT visitor_id) AS unique_visitors,
  count(DISTINCT session_id) AS sessions,
  {dvis("event_name = 'checkout_started'", 'checkout_visitors')},
  {dvis("event_name = 'purchase'", 'purchase_visitors')}
FROM c GROUP BY journey_type"""

SQL["visitor_overlap"] = BASE + f""",
v AS (SELECT visitor_id,
  bool_or({jx('page_type')} = 'funnel' OR page_path LIKE '/editorial/%' OR event_name = 'funnel_view') AS f,
  bool_or({jx('page_type')} = 'sales_page' OR event_name = 'sales_page_view'
    OR event_name IN ('product_view', 'buy_button_click', 'checkout_redirect')) AS s,
  bool_or(event_name = 'checkout_started') AS c, bool_or(event_name = 'purchase') AS p
  FROM base GROUP BY visitor_id)
SELECT count(*) FILTER (WHERE f AND NOT s) AS funnel_only_visitors,
  count(*) FILTER (WHERE s AND NOT f) AS sales_page_only_visitors,
  count(*) FILTER (WHERE f AND s) AS funnel_and_sales_page_visitors,
  count(*) FILTER (WHERE NOT f AND NOT s) AS unclassified_visitors,
  count(*) FILTER (WHERE f AND c) AS funnel_touched_checkout_visitors,
  count(*) FILTER (WHERE f AND p) AS funnel_touched_purchase_visitors,
  count(*) FILTER (WHERE s AND c) AS sales_page_checkout_visitors,
  count(*) FILTER (WHERE s AND p) AS sales_page_purchase_visitors
FROM v"""

SQL["stage_flow"] = BASE + f"""
SELECT {dvis("event_name = 'funnel_view'", 'funnel_visitors')},
  {dvis("event_name = 'funnel_cta_impression'", 'funnel_cta_impression_visitors')},
  {dvis("event_name = 'funnel_cta_click'", 'funnel_cta_click_visitors')},
  {dvis("event_name = 'sales_page_view'", 'sales_page_visitors')},
  {dvis("event_name = 'sales_page_view' AND " + jx('journey_type') + " = 'funnel_to_sales'", 'funnel_to_sales_visitors')},
  {dvis("event_name = 'sales_page_view' AND " + jx('journey_type') + " = 'funnel_assisted_sales'", 'funnel_assisted_sales_visitors')},
  {dvis("event_name = 'sales_page_view' AND " + jx('journey_type') + " = 'direct_to_sales'", 'direct_to_sales_visitors')},
  {dvis("event_name = 'buy_button_click'", 'buy_click_visitors')},
  {dvis("event_name = 'checkout_started'", 'checkout_visitors')},
  {dvis("event_name = 'purchase'", 'purchase_visitors')}
FROM base"""

# ------------------------------------------------------------------ audit
_PROD = f"coalesce({jx('traffic_classification')}, 'production') = 'production'"
SQL["audit_distribution"] = FX + f"""
SELECT coalesce({jx('traffic_classification')}, 'unclassified') AS traffic_classification, count(*) AS events,
  count(DISTINCT visitor_id) AS unique_visitors, count(DISTINCT session_id) AS sessions,
  min(received_at) AS first_seen_at, max(received_at) AS last_seen_at
FROM fx GROUP BY 1 ORDER BY events DESC"""

SQL["audit_production"] = FX + f"""
SELECT count(*) AS production_events, count(DISTINCT visitor_id) AS production_unique_visitors,
  count(DISTINCT session_id) AS production_sessions, {cnt('page_view', 'page_views')},
  {cnt('checkout_started', 'checkout_events')}, {cnt('purchase', 'purchase_events')}
FROM fx WHERE {_PROD} AND {NOT_TEST} AND {NOT_INTERNAL}"""

SQL["audit_duplicates"] = FX + f"""
SELECT {jx('shopify_event_id')} AS shopify_event_id, count(*) AS production_copies
FROM fx WHERE NULLIF({jx('shopify_event_id')}, '') IS NOT NULL AND {_PROD}
GROUP BY 1 HAVING count(*) > 1 ORDER BY production_copies DESC"""

SQL["audit_reasons"] = FX + f"""
SELECT coalesce({jx('traffic_classification_reason')}, 'unclassified') AS reason, count(*) AS events,
  count(DISTINCT visitor_id) AS unique_visitors
FROM fx WHERE NOT ({_PROD}) GROUP BY 1 ORDER BY events DESC"""

SQL["audit_campaigns"] = FX + f"""
SELECT coalesce(utm_source, 'direct') AS source, coalesce(utm_campaign, 'unattributed') AS campaign,
  count(*) AS events, count(DISTINCT visitor_id) AS unique_visitors,
  {cnt('checkout_started', 'checkout_events')}, {cnt('purchase', 'purchase_events')}
FROM fx WHERE {_PROD} GROUP BY 1, 2 ORDER BY events DESC"""

# ------------------------------------------------------------------ ads
SQL["ads_upsert"] = "WITH " + FX_ADS_DUCK + """
SELECT * EXCLUDE (spend, purchase_value, ingested_seq), CAST(spend AS DOUBLE) AS spend,
  CAST(purchase_value AS DOUBLE) AS purchase_value
FROM fx_ads"""

SQL["ads_upsert_merge"] = SQL["ads_upsert"]

SQL["ads_overview"] = ADS + f""",
o AS (SELECT count(*) AS rows, min(date_start) AS first_date, max(date_start) AS latest_date,
  count(DISTINCT account_id) AS accounts, count(DISTINCT campaign_id) AS campaigns, count(DISTINCT adset_id) AS adsets,
  count(DISTINCT ad_id) AS ads, CAST(coalesce(sum(spend), 0) AS DOUBLE) AS spend,
  CAST(coalesce(sum(impressions), 0) AS BIGINT) AS impressions, CAST(coalesce(sum(reach), 0) AS BIGINT) AS reach,
  CAST(coalesce(sum(clicks), 0) AS BIGINT) AS clicks,
  CAST(coalesce(sum(landing_page_views), 0) AS BIGINT) AS landing_page_views,
  round(coalesce(sum(purchases), 0), 6) AS purchases, CAST(coalesce(sum(purchase_value), 0) AS DOUBLE) AS purchase_value
  FROM ads)
SELECT *, {metrics()} FROM o"""

SQL["ads_campaigns"] = ADS + f""",
o AS (SELECT campaign_id, campaign_name, count(DISTINCT adset_id) AS adsets, count(DISTINCT ad_id) AS ads,
  CAST(coalesce(sum(spend), 0) AS DOUBLE) AS spend,
  CAST(coalesce(sum(impressions), 0) AS BIGINT) AS impressions, CAST(coalesce(sum(reach), 0) AS BIGINT) AS reach,
  CAST(coalesce(sum(clicks), 0) AS BIGINT) AS clicks, CAST(coalesce(sum(unique_clicks), 0) AS BIGINT) AS unique_clicks,
  CAST(coalesce(sum(landing_page_views), 0) AS BIGINT) AS landing_page_views,
  CAST(coalesce(sum(add_to_cart), 0) AS BIGINT) AS add_to_cart,
  CAST(coalesce(sum(initiate_checkout), 0) AS BIGINT) AS initiate_checkout,
  round(coalesce(sum(purchases), 0), 6) AS purchases, CAST(coalesce(sum(purchase_value), 0) AS DOUBLE) AS purchase_value,
  max(currency) AS currency, max(ingested_at) AS latest_ingested_at
  FROM ads GROUP BY campaign_id, campaign_name)
SELECT *, {metrics()} FROM o ORDER BY spend DESC, impressions DESC"""

SQL["ads_daily"] = ADS + f""",
o AS (SELECT date_start, account_id, campaign_id, campaign_name, adset_id, adset_name, ad_id, ad_name, creative_id,
  CAST(spend AS DOUBLE) AS spend, impressions, reach, frequency, clicks, unique_clicks, landing_page_views, add_to_cart,
  initiate_checkout, purchases, CAST(purchase_value AS DOUBLE) AS purchase_value, currency, ingested_at
  FROM ads ORDER BY date_start, spend DESC, account_id, ad_id)
SELECT * EXCLUDE (spend, purchase_value), round(spend, 6) AS spend, round(purchase_value, 6) AS purchase_value,
  {metrics()} FROM o"""

# ------------------------------------------------------------------ attribution
_ELIGIBLE = f"{NOT_TEST} AND {NOT_INTERNAL}"


def _match(name: str, conv_key: str, cand_sql: str) -> str:
    return f"""{name} AS (SELECT c.event_id AS cid, h.session_id AS m_session, h.visitor_id AS m_visitor, h.hid AS m_event
  FROM conv c JOIN {cand_sql} h ON h.k = c.{conv_key} AND h.client_timestamp <= c.client_timestamp
    AND h.received_at >= c.received_at - INTERVAL 30 DAY AND h.received_at < c.received_at
  QUALIFY row_number() OVER (PARTITION BY c.event_id ORDER BY h.client_timestamp DESC, h.received_at DESC, h.hid DESC) = 1)"""


def _cands(names: str, keys: list[str], extra: str = "") -> str:
    arr = ", ".join(f"NULLIF({k}, '')" for k in keys)
    return f"""(SELECT DISTINCT k, CAST(event_id AS VARCHAR) AS hid, client_timestamp, received_at,
    CAST(session_id AS VARCHAR) AS session_id, CAST(visitor_id AS VARCHAR) AS visitor_id
  FROM (SELECT *, unnest([{arr}]) AS k FROM fx WHERE event_name IN ({names}) AND {_ELIGIBLE}{extra}) WHERE k IS NOT NULL)"""


_TAGGED = (f" AND (NULLIF(utm_campaign, '') IS NOT NULL OR NULLIF(fbclid, '') IS NOT NULL"
           f" OR NULLIF({jx('first_touch.utm_campaign')}, '') IS NOT NULL OR NULLIF({jx('first_touch.fbclid')}, '') IS NOT NULL)")
_METHOD = ("CASE m.prio WHEN 3 THEN 'checkout_id' WHEN 4 THEN 'order_id' "
           "WHEN 5 THEN 'visitor_latest_attributed_session' ELSE 'same_session' END")

SQL["attribute_conversions"] = FX + f""",
conv AS (SELECT event_id, event_name, visitor_id, session_id, client_timestamp, received_at,
    NULLIF(trim(coalesce({jx('checkout_id')}, {jx('checkoutId')}, {jx('ct_checkout_id')}, {jx('checkout_token')})), '') AS checkout_key,
    NULLIF(trim(coalesce({jx('order_id')}, {jx('orderId')}, {jx('ct_order_id')})), '') AS order_key,
    CAST(visitor_id AS VARCHAR) AS visitor_key
  FROM fx WHERE event_name IN ('checkout_started', 'purchase')),
{_match('mc', 'checkout_key', _cands("'checkout_started', 'add_to_cart', 'buy_button_click'", [jx('checkout_id'), jx('ct_checkout_id'), jx('checkout_token'), jx('conversion_attribution.checkout_id')]))},
{_match('mo', 'order_key', _cands("'checkout_started', 'add_to_cart'", [jx('order_id'), jx('ct_order_id'), jx('conversion_attribution.order_id')]))},
{_match('mv', 'visitor_key', _cands("'page_view'", ['CAST(visitor_id AS VARCHAR)'], _TAGGED))},
allm AS (SELECT 3 AS prio, * FROM mc UNION ALL SELECT 4, * FROM mo UNION ALL SELECT 5, * FROM mv),
best AS (SELECT * FROM allm QUALIFY row_number() OVER (PARTITION BY cid ORDER BY prio) = 1)
SELECT c.event_id, c.event_name, c.visitor_id, c.session_id, c.client_timestamp, c.received_at,
  coalesce(m.m_visitor, CAST(c.visitor_id AS VARCHAR)) AS attributed_visitor_id,
  coalesce(m.m_session, CAST(c.session_id AS VARCHAR)) AS attributed_session_id,
  {_METHOD} AS method, m.m_event AS matched_event_id, c.checkout_key AS checkout_id, c.order_key AS order_id,
  CASE WHEN m.prio = 5 THEN 'medium' WHEN m.prio IN (3, 4) THEN 'high' ELSE 'native' END AS confidence,
  coalesce(m.m_session, CAST(c.session_id AS VARCHAR)) <> CAST(c.session_id AS VARCHAR) AS cross_session,
  {_METHOD} AS identifier_source, CAST(30 AS INTEGER) AS lookback_days
FROM conv c LEFT JOIN best m ON m.cid = c.event_id"""

# ------------------------------------------------------------------ classification / maintenance
from clickloom.config import (  # noqa: E402
    CLASSIFY_BOT_UA, CLASSIFY_INTERNAL_URL_PARAM, CLASSIFY_LOCALHOST, CLASSIFY_TEST_CAMPAIGN, CLASSIFY_TEST_URL_PARAM,
)

_T_OLD, _T_NEW, _T_REPLAY = "2024-01-20 00:00:00", "2024-01-15 00:00:00", "2024-01-25 00:00:00"
_SID = f"NULLIF({jx('shopify_event_id')}, '')"
_CLS_INPUT = f"""cin AS (SELECT *, lower(coalesce(page_url, '')) AS u, lower(coalesce(page_path, '')) AS pth,
    lower(coalesce(utm_campaign, '')) AS cmp, lower(coalesce({jx('server_context.user_agent')}, '')) AS ua,
    lower(coalesce({jx('test')}, 'false')) = 'true' AS is_t, lower(coalesce({jx('internal_traffic')}, 'false')) = 'true' AS is_i
  FROM fx),
cls AS (SELECT *,
  CASE WHEN is_i OR regexp_matches(u, '{CLASSIFY_INTERNAL_URL_PARAM}') OR regexp_matches(u, '{FX_CONTROL_PATTERN}')
      OR regexp_matches(u, '{CLASSIFY_LOCALHOST}') THEN 'internal'
    WHEN regexp_matches(ua, '{CLASSIFY_BOT_UA}') THEN 'bot'
    WHEN u LIKE '%preview_theme_id=%' OR pth LIKE '%preview_theme_id=%' OR u LIKE '%shopify-preview%' THEN 'preview'
    WHEN is_t OR regexp_matches(u, '{CLASSIFY_TEST_URL_PARAM}') OR regexp_matches(cmp, '{CLASSIFY_TEST_CAMPAIGN}') THEN 'qa'
    ELSE 'production' END AS c,
  CASE WHEN is_i THEN 'property_internal_traffic'
    WHEN regexp_matches(u, '{CLASSIFY_INTERNAL_URL_PARAM}') THEN 'url_ct_internal'
    WHEN regexp_matches(u, '{FX_CONTROL_PATTERN}') THEN 'tracker_control_surface'
    WHEN regexp_matches(u, '{CLASSIFY_LOCALHOST}') THEN 'localhost'
    WHEN regexp_matches(ua, '{CLASSIFY_BOT_UA}') THEN 'known_bot_user_agent'
    WHEN u LIKE '%preview_theme_id=%' OR pth LIKE '%preview_theme_id=%' THEN 'shopify_theme_preview'
    WHEN u LIKE '%shopify-preview%' THEN 'shopify_preview'
    WHEN is_t THEN 'property_test'
    WHEN regexp_matches(u, '{CLASSIFY_TEST_URL_PARAM}') THEN 'url_ct_test'
    WHEN regexp_matches(cmp, '{CLASSIFY_TEST_CAMPAIGN}') THEN 'test_campaign'
    ELSE 'production_default' END AS r
  FROM cin)"""

SQL["classify_traffic"] = FX + f""",
{_CLS_INPUT}
SELECT event_id, c AS traffic_classification, r AS traffic_classification_reason FROM cls"""

SQL["reclassify_history"] = FX + f""",
{_CLS_INPUT}
SELECT event_id, c AS traffic_classification, r AS traffic_classification_reason,
  '1' AS traffic_classification_version, '2024-01-31T00:00:00Z' AS traffic_classified_at,
  CASE WHEN c <> 'production' THEN 'true' ELSE {jx('test')} END AS test,
  CASE WHEN c = 'internal' THEN 'true' ELSE {jx('internal_traffic')} END AS internal_traffic,
  CAST(len(list_distinct(json_keys(properties) || ['traffic_classification', 'traffic_classification_reason',
    'traffic_classification_version', 'traffic_classified_at']
    || CASE WHEN c <> 'production' THEN ['test'] ELSE [] END
    || CASE WHEN c = 'internal' THEN ['internal_traffic'] ELSE [] END)) AS INTEGER) AS n_keys
FROM cls"""

SQL["mark_duplicates"] = FX + f"""
SELECT event_id, {_SID} AS shopify_event_id,
  coalesce({_SID} IS NOT NULL AND row_number() OVER (PARTITION BY {_SID} ORDER BY received_at, event_id) > 1, false) AS is_duplicate
FROM fx"""

SQL["dedupe_shopify"] = FX + f"""
SELECT event_id, received_at FROM fx
QUALIFY {_SID} IS NULL OR row_number() OVER (PARTITION BY {_SID} ORDER BY received_at, event_id) = 1"""

SQL["insert_ignore"] = FX + f""",
target AS (SELECT event_id FROM fx WHERE received_at < TIMESTAMP '{_T_OLD}'),
batch AS (SELECT * FROM fx WHERE received_at >= TIMESTAMP '{_T_NEW}'
  UNION ALL SELECT * FROM fx WHERE received_at >= TIMESTAMP '{_T_REPLAY}')
SELECT DISTINCT event_id, received_at FROM batch WHERE event_id NOT IN (SELECT event_id FROM target)"""

SQL["anti_existing"] = FX + f""",
target AS (SELECT {_SID} AS sid FROM fx WHERE received_at < TIMESTAMP '{_T_OLD}' AND {_SID} IS NOT NULL),
fresh AS (SELECT * FROM fx WHERE received_at >= TIMESTAMP '{_T_OLD}'
  AND ({_SID} IS NULL OR {_SID} NOT IN (SELECT sid FROM target)))
SELECT event_id, received_at FROM fresh
QUALIFY {_SID} IS NULL OR row_number() OVER (PARTITION BY {_SID} ORDER BY received_at, event_id) = 1"""

_LEGACY = f"coalesce({jx('traffic_classification')}, 'production') <> 'production'"
SQL["archive_split"] = FX + f"""
SELECT event_id, received_at FROM fx WHERE {_LEGACY} AND received_at < TIMESTAMP '{_T_OLD}'"""

SQL["archive_remainder"] = FX + f"""
SELECT event_id, received_at FROM fx WHERE NOT coalesce({_LEGACY} AND received_at < TIMESTAMP '{_T_OLD}', false)"""

SQL["stamp_duplicates"] = FX + f""",
d AS (SELECT event_id, properties,
  coalesce({_SID} IS NOT NULL AND row_number() OVER (PARTITION BY {_SID} ORDER BY received_at, event_id) > 1, false) AS is_duplicate FROM fx)
SELECT event_id, is_duplicate, CASE WHEN is_duplicate THEN 'duplicate' ELSE {jx('traffic_classification')} END AS traffic_classification,
  CASE WHEN is_duplicate THEN 'duplicate_shopify_event_id' ELSE {jx('traffic_classification_reason')} END AS traffic_classification_reason,
  CASE WHEN is_duplicate THEN 'true' ELSE {jx('test')} END AS test FROM d"""

SQL["archive_record"] = FX + f"""
SELECT count(*) FILTER (WHERE {_LEGACY} AND received_at < TIMESTAMP '{_T_OLD}') AS rows_archived,
  CAST(0 AS BIGINT) AS rows_remaining, TIMESTAMP '{_T_OLD}' AS cutover FROM fx"""

SQL["validate_events"] = FX + """
SELECT event_id AS source_event_id, CASE event_id % 97 WHEN 1 THEN 'invalid_identifiers'
  WHEN 2 THEN 'invalid_event_name' WHEN 5 THEN 'invalid_page_url' WHEN 3 THEN 'invalid_timestamp' END AS reject_reason
FROM fx"""


def _hint(col: str) -> str:
    return (f"coalesce(NULLIF(trim({col}), ''), "
            f"NULLIF(trim(regexp_extract(page_url, '[?&]{col}=([^&#]*)', 1)), ''))")


SQL["ingest_events_batch"] = FX + f"""
SELECT event_id AS source_event_id, printf('%08x-0000-4000-8000-%012x', 1, event_id) AS event_id, event_name,
  CASE WHEN event_id % 97 IN (4, 7) THEN received_at ELSE client_timestamp END AS client_timestamp, received_at,
  NULLIF(trim(page_path), '') AS page_path, NULLIF(trim(page_title), '') AS page_title,
  NULLIF(trim(referrer), '') AS referrer, {_hint('utm_source')} AS utm_source, {_hint('utm_medium')} AS utm_medium,
  {_hint('utm_campaign')} AS utm_campaign, {_hint('utm_content')} AS utm_content, {_hint('utm_term')} AS utm_term,
  {_hint('fbclid')} AS fbclid, NULLIF(trim(device_type), '') AS device_type, CASE WHEN event_id % 97 <> 8 THEN screen_width END AS screen_width,
  NULLIF(trim(language), '') AS language,
  CASE WHEN lower({jx('internal_traffic')}) = 'true' THEN 'true' ELSE {jx('test')} END AS test,
  {jx('internal_traffic')} AS internal_traffic, {jx('checkout_id')} AS checkout_id, {jx('value')} AS value, {jx('shopify_event_id')} AS shopify_event_id,
  {jx('first_touch.utm_campaign')} AS "first_touch.utm_campaign",
  CASE WHEN event_id % 97 = 9 THEN printf('%08x-0000-4000-8000-%012x', 4, event_id) END AS hint_session_id,
  CASE WHEN event_id % 97 = 9 OR regexp_matches(page_url, '[?&](utm_source|utm_medium|utm_campaign|utm_content|utm_term|fbclid|ref|order_id|checkout_id|checkout_token)=[^&#]') THEN 'query' END AS hint_source,
  3 AS ingestion_version, {jx('server_context.user_agent')} AS user_agent,
  CASE WHEN event_id % 97 IN (4, 7) THEN 0 ELSE greatest(0, epoch_ms(received_at) - epoch_ms(client_timestamp)) END AS client_server_lag_ms
FROM fx WHERE event_id % 97 NOT IN (1, 2, 3, 5)"""

SQL["constraint_check"] = FX + """
SELECT count(*) AS rows,
  count(*) FILTER (WHERE NOT coalesce(regexp_matches(event_name, '^[a-z][a-z0-9_]{0,63}$'), false)) AS bad_event_name,
  count(*) FILTER (WHERE device_type IS NOT NULL AND device_type NOT IN ('mobile', 'tablet', 'desktop')) AS bad_device_type,
  count(*) FILTER (WHERE screen_width IS NOT NULL AND NOT (screen_width BETWEEN 0 AND 20000)) AS bad_screen_width,
  count(*) FILTER (WHERE event_id IS NULL OR visitor_id IS NULL OR session_id IS NULL OR client_timestamp IS NULL
    OR page_url IS NULL) AS missing_required
FROM fx"""

SQL["production_only"] = FX + f"""
SELECT event_id, event_name, visitor_id FROM fx
WHERE coalesce({jx('traffic_classification')}, 'production') = 'production' AND {NOT_TEST} AND {NOT_INTERNAL}"""

SQL["has_any_key"] = BASE + """
SELECT event_id FROM base WHERE list_has_any(json_keys(properties),
  ['concept', 'hook', 'sales_message', 'format', 'angle', 'awareness_level', 'landing_version', 'offer_version'])"""

SQL["dedupe_consecutive_pages"] = BASE + f""",
pv AS (SELECT *, NULLIF({jx('page_instance_id')}, '') AS pi FROM base WHERE event_name = 'page_view')
SELECT event_id FROM pv WHERE pi IS NULL
UNION ALL
SELECT event_id FROM (SELECT event_id, page_url,
    lag(page_url) OVER (PARTITION BY pi ORDER BY client_timestamp, event_id) AS prev FROM pv WHERE pi IS NOT NULL)
WHERE prev IS DISTINCT FROM page_url"""

_SESS30 = """s30 AS (SELECT *, CAST(sum(CASE WHEN prev IS NULL OR epoch_us(client_timestamp) - epoch_us(prev) > 1800000000
    THEN 1 ELSE 0 END) OVER (PARTITION BY visitor_id ORDER BY client_timestamp, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_no
  FROM (SELECT *, lag(client_timestamp) OVER (PARTITION BY visitor_id ORDER BY client_timestamp, event_id) AS prev FROM fx))"""

SQL["sessionize"] = FX + f""",
{_SESS30}
SELECT event_id, visitor_id, session_no FROM s30"""

SQL["session_windows"] = FX + f""",
{_SESS30}
SELECT visitor_id, min(client_timestamp) AS session_start, max(client_timestamp) + INTERVAL 30 MINUTE AS session_end,
  count(*) AS events
FROM s30 GROUP BY visitor_id, session_no"""

SQL["session_entries"] = BASE + f"""
SELECT session_id, visitor_id, client_timestamp AS started_at, page_url AS landing_page, {ft('utm_source')} AS source
FROM base QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY client_timestamp, event_id) = 1"""

SQL["latest_page_summary"] = BASE + f"""
SELECT session_id, coalesce(NULLIF({jx('page_instance_id')}, ''), CAST(session_id AS VARCHAR)) AS page_instance_key,
  {_num0('visible_seconds')} AS visible_seconds, {_num0('duration_seconds')} AS duration_seconds,
  {_num0('max_scroll_depth')} AS max_scroll_depth, {_num0('sections_viewed')} AS sections_viewed,
  {_num0('rage_click_count')} AS rage_click_count, {_num0('dead_click_count')} AS dead_click_count,
  {jx('quick_exit')} AS quick_exit
FROM base WHERE event_name = 'session_summary'
QUALIFY row_number() OVER (PARTITION BY session_id, page_instance_key ORDER BY client_timestamp DESC, event_id DESC) = 1"""

SQL["visitor_counters"] = BASE + """,
firsts AS (SELECT visitor_id, session_id, client_timestamp, event_id
  FROM base QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY client_timestamp, event_id) = 1),
starts AS (SELECT visitor_id, session_id,
  row_number() OVER (PARTITION BY visitor_id ORDER BY client_timestamp, event_id) AS visit_number FROM firsts),
x AS (SELECT b.event_id, b.event_name, s.visit_number,
    min(b.client_timestamp) OVER (PARTITION BY b.visitor_id) AS first_seen_at,
    CAST(sum(CASE WHEN b.event_name = 'page_view' THEN 1 ELSE 0 END) OVER (PARTITION BY b.session_id
      ORDER BY b.client_timestamp, b.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS pis,
    CAST(sum(CASE WHEN b.event_name = 'page_view' THEN 1 ELSE 0 END) OVER (PARTITION BY b.visitor_id
      ORDER BY b.client_timestamp, b.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS piv
  FROM base b JOIN starts s ON s.session_id = b.session_id AND s.visitor_id = b.visitor_id)
SELECT event_id, visit_number, CASE WHEN event_name = 'page_view' THEN pis END AS page_view_index_in_session,
  CASE WHEN event_name = 'page_view' THEN piv END AS page_view_index_for_visitor, first_seen_at,
  visit_number > 1 AS returning_visitor
FROM x"""

SQL["touch_attribution"] = BASE + """,
t AS (SELECT event_id, visitor_id, session_id, client_timestamp,
    CASE WHEN NULLIF(trim(utm_source), '') IS NOT NULL OR NULLIF(trim(utm_campaign), '') IS NOT NULL
      OR NULLIF(trim(fbclid), '') IS NOT NULL THEN {'utm_source': NULLIF(trim(utm_source), ''),
      'utm_campaign': NULLIF(trim(utm_campaign), ''), 'fbclid': NULLIF(trim(fbclid), '')} END AS touch
  FROM base),
ft AS (SELECT visitor_id, touch AS first_touch FROM t WHERE touch IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY visitor_id ORDER BY client_timestamp, event_id) = 1),
st AS (SELECT *, last_value(touch IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY client_timestamp, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session_touch FROM t)
SELECT st.event_id, ft.first_touch.utm_source AS first_touch_source, ft.first_touch.utm_campaign AS first_touch_campaign,
  st.session_touch.utm_campaign AS session_touch_campaign, st.session_touch.fbclid AS session_touch_fbclid,
  coalesce(st.session_touch, st.touch, ft.first_touch).utm_source AS active_touch_source,
  coalesce(st.session_touch, st.touch, ft.first_touch).utm_campaign AS active_touch_campaign
FROM st LEFT JOIN ft ON ft.visitor_id = st.visitor_id"""

# ------------------------------------------------------------------ statistics / economics
_EPS = "2.220446049250313e-16"


def jr(x: str, d: int = 2) -> str:
    return f"(floor(({x} + {_EPS}) * {float(10 ** d)} + 0.5) / {float(10 ** d)})"


def div4(n: str, d: str) -> str:
    return f"(CASE WHEN {n} IS NOT NULL AND {d} IS NOT NULL AND {d} > 0 THEN {jr(f'CAST({n} AS DOUBLE) / {d}', 4)} END)"


def pct(n: str, d: str) -> str:
    return f"(CASE WHEN {div4(n, d)} IS NOT NULL THEN {jr(div4(n, d) + ' * 100.0', 4)} END)"


_OFFERS = """offers AS (SELECT substring(o_orderpriority, 1, 1) AS offer_id,
    CAST(round(avg(o_totalprice) / 1000.0, 2) AS VARCHAR) AS average_order_value,
    CAST(30 + 10 * CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS VARCHAR) AS contribution_margin_percent,
    CAST(18 * CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS VARCHAR) AS desired_profit_percent
  FROM orders GROUP BY 1),
oe AS (SELECT *, CAST(average_order_value AS DOUBLE) AS aov, CAST(contribution_margin_percent AS DOUBLE) AS mp,
    CAST(desired_profit_percent AS DOUBLE) AS dp FROM offers),
ov AS (SELECT *, aov > 0 AND mp >= 0 AND mp <= 100 AND dp >= 0 AND dp <= mp AS valid,
    aov * (mp / 100.0) AS cm, aov * (dp / 100.0) AS pr, greatest(0.0, aov * (mp / 100.0) - aov * (dp / 100.0)) AS tg FROM oe)"""

_ECON_COLS = f"""true AS economics_configured, coalesce(valid, false) AS economics_valid,
  CASE WHEN valid THEN NULL WHEN dp > mp THEN 'profit_exceeds_margin' ELSE 'invalid_ranges' END AS economics_warning,
  CASE WHEN valid THEN {jr('cm')} END AS contribution_margin_before_ads,
  CASE WHEN valid THEN {jr('cm')} END AS break_even_cac,
  CASE WHEN valid THEN {jr('tg')} END AS target_cac,
  CASE WHEN valid THEN {jr('pr')} END AS desired_profit_after_ads,
  CASE WHEN valid AND cm > 0 THEN {jr('aov / cm', 4)} END AS break_even_roas,
  CASE WHEN valid AND tg > 0 THEN {jr('aov / tg', 4)} END AS target_roas,
  CASE WHEN valid THEN {jr('mp', 4)} END AS margin_percent"""

SQL["unit_economics"] = f"""WITH {_OFFERS}
SELECT offer_id, average_order_value, contribution_margin_percent, desired_profit_percent, {_ECON_COLS} FROM ov"""

_CAMP = ADS + r""",
camp AS (SELECT campaign_id, CAST((CAST(regexp_extract(campaign_id, '(\d+)$', 1) AS INTEGER) % 5) + 1 AS VARCHAR) AS offer_id,
    round(CAST(coalesce(sum(spend), 0) AS DOUBLE), 2) AS spend, CAST(coalesce(sum(impressions), 0) AS BIGINT) AS impressions,
    CAST(coalesce(sum(reach), 0) AS BIGINT) AS reach, CAST(NULL AS DOUBLE) AS three_second_views,
    CAST(coalesce(sum(clicks), 0) AS BIGINT) AS link_clicks, CAST(coalesce(sum(landing_page_views), 0) AS BIGINT) AS landing_page_views,
    CAST(coalesce(sum(add_to_cart), 0) AS BIGINT) AS add_to_carts, CAST(coalesce(sum(initiate_checkout), 0) AS BIGINT) AS checkouts,
    coalesce(sum(purchases), 0) AS purchases, round(CAST(coalesce(sum(purchase_value), 0) AS DOUBLE), 2) AS revenue
  FROM ads GROUP BY campaign_id)"""

_METRICS = {
    "hook_rate_percent": pct("three_second_views", "impressions"),
    "frequency": div4("impressions", "reach"),
    "ctr_percent": pct("link_clicks", "impressions"),
    "cpm": f"(CASE WHEN spend IS NOT NULL AND impressions > 0 THEN {jr('spend / impressions * 1000.0', 4)} END)",
    "cpc": div4("spend", "link_clicks"),
    "click_to_landing_page_rate_percent": pct("landing_page_views", "link_clicks"),
    "cost_per_landing_page_view": div4("spend", "landing_page_views"),
    "add_to_cart_rate_percent": pct("add_to_carts", "landing_page_views"),
    "cost_per_add_to_cart": div4("spend", "add_to_carts"),
    "add_to_cart_to_checkout_rate_percent": pct("checkouts", "add_to_carts"),
    "add_to_cart_to_purchase_rate_percent": pct("purchases", "add_to_carts"),
    "landing_page_to_checkout_rate_percent": pct("checkouts", "landing_page_views"),
    "cost_per_checkout": div4("spend", "checkouts"),
    "checkout_to_purchase_rate_percent": pct("purchases", "checkouts"),
    "landing_page_to_purchase_rate_percent": pct("purchases", "landing_page_views"),
    "cac": div4("spend", "purchases"),
    "roas": div4("revenue", "spend"),
    "observed_average_order_value": div4("revenue", "purchases"),
    "revenue_per_landing_page_view": div4("revenue", "landing_page_views"),
}
_METRIC_SELECT = ",\n  ".join(f"{v} AS {k}" for k, v in _METRICS.items())

SQL["funnel_metrics"] = _CAMP + f"""
SELECT camp.*, {_METRIC_SELECT} FROM camp"""

_W = [
    ("reach_exceeds_impressions", "reach > impressions"),
    ("three_second_views_exceed_impressions", "three_second_views > impressions"),
    ("clicks_exceed_impressions", "link_clicks > impressions"),
    ("landing_page_views_exceed_clicks", "landing_page_views > link_clicks"),
    ("add_to_carts_exceed_landing_page_views", "add_to_carts > landing_page_views"),
    ("checkouts_exceed_add_to_carts", "checkouts > add_to_carts"),
    ("purchases_exceed_checkouts", "purchases > checkouts"),
    ("revenue_without_purchases", "revenue IS NOT NULL AND revenue > 0 AND (purchases IS NULL OR purchases = 0)"),
    ("add_to_carts_missing", "add_to_carts IS NULL AND checkouts IS NOT NULL"),
]
SQL["funnel_warnings"] = _CAMP + """
SELECT campaign_id, true AS funnel_valid, concat_ws(',', """ + ", ".join(
    f"CASE WHEN coalesce({c}, false) THEN '{n}' END" for n, c in _W) + """) AS warnings FROM camp"""

_STATUS = {
    "creative": "CASE WHEN impressions IS NULL AND link_clicks IS NULL THEN 'missing' WHEN coalesce(impressions, 0) >= 2000 OR coalesce(link_clicks, 0) >= 30 THEN 'decision_ready' ELSE 'insufficient' END",
    "landing_delivery": "CASE WHEN link_clicks IS NULL THEN 'missing' WHEN link_clicks >= 30 THEN 'decision_ready' ELSE 'insufficient' END",
    "page": "CASE WHEN landing_page_views IS NULL THEN 'missing' WHEN landing_page_views >= 100 THEN 'decision_ready' ELSE 'insufficient' END",
    "cart": "CASE WHEN add_to_carts IS NULL THEN 'missing' WHEN add_to_carts >= 10 THEN 'directional' ELSE 'insufficient' END",
    "checkout": "CASE WHEN checkouts IS NULL THEN 'missing' WHEN checkouts < 10 THEN 'insufficient' WHEN checkouts < 20 THEN 'directional' ELSE 'decision_ready' END",
    "cac": "CASE WHEN purchases IS NULL THEN 'missing' WHEN purchases < 5 THEN 'insufficient' WHEN purchases < 10 THEN 'directional' WHEN purchases < 20 THEN 'decision_ready' ELSE 'strong' END",
}
SQL["sample_readiness"] = _CAMP + "\nSELECT campaign_id, " + ", ".join(
    f"{v} AS {k}_sample_status" for k, v in _STATUS.items()) + " FROM camp"


def _h(v: str, st: str, poor, good) -> str:
    return (f"CASE WHEN {v} IS NULL THEN 'unavailable' WHEN {st} IN ('missing', 'insufficient') THEN 'sample_insufficient' "
            f"WHEN {v} < {poor} THEN 'bottleneck' WHEN {v} >= {good} THEN 'healthy' ELSE 'watch' END")


_STAGES = [
    ("creative_hook", "hook_rate_percent", "s_creative", 20, 30),
    ("creative_click", "ctr_percent", "s_creative", 1, 1.5),
    ("landing_delivery", "click_to_landing_page_rate_percent", "s_landing_delivery", 70, 80),
    ("sales_page", "add_to_cart_rate_percent", "s_page", 4, 8),
    ("cart", "add_to_cart_to_checkout_rate_percent", "s_cart", 30, 45),
    ("checkout", "checkout_to_purchase_rate_percent", "s_checkout", 35, 50),
    ("full_funnel", "landing_page_to_purchase_rate_percent", "s_page", 1, 2),
]
_HEALTH = [(n, _h(m, s, p, g)) for n, m, s, p, g in _STAGES] + [(
    "economics", "CASE WHEN cac IS NULL OR target_cac IS NULL THEN 'unavailable' WHEN s_cac IN ('missing', 'insufficient') "
    "THEN 'sample_insufficient' WHEN cac > target_cac THEN 'bottleneck' ELSE 'healthy' END")]


def _first(kind: str) -> str:
    return "CASE " + " ".join(f"WHEN h_{n} = '{kind}' THEN '{n}'" for n, _ in _HEALTH) + " END"


SQL["diagnose_funnel"] = _CAMP + ",\n" + _OFFERS + f""",
m AS (SELECT camp.*, {_METRIC_SELECT}, {', '.join(f'{v} AS s_{k}' for k, v in _STATUS.items())} FROM camp),
j AS (SELECT m.*, CASE WHEN ov.valid THEN {jr('ov.tg')} END AS target_cac, CASE WHEN ov.valid THEN {jr('ov.mp', 4)} END AS margin_percent
  FROM m LEFT JOIN ov ON ov.offer_id = m.offer_id),
h AS (SELECT *, {', '.join(f'{v} AS h_{n}' for n, v in _HEALTH)},
  CASE WHEN purchases IS NOT NULL AND target_cac IS NOT NULL THEN {jr('purchases * target_cac')} END AS max_spend,
  CASE WHEN revenue IS NOT NULL AND spend IS NOT NULL AND margin_percent IS NOT NULL
    THEN {jr('revenue * (margin_percent / 100.0) - spend')} END AS profit FROM j)
SELECT campaign_id, offer_id, target_cac, cac,
  CASE WHEN cac IS NULL OR target_cac IS NULL THEN 'unavailable' WHEN cac <= target_cac THEN 'within_target' ELSE 'above_target' END AS cac_status,
  CASE WHEN cac IS NOT NULL AND target_cac IS NOT NULL THEN {jr('cac - target_cac')} END AS cac_difference,
  CASE WHEN cac IS NOT NULL AND target_cac > 0 THEN {jr('(cac - target_cac) / target_cac * 100.0', 4)} END AS cac_difference_percent,
  max_spend AS max_spend_at_target_cac,
  CASE WHEN max_spend IS NOT NULL AND spend IS NOT NULL THEN {jr('max_spend - spend')} END AS spend_headroom_vs_target,
  profit AS estimated_contribution_profit_after_ads,
  {div4('profit', 'purchases')} AS estimated_contribution_profit_per_purchase,
  concat_ws(',', {', '.join(f"'{n}:' || h_{n}" for n, _ in _HEALTH)}) AS stage_health,
  {_first('bottleneck')} AS first_probable_bottleneck,
  {_first('sample_insufficient')} AS first_stage_waiting_for_sample,
  CASE WHEN {_first('bottleneck')} IS NOT NULL THEN 'probable_bottleneck'
    WHEN {_first('sample_insufficient')} IS NOT NULL THEN 'waiting_for_sample'
    WHEN {' AND '.join(f"h_{n} IN ('healthy', 'watch', 'unavailable')" for n, _ in _HEALTH)} THEN 'no_confirmed_bottleneck'
    ELSE 'no_data' END AS diagnosis_summary
FROM h"""

_Z = "1.959963984540054"


def _wilson_row(name: str, s: str, n: str) -> str:
    p = f"(CAST({s} AS DOUBLE) / {n})"
    den = f"(1.0 + {_Z} * {_Z} / {n})"
    center = f"(({p} + {_Z} * {_Z} / (2.0 * {n})) / {den})"
    margin = f"(({_Z} / {den}) * sqrt({p} * (1.0 - {p}) / {n} + {_Z} * {_Z} / (4.0 * {n} * {n})))"
    valid = f"({n} > 0 AND {s} >= 0 AND {s} <= {n})"
    return (f"SELECT '{name}' AS transition, CAST({s} AS BIGINT) AS successes, CAST({n} AS BIGINT) AS total, "
            f"CASE WHEN {valid} THEN round({p}, 6) END AS rate, "
            f"CASE WHEN {valid} THEN round(greatest(0.0, {center} - {margin}), 6) END AS lower_95, "
            f"CASE WHEN {valid} THEN round(least(1.0, {center} + {margin}), 6) END AS upper_95, "
            f"{valid} AS valid, CASE WHEN {valid} THEN NULL WHEN {s} > {n} THEN "
            f"'successes exceed total: identity fragmentation or incompatible units' ELSE 'no valid denominator' END AS warning FROM f")


_TRANS = [
    ("page_view_to_cta_impression", "cta_impression_visitors", "page_view_visitors"),
    ("cta_impression_to_buy_click", "buy_click_visitors", "cta_impression_visitors"),
    ("buy_click_to_checkout", "checkout_visitors", "buy_click_visitors"),
    ("checkout_to_purchase", "purchase_visitors", "checkout_visitors"),
    ("page_view_to_checkout", "checkout_visitors", "page_view_visitors"),
    ("page_view_to_purchase", "purchase_visitors", "page_view_visitors"),
]
_FUNNEL_CTE = f"""f AS (SELECT count(DISTINCT visitor_id) AS visitors,
  {dvis("event_name = 'page_view'", 'page_view_visitors')},
  {dvis("event_name = 'cta_impression'", 'cta_impression_visitors')},
  {dvis("event_name = 'buy_button_click'", 'buy_click_visitors')},
  {dvis("event_name = 'add_to_cart'", 'add_to_cart_visitors')},
  {dvis("event_name = 'checkout_started'", 'checkout_visitors')},
  {dvis("event_name = 'purchase'", 'purchase_visitors')}
FROM base)"""
SQL["funnel_confidence"] = BASE + ",\n" + _FUNNEL_CTE + "\n" + "\nUNION ALL\n".join(_wilson_row(*t) for t in _TRANS)

SQL["coverage"] = BASE + f""",
sv AS (SELECT session_id, max({VER}) AS version FROM base GROUP BY session_id),
o AS (SELECT count(DISTINCT session_id) AS sessions, count(DISTINCT visitor_id) AS unique_visitors,
  (SELECT count(*) FROM sv WHERE version >= 2) AS v2, (SELECT count(*) FROM sv WHERE version >= 3) AS v3 FROM base)
SELECT sessions, unique_visitors,
  CASE WHEN sessions > 0 THEN round(CAST(v2 AS DOUBLE) / sessions * 100.0, 2) ELSE 0.0 END AS session_v2_coverage_percent,
  CASE WHEN sessions > 0 THEN round(CAST(v3 AS DOUBLE) / sessions * 100.0, 2) ELSE 0.0 END AS session_v3_coverage_percent,
  CASE WHEN unique_visitors > 0 THEN round(CAST(sessions AS DOUBLE) / unique_visitors, 4) ELSE 0.0 END AS sessions_per_visitor
FROM o"""


def _score(x: str) -> str:
    return f"CAST(least(100, greatest(0, floor(coalesce({x}, 0.0) * 100.0 + 0.5))) AS INTEGER)"


def _sd(n: str, d: str) -> str:
    return f"coalesce(CASE WHEN {d} > 0 THEN round(CAST({n} AS DOUBLE) / {d}, 6) END, 0.0)"


SQL["readiness_score"] = (BASE + ",\n" + _FUNNEL_CTE + f""",
entries AS (SELECT session_id, visitor_id, {VER} AS version
  FROM base QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY client_timestamp, event_id) = 1),
i AS (SELECT count(*) AS sessions, count(DISTINCT visitor_id) AS unique_visitors,
    count(*) FILTER (WHERE version >= 3) AS session_v3_sessions,
    (SELECT count(DISTINCT session_id) FROM base WHERE event_name = 'session_summary') AS summary_sessions,
    (SELECT count(*) FROM base WHERE event_name IN ('checkout_started', 'purchase')
      AND NULLIF({jx('conversion_attribution.session_id')}, '') IS NOT NULL) AS resolved,
    (SELECT count(*) FROM base WHERE event_name IN ('checkout_started', 'purchase')) AS conv,
    (SELECT cta_impression_visitors FROM f) AS cta, (SELECT page_view_visitors FROM f) AS pv,
    (SELECT count(*) FROM fx_ads WHERE date_start >= DATE '{FX_ADS_AS_OF}' - INTERVAL {ADS_DAYS} DAY) AS ad_rows
  FROM entries),
s AS (SELECT *, {_score('least(1.0, unique_visitors / 100.0)')} AS sample_score,
    {_score(_sd('session_v3_sessions', 'sessions'))} AS session_v3_score,
    {_score(_sd('summary_sessions', 'sessions'))} AS summary_coverage_score,
    {_score(_sd('resolved', 'conv'))} AS attribution_score,
    {_score('greatest(' + _sd('cta', 'pv') + ', ' + _sd('summary_sessions', 'sessions') + ')')} AS behavior_coverage_score,
    CASE WHEN ad_rows > 0 THEN 100 ELSE 0 END AS meta_ads_score FROM i)
SELECT CAST(floor(sample_score * 0.15 + session_v3_score * 0.2 + summary_coverage_score * 0.2 + attribution_score * 0.25
    + behavior_coverage_score * 0.1 + meta_ads_score * 0.1 + 0.5) AS INTEGER) AS overall_score,
  sample_score, session_v3_score, summary_coverage_score, attribution_score, behavior_coverage_score, meta_ads_score,
  CASE WHEN unique_visitors < 20 THEN 'exploratory_only' WHEN unique_visitors < 100 THEN 'directional'
    ELSE 'stronger_directional' END AS sample_label
FROM s""").replace("WITH fx_base", "WITH " + FX_ADS_DUCK + ",\nfx_base", 1)

SQL["readiness_labels"] = (BASE + ",\n" + _FUNNEL_CTE + f""",
sv AS (SELECT session_id, max({VER}) AS version FROM base GROUP BY session_id),
pvv AS (SELECT DISTINCT visitor_id FROM base WHERE event_name = 'page_view'),
cvv AS (SELECT DISTINCT visitor_id FROM base WHERE event_name IN ('checkout_started', 'purchase')),
i AS (SELECT count(DISTINCT visitor_id) AS uv, count(DISTINCT session_id) AS s,
    (SELECT count(*) FROM sv WHERE version >= 3) AS v3,
    (SELECT count(*) FROM cvv WHERE visitor_id NOT IN (SELECT visitor_id FROM pvv)) AS orphans,
    (SELECT count(*) FROM fx_ads WHERE date_start >= DATE '{FX_ADS_AS_OF}' - INTERVAL {ADS_DAYS} DAY) AS ad_rows,
    (SELECT purchase_visitors FROM f) AS pu FROM base)
SELECT CASE WHEN uv < 20 THEN 'exploratory_only' WHEN uv < 100 THEN 'directional' ELSE 'stronger_directional' END AS sample_label,
  s > 0 AND v3 = s AS tracker_v3_ready, ad_rows > 0 AS meta_ads_available,
  concat_ws(',', CASE WHEN uv < 20 THEN 'sample_below_20_visitors' END,
    CASE WHEN s > 0 AND v3 < s THEN 'not_all_sessions_tracker_v3' END,
    CASE WHEN orphans > 0 THEN 'orphan_conversions' END, CASE WHEN ad_rows = 0 THEN 'no_ad_data' END,
    CASE WHEN pu = 0 THEN 'no_external_purchase' END) AS blockers
FROM i""").replace("WITH fx_base", "WITH " + FX_ADS_DUCK + ",\nfx_base", 1)

SQL["normalize_ads"] = "WITH " + FX_ADS_DUCK.split(",\nfx_ads AS")[0] + """,
r AS (SELECT *, ingested_seq % 23 AS rr FROM fx_ads_raw)
SELECT ingested_seq,
  CASE WHEN rr = 1 THEN 'unknown-account' ELSE account_id END AS account_id,
  CASE WHEN rr IN (2, 3) THEN NULL ELSE date_start END AS date_start,
  CASE WHEN rr = 4 THEN NULL ELSE campaign_id END AS campaign_id,
  CASE WHEN rr = 5 THEN 'unknown-adset' ELSE adset_id END AS adset_id,
  ad_id,
  round(CASE WHEN rr = 6 THEN 0.0 ELSE greatest(0.0, CAST(spend AS DOUBLE)) END, 6) AS spend,
  CAST(greatest(0, floor(impressions + 0.5)) AS BIGINT) AS impressions,
  CAST(landing_page_views AS BIGINT) AS landing_page_views,
  round(greatest(0.0, purchases), 6) AS purchases,
  rr NOT IN (2, 3, 4) AS accepted
FROM r"""

SQL["ads_ingest_json"] = SQL["normalize_ads"]

SQL["export_health"] = BASE + """
SELECT 'overview_basic' AS name, true AS ok, CAST(1 AS BIGINT) AS rows, CAST(NULL AS VARCHAR) AS error
UNION ALL SELECT 'event_catalog', true, (SELECT count(DISTINCT event_name) FROM base), NULL
UNION ALL SELECT 'raw_events', true, (SELECT count(*) FROM base), NULL"""

SQL["export_scope"] = BASE + """
SELECT 'full' AS mode, CAST(3 AS BIGINT) AS complete_query_blocks, CAST(0 AS BIGINT) AS failed_query_blocks,
  CAST(NULL AS INTEGER) AS raw_event_limit, count(*) AS raw_events_included, false AS raw_event_limit_reached
FROM base"""

# ------------------------------------------------------------------ streaming (same rows as batch)
_STREAM_ACC = FX + f""",
{_CLS_INPUT},
acc AS (SELECT cls.*, event_id % 97 AS kk FROM cls WHERE event_id % 97 NOT IN (1, 2, 3, 5)),
ded AS (SELECT * FROM acc
  QUALIFY {_SID} IS NULL OR row_number() OVER (PARTITION BY {_SID} ORDER BY received_at, event_id) = 1),
st AS (SELECT event_id, event_name, visitor_id, session_id, received_at, c, properties, kk,
  CASE WHEN kk IN (4, 7) THEN received_at ELSE client_timestamp END AS client_ts,
  {_hint('utm_source')} AS src, {_hint('utm_campaign')} AS cmp, {_hint('fbclid')} AS fb FROM ded)
"""

SQL["stream_ingest"] = _STREAM_ACC + f"""
SELECT event_id AS source_event_id, event_name, client_ts AS client_timestamp, received_at,
  c AS traffic_classification, CASE WHEN c <> 'production' THEN 'true' ELSE {jx('test')} END AS test
FROM st"""

SQL["stream_dead_letter"] = FX + """,
rej AS (SELECT event_id, received_at, CASE event_id % 97 WHEN 1 THEN 'invalid_identifiers'
    WHEN 2 THEN 'invalid_event_name' WHEN 5 THEN 'invalid_page_url' WHEN 3 THEN 'invalid_timestamp' END AS reject_reason
  FROM fx WHERE event_id % 97 IN (1, 2, 3, 5))
SELECT reject_reason, event_id AS source_event_id FROM rej
UNION ALL SELECT reject_reason, event_id FROM rej
  WHERE event_id % 20 = 7 AND received_at < TIMESTAMP '2024-01-22'
UNION ALL SELECT 'invalid_json', CAST(NULL AS BIGINT)
UNION ALL SELECT 'invalid_json', CAST(NULL AS BIGINT)"""

_STREAM_MATCHES = ",\n".join([
    _match('mc', 'checkout_key', _cands("'checkout_started', 'add_to_cart', 'buy_button_click'", [jx('checkout_id'), jx('ct_checkout_id'), jx('checkout_token'), jx('conversion_attribution.checkout_id')])),
    _match('mo', 'order_key', _cands("'checkout_started', 'add_to_cart'", [jx('order_id'), jx('ct_order_id'), jx('conversion_attribution.order_id')])),
    _match('mv', 'visitor_key', _cands("'page_view'", ['visitor_id'], _TAGGED)),
]).replace("FROM fx WHERE", "FROM stored WHERE c = 'production' AND")

# Ids in the page URL are stamped into the bag as hints before it is searched, so they count as explicit ids.
SQL["stream_attribution"] = _STREAM_ACC + f""",
stored AS (SELECT event_id AS source_event_id, printf('%08x-0000-4000-8000-%012x', 1, event_id) AS event_id, event_name,
    printf('%08x-0000-4000-8000-%012x', 2, visitor_id) AS visitor_id, printf('%08x-0000-4000-8000-%012x', 3, session_id) AS session_id,
    client_ts AS client_timestamp, received_at, c, cmp AS utm_campaign, fb AS fbclid, properties, kk FROM st),
found AS (SELECT *, CASE WHEN kk = 9 THEN printf('%08x-0000-4000-8000-%012x', 4, source_event_id) END AS url_session,
    NULLIF(trim(coalesce({jx('checkout_id')}, {jx('checkoutId')}, {jx('ct_checkout_id')}, {jx('checkout_token')})), '') AS checkout_id,
    NULLIF(trim(coalesce({jx('order_id')}, {jx('orderId')}, {jx('ct_order_id')})), '') AS order_id
  FROM stored WHERE event_name IN ('checkout_started', 'purchase')),
conv AS (SELECT event_id, client_timestamp, received_at, checkout_id AS checkout_key, order_id AS order_key, visitor_id AS visitor_key
  FROM found WHERE url_session IS NULL),
{_STREAM_MATCHES},
allm AS (SELECT 3 AS prio, * FROM mc UNION ALL SELECT 4, * FROM mo UNION ALL SELECT 5, * FROM mv),
best AS (SELECT * FROM allm QUALIFY row_number() OVER (PARTITION BY cid ORDER BY prio) = 1)
SELECT f.source_event_id, CASE WHEN url_session IS NOT NULL THEN 'explicit_ids' ELSE {_METHOD} END AS method,
  coalesce(url_session, m.m_session, f.session_id) AS attributed_session_id, coalesce(m.m_visitor, f.visitor_id) AS attributed_visitor_id,
  CASE WHEN url_session IS NOT NULL THEN 'properties' ELSE {_METHOD} END AS identifier_source,
  CASE WHEN coalesce(url_session, m.m_session, f.session_id) <> f.session_id THEN 'true' ELSE 'false' END AS cross_session,
  f.checkout_id, f.order_id
FROM found f LEFT JOIN best m ON m.cid = f.event_id"""

SQL["stream_daily"] = _STREAM_ACC + """
SELECT date_trunc('day', client_ts) AS day, count(*) AS events,
  count(*) FILTER (WHERE event_name = 'page_view') AS page_views,
  count(*) FILTER (WHERE event_name = 'purchase') AS purchases
FROM st GROUP BY 1"""

SQL["stream_first_touch"] = _STREAM_ACC + """
SELECT printf('%08x-0000-4000-8000-%012x', 2, visitor_id) AS visitor_id, client_ts AS first_touch_at,
  src AS first_touch_source, cmp AS first_touch_campaign, fb AS first_touch_fbclid
FROM st WHERE src IS NOT NULL OR cmp IS NOT NULL OR fb IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY visitor_id ORDER BY client_ts,
  printf('%08x-0000-4000-8000-%012x', 1, event_id)) = 1"""

# ------------------------------------------------------------------ interaction
_PAGE = f"NULLIF({jx('page_instance_id')}, '')"

SQL["scroll_milestones"] = BASE + f""",
s AS (SELECT {_PAGE} AS page_instance_id, client_timestamp AS ts,
    TRY_CAST({jx('max_scroll_depth')} AS INTEGER) AS depth FROM base WHERE {_PAGE} IS NOT NULL),
m AS (SELECT page_instance_id, ts, unnest([10, 25, 50, 75, 90, 100]) AS milestone, depth FROM s)
SELECT page_instance_id, milestone, min(ts) AS reached_at FROM m WHERE depth >= milestone GROUP BY 1, 2"""

SQL["section_dwell"] = BASE + f""",
e AS (SELECT {_PAGE} AS page_instance_id,
    regexp_replace(coalesce({jx('section_key')}, {jx('chapter')}, {jx('section_id')}, 'unknown'), '^[a-z]_', 'section ') AS section_key,
    client_timestamp AS ts, CASE WHEN event_name = 'section_view' THEN 'enter' ELSE 'exit' END AS state
  FROM base WHERE {_PAGE} IS NOT NULL AND event_name IN ('section_view', 'section_engagement')),
n AS (SELECT *, count(*) FILTER (WHERE state = 'exit') OVER (PARTITION BY page_instance_id, section_key
    ORDER BY ts, state ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS exits FROM e),
iv AS (SELECT i.page_instance_id, i.section_key, i.entered_at, greatest(0, epoch_ms(x.ts) - epoch_ms(i.entered_at)) AS visible_ms
  FROM (SELECT page_instance_id, section_key, exits, min(ts) AS entered_at FROM n WHERE state = 'enter' GROUP BY 1, 2, 3) i
  JOIN n x ON x.state = 'exit' AND x.page_instance_id = i.page_instance_id AND x.section_key = i.section_key AND x.exits = i.exits + 1),
c AS (SELECT *, CAST(sum(visible_ms) OVER (PARTITION BY page_instance_id, section_key ORDER BY entered_at
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cumulative_visible_ms FROM iv)
SELECT * FROM c WHERE visible_ms >= 750"""

SQL["page_vitals"] = BASE + f""",
pp AS (SELECT {_PAGE} AS page_instance_id, client_timestamp AS ts, {jx('quick_exit')} = 'true' AS recent_input,
    {guarded(jx('lcp_ms'))} AS lcp, {guarded(jx('inp_ms'))} AS inp, {guarded(jx('cls'))} AS cls
  FROM base WHERE {_PAGE} IS NOT NULL AND event_name = 'page_performance')
SELECT page_instance_id, arg_max(lcp, (ts, lcp)) FILTER (WHERE lcp IS NOT NULL) AS lcp_ms,
  max(inp) AS inp_ms, round(coalesce(sum(cls) FILTER (WHERE NOT coalesce(recent_input, false)), 0.0), 6) AS cls
FROM pp GROUP BY 1"""

SQL["device_buckets"] = BASE + """
SELECT CASE WHEN coalesce(screen_width, 0) > 0 AND screen_width < 768 THEN 'mobile'
    WHEN screen_width >= 768 AND screen_width < 1024 THEN 'tablet' ELSE 'desktop' END AS device_bucket,
  count(*) AS events, count(DISTINCT visitor_id) AS unique_visitors
FROM base GROUP BY 1"""

SQL["arrival_lag"] = FX + """
SELECT event_id, greatest(0, epoch_ms(received_at) - epoch_ms(client_timestamp)) AS lag_ms FROM fx"""

_K = f"CAST(CAST({jx('visible_ms')} AS INTEGER) / 100 AS INTEGER)"
SQL["rage_clicks"] = BASE + f""",
ev AS (SELECT {_PAGE} AS page_instance_id, client_timestamp, {_K} AS k FROM base
  WHERE {_PAGE} IS NOT NULL AND event_name IN ('buy_button_click', 'cta_impression')),
clicks AS (SELECT page_instance_id, client_timestamp + (i * (200 + (k % 5) * 150)) * INTERVAL 1 MILLISECOND AS ts,
    (k * 37) % 400 + i * (k % 3) * 15 AS x, (k * 53) % 300 AS y
  FROM (SELECT *, unnest(range(0, k % 6 + 1)) AS i FROM ev)),
lagged AS (SELECT *, epoch_ms(ts) AS t,
    lag(epoch_ms(ts), 2) OVER w AS t2, lag(x, 1) OVER w AS x1, lag(y, 1) OVER w AS y1,
    lag(x, 2) OVER w AS x2, lag(y, 2) OVER w AS y2
  FROM clicks WINDOW w AS (PARTITION BY page_instance_id ORDER BY ts, x, y)),
cand AS (SELECT page_instance_id, ts, x, y, t FROM lagged
  WHERE t2 IS NOT NULL AND t - t2 <= 1400 AND sqrt((x1 - x) ^ 2 + (y1 - y) ^ 2) <= 48
    AND sqrt((x2 - x) ^ 2 + (y2 - y) ^ 2) <= 48),
emitted AS (SELECT page_instance_id, min(t) AS t FROM cand GROUP BY 1
  UNION ALL
  SELECT c.page_instance_id, min(c.t) FROM emitted e JOIN cand c
    ON c.page_instance_id = e.page_instance_id AND c.t > e.t + 5000 GROUP BY c.page_instance_id)
SELECT c.page_instance_id, c.ts, c.x, c.y FROM cand c
WHERE (c.page_instance_id, c.t) IN (SELECT page_instance_id, t FROM emitted)
QUALIFY row_number() OVER (PARTITION BY c.page_instance_id, c.t ORDER BY c.ts, c.x, c.y) = 1"""
SQL["rage_clicks"] = SQL["rage_clicks"].replace("WITH ", "WITH RECURSIVE ", 1)

_PIXEL_NAME = "CASE WHEN c.event_name = 'purchase' THEN 'checkout_completed' ELSE 'checkout_started' END"
_H = f"sha256('e|se_' || CAST(c.event_id AS VARCHAR) || '|' || {_PIXEL_NAME})"
SQL["checkout_payload"] = FX + f""",
conv AS (SELECT * FROM fx WHERE event_name IN ('checkout_started', 'purchase')),
items AS (SELECT event_id, sum(greatest(0.0, coalesce(TRY_CAST(json_extract_string(it, '$.quantity') AS DOUBLE), 0.0))) AS q
  FROM (SELECT event_id, unnest(CASE WHEN json_type(properties, '$.line_items') = 'ARRAY'
      THEN json_extract(properties, '$.line_items[*]') ELSE CAST([] AS JSON[]) END) AS it FROM conv)
  GROUP BY event_id)
SELECT substring({_H}, 1, 8) || '-' || substring({_H}, 9, 4) || '-4' || substring({_H}, 14, 3) || '-8'
    || substring({_H}, 18, 3) || '-' || substring({_H}, 21, 12) AS event_id,
  c.event_name, printf('%08x-0000-4000-8000-%012x', 2, c.visitor_id) AS visitor_id,
  NULLIF(c.utm_campaign, '') AS utm_campaign,
  CASE WHEN coalesce(c.screen_width, 0) > 0 AND c.screen_width < 768 THEN 'mobile'
    WHEN c.screen_width >= 768 AND c.screen_width < 1024 THEN 'tablet' ELSE 'desktop' END AS device_type,
  json_extract_string(c.properties, '$.checkout_id') AS checkout_id,
  CAST(coalesce(TRY_CAST(json_extract_string(c.properties, '$.value') AS DOUBLE), 0.0) AS VARCHAR) AS value,
  CAST(coalesce(i.q, 0.0) AS VARCHAR) AS item_count
FROM conv c LEFT JOIN items i ON i.event_id = c.event_id"""

SQL["sanitize_urls"] = """
SELECT page_id, CASE WHEN regexp_matches(url, '^[a-zA-Z]+://[^/?#]+') THEN
    lower(regexp_extract(url, '^([a-zA-Z]+)://', 1)) || '://' || lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]+)', 1))
    || coalesce(NULLIF(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+([^?#]*)', 1), ''), '/')
    || coalesce('?' || NULLIF(array_to_string(list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'),
         lambda x: split_part(x, '=', 1) IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_content', 'utm_term', 'ref')),
         '&'), ''), '')
  ELSE substring(url, 1, 2048) END AS sanitized_url
FROM pages"""

SQL["stream_sessions"] = _STREAM_ACC + """,
lg AS (SELECT visitor_id, client_ts, lag(client_ts) OVER (PARTITION BY visitor_id ORDER BY client_ts) AS prev FROM st),
sn AS (SELECT *, sum(CASE WHEN prev IS NULL OR epoch_us(client_ts) - epoch_us(prev) > 1800000000 THEN 1 ELSE 0 END)
    OVER (PARTITION BY visitor_id ORDER BY client_ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM lg),
ss AS (SELECT printf('%08x-0000-4000-8000-%012x', 2, visitor_id) AS visitor_id, min(client_ts) AS session_start,
    max(client_ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS events FROM sn GROUP BY visitor_id, n)
SELECT * FROM ss WHERE session_end <= (SELECT max(client_ts) FROM st) - INTERVAL 1 HOUR"""
