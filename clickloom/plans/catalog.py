"""Registered queries: key -> callable(spark, sf_dir) -> DataFrame.

Every callable reads the driver's tables, builds the event / ad fixture shapes
and runs one library operator over the whole table.  Doubles are rounded to 6
digits at this edge only (the oracle does the same) so that summation order
does not show in the comparison.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions.stats import round_to
from clickloom.operators import ads as ads_ops
from clickloom.operators import journeys as J
from clickloom.operators import reports as R
from clickloom.operators.attribution import attribute_conversions
from clickloom.operators.filters import valid_events
from clickloom.sources import fixtures as FX
from clickloom.sources.fixtures import EVENT_COLUMNS, FX_ADS_AS_OF, FX_AS_OF, FX_CONTROL_PATTERN, fx_ads, fx_ads_raw, fx_events, fx_silver

DAYS = 90
ADS_DAYS = 365


def finish(df: DataFrame) -> DataFrame:
    """Round double columns to 6 digits (comparison edge only)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_to(F.col(f.name), 6).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Silver events (fact columns + parsed property struct ``p``)."""
    return fx_silver(spark, sf)


def base(spark: SparkSession, sf: str) -> DataFrame:
    return valid_events(fx_silver(spark, sf), FX_AS_OF, DAYS, FX_CONTROL_PATTERN)


def ads(spark: SparkSession, sf: str) -> DataFrame:
    return fx_ads(spark, sf)


def _b(fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: finish(fn(base(spark, sf)))


def _e(fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: finish(fn(events(spark, sf)))


def _a(fn: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: finish(fn(ads(spark, sf)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    # sources / filters
    "read_events": lambda spark, sf: fx_events(spark, sf),
    "valid_events": lambda spark, sf: base(spark, sf).select(*EVENT_COLUMNS),
    "exclusion_audit": _e(lambda ev: R.exclusion_audit(ev, FX_AS_OF, DAYS, FX_CONTROL_PATTERN)),
    "raw_events": _b(lambda b: R.raw_events(b)),
    # flagship: conversion attribution (as-of joins, 30-day look-back)
    "attribute_conversions": _e(attribute_conversions),
    # report blocks (live export)
    "overview": _b(R.overview),
    "overview_basic": _b(R.overview_basic),
    "funnel_unique_visitors": _b(R.funnel_unique_visitors),
    "event_catalog": _b(R.event_catalog),
    "campaigns": _b(R.campaigns),
    "session_journeys": _b(R.session_journeys),
    "conversion_report": _b(R.conversion_report),
    "daily_series": _b(R.daily_series),
    "pages": _b(R.pages),
    "devices": _b(R.devices),
    "products": _b(R.products),
    "cta_performance": _b(R.cta_performance),
    "sections": _b(R.sections),
    "web_performance": _b(R.web_performance),
    "identity_integrity": _b(R.identity_integrity),
    "time_to_conversion": _b(R.time_to_conversion),
    "creative_taxonomy": _b(R.creative_taxonomy),
    # report blocks (older, richer export)
    "overview_sessions": _b(R.overview_sessions),
    "campaigns_click_ids": _b(lambda b: R.campaigns(b, with_click_ids=True)),
    "session_journeys_pages": _b(R.session_journeys_pages),
    "conversion_report_ext": _b(lambda b: R.conversion_report(b, extended=True)),
    "attribution_summary": _b(R.attribution_summary),
    "data_quality": _b(R.data_quality),
    "property_keys": _b(R.property_keys),
    "daily_revenue": _b(lambda b: R.daily_series(b, with_revenue=True)),
    "pages_by_path": _b(R.pages_by_path),
    "referrers": _b(R.referrers),
    "devices_network": _b(R.devices_network),
    "products_line_items": _b(R.products_line_items),
    "javascript_errors": _b(R.javascript_errors),
    "cta_by_creative": _b(R.cta_by_creative),
    "sections_engagement": _b(lambda b: R.sections(b, engagement_only_ms=True)),
    "web_performance_ext": _b(lambda b: R.web_performance(b, extended=True)),
    "interaction_anomalies": _b(R.interaction_anomalies),
    "identity_continuity": _b(lambda b: R.identity_integrity(b, checkout_only=True)),
    "visitor_cohorts": _b(R.visitor_cohorts),
    "creative_taxonomy_sessions": _b(lambda b: R.creative_taxonomy(b, with_sessions=True)),
    # journey segmentation
    "page_types": _b(J.page_types),
    "journey_types": _b(J.journey_types),
    "visitor_overlap": _b(J.visitor_overlap),
    "stage_flow": _b(J.stage_flow),
    # traffic audit (whole table)
    "audit_distribution": _e(J.audit_distribution),
    "audit_production": _e(J.audit_production),
    "audit_duplicates": _e(J.audit_duplicates),
    "audit_reasons": _e(J.audit_reasons),
    "audit_campaigns": _e(J.audit_campaigns),
    # ads
    "ads_upsert": _a(lambda a: a.drop("ingested_seq").withColumn("spend", F.col("spend").cast("double"))
                     .withColumn("purchase_value", F.col("purchase_value").cast("double"))),
    "ads_overview": _a(lambda a: ads_ops.ads_overview(a, FX_ADS_AS_OF, ADS_DAYS)),
    "ads_campaigns": _a(lambda a: ads_ops.ads_campaigns(a, FX_ADS_AS_OF, ADS_DAYS)),
    "ads_daily": _a(lambda a: ads_ops.ads_daily(a, FX_ADS_AS_OF, ADS_DAYS)),
}


# --------------------------------------------------------------------------- ingest / maintenance
from clickloom.operators import classify as C  # noqa: E402
from clickloom.operators import filters as FL  # noqa: E402
from clickloom.operators import sessions as SE  # noqa: E402
from clickloom.sources import events as SRC  # noqa: E402

SPLIT_OLD = "2024-01-20 00:00:00"   # history stored before this arrival time
SPLIT_NEW = "2024-01-15 00:00:00"   # new batch starts here (overlap is replayed)
SPLIT_REPLAY = "2024-01-25 00:00:00"  # rows sent twice by the client outbox
CLASSIFIED_AT = "2024-01-31T00:00:00Z"


def _arrived_before(ts: str):
    return F.col("received_at") < F.lit(ts).cast("timestamp_ntz")


def _q_classify(spark, sf):
    c = C.classify_traffic(events(spark, sf), FX_CONTROL_PATTERN)
    return c.select("event_id", "traffic_classification", "traffic_classification_reason")


def _q_reclassify(spark, sf):
    r = C.reclassify_history(events(spark, sf), CLASSIFIED_AT, FX_CONTROL_PATTERN)
    stamps = ("traffic_classification", "traffic_classification_reason", "traffic_classification_version",
              "traffic_classified_at", "test", "internal_traffic")
    r = r.select("event_id", "properties", _bag_fields(*stamps).alias("_f"))
    return r.select("event_id", *[F.col(f"_f.{c}").alias(c) for c in stamps], F.size(F.json_object_keys("properties")).alias("n_keys"))


def _bag_fields(*fields: str) -> Column:
    """Some members of the property bag as text, in one pass over it; a member
    with a type is read as that."""
    return F.from_json(F.col("properties"), ", ".join(f if " " in f else f"{f} string" for f in fields))


def _q_mark_duplicates(spark, sf):
    m = C.mark_duplicates(events(spark, sf))
    return m.select("event_id", nz_col(F.get_json_object("properties", "$.shopify_event_id")).alias("shopify_event_id"),
                    "is_duplicate")


def nz_col(c):
    return F.when(c != "", c)


def _q_dedupe(spark, sf):
    d = C.dedupe_shopify(events(spark, sf))
    return d.select("event_id", "received_at")


def _q_insert_ignore(spark, sf):
    ev = events(spark, sf)
    target = ev.where(_arrived_before(SPLIT_OLD))
    batch = ev.where(~_arrived_before(SPLIT_NEW))
    replay = ev.where(~_arrived_before(SPLIT_REPLAY))
    ins = SRC.insert_ignore(target, batch.unionByName(replay))
    return ins.select("event_id", "received_at")


def _q_anti_existing(spark, sf):
    ev = events(spark, sf)
    target = ev.where(_arrived_before(SPLIT_OLD))
    batch = ev.where(~_arrived_before(SPLIT_OLD))
    return SRC.anti_existing(target, batch).select("event_id", "received_at")


def _legacy_pred():
    return F.coalesce(F.get_json_object("properties", "$.traffic_classification"), F.lit("production")) != "production"


def _q_archive_split(spark, sf):
    archived, _ = SRC.archive_split(events(spark, sf), _legacy_pred(), SPLIT_OLD)
    return archived.select("event_id", "received_at")


def _q_archive_remainder(spark, sf):
    _, remaining = SRC.archive_split(events(spark, sf), _legacy_pred(), SPLIT_OLD)
    return remaining.select("event_id", "received_at")


def _q_stamp_duplicates(spark, sf):
    d = C.stamp_duplicates(events(spark, sf), FX_AS_OF)
    get = lambda k: F.get_json_object("properties", f"$.{k}").alias(k)
    return d.select("event_id", "is_duplicate", get("traffic_classification"), get("traffic_classification_reason"), get("test"))


def _q_archive_record(spark, sf):
    ev = events(spark, sf)
    archived, remaining = SRC.archive_split(ev, _legacy_pred(), SPLIT_OLD)
    return SRC.archive_record(archived, remaining, _legacy_pred(), SPLIT_OLD)


def _bodies(spark, sf):
    """Request bodies as newline-delimited JSON files in the shared folder
    (written once per application), read back by the JSON data source."""
    from clickloom.sources.fixtures import materialized_path

    path = materialized_path(spark, "bodies", sf,
                             lambda: SRC.fixture_bodies(events(spark, sf)).select("body"), fmt="text")
    raw = SRC.read_bodies(spark, path, SRC.FIXTURE_BODY_EXTRA)
    return raw.withColumnRenamed("_source_event_id", "source_event_id").withColumn(
        "arrival", F.col("_arrival").cast("timestamp_ntz")).drop("_arrival")


def _q_validate(spark, sf):
    ok, bad = SRC.validate_events(_bodies(spark, sf), keep=("source_event_id",), context=SRC.fixture_context())
    return ok.select("source_event_id", F.lit(None).cast("string").alias("reject_reason")).unionByName(
        bad.select("source_event_id", "reject_reason"))


def _q_ingest(spark, sf):
    ok, _ = SRC.validate_events(_bodies(spark, sf), keep=("source_event_id",), context=SRC.fixture_context())
    # one pass over the bag for all that is asked of it
    ok = ok.withColumn("_f", _bag_fields(
        "test", "internal_traffic", "checkout_id", "value", "shopify_event_id", "first_touch struct<utm_campaign: string>",
        "url_attribution_hints struct<ct_session_id: string, source: string>",
        "server_context struct<ingestion_version: string, user_agent: string, client_server_lag_ms: string>"))
    get = lambda path: F.col(f"_f.{path}")
    return ok.select(
        "source_event_id", "event_id", "event_name", "client_timestamp", "received_at", "page_path", "page_title",
        "referrer", "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid", "device_type",
        "screen_width", "language",
        get("test").alias("test"),
        get("internal_traffic").alias("internal_traffic"),
        *[get(c).alias(c) for c in ("checkout_id", "value", "shopify_event_id", "first_touch.utm_campaign")],
        get("url_attribution_hints.ct_session_id").alias("hint_session_id"),
        get("url_attribution_hints.source").alias("hint_source"),
        get("server_context.ingestion_version").cast("int").alias("ingestion_version"),
        get("server_context.user_agent").alias("user_agent"),
        get("server_context.client_server_lag_ms").cast("long").alias("client_server_lag_ms"))


def _q_sessionize(spark, sf):
    ev = events(spark, sf)
    s = SE.sessionize(ev, gap_seconds=1800)
    return s.select("event_id", "visitor_id", "session_no")


def _q_session_windows(spark, sf):
    w = SE.session_window_ids(events(spark, sf), gap="30 minutes")
    return w.select("visitor_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"),
                    F.col("session_end").cast("timestamp_ntz").alias("session_end"), "events")


def _q_session_entries(spark, sf):
    b = base(spark, sf)
    return SE.session_entries(b, {
        "visitor_id": F.col("visitor_id"), "started_at": F.col("client_timestamp"),
        "landing_page": F.col("page_url"), "source": R.first_touch_or("utm_source")})


def _q_visitor_counters(spark, sf):
    v = SE.visitor_counters(base(spark, sf))
    return v.select("event_id", "visit_number", "page_view_index_in_session", "page_view_index_for_visitor",
                    "first_seen_at", "returning_visitor")


def _q_touch(spark, sf):
    t = SE.touch_attribution(base(spark, sf), touch_cols=("utm_source", "utm_campaign", "fbclid"))
    return t.select(
        "event_id",
        F.col("first_touch.utm_source").alias("first_touch_source"),
        F.col("first_touch.utm_campaign").alias("first_touch_campaign"),
        F.col("session_touch.utm_campaign").alias("session_touch_campaign"),
        F.col("session_touch.fbclid").alias("session_touch_fbclid"),
        F.col("active_touch.utm_source").alias("active_touch_source"),
        F.col("active_touch.utm_campaign").alias("active_touch_campaign"),
    )


QUERIES.update({
    "classify_traffic": _q_classify,
    "reclassify_history": _q_reclassify,
    "mark_duplicates": _q_mark_duplicates,
    "dedupe_shopify": _q_dedupe,
    "insert_ignore": _q_insert_ignore,
    "anti_existing": _q_anti_existing,
    "archive_split": _q_archive_split,
    "archive_remainder": _q_archive_remainder,
    "archive_record": _q_archive_record,
    "stamp_duplicates": _q_stamp_duplicates,
    "validate_events": _q_validate,
    "ingest_events_batch": _q_ingest,
    "constraint_check": _e(FL.constraint_check),
    "production_only": _e(lambda ev: FL.production_only(ev).select("event_id", "event_name", "visitor_id")),
    "has_any_key": _b(lambda b: b.where(R.has_any_key(R.TAXONOMY_KEYS)).select("event_id")),
    "dedupe_consecutive_pages": _b(lambda b: FL.dedupe_consecutive_pages(
        b.withColumn("page_instance_id", R.nz(R.prop("page_instance_id")))).select("event_id")),
    "sessionize": _q_sessionize,
    "session_windows": _q_session_windows,
    "session_entries": _q_session_entries,
    "latest_page_summary": _b(R.latest_page_summary),
    "visitor_counters": _q_visitor_counters,
    "touch_attribution": _q_touch,
})


# --------------------------------------------------------------------------- statistics / economics
from clickloom.functions.agg import combine_rows  # noqa: E402
from clickloom.operators import diagnosis as D  # noqa: E402


def offers(spark, sf):
    """Offer table derived from ``orders``: one offer per order priority."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    g = o.groupBy(F.substring("o_orderpriority", 1, 1).alias("offer_id")).agg(
        round_to(F.avg("o_totalprice") / 1000.0, 2).alias("average_order_value"),
        F.first(digit).alias("_d"))
    return g.select("offer_id", F.col("average_order_value").cast("string").alias("average_order_value"),
                    (30 + 10 * F.col("_d")).cast("string").alias("contribution_margin_percent"),
                    (18 * F.col("_d")).cast("string").alias("desired_profit_percent"))


def campaign_funnel(spark, sf):
    """Campaign funnel rows from the ad snapshot table (R25) with their offer."""
    c = ads_ops.ads_campaigns(ads(spark, sf), FX_ADS_AS_OF, ADS_DAYS)
    brand = F.regexp_extract("campaign_id", r"(\d+)$", 1).cast("int")
    return c.select(
        "campaign_id", ((brand % 5) + 1).cast("string").alias("offer_id"),
        round_to(F.col("spend"), 2).alias("spend"), F.col("impressions"), F.col("reach"),
        F.lit(None).cast("double").alias("three_second_views"),
        F.col("clicks").alias("link_clicks"), F.col("landing_page_views"), F.col("add_to_cart").alias("add_to_carts"),
        F.col("initiate_checkout").alias("checkouts"), F.col("purchases"),
        round_to(F.col("purchase_value"), 2).alias("revenue"))


def _q_unit_economics(spark, sf):
    return D.unit_economics(offers(spark, sf))


def _q_funnel_metrics(spark, sf):
    return D.funnel_metrics(campaign_funnel(spark, sf))


def _q_funnel_warnings(spark, sf):
    w = D.funnel_warnings(campaign_funnel(spark, sf))
    return w.select("campaign_id", "funnel_valid", F.array_join("warnings", ",").alias("warnings"))


def _q_sample_readiness(spark, sf):
    r = D.sample_readiness(campaign_funnel(spark, sf))
    return r.select("campaign_id", *[c for c in r.columns if c.endswith("_sample_status")])


def _q_diagnose(spark, sf):
    d = D.diagnose_funnel(campaign_funnel(spark, sf), offers(spark, sf))
    stage_health = F.array_join(F.transform("stage_evaluations", lambda e: F.concat(e["stage"], F.lit(":"), e["health"])), ",")
    return d.select("campaign_id", "offer_id", "target_cac", "cac", "cac_status", "cac_difference", "cac_difference_percent",
                    "max_spend_at_target_cac", "spend_headroom_vs_target", "estimated_contribution_profit_after_ads",
                    "estimated_contribution_profit_per_purchase", stage_health.alias("stage_health"),
                    "first_probable_bottleneck", "first_stage_waiting_for_sample", "diagnosis_summary")


def _q_funnel_confidence(spark, sf):
    return D.funnel_confidence(R.funnel_unique_visitors(base(spark, sf)))


def _q_coverage(spark, sf):
    return D.coverage(R.overview(base(spark, sf))).select(
        "sessions", "unique_visitors", "session_v2_coverage_percent", "session_v3_coverage_percent", "sessions_per_visitor")


def _q_readiness_score(spark, sf):
    b = base(spark, sf)
    ov = R.overview_sessions(b).select("unique_visitors", "sessions", "session_v3_sessions")
    q = R.data_quality(b).select("summary_sessions")
    ident = R.identity_integrity(b, checkout_only=True).select("conversions_with_resolved_attribution", "conversion_events")
    fun = R.funnel_unique_visitors(b).select("cta_impression_visitors", "page_view_visitors")
    ad = ads_ops.ads_overview(ads(spark, sf), FX_ADS_AS_OF, ADS_DAYS).select(F.col("rows").alias("ad_rows"))
    return D.readiness_score(combine_rows(ov, q, ident, fun, ad))


def _q_readiness_labels(spark, sf):
    b = base(spark, sf)
    ov = R.overview(b).select("unique_visitors", "sessions", "session_v3_sessions")
    fun = R.funnel_unique_visitors(b).select("purchase_visitors")
    ident = R.identity_integrity(b).select("orphan_conversion_visitors")
    ad = ads_ops.ads_overview(ads(spark, sf), FX_ADS_AS_OF, ADS_DAYS).select(F.col("rows").alias("ad_rows"))
    return D.readiness_labels(combine_rows(ov, fun, ident, ad).withColumn("failed_blocks", F.lit(0)))


QUERIES.update({
    "unit_economics": lambda spark, sf: finish(_q_unit_economics(spark, sf)),
    "funnel_metrics": lambda spark, sf: finish(_q_funnel_metrics(spark, sf)),
    "funnel_warnings": _q_funnel_warnings,
    "sample_readiness": _q_sample_readiness,
    "diagnose_funnel": lambda spark, sf: finish(_q_diagnose(spark, sf)),
    "funnel_confidence": lambda spark, sf: finish(_q_funnel_confidence(spark, sf)),
    "coverage": lambda spark, sf: finish(_q_coverage(spark, sf)),
    "readiness_score": _q_readiness_score,
    "readiness_labels": _q_readiness_labels,
})


# --------------------------------------------------------------------------- sanitiser / ads ingest
from clickloom.functions import sanitize as SAN  # noqa: E402
from clickloom.functions.urls import sanitize_url as _sanitize_url  # noqa: E402
from clickloom.sources import ads as ADS_SRC  # noqa: E402


def _q_sanitized_raw_events(spark, sf):
    return SAN.sanitize_frame(R.raw_events(base(spark, sf)).drop("p"))


def _q_sanitize_urls(spark, sf):
    pg = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    return pg.select("page_id", _sanitize_url(F.col("url")).alias("sanitized_url"))


def _ad_post_rows(spark, sf):
    """Ad rows as posted to the ingest endpoint (text fields, actions array),
    derived from lineitem x part; a fixed rule blanks ids / dates and moves
    metrics into ``actions`` so every normalisation path runs."""
    return fx_ads_raw(spark, sf).select(*_ad_post(F.col))


def _ad_post(col) -> list[Column]:
    """The posted fields; ``col`` gives a field of the raw row."""
    r = col("ingested_seq") % 23
    text = lambda c: col(c).cast("string")
    acts = F.array(
        F.struct(F.lit("landing_page_view").alias("action_type"), text("landing_page_views").alias("value")),
        F.struct(F.lit("omni_purchase").alias("action_type"), text("purchases").alias("value")),
    )
    fields = {
        "account_id": F.when(r == 1, F.lit(None)).otherwise(col("account_id")),
        "date_start": F.when(r == 2, F.lit("2001-02-30")).when(r == 3, F.lit(None)).otherwise(text("date_start")),
        "campaign_id": F.when(r == 4, F.lit("  ")).otherwise(col("campaign_id")),
        "campaign_name": col("campaign_name"),
        "adset_id": F.when(r == 5, F.lit(None)).otherwise(col("adset_id")),
        **{c: col(c) for c in ("adset_name", "ad_id", "ad_name", "creative_id")},
        "spend": F.when(r == 6, F.lit("-3.5")).otherwise(text("spend")),
        **{c: text(c) for c in ("impressions", "reach", "frequency", "clicks", "unique_clicks")},
        "landing_page_views": F.when(r == 7, F.lit("0")).otherwise(text("landing_page_views")),
        **{c: text(c) for c in ("add_to_cart", "initiate_checkout")},
        "purchases": F.when(r == 8, F.lit(None)).otherwise(text("purchases")),
        "purchase_value": text("purchase_value"), "currency": col("currency"),
        "actions": acts, "ingested_seq": col("ingested_seq"),
    }
    return [c.alias(n) for n, c in fields.items()]


def _q_normalize_ads(spark, sf):
    return ADS_SRC.normalized_ads(_ad_post_rows(spark, sf)).select(
        "ingested_seq", "account_id", "date_start", "campaign_id", "adset_id", "ad_id", "spend", "impressions",
        "landing_page_views", "purchases", "accepted")


def _q_ads_upsert_merge(spark, sf):
    """The rows posted first make the stored table, those posted later are
    merged into it; both as batches of ``upsert_table``, by month."""
    path = f"{_stage_dir(spark, 'ads_table', sf)}/{uuid4().hex}"  # each call merges into a table of its own
    raw = fx_ads_raw(spark, sf).withColumn("month", F.date_format("date_start", "yyyy-MM"))
    middle = raw.agg((F.max("ingested_seq") / 2).alias("m")).first()["m"] or 0
    for batch in (F.col("ingested_seq") <= middle, F.col("ingested_seq") > middle):
        ADS_SRC.upsert_table(spark, path, raw.where(batch), sequence=("ingested_seq",), by="month")
    a = spark.read.parquet(path).drop("month")
    return a.withColumns({c: F.col(c).cast("double") for c in ("spend", "purchase_value")})


AD_POST_ROWS = 50


def _q_ads_ingest_json(spark, sf):
    """The posted rows as JSON documents of up to ``AD_POST_ROWS`` rows, read
    and normalised by the ingest: accepted and rejected rows."""
    root = _stage_dir(spark, "ad_posts", sf)
    if not _done(spark, f"{root}/_ready"):
        # rows are grouped narrow; a document's rows are widened in the task that writes it
        part = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_brand", "p_type")
        raw = FX.fx_ads_narrow(spark, sf).join(part, F.col("l_partkey") == F.col("p_partkey")).drop("p_partkey")
        posts = raw.groupBy(F.floor(F.col("ingested_seq") / AD_POST_ROWS).alias("post")).agg(
            F.collect_list(F.struct(*raw.columns)).alias("narrow"))
        fields = lambda x: _ad_post(lambda c: x[c])
        rows = F.sort_array(F.transform("raw", lambda x: F.struct(fields(x)[-1], *fields(x)[:-1])))  # the sequence first
        (posts.select(FX.ads_posted("narrow").alias("raw")).select(rows.alias("rows"))
         .write.mode("overwrite").option("compression", "gzip").json(f"{root}/posts"))
        _mark(spark, f"{root}/_ready")
    both = ADS_SRC.ingested_ads(spark, f"{root}/posts", T.StructType([T.StructField("ingested_seq", T.LongType())]))
    return both.select(
        "ingested_seq", "account_id", "date_start", "campaign_id", "adset_id", "ad_id", "spend", "impressions",
        "landing_page_views", "purchases", "accepted")


QUERIES.update({
    "sanitized_raw_events": _q_sanitized_raw_events,
    "sanitize_urls": _q_sanitize_urls,
    "normalize_ads": lambda spark, sf: finish(_q_normalize_ads(spark, sf)),
    "ads_upsert_merge": lambda spark, sf: finish(_q_ads_upsert_merge(spark, sf)),
    "ads_ingest_json": lambda spark, sf: finish(_q_ads_ingest_json(spark, sf)),
})


# --------------------------------------------------------------------------- export
from clickloom.config import ReportConfig  # noqa: E402
from clickloom.plans import export as EXP  # noqa: E402


def _fx_cfg():
    import datetime as _dt

    return ReportConfig(as_of=_dt.datetime.fromisoformat(FX_AS_OF), days=DAYS, control_pattern=FX_CONTROL_PATTERN,
                        ads_as_of=_dt.date.fromisoformat(FX_ADS_AS_OF), ads_days=ADS_DAYS)


def _q_export_health(spark, sf):
    return EXP.run_isolated(spark, EXP.fallback_bundle(events(spark, sf), _fx_cfg()))


def _q_export_scope(spark, sf):
    ev = events(spark, sf)
    health = EXP.run_isolated(spark, EXP.fallback_bundle(ev, _fx_cfg()))
    return EXP.export_scope(health, R.overview_basic(base(spark, sf)), None)


QUERIES.update({
    "export_health": _q_export_health,
    "export_scope": _q_export_scope,
})


# --------------------------------------------------------------------------- streaming
from pyspark.sql import types as _T  # noqa: E402

from clickloom.sources.fixtures import _stage_dir  # noqa: E402
from clickloom.streaming import aggregates as SA  # noqa: E402
from clickloom.streaming import ingest as SI  # noqa: E402

#: Files of one week's bodies, and of one micro-batch.
STREAM_FILES = 24
STREAM_CUTS = ("2024-01-01", "2024-01-08", "2024-01-15", "2024-01-22", "2024-02-01")


def _done(spark, path):
    return SI._exists(spark, path)


def _mark(spark, path):
    spark.createDataFrame([(1,)], "x int").coalesce(1).write.mode("overwrite").json(path)


def _parts(spark, path):
    """The data files of a folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/part-*")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)


def dealt(rows: DataFrame, files: int) -> DataFrame:
    """``rows`` in ``files`` partitions.  Where there are as many already, they are
    put together as they are: no shuffle of wide rows stays on disk."""
    return rows.coalesce(files) if rows.rdd.getNumPartitions() >= files else rows.repartition(files)


def _stream_source(spark, sf):
    """Request bodies as arriving files: ``STREAM_FILES`` per arrival week, each
    week also re-delivering a share of the previous week's rows (client outbox
    replays), the second one with malformed lines."""
    root = _stage_dir(spark, "stream", sf)
    src = f"{root}/source"
    if _done(spark, f"{root}/_source_ready"):
        return root
    # The same bodies as those of the batch ingest queries.  Narrow rows are dealt to the files evenly and
    # widened by the task that writes a file: files of one size keep all cores of a micro-batch busy.
    events, at = FX.fx_rows(spark, sf), F.col("ts") + F.expr("INTERVAL '2' SECOND")
    prev, weeks = None, 0
    for lo, hi in zip(STREAM_CUTS[:-1], STREAM_CUTS[1:]):
        # the first and the last file are open-ended: no arrival time is left out
        rng = F.lit(True)
        if lo != STREAM_CUTS[0]:
            rng = rng & (at >= F.lit(lo).cast("timestamp_ntz"))
        if hi != STREAM_CUTS[-1]:
            rng = rng & (at < F.lit(hi).cast("timestamp_ntz"))
        # weeks have no row in common: those of this one and the replays of the last are one scan
        rows = events.where(rng if prev is None else rng | (prev & (F.col("eid") % 20 == 7)))
        broken = spark.createDataFrame([("{not json",), ('{"event_id": ',)], "body string") if lo == STREAM_CUTS[1] else None
        weeks += 1
        put = lambda d: d.write.mode("append").option("compression", "gzip").text(src)
        dealt_rows = rows.repartition(STREAM_FILES if broken is None else STREAM_FILES - 1)
        put(SRC.fixture_bodies(FX.fx_widened(dealt_rows)).select("body"))  # one micro-batch: weeks arrive one after the other
        if broken is not None:
            put(dealt(broken, 1))
        for _ in range(weeks * STREAM_FILES - len(_parts(spark, src))):  # a partition without rows has left no file
            put(spark.createDataFrame([], "body string"))
        prev = rng
    _mark(spark, f"{root}/_source_ready")
    return root


def _stream_target(spark, sf):
    root = _stream_source(spark, sf)
    if not _done(spark, f"{root}/_target_ready"):
        q = SI.stream_ingest(spark, f"{root}/source", f"{root}/target", f"{root}/dead_letter", f"{root}/ckpt_ingest",
                             control_pattern=FX_CONTROL_PATTERN, extra_schema=SRC.FIXTURE_BODY_EXTRA,
                             arrival_col="_arrival", keep=("_source_event_id",), context=SRC.fixture_context(),
                             max_files_per_trigger=STREAM_FILES, buckets=8)
        q.awaitTermination()
        _mark(spark, f"{root}/_target_ready")
    return root


TARGET_SCHEMA = _T.StructType(SRC.EVENTS_SCHEMA.fields + [_T.StructField("_source_event_id", _T.LongType()),
                                                         _T.StructField("event_date", _T.DateType()),
                                                         _T.StructField("batch", _T.StringType())])


def _q_stream_ingest(spark, sf):
    root = _stream_target(spark, sf)
    t = spark.read.schema(TARGET_SCHEMA).parquet(f"{root}/target")
    return t.select(F.col("_source_event_id").alias("source_event_id"), "event_name", "client_timestamp",
                    "received_at", F.get_json_object("properties", "$.traffic_classification").alias("traffic_classification"),
                    F.get_json_object("properties", "$.test").alias("test"))


def _q_stream_dead_letter(spark, sf):
    root = _stream_target(spark, sf)
    d = spark.read.parquet(f"{root}/dead_letter")
    return d.select("reject_reason", F.col("_source_event_id").alias("source_event_id"))


def _q_stream_attribution(spark, sf):
    """What each stored conversion's bag says about the session that earned it."""
    root = _stream_target(spark, sf)
    t = spark.read.schema(TARGET_SCHEMA).parquet(f"{root}/target").where(F.col("event_name").isin("checkout_started", "purchase"))
    get = lambda c, name: F.get_json_object("properties", f"$.conversion_attribution.{c}").alias(name)
    return t.select(F.col("_source_event_id").alias("source_event_id"), get("method", "method"), get("session_id", "attributed_session_id"),
                    get("visitor_id", "attributed_visitor_id"), get("identifier_source", "identifier_source"),
                    get("cross_session", "cross_session"), get("checkout_id", "checkout_id"), get("order_id", "order_id"))


def _run_stream_agg(spark, sf, name, build, mode):
    root = _stream_target(spark, sf)
    out = f"{root}/{name}"
    if not _done(spark, f"{root}/_{name}_ready"):
        src = spark.readStream.schema(TARGET_SCHEMA).parquet(f"{root}/target")
        res = build(src)
        w = res.writeStream.option("checkpointLocation", f"{root}/ckpt_{name}").trigger(availableNow=True)
        if mode == "complete":
            w = w.outputMode("complete").foreachBatch(lambda df, _e: df.write.mode("overwrite").parquet(out))
        else:
            w = w.outputMode("append").format("parquet").option("path", out)
        w.start().awaitTermination()
        _mark(spark, f"{root}/_{name}_ready")
    return spark.read.parquet(out)


def _q_stream_daily(spark, sf):
    d = _run_stream_agg(spark, sf, "daily", lambda s: SA.stream_daily(SA.stream_dedupe(s)), "complete")
    return d.select("day", "events", "page_views", "purchases")


def _q_stream_sessions(spark, sf):
    return _run_stream_agg(spark, sf, "sessions", lambda s: SA.stream_sessions(s), "append")


def _q_stream_first_touch(spark, sf):
    d = _run_stream_agg(spark, sf, "first_touch", lambda s: SA.stream_first_touch(s), "append")
    return d.select("visitor_id", F.col("first_touch_at").cast("timestamp_ntz").alias("first_touch_at"),
                    "first_touch_source", "first_touch_campaign", "first_touch_fbclid")


QUERIES.update({
    "stream_ingest": _q_stream_ingest,
    "stream_dead_letter": _q_stream_dead_letter,
    "stream_attribution": _q_stream_attribution,
    "stream_daily": _q_stream_daily,
    "stream_sessions": _q_stream_sessions,
    "stream_first_touch": _q_stream_first_touch,
})


# --------------------------------------------------------------------------- interaction (re-aimed tracker logic)
from clickloom.functions.json import guarded_number, nz as _nz, prop as _prop  # noqa: E402
from clickloom.operators import interaction as INT  # noqa: E402


def _with_page(b):
    return b.withColumn("page_instance_id", _nz(_prop("page_instance_id"))).where(F.col("page_instance_id").isNotNull())


def _q_rage_clicks(spark, sf):
    """Each click event is expanded into the burst of pointer clicks behind it
    (1 + k % 6 clicks, k-derived spacing and drift), so clusters, spreads and
    the cool-down all occur."""
    b = _with_page(base(spark, sf)).where(F.col("event_name").isin("buy_button_click", "cta_impression"))
    k = (_prop("visible_ms").cast("int") / 100).cast("int")
    e = b.select("page_instance_id", "client_timestamp", k.alias("k"),
                 F.explode(F.sequence(F.lit(0), k % 6)).alias("i"))
    step_ms = F.lit(200) + (F.col("k") % 5) * 150
    clicks = e.select(
        "page_instance_id",
        (F.col("client_timestamp") + F.make_dt_interval(secs=F.col("i") * step_ms / 1000.0)).alias("ts"),
        ((F.col("k") * 37) % 400 + F.col("i") * (F.col("k") % 3) * 15).alias("x"),
        ((F.col("k") * 53) % 300).alias("y"))
    return INT.rage_clicks(clicks)


def _q_scroll_milestones(spark, sf):
    b = _with_page(base(spark, sf))
    s = b.select("page_instance_id", F.col("client_timestamp").alias("ts"),
                 _prop("max_scroll_depth").try_cast("int").alias("depth"))
    return INT.scroll_milestones(s)


def _q_section_dwell(spark, sf):
    b = _with_page(base(spark, sf)).where(F.col("event_name").isin("section_view", "section_engagement"))
    e = b.select("page_instance_id",
                 F.regexp_replace(F.coalesce(_prop("section_key"), _prop("chapter"), _prop("section_id"), F.lit("unknown")),
                                  "^[a-z]_", "section ").alias("section_key"),  # views and engagements name a section differently
                 F.col("client_timestamp").alias("ts"),
                 F.when(F.col("event_name") == "section_view", "enter").otherwise("exit").alias("state"))
    return INT.section_dwell(e)


def _q_page_vitals(spark, sf):
    b = _with_page(base(spark, sf)).where(F.col("event_name") == "page_performance")
    e = b.select("page_instance_id", F.col("client_timestamp").alias("ts"),
                 (_prop("quick_exit") == "true").alias("recent_input"),
                 F.explode(F.array(
                     F.struct(F.lit("lcp").alias("metric"), guarded_number(_prop("lcp_ms")).alias("value")),
                     F.struct(F.lit("inp").alias("metric"), guarded_number(_prop("inp_ms")).alias("value")),
                     F.struct(F.lit("cls").alias("metric"), guarded_number(_prop("cls")).alias("value")))).alias("e"))
    return INT.page_vitals(e.select("page_instance_id", "ts", "recent_input", "e.metric", "e.value"))


QUERIES.update({
    "rage_clicks": _q_rage_clicks,
    "scroll_milestones": _q_scroll_milestones,
    "section_dwell": _q_section_dwell,
    "page_vitals": lambda spark, sf: finish(_q_page_vitals(spark, sf)),
})


# --------------------------------------------------------------------------- checkout pixel + row helpers
from clickloom.functions.json import LINE_ITEM as _LINE_ITEM  # noqa: E402
from clickloom.operators import checkout as CO  # noqa: E402


def _pixel_events(spark, sf):
    """Shop-checkout events in the pixel's input shape, derived from the
    fixture's conversions."""
    b = events(spark, sf).where(F.col("event_name").isin("checkout_started", "purchase"))
    items = F.when(F.ltrim(_prop("line_items")).startswith("["), F.from_json(_prop("line_items"), _LINE_ITEM))
    line_items = F.transform(F.coalesce(items, F.array().cast(_LINE_ITEM)), lambda it: F.struct(
        F.concat(F.lit("li_"), it["product_id"]).alias("id"), it["product_title"].alias("title"),
        it["quantity"].alias("quantity"),
        F.struct(it["variant_id"].alias("id"), it["variant_title"].alias("title"),
                 F.struct(it["product_id"].alias("id"), it["product_title"].alias("title")).alias("product")).alias("variant"),
        F.struct(it["price"].alias("amount"), F.lit("BRL").alias("currencyCode")).alias("finalLinePrice")))
    uuid = lambda c, tag: F.format_string("%08x-0000-4000-8000-%012x", F.lit(tag), c)
    attrs = F.array(
        F.struct(F.lit("ct_visitor_id").alias("key"), uuid(F.col("visitor_id"), 2).alias("value")),
        F.struct(F.lit("ct_utm_campaign").alias("key"), F.col("utm_campaign").alias("value")),
        F.struct(F.lit("other").alias("key"), F.lit("x").alias("value")))
    return b.select(
        F.concat(F.lit("se_"), F.col("event_id").cast("string")).alias("id"),
        F.when(F.col("event_name") == "purchase", "checkout_completed").otherwise("checkout_started").alias("name"),
        F.col("event_id").alias("seq"), F.col("visitor_id").cast("string").alias("clientId"),
        F.date_format("client_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"),
        F.struct(F.struct(F.struct(F.col("page_url").alias("href")).alias("location"), F.col("page_title").alias("title"),
                          F.col("referrer").alias("referrer")).alias("document"),
                 F.struct(F.struct(F.col("page_url").alias("href")).alias("location"),
                          F.col("screen_width").cast("long").alias("innerWidth"),
                          F.struct(F.col("screen_width").cast("long").alias("width")).alias("screen")).alias("window"),
                 F.struct(F.col("language").alias("language")).alias("navigator")).alias("context"),
        F.struct(F.struct(_prop("checkout_id").alias("token"), attrs.alias("attributes"),
                          F.struct(_prop("order_id").alias("id"), F.lit(None).cast("string").alias("name")).alias("order"),
                          F.struct(_prop("value").alias("amount"), F.lit("BRL").alias("currencyCode")).alias("totalPrice"),
                          F.struct(F.lit("0").alias("amount"), F.lit("BRL").alias("currencyCode")).alias("subtotalPrice"),
                          F.lit("BRL").alias("currencyCode"), line_items.alias("lineItems")).alias("checkout")).alias("data"),
    )


def _q_checkout_payload(spark, sf):
    out = CO.checkout_payload(_pixel_events(spark, sf))
    return out.select("event_id", "event_name", "visitor_id", "utm_campaign", "device_type",
                      F.get_json_object("properties", "$.checkout_id").alias("checkout_id"),
                      F.get_json_object("properties", "$.value").alias("value"),
                      F.get_json_object("properties", "$.item_count").alias("item_count"))


def _q_device_buckets(spark, sf):
    b = base(spark, sf).withColumn("device_bucket", CO.device_bucket(F.col("screen_width")))
    return grouped_rollup(b, ["device_bucket"], sessions=None)


def _q_arrival_lag(spark, sf):
    return events(spark, sf).select("event_id", CO.lag_ms(F.col("received_at"), F.col("client_timestamp")).alias("lag_ms"))


from clickloom.functions.agg import grouped_rollup  # noqa: E402

QUERIES.update({
    "checkout_payload": _q_checkout_payload,
    "device_buckets": _q_device_buckets,
    "arrival_lag": _q_arrival_lag,
})
