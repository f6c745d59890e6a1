"""Checkout pixel normalisation (X15, X16, X18) and small row-level helpers
(X13 arrival lag, X14 device bucket, X21 quick exit).

``checkout_payload`` turns raw shop-checkout events (the pixel's input: event
id / name / timestamp / context / data.checkout) into rows of the event table.
Everything is a column expression; nothing per row runs in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.config import UUID_PATTERN

S = T.StringType()
MONEY = T.StructType([T.StructField("amount", S), T.StructField("currencyCode", S)])
LINE_ITEM = T.StructType([
    T.StructField("id", S), T.StructField("title", S), T.StructField("quantity", S),
    T.StructField("variant", T.StructType([
        T.StructField("id", S), T.StructField("title", S),
        T.StructField("product", T.StructType([T.StructField("id", S), T.StructField("title", S)]))])),
    T.StructField("finalLinePrice", MONEY),
])
PIXEL_EVENT = T.StructType([
    T.StructField("id", S), T.StructField("name", S), T.StructField("seq", T.LongType()),
    T.StructField("clientId", S), T.StructField("timestamp", S),
    T.StructField("context", T.StructType([
        T.StructField("document", T.StructType([
            T.StructField("location", T.StructType([T.StructField("href", S)])),
            T.StructField("title", S), T.StructField("referrer", S)])),
        T.StructField("window", T.StructType([
            T.StructField("location", T.StructType([T.StructField("href", S)])),
            T.StructField("innerWidth", T.LongType()),
            T.StructField("screen", T.StructType([T.StructField("width", T.LongType())]))])),
        T.StructField("navigator", T.StructType([T.StructField("language", S)])),
    ])),
    T.StructField("data", T.StructType([T.StructField("checkout", T.StructType([
        T.StructField("token", S),
        T.StructField("attributes", T.ArrayType(T.StructType([T.StructField("key", S), T.StructField("value", S)]))),
        T.StructField("order", T.StructType([T.StructField("id", S), T.StructField("name", S)])),
        T.StructField("totalPrice", MONEY), T.StructField("subtotalPrice", MONEY),
        T.StructField("currencyCode", S),
        T.StructField("lineItems", T.ArrayType(LINE_ITEM)),
    ]))])),
])

# FIXED VALUES: shop event name -> tracked event name; attribute keys read.
PIXEL_EVENT_NAMES = {"checkout_started": "checkout_started", "checkout_completed": "purchase"}


def lag_ms(arrival: Column, client_ts: Column) -> Column:
    """max(0, arrival - client time) in milliseconds."""
    return F.greatest(F.lit(0), F.unix_millis(arrival.cast("timestamp")) - F.unix_millis(client_ts.cast("timestamp")))


def device_bucket(width: Column) -> Column:
    """<768 mobile, <1024 tablet, else desktop (0 / missing = desktop)."""
    w = F.coalesce(width.cast("double"), F.lit(0.0))
    return F.when((w > 0) & (w < 768), "mobile").when((w >= 768) & (w < 1024), "tablet").otherwise("desktop")


def quick_exit(visible_seconds: Column, max_scroll: Column, pointer_count: Column) -> Column:
    """Visible < 10 s, scroll < 25 % and no pointer interaction."""
    return (visible_seconds < 10) & (max_scroll < 25) & (pointer_count == 0)


def compact_map(m: Column) -> Column:
    """Drop NULL and '' entries of a map."""
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v.cast("string") != ""))


def ct_attributes(attrs: Column) -> Column:
    """[{key, value}] -> map of the keys starting with ``ct_`` (last wins)."""
    kept = F.filter(attrs, lambda a: a["key"].startswith("ct_"))
    keys = F.transform(kept, lambda a: a["key"])
    last = F.filter(kept, lambda a, i: F.array_position(F.reverse(keys), a["key"]) == F.size(keys) - i)
    return F.map_from_entries(F.transform(last, lambda a: F.struct(a["key"], a["value"])))


def _money(m: Column) -> Column:
    v = m["amount"].try_cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def _stable_uuid(*parts: Column) -> Column:
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)),
                       F.concat(F.lit("8"), F.substring(h, 18, 3)), F.substring(h, 21, 12))


def checkout_payload(raw: DataFrame, default_url: str = "https://shop.invalid/", source_page_type: str = "sales_page",
                     id_pattern: str = UUID_PATTERN) -> DataFrame:
    """Pixel checkout events -> event rows (ids, value = total else
    subtotal, currency, all items, item count = sum of max(0, qty),
    UTMs from the page URL else ``ct_`` attributes, journey fields, empties
    dropped).  Invalid visitor / session ids get a stable id derived from the
    shop event id (the pixel would draw a random one)."""
    from clickloom.functions.urls import params_map, query_pairs

    co = F.col("data.checkout")
    names = F.create_map(*[x for k, v in PIXEL_EVENT_NAMES.items() for x in (F.lit(k), F.lit(v))])
    df = raw.select(
        "*",
        ct_attributes(co["attributes"]).alias("_a"),
        F.coalesce(F.col("context.document.location.href"), F.col("context.window.location.href"),
                   F.lit(default_url)).alias("_url"),
    )
    df = df.withColumn("_q", params_map(query_pairs(F.col("_url"))))
    a, q = F.col("_a"), F.col("_q")

    def utm(k: str) -> Column:
        return F.coalesce(F.when(q[k] != "", q[k]), F.when(a[f"ct_{k}"] != "", a[f"ct_{k}"]))

    items = F.coalesce(co["lineItems"], F.array().cast(T.ArrayType(LINE_ITEM)))
    item_rows = F.transform(items, lambda it: F.struct(
        it["id"].alias("line_item_id"), it["title"].alias("title"),
        F.coalesce(it["quantity"].try_cast("double"), F.lit(0.0)).alias("quantity"),
        it["variant"]["id"].alias("variant_id"), it["variant"]["title"].alias("variant_title"),
        it["variant"]["product"]["id"].alias("product_id"), it["variant"]["product"]["title"].alias("product_title"),
        _money(it["finalLinePrice"]).alias("line_value")))
    value = F.coalesce(_money(co["totalPrice"]), _money(co["subtotalPrice"]))
    checkout_id = F.coalesce(co["token"], a["ct_checkout_id"])
    event_name = names[F.col("name")]
    visitor = F.when(a["ct_visitor_id"].rlike(id_pattern), a["ct_visitor_id"]).otherwise(
        _stable_uuid(F.lit("v"), F.col("id")))
    session = F.when(a["ct_session_id"].rlike(id_pattern), a["ct_session_id"]).otherwise(
        _stable_uuid(F.lit("s"), F.col("id")))
    props = F.struct(
        F.lit("shopify_custom_pixel").alias("source"), F.lit(2).alias("tracker_version"),
        F.lit("checkout").alias("page_type"),
        F.when(event_name == "purchase", "purchase").otherwise("checkout_started").alias("funnel_stage"),
        F.coalesce(a["ct_page_type"], F.lit(source_page_type)).alias("source_page_type"),
        F.coalesce(a["ct_journey_type"], F.lit("unknown")).alias("journey_type"),
        F.col("id").alias("shopify_event_id"), F.col("name").alias("shopify_event_name"),
        F.col("seq").alias("shopify_event_sequence"), F.col("clientId").alias("shopify_client_id"),
        checkout_id.alias("checkout_id"), F.coalesce(a["ct_checkout_id"], checkout_id).alias("ct_checkout_id"),
        F.coalesce(co["order"]["id"], co["order"]["name"]).alias("order_id"),
        value.alias("value"), value.alias("revenue"),
        F.coalesce(co["currencyCode"], co["totalPrice"]["currencyCode"]).alias("currency"),
        F.aggregate(item_rows, F.lit(0.0), lambda acc, it: acc + F.greatest(F.lit(0.0), it["quantity"])).alias("item_count"),
        item_rows.alias("line_items"),
        a["ct_visitor_id"].alias("ct_visitor_id"), a["ct_session_id"].alias("ct_session_id"),
        a["ct_page_instance_id"].alias("ct_page_instance_id"), F.coalesce(a["ct_origin"], F.lit("shopify")).alias("ct_origin"),
        compact_map(a).alias("checkout_attributes"), F.lit(False).alias("pii_included"),
    )
    path = F.regexp_extract(F.col("_url"), r"^[a-zA-Z]+://[^/?#]+([^#]*)", 1)
    return df.select(
        _stable_uuid(F.lit("e"), F.col("id"), F.col("name")).alias("event_id"),
        event_name.alias("event_name"), visitor.alias("visitor_id"), session.alias("session_id"),
        F.coalesce(F.try_to_timestamp(F.col("timestamp")), F.current_timestamp()).cast("timestamp_ntz").alias("client_timestamp"),
        F.col("_url").alias("page_url"), F.when(path != "", path).alias("page_path"),
        F.col("context.document.title").alias("page_title"), F.col("context.document.referrer").alias("referrer"),
        *[utm(k).alias(k) for k in ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid")],
        device_bucket(F.col("context.window.innerWidth")).alias("device_type"),
        F.col("context.window.screen.width").cast("int").alias("screen_width"),
        F.col("context.navigator.language").alias("language"),
        F.to_json(props).alias("properties"),
    ).where(F.col("event_name").isNotNull())
