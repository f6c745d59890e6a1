"""Traffic classification (U1), history re-classification (S9), duplicate
marking / dedupe by shop event id (S10, W1) and the stamping done at insert (U2).

Everything is a column expression or an aggregate + join; the property bag is
rewritten with a typed merge (``map<string, variant>``: the right side wins,
value types preserved) instead of string surgery.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.config import (
    CLASSIFY_BOT_UA,
    CLASSIFY_INTERNAL_URL_PARAM,
    CLASSIFY_LOCALHOST,
    CLASSIFY_TEST_CAMPAIGN,
    CLASSIFY_TEST_URL_PARAM,
)
from clickloom.functions.json import nz, prop, with_props

CLASSIFICATION_VERSION = 1


def classification_rules(control_pattern: str | None = None, preview_pattern: str | None = None):
    """Ordered (class, reason, predicate) rules; first match wins.  Inputs are
    lower-cased URL / path / campaign / user agent and the two flags."""
    url = F.lower(F.coalesce(F.col("page_url"), F.lit("")))
    path = F.lower(F.coalesce(F.col("page_path"), F.lit("")))
    campaign = F.lower(F.coalesce(F.col("utm_campaign"), F.lit("")))
    ua = F.lower(F.coalesce(prop("server_context.user_agent"), F.lit("")))
    is_test = F.lower(F.coalesce(prop("test"), F.lit("false"))) == "true"
    is_internal = F.lower(F.coalesce(prop("internal_traffic"), F.lit("false"))) == "true"
    never = F.lit(False)
    return [
        ("internal", "property_internal_traffic", is_internal),
        ("internal", "url_ct_internal", url.rlike(CLASSIFY_INTERNAL_URL_PARAM)),
        ("internal", "tracker_control_surface", url.rlike(control_pattern) if control_pattern else never),
        ("internal", "localhost", url.rlike(CLASSIFY_LOCALHOST)),
        ("bot", "known_bot_user_agent", ua.rlike(CLASSIFY_BOT_UA)),
        ("preview", "vercel_preview", url.rlike(preview_pattern) if preview_pattern else never),
        ("preview", "shopify_theme_preview", url.like("%preview_theme_id=%") | path.like("%preview_theme_id=%")),
        ("preview", "shopify_preview", url.like("%shopify-preview%")),
        ("qa", "property_test", is_test),
        ("qa", "url_ct_test", url.rlike(CLASSIFY_TEST_URL_PARAM)),
        ("qa", "test_campaign", campaign.rlike(CLASSIFY_TEST_CAMPAIGN)),
    ]


def classify_columns(control_pattern: str | None = None, preview_pattern: str | None = None) -> tuple[Column, Column]:
    rules = classification_rules(control_pattern, preview_pattern)
    cls = F.lit("production")
    reason = F.lit("production_default")
    for c, r, pred in reversed(rules):
        cls = F.when(pred, F.lit(c)).otherwise(cls)
        reason = F.when(pred, F.lit(r)).otherwise(reason)
    return cls, reason


def classify_traffic(df: DataFrame, control_pattern: str | None = None, preview_pattern: str | None = None) -> DataFrame:
    """Add ``traffic_classification`` and ``traffic_classification_reason``."""
    df = with_props(df)
    cls, reason = classify_columns(control_pattern, preview_pattern)
    return df.withColumn("traffic_classification", cls).withColumn("traffic_classification_reason", reason)


def json_merge(props: Column, updates: dict[str, Column]) -> Column:
    """Top-level JSON object merge, right side wins (``a || b``).  ``updates``
    values are VARIANT columns (NULL entries are skipped)."""
    return bag_merge(json_bag(props), updates)


def json_bag(props: Column) -> Column:
    """The members of a top-level JSON object, none where there is no object."""
    return F.coalesce(F.from_json(props, "map<string,variant>"), F.create_map().cast("map<string,variant>"))


def bag_merge(m: Column, updates: dict[str, Column]) -> Column:
    """``json_merge`` of an object that is already read (``json_bag``)."""
    keys = list(updates)
    kept = F.map_filter(m, lambda k, v: ~k.isin(*keys))
    add = F.map_filter(
        F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*[updates[k] for k in keys])),
        lambda k, v: v.isNotNull(),
    )
    return F.to_json(F.map_concat(kept, add))


def _v(c: Column) -> Column:
    return c.cast("variant")


def _vjson(text: str) -> Column:
    return F.parse_json(F.lit(text))


def reclassify_history(ev: DataFrame, classified_at, control_pattern: str | None = None,
                       preview_pattern: str | None = None) -> DataFrame:
    """Stamp classification, reason, version and time into every row's
    property bag; non-production rows also get ``test: true``, internal rows
    ``internal_traffic: true``.  Returns a new version of the table (no in-place
    update)."""
    c = classify_traffic(ev, control_pattern, preview_pattern)
    cls = F.col("traffic_classification")
    ts = classified_at if isinstance(classified_at, Column) else F.lit(str(classified_at))
    updates = {
        "traffic_classification": _v(cls),
        "traffic_classification_reason": _v(F.col("traffic_classification_reason")),
        "traffic_classification_version": _vjson(str(CLASSIFICATION_VERSION)),
        "traffic_classified_at": _v(ts.cast("string")),
        "test": F.when(cls != "production", _vjson("true")),
        "internal_traffic": F.when(cls == "internal", _vjson("true")),
    }
    # a NULL update means "leave the existing value": merge it back from the old map
    c, old = c.withColumn("_bag", json_bag(F.col("properties"))), F.col("_bag")  # a column of its own: read once
    for k in ("test", "internal_traffic"):
        updates[k] = F.coalesce(updates[k], old[k])
    return c.withColumn("properties", bag_merge(old, updates)).drop("p", "_bag")


def first_per_key(df: DataFrame, key: Column, order: list[str]) -> DataFrame:
    """(key, first row's order struct) per key.  An aggregate: partial
    aggregation keeps one row per key and task before the shuffle, so a hot
    key never lands whole in one task."""
    return (df.where(key.isNotNull())
            .groupBy(key.alias("_k"))
            .agg(F.min(F.struct(*[F.col(c) for c in order])).alias("_first")))


def mark_duplicates(ev: DataFrame, order=("received_at", "event_id")) -> DataFrame:
    """Every non-first copy of a shop event id is stamped
    ``duplicate`` / ``duplicate_shopify_event_id`` and ``test: true``; rows are
    kept (nothing is deleted)."""
    ev = with_props(ev).withColumn("_k", nz(prop("shopify_event_id")))
    firsts = first_per_key(ev, F.col("_k"), list(order))
    # Only rows that carry an id take part in the join: the (many) rows
    # without one would all hash to the NULL key's single partition.
    keyed = ev.where(F.col("_k").isNotNull()).join(firsts, "_k", "inner")
    keyed = keyed.withColumn("is_duplicate", F.struct(*[F.col(c) for c in order]) != F.col("_first")).drop("_first")
    rest = ev.where(F.col("_k").isNull()).withColumn("is_duplicate", F.lit(False))
    return keyed.unionByName(rest).drop("_k")


def dedupe_shopify(ev: DataFrame, order=("received_at", "event_id")) -> DataFrame:
    """Keep the first row per shop event id (rows without one pass)."""
    return mark_duplicates(ev, order).where(~F.col("is_duplicate")).drop("is_duplicate")


def stamp_duplicates(ev: DataFrame, classified_at) -> DataFrame:
    """S10 as a property rewrite of the marked rows."""
    m = mark_duplicates(ev)
    ts = F.lit(str(classified_at))
    updates = {
        "traffic_classification": _vjson('"duplicate"'),
        "traffic_classification_reason": _vjson('"duplicate_shopify_event_id"'),
        "traffic_classification_version": _vjson(str(CLASSIFICATION_VERSION)),
        "traffic_classified_at": _v(ts),
        "test": _vjson("true"),
    }
    return m.withColumn(
        "properties", F.when(F.col("is_duplicate"), json_merge(F.col("properties"), updates)).otherwise(F.col("properties"))
    ).drop("p")


def default_classified_at() -> str:
    return dt.datetime.now(dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
