"""Property-bag access.

Bronze events carry ``properties`` as a JSON string.  ``with_props`` parses it
once with an explicit schema into the struct column ``p`` (every leaf read as
text, the same coercion as a scalar text extraction: numbers keep their
literal text, ``null``/missing give NULL, nested objects give their JSON text).
Catalyst prunes the struct to the fields a plan actually uses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.config import NUMERIC_TEXT_PATTERN

S = T.StringType()


def _st(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, S) for n in names])


FIRST_TOUCH = _st("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid")
CONVERSION_ATTRIBUTION = _st(
    "version", "visitor_id", "session_id", "method", "confidence", "cross_session", "checkout_id",
    "order_id", "actual_visitor_id", "actual_session_id", "identifier_source", "lookback_days", "resolved_at",
)

PROPS_SCHEMA = T.StructType(
    [T.StructField(n, S) for n in (
        "test", "internal_traffic", "traffic_classification", "traffic_classification_reason",
        "session_storage_version", "session_started_at", "checkout_id", "checkout_token", "ct_checkout_id",
        "order_id", "ct_order_id", "value", "placement", "element_text", "section_key", "chapter",
        "section_id", "visible_ms", "visible_seconds", "max_scroll_depth", "sections_viewed",
        "quick_exit", "duration_seconds", "rage_click_count", "dead_click_count", "page_instance_id",
        "ttfb_ms", "lcp_ms", "inp_ms", "cls", "load_ms", "page_type", "journey_type", "concept", "hook",
        "sales_message", "format", "angle", "awareness_level", "landing_version", "offer_version",
        "message", "filename", "kind", "anomaly_type", "element_tag", "shopify_event_id", "line_items",
        "product_id", "variant_id", "product_name", "currency", "visible_ms_before_impression",
        "seconds_to_click", "seconds_visible", "viewport_width", "viewport_height",
        "effective_connection_type", "country", "ct_session_id", "source_session_id",
        "attributed_session_id", "ct_visitor_id", "source_visitor_id", "attributed_visitor_id",
    )]
    + [
        T.StructField("first_touch", FIRST_TOUCH),
        T.StructField("conversion_attribution", CONVERSION_ATTRIBUTION),
        T.StructField("checkout_attributes", _st("ct_journey_type")),
        T.StructField("server_context", _st("user_agent", "origin", "country")),
    ]
)

LINE_ITEM = T.ArrayType(_st("product_id", "variant_id", "product_title", "variant_title", "quantity", "price"))


def with_props(df: DataFrame, col: str = "properties", out: str = "p") -> DataFrame:
    """Silver projection: parse the property bag once."""
    if out in df.columns:
        return df
    return df.withColumn(out, F.from_json(F.col(col), PROPS_SCHEMA))


def prop(path: str, root: str = "p") -> Column:
    """Text value of a (possibly nested) property, e.g. ``prop('first_touch.utm_source')``."""
    return F.col(f"{root}.{path}")


def nz(c: Column) -> Column:
    """NULLIF(c, '')."""
    return F.when(c != "", c)


def is_true(c: Column) -> Column:
    """coalesce(c, 'false') = 'true'."""
    return F.coalesce(c, F.lit("false")) == "true"


def guarded_number(c: Column) -> Column:
    """Cast text to double only when it is a plain decimal literal, else NULL."""
    return F.when(nz(c).rlike(NUMERIC_TEXT_PATTERN), c.cast("double"))


def loose_number(c: Column) -> Column:
    """NULLIF(c,'')::numeric without a guard; non-numbers give NULL (``try_cast``)."""
    return (nz(c)).try_cast("double")


def json_keys(col: str = "properties") -> Column:
    return F.json_object_keys(F.col(col))


def has_any_key(keys, col: str = "properties") -> Column:
    """Row carries at least one of ``keys`` (a key present with null counts)."""
    return F.arrays_overlap(json_keys(col), F.array(*[F.lit(k) for k in keys])) == F.lit(True)
