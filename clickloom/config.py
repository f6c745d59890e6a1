"""Configuration and fixed values.

Everything that must equal the studied application's behaviour for identical
results is listed once, below, under "FIXED VALUES".  Host names of the original
deployment are deliberately *not* part of the library: control-surface and
preview host patterns are arguments (see ``ReportConfig``).
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

# ---------------------------------------------------------------------------
# FIXED VALUES (must match the studied application's semantics)
# ---------------------------------------------------------------------------

# Report period when none is given.
DEFAULT_DAYS = 90
# Attribution look-back for checkout / purchase resolution.
ATTRIBUTION_LOOKBACK_DAYS = 30
# Ingest limits; they apply only where a caller asks for them (``IngestLimits``).
MAX_BODY_BYTES = 96_000
MAX_PROPERTIES_BYTES = 64_000
MAX_PAGE_URL = 8_192
# Text caps of the same limits (column -> max characters).
TEXT_CAPS = {
    "page_path": 4096,
    "page_title": 512,
    "referrer": 8192,
    "utm_source": 255,
    "utm_medium": 255,
    "utm_campaign": 255,
    "utm_content": 255,
    "utm_term": 255,
    "fbclid": 1024,
    "device_type": 32,
    "language": 64,
}
EVENT_NAME_PATTERN = r"^[a-z][a-z0-9_]{0,63}$"
UUID_PATTERN = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
NUMERIC_TEXT_PATTERN = r"^-?[0-9]+(\.[0-9]+)?$"
DEVICE_TYPES = ("mobile", "tablet", "desktop")
SCREEN_WIDTH_MAX = 20_000

# Funnel stage event names.
STAGE_EVENTS = (
    "page_view",
    "cta_impression",
    "buy_button_click",
    "add_to_cart",
    "checkout_started",
    "purchase",
)
CONVERSION_EVENTS = ("checkout_started", "purchase")

# Labels used when grouping keys are missing.
LABEL_DIRECT_SOURCE = "Direto / não informado"
LABEL_DIRECT_CAMPAIGN = "Direto / não atribuído"
LABEL_NOT_INFORMED = "Não informado"
LABEL_UNKNOWN = "unknown"
LABEL_NO_REFERRER = "Sem referrer"

# Creative taxonomy property keys.
TAXONOMY_KEYS = (
    "concept",
    "hook",
    "sales_message",
    "format",
    "angle",
    "awareness_level",
    "landing_version",
    "offer_version",
)

# Keys hashed by the sanitiser.
SENSITIVE_KEYS = (
    "checkout_token",
    "checkout_id",
    "order_id",
    "shopify_event_id",
    "fbclid",
    "gclid",
    "ttclid",
    "email",
    "phone",
    "phone_number",
    "customer_email",
)
# Key-name suffixes that keep numeric-looking strings as text.
NON_NUMERIC_KEY_PATTERN = (
    r"(?i)(?:^|_)(?:id|date|day|time|timestamp|at|url|path|title|name|source|medium|"
    r"campaign|creative|term|currency|language|device|method|confidence|reason|type|key|"
    r"hash|token|pattern|status|schema|version|warning|note|request)$"
)
URL_KEY_PATTERN = r"(?i)(?:url|referrer|landing_page|destination)$"
URL_PRESERVED_PARAMS = ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "ref")
URL_CLICK_ID_PARAMS = ("fbclid", "gclid", "ttclid")

# Traffic classifier rules.
CLASSIFY_INTERNAL_URL_PARAM = r"[?&]ct_internal=(1|true)(&|$)"
CLASSIFY_LOCALHOST = r"^https?://(localhost|127\.0\.0\.1)(:[0-9]+)?(/|$)"
CLASSIFY_BOT_UA = (
    r"(googlebot|bingbot|duckduckbot|baiduspider|yandexbot|facebookexternalhit|"
    r"meta-externalagent|meta-externalfetcher|crawler|spider|bot([/ ;]|$))"
)
CLASSIFY_TEST_URL_PARAM = r"[?&]ct_test=(1|true)(&|$)"
CLASSIFY_TEST_CAMPAIGN = r"(^|[-_ ])(teste|test|qa|debug|internal)([-_ ]|$)"

# Ad actions used as fallbacks when a metric column is 0.
AD_ACTION_FALLBACKS = {
    "landing_page_views": ("landing_page_view",),
    "add_to_cart": ("add_to_cart", "omni_add_to_cart"),
    "initiate_checkout": ("initiate_checkout", "omni_initiated_checkout"),
    "purchases": ("purchase", "omni_purchase"),
}

# Wilson interval z for 95 %.
WILSON_Z = 1.959963984540054

# Readiness weights: sample, session v3, summary coverage, attribution,
# behaviour coverage, ad data.
READINESS_WEIGHTS = (0.15, 0.20, 0.20, 0.25, 0.10, 0.10)

# ---------------------------------------------------------------------------
# Run-time configuration
# ---------------------------------------------------------------------------


def normalize_days(days) -> int:
    """A report period in days: any positive whole number (also as text);
    None is the default period."""
    if days is None:
        return DEFAULT_DAYS
    d = int(days)
    if d < 1:
        raise ValueError(f"a report period has at least one day, not {d}")
    return d


def raw_limit(limit) -> int | None:
    """Rows of the raw dump: None is all of them."""
    if limit is None:
        return None
    n = int(limit)
    if n < 1:
        raise ValueError(f"a limit is at least one row, not {n}")
    return n


@dataclass(frozen=True)
class IngestLimits:
    """Size limits of ingest; the default has none."""

    body: int | None = None
    properties: int | None = None
    page_url: int | None = None
    screen_width: int | None = None
    text: dict = field(default_factory=dict)

    @classmethod
    def fixed(cls) -> IngestLimits:
        """The fixed values above."""
        return cls(MAX_BODY_BYTES, MAX_PROPERTIES_BYTES, MAX_PAGE_URL, SCREEN_WIDTH_MAX, TEXT_CAPS)


@dataclass(frozen=True)
class ReportConfig:
    """Parameters of one report run (replaces ``now()`` by ``as_of``)."""

    as_of: dt.datetime
    days: int = DEFAULT_DAYS
    control_pattern: str | None = None  # case-insensitive URL regex of the operator's own UI
    ads_as_of: dt.date | None = None
    ads_days: int = DEFAULT_DAYS
    raw_limit: int | None = None
    lookback_days: int = ATTRIBUTION_LOOKBACK_DAYS
    extra: dict = field(default_factory=dict)
