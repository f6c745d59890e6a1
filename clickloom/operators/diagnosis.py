"""Unit economics, funnel metrics, warnings, sample readiness and funnel
diagnosis (M7-M12), funnel confidence (M2), coverage (M4) and data readiness
(M5, M6) - all as column expressions over small aggregated DataFrames (one row
per campaign / per report), never collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.config import READINESS_WEIGHTS
from clickloom.functions.stats import round_to, safe_divide, sample_label, score_from_ratio, wilson

# FIXED VALUES: minimum samples and KPI thresholds of the funnel SOP.
SOP_VERSION = "private_ecommerce_funnel_sop_v1"
MIN_CREATIVE_IMPRESSIONS = 2000
MIN_CREATIVE_LINK_CLICKS = 30
MIN_LANDING_LINK_CLICKS = 30
MIN_PAGE_LANDING_PAGE_VIEWS = 100
MIN_CART_ADD_TO_CARTS = 10
MIN_CHECKOUTS = 10
PREFERRED_CHECKOUTS = 20
CAC_SIGNAL_PURCHASES = 5
CAC_DECISION_PURCHASES = 10
CAC_STRONG_PURCHASES = 20
KPI = {  # metric: (poor_below, good_from)
    "hook_rate_percent": (20, 30),
    "link_ctr_percent": (1, 1.5),
    "click_to_landing_page_rate_percent": (70, 80),
    "add_to_cart_rate_percent": (4, 8),
    "add_to_cart_to_checkout_rate_percent": (30, 45),
    "checkout_to_purchase_rate_percent": (35, 50),
    "landing_page_to_purchase_rate_percent": (1, 2),
}
JS_EPSILON = 2.220446049250313e-16

FUNNEL_COLUMNS = ("spend", "impressions", "reach", "three_second_views", "link_clicks", "landing_page_views",
                  "add_to_carts", "checkouts", "purchases", "revenue")


def js_round(x: Column, digits: int = 2) -> Column:
    """Round half up after adding machine epsilon (the calculator's rounding)."""
    f = float(10 ** digits)
    return F.floor((x + F.lit(JS_EPSILON)) * F.lit(f) + F.lit(0.5)) / F.lit(f)


def parse_decimal(c: Column) -> Column:
    """Locale decimal text ('1.234,56' or '1234.56') -> double; '' -> NULL."""
    raw = F.regexp_replace(c.cast("string"), r"\s", "")
    norm = F.when(raw.contains(","), F.regexp_replace(F.regexp_replace(raw, r"\.", ""), ",", ".")).otherwise(raw)
    v = F.when(raw != "", norm.try_cast("double"))
    return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)


def _div4(n: Column, d: Column) -> Column:
    return F.when(n.isNotNull() & d.isNotNull() & (d > 0), js_round(n / d, 4))


def _pct(n: Column, d: Column) -> Column:
    r = _div4(n, d)
    return F.when(r.isNotNull(), js_round(r * 100.0, 4))


# --------------------------------------------------------------------- M7
def unit_economics(offers: DataFrame) -> DataFrame:
    """M7: break-even / target CAC and ROAS per offer row.  Input columns
    average_order_value, contribution_margin_percent, desired_profit_percent
    (numbers or locale text)."""
    aov = parse_decimal(F.col("average_order_value"))
    mp = parse_decimal(F.col("contribution_margin_percent"))
    dp = parse_decimal(F.col("desired_profit_percent"))
    configured = aov.isNotNull() & mp.isNotNull() & dp.isNotNull()
    valid = configured & (aov > 0) & (mp >= 0) & (mp <= 100) & (dp >= 0) & (dp <= mp)
    cm = aov * (mp / 100.0)
    profit = aov * (dp / 100.0)
    target = F.greatest(F.lit(0.0), cm - profit)
    warning = (F.when(~configured, "missing_inputs").when(valid, F.lit(None))
               .when(dp > mp, "profit_exceeds_margin").otherwise("invalid_ranges"))
    return offers.select(
        "*",
        configured.alias("economics_configured"),
        F.coalesce(valid, F.lit(False)).alias("economics_valid"),
        warning.alias("economics_warning"),
        F.when(valid, js_round(cm)).alias("contribution_margin_before_ads"),
        F.when(valid, js_round(cm)).alias("break_even_cac"),
        F.when(valid, js_round(target)).alias("target_cac"),
        F.when(valid, js_round(profit)).alias("desired_profit_after_ads"),
        F.when(valid & (cm > 0), js_round(aov / cm, 4)).alias("break_even_roas"),
        F.when(valid & (target > 0), js_round(aov / target, 4)).alias("target_roas"),
        F.when(valid, js_round(mp, 4)).alias("margin_percent"),
    )


# --------------------------------------------------------------------- M8
def funnel_metrics(funnel: DataFrame) -> DataFrame:
    """M8: rates and costs of a funnel row (columns ``FUNNEL_COLUMNS``, NULL =
    not informed)."""
    c = {k: F.col(k).cast("double") for k in FUNNEL_COLUMNS}
    m = {
        "hook_rate_percent": _pct(c["three_second_views"], c["impressions"]),
        "frequency": _div4(c["impressions"], c["reach"]),
        "ctr_percent": _pct(c["link_clicks"], c["impressions"]),
        "cpm": F.when(c["spend"].isNotNull() & (c["impressions"] > 0), js_round(c["spend"] / c["impressions"] * 1000.0, 4)),
        "cpc": _div4(c["spend"], c["link_clicks"]),
        "click_to_landing_page_rate_percent": _pct(c["landing_page_views"], c["link_clicks"]),
        "cost_per_landing_page_view": _div4(c["spend"], c["landing_page_views"]),
        "add_to_cart_rate_percent": _pct(c["add_to_carts"], c["landing_page_views"]),
        "cost_per_add_to_cart": _div4(c["spend"], c["add_to_carts"]),
        "add_to_cart_to_checkout_rate_percent": _pct(c["checkouts"], c["add_to_carts"]),
        "add_to_cart_to_purchase_rate_percent": _pct(c["purchases"], c["add_to_carts"]),
        "landing_page_to_checkout_rate_percent": _pct(c["checkouts"], c["landing_page_views"]),
        "cost_per_checkout": _div4(c["spend"], c["checkouts"]),
        "checkout_to_purchase_rate_percent": _pct(c["purchases"], c["checkouts"]),
        "landing_page_to_purchase_rate_percent": _pct(c["purchases"], c["landing_page_views"]),
        "cac": _div4(c["spend"], c["purchases"]),
        "roas": _div4(c["revenue"], c["spend"]),
        "observed_average_order_value": _div4(c["revenue"], c["purchases"]),
        "revenue_per_landing_page_view": _div4(c["revenue"], c["landing_page_views"]),
    }
    return funnel.select("*", *[v.alias(k) for k, v in m.items()])


# --------------------------------------------------------------------- M9
def funnel_warnings(funnel: DataFrame) -> DataFrame:
    """M9: consistency warnings (codes) of a funnel row; negative inputs give
    only ``negative_values``."""
    c = {k: F.col(k).cast("double") for k in FUNNEL_COLUMNS}

    def gt(a, b):
        return c[a].isNotNull() & c[b].isNotNull() & (c[a] > c[b])

    checks = [
        ("reach_exceeds_impressions", gt("reach", "impressions")),
        ("three_second_views_exceed_impressions", gt("three_second_views", "impressions")),
        ("clicks_exceed_impressions", gt("link_clicks", "impressions")),
        ("landing_page_views_exceed_clicks", gt("landing_page_views", "link_clicks")),
        ("add_to_carts_exceed_landing_page_views", gt("add_to_carts", "landing_page_views")),
        ("checkouts_exceed_add_to_carts", gt("checkouts", "add_to_carts")),
        ("purchases_exceed_checkouts", gt("purchases", "checkouts")),
        ("revenue_without_purchases", c["revenue"].isNotNull() & (c["revenue"] > 0)
         & (c["purchases"].isNull() | (c["purchases"] == 0))),
        ("add_to_carts_missing", c["add_to_carts"].isNull() & c["checkouts"].isNotNull()),
    ]
    valid = F.lit(True)
    for k in FUNNEL_COLUMNS:
        valid = valid & (c[k].isNull() | (c[k] >= 0))
    arr = F.filter(F.array(*[F.when(p, F.lit(n)) for n, p in checks]), lambda x: x.isNotNull())
    return funnel.select("*", valid.alias("funnel_valid"),
                         F.when(valid, arr).otherwise(F.array(F.lit("negative_values"))).alias("warnings"))


# --------------------------------------------------------------------- M11
def sample_statuses() -> dict[str, Column]:
    im, lc = F.col("impressions").cast("double"), F.col("link_clicks").cast("double")
    lpv, atc = F.col("landing_page_views").cast("double"), F.col("add_to_carts").cast("double")
    co, pu = F.col("checkouts").cast("double"), F.col("purchases").cast("double")
    return {
        "creative": F.when(im.isNull() & lc.isNull(), "missing")
        .when((F.coalesce(im, F.lit(0.0)) >= MIN_CREATIVE_IMPRESSIONS)
              | (F.coalesce(lc, F.lit(0.0)) >= MIN_CREATIVE_LINK_CLICKS), "decision_ready")
        .otherwise("insufficient"),
        "landing_delivery": F.when(lc.isNull(), "missing").when(lc >= MIN_LANDING_LINK_CLICKS, "decision_ready")
        .otherwise("insufficient"),
        "page": F.when(lpv.isNull(), "missing").when(lpv >= MIN_PAGE_LANDING_PAGE_VIEWS, "decision_ready")
        .otherwise("insufficient"),
        "cart": F.when(atc.isNull(), "missing").when(atc >= MIN_CART_ADD_TO_CARTS, "directional").otherwise("insufficient"),
        "checkout": F.when(co.isNull(), "missing").when(co < MIN_CHECKOUTS, "insufficient")
        .when(co < PREFERRED_CHECKOUTS, "directional").otherwise("decision_ready"),
        "cac": F.when(pu.isNull(), "missing").when(pu < CAC_SIGNAL_PURCHASES, "insufficient")
        .when(pu < CAC_DECISION_PURCHASES, "directional").when(pu < CAC_STRONG_PURCHASES, "decision_ready")
        .otherwise("strong"),
    }


def sample_readiness(funnel: DataFrame) -> DataFrame:
    """Sample status per stage."""
    return funnel.select("*", *[v.alias(f"{k}_sample_status") for k, v in sample_statuses().items()])


def _health(value: Column, status: Column, poor: float, good: float) -> Column:
    return (F.when(value.isNull(), "unavailable")
            .when(status.isin("missing", "insufficient"), "sample_insufficient")
            .when(value < poor, "bottleneck").when(value >= good, "healthy").otherwise("watch"))


# --------------------------------------------------------------------- M10 + M12
def diagnose_funnel(funnel: DataFrame, offers: DataFrame, on: str = "offer_id") -> DataFrame:
    """M10 + M12: economics comparison against the offer's target CAC and the
    ordered stage evaluation (first probable bottleneck, first stage waiting
    for sample, summary status).  ``funnel`` and ``offers`` are joined on
    ``on`` (an equi-join: each campaign names its offer)."""
    econ = unit_economics(offers).select(on, "target_cac", "margin_percent")
    f = sample_readiness(funnel_metrics(funnel)).join(econ, on, "left")
    st = {k: F.col(f"{k}_sample_status") for k in sample_statuses()}
    cac, target = F.col("cac"), F.col("target_cac")
    pu, sp, rev = F.col("purchases").cast("double"), F.col("spend").cast("double"), F.col("revenue").cast("double")
    stages = [
        ("creative_hook", "hook_rate_percent", st["creative"]),
        ("creative_click", "ctr_percent", st["creative"], "link_ctr_percent"),
        ("landing_delivery", "click_to_landing_page_rate_percent", st["landing_delivery"]),
        ("sales_page", "add_to_cart_rate_percent", st["page"]),
        ("cart", "add_to_cart_to_checkout_rate_percent", st["cart"]),
        ("checkout", "checkout_to_purchase_rate_percent", st["checkout"]),
        ("full_funnel", "landing_page_to_purchase_rate_percent", st["page"]),
    ]
    evals = []
    for i, s in enumerate(stages, start=1):
        name, metric, status = s[0], s[1], s[2]
        kpi = KPI[s[3] if len(s) > 3 else metric]
        evals.append(F.struct(F.lit(i).alias("order"), F.lit(name).alias("stage"), F.col(metric).alias("value"),
                              status.alias("sample_status"), _health(F.col(metric), status, *kpi).alias("health")))
    econ_health = (F.when(cac.isNull() | target.isNull(), "unavailable")
                   .when(st["cac"].isin("missing", "insufficient"), "sample_insufficient")
                   .when(cac > target, "bottleneck").otherwise("healthy"))
    evals.append(F.struct(F.lit(8).alias("order"), F.lit("economics").alias("stage"), cac.alias("value"),
                          st["cac"].alias("sample_status"), econ_health.alias("health")))
    arr = F.array(*evals)
    first_bad = F.get(F.filter(arr, lambda e: e["health"] == "bottleneck"), 0)
    first_wait = F.get(F.filter(arr, lambda e: e["health"] == "sample_insufficient"), 0)
    all_ok = F.forall(arr, lambda e: e["health"].isin("healthy", "watch", "unavailable"))
    summary = (F.when(first_bad.isNotNull(), "probable_bottleneck")
               .when(first_wait.isNotNull(), "waiting_for_sample")
               .when(all_ok, "no_confirmed_bottleneck").otherwise("no_data"))
    max_spend = F.when(pu.isNotNull() & target.isNotNull(), js_round(pu * target))
    profit = F.when(rev.isNotNull() & sp.isNotNull() & F.col("margin_percent").isNotNull(),
                    js_round(rev * (F.col("margin_percent") / 100.0) - sp))
    return f.select(
        "*",
        F.when(cac.isNull() | target.isNull(), "unavailable").when(cac <= target, "within_target")
        .otherwise("above_target").alias("cac_status"),
        F.when(cac.isNotNull() & target.isNotNull(), js_round(cac - target)).alias("cac_difference"),
        F.when(cac.isNotNull() & (target > 0), js_round((cac - target) / target * 100.0, 4)).alias("cac_difference_percent"),
        max_spend.alias("max_spend_at_target_cac"),
        F.when(max_spend.isNotNull() & sp.isNotNull(), js_round(max_spend - sp)).alias("spend_headroom_vs_target"),
        profit.alias("estimated_contribution_profit_after_ads"),
        _div4(profit, pu).alias("estimated_contribution_profit_per_purchase"),
        arr.alias("stage_evaluations"),
        first_bad["stage"].alias("first_probable_bottleneck"),
        first_wait["stage"].alias("first_stage_waiting_for_sample"),
        summary.alias("diagnosis_summary"),
    )


# --------------------------------------------------------------------- M2
FUNNEL_TRANSITIONS = (
    ("page_view_to_cta_impression", "cta_impression_visitors", "page_view_visitors"),
    ("cta_impression_to_buy_click", "buy_click_visitors", "cta_impression_visitors"),
    ("buy_click_to_checkout", "checkout_visitors", "buy_click_visitors"),
    ("checkout_to_purchase", "purchase_visitors", "checkout_visitors"),
    ("page_view_to_checkout", "checkout_visitors", "page_view_visitors"),
    ("page_view_to_purchase", "purchase_visitors", "page_view_visitors"),
)


def funnel_confidence(funnel: DataFrame, transitions=FUNNEL_TRANSITIONS) -> DataFrame:
    """M2: one row per funnel transition with its 95 % Wilson interval."""
    arr = F.array(*[F.struct(F.lit(n).alias("transition"), wilson(F.col(s), F.col(t)).alias("w"))
                    for n, s, t in transitions])
    return funnel.select(F.explode(arr).alias("x")).select("x.transition", "x.w.*")


# --------------------------------------------------------------------- M4 / M5 / M6
def coverage(overview: DataFrame) -> DataFrame:
    """M4: storage-version coverage and sessions per visitor of an overview row."""
    s, v = F.col("sessions").cast("double"), F.col("unique_visitors").cast("double")
    return overview.select(
        "*",
        F.when(s > 0, round_to(F.col("session_v2_sessions") / s * 100.0, 2)).otherwise(0.0).alias("session_v2_coverage_percent"),
        F.when(s > 0, round_to(F.col("session_v3_sessions") / s * 100.0, 2)).otherwise(0.0).alias("session_v3_coverage_percent"),
        F.when(v > 0, round_to(s / v, 4)).otherwise(0.0).alias("sessions_per_visitor"),
    )


def readiness_score(inputs: DataFrame) -> DataFrame:
    """M5: six 0..100 scores and their weighted total.  ``inputs`` is one row
    with unique_visitors, sessions, session_v3_sessions, summary_sessions,
    conversions_with_resolved_attribution, conversion_events,
    cta_impression_visitors, page_view_visitors, ad_rows."""
    def ratio(n, d):
        return F.coalesce(safe_divide(n, d), F.lit(0.0))

    sample = score_from_ratio(F.least(F.lit(1.0), F.col("unique_visitors") / 100.0))
    v3 = score_from_ratio(ratio("session_v3_sessions", "sessions"))
    summ = score_from_ratio(ratio("summary_sessions", "sessions"))
    attr = score_from_ratio(ratio("conversions_with_resolved_attribution", "conversion_events"))
    beh = score_from_ratio(F.greatest(ratio("cta_impression_visitors", "page_view_visitors"),
                                      ratio("summary_sessions", "sessions")))
    meta = F.when(F.col("ad_rows") > 0, 100).otherwise(0)
    w = READINESS_WEIGHTS
    total = F.floor(sample * w[0] + v3 * w[1] + summ * w[2] + attr * w[3] + beh * w[4] + meta * w[5] + 0.5).cast("int")
    return inputs.select(
        total.alias("overall_score"), sample.alias("sample_score"), v3.alias("session_v3_score"),
        summ.alias("summary_coverage_score"), attr.alias("attribution_score"),
        beh.alias("behavior_coverage_score"), meta.cast("int").alias("meta_ads_score"),
        sample_label(F.col("unique_visitors")).alias("sample_label"),
    )


def readiness_labels(inputs: DataFrame) -> DataFrame:
    """M6: sample label, readiness flags and the list of blockers (codes).
    ``inputs``: unique_visitors, sessions, session_v3_sessions,
    orphan_conversion_visitors, ad_rows, purchase_visitors, failed_blocks."""
    uv, s, v3 = F.col("unique_visitors"), F.col("sessions"), F.col("session_v3_sessions")
    from clickloom.functions.stats import blockers

    return inputs.select(
        sample_label(uv).alias("sample_label"),
        ((s > 0) & (v3 == s)).alias("tracker_v3_ready"),
        (F.col("ad_rows") > 0).alias("meta_ads_available"),
        F.array_join(blockers({
            "sample_below_20_visitors": uv < 20,
            "not_all_sessions_tracker_v3": (s > 0) & (v3 < s),
            "orphan_conversions": F.col("orphan_conversion_visitors") > 0,
            "no_ad_data": F.col("ad_rows") == 0,
            "no_external_purchase": F.col("purchase_visitors") == 0,
            "isolated_block_failures": F.col("failed_blocks") > 0,
        }), ",").alias("blockers"),
    )
