"""Post-aggregation statistics as column expressions (M1-M3, M5, M6)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clickloom.config import WILSON_Z


def _c(x) -> Column:
    if isinstance(x, Column):
        return x
    if isinstance(x, str):
        return F.col(x)
    return F.lit(x)


def round_to(x, digits: int = 6) -> Column:
    """Round half away from zero on the binary value scaled by 10^digits (the
    same result as ``round(x, d)`` in common SQL engines for doubles)."""
    scale = F.lit(10.0 ** digits)
    return F.round(_c(x).cast("double") * scale) / scale


def safe_divide(n, d, digits: int = 6) -> Column:
    """M1: NULL unless the denominator is > 0; rounded to ``digits``."""
    n, d = _c(n).cast("double"), _c(d).cast("double")
    return F.when(d > 0, round_to(n / d, digits))


def half_up(x, digits: int = 0) -> Column:
    """Round half toward +infinity at ``digits`` (Spark's ``round`` rounds
    -2.5 to -3)."""
    scale = 10.0 ** digits
    return F.floor(_c(x) * scale + F.lit(0.5)) / scale


def wilson(successes, total) -> Column:
    """M2: 95 % Wilson score interval as a struct
    (successes, total, rate, lower_95, upper_95, valid, warning)."""
    s, n = _c(successes).cast("double"), _c(total).cast("double")
    z = F.lit(WILSON_Z)
    valid = (n > 0) & (s >= 0) & (s <= n)
    p = s / n
    den = F.lit(1.0) + z * z / n
    center = (p + z * z / (F.lit(2.0) * n)) / den
    margin = (z / den) * F.sqrt(p * (F.lit(1.0) - p) / n + z * z / (F.lit(4.0) * n * n))
    warning = F.when(valid, F.lit(None).cast("string")).when(
        s > n, F.lit("successes exceed total: identity fragmentation or incompatible units")
    ).otherwise(F.lit("no valid denominator"))
    return F.struct(
        _c(successes).cast("bigint").alias("successes"),
        _c(total).cast("bigint").alias("total"),
        F.when(valid, round_to(p, 6)).alias("rate"),
        F.when(valid, round_to(F.greatest(F.lit(0.0), center - margin), 6)).alias("lower_95"),
        F.when(valid, round_to(F.least(F.lit(1.0), center + margin), 6)).alias("upper_95"),
        valid.alias("valid"),
        warning.alias("warning"),
    )


def ads_metrics_cols(spend="spend", impressions="impressions", clicks="clicks",
                     lpv="landing_page_views", purchases="purchases", purchase_value="purchase_value") -> dict[str, Column]:
    """M3: derived ad metrics (ctr, cpc, cpm, lpv rate, cost / lpv, cpa, roas)."""
    sp, im = F.coalesce(_c(spend).cast("double"), F.lit(0.0)), F.coalesce(_c(impressions).cast("double"), F.lit(0.0))
    cl, lp = F.coalesce(_c(clicks).cast("double"), F.lit(0.0)), F.coalesce(_c(lpv).cast("double"), F.lit(0.0))
    pu, pv = F.coalesce(_c(purchases).cast("double"), F.lit(0.0)), F.coalesce(_c(purchase_value).cast("double"), F.lit(0.0))
    return {
        "ctr": safe_divide(cl, im),
        "cpc": safe_divide(sp, cl),
        "cpm": F.when(im > 0, round_to(sp / im * 1000.0, 4)),
        "landing_page_view_rate": safe_divide(lp, cl),
        "cost_per_landing_page_view": safe_divide(sp, lp),
        "cpa": safe_divide(sp, pu),
        "roas": safe_divide(pv, sp),
    }


def score_from_ratio(r) -> Column:
    """0..100 score of a ratio: round half up of ratio * 100, clamped."""
    x = F.coalesce(_c(r).cast("double"), F.lit(0.0))
    return F.least(F.lit(100), F.greatest(F.lit(0), F.floor(x * 100.0 + 0.5))).cast("int")


def sample_label(unique_visitors) -> Column:
    v = _c(unique_visitors)
    return F.when(v < 20, "exploratory_only").when(v < 100, "directional").otherwise("stronger_directional")


def blockers(conditions: dict[str, Column]) -> Column:
    """M6: array of the messages whose condition holds (order kept)."""
    arr = F.array(*[F.when(c, F.lit(msg)) for msg, c in conditions.items()])
    return F.filter(arr, lambda x: x.isNotNull())
