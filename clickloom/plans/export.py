"""Export bundle (S7), isolated block execution (S12), fallback export
and export health / scope (M13).

A bundle is a dict of lazily defined DataFrames.  Running it is the only
driver-side loop: one action per block, each guarded so that a failing block
is reported instead of failing the export.  No block's rows pass through the
driver; blocks are written by the executors (``write_bundle``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.config import ReportConfig, normalize_days, raw_limit
from clickloom.functions.sanitize import sanitize_frame
from clickloom.operators import ads as A
from clickloom.operators import journeys as J
from clickloom.operators import reports as R
from clickloom.operators.filters import valid_events

JSON_COLUMNS = ("properties", "conversion_attribution", "attribution", "journey", "pages")

HEALTH_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("ok", T.BooleanType()),
    T.StructField("rows", T.LongType()), T.StructField("error", T.StringType()),
])


def build_bundle(ev: DataFrame, ads: DataFrame | None, cfg: ReportConfig) -> dict[str, DataFrame]:
    """The live export's blocks (plus journey segmentation) as lazy frames
    over one shared base (valid events of the period)."""
    days = normalize_days(cfg.days)
    base = valid_events(ev, cfg.as_of, days, cfg.control_pattern)
    b: dict[str, DataFrame] = {
        "exclusion_audit": R.exclusion_audit(ev, cfg.as_of, days, cfg.control_pattern),
        "overview": R.overview(base),
        "funnel_unique_visitors": R.funnel_unique_visitors(base),
        "event_catalog": R.event_catalog(base),
        "campaigns": R.campaigns(base),
        "session_journeys": R.session_journeys(base),
        "conversion_attribution": R.conversion_report(base),
        "daily_series": R.daily_series(base),
        "pages": R.pages(base),
        "devices": R.devices(base),
        "products": R.products(base),
        "cta_performance": R.cta_performance(base),
        "sections": R.sections(base),
        "web_performance": R.web_performance(base),
        "identity_integrity": R.identity_integrity(base),
        "time_to_conversion": R.time_to_conversion(base),
        "creative_taxonomy": R.creative_taxonomy(base),
        "raw_events": R.raw_events(base, raw_limit(cfg.raw_limit)).drop("p"),
        "page_types": J.page_types(base),
        "journey_types": J.journey_types(base),
        "visitor_overlap": J.visitor_overlap(base),
        "stage_flow": J.stage_flow(base),
    }
    if ads is not None and cfg.ads_as_of is not None:
        b["meta_overview"] = A.ads_overview(ads, cfg.ads_as_of, cfg.ads_days)
        b["meta_campaigns"] = A.ads_campaigns(ads, cfg.ads_as_of, cfg.ads_days)
        b["meta_daily"] = A.ads_daily(ads, cfg.ads_as_of, cfg.ads_days)
    return {name: sanitized(block) for name, block in b.items()}


def sanitized(block: DataFrame) -> DataFrame:
    """Every column of a block by its name, JSON documents in depth."""
    return sanitize_frame(block, [c for c, t in block.dtypes if t == "string" and c in JSON_COLUMNS])


def fallback_bundle(ev: DataFrame, cfg: ReportConfig) -> dict[str, DataFrame]:
    """The minimal export used when the rich one fails."""
    days = normalize_days(cfg.days)
    base = valid_events(ev, cfg.as_of, days, cfg.control_pattern)
    blocks = {
        "overview_basic": R.overview_basic(base),
        "event_catalog": R.event_catalog(base),
        "raw_events": R.raw_events(base, raw_limit(cfg.raw_limit)).drop("p"),
    }
    return {name: sanitized(block) for name, block in blocks.items()}


def run_isolated(spark: SparkSession, bundle: dict[str, DataFrame | Callable[[], DataFrame]],
                 action: Callable[[str, DataFrame], int] | None = None) -> DataFrame:
    """Execute every block independently; a failure is recorded
    (name, ok=false, rows=0, error) and the others continue.  A block may be
    a DataFrame or a zero-argument builder (then analysis errors raised while
    building it are isolated too).  ``action`` defaults to evaluating every
    column of the block on the executors, so an expression that fails is
    found."""
    act = action or (lambda name, df: observed_rows(df, lambda d: d.write.format("noop").mode("overwrite").save()))
    health = []
    for name, block in bundle.items():
        try:
            df = block() if callable(block) else block
            n = int(act(name, df))
            health.append((name, True, n, None))
        except Exception as e:  # noqa: BLE001 - isolation is the point
            health.append((name, False, 0, f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(health, HEALTH_SCHEMA)


def observed_rows(df: DataFrame, write: Callable[[DataFrame], None]) -> int:
    """Rows that ``write`` wrote, counted on the way."""
    seen = Observation()
    write(df.observe(seen, F.count(F.lit(1)).alias("n")))
    return int(seen.get["n"])


def write_bundle(spark: SparkSession, bundle: dict[str, DataFrame], path: str, mode: str = "overwrite") -> DataFrame:
    """Write each block as JSON under ``path/<block>`` (executors write; the
    driver only sees the health table, which is written too)."""
    def act(name: str, df: DataFrame) -> int:
        return observed_rows(df, lambda d: d.write.mode(mode).json(f"{path.rstrip('/')}/{name}"))

    health = run_isolated(spark, bundle, act)
    health.write.mode(mode).json(f"{path.rstrip('/')}/_export_health")
    return health


def export_or_fallback(spark: SparkSession, ev: DataFrame, ads: DataFrame | None, cfg: ReportConfig, path: str) -> DataFrame:
    """The full export under ``path``; where it cannot be built or written, the
    fallback blocks under ``path/_fallback``.  Returns the health table; after a
    fallback it has a row ``full_export`` with the error.  A single failing
    block is isolated by ``write_bundle`` and needs no fallback."""
    try:
        return write_bundle(spark, build_bundle(ev, ads, cfg), path)
    except Exception as e:  # noqa: BLE001 - whatever stops the full export
        failed = spark.createDataFrame([("full_export", False, 0, f"{type(e).__name__}: {e}")], HEALTH_SCHEMA)
    return failed.unionByName(write_bundle(spark, fallback_bundle(ev, cfg), f"{path.rstrip('/')}/_fallback"))


def export_scope(health: DataFrame, overview: DataFrame, limit: int | None) -> DataFrame:
    """Mode (full / partial), block counts, raw-dump size and whether the
    raw limit was reached (valid events in the period exceed the dump)."""
    h = health.agg(
        F.count_if("ok").alias("complete_query_blocks"),
        F.count_if(~F.col("ok")).alias("failed_query_blocks"),
        F.max(F.when(F.col("name") == "raw_events", F.col("rows"))).alias("raw_events_included"),
    )
    o = overview.select(F.col("total_events"))
    from clickloom.functions.agg import combine_rows

    j = combine_rows(h, o)
    return j.select(
        F.when(F.col("failed_query_blocks") == 0, "full").otherwise("partial_with_isolated_failures").alias("mode"),
        "complete_query_blocks", "failed_query_blocks",
        F.lit(limit).cast("int").alias("raw_event_limit"),
        F.coalesce("raw_events_included", F.lit(0)).cast("bigint").alias("raw_events_included"),
        (F.col("total_events") > F.coalesce("raw_events_included", F.lit(0))).alias("raw_event_limit_reached"),
    )
