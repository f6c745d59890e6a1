"""Fixture projection: the driver's generic tables mapped onto the event-fact and
ad-snapshot shapes (FIXTURES.md A1-A3).

The row-level projection is one SQL text that both Spark SQL and DuckDB run
unchanged (only ``||``, ``concat_ws``, ``regexp_extract``, ``CASE`` and casts are
used, which behave the same in both).  Everything *after* the projection -
sessionization and every report - is library code on DataFrames.

Scale notes: events join all pages on page_id, a plain shuffle or size-checked
broadcast join, as Spark finds the page side; the events
side is scanned once with only five columns read.  Joins, sessions and the
deal to dates move narrow rows; the property bag and all other wide columns are
made after the last shuffle, in the task that writes them.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.session import TABLE_CODEC, ensure_checkpoint_dir

FX_AS_OF = "2024-01-31 00:00:00"
FX_ADS_AS_OF = "2001-11-05"
FX_SESSION_GAP_SECONDS = 12 * 3600
# Control-surface pattern used on fixtures (one synthetic host of `pages`).
FX_CONTROL_PATTERN = r"^https?://ads-track\.example\.org(/|$)"


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


def _kv(key: str, value_sql: str, cond: str | None = None) -> str:
    """JSON member with a string value; NULL (dropped by concat_ws) if cond fails."""
    body = f"""'"{key}":"' || {value_sql} || '"'"""
    return f"CASE WHEN {cond} THEN {body} END" if cond else body


def _kraw(key: str, json_sql: str, cond: str | None = None) -> str:
    body = f"""'"{key}":' || {json_sql}"""
    return f"CASE WHEN {cond} THEN {body} END" if cond else body


def _item(i: int) -> str:
    m = f"(k + {i})"
    return (
        f"""'{{"product_id":"p_' || {_s(m + ' % 5')} || '","variant_id":"v_' || {_s(m + ' % 3')}"""
        f""" || '","product_title":"Product ' || {_s(m + ' % 5')} || '","variant_title":"V' || {_s(m + ' % 3')}"""
        f""" || '","quantity":"' || {_s('1 + ' + m + ' % 3')} || '","price":"' || {_s('10 + (' + m + ' % 5) * 5')} || '.5"}}'"""
    )


def _properties_sql() -> str:
    parts = [
        _kv("test", "'true'", "k = 99"),
        _kv("internal_traffic", "'true'", "k = 98"),
        _kv("traffic_classification",
            "CASE k WHEN 97 THEN 'bot' WHEN 96 THEN 'preview' WHEN 95 THEN 'qa' ELSE 'production' END"),
        _kv("traffic_classification_reason",
            "CASE k WHEN 97 THEN 'known_bot_user_agent' WHEN 96 THEN 'shopify_theme_preview' "
            "WHEN 95 THEN 'test_campaign' ELSE 'production_default' END"),
        _kv("session_storage_version", _s("1 + k % 3"), "k % 10 <> 0"),
        _kv("checkout_id", "'co_' || " + _s("uid % 50")),
        _kv("order_id", "'or_' || " + _s("uid % 40"), "en <> 'page_view'"),
        _kv("value", f"CASE WHEN k % 10 = 9 THEN 'n/a' ELSE {_s('k')} END"),
        _kv("placement", "'pl_' || " + _s("k % 4")),
        _kv("element_text", "'el_' || " + _s("k % 3")),
        _kv("section_key", "'s_' || " + _s("k % 5"), "k % 3 = 0"),
        _kv("chapter", "'c_' || " + _s("k % 5"), "k % 3 = 1"),
        _kv("section_id", "'i_' || " + _s("k % 5"), "k % 3 = 2"),
        _kv("visible_ms", _s("k * 100")),
        _kv("visible_seconds", _s("k % 60")),
        _kv("max_scroll_depth", _s("(k * 7) % 101")),
        _kv("sections_viewed", _s("k % 8")),
        _kv("quick_exit", "CASE WHEN k % 5 = 0 THEN 'true' ELSE 'false' END"),
        _kv("duration_seconds", _s("k % 90")),
        _kv("rage_click_count", _s("k % 3")),
        _kv("dead_click_count", _s("k % 2")),
        _kv("page_instance_id",
            f"CASE WHEN k % 13 = 0 THEN '' ELSE 'pi_' || {_s('uid')} || '_' || {_s('k % 3')} END"),
        _kv("ttfb_ms", _s("CAST(floor(val * 10) AS BIGINT)")),
        _kv("lcp_ms", f"CASE WHEN k % 17 = 0 THEN 'slow' ELSE {_s('CAST(floor(val * 100) AS BIGINT)')} END"),
        _kv("inp_ms", _s("CAST(floor(val * 7) AS BIGINT)")),
        _kv("cls", "'0.' || lpad(" + _s("k % 25") + ", 2, '0')"),
        _kv("load_ms", _s("CAST(floor(val * 30) AS BIGINT)")),
        _kv("page_type", "CASE k % 6 WHEN 0 THEN 'funnel' WHEN 1 THEN 'sales_page' ELSE '' END", "k % 6 < 3"),
        _kv("journey_type",
            "CASE k % 6 WHEN 0 THEN 'funnel_to_sales' WHEN 1 THEN 'funnel_assisted_sales' ELSE 'direct_to_sales' END",
            "k % 6 < 3"),
        _kraw("checkout_attributes", """'{"ct_journey_type":"jt_' || """ + _s("k % 2") + """ || '"}'""", "k % 6 = 3"),
        _kv("concept", "'cn_' || " + _s("k % 3"), "k % 8 = 0"),
        _kv("hook", "'hk_' || " + _s("k % 2"), "k % 8 = 0"),
        _kv("format", "'fm_' || " + _s("k % 4"), "k % 8 = 0"),
        _kv("angle", "'an_' || " + _s("k % 5"), "k % 16 = 0"),
        _kv("landing_version", "'lv_1'", "k % 24 = 0"),
        _kv("message", "'msg_' || " + _s("k % 6"), "et = 'error'"),
        _kv("filename", "'app_' || " + _s("k % 3") + " || '.js'", "et = 'error'"),
        _kv("kind", "CASE WHEN k % 2 = 0 THEN 'error' ELSE 'unhandledrejection' END", "et = 'error'"),
        _kv("anomaly_type", "CASE WHEN k % 2 = 0 THEN 'rage_click' ELSE 'dead_click' END", "et = 'error' AND k % 4 <> 3"),
        _kv("element_tag", "CASE k % 3 WHEN 0 THEN 'button' WHEN 1 THEN 'a' ELSE 'div' END", "et = 'error'"),
        _kv("shopify_event_id",
            f"CASE WHEN en = 'purchase' THEN 'se_' || {_s('CAST(floor(eid / 2) AS BIGINT)')} ELSE '' END"),
        _kraw("first_touch",
              """'{"utm_source":"ft_src_' || """ + _s("k % 3")
              + """ || '","utm_medium":"ft_med","utm_campaign":"ft_camp_' || """ + _s("k % 5")
              + """ || '","utm_content":"ft_cr_' || """ + _s("k % 2")
              + """ || '","fbclid":"ftfb_' || """ + _s("uid") + """ || '"}'""",
              "k % 4 = 1"),
        _kraw("line_items",
              "CASE WHEN k % 20 = 0 THEN '\"none\"' ELSE CASE k % 4 WHEN 0 THEN '[]' "
              f"WHEN 1 THEN '[' || {_item(0)} || ']' "
              f"WHEN 2 THEN '[' || {_item(0)} || ',' || {_item(1)} || ']' "
              f"ELSE '[' || {_item(0)} || ',' || {_item(1)} || ',' || {_item(2)} || ']' END END"),
        _kv("product_id", "'p_' || " + _s("k % 5"), "k % 7 = 3"),
        _kv("currency", "'BRL'", "k % 2 = 0"),
        _kraw("conversion_attribution",
              """'{"version":"2","visitor_id":"' || """ + _s("uid")
              + """ || '","session_id":"' || CASE WHEN eid % 8 = 2 THEN '' ELSE 'as_' || """ + _s("uid") + """ END"""
              + """ || '","method":"' || CASE eid % 3 WHEN 0 THEN 'checkout_id' WHEN 1 THEN 'same_session'"""
              + """ ELSE 'visitor_latest_attributed_session' END"""
              + """ || '","confidence":"' || CASE eid % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'native' ELSE 'medium' END"""
              + """ || '","cross_session":"' || CASE WHEN eid % 3 = 1 THEN 'false' ELSE 'true' END"""
              + """ || '","checkout_id":"co_' || """ + _s("uid % 50")
              + """ || '","identifier_source":"checkout_id","lookback_days":"30"}'""",
              "en IN ('checkout_started', 'purchase') AND eid % 2 = 0"),
        _kv("visible_ms_before_impression", _s("k * 10"), "en = 'cta_impression'"),
        _kv("seconds_to_click", _s("k % 30"), "en = 'buy_button_click'"),
        _kv("seconds_visible", _s("k % 20"), "en = 'buy_button_click'"),
        _kv("viewport_width", _s("300 + (k % 4) * 100")),
        _kv("viewport_height", "CASE WHEN k % 2 = 0 THEN '600' ELSE '800' END"),
        _kv("effective_connection_type", "CASE WHEN k % 3 = 0 THEN '4g' ELSE '3g' END", "k % 3 < 2"),
        _kv("country", "CASE k % 3 WHEN 0 THEN 'BR' WHEN 1 THEN 'US' ELSE 'PT' END"),
        _kraw("server_context",
              """'{"user_agent":"' || CASE WHEN k = 97 THEN 'Mozilla/5.0 (compatible; Googlebot/2.1)'"""
              """ ELSE 'Mozilla/5.0' END || '"}'"""),
    ]
    return "'{' || concat_ws(',', " + ",\n      ".join(parts) + ") || '}'"


def _esc(sql: str) -> str:
    return sql.replace("{", "{{").replace("}", "}}")


# The parts of the shared projection: the narrow rows that shuffles move ({events}
# and {pages} are table references), and the columns made of them.
FX_ROWS_SQL = """SELECT event_id AS eid, user_id AS uid, ts, event_type AS et, value AS val, (SELECT count(*) FROM {pages}) AS np,
        CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k
      FROM {events}"""

_FX_COLUMNS = """
SELECT
  x.eid AS event_id,
  x.en AS event_name,
  x.uid AS visitor_id,
  x.ts AS client_timestamp,
  x.ts + INTERVAL '2' SECOND AS received_at,
  pg.url AS page_url,
  regexp_extract(pg.url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS page_path,
  't_' || CAST(x.k % 9 AS STRING) AS page_title,
  CASE x.k % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE rf.url END AS referrer,
  CASE x.k % 5 WHEN 0 THEN 'facebook' WHEN 1 THEN 'google' WHEN 2 THEN '' WHEN 3 THEN 'instagram' ELSE NULL END AS utm_source,
  CASE WHEN x.k % 2 = 0 THEN 'cpc' END AS utm_medium,
  CASE WHEN x.k % 7 = 0 THEN NULL ELSE 'camp_' || CAST(x.k % 7 AS STRING) END AS utm_campaign,
  'cr_' || CAST(x.k % 11 AS STRING) AS utm_content,
  CAST(NULL AS STRING) AS utm_term,
  CASE WHEN x.k % 10 = 0 THEN 'fb_' || CAST(x.eid AS STRING) END AS fbclid,
  CASE x.uid % 4 WHEN 0 THEN 'mobile' WHEN 1 THEN 'tablet' WHEN 2 THEN 'desktop' END AS device_type,
  CAST(320 + (x.k % 6) * 200 AS INT) AS screen_width,
  CASE WHEN x.k % 3 = 0 THEN 'pt-BR' ELSE 'en' END AS language,
  x.properties AS properties"""

_FX_BAG = (
    """
FROM (
  SELECT y.*, """
    + _esc(_properties_sql())
    + """ AS properties
  FROM (
    SELECT s.*,
      CASE s.et
        WHEN 'view' THEN CASE WHEN s.k % 20 = 13 THEN 'sales_page_view' WHEN s.k % 20 = 17 THEN 'funnel_view' ELSE 'page_view' END
        WHEN 'click' THEN CASE WHEN s.k % 3 = 0 THEN 'cta_impression' ELSE 'buy_button_click' END
        WHEN 'signup' THEN CASE WHEN s.k % 2 = 0 THEN 'checkout_started' ELSE 'add_to_cart' END
        WHEN 'purchase' THEN 'purchase'
        ELSE CASE s.k % 6 WHEN 0 THEN 'javascript_error' WHEN 1 THEN 'session_summary' WHEN 2 THEN 'page_performance'
          WHEN 3 THEN 'section_view' WHEN 4 THEN 'section_engagement' ELSE 'interaction_anomaly' END
      END AS en
    FROM """
)

# The whole projection in one statement, as DuckDB runs it.
FX_BASE_SQL = (
    _FX_COLUMNS
    + _FX_BAG
    + """(
      """
    + FX_ROWS_SQL
    + """
    ) s
  ) y
) x
LEFT JOIN {pages} pg ON pg.page_id = (x.k + x.eid) % x.np
LEFT JOIN {pages} rf ON rf.page_id = (x.k + x.eid + 7) % x.np
"""
)

# Spark runs it in two steps: narrow rows get their pages and session numbers and
# are dealt to their dates, then every task makes the wide columns of its rows.
FX_PAGED_SQL = """
SELECT s.*, pg.url AS pg_url, rf.url AS rf_url
FROM {rows} s
LEFT JOIN {pages} pg ON pg.page_id = (s.k + s.eid) % s.np
LEFT JOIN {pages} rf ON rf.page_id = (s.k + s.eid + 7) % s.np
"""
FX_WIDE_SQL = (
    _FX_COLUMNS.replace("pg.url", "x.pg_url").replace("rf.url", "x.rf_url")
    + ",\n  x.uid * 1000 + x.session_no AS session_id,\n  x.event_date AS event_date"
    + _FX_BAG
    + """{rows} s
  ) y
) x
"""
)

# DuckDB: the same projection plus sessionization by window (the plain form).
FX_EVENTS_DUCK = (
    "fx_base AS (" + FX_BASE_SQL.format(events="events", pages="pages") + "),\n"
    "fx_lag AS (SELECT *, lag(client_timestamp) OVER (PARTITION BY visitor_id ORDER BY client_timestamp, event_id) AS prev_ts FROM fx_base),\n"
    "fx AS (SELECT event_id, event_name, visitor_id,\n"
    "  CAST(visitor_id * 1000 + SUM(CASE WHEN prev_ts IS NULL OR epoch_us(client_timestamp) - epoch_us(prev_ts) > "
    f"{FX_SESSION_GAP_SECONDS * 1_000_000} THEN 1 ELSE 0 END)\n"
    "    OVER (PARTITION BY visitor_id ORDER BY client_timestamp, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session_id,\n"
    "  client_timestamp, received_at, page_url, page_path, page_title, referrer, utm_source, utm_medium, utm_campaign,\n"
    "  utm_content, utm_term, fbclid, device_type, screen_width, language, properties FROM fx_lag)"
)

EVENT_COLUMNS = (
    "event_id", "event_name", "visitor_id", "session_id", "client_timestamp", "received_at",
    "page_url", "page_path", "page_title", "referrer", "utm_source", "utm_medium", "utm_campaign",
    "utm_content", "utm_term", "fbclid", "device_type", "screen_width", "language", "properties",
)


def _stage_dir(spark: SparkSession, name: str, sf_dir: str) -> str:
    """Folder for a materialised fixture table inside the cluster's shared
    checkpoint folder (``spark.checkpoint.dir``), per application and scale."""
    import hashlib

    root = ensure_checkpoint_dir(spark)
    app = spark.sparkContext.applicationId
    tag = hashlib.sha1(os.path.abspath(sf_dir).encode()).hexdigest()[:12]
    return f"{root.rstrip('/')}/clickloom-fixtures/{app}/{tag}/{name}"


_TABLES: dict = {}


def _materialized(spark: SparkSession, name: str, sf_dir: str, build, fmt: str = "parquet", schema=None,
                  partition_by: str | None = None, order_by: str | None = None, widen=None) -> DataFrame:
    """Write ``build()`` once (a table in the shared folder) and read it back;
    later calls in the same application reuse it.  This is the bronze ->
    silver step that a production pipeline runs once per load.  With
    ``partition_by`` the rows are range-partitioned on ``order_by`` first, so
    each task writes a contiguous time range (few files per partition
    directory).  ``widen`` makes the table's columns of the rows that have been
    dealt and put in the partitions' order, so neither moves or sorts them."""
    path = _stage_dir(spark, name, sf_dir)
    cached = _TABLES.get((path, fmt))
    if cached is not None:  # same application: the table (and its file listing) is reused
        return cached
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_READY")
    fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(marker):
        df = build()
        if partition_by:
            # contiguous time slices, few files per date; their number follows the size (AQE)
            df = df.repartitionByRange(order_by or partition_by)
            if widen is not None:
                df = widen(df.sortWithinPartitions(partition_by))
        w = df.write.mode("overwrite").format(fmt)
        if fmt == "parquet":
            w = w.option("compression", TABLE_CODEC)
        if partition_by:
            w = w.option("partitionOverwriteMode", "static").partitionBy(partition_by)
        w.save(path)
        fs.create(marker, True).close()  # our own completion marker (independent of the committer)
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    table = reader.load(path)
    _TABLES[(path, fmt)] = table
    return table


def materialized_path(spark: SparkSession, name: str, sf_dir: str, build, fmt: str = "json") -> str:
    """Like ``_materialized`` but returns the folder (for file / stream sources);
    its files, text or JSON, are compressed."""
    path = _stage_dir(spark, name, sf_dir)
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path + "/_READY")
    fs = marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(marker):
        build().write.mode("overwrite").format(fmt).option("compression", "gzip").save(path)
        fs.create(marker, True).close()
    return path


def fx_events(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """Event fact table (bronze shape: JSON ``properties`` string)."""
    if materialize:
        return fx_silver(spark, sf_dir).select(*EVENT_COLUMNS)
    return _fx_events_build(spark, sf_dir)


def fx_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver events: the fact table plus the property bag parsed once into the
    struct ``p`` (nested-column pruning reads only the keys a query uses)."""
    from clickloom.functions.json import with_props

    return _materialized(spark, "silver_events", sf_dir, lambda: _fx_rows(spark, sf_dir),
                         partition_by="event_date", order_by="ts",
                         widen=lambda rows: with_props(_fx_wide(rows).select(*EVENT_COLUMNS, "event_date")).select(*EVENT_COLUMNS, "p", "event_date"))


def _fx_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrow rows of the event table: source columns, the two page URLs,
    session number and date of arrival."""
    from clickloom.operators.sessions import sessionize

    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rows = spark.sql(FX_ROWS_SQL, events=events, pages=pages)
    sess = sessionize(rows, visitor="uid", ts="ts", tiebreak="eid", gap_seconds=FX_SESSION_GAP_SECONDS, out="session_no")
    paged = spark.sql(FX_PAGED_SQL, rows=sess, pages=pages)
    return paged.withColumn("event_date", F.to_date(F.col("ts") + F.expr("INTERVAL '2' SECOND")))


def fx_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrow rows as a table, for tables that deal them otherwise than by date."""
    return _materialized(spark, "event_rows", sf_dir, lambda: _fx_rows(spark, sf_dir))


def fx_widened(rows: DataFrame) -> DataFrame:
    """The events of narrow rows, as in the event table."""
    return _fx_wide(rows).select(*EVENT_COLUMNS)


def _fx_wide(rows: DataFrame) -> DataFrame:
    return rows.sparkSession.sql(FX_WIDE_SQL, rows=rows)


def _fx_events_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx_widened(_fx_rows(spark, sf_dir))


# Ad snapshot rows (before upsert), from lineitem x part: the columns of a row of
# both, and the one statement that DuckDB runs.
_FX_ADS_COLUMNS = """
SELECT
  CAST(l.l_suppkey % 5 AS STRING) AS account_id,
  CAST(l.l_shipdate AS DATE) AS date_start,
  p.p_brand AS campaign_id,
  'Campaign ' || p.p_brand AS campaign_name,
  p.p_type AS adset_id,
  'Adset ' || p.p_type AS adset_name,
  CAST(l.l_partkey % 200 AS STRING) AS ad_id,
  'Ad ' || CAST(l.l_partkey % 200 AS STRING) AS ad_name,
  'cr_' || CAST(l.l_partkey % 11 AS STRING) AS creative_id,
  CAST(l.l_extendedprice * l.l_discount AS DECIMAL(20,6)) AS spend,
  CAST(l.l_quantity * 100 AS BIGINT) AS impressions,
  CAST(l.l_quantity * 80 AS BIGINT) AS reach,
  1.25 AS frequency,
  CAST(l.l_quantity * 5 AS BIGINT) AS clicks,
  CAST(l.l_quantity * 4 AS BIGINT) AS unique_clicks,
  CAST(l.l_quantity * 3 AS BIGINT) AS landing_page_views,
  CAST(l.l_quantity AS BIGINT) % 7 AS add_to_cart,
  CAST(l.l_quantity AS BIGINT) % 5 AS initiate_checkout,
  CAST(CAST(l.l_quantity AS BIGINT) % 3 AS DOUBLE) AS purchases,
  CAST(l.l_extendedprice * l.l_tax AS DECIMAL(20,6)) AS purchase_value,
  'BRL' AS currency,
  l.l_orderkey * 10 + l.l_linenumber AS ingested_seq,
  l.l_shipdate + INTERVAL '1' DAY AS ingested_at
"""
FX_ADS_RAW_SQL = _FX_ADS_COLUMNS + """FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey
"""

# Spark moves what an ad row is made of; the wide columns are made last.
FX_ADS_NARROW_SQL = """
SELECT
  l.l_suppkey % 5 AS account, CAST(l.l_shipdate AS DATE) AS day, l.l_partkey % 200 AS ad,
  l.l_shipdate + INTERVAL '1' DAY AS ingested_at, l.l_orderkey * 10 + l.l_linenumber AS ingested_seq,
  l.l_partkey, l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax
FROM {lineitem} l
"""
_FX_ADS_WIDE = [line.strip().rstrip(",") for line in _FX_ADS_COLUMNS.split("SELECT")[1]
                .replace("CAST(l.l_suppkey % 5 AS STRING)", "CAST(l.account AS STRING)")
                .replace("CAST(l.l_shipdate AS DATE)", "l.day")
                .replace("l.l_orderkey * 10 + l.l_linenumber", "l.ingested_seq")
                .replace("l.l_shipdate + INTERVAL '1' DAY", "l.ingested_at").strip().splitlines()]

FX_ADS_DUCK = (
    "fx_ads_raw AS (" + FX_ADS_RAW_SQL.format(lineitem="lineitem", part="part") + "),\n"
    "fx_ads AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY account_id, date_start, ad_id "
    "ORDER BY ingested_at DESC, ingested_seq DESC) AS rn FROM fx_ads_raw) WHERE rn = 1)"
)


def fx_ads_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return spark.sql(FX_ADS_RAW_SQL, lineitem=lineitem, part=part)


def fx_ads_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rows of ``fx_ads_raw`` are made of, without their part's columns
    (parts are looked up where rows are widened)."""
    return spark.sql(FX_ADS_NARROW_SQL, lineitem=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def ads_posted(rows: str) -> Column:
    """An array of narrow rows with ``p_brand`` and ``p_type``, widened to those of ``fx_ads_raw``."""
    fields = [f"{e.replace('p.p_', 'l.p_')} AS {n}" for e, n in (c.rsplit(" AS ", 1) for c in _FX_ADS_WIDE)]
    return F.expr(f"transform({rows}, l -> struct({', '.join(fields)}))")


def fx_ads(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """Ad snapshot table after the latest-wins upsert of all raw rows.  Rows go
    through the upsert narrow; the rows that are left get their part's names."""
    from clickloom.sources.ads import upsert_latest

    def build():
        part = spark.read.parquet(f"{sf_dir}/part.parquet")
        raw = fx_ads_narrow(spark, sf_dir).join(part.select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi")
        latest = upsert_latest(None, raw, keys=("account", "day", "ad"), order=("ingested_at", "ingested_seq"))
        named = part.groupBy("p_partkey").agg(F.max(F.struct("p_brand", "p_type")).alias("_p")).select("p_partkey", "_p.*")
        columns = [f"{c} " for c in _FX_ADS_WIDE]
        rows = spark.sql("SELECT " + ", ".join(columns) + "FROM {l} l JOIN {p} p ON p.p_partkey = l.l_partkey", l=latest, p=named)
        first = ("account_id", "date_start", "ad_id")
        return rows.select(*first, *[c for c in rows.columns if c not in first])

    return _materialized(spark, "ads", sf_dir, build) if materialize else build()
