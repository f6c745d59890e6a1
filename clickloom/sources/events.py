"""Event sources and table maintenance: typed scan (S1), JSON ingest with
validation (S2 / F5), insert-ignore (S5), anti-join on existing shop ids (J11),
archive split (S11).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.config import (
    EVENT_NAME_PATTERN,
    IngestLimits,
    UUID_PATTERN,
)
from clickloom.functions.json import nz, prop, with_props
from clickloom.functions.urls import HINT_PARAMS, optional_text, parse_url_part, with_url_hints

S = T.StringType()
EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", S), T.StructField("event_name", S), T.StructField("visitor_id", S),
    T.StructField("session_id", S), T.StructField("client_timestamp", T.TimestampNTZType()),
    T.StructField("received_at", T.TimestampNTZType()), T.StructField("page_url", S),
    T.StructField("page_path", S), T.StructField("page_title", S), T.StructField("referrer", S),
    T.StructField("utm_source", S), T.StructField("utm_medium", S), T.StructField("utm_campaign", S),
    T.StructField("utm_content", S), T.StructField("utm_term", S), T.StructField("fbclid", S),
    T.StructField("device_type", S), T.StructField("screen_width", T.IntegerType()),
    T.StructField("language", S), T.StructField("properties", S),
])

# Raw request body: every field keeps its JSON type (VARIANT), so a number where
# text is expected, or text where a number is, is told apart without a second parse.
BODY_FIELDS = ("event_id", "event_name", "visitor_id", "session_id", "client_timestamp", "page_url", "page_path",
               "page_title", "referrer", "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term",
               "fbclid", "device_type", "screen_width", "language")
BODY_SCHEMA = T.StructType([T.StructField(f, T.VariantType()) for f in (*BODY_FIELDS, "properties")])
#: Request facts that the server adds to the bag besides version and lag.
CONTEXT_FIELDS = ("origin", "user_agent", "client_hint_platform", "country", "region")
INGESTION_VERSION = 3


def read_events(spark: SparkSession, path: str, as_of=None, days: int | None = None) -> DataFrame:
    """Typed scan; with ``as_of``/``days`` the period predicate is pushed to
    the Parquet scan (and prunes ``date(received_at)`` partitions)."""
    df = spark.read.schema(EVENTS_SCHEMA).parquet(path)
    if as_of is not None and days is not None:
        from clickloom.operators.filters import period_filter

        df = period_filter(df, as_of, days)
    return df


BODY_READ_SCHEMA = T.StructType(BODY_SCHEMA.fields + [T.StructField("_corrupt_record", S)])


def read_bodies(spark: SparkSession, path: str, extra: T.StructType | None = None) -> DataFrame:
    """Newline-delimited JSON request bodies read by the JSON data source: each
    line is parsed once in the scan; malformed lines keep their text in
    ``_corrupt_record``."""
    schema = T.StructType(BODY_READ_SCHEMA.fields + (list(extra.fields) if extra else []))
    return (spark.read.schema(schema).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record").json(path))


def parse_bodies(raw: DataFrame, body_col: str = "body") -> DataFrame:
    """Bodies held as a text column (e.g. a message value) -> body columns."""
    parsed = F.from_json(F.col(body_col), BODY_READ_SCHEMA,
                         {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return raw.withColumn("_body_len", F.length(F.col(body_col))).withColumn("_b", parsed).select(
        "*", *[F.col(f"_b.{f.name}").alias(f.name) for f in BODY_READ_SCHEMA.fields]).drop("_b")


def _is(kind: str, c: Column) -> Column:
    return F.coalesce(F.schema_of_variant(c) == kind, F.lit(False))


def _raw_text(c: Column) -> Column:
    """A field of a rejected body as text: text as it is, the rest as JSON."""
    return F.when(_is("STRING", c), F.try_variant_get(c, "$", "string")).otherwise(F.to_json(c))


def check_events(p: DataFrame, arrival_col: str = "arrival", id_pattern: str = UUID_PATTERN,
                 limits: IngestLimits | None = None) -> DataFrame:
    """the typed fields of each body (prefix ``_t_``), its property bag as a
    map ``_bag`` and ``reject_reason`` (NULL: accepted).

    A field counts as text only if the body has a JSON string there, so a
    numeric ``client_timestamp`` is no time (arrival is taken), a width in
    quotes is no width, and a bag that is not an object is empty."""
    lim = limits or IngestLimits()
    within = lambda c, most: F.lit(True) if most is None else c <= most
    if lim.body is not None and "_body_len" not in p.columns:  # re-serialised size (whitespace-insensitive)
        p = p.withColumn("_body_len", F.length(F.to_json(F.struct(*[F.col(f) for f in (*BODY_FIELDS, "properties")]))))
    text = {f"_t_{f}": F.when(_is("STRING", F.col(f)), F.try_variant_get(F.col(f), "$", "string")) for f in BODY_FIELDS if f != "screen_width"}
    width = F.try_variant_get(F.col("screen_width"), "$", "double")
    number = F.schema_of_variant("screen_width").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    whole = number & (width == F.floor(width)) & (width >= 0) & within(width, lim.screen_width) & (width < 2**31)
    p = p.withColumns({
        **text,
        "_t_screen_width": F.when(whole, width.cast("int")),
        "_bag": F.coalesce(F.try_variant_get(F.col("properties"), "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")),
    })
    url, stamp = F.col("_t_page_url"), F.col("_t_client_timestamp")
    p = p.withColumn("_proto", parse_url_part(url, "PROTOCOL")).withColumn("_host", parse_url_part(url, "HOST"))
    p = p.withColumn("_ts", F.when(stamp.isNull(), F.col(arrival_col).cast("timestamp")).otherwise(stamp.try_cast("timestamp")))
    ids_ok = F.col("_t_event_id").rlike(id_pattern) & F.col("_t_visitor_id").rlike(id_pattern) & F.col("_t_session_id").rlike(id_pattern)
    url_ok = url.isNotNull() & within(F.length(url), lim.page_url) & F.col("_proto").isNotNull() \
        & (F.col("_host").isNotNull() | (F.lower(F.col("_proto")) == "file"))
    reason = (
        F.when(F.lit(False) if lim.body is None else F.col("_body_len") > lim.body, "payload_too_large")
        .when(F.col("_corrupt_record").isNotNull(), "invalid_json")
        .when(~F.coalesce(ids_ok, F.lit(False)), "invalid_identifiers")
        .when(~F.coalesce(F.col("_t_event_name").rlike(EVENT_NAME_PATTERN), F.lit(False)), "invalid_event_name")
        .when(~F.coalesce(url_ok, F.lit(False)), "invalid_page_url")
        .when(F.col("_ts").isNull(), "invalid_timestamp")
    )
    if lim.properties is not None:
        reason = reason.when(F.length(F.to_json("_bag")) > lim.properties, "properties_too_large")
    return p.withColumn("reject_reason", reason).drop("_proto", "_host")


def accepted_events(checked: DataFrame, arrival_col: str = "arrival", keep=(), limits: IngestLimits | None = None,
                    context: dict[str, Column] | None = None) -> DataFrame:
    """The accepted rows of ``check_events`` in table shape.  The bag gets its
    flags, the hints that the page URL carries and the server's context
    (``context``: request facts by name, NULL where not given), all in one pass
    over the map."""
    lim = limits or IngestLimits()
    text = lambda c: optional_text(F.col(f"_t_{c}"), lim.text.get(c))
    rows = with_url_hints(checked.where(F.col("reject_reason").isNull()), "_t_page_url", "_h")
    received = F.col(arrival_col).cast("timestamp")
    facts = [(context or {}).get(c, F.lit(None).cast("string")).cast("string").alias(c) for c in CONTEXT_FIELDS]
    lag = F.greatest(F.lit(0), F.unix_millis(received) - F.unix_millis("_ts")).alias("client_server_lag_ms")
    server = F.struct(F.lit(INGESTION_VERSION).alias("ingestion_version"), *facts, lag)
    hints = [*HINT_PARAMS, "source"]
    found = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in hints]), F.array(*[F.col(f"_h.{c}") for c in hints])), lambda k, v: v.isNotNull())
    internal = F.lower(F.try_variant_get(F.col("_bag")["internal_traffic"], "$", "string")) == "true"
    true = F.parse_json(F.lit("true"))
    stamps = {
        "internal_traffic": F.when(internal, true),
        "test": F.when(internal, true),
        "url_attribution_hints": F.when(F.col("_h.source").isNotNull(), F.to_variant_object(found)),
        "server_context": F.to_variant_object(server),
    }
    # A column of its own: inside the filter's lambda its expression would run once per entry of the bag.
    rows = rows.withColumn("_stamps", stamp_map(stamps))
    bag = F.map_concat(F.map_filter("_bag", lambda k, v: ~F.map_contains_key("_stamps", k)), F.col("_stamps"))
    return rows.select(
        *keep,
        *[F.col(f"_t_{c}").alias(c) for c in ("event_id", "event_name", "visitor_id", "session_id")],
        F.col("_ts").cast("timestamp_ntz").alias("client_timestamp"),
        F.col(arrival_col).cast("timestamp_ntz").alias("received_at"),
        F.col("_t_page_url").alias("page_url"),
        *[text(c).alias(c) for c in ("page_path", "page_title", "referrer")],
        *[F.coalesce(text(c), F.col(f"_h.{c}")).alias(c)
          for c in ("utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "fbclid")],
        text("device_type").alias("device_type"),
        F.col("_t_screen_width").alias("screen_width"),
        text("language").alias("language"),
        F.to_json(bag).alias("properties"),
    )


def rejected_events(checked: DataFrame, arrival_col: str = "arrival", keep=()) -> DataFrame:
    """The rejected rows of ``check_events``, their fields as text, with reason."""
    return checked.where(F.col("reject_reason").isNotNull()).select(
        *keep, *[_raw_text(F.col(f)).alias(f) for f in (*BODY_FIELDS, "properties")], "_corrupt_record", F.col(arrival_col), "reject_reason")


def stamp_map(stamps: dict[str, Column]) -> Column:
    """The stamps that are not NULL, as a map."""
    names = F.array(*[F.lit(k) for k in stamps])
    return F.map_filter(F.map_from_arrays(names, F.array(*stamps.values())), lambda k, v: v.isNotNull())


def validate_events(p: DataFrame, arrival_col: str = "arrival", id_pattern: str = UUID_PATTERN,
                    keep=(), limits: IngestLimits | None = None,
                    context: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """F5 + normalisation.  ``p`` holds the body fields as VARIANT columns (see
    ``read_bodies`` / ``parse_bodies``) plus the arrival time.  Returns
    (accepted events in table shape, rejects with reason).

    ``limits`` adds the size rejects and text cuts; without it no row is
    rejected for its size and no text is cut."""
    checked = check_events(p, arrival_col, id_pattern, limits)
    return accepted_events(checked, arrival_col, keep, limits, context), rejected_events(checked, arrival_col, keep)


def ingest_events_json(spark: SparkSession, path: str, arrival: Column | None = None,
                       id_pattern: str = UUID_PATTERN) -> tuple[DataFrame, DataFrame]:
    """Read newline-delimited JSON bodies (one event per line) and validate."""
    raw = read_bodies(spark, path)
    raw = raw.withColumn("arrival", arrival if arrival is not None else F.current_timestamp())
    return validate_events(raw, "arrival", id_pattern)


def content_hash(batch: DataFrame) -> Column:
    return F.xxhash64(*[F.col(c) for c, t in batch.dtypes if "map" not in t and "variant" not in t])


def first_copies(batch: DataFrame, key: str = "event_id", content: Column | None = None) -> DataFrame:
    """One row per key: the copy that arrived first, of copies that arrived
    together the one of the least content hash (so a rerun keeps the same).
    ``content`` is that hash where ``batch`` has only some of its columns."""
    order = ([F.col("received_at")] if "received_at" in batch.columns else []) + [content_hash(batch) if content is None else content]
    row = F.struct(*[F.col(c) for c in batch.columns])
    first = batch.groupBy(key).agg(F.min_by(row, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])).alias("_r"))
    return first.select("_r.*")


def insert_ignore(target: DataFrame, batch: DataFrame, key: str = "event_id") -> DataFrame:
    """Rows of ``batch`` whose key is new - first copy within the batch,
    none already in ``target``.  The target side of the anti-join is projected
    to the key only; Spark broadcasts it only under the size threshold."""
    first = first_copies(batch, key)
    return first.join(target.select(key), key, "left_anti")


def anti_existing(target: DataFrame, batch: DataFrame, order=("received_at", "event_id")) -> DataFrame:
    """Drop batch rows whose shop event id already exists in ``target``
    and keep only the first copy per shop id inside the batch."""
    from clickloom.operators.classify import dedupe_shopify

    b = with_props(batch).withColumn("_sid", nz(prop("shopify_event_id")))
    existing = with_props(target).select(nz(prop("shopify_event_id")).alias("_sid")).where(F.col("_sid").isNotNull())
    # rows without a shop id skip the anti-join (no NULL-key partition)
    keyed = b.where(F.col("_sid").isNotNull()).join(existing, "_sid", "left_anti")
    fresh = keyed.unionByName(b.where(F.col("_sid").isNull()))
    return dedupe_shopify(fresh.drop("_sid"), order)


def archive_split(ev: DataFrame, predicate: Column, cutover) -> tuple[DataFrame, DataFrame]:
    """Rows matching ``predicate`` that arrived before ``cutover`` go to the
    archive; the rest remain.  Write the archive (append) and then the
    remainder (overwrite) to complete the move."""
    cut = F.lit(str(cutover)).cast("timestamp_ntz") if not isinstance(cutover, Column) else cutover
    move = F.coalesce(predicate & (F.col("received_at") < cut), F.lit(False))
    return ev.where(move), ev.where(~move)


def archive_record(archived: DataFrame, remaining: DataFrame, predicate: Column, cutover) -> DataFrame:
    """Count record of an archive run (rows archived, matching rows left)."""
    cut = F.lit(str(cutover)).cast("timestamp_ntz")
    a = archived.agg(F.count(F.lit(1)).alias("rows_archived"))
    r = remaining.agg(F.count_if(predicate & (F.col("received_at") < cut)).alias("rows_remaining"))
    from clickloom.functions.agg import combine_rows

    return combine_rows(a, r).withColumn("cutover", cut)


FIXTURE_BODY_EXTRA = T.StructType([T.StructField("_source_event_id", T.LongType()),
                                   T.StructField("_arrival", S),
                                   T.StructField("_headers", T.StructType([T.StructField(c, S) for c in CONTEXT_FIELDS]))])


def fixture_context() -> dict[str, Column]:
    """The request facts that fixture bodies carry beside the event."""
    return {c: F.col(f"_headers.{c}") for c in CONTEXT_FIELDS}


def fixture_bodies(ev: DataFrame) -> DataFrame:
    """JSON request bodies derived from fixture events (ids rendered as UUIDs,
    timestamps as ISO text, a few fields made invalid, wrongly typed or given
    ids in the URL by a fixed rule).  Output: (event_id, body, arrival);
    ``body`` also carries ``_source_event_id``, ``_arrival`` and the request's
    ``_headers`` for the harness."""
    uuid = lambda c, tag: F.format_string("%08x-0000-4000-8000-%012x", F.lit(tag), c)
    kk = F.col("event_id") % 97
    ev = ev.withColumn("_bag", F.parse_json("properties"))  # read once, for the bag and the headers
    body = F.struct(
        F.when(kk == 1, F.lit("not-a-uuid")).otherwise(uuid(F.col("event_id"), 1)).alias("event_id"),
        F.when(kk == 2, F.lit("Bad Name")).otherwise(F.col("event_name")).alias("event_name"),
        uuid(F.col("visitor_id"), 2).alias("visitor_id"),
        uuid(F.col("session_id"), 3).alias("session_id"),
        F.when(kk == 3, F.lit("yesterday").cast("variant")).when(kk == 4, F.lit(None)).when(kk == 7, F.lit(1704067200000).cast("variant"))
        .otherwise(F.date_format(F.col("client_timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").cast("variant")).alias("client_timestamp"),
        F.when(kk == 5, F.lit("no scheme here"))
        .when(kk == 9, F.concat(F.regexp_replace("page_url", "#.*$", ""), F.when(F.col("page_url").contains("?"), "&").otherwise("?"), F.lit("ct_session_id="), uuid(F.col("event_id"), 4)))
        .otherwise(F.col("page_url")).alias("page_url"),
        "page_path", "page_title", "referrer", "utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term",
        "fbclid", "device_type",
        F.when(kk == 8, F.col("screen_width").cast("string").cast("variant")).otherwise(F.col("screen_width").cast("variant")).alias("screen_width"),
        "language",
        F.col("_bag").alias("properties"),
        F.col("event_id").alias("_source_event_id"),
        F.date_format(F.col("received_at"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("_arrival"),
        F.struct(*[F.try_variant_get("_bag", f"$.server_context.{c}", "string").alias(c) for c in CONTEXT_FIELDS]).alias("_headers"),
    )
    return ev.select("event_id", F.to_json(body).alias("body"), F.col("received_at").alias("arrival"))
