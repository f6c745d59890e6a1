"""Structured Streaming ingest (ST1-ST4): JSON bodies arriving as files ->
validate -> dead letters -> dedupe -> classify -> attribute -> append.

The micro-batch body (``process_batch``) is plain batch code from the library,
so a stream and a batch run of the same rows give the same table.

Exactly once: every micro-batch has a tag (query id and epoch).  It writes its
target partition (event_date, batch=tag) and its dead letters by overwriting
them, asks the seen-id index (``seen.SeenIds``) for keys of *other* tags only,
and adds its own keys after the target is written.  So a batch that runs again
after a failure at any point gives the same rows once.  What it reads of the
past are the index buckets of its own keys and the attribution look-back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from clickloom.config import ATTRIBUTION_LOOKBACK_DAYS, CONVERSION_EVENTS, UUID_PATTERN
from clickloom.functions.json import nz, prop, with_props
from clickloom.operators.attribution import attribute_conversions, stamp_attribution
from clickloom.operators.classify import bag_merge, classify_traffic, dedupe_shopify, json_bag
from clickloom.session import TABLE_CODEC, ensure_checkpoint_dir
from clickloom.sources.events import BODY_READ_SCHEMA, accepted_events, check_events, content_hash, first_copies, rejected_events
from clickloom.streaming.seen import BUCKETS, FANIN, SeenIds


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def stamp_classification(df: DataFrame, classified_at: str, control_pattern: str | None = None) -> DataFrame:
    """Classify new rows and stamp the result into their property bag
    (non-production also test, internal also internal_traffic)."""
    c = classify_traffic(df, control_pattern)
    cls = F.col("traffic_classification")
    updates = {
        "traffic_classification": cls.cast("variant"),
        "traffic_classification_reason": F.col("traffic_classification_reason").cast("variant"),
        "traffic_classification_version": F.parse_json(F.lit("1")),
        "traffic_classified_at": F.lit(classified_at).cast("variant"),
        "test": F.when(cls != "production", F.parse_json(F.lit("true"))),
        "internal_traffic": F.when(cls == "internal", F.parse_json(F.lit("true"))),
    }
    c, old = c.withColumn("_bag", json_bag(F.col("properties"))), F.col("_bag")  # a column of its own: read once
    for k in ("test", "internal_traffic"):
        updates[k] = F.coalesce(updates[k], old[k])
    return c.withColumn("properties", bag_merge(old, updates)).drop(
        "p", "_bag", "traffic_classification", "traffic_classification_reason")


def known_keys(rows: DataFrame) -> DataFrame:
    """The keys (column ``key``) that must be stored once: event ids and shop ids."""
    keys = F.array(_event_key(), _shop_key())
    return rows.select(F.explode(keys).alias("key")).where(F.col("key").isNotNull())


def _event_key():
    return F.concat(F.lit("e:"), F.col("event_id"))


def _shop_key():
    return F.concat(F.lit("s:"), nz(prop("shopify_event_id")))


def drop_seen(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows (with ``p``) whose event id and shop id are not among ``seen``, once per shop id."""
    rows = rows.join(seen.select(F.col("key").alias("_e")), _event_key() == F.col("_e"), "left_anti")
    own = F.coalesce(_shop_key(), _event_key())  # rows without a shop id are spread by their own id, which is not seen
    fresh = rows.join(seen.select(F.col("key").alias("_s")), own == F.col("_s"), "left_anti")
    return dedupe_shopify(fresh, ("received_at", "event_id"))


def process_batch(spark: SparkSession, batch: DataFrame, epoch_id: int, target: str, dead_letter: str,
                  arrival_col: str, id_pattern: str, control_pattern: str | None, lookback_days: int,
                  keep=(), context: dict | None = None, run: str = "batch", buckets: int = BUCKETS) -> None:
    """One micro-batch of bodies -> target table (append) + dead letters.

    The target is the silver table: it stores the parsed property struct
    ``p`` next to the JSON text, so history look-ups (test flags, attribution
    candidates) read pruned nested columns instead of re-parsing JSON.  Bodies
    are parsed once for the rejects and once for the accepted rows; what later
    steps need is stored compressed and narrow (``Steps``)."""
    ensure_checkpoint_dir(spark)
    tag, index = f"{run}-{epoch_id}", SeenIds(spark, f"{target}/_seen", buckets)
    has_history = _exists(spark, target)
    history = spark.read.parquet(target).where(F.col("batch") != tag).drop("batch") if has_history else None
    if has_history and not index.exists():  # a target from before the index
        index.add(known_keys(history), "history")
    elif epoch_id % FANIN == 0:
        index.compact()

    arrivals = batch.agg(F.max(arrival_col).alias("last"), F.min(arrival_col).alias("first")).first()
    if arrivals["last"] is None:
        return
    checked = check_events(batch, arrival_col, id_pattern)
    (rejected_events(checked, arrival_col, keep).withColumn("epoch", F.lit(int(epoch_id)))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", TABLE_CODEC)
     .partitionBy("epoch").parquet(dead_letter))
    steps = Steps(spark, f"{target.rstrip('/')}_steps/{tag}")
    try:
        _store_batch(steps, checked, arrivals, history, index, target, tag, arrival_col, id_pattern, control_pattern, lookback_days, keep, context)
    finally:
        steps.drop()


class Steps:
    """Finished steps of a micro-batch as compressed tables in the shared folder;
    they go when no later step reads them, at the latest with the batch."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def put(self, name: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").option("compression", TABLE_CODEC).parquet(f"{self.path}/{name}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str | None = None) -> None:
        """One step's table, or all of them."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path if name is None else f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def repeated_rows(rows: DataFrame, index: SeenIds, tag: str, steps: Steps) -> DataFrame:
    """The rows (column ``_row``) of a batch that are not to be stored: copies of
    an event id or shop id inside the batch, and ids that other batches stored.
    Rows are compared by ids, arrival and content hash alone."""
    narrow = rows.select("_row", "_hash", "event_id", "received_at", F.struct(prop("shopify_event_id").alias("shopify_event_id")).alias("p"))
    first = steps.put("first", first_copies(narrow, content=F.struct("_hash", "_row")))
    fresh = drop_seen(first, index.seen(known_keys(first), tag))
    return rows.select("_row").join(fresh.select("_row"), "_row", "left_anti")


def _store_batch(steps: Steps, checked: DataFrame, arrivals, history: DataFrame | None, index: SeenIds, target: str, tag: str,
                 arrival_col: str, id_pattern: str, control_pattern: str | None, lookback_days: int, keep, context) -> None:
    """The accepted rows of a micro-batch -> target table and index."""
    accepted = accepted_events(checked, arrival_col, keep, context=context)
    rows = with_props(accepted.withColumn("_hash", content_hash(accepted))).withColumn("_row", F.monotonically_increasing_id())
    rows = steps.put("accepted", rows)
    repeated = steps.put("repeated", repeated_rows(rows, index, tag, steps))
    fresh = rows.join(repeated, "_row", "left_anti").drop("_row", "_hash")
    fresh = steps.put("fresh", with_props(stamp_classification(fresh, str(arrivals["last"]), control_pattern)))
    for done in ("accepted", "first", "repeated"):  # ``fresh`` is all that is read from here on
        steps.drop(done)
    # ST4: attribution against stored history of the look-back plus this batch.
    if history is not None:
        # the look-back of the batch's earliest row: a later row must not narrow it
        since = F.lit(arrivals["first"]).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(lookback_days)} DAYS")
        recent = history.where((F.col("received_at") >= since) & (F.col("event_date") >= F.to_date(since)))
        hist = recent.select(*fresh.columns).unionByName(fresh)  # only the look-back's partitions are read
    else:
        hist = fresh
    resolved = attribute_conversions(fresh, lookback_days=lookback_days, id_pattern=id_pattern, history=hist,
                                     store=lambda rows: steps.put("candidates", rows))
    # Only conversions get a record (event ids are unique here): the other rows move nowhere.
    columns, converted = [c for c in fresh.columns if c != "p"], F.coalesce(F.col("event_name").isin(*CONVERSION_EVENTS), F.lit(False))
    stamped = stamp_attribution(fresh.where(converted).drop("p"), resolved).select(*columns)
    out = stamped.unionByName(fresh.where(~converted).select(*columns)).withColumn("event_date", F.to_date("received_at"))
    out = with_props(out.sortWithinPartitions("event_date"))  # put in order without ``p``
    (out.withColumn("batch", F.lit(tag))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", TABLE_CODEC)
     .partitionBy("event_date", "batch").parquet(target))
    index.add(known_keys(fresh), tag)


def stream_ingest(spark: SparkSession, source: str, target: str, dead_letter: str, checkpoint: str,
                  id_pattern: str = UUID_PATTERN, control_pattern: str | None = None,
                  lookback_days: int = ATTRIBUTION_LOOKBACK_DAYS, extra_schema: T.StructType | None = None,
                  arrival_col: str | None = None, keep=(), available_now: bool = True,
                  max_files_per_trigger: int | None = None, max_bytes_per_trigger: str | None = None,
                  context: dict | None = None, buckets: int = BUCKETS) -> StreamingQuery:
    """ST1/ST2: continuous JSON ingest.  ``arrival_col`` names a body field with
    the arrival time (tests); by default the processing time is used.
    ``max_bytes_per_trigger`` sizes micro-batches whatever the files' sizes."""
    schema = T.StructType(BODY_READ_SCHEMA.fields + (list(extra_schema.fields) if extra_schema else []))
    reader = spark.readStream.schema(schema).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", "_corrupt_record")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    if max_bytes_per_trigger:
        reader = reader.option("maxBytesPerTrigger", max_bytes_per_trigger)
    src = reader.json(source)
    if arrival_col:
        src = src.withColumn("arrival", F.col(arrival_col).cast("timestamp_ntz"))
    else:
        src = src.withColumn("arrival", F.current_timestamp().cast("timestamp_ntz"))

    def _batch(df: DataFrame, epoch_id: int) -> None:
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "stream"
        process_batch(spark, df, epoch_id, target, dead_letter, "arrival", id_pattern, control_pattern,
                      lookback_days, keep, context, run, buckets)

    w = src.writeStream.foreachBatch(_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
