"""Ad snapshot sources: read (S3), normalise + ingest (S4 / X-A), upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.config import AD_ACTION_FALLBACKS
from clickloom.session import ensure_checkpoint_dir

ADS_COLUMNS = (
    "account_id", "date_start", "campaign_id", "campaign_name", "adset_id", "adset_name", "ad_id",
    "ad_name", "creative_id", "spend", "impressions", "reach", "frequency", "clicks", "unique_clicks",
    "landing_page_views", "add_to_cart", "initiate_checkout", "purchases", "purchase_value", "currency",
)

ACTION = T.StructType([T.StructField("action_type", T.StringType()), T.StructField("value", T.StringType())])

# Raw ad row as posted: every field may be a string or a number, so all leaves
# are read as text and converted by column expressions.
RAW_AD_ROW = T.StructType(
    [T.StructField(c, T.StringType()) for c in ADS_COLUMNS]
    + [T.StructField("actions", T.ArrayType(ACTION))]
)


def read_ads(spark, path: str, as_of_date=None, days: int | None = None) -> DataFrame:
    """Typed scan of the snapshot table, partitioned by ``date_start`` so the
    period predicate prunes partitions."""
    df = spark.read.parquet(path)
    if as_of_date is not None and days is not None:
        df = df.where(F.col("date_start") >= F.date_sub(F.lit(as_of_date).cast("date"), int(days)))
    return df


def _text(c: Column, n: int = 512) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def _number(c: Column) -> Column:
    # JS Number(): '' -> 0, non-numeric -> NaN -> 0, +-Infinity -> 0.
    v = (F.trim(c)).try_cast("double")
    v = F.when(F.trim(c) == "", F.lit(0.0)).otherwise(v)
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v)


def _integer(c: Column) -> Column:
    # max(0, round half toward +inf)
    return F.greatest(F.lit(0), F.floor(c + F.lit(0.5))).cast("bigint")


def _action_value(actions: Column, candidates) -> Column:
    cand = F.array(*[F.lit(x) for x in candidates])
    hits = F.filter(actions, lambda a: F.array_contains(cand, F.trim(a["action_type"])))
    return F.coalesce(_number(F.get(hits, 0)["value"]), F.lit(0.0))


def normalize_ads(raw_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``normalized_ads`` as (accepted, rejected)."""
    out = normalized_ads(raw_rows)
    return out.where("accepted").drop("accepted"), out.where("not accepted").drop("accepted")


def normalized_ads(raw_rows: DataFrame) -> DataFrame:
    """Normalise raw ad rows (one row per posted object, columns as text plus
    ``actions`` array) in one projection; ``accepted`` is false for rows that
    lack a valid date, campaign id or ad id."""
    r = raw_rows
    date_txt = _text(F.col("date_start"))
    date = F.when(date_txt.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(date_txt, "yyyy-MM-dd"))
    fallback = {}
    for metric, cands in AD_ACTION_FALLBACKS.items():
        own = _number(F.col(metric))
        fallback[metric] = F.when(own != 0, own).otherwise(_action_value(F.col("actions"), cands))
    passthrough = [c for c in r.columns if c not in ADS_COLUMNS and c != "actions"]
    out = r.select(
        *passthrough,
        F.coalesce(_text(F.col("account_id")), F.lit("unknown-account")).alias("account_id"),
        date.alias("date_start"),
        _text(F.col("campaign_id")).alias("campaign_id"),
        _text(F.col("campaign_name")).alias("campaign_name"),
        F.coalesce(_text(F.col("adset_id")), F.lit("unknown-adset")).alias("adset_id"),
        _text(F.col("adset_name")).alias("adset_name"),
        _text(F.col("ad_id")).alias("ad_id"),
        _text(F.col("ad_name")).alias("ad_name"),
        _text(F.col("creative_id")).alias("creative_id"),
        F.greatest(F.lit(0.0), _number(F.col("spend"))).alias("spend"),
        _integer(_number(F.col("impressions"))).alias("impressions"),
        _integer(_number(F.col("reach"))).alias("reach"),
        F.greatest(F.lit(0.0), _number(F.col("frequency"))).alias("frequency"),
        _integer(_number(F.col("clicks"))).alias("clicks"),
        _integer(_number(F.col("unique_clicks"))).alias("unique_clicks"),
        _integer(fallback["landing_page_views"]).alias("landing_page_views"),
        _integer(fallback["add_to_cart"]).alias("add_to_cart"),
        _integer(fallback["initiate_checkout"]).alias("initiate_checkout"),
        F.greatest(F.lit(0.0), fallback["purchases"]).alias("purchases"),
        F.greatest(F.lit(0.0), _number(F.col("purchase_value"))).alias("purchase_value"),
        _text(F.col("currency")).alias("currency"),
        F.col("actions"),
    )
    ok = F.col("date_start").isNotNull() & F.col("campaign_id").isNotNull() & F.col("ad_id").isNotNull()
    return out.withColumn("accepted", ok)


def ingest_ads_json(spark, path: str, extra: T.StructType | None = None) -> tuple[DataFrame, DataFrame]:
    """``ingested_ads`` as (accepted, rejected)."""
    out = ingested_ads(spark, path, extra)
    return out.where("accepted").drop("accepted"), out.where("not accepted").drop("accepted")


def ingested_ads(spark, path: str, extra: T.StructType | None = None) -> DataFrame:
    """``{"rows": [...]}`` documents (one per line) -> normalised rows with
    ``accepted``, in one pass over the documents.

    ``posted`` tells the order in which the rows were posted: by file (change
    time, path), by line and by place in the document.  Lines need no global
    numbering: the offset of a file's split and a row number that grows inside
    the split order them.  ``extra`` names further fields of a row to pass on.
    Documents without rows give nothing.
    """
    row = T.StructType(RAW_AD_ROW.fields + (extra.fields if extra is not None else []))
    body = spark.read.schema(T.StructType([T.StructField("rows", T.ArrayType(row))])).json(path)
    line = F.struct(
        F.col("_metadata.file_modification_time").alias("changed"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = body.select("rows", line.alias("_line"))
    rows = lines.select("_line", F.posexplode("rows").alias("_place", "r"))
    return normalized_ads(rows.select("r.*", F.struct("_line.*", F.col("_place").alias("place")).alias("posted")))


#: The least value of the types that can order rows in ``_latest_numbers``: NULL counts as that.
LOWEST = {**{t: str(-2 ** (n - 1)) for t, n in (("tinyint", 8), ("smallint", 16), ("int", 32), ("bigint", 64))},
          "date": "0001-01-01", "timestamp": "0001-01-01", "timestamp_ntz": "0001-01-01"}


def _latest_numbers(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key the row of the greatest ``order``: by its last column among rows
    that are alike in the others, then by the one before it, and so on.  All
    columns of a group follow the same order over the same rows, so they come
    from one row; as they have a fixed width, Spark keeps them in a hash map and
    sorts nothing."""
    types = dict(rows.dtypes)
    for i in reversed(range(len(order))):
        group = [*keys, *order[:i]]
        rank = F.coalesce(F.col(order[i]), F.lit(LOWEST[types[order[i]]]).cast(types[order[i]]))
        rows = rows.groupBy(*group).agg(*[F.max_by(F.col(c), rank).alias(c) for c in rows.columns if c not in group])
    return rows


def upsert_latest(old: DataFrame | None, new: DataFrame, keys=("account_id", "date_start", "ad_id"),
                  order=("ingested_at",)) -> DataFrame:
    """Latest-wins upsert: the union of the current table and the new rows keeps,
    per key, the row with the greatest ``order``.

    Implemented as an aggregate (``max_by`` over a struct of all columns): the
    map side keeps one row per key before the shuffle, so a hot key costs one
    row per task rather than a whole partition.  Rows of numbers and times alone
    are kept in hash maps by key (``_latest_numbers``); with texts among them
    Spark sorts a task's rows by key first.
    """
    both = new if old is None else old.unionByName(new, allowMissingColumns=True)
    keys = list(keys)
    rest = [c for c in both.columns if c not in keys]
    types, by = dict(both.dtypes), [c for c in order if c not in keys]
    if by and all(types[c] in LOWEST for c in by) and all(types[c] in (*LOWEST, "boolean", "float", "double") for c in rest):
        return _latest_numbers(both, keys, by).select(*keys, *rest)
    agg = both.groupBy(*keys).agg(
        F.max_by(F.struct(*[F.col(c) for c in rest]), F.struct(*[F.col(c) for c in order])).alias("_row")
    )
    return agg.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def upsert_table(spark, path: str, new: DataFrame, ingested_at=None, keys=("account_id", "date_start", "ad_id"),
                 sequence=("posted",), by: str = "date_start") -> None:
    """Merge normalised rows into the table at ``path``, partitioned by ``by``
    (a column that the keys determine; a month where single dates are small):
    the partitions of ``new`` are read, merged (latest wins) and overwritten,
    all others stay untouched.  ``ingested_at`` stamps the rows;
    without it they keep a column of that name, or get the present time.  The
    merged rows are cut from the files they replace by a reliable checkpoint.

    Rows of one key and stamp: the greatest ``sequence`` wins (those of its
    columns that ``new`` has; they are not stored), a new row wins over a
    stored one, and rows that tie in all of it are ordered by their values, so
    the order of rows in ``new`` never matters.
    """
    if ingested_at is not None or "ingested_at" not in new.columns:
        new = new.withColumn("ingested_at", (F.current_timestamp() if ingested_at is None else F.lit(ingested_at)).cast("timestamp_ntz"))
    sequence = [c for c in sequence if c in new.columns]
    values = [c for c in new.columns if c not in (*keys, *sequence, "ingested_at", by)]
    new = new.withColumn("_new", F.lit(True))
    table = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    old = None
    if table.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(table):
        touched = new.select(by).distinct()  # Spark prunes partitions by these at run time
        old = spark.read.parquet(path).join(touched, by, "left_semi").withColumn("_new", F.lit(False))
    merged = upsert_latest(old, new, keys, order=("ingested_at", "_new", *sequence, *values)).drop("_new", *sequence)
    ensure_checkpoint_dir(spark)
    merged = merged.checkpoint(eager=True).hint("rebalance", by)  # few files a partition, large ones split
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
