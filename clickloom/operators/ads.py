"""Ad snapshot reports (R24-R26) with derived metrics (M3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.agg import top_k, zsum
from clickloom.functions.stats import ads_metrics_cols


def _money_sum(c: str):
    """Money columns are DECIMAL: the sum is exact (independent of summation
    order across tasks) and reported as a double."""
    return F.coalesce(F.sum(F.col(c).cast("decimal(20,6)")), F.lit(0)).cast("double").alias(c)


def ads_period(ads: DataFrame, as_of_date, days: int) -> DataFrame:
    """date_start >= as_of_date - days (partition pruning on date_start)."""
    return ads.where(F.col("date_start") >= F.date_sub(F.lit(str(as_of_date)).cast("date"), int(days)))


def with_ads_metrics(df: DataFrame) -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in ads_metrics_cols().items()])


def ads_overview(ads: DataFrame, as_of_date, days: int) -> DataFrame:
    """Global totals of the period."""
    a = ads_period(ads, as_of_date, days)
    out = a.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("date_start").alias("first_date"),
        F.max("date_start").alias("latest_date"),
        F.count_distinct("account_id").alias("accounts"),
        F.count_distinct("campaign_id").alias("campaigns"),
        F.count_distinct("adset_id").alias("adsets"),
        F.count_distinct("ad_id").alias("ads"),
        _money_sum("spend"),
        zsum(F.col("impressions")).cast("bigint").alias("impressions"),
        zsum(F.col("reach")).cast("bigint").alias("reach"),
        zsum(F.col("clicks")).cast("bigint").alias("clicks"),
        zsum(F.col("landing_page_views")).cast("bigint").alias("landing_page_views"),
        F.coalesce(F.sum("purchases"), F.lit(0.0)).alias("purchases"),
        _money_sum("purchase_value"),
    )
    return with_ads_metrics(out)


def ads_campaigns(ads: DataFrame, as_of_date, days: int) -> DataFrame:
    """By campaign id + name; order spend desc."""
    a = ads_period(ads, as_of_date, days)
    out = a.groupBy("campaign_id", "campaign_name").agg(
        F.count_distinct("adset_id").alias("adsets"),
        F.count_distinct("ad_id").alias("ads"),
        _money_sum("spend"),
        *[zsum(F.col(c)).cast("bigint").alias(c) for c in (
            "impressions", "reach", "clicks", "unique_clicks", "landing_page_views", "add_to_cart",
            "initiate_checkout")],
        F.coalesce(F.sum("purchases"), F.lit(0.0)).alias("purchases"),
        _money_sum("purchase_value"),
        F.max("currency").alias("currency"),
        F.max("ingested_at").alias("latest_ingested_at"),
    )
    return with_ads_metrics(out).orderBy(F.desc("spend"), F.desc("impressions"))


ADS_DAILY_COLUMNS = (
    "date_start", "account_id", "campaign_id", "campaign_name", "adset_id", "adset_name", "ad_id", "ad_name",
    "creative_id", "spend", "impressions", "reach", "frequency", "clicks", "unique_clicks", "landing_page_views",
    "add_to_cart", "initiate_checkout", "purchases", "purchase_value", "currency", "ingested_at",
)


def ads_daily(ads: DataFrame, as_of_date, days: int, limit: int | None = None) -> DataFrame:
    """Daily ad rows, date ascending then spend descending."""
    a = ads_period(ads, as_of_date, days).select(*ADS_DAILY_COLUMNS) \
        .withColumn("spend", F.col("spend").cast("double")).withColumn("purchase_value", F.col("purchase_value").cast("double"))
    a = top_k(a, [F.asc("date_start"), F.desc("spend"), F.asc("account_id"), F.asc("ad_id")], limit)
    return with_ads_metrics(a)
