"""Weather alerts: bulletin text blocks and the warning RSS feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import ALERT_KEYWORDS, REGIONS
from ..functions.match import alert_type, matching, mentions_any
from ..functions.names import strip_space

RSS_ITEM = "title string, link string, description string, pubDate string"
ORGANIZATION = "India Meteorological Department"


def alert_blocks(
    blocks: DataFrame,
    keywords: list[str] = ALERT_KEYWORDS,
    regions: list[str] = REGIONS,
    min_length: int = 20,
) -> DataFrame:
    """Blocks of at least ``min_length`` characters naming a keyword and a region.

    Adds ``affected``, all named regions, and ``alert_type``, the first keyword; both follow the
    order of their lists.
    """
    text = F.col("text")
    return (
        blocks.filter(
            (F.length(text) >= min_length)
            & mentions_any([text], keywords)
            & mentions_any([text], regions)
        )
        .withColumn("affected", matching(text, regions))
        .withColumn("alert_type", alert_type(text, keywords))
    )


def bulletin_records(
    alerts: DataFrame, day: Column | None = None, ingested_at: Column | None = None
) -> DataFrame:
    """Records from :func:`alert_blocks` rows that carry ``text`` and the bulletin ``url``.

    The id follows from day and text, unless the rows bring a ``record_id`` of their own.
    """
    day = F.date_format(F.current_timestamp(), "yyyyMMdd") if day is None else day
    by_text = F.concat_ws("-", F.lit("imd"), day, F.sha2("text", 256))
    record_id = F.col("record_id") if "record_id" in alerts.columns else by_text
    return alerts.select(
        F.lit("IMD").alias("source"),
        record_id.alias("record_id"),
        day.alias("date"),
        "url",
        F.concat(
            F.lit("IMD Alert: "), "alert_type", F.lit(" — "),
            F.array_join(F.slice("affected", 1, 3), ", "),
        ).alias("title"),
        F.array(F.lit("Weather"), F.lit("Disaster"), F.col("alert_type")).alias("themes"),
        F.array().cast("array<string>").alias("persons"),
        F.array(F.lit(ORGANIZATION)).alias("organizations"),
        F.col("affected").alias("locations"),
        F.lit("-3").alias("tone"),
        (F.current_timestamp() if ingested_at is None else ingested_at).alias(
            "ingestion_timestamp"
        ),
        F.left("text", F.lit(500)).alias("alert_text"),
        "alert_type",
    )


def read_rss(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM).load(path)


def rss_date(pub_date: Column, today: Column) -> Column:
    """``Tue, 17 Mar 2026 …`` as ``20260317``; anything else is today."""
    day = F.try_to_timestamp(F.substring(F.trim(pub_date), 6, 11), F.lit("dd MMM yyyy"))
    return F.coalesce(F.date_format(day, "yyyyMMdd"), today)


def rss_records(
    items: DataFrame,
    feed_url: str,
    regions: list[str] = REGIONS,
    today: Column | None = None,
    ingested_at: Column | None = None,
) -> DataFrame:
    """Records from feed items. The title is required, every other part has a default.

    The id follows from title, link and date, so the same warning on another day is another record.
    """
    today = F.date_format(F.current_timestamp(), "yyyyMMdd") if today is None else today
    named = (
        items.filter(F.col("title").isNotNull())
        .withColumn("title", strip_space(F.col("title")))
        .withColumn("body", F.coalesce(strip_space(F.col("description")), F.lit("")))
    )
    affected = matching(F.concat("title", "body"), regions)
    parts = [F.coalesce(F.trim(c), F.lit("")) for c in ("title", "link", "pubDate")]
    told = F.concat_ws("\n", *parts)
    return named.select(
        F.lit("IMD").alias("source"),
        F.concat(F.lit("imd-rss-"), F.sha2(told, 256)).alias("record_id"),
        rss_date(F.col("pubDate"), today).alias("date"),
        F.coalesce(F.trim("link"), F.lit(feed_url)).alias("url"),
        "title",
        F.array(F.lit("Weather"), F.lit("Disaster")).alias("themes"),
        F.array().cast("array<string>").alias("persons"),
        F.array(F.lit(ORGANIZATION)).alias("organizations"),
        F.when(F.size(affected) > 0, affected).otherwise(F.array(F.lit("India"))).alias("locations"),
        F.lit("-3").alias("tone"),
        (F.current_timestamp() if ingested_at is None else ingested_at).alias(
            "ingestion_timestamp"
        ),
        F.left("body", F.lit(500)).alias("alert_text"),
    )
