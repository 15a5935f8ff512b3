"""Heavy and fast-growing relationships, and the alert snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.fixed import NO_ALERTS
from ..functions.reports import growth_text, severity
from ..sources.batches import BatchTable
from .graph import undirected

ALERT = (
    "severity string, source_entity string, target_entity string, weight_score bigint, "
    "description string, timestamp double"
)
SNAPSHOT = f"active_threats array<struct<{ALERT}>>, last_scan double, status string"


def heavy_relationships(
    edges: DataFrame,
    labels: list[str] = ["Theme", "Location"],
    min_weight: int = 5,
    n: int = 10,
    critical: int = 15,
) -> DataFrame:
    """The heaviest weighted edges at a theme or place, seen from that end."""
    return (
        undirected(edges.filter(F.col("weight") > min_weight))
        .filter(F.col("near_label").isin(labels))
        .orderBy(F.desc("weight"), "near", "far", "rel_type")
        .limit(n)
        .select(
            severity(F.col("weight"), critical).alias("severity"),
            F.col("near").alias("source_entity"),
            F.col("far").alias("target_entity"),
            F.col("weight").alias("weight_score"),
            "rel_type",
        )
    )


def daily_counts(events: DataFrame, pair: list[str], ts: str) -> DataFrame:
    return events.groupBy(*pair, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("weight"))


def growth(daily: DataFrame, pair: list[str], ratio: float = 1.5) -> DataFrame:
    """Days on which a pair weighs more than ``ratio`` times what it did the day before.

    ``daily`` holds one row per pair and day, so a window holds days, not events.
    """
    w = Window.partitionBy(*pair).orderBy("day")
    return (
        daily.withColumn("previous_day", F.lag("day").over(w))
        .withColumn("previous", F.lag("weight").over(w))
        .filter(
            (F.col("previous_day") == F.date_sub("day", 1))
            & (F.col("weight") > ratio * F.col("previous"))
        )
        .drop("previous_day")
    )


def to_alerts(
    found: DataFrame, source: str, target: str, weight: str, scanned_at: Column, grown: bool
) -> DataFrame:
    """Rows of the alert table. The text that claims growth is given only when it was measured."""
    text = growth_text(F.col(source), F.col(target)) if grown else F.concat(
        F.lit("Heavy relationship between '"), source, F.lit("' and '"), target, F.lit("'.")
    )
    return found.select(
        severity(F.col(weight)).alias("severity"),
        F.col(source).alias("source_entity"),
        F.col(target).alias("target_entity"),
        F.col(weight).cast("bigint").alias("weight_score"),
        text.alias("description"),
        scanned_at.cast("double").alias("timestamp"),
    )


def snapshot(alerts: DataFrame, scanned_at: Column, most: int = 1000) -> DataFrame:
    """One row of JSON with the alerts, heaviest first. It is for a short top list: more than ``most``
    alerts are an error, as one row would hold them all."""
    alerts = alerts.limit(most + 1)
    rows = F.array_sort(
        F.collect_list(
            F.struct(
                (-F.col("weight_score")).alias("_rank"), "source_entity", "target_entity",
                F.struct(*alerts.columns).alias("alert"),
            )
        )
    )
    too_many = F.raise_error(F.lit(f"more than {most} alerts for one snapshot"))
    found = alerts.agg(rows.alias("rows"))
    found = found.withColumn("rows", F.when(F.size("rows") > most, too_many).otherwise(F.col("rows")))
    return found.select(
        F.to_json(
            F.struct(
                F.transform("rows", lambda r: r["alert"]).alias("active_threats"),
                scanned_at.cast("double").alias("last_scan"),
            )
        ).alias("value")
    )


def write_snapshot(alerts: DataFrame, scanned_at: Column, path: str) -> None:
    """Renews the snapshot under ``path``; a reader sees the old one until the new one is whole."""
    table = BatchTable(alerts.sparkSession, path, format="text")
    table.replace(snapshot(alerts, scanned_at))
    table.vacuum()


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The last snapshot, or one empty answer when there was no scan yet."""
    table = BatchTable(spark, path)
    if table.versions():
        return table.read(SNAPSHOT, "json").drop("batch_id")
    nothing = F.lit(f'{{"active_threats": [], "status": "{NO_ALERTS}"}}')
    return spark.range(1).select(F.from_json(nothing, SNAPSHOT).alias("s")).select("s.*")
