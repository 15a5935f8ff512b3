"""Messages to and from a topic, and the same through JSON files where there is no broker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MESSAGE

TOPIC = "news-records"


def to_messages(records: DataFrame) -> DataFrame:
    """One JSON text per record, in the column a topic writer expects."""
    return records.select(F.to_json(F.struct(*records.columns)).alias("value"))


def publish(records: DataFrame, servers: str, topic: str = TOPIC) -> None:
    (
        to_messages(records)
        .write.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .save()
    )


def publish_files(records: DataFrame, path: str) -> None:
    """Compressed, as messages repeat their field names and many values. A file is then read by one task, so a trigger should
    take as many as there are tasks to keep busy."""
    to_messages(records).write.mode("append").option("compression", "gzip").text(path)


def subscribe(
    spark: SparkSession, servers: str, topic: str = TOPIC, offsets_per_trigger: int | None = None
) -> DataFrame:
    """All that is there per trigger, unless a number of offsets is given."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
    )
    if offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", offsets_per_trigger)
    return reader.load().select(F.col("value").cast("string").alias("value"))


def subscribe_files(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).select("value")


def parse_messages(messages: DataFrame) -> DataFrame:
    """Message fields beside the raw ``value`` and ``_corrupt``, set when it was no message."""
    schema = MESSAGE.simpleString()[len("struct<"):-1]
    data = F.from_json(
        "value",
        f"struct<{schema},_corrupt:string>",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
    )
    return messages.select("value", data.alias("data")).select("value", "data.*")


def mark_dead(parsed: DataFrame) -> DataFrame:
    """Adds ``kind``, record or dead, and for dead letters keeps the message and a reason."""
    dead = F.col("_corrupt").isNotNull() | F.col("value").isNull()
    return (
        parsed.withColumn("kind", F.when(dead, F.lit("dead")).otherwise(F.lit("record")))
        .withColumn(
            "reason",
            F.when(F.col("value").isNull(), F.lit("empty message")).when(dead, F.lit("not a record")),
        )
        .withColumn("value", F.when(dead, F.col("value")))
        .drop("_corrupt")
    )


def good_messages(parsed: DataFrame) -> DataFrame:
    return mark_dead(parsed).filter("kind = 'record'").drop("kind", "value", "reason")


def dead_letters(parsed: DataFrame) -> DataFrame:
    """Messages that could not be read, kept as they came."""
    return mark_dead(parsed).filter("kind = 'dead'").select("value", "reason")
