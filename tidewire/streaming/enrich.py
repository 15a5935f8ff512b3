"""Streaming enrichment: messages in, records with an entity summary out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.reports import entity_summary
from ..schemas import ENRICHED
from ..sources.batches import BatchTable
from ..sources.topic import mark_dead, parse_messages


def enrich(records: DataFrame) -> DataFrame:
    return records.withColumn(
        "ai_insight",
        entity_summary(
            F.col("persons"), F.col("organizations"), F.col("locations"), F.col("themes")
        ),
    )


def enriched_table(spark: SparkSession, path: str) -> BatchTable:
    return BatchTable(spark, path, ("kind",))


class BatchWriter:
    """Writes every micro-batch to a batch table, records and dead letters in one pass.

    A batch is seen once it is whole and takes the place of its first try, so a batch that is repeated
    after a restart leaves the same rows. Small folders are merged as they come. Row counts come from the write itself; those of the last ``KEPT`` batches
    are kept.
    """

    KEPT = 100

    def __init__(self, path: str):
        self.path = path
        self.counts: dict[int, int] = {}

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        seen = Observation(f"batch{batch_id}")
        parsed = mark_dead(parse_messages(batch)).observe(seen, F.count(F.lit(1)).alias("rows"))
        table = enriched_table(batch.sparkSession, self.path)
        if table.write(batch_id, enrich(parsed)):
            self.counts[batch_id] = seen.get["rows"]
            self.counts.pop(batch_id - self.KEPT, None)
            table.merge()


def enrichment(
    messages: DataFrame, path: str, checkpoint: str, available_now: bool = False
) -> DataStreamWriter:
    """The job, ready to start: every 30 seconds, or once over all that is there."""
    writer = messages.writeStream.foreachBatch(BatchWriter(path)).option(
        "checkpointLocation", checkpoint
    )
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime="30 seconds")


def read_enriched(spark: SparkSession, path: str) -> DataFrame:
    return enriched_table(spark, path).read(ENRICHED).filter("kind = 'record'").drop("kind", "value", "reason")


def read_dead(spark: SparkSession, path: str) -> DataFrame:
    """Dead letters; ``batch_id`` is that of the last batch they were merged with."""
    return enriched_table(spark, path).read(ENRICHED).filter("kind = 'dead'").select("value", "reason", "batch_id")
