"""The edges of a graph kept by a stream of messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.graph import article_edges, association_edges
from ..operators.lists import stored_keyed
from ..operators.weights import EdgeWeights
from ..session import cut, passing_scratch
from ..sources.topic import good_messages, parse_messages


def batch_edges(records: DataFrame) -> DataFrame:
    """All edges that the records of one batch give, weighted by the batch alone."""
    ready = stored_keyed(records)
    return article_edges(ready).unionByName(association_edges(ready, ready=True))


def edge_job(messages: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Adds the edges of every batch of messages to :class:`EdgeWeights` under ``path``.

    A batch costs what its own messages cost, whatever the graph's size; weights add up when read. A batch that is
    repeated after a restart takes the place of its first try. Start it with a trigger.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with passing_scratch(spark):
            records = cut(good_messages(parse_messages(batch)), "messages")
            EdgeWeights(spark, path).add(batch_id, batch_edges(records))

    return messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
