"""Edge weights kept over runs, each run a batch of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EDGE_COLUMNS, EDGE_KEY
from ..sources.batches import FAN, BatchTable


def summed(rows: DataFrame) -> DataFrame:
    """Weights that accumulate; an edge type without weights keeps none."""
    return rows.groupBy(*EDGE_KEY).agg(F.sum("weight").alias("weight"))


def newest(rows: DataFrame) -> DataFrame:
    """The last run's weight of every edge, a null one too."""
    last = F.max_by(F.struct("weight"), "batch_id").alias("last")
    return rows.groupBy(*EDGE_KEY).agg(last).select(*EDGE_KEY, "last.weight")


class EdgeWeights:
    """Weights of edges over runs under ``path``.

    A run writes its own edges and reads no others; once ``fan`` runs are there their edges are folded into one
    folder, so an edge is read and written again a logarithmic number of times. A run that is repeated takes its
    own place. Folders are by edge type, so readers of some types skip the others.
    """

    def __init__(self, spark: SparkSession, path: str, fold=summed, fan: int = FAN):
        self.table = BatchTable(spark, path, ("rel_type",))
        self.fold, self.fan = fold, fan

    def add(self, run: int, edges: DataFrame) -> bool:
        """Edges with one row per key; False when the run had been merged already and nothing was added."""
        if not self.table.write(run, edges.select(*EDGE_COLUMNS)):
            return False
        self.table.merge(self.fold, self.fan)
        return True

    def read(self, rel_types: list[str] | None = None) -> DataFrame:
        rows = self.table.read()
        if rel_types is not None:
            rows = rows.filter(F.col("rel_type").isin(rel_types))
        return self.fold(rows).select(*EDGE_COLUMNS)
