"""A stored index of name pieces, kept while names are added."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import ANCHOR_LABELS
from ..session import cut
from ..sources.batches import FAN, BatchTable
from .expand import GRAM, NODE, needle, pieces_of

BUCKETS = 32
#: Fills up the pieces at a name's end, so that a piece starts at every character.
END = "\u0001"


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _sorted(rows: DataFrame, *columns: str) -> DataFrame:
    """In files that hold a range of pieces each. ``columns`` part a piece that very many names have."""
    order = ["bucket", "gram", *columns]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order)


class NameIndex:
    """Which names hold a piece of three characters, under ``path``, for lookups of any substring.

    A batch of names adds its own pieces and reads none that are stored. A lookup reads the counts of its needles'
    pieces, and then only the rarest piece of each needle: folders are by a hash of the piece, and files are ranges of pieces, so
    those that hold none of them are not read. A needle of one or two characters is the beginning of a piece, which
    takes a pass over the index. The full name decides, so the counts, in which a name that was added twice
    counts twice, only tell where to look.
    """

    def __init__(self, spark: SparkSession, path: str, fan: int = FAN):
        self.pieces = BatchTable(spark, f"{path}/pieces", ("bucket",))
        self.counts = BatchTable(spark, f"{path}/counts", ("bucket",))
        self.fan = fan

    def add(self, batch_id: int, names: DataFrame) -> bool:
        """Adds the names of ``label, key``; names that are known already do no harm, null and empty ones are left out.
        False when the batch had been merged."""
        low = F.concat(F.lower("key"), F.lit(END * (GRAM - 1)))
        rows = names.select(*NODE).distinct().select(F.explode(pieces_of(low, GRAM)).alias("gram"), *NODE)
        rows = cut(rows.withColumn("bucket", _bucket(F.col("gram"))), "name-pieces")
        counts = rows.groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("names")).select("gram", "names", "bucket")
        # The counts only tell where to look, so they come first: a reader between the two misses nothing.
        if self.counts.write(batch_id, _sorted(counts)):
            self.counts.merge(self._sum, self.fan)
        if not self.pieces.write(batch_id, _sorted(rows, "key")):
            return False
        self.pieces.merge(self._once, self.fan)
        return True

    @staticmethod
    def _sum(rows: DataFrame) -> DataFrame:
        return _sorted(rows.groupBy("bucket", "gram").agg(F.sum("names").alias("names")))

    @staticmethod
    def _once(rows: DataFrame) -> DataFrame:
        return _sorted(rows.drop("batch_id").distinct(), "key")

    @staticmethod
    def _of(table: BatchTable, wanted: DataFrame) -> DataFrame:
        """The rows in the folders of the wanted pieces."""
        buckets = [r["bucket"] for r in wanted.select("bucket").distinct().collect()]
        return table.read().drop("batch_id").filter(F.col("bucket").isin(buckets))

    def match(self, needles: DataFrame, labels: list[str] | None = None) -> DataFrame:
        """Pairs of ``needle`` and ``label, key`` where the lower-cased key contains the needle, each once."""
        wanted = needles.select("needle").filter(F.col("needle").isNotNull()).distinct()
        asked = wanted.filter(F.length("needle") >= GRAM).select("needle", F.explode(pieces_of(F.col("needle"), GRAM)).alias("gram"))
        asked = cut(asked.withColumn("bucket", _bucket(F.col("gram"))), "needles")
        counts = self._of(self.counts, asked).groupBy("bucket", "gram").agg(F.sum("names").alias("names"))
        rarest = asked.join(counts, ["bucket", "gram"], "left").groupBy("needle").agg(
            F.min_by(F.struct("bucket", "gram"), F.struct(F.coalesce("names", F.lit(0)), "gram")).alias("at")
        )
        rarest = cut(rarest.select("needle", "at.*"), "rarest")
        found = self._of(self.pieces, rarest).join(rarest, ["bucket", "gram"])
        short = wanted.filter(F.length("needle") < GRAM)
        if not short.isEmpty():
            heads = [F.left("gram", F.lit(n)) for n in range(GRAM)]
            begun = self.pieces.read().select(*NODE, F.explode(F.array_distinct(F.array(*heads))).alias("needle"))
            found = found.select("needle", *NODE).unionByName(begun.join(short, "needle").select("needle", *NODE))
        if labels is not None:
            found = found.filter(F.col("label").isin(labels))
        return found.filter(F.contains(F.lower("key"), F.col("needle"))).select("needle", *NODE).distinct()

    def resolve(self, targets: DataFrame, labels: list[str] = ANCHOR_LABELS, quotes: bool = True) -> DataFrame:
        """What ``expand.resolve_targets`` gives for all names that were added."""
        asked = targets.withColumn("needle", needle(F.col("target"), quotes))
        return asked.join(self.match(asked, labels), "needle").select(
            "target_id", "target", F.col("label").alias("anchor_label"), F.col("key").alias("anchor")
        )
