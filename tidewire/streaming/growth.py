"""Daily weights of pairs on a stream, and the alerts for pairs that grow."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StreamingQuery

from ..operators.alerts import heavy_relationships, to_alerts, write_snapshot
from ..sources.batches import BatchTable


def _newest(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    last = F.max_by(F.struct(*columns), "batch_id").alias("last")
    return rows.groupBy(*key).agg(last).select(*key, "last.*")


def daily_weights(events: DataFrame, pair: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Events per pair and day. State holds the days that the watermark has not closed."""
    return (
        events.withWatermark(ts, late)
        .groupBy(*pair, F.window(ts, "1 day"))
        .agg(F.count(F.lit(1)).alias("weight"))
        .select(*pair, F.to_date("window.start").alias("day"), "weight")
    )


def daily_job(
    events: DataFrame, pair: list[str], path: str, checkpoint: str, ts: str = "ts", late: str = "1 day"
) -> DataStreamWriter:
    """Keeps the daily weights of a stream under ``path``, open days included.

    Every batch writes the weights that it changed to a batch table, so a repeated batch changes nothing; merged
    batches keep the newest weight of a day. Start it with a trigger; read it with :func:`read_daily`.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        table = BatchTable(batch.sparkSession, path)
        table.write(batch_id, batch)
        table.merge(lambda rows: _newest(rows, [*pair, "day"], ["weight"]))

    return (
        daily_weights(events, pair, ts, late)
        .writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    )


def read_daily(spark: SparkSession, path: str, pair: list[str]) -> DataFrame:
    """The newest weight of every pair and day."""
    return _newest(BatchTable(spark, path).read(), [*pair, "day"], ["weight"])


def late_rows(query: StreamingQuery) -> int:
    """Events that came after the watermark had closed their day, over the progress still known."""
    return sum(
        state["numRowsDroppedByWatermark"] for progress in query.recentProgress for state in progress["stateOperators"]
    )


#: What ``spark.sql.streaming.stateStore.providerClass`` must be for :func:`alert_job`.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


class GrowthState(StatefulProcessor):
    """Per pair the weights of the days that may still change, and whether a day's alert is raised.

    A day's verdict is given again when its weight or the one of the day before changes. A day is forgotten once the
    watermark has passed the day after it, for which it is the previous one. A pair's open days are few and one value, read and
    written once per batch, with a timer for the first of them: every call to the state is a trip to the JVM.
    """

    def __init__(self, pair: list[str], ratio: float):
        self.pair, self.ratio = pair, ratio

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "days array<int>, weights array<bigint>, raised array<boolean>")

    def _read(self) -> dict[int, tuple[int, bool]]:
        held = self.open.get()
        return {int(d): (int(w), bool(r)) for d, w, r in zip(*held)} if held else {}

    def _write(self, days: dict[int, tuple[int, bool]]) -> None:
        order = sorted(days)
        self.open.update((order, [days[d][0] for d in order], [days[d][1] for d in order]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        days = self._read()
        first = min(days, default=None)
        added: dict[int, int] = {}
        for row in rows:
            added[row["day"]] = added.get(row["day"], 0) + row["weight"]
        for day, weight in added.items():
            old, was = days.get(day, (0, False))
            days[day] = (old + weight, was)
        verdicts = [self._verdict(key, days, day) for day in sorted({d for a in added for d in (a, a + 1)})]
        self._write(days)
        if first is None or min(days) < first:
            self.handle.registerTimer((min(days) + 2) * DAY_MS)
        return iter([v for v in verdicts if v is not None])

    def _verdict(self, key, days: dict[int, tuple[int, bool]], day: int) -> Row | None:
        if day not in days or day - 1 not in days:
            return None
        (weight, was), (previous, _) = days[day], days[day - 1]
        raised = weight > self.ratio * previous
        if not (raised or was):
            return None
        days[day] = (weight, raised)
        return Row(**dict(zip(self.pair, key)), day=day, weight=weight, previous=previous, raised=raised)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        days = {d: held for d, held in self._read().items() if (d + 2) * DAY_MS > until}
        if days:
            self._write(days)
            self.handle.registerTimer((min(days) + 2) * DAY_MS)
        else:
            self.open.clear()
        return iter(())


def raised_days(
    events: DataFrame, pair: list[str], ts: str = "ts", late: str = "1 day", ratio: float = 1.5
) -> DataFrame:
    """A row whenever a day's alert is raised, changed or withdrawn; events later than the watermark are dropped.

    Events are counted per day before they travel, so a hot pair sends few rows. Days are those of UTC.
    """
    named = T.StructType([events.schema[c] for c in pair])
    counted = T.StructType([*named.fields, *T._parse_datatype_string(f"day int, {ts} timestamp, weight bigint").fields])
    order = counted.names

    def per_day(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.Table.from_batches([batch]).group_by([*pair, "day"]).aggregate([(ts, "max"), (ts, "count")])
            columns = {f"{ts}_max": ts, f"{ts}_count": "weight"}
            yield from sums.rename_columns([columns.get(c, c) for c in sums.column_names]).select(order).to_batches()

    day = F.floor(F.unix_millis(ts) / F.lit(DAY_MS)).cast("int").alias("day")
    parts = events.filter(F.col(ts).isNotNull()).select(*pair, day, ts).mapInArrow(per_day, counted)
    verdict = T._parse_datatype_string("day int, weight bigint, previous bigint, raised boolean")
    out = T.StructType([*named.fields, *verdict.fields])
    return (
        parts.withWatermark(ts, late).groupBy(*pair)
        .transformWithState(GrowthState(pair, ratio), out, "Update", "EventTime")
        .withColumn("day", F.date_from_unix_date("day"))
    )


def alert_job(
    events: DataFrame, pair: list[str], path: str, checkpoint: str, ts: str = "ts", late: str = "1 day", ratio: float = 1.5
) -> DataStreamWriter:
    """Keeps the days on which a pair grew under ``path`` while the events come. Needs ``STATE_STORE`` in the session."""

    def write(batch: DataFrame, batch_id: int) -> None:
        table = BatchTable(batch.sparkSession, path)
        table.write(batch_id, batch)
        table.merge(lambda rows: _newest(rows, [*pair, "day"], RAISED))

    return (
        raised_days(events, pair, ts, late, ratio)
        .writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    )


RAISED = ["weight", "previous", "raised"]


def read_raised(spark: SparkSession, path: str, pair: list[str]) -> DataFrame:
    """The days whose alert stands, as :func:`alerts.growth` gives them."""
    return _newest(BatchTable(spark, path).read(), [*pair, "day"], RAISED).filter("raised").drop("raised")


def rescan(edges_path: str, snapshot_path: str, now: Column | None = None):
    """A ``foreachBatch`` function that renews the alert snapshot from the stored edges."""

    def scan(batch: DataFrame, batch_id: int) -> None:
        at = F.current_timestamp() if now is None else now
        edges = batch.sparkSession.read.parquet(edges_path)
        heavy = heavy_relationships(edges)
        write_snapshot(
            to_alerts(heavy, "source_entity", "target_entity", "weight_score", at, grown=False),
            at,
            snapshot_path,
        )

    return scan
