"""Sums per row of values that belong to terms: a row's terms joined to a table of terms.

The table of terms has any size, so it is joined, not broadcast. Yet a few terms make up most
occurrences; those (at most ``HOT`` of them, of ``HOT_BYTES`` each on average, which bounds the broadcast)
are summed where the text is read. Only the rest of a row's terms travels, each with its count, and joins
the table by a shuffle. As frequent terms never travel, no key of that join is hot.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import own
from tidewire.llm.vectors import matrix
from tidewire.session import cut

HOT, HOT_BYTES = 300_000, 64
#: Distinct terms that a task holds before it hands them on.
HELD = 200_000

#: From texts to their terms; both are str, or both UTF-8 bytes where ``raw`` says so.
Split = Callable[[list], list[list]]


def _texts(column: pa.Array, raw: bool) -> list:
    return (column.cast(pa.binary()) if raw else column).to_pylist()


def _strings(terms: list, raw: bool) -> pa.Array:
    return pa.array(terms, pa.large_binary()).cast(pa.large_string()).cast(pa.string()) if raw else pa.array(terms, pa.string())


def _count(split: Split, groups: bool, raw: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for group, counter in held.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        _strings(list(counter), raw),
                        pa.array([group] * len(counter), pa.int32()),
                        pa.array(counter.values(), pa.int64()),
                    ],
                    ["term", "part", "n"],
                )
            held.clear()

        for batch in batches:
            for at in range(0, len(batch), 500):
                rows = batch.slice(at, 500)
                kinds = rows.column(1).to_pylist() if groups else [0] * len(rows)
                for kind, terms in zip(kinds, split(_texts(rows.column(0), raw))):
                    held.setdefault(kind, Counter()).update(terms)
                if sum(map(len, held.values())) > HELD:
                    yield from out()
        yield from out()

    return run


def counted(docs: DataFrame, text: Column, split: Split, part: Column | None = None, raw: bool = False) -> DataFrame:
    """(term, part, n): occurrences of every term of all rows, summed per task; ``part`` is a small int."""
    columns = [text.alias("text")] + ([part.cast("int").alias("part")] if part is not None else [])
    rows = docs.select(*columns).mapInArrow(_count(split, part is not None, raw), "term string, part int, n long")
    # The tasks have summed already; a second sum before the shuffle would only widen the rows.
    return rows.repartition("term")


def hot_terms(terms: DataFrame, most: int = HOT) -> DataFrame:
    """The terms of ``terms(term, n, ...)`` with the largest n: those above the least power of two that
    leaves at most ``most`` and ``most * HOT_BYTES`` bytes of them, however long a single one is."""
    bands = terms.groupBy(F.floor(F.log2("n")).cast("int").alias("band"))
    bands = bands.agg(F.count("*").alias("terms"), F.sum(F.octet_length("term")).alias("bytes")).collect()
    kept, size, band = 0, 0, 64
    for row in sorted(bands, key=lambda r: -r["band"]):
        kept, size = kept + row["terms"], size + row["bytes"]
        if kept > most or size > most * HOT_BYTES:
            break
        band = row["band"]
    return terms.where(F.col("n") >= F.lit(float(2**band)))


def row_sums(
    rows: DataFrame, split: Split, terms: DataFrame, values: list[Column], keep: list[str], most: int = HOT, raw: bool = False
) -> DataFrame:
    """``keep`` of every row of ``rows(text, ...)``, ``terms``, how many it has, and ``sums``: over the row's
    terms, each time it occurs, of every value. ``values`` are doubles over the columns of ``terms(term, n, ...)``, which holds every
    term of the rows; they are made after the join, so only those columns travel."""
    spark, row, width = rows.sparkSession, own("row"), len(values)
    hot = hot_terms(terms, most).select("term", F.array(*values).alias("values")).toArrow()
    shared = spark.sparkContext.broadcast(
        ({t: i for i, t in enumerate(_texts(hot.column("term"), raw))}, matrix(hot.column("values"), width))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = shared.value
        get, unknown = index.get, repeat(-1)
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.slice(at, 500)
                sums, sizes, ends, terms_left, counts_left = [], [], [0], [], []
                for found in split(_texts(part.column(0), raw)):
                    where = np.fromiter(map(get, found, unknown), np.int64, len(found))
                    other = where < 0
                    if other.any():
                        rest = Counter([found[i] for i in np.flatnonzero(other).tolist()])
                        terms_left += rest.keys()
                        counts_left += rest.values()
                        where = where[~other]
                    ends.append(len(terms_left))
                    sizes.append(len(found))
                    sums.append(known.take(where, axis=0).sum(axis=0))
                pairs = pa.StructArray.from_arrays([_strings(terms_left, raw), pa.array(counts_left, pa.int64())], ["term", "n"])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
                flat = pa.array(np.array(sums).ravel(), pa.float64())
                added = pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, width), pa.int32()), flat)
                columns = [*part.columns[1:], pa.array(sizes, pa.int64()), added, lists]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[1:], "terms", "sums", "rest"])

    kept = rows.select(*keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    read = rows.select("text", *keep).mapInArrow(run, f"{schema}, terms long, sums array<double>, rest array<struct<term:string,n:long>>")
    read = cut(read.withColumn(row, F.monotonically_increasing_id()), "row-sums")
    times = own("times")
    travelling = read.select(row, F.explode("rest").alias("rest")).select(row, F.col("rest.term").alias("term"), F.col("rest.n").alias(times))
    # Terms are unique and dealt evenly, so a partition of them is a small table to look up; nothing is sorted.
    joined = travelling.join(terms.hint("shuffle_hash"), "term")
    added = joined.groupBy(row).agg(*[F.sum(F.col(times) * v).alias(f"add{i}") for i, v in enumerate(values)])
    added = added.withColumnRenamed(row, own("of"))
    total = F.array(*[F.col("sums")[i] + F.coalesce(F.col(f"add{i}"), F.lit(0.0)) for i in range(width)])
    return read.drop("rest").join(added, F.col(row) == F.col(own("of")), "left").select(*keep, "terms", total.alias("sums"))
