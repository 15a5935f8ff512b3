"""Helpers that several operators share."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How this folder names columns that it adds beside a caller's own.
MARK = "__llm_"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers of the running application, once."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        folder = Path(__file__).resolve().parent.parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='tidewire-')}/code", "zip", folder.parent, folder.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


def fold(key: str | Column, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; -1 where the key is null."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string")) % F.lit(parts), F.lit(-1))


def own(name: str) -> str:
    return MARK + name


def text_of(column: str) -> Column:
    """The column as text, null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def pieces(values: Iterable, size: int) -> Iterator[list]:
    values = list(values)
    for start in range(0, len(values), size):
        yield values[start : start + size]


def struct_array(names: list[str], types: list[pa.DataType], rows: list[list]) -> pa.StructArray:
    """Columns as one Arrow array of structs."""
    return pa.StructArray.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names)


class Links:
    """Connected points of one shard. Links come in arrays; only a forest of them is kept."""

    def __init__(self, points: int, room: int = 1 << 20):
        self.root = np.arange(points, dtype=np.int64)
        self.room = max(room, points)
        self._left: list[np.ndarray] = []
        self._right: list[np.ndarray] = []
        self._held = 0

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        self._left.append(left)
        self._right.append(right)
        self._held += len(left)
        if self._held > self.room:
            self.settle()

    def settle(self) -> np.ndarray:
        """The smallest point of every point's group."""
        if self._held:
            a, b = self.root[np.concatenate(self._left)], self.root[np.concatenate(self._right)]
            self._left, self._right, self._held = [], [], 0
            while True:
                open_ = a != b
                if not open_.any():
                    break
                a, b = a[open_], b[open_]
                low, high = np.minimum(a, b), np.maximum(a, b)
                np.minimum.at(self.root, high, low)
                while True:
                    jumped = self.root[self.root]
                    if np.array_equal(jumped, self.root):
                        break
                    self.root = jumped
                a, b = self.root[low], self.root[high]
        return self.root
