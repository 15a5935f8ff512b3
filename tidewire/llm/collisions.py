"""Operator 3: near-duplicate vectors by counting collisions of one-dimensional projections.

Vectors become unit vectors; equal ones are one class from then on. Two sets of random projections are
used. The first deals classes to cells: the signs of ``bits`` projections name a cell, and there are as
many such tables as a near pair needs to share a cell of one. Signs part a pair by its angle alone,
wherever its table is dense; cuts at medians would run through the dense places. No projection is sorted
over the table: windows on a sorted projection hold a third of all pairs, cells far fewer. The second decides inside a cell:
two vectors collide in a projection if one lies in the window around the other, collisions are counted
per pair, and pairs with enough of them are verified by their cosine in double precision.

A pair at exactly the least cosine shares a cell with probability ``MEET`` or more and passes the count
with ``PASS`` or more, over the draw of the projections; both numbers follow from its angle, so they hold
in every table of vectors, and there is no bound on tables. Every vector is indexed. Closer pairs pass
more surely. A bounded sample only tells how many bits are cheapest: signs part the vectors of a narrow
table less, and then fewer bits need fewer tables; without bits all classes are one cell.

A cell with many classes is dealt to pairs of sub-blocks, so no task holds more than two of them; no
class is left out. A pair counts in the first table whose cell it shares, so links are counted once and
summed where they are found; only a forest of them goes on. Components are rounds over that table.

Defined results: vectors that are null, zero or hold null or non-finite components, and vectors of
another length, link with nothing among those. Vectors of different length are not compared. A row
without an id has a component (the smallest id, null aside) but is not kept. Repeated rows link.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import Links, own
from tidewire.llm.components import components
from tidewire.llm.vectors import matrix, usable
from tidewire.session import cut

LEAST, MEET, PASS = 0.9, 0.997, 0.9995
#: Projections of the second set, window in units of a projection's deviation, and steps of a window.
PROJECTIONS, WINDOW, STEPS = 32, 0.6, 6
#: Sample that tells the cost of bits, mean classes of a cell in an even table, and classes of a sub-block.
SAMPLE, CELL, BLOCK = 2048, 512, 2048
ROWS = 256


class Index:
    """Projections of one vector length. Their number follows from the least cosine, its split from a sample."""

    def __init__(self, sample: np.ndarray, count: int, least: float = LEAST, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.width, self.least = sample.shape[1], least
        self.bits, self.tables = self._size(sample, count)
        self.axes = rng.standard_normal((self.width, self.tables * self.bits))
        self.fine = rng.standard_normal((self.width, PROJECTIONS))
        self.enough = self._enough()

    def _size(self, sample: np.ndarray, count: int) -> tuple[int, int]:
        """Bits and tables: no more bits than leave ``CELL`` classes of an even table, fewer where they cost less."""
        most = min(24, math.ceil(math.log2(count / CELL))) if count > CELL else 0
        keep = 1 - math.acos(min(1.0, max(-1.0, self.least))) / math.pi  # a sign is shared so often at the least cosine
        cosines = (sample @ sample.T)[~np.eye(len(sample), dtype=bool)]
        same, shared, best = 1 - np.arccos(np.clip(cosines, -1, 1)) / math.pi, np.ones(len(cosines)), (math.inf, 0, 1)
        for bits in range(most + 1):
            meet = keep**bits
            if meet <= 0:
                break  # no number of tables is enough; cells of fewer bits are
            tables = 1 if meet == 1 else math.ceil(math.log(1 - MEET) / math.log1p(-meet))
            cell = count * float(shared.mean()) if len(shared) else 0.0
            # A class is sent once per sub-block of its cell, which costs as much as 2 * CELL comparisons.
            best = min(best, (tables * (2 * CELL * (1 + cell / BLOCK) + cell), bits, tables))
            shared *= same
        return best[1:]

    def _enough(self) -> int:
        """Collisions that a pair at the least cosine has with probability ``PASS`` or more."""
        apart = math.sqrt(max(0.0, 2 - 2 * self.least))
        hit = math.erf(WINDOW / apart / math.sqrt(2)) if apart else 1.0
        fewer = 0.0  # probability of less than ``count`` collisions
        for count in range(PROJECTIONS):
            fewer += math.comb(PROJECTIONS, count) * hit**count * (1 - hit) ** (PROJECTIONS - count)
            if fewer > 1 - PASS:
                return count
        return PROJECTIONS

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """The cell of every vector in every table."""
        if not self.bits:
            return np.zeros((len(unit), self.tables), dtype=np.int32)
        above = (unit @ self.axes > 0).reshape(len(unit), self.tables, self.bits)
        return (above * (1 << np.arange(self.bits))).sum(axis=2).astype(np.int32)

    def steps(self, unit: np.ndarray) -> np.ndarray:
        """Places on the second set of projections, in steps of a window; far places are cut off alike."""
        return np.clip(np.rint(unit @ self.fine * (STEPS / WINDOW)), -63, 63).astype(np.int8)

    @staticmethod
    def collisions(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Collisions of pairs (row by row)."""
        return (np.abs(a - b) <= STEPS).sum(axis=-1)


def _window_counts(places: np.ndarray, others: np.ndarray) -> np.ndarray:
    """How many of its projections put each query's window around each other vector."""
    count = np.zeros((places.shape[1], others.shape[1]), dtype=np.int8)
    for place, other in zip(places, others):
        count += np.abs(place[:, None] - other[None, :]) <= STEPS
    return count


def link_block(index: Index, table: int, unit: np.ndarray, codes: np.ndarray, weight: np.ndarray, side: np.ndarray):
    """Links of one cell's (sub-)blocks: (position, linked rows, root) of the vectors that have any.

    ``side`` is 0 or 1; with both sides present only pairs across them are compared.
    """
    across = bool(side.any()) and not side.all()
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if across else (np.arange(len(unit)),) * 2
    links, add = Links(len(unit)), np.zeros(len(unit), dtype=np.int64)
    steps = np.ascontiguousarray(index.steps(unit).T)
    for start in range(0, len(left), ROWS):
        some = left[start : start + ROWS]
        rest = right if across else right[start:]
        i, j = np.nonzero(_window_counts(steps[:, some], steps[:, rest]) >= index.enough)
        a, b = some[i], rest[j]
        if not across:
            a, b = a[a < b], b[a < b]
        for at in range(0, len(a), 1 << 18):
            x, y = a[at : at + (1 << 18)], b[at : at + (1 << 18)]
            first = ~(codes[x, :table] == codes[y, :table]).any(axis=1)
            x, y = x[first], y[first]
            near = (unit[x] * unit[y]).sum(axis=1) >= index.least
            x, y = x[near], y[near]
            np.add.at(add, x, weight[y])
            np.add.at(add, y, weight[x])
            links.add(x, y)
    root = links.settle()
    at = np.flatnonzero(add)
    return at, add[at], root[at]


def _unit(batch_column, width: int) -> np.ndarray:
    rows = matrix(batch_column, width)
    scale = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / scale  # so that squares neither vanish nor overflow
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _deal(index: Index):
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                codes = index.codes(_unit(part.column(1), index.width))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(1), pa.array(list(codes), pa.list_(pa.int32()))],
                    ["cid", "n", "e", "codes"],
                )

    return run


def _link(index: Index):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("cid")
        cid = rows.column("cid").to_numpy()
        at, add, root = link_block(
            index, rows.column("table")[0].as_py(), _unit(rows.column("e"), index.width),
            matrix(rows.column("codes"), index.tables, np.int32), rows.column("n").to_numpy(), rows.column("side").to_numpy(),
        )
        return pa.table({"cid": cid[at], "links": add, "root": cid[root]})

    return run


def _linked(classes: DataFrame, width: int, least: float) -> DataFrame:
    """(cid, links, root) of the classes of one length, several rows per class."""
    classes = classes.where(F.size("e") == width)
    count = classes.count()
    sample = classes.orderBy(F.xxhash64("cid")).select("e").limit(SAMPLE).toArrow()
    index = Index(_unit(sample.column("e"), width), count, least)
    dealt = cut(classes.select("cid", "e", "n").mapInArrow(_deal(index), f"cid long, n long, e {classes.schema['e'].dataType.simpleString()}, codes array<int>"), "codes")
    places = dealt.select("cid", F.posexplode("codes").alias("table", "cell"))
    sizes = places.groupBy("table", "cell").count().select("table", "cell", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    spread = dealt.select("*", F.posexplode("codes").alias("table", "cell")).join(sizes, ["table", "cell"])
    home = F.pmod(F.xxhash64("cid", "table"), F.col("blocks")).cast("int")
    spread = spread.withColumn("home", home).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.select(
        "cid", "n", "e", "codes", "table", "cell", F.least("home", "with").alias("low"), F.greatest("home", "with").alias("high"),
        (F.col("home") > F.col("with")).cast("int").alias("side"),
    )
    return spread.groupBy("table", "cell", "low", "high").applyInArrow(_link(index), "cid long, links long, root long")


def near_duplicates(vectors: DataFrame, least: float = LEAST, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    # Floats are compared as they are; any other numbers as doubles.
    kind = "float" if vectors.schema[vector_column].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(id_column).alias("id"), F.col(vector_column).cast(f"array<{kind}>").alias("e"))
    fit = usable("e") & F.coalesce(F.exists("e", lambda x: x != 0), F.lit(False))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("e", F.when(fit, F.col("e"))), "vectors")
    placed = rows.where("e is not null")
    # A class is named by its smallest row; adding zero turns -0.0 into 0.0.
    key = F.transform("e", lambda x: x + F.lit(0.0).cast(kind))
    classes = cut(placed.groupBy(key.alias("e")).agg(F.min("row").alias("cid"), F.count("*").alias("n"), F.min("id").alias("least")), "classes")
    widths = [r["width"] for r in classes.select(F.size("e").alias("width")).distinct().collect()]
    found = None
    for width in widths:
        part = _linked(classes, width, least)
        found = part if found is None else found.unionAll(part)
    if found is None:
        found = classes.sparkSession.createDataFrame([], "cid long, links long, root long")
    found = cut(found, "found")
    links = found.groupBy("cid").agg(F.sum("links").alias("links")).withColumnRenamed("cid", "lcid")
    groups = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b")), "vector-links")
    members = (
        classes.join(links, F.col("cid") == F.col("lcid"), "left").join(groups, F.col("cid") == F.col("node"), "left")
        .select("e", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("label", "cid").alias("label"))
    )
    smallest = members.groupBy("label").agg(F.min("least").alias("component_id"))
    members = members.join(smallest, "label").select(F.col("e").alias(own("e")), "n_links", "component_id")
    rows = rows.withColumn("e", F.when(F.col("e").isNotNull(), key))
    whole = rows.join(members, F.col("e") == F.col(own("e")), "left")
    component = F.when(F.col("e").isNull(), F.col("id")).otherwise(F.col("component_id"))
    whole = whole.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return whole.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
