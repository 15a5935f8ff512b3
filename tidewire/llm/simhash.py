"""Operator 6: SimHash near-duplicates by vantage-point trees.

Texts become 64-bit fingerprints of their word shingles; equal fingerprints are one point from then on,
so a group of copies is one row however large. Vantage-point trees of a bounded sample deal the points
to shards; a point also visits the shards beyond a boundary within reach. Every shard returns a forest
of its links, never all pairs, and rounds over the forest's table give the components. All pairs of
points within the distance are found: the sample only decides where the boundaries lie.

Defined results: a null text is the empty text; a text without words has fingerprint zero and links like
any other; fewer words than a shingle are one shingle. Repeated rows stay repeated. The component of
rows is the smallest id reachable, null ids aside; it is null only if all its ids are null.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidewire.llm.common import own, pieces
from tidewire.llm.components import components
from tidewire.llm.hamming import HALVES, Node, grow, link_shard, visits
from tidewire.session import cut

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints that one shard is meant to hold, and the bound of the sample that draws the boundaries.
SHARD_POINTS, SAMPLE = 20_000, 131_072
#: Shingles whose bits are counted at once; bounds memory for very long texts.
AT_ONCE = 65_536


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    first, last = starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(first), AT_ONCE):
        block = b"".join([digest(joined[s:e], seed) for s, e in zip(first[at : at + AT_ONCE], last[at : at + AT_ONCE])])
        bits = np.unpackbits(np.frombuffer(block, np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(first)).tobytes(), "big")


@F.arrow_udf(LongType())
def fingerprint_column(text: pa.Array) -> pa.Array:
    prints = np.fromiter((fingerprint(t.as_py()) for t in text), np.uint64, len(text))
    return pa.array(prints.view(np.int64))


def _deal(trees: list[Node], leaves: list[int]):
    """Rows (shard, fp, home) of every shard that a fingerprint lies in or visits."""
    offsets = np.concatenate(([0], np.cumsum(leaves)))

    def run(batches):
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for part in pieces(range(0, len(points), 16_384), 1):
                block = points[part[0] : part[0] + 16_384]
                for tree, offset in zip(trees, offsets):
                    at, leaf, home = visits(tree, block)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(leaf + np.int32(offset)), pa.array(block[at].view(np.int64)), pa.array(home)],
                        ["shard", "fp", "home"],
                    )

    return run


def _join(first_of_half: list[int], radius: int):
    def run(table: pa.Table) -> pa.Table:
        shard = table.column("shard")[0].as_py()
        half = HALVES[int(shard >= first_of_half[1])]
        points = table.column("fp").to_numpy().view(np.uint64)
        order = np.argsort(points.view(np.int64), kind="stable")
        points, home = points[order], table.column("home").to_numpy(zero_copy_only=False)[order]
        root = link_shard(points, home, half, radius)
        at = np.flatnonzero(root != np.arange(len(points)))
        return pa.table({"a": points[at].view(np.int64), "b": points[root[at]].view(np.int64)})

    return run


def link_fingerprints(prints: DataFrame, radius: int = RADIUS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``prints(fp)`` within ``radius`` bits.

    ``prints`` holds distinct values. Links are a forest per shard.
    """
    spark = prints.sparkSession
    count = prints.count()
    sample = prints.select("fp").orderBy(F.xxhash64("fp", F.lit(1))).limit(SAMPLE).collect() if count else []
    sample = np.array([r[0] for r in sample], dtype=np.int64).view(np.uint64)
    leaf_points = max(32, len(sample) * shard_points // max(count, 1))
    grown = [grow(sample, half, radius, leaf_points) for half in HALVES]
    trees, leaves = [g[0] for g in grown], [g[1] for g in grown]
    dealt = prints.select("fp").mapInArrow(_deal(trees, leaves), "shard int, fp long, home boolean")
    return dealt.groupBy("shard").applyInArrow(_join([0, leaves[0]], radius), "a long, b long")


def with_components(docs: DataFrame, id_column: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """``docs`` with ``__llm_group``, one value per component, and ``__llm_component``, its smallest id.

    ``docs`` has the column ``__llm_fp`` and should be a written table, as it is read more than once.
    """
    fp, node, group, least = own("fp"), own("node"), own("group"), own("least")
    prints = cut(docs.groupBy(F.col(fp).alias("fp")).agg(F.min(id_column).alias(least)), "prints")
    groups = components(link_fingerprints(prints, radius), "print-links").select(
        F.col("node").alias(node), F.col("label").alias(group)
    )
    members = prints.join(groups, F.col("fp") == F.col(node), "left").select(
        "fp", least, F.coalesce(group, "fp").alias(group)
    )
    smallest = members.groupBy(group).agg(F.min(least).alias(own("component")))
    members = members.join(smallest, group).select(F.col("fp").alias(node), group, own("component"))
    return docs.join(members, F.col(fp) == F.col(node)).drop(node)


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, fingerprint (16 hexadecimal digits) and component_id of every row."""
    marked = docs.select(F.col(id_column), fingerprint_column(F.col(text_column).cast("string")).alias(own("fp")))
    found = with_components(cut(marked, "fingerprints"), id_column)
    return found.select(
        id_column,
        F.lpad(F.lower(F.hex(own("fp"))), 16, "0").alias("fingerprint"),
        F.col(own("component")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps its row with the smallest id.

    Of repeated rows with that id one stays; rows without an id come last. Columns stay as they are.
    """
    row = own("row")
    marked = cut(
        docs.withColumn(own("fp"), fingerprint_column(F.col(text_column).cast("string")))
        .withColumn(row, F.monotonically_increasing_id()),
        "marked",
    )
    found = with_components(marked.select(id_column, own("fp"), row), id_column)
    first = F.struct(F.col(id_column).isNull().alias("none"), F.col(id_column).alias("id"), F.col(row).alias("row"))
    kept = found.groupBy(own("group")).agg(F.min(first).alias("first")).select(F.col("first.row").alias(row))
    return marked.join(kept, row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
