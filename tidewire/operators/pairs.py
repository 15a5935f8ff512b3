"""Weighted pairs of entities that occur in the same report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import EDGE_COLUMNS
from ..session import cut
from .lists import keyed

# Names of the left and of the right list that meet in one row.
LEFT, RIGHT = 256, 1024
# Share of all mentions that rare names must have for dropping them to be worth a shuffle; results are the same.
WORTH = 0.1


@dataclass(frozen=True)
class Family:
    """Two entity lists of a report and the edge type that their pairs become."""

    rel_type: str
    src_label: str
    left: str
    dst_label: str
    right: str


ASSOCIATED = Family("ASSOCIATED_WITH", "Person", "persons", "Organization", "organizations")
LOCATED = Family("LOCATED_AT", "Person", "persons", "Location", "locations")
OPERATES = Family("OPERATES_IN", "Organization", "organizations", "Location", "locations")
KNOWS = Family("KNOWS_OR_COOCCURRED_WITH", "Person", "persons", "Person", "persons")
ALL_FAMILIES = [ASSOCIATED, LOCATED, OPERATES, KNOWS]


def _record_lists(records: DataFrame, families: list[Family], ready: bool = False) -> DataFrame:
    """One row per record that may give pairs: a number of its own and the key lists that the families use."""
    used = sorted({name for f in families for name in (f.left, f.right)})
    lists = (records if ready else keyed(records)).select(F.monotonically_increasing_id().alias("record"), *used)
    return lists.filter(sum((F.size(F.coalesce(name, F.array())) for name in used), F.lit(0)) > 1)


def frequent_only(lists: DataFrame, min_weight: int) -> DataFrame:
    """``lists(record, ...)`` without the names that fewer than ``min_weight`` records hold.

    A pair is in no more records than either of its names, so no pair of that weight is lost; most names are rare, so most
    pairs need not be made. Where rare names are few they stay, as the pairs are counted anyway. ``lists`` should
    be a written table, it is read twice.
    """
    names = [c for c in lists.columns if c != "record"]

    def of(name: str) -> Column:
        return F.transform(F.coalesce(name, F.array()), lambda x: F.struct(F.lit(name).alias("list"), x.alias("name")))

    each = F.concat(*[of(name) for name in names])
    held = lists.select("record", F.inline(each))
    counts = cut(held.groupBy("list", "name").count(), "names")
    is_rare = F.col("count") < min_weight
    total, rare = counts.agg(F.sum("count"), F.sum(F.when(is_rare, F.col("count")))).first()
    if (rare or 0) < WORTH * (total or 1):
        return lists
    # Written, so its size is known: where it is small, the names need no shuffle.
    often = cut(counts.filter(~is_rare).select("list", "name"), "frequent")
    kept = held.join(often, ["list", "name"], "left_semi")
    return kept.groupBy("record").agg(
        *[F.collect_list(F.when(F.col("list") == name, F.col("name"))).alias(name) for name in names]
    )


def _family_lists(lists: DataFrame, families: list[Family]) -> DataFrame:
    """One row per record and family with both key lists; lists met with themselves are sorted."""

    def keys(f: Family, name: str) -> Column:
        return F.array_sort(name) if f.left == f.right else F.col(name)

    rows = F.array(
        *[
            F.struct(
                F.lit(f.rel_type).alias("rel_type"),
                F.lit(f.left == f.right).alias("same"),
                keys(f, f.left).alias("l"),
                keys(f, f.right).alias("r"),
            )
            for f in families
        ]
    )
    return lists.select("record", F.inline(rows)).filter((F.size("l") > 0) & (F.size("r") > 0))


def _ranges(sides: DataFrame, left: int, right: int) -> DataFrame:
    """Both lists cut into ranges that meet each other, one row per meeting."""
    return (
        sides.withColumn("start", F.explode(F.sequence(F.lit(0), F.size("l") - 1, F.lit(left))))
        .withColumn("from", F.explode(F.sequence(F.lit(0), F.size("r") - 1, F.lit(right))))
        # A list met with itself: ranges that end before the left one starts hold no later name.
        .filter(~F.col("same") | (F.col("from") + right > F.col("start")))
        .select(
            "record", "rel_type", "same", "start", "from",
            F.slice("l", F.col("start") + 1, F.lit(left)).alias("part"),
            F.slice("r", F.col("from") + 1, F.lit(right)).alias("r"),
        )
    )


def _pairs(lists: DataFrame, families: list[Family], left: int, right: int) -> DataFrame:
    sides = _family_lists(lists, families)
    is_long = (F.size("l") > left) | (F.size("r") > right)
    # The ranges of one long record go to many tasks; those of all others stay where they are. Ranges are few bytes and many pairs,
    # so the number of tasks is given: adaptive execution would merge them by their bytes.
    tasks = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = _ranges(sides.filter(~is_long), left, right).unionByName(
        _ranges(sides.filter(is_long), left, right).repartition(tasks, "record", "rel_type", "start", "from")
    )
    # Where in the right range the names after the left one start.
    after = F.greatest(F.col("start") + F.col("i") + 1 - F.col("from"), F.lit(0))
    later = F.slice("r", after + 1, F.lit(right))
    return (
        ranges.select("rel_type", "same", "start", "from", "r", F.posexplode("part").alias("i", "a"))
        .select("rel_type", "a", F.explode(F.when(F.col("same"), later).otherwise(F.col("r"))).alias("b"))
    )


def pair_rows(
    records: DataFrame, families: list[Family], left: int = LEFT, right: int = RIGHT, min_weight: int = 1,
    ready: bool = False,
) -> DataFrame:
    """One row per record, edge type and pair: ``rel_type, a, b``, of names that ``min_weight`` records hold or more.

    Both lists of every record are cut into ranges, so a row pairs at most ``left`` by ``right`` names; a record with
    very long lists becomes many such rows, dealt to many tasks. Pairs within one list are made once, with ``a < b``.
    ``ready`` records are a written table whose lists went through ``lists.keyed``; they are not written again.
    """
    lists = _record_lists(records, families, ready)
    if not ready:
        lists = cut(lists, "record-lists")
    if min_weight > 1:
        lists = frequent_only(lists, min_weight)
    return _pairs(lists, families, left, right)


def pair_counts(
    records: DataFrame, families: list[Family] = ALL_FAMILIES, min_weight: int = 2, ready: bool = False
) -> DataFrame:
    """Edges weighted by the number of rows of ``records`` that hold both ends.

    With one row per report (see ``graph.latest_reports``) the weight counts distinct reports. Names in fewer
    records than ``min_weight`` are dropped before pairs are made. ``ready`` as in :func:`pair_rows`.
    """
    counted = (
        pair_rows(records, families, min_weight=min_weight, ready=ready)
        .groupBy("rel_type", "a", "b")
        .agg(F.count(F.lit(1)).alias("weight"))
        .filter(F.col("weight") >= min_weight)
    )
    rel = F.col("rel_type")

    def label(side: str):
        found = F.lit(None).cast("string")
        for f in families:
            found = F.when(rel == f.rel_type, F.lit(getattr(f, side))).otherwise(found)
        return found

    return counted.select(
        label("src_label").alias("src_label"), F.col("a").alias("src"), "rel_type",
        label("dst_label").alias("dst_label"), F.col("b").alias("dst"), "weight",
    ).select(*EDGE_COLUMNS)
