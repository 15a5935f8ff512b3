"""Connected components of a table of links.

Each round turns every point's neighbours to the smallest one it knows: first the larger neighbours of
a point, then its smaller ones and itself. Rounds are aggregates with a map-side part and joins that
adaptive execution splits where a point has very many links. A round's result is a written table, so a
lost executor costs no more than the running round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.session import cut


def _larger_to_smallest(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
        links.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.join(least, "u").where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    )


def _smaller_to_smallest(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(
        links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.sum(F.col("b").cast("decimal(20,0)"))).first()
    )


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """(node, label) for every point of ``links(a, b)``; label is the group's smallest point.

    Links of a point with itself and repeated links change nothing; links with a null end are ignored.
    Points without a link to another one are not in the result.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = cut(links, name)
    before = _state(links)
    while before[0]:
        links = cut(_smaller_to_smallest(_larger_to_smallest(links)), name)
        after = _state(links)
        if after == before:
            break
        before = after
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionAll(
        links.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    )
