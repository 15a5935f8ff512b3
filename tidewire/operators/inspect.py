"""Looking into the graph: search, neighbours, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import undirected


def search_nodes(nodes: DataFrame, text: str, label: str | None = None, n: int = 5) -> DataFrame:
    """Nodes whose name, or title without one, contains the text, ignoring case."""
    shown = F.coalesce("key", "title", F.lit(""))
    found = nodes.filter(F.contains(F.lower(shown), F.lit(text.lower())))
    if label is not None:
        found = found.filter(F.col("label") == label)
    return found.select("label", "key", "title").orderBy("label", "key").limit(n)


def theme_neighbours(edges: DataFrame, nodes: DataFrame, text: str, n: int = 10) -> DataFrame:
    """What is linked to themes whose name contains the text, case-sensitive."""
    near = undirected(edges).filter(
        (F.col("near_label") == "Theme") & F.contains("near", F.lit(text))
    )
    first = near.orderBy("near", "rel_type", "far_label", "far").limit(n)
    titles = nodes.select(F.col("label").alias("far_label"), F.col("key").alias("far"), "title")
    return first.join(titles, ["far_label", "far"], "left").select(
        "near", "rel_type", "far_label", "far", "title"
    )


def sample_properties(
    nodes: DataFrame, label: str | None = None, without: list[str] = [], n: int = 3
) -> DataFrame:
    """Properties of the first ``n`` nodes, values cut to 200 characters: ``label, key, name,
    shown``. Columns without a value are left out."""
    kept = nodes.filter(~F.col("label").isin(without)) if without else nodes
    if label is not None:
        kept = kept.filter(F.col("label") == label)
    first = kept.orderBy("label", "key").limit(n)
    names = [c for c in first.columns if c not in ("label", "key")]
    props = F.array(
        *[
            F.struct(F.lit(c).alias("name"), F.left(F.col(c).cast("string"), F.lit(200)).alias("shown"))
            for c in names
        ]
    )
    return first.select("label", "key", F.inline(props)).filter(F.col("shown").isNotNull())
