"""The whole graph from one record store: every record goes to the builder of its route."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import route
from . import graph
from .lists import keyed, stored_keyed
from .pairs import ALL_FAMILIES, Family, pair_counts


@dataclass
class Routed:
    """Records of each route, a written table. Indicators and weather alerts never become articles."""

    records: DataFrame

    def __getitem__(self, kind: str) -> DataFrame:
        return route(self.records).filter(F.col("route") == kind).drop("route")

    def edges(self) -> DataFrame:
        articles = stored_keyed(graph.accepted(self["article"]))
        return (
            graph.article_edges(articles)
            .unionByName(graph.association_edges(articles, ready=True))
            .unionByName(graph.indicator_edges(self["indicator"]))
            .unionByName(graph.weather_edges(self["weather"]))
        )

    def entities(self) -> DataFrame:
        return graph.entity_nodes(keyed(self["article"]))

    def pairs(self, families: list[Family] = ALL_FAMILIES, min_weight: int = 2) -> DataFrame:
        """Scored pairs of the newest version of every article."""
        return pair_counts(graph.latest_reports(self["article"], ready=True), families, min_weight)

    def rejected(self) -> DataFrame:
        """Records whose route needs a key that they lack, with the reason."""
        routed = route(self.records)
        article = F.col("route") == "article"
        key = F.when(article, F.col("url")).otherwise(F.col("record_id"))
        reason = F.when(article, "missing url").otherwise("missing record_id")
        return routed.filter(key.isNull() | (key == "")).withColumn("reason", reason)

    def write(self, path: str) -> None:
        """Nodes of articles and entities, edges, pairs and rejected records under ``path``."""
        graph.article_nodes(self["article"]).write.mode("overwrite").parquet(f"{path}/articles")
        graph.indicator_nodes(self["indicator"]).write.mode("overwrite").parquet(f"{path}/indicators")
        graph.weather_nodes(self["weather"]).write.mode("overwrite").parquet(f"{path}/weather")
        self.entities().write.mode("overwrite").parquet(f"{path}/entities")
        graph.write_edges(self.edges(), f"{path}/edges")
        graph.write_edges(self.pairs(), f"{path}/pairs")
        self.rejected().write.mode("overwrite").parquet(f"{path}/rejected")
