"""Node and edge tables from records.

``keyed_records`` are records whose four entity lists went through ``lists.keyed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import article_title, entity_list, whole
from ..schemas import EDGE_COLUMNS, EDGE_KEY, NODE_KEY
from ..session import cut
from .pairs import ASSOCIATED, pair_counts


def accepted(records: DataFrame, key: str = "url") -> DataFrame:
    return records.filter(F.col(key).isNotNull() & (F.col(key) != ""))


def rejected(records: DataFrame, key: str = "url") -> DataFrame:
    """Records that cannot become a node because their key is missing."""
    return records.filter(F.col(key).isNull() | (F.col(key) == "")).withColumn(
        "reason", F.lit(f"missing {key}")
    )


def last_written(df: DataFrame, key: str, columns: list[str], order: list[str]) -> DataFrame:
    """One row per key holding the columns of its last write, nulls included.

    An aggregate, so a key written very often is reduced before the shuffle.
    """
    # The row's own hash decides between writes of one time, so the answer is always the same.
    total = F.struct(*order, F.xxhash64(F.to_json(F.struct(*columns))))
    newest = F.max_by(F.struct(*columns), total).alias("last")
    return accepted(df, key).groupBy(key).agg(newest).select(key, "last.*")


def with_article_title(records: DataFrame) -> DataFrame:
    return records.withColumn("title", article_title(_or_null(records, "title"), F.col("source_name")))


def article_nodes(records: DataFrame) -> DataFrame:
    return last_written(
        with_article_title(records),
        "url",
        ["title", "date", "tone", "source", "ingestion_timestamp"],
        ["ingestion_timestamp", "record_id"],
    )


def _or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def latest_reports(records: DataFrame, ready: bool = False) -> DataFrame:
    """One row per url with its newest lists; what co-occurrence counts.

    ``ready`` records are a written table, read three times: urls of several records are found by the urls alone and
    written, so only these records travel and are compared, and the lists of all others stay where they are.
    """
    lists = ["source", "persons", "organizations", "locations", "themes"]
    order = ["ingestion_timestamp", "record_id"]
    if not ready:
        return last_written(records, "url", lists, order)
    kept = accepted(records)
    repeated = cut(kept.groupBy("url").count().filter("count > 1").select("url"), "repeated")
    once = kept.join(repeated, "url", "left_anti").select("url", *lists)
    return once.unionByName(last_written(kept.join(repeated, "url", "left_semi"), "url", lists, order))


def indicator_nodes(records: DataFrame, more: list[str] = []) -> DataFrame:
    filled = records.withColumn("indicator_name", F.coalesce("indicator_name", F.lit(""))).withColumn(
        "value_raw", F.coalesce("value_raw", F.lit(""))
    )
    return last_written(
        filled,
        "record_id",
        ["title", "date", "indicator_name", "value_raw", "value", "url", "source",
         "ingestion_timestamp", *more],
        ["ingestion_timestamp", "title"],
    )


def weather_nodes(records: DataFrame) -> DataFrame:
    filled = records.withColumn(
        "alert_type", F.coalesce("alert_type", F.lit("Weather Alert"))
    ).withColumn("alert_text", F.left(F.coalesce("alert_text", F.lit("")), F.lit(500)))
    return last_written(
        filled,
        "record_id",
        ["title", "date", "alert_type", "alert_text", "url", "source", "ingestion_timestamp"],
        ["ingestion_timestamp", "title"],
    )


def mentions(keyed_records: DataFrame) -> DataFrame:
    """One row per record and entity, from one pass over the lists."""
    ends = F.expr(
        """concat(
          transform(persons, k -> struct('Person' as label, k as key)),
          transform(organizations, k -> struct('Organization' as label, k as key)),
          transform(locations, k -> struct('Location' as label, k as key)),
          transform(themes, k -> struct('Theme' as label, k as key)))"""
    )
    return keyed_records.select("url", F.inline(ends))


def entity_nodes(keyed_records: DataFrame) -> DataFrame:
    """Entities of the records that become articles; records without a url give no nodes either."""
    return mentions(accepted(keyed_records)).select(*NODE_KEY).distinct()


def article_edges(keyed_records: DataFrame) -> DataFrame:
    """Edges between entities and articles.

    People and organisations point at the article with the number of records that name them
    there; articles point at places and themes without a weight. Only urls of several records have mentions to
    count; they are found by the urls alone and written, so the lists of all others stay where they are.
    ``keyed_records`` should be a stored table, it is read three times.
    """
    lists = accepted(keyed_records).select("url", "persons", "organizations", "locations", "themes")
    repeated = cut(lists.groupBy("url").count().filter("count > 1").select("url"), "repeated")
    once = mentions(lists.join(repeated, "url", "left_anti")).withColumn("n", F.lit(1).cast("bigint"))
    several = mentions(lists.join(repeated, "url", "left_semi")).groupBy("url", *NODE_KEY)
    rows = once.unionByName(several.agg(F.count(F.lit(1)).alias("n")))
    is_name = F.col("label").isin("Person", "Organization")
    return rows.select(
        F.when(is_name, F.col("label")).otherwise("Article").alias("src_label"),
        F.when(is_name, F.col("key")).otherwise(F.col("url")).alias("src"),
        F.when(is_name, "MENTIONED_IN")
        .when(F.col("label") == "Location", "LOCATED_IN")
        .otherwise("HAS_THEME")
        .alias("rel_type"),
        F.when(is_name, "Article").otherwise(F.col("label")).alias("dst_label"),
        F.when(is_name, F.col("url")).otherwise(F.col("key")).alias("dst"),
        F.when(is_name, F.col("n")).alias("weight"),
    )


def association_edges(records: DataFrame, ready: bool = False) -> DataFrame:
    """Person to organisation, weighted by the number of records that name both. ``ready`` as in ``pairs.pair_rows``."""
    return pair_counts(records, [ASSOCIATED], min_weight=1, ready=ready)


def _plain_edges(records: DataFrame, src_label: str, parts: list[tuple[str, str, str]]) -> DataFrame:
    def ends(arr: str, rel: str, label: str) -> Column:
        return F.transform(
            entity_list(arr, whole),
            lambda x: F.struct(
                F.lit(rel).alias("rel_type"), F.lit(label).alias("dst_label"), x.alias("dst")
            ),
        )

    links = F.concat(*[ends(arr, rel, label) for arr, rel, label in parts])
    return (
        accepted(records, "record_id")
        .select(F.lit(src_label).alias("src_label"), F.col("record_id").alias("src"), F.inline(links))
        .distinct()
        .withColumn("weight", F.lit(None).cast("bigint"))
        .select(*EDGE_COLUMNS)
    )


def indicator_edges(records: DataFrame) -> DataFrame:
    return _plain_edges(
        records,
        "EconomicIndicator",
        [("locations", "MEASURED_IN", "Location"), ("themes", "HAS_THEME", "Theme")],
    )


def weather_edges(records: DataFrame) -> DataFrame:
    """Weather alerts threaten places; their themes are not linked."""
    return _plain_edges(records, "WeatherAlert", [("locations", "THREATENS", "Location")])


def upsert_weights(stored: DataFrame, new: DataFrame) -> DataFrame:
    """New weights replace stored ones; pairs that are not new keep what they had."""
    return (
        stored.withColumnRenamed("weight", "_old")
        .join(new.withColumnRenamed("weight", "_new"), EDGE_KEY, "full_outer")
        .select(*EDGE_KEY, F.coalesce("_new", "_old").alias("weight"))
    )


def add_weights(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Weights that accumulate over runs."""
    return (
        stored.select(*EDGE_COLUMNS)
        .unionByName(new.select(*EDGE_COLUMNS))
        .groupBy(*EDGE_KEY)
        .agg(F.sum("weight").alias("weight"))
    )


def created(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Keys of ``new`` that the stored table does not hold: what a write would create.

    One aggregate over both sides, combined before its only shuffle; a key with nulls is a key like others.
    """
    sides = stored.select(*key, F.lit(False).alias("_new")).unionByName(new.select(*key, F.lit(True).alias("_new")))
    return sides.groupBy(*key).agg(F.bool_and("_new").alias("_new")).filter("_new").drop("_new")


def write_edges(edges: DataFrame, path: str) -> None:
    """Edges partitioned by type, so that readers of some types skip the others.

    The rebalance hint gives a type with most of the rows many files and a small one few.
    """
    edges.hint("rebalance", F.col("rel_type")).write.mode("overwrite").partitionBy(
        "rel_type"
    ).parquet(path)


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge seen from both of its ends."""
    out = edges.select(
        F.col("src_label").alias("near_label"), F.col("src").alias("near"), "rel_type",
        F.col("dst_label").alias("far_label"), F.col("dst").alias("far"), "weight",
    )
    back = edges.select(
        F.col("dst_label").alias("near_label"), F.col("dst").alias("near"), "rel_type",
        F.col("src_label").alias("far_label"), F.col("src").alias("far"), "weight",
    )
    return out.unionByName(back)


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label")


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that break uniqueness, with how often they occur."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
