"""The star-schema tables seen as feeds, records and a graph.

One order is one report: suppliers are its people, brands its organisations, nations its places
and part types its themes. Everything grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.graph import (
    article_edges,
    article_nodes,
    association_edges,
    entity_nodes,
    indicator_edges,
    indicator_nodes,
    weather_edges,
    weather_nodes,
)
from ..operators.lists import keyed, stored_keyed
from ..operators.pairs import KNOWS, LOCATED, OPERATES, pair_counts
from ..schemas import GKG_COLUMNS
from ..sources.indicators import flatten_responses
from ..sources.weather import alert_blocks, bulletin_records

TARGETS = [
    "brand#1",
    "'\"supplier#00000001\"'",
    "nation_2",
    "economy",
    "zzz",
    "tell about the economy nation_1 brand#2",
]
LONG_TARGET = "tell zzz about brand#2 nation_1 brand#2 supplier#00000001 nation_3"
# Words that occur in the documents, standing in for alert keywords and regions.
DOCUMENT_KEYWORDS = ["thatin", "rewh", "tion"]
DOCUMENT_REGIONS = ["ononst", "inoran", "hehely"]
ANSWER = "facts [1], more [3], again [1], none [99]"
STORED_UNTIL = "1998-01-01"
# Lines that one task gathers into reports, about.
GATHERED = 500_000

_schemas: dict[str, StructType] = {}


class Views:
    """Views over one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        """A table; its schema is read from the files once and then given."""
        path = f"{self.folder}/{name}.parquet"
        if path not in _schemas:
            _schemas[path] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(_schemas[path]).parquet(path)

    def _dealt(self, lines: DataFrame, key: str) -> DataFrame:
        """Lines dealt by a key: to the session's number of tasks, or to more where a task would sort too many."""
        tasks = self.table("lineitem").count() // GATHERED + 1
        usual = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return lines.repartition(tasks, key) if tasks > usual else lines.repartition(key)

    def reports(self) -> DataFrame:
        """One record per order; orders without lines have null lists."""
        person = F.concat(
            F.when(F.col("s_suppkey") % 4 == 0, "Mr. ")
            .when(F.col("s_suppkey") % 4 == 1, "President ")
            .when(F.col("s_suppkey") % 4 == 2, "")
            .otherwise("Ms "),
            "s_name", F.lit(","), F.col("s_suppkey").cast("string"),
        )
        # Texts are made once per supplier and part, and lines travel to their order before they are gathered.
        people = (
            self.table("supplier").select("s_suppkey", "s_name", "s_nationkey")
            .join(self.table("nation").select("n_nationkey", "n_name"), F.col("s_nationkey") == F.col("n_nationkey"))
            .select("s_suppkey", person.alias("person"), F.concat(F.lit("1#"), "n_name", F.lit("#XX")).alias("place"))
        )
        things = self.table("part").select(
            "p_partkey", "p_brand", F.concat("p_type", F.lit(","), F.col("p_partkey").cast("string")).alias("theme")
        )
        lines = (
            self.table("lineitem")
            .select("l_orderkey", "l_partkey", "l_suppkey", "l_discount")
            .join(things, F.col("l_partkey") == F.col("p_partkey"))
            .join(people, F.col("l_suppkey") == F.col("s_suppkey"))
            .select("l_orderkey", "l_discount", F.struct("person", "p_brand", "place", "theme").alias("line"))
        )

        def names(c: str):
            return F.sort_array(F.array_distinct(F.array_compact(F.col("lines")[c])))

        lists = (
            self._dealt(lines, "l_orderkey").groupBy("l_orderkey")
            .agg(
                F.collect_list("line").alias("lines"),
                (F.round(F.max("l_discount") * 100).cast("int") - 5).alias("tone_i"),
            )
            .select(
                "l_orderkey", "tone_i", names("person").alias("persons"), names("p_brand").alias("organizations"),
                names("place").alias("locations"), names("theme").alias("themes"),
            )
        )
        key = F.col("o_orderkey").cast("string")
        return (
            self.table("orders")
            .select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
            .join(lists, F.col("o_orderkey") == F.col("l_orderkey"), "left")
            .select(
                F.concat(F.lit("ord-"), key).alias("record_id"),
                F.concat(F.lit("https://example.com/o/"), key).alias("url"),
                F.when(F.col("o_orderkey") % 10 == 7, "PIB").otherwise("GDELT").alias("source"),
                F.col("o_orderpriority").alias("source_name"),
                F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("date"),
                "persons", "organizations", "locations", "themes",
                F.concat(F.col("tone_i").cast("string"), F.lit(",0,0,0,0,0,0")).alias("tone"),
                F.col("o_orderdate").alias("ingestion_timestamp"),
                F.col("o_orderstatus").alias("status"),
                F.col("o_orderkey").alias("order_key"),
            )
        )

    def repeats(self, reports: DataFrame | None = None) -> DataFrame:
        """Reports, stored ones if given, plus a later version, without tone, of every report that is in progress."""
        reports = self.reports() if reports is None else reports
        later = reports.filter(F.col("status") == "P").withColumns(
            {
                "tone": F.lit(None).cast("string"),
                "ingestion_timestamp": F.col("ingestion_timestamp") + F.expr("interval 1 day"),
            }
        )
        return reports.unionByName(later)

    def linked(self, reports: DataFrame | None = None) -> DataFrame:
        """Reports, stored ones if given, whose text is a page where there is one of that number."""
        pages = self.table("pages").select("page_id", F.col("url").alias("page_url"))
        return (
            (self.reports() if reports is None else reports)
            .join(pages, F.col("order_key") == F.col("page_id"), "left")
            .withColumn("url", F.coalesce("page_url", "url"))
            .drop("page_id", "page_url")
        )

    def earlier(self, reports: DataFrame) -> DataFrame:
        return reports.filter(F.col("ingestion_timestamp") < F.lit(STORED_UNTIL).cast("timestamp"))

    def later(self, reports: DataFrame) -> DataFrame:
        return reports.filter(F.col("ingestion_timestamp") >= F.lit(STORED_UNTIL).cast("timestamp"))

    def gkg(self) -> DataFrame:
        """Reports in the 31 text columns of a feed file."""
        def text(c: str):
            return F.concat(F.array_join(c, ";"), F.lit(";"))

        filled = {
            "GKGRECORDID": F.col("record_id"), "DATE": F.col("date"),
            "SourceCommonName": F.col("source_name"), "DocumentIdentifier": F.col("url"),
            "Themes": text("themes"), "V2Themes": text("themes"),
            "Locations": text("locations"), "V2Locations": text("locations"),
            "Persons": text("persons"), "V2Persons": text("persons"),
            "Organizations": text("organizations"), "V2Organizations": text("organizations"),
            "Tone": F.col("tone"),
        }
        empty = F.lit(None).cast("string")
        return self.reports().select(
            *[filled.get(c, empty).alias(c) for c in GKG_COLUMNS],
            F.col("ingestion_timestamp"),
        )

    def gkg_lines(self) -> DataFrame:
        return self.gkg().select(
            F.concat_ws("\t", *[F.coalesce(c, F.lit("")) for c in GKG_COLUMNS]).alias("line")
        )

    def manifest(self) -> DataFrame:
        """A manifest with one line per order; finished orders name another kind of file."""
        kind = F.when(F.col("o_orderstatus") == "F", ".export.CSV.zip").otherwise(".gkg.csv.zip")
        return self.table("orders").select(
            F.concat(
                F.col("o_orderkey").cast("string"), F.lit(" "),
                F.md5(F.col("o_orderkey").cast("string")), F.lit(" http://feeds.example.com/"),
                F.date_format("o_orderdate", "yyyyMMddHHmmss"), kind,
            ).alias("value")
        )

    def indicator_responses(self) -> DataFrame:
        """What the indicator service would answer per country and indicator."""
        counts = (
            self.table("orders")
            .join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("c_nationkey", "c_mktsegment", F.year("o_orderdate").alias("yr"))
            .agg(F.count(F.lit(1)).cast("double").alias("value"))
        )
        entry = F.struct(F.col("yr").cast("string").alias("date"), "value")
        return (
            counts.groupBy("c_nationkey", "c_mktsegment")
            .agg(
                F.concat(
                    F.lit('[{"page":1},'), F.to_json(F.collect_list(entry)), F.lit("]")
                ).alias("body")
            )
            .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
            .select(
                F.col("c_nationkey").cast("string").alias("country_code"),
                F.col("n_name").alias("country"),
                F.col("c_mktsegment").alias("indicator_code"),
                F.col("c_mktsegment").alias("indicator_name"),
                "body",
            )
        )

    def indicators(self) -> DataFrame:
        year_start = F.to_timestamp(F.concat(F.col("entry.date"), F.lit("-01-01")))
        return flatten_responses(self.indicator_responses(), year_start)

    def portal_responses(self) -> DataFrame:
        """One portal answer per order, its lines being the rows of the data set."""
        row = F.struct(
            F.col("l_linenumber").alias("_id"),
            F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_returnflag")).alias("State"),
            F.col("l_linestatus").alias("District"),
            F.year("l_shipdate").alias("Year"),
            F.col("l_quantity").cast("int").alias("Quantity"),
            F.col("l_partkey").alias("Alpha"),
        )
        return (
            self.table("lineitem")
            .groupBy("l_orderkey")
            .agg(F.collect_list(row).alias("records"))
            .select(
                F.format_string("%08d", "l_orderkey").alias("resource_id"),
                F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")).alias("name"),
                F.array(F.lit("Economics")).alias("themes"),
                F.to_json(
                    F.struct(
                        F.lit(True).alias("success"),
                        F.struct("records").alias("result"),
                    )
                ).alias("body"),
            )
        )

    def document_lines(self) -> DataFrame:
        """Lines of documents as text blocks with their position."""
        return self.table("documents").select(
            "doc_id",
            F.posexplode(F.split("text", "\n")).alias("pos", "line"),
        ).select(
            "doc_id", "pos", F.trim("line").alias("text"),
            F.concat(F.lit("https://example.com/d/"), F.col("doc_id").cast("string")).alias("url"),
        )

    def weather_alerts(self) -> DataFrame:
        return alert_blocks(self.document_lines(), DOCUMENT_KEYWORDS, DOCUMENT_REGIONS)

    def weather(self) -> DataFrame:
        """Weather records; the id is the place of the line, so equal lines stay apart."""
        place = F.concat_ws("-", F.col("doc_id").cast("string"), F.col("pos").cast("string"))
        return bulletin_records(
            self.weather_alerts().withColumn("record_id", place),
            F.lit("20260101"),
            F.lit("2026-01-01").cast("timestamp"),
        )

    def targets(self) -> DataFrame:
        return self.spark.createDataFrame(
            list(enumerate(TARGETS, 1)), "target_id bigint, target string"
        )

    def long_target(self) -> DataFrame:
        """One target of five keywords, no name holding all of them."""
        return self.spark.createDataFrame([(1, LONG_TARGET)], "target_id bigint, target string")

    def answers(self) -> DataFrame:
        return self.targets().select("target_id", F.lit(ANSWER).alias("answer"))

    def retrieval_edges(self, reports: DataFrame) -> DataFrame:
        """Edges that retrieval follows: article edges, associations, places of organisations."""
        return self.retrieval_edges_of(stored_keyed(reports))

    def retrieval_edges_of(self, ready: DataFrame) -> DataFrame:
        """The same of reports whose keyed lists are stored."""
        return (
            article_edges(ready)
            .unionByName(association_edges(ready, ready=True))
            .unionByName(pair_counts(ready, [OPERATES], 2, ready=True))
        )

    def scored_edges(self, reports: DataFrame, min_weight: int = 2) -> DataFrame:
        return pair_counts(reports, [LOCATED, OPERATES, KNOWS], min_weight)

    def nodes(self, reports: DataFrame) -> DataFrame:
        """All nodes: ``label, key, title, date, tone, source, url, ingestion_timestamp``."""
        def shaped(df: DataFrame, label: str, key: str) -> DataFrame:
            have = set(df.columns)
            text = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
            return df.select(
                F.lit(label).alias("label"), F.col(key).alias("key"), text("title").alias("title"),
                text("date").alias("date"), text("tone").alias("tone"),
                text("source").alias("source"), text("url").alias("url"),
                (F.col("ingestion_timestamp") if "ingestion_timestamp" in have
                 else F.lit(None).cast("timestamp")).alias("ingestion_timestamp"),
            )

        entities = entity_nodes(keyed(reports)).select(
            "label", "key", *[F.lit(None).cast("string").alias(c) for c in
                              ("title", "date", "tone", "source", "url")],
            F.lit(None).cast("timestamp").alias("ingestion_timestamp"),
        )
        return (
            entities.unionByName(shaped(article_nodes(reports), "Article", "url"))
            .unionByName(shaped(indicator_nodes(self.indicators()), "EconomicIndicator", "record_id"))
            .unionByName(shaped(weather_nodes(self.weather()), "WeatherAlert", "record_id"))
        )

    def feed_edges(self) -> DataFrame:
        return indicator_edges(self.indicators()).unionByName(weather_edges(self.weather()))
