"""One query per operator, each over whole tables: ``f(spark, folder) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import match
from ..functions.fixed import STREAM_TERMS
from ..operators import adjacency, alerts, build, cards, evidence, expand, graph, inspect, lists, nameindex, pairs, ranking, weights
from ..session import cut, scratch_path
from ..sources import archives, gkg, indicators, pages, store, topic, weather
from ..streaming import edges, enrich, growth
from .views import Views

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

PAIR = ["user_id", "event_type"]
ENRICHED = ["record_id", "url", "source", "source_name", "date", "tone", "ai_insight"]
PAGE_MARKER = "/t"
PAGE_BASE = "https://example.com"
# Records of one landed file, about.
LANDED = 20_000
# Lines of one archive, about, and its name; an archive is one task's.
ARCHIVED, ARCHIVE = 50_000, "feed%06d"
ACCENTED = ("\\u00C0", "\\u017F")


def query(run: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    REGISTRY[run.__name__] = lambda spark, folder: run(Views(spark, folder))
    return run


def _joined(c: str):
    return F.array_join(c, "|").alias(c)


# --- feeds ---------------------------------------------------------------------------------


@query
def relevance_filter(v: Views) -> DataFrame:
    return gkg.relevant(v.gkg(), STREAM_TERMS).select(F.col("GKGRECORDID").alias("record_id"))


@query
def canonical_records(v: Views) -> DataFrame:
    records = gkg.to_records(v.gkg(), F.col("ingestion_timestamp"))
    lists = ["themes", "persons", "organizations", "locations"]
    return records.select(
        "source", "record_id", "date", "url", "source_name", "tone", "ingestion_timestamp",
        *[_joined(c) for c in lists],
        *[F.size(c).cast("bigint").alias(f"n_{c}") for c in lists],
    )


@query
def gkg_lines(v: Views) -> DataFrame:
    return gkg.parse_lines(v.gkg_lines()).select(
        "GKGRECORDID", "DATE", "SourceCommonName", "DocumentIdentifier", "V2Themes", "V2Persons",
        "Tone", "Extras",
    )


ZIP_COLUMNS = ["GKGRECORDID", "DATE", "DocumentIdentifier", "V2Themes", "Tone", "Extras"]


def _feed_archives(v: Views) -> tuple[DataFrame, int]:
    """Feed lines dealt to archives of three members each, and their number: five, or as many as the lines need."""
    n = max(5, v.table("orders").count() // ARCHIVED + 1)
    part = F.pmod(F.xxhash64("line"), F.lit(3 * n))
    return v.gkg_lines().select(
        F.format_string(ARCHIVE, F.floor(part / 3)).alias("archive"), F.format_string("part%02d.csv", part).alias("member"), "line"
    ), n


@query
def gkg_zip_scan(v: Views) -> DataFrame:
    """The feed written as archives and read back, member by member."""
    path = scratch_path(v.spark, "zips")
    archives.write_zips(_feed_archives(v)[0], path)
    return gkg.parse_lines(archives.read_lines(v.spark, path, partitionBytes=str(1 << 20))).select(*ZIP_COLUMNS)


@query
def gkg_zip_stream(v: Views) -> DataFrame:
    """Archives read by a stream that stops and goes on: some have landed before it starts, the others while it rests."""
    source, out, state = (scratch_path(v.spark, n) for n in ("zips", "zip-rows", "zip-state"))
    feed, n = _feed_archives(v)
    early = F.col("archive") < ARCHIVE % (2 * n // 5)
    for landed in (feed.filter(early), feed.filter(~early)):
        archives.write_zips(landed, source)
        rows = gkg.parse_lines(archives.stream_lines(v.spark, source)).select(*ZIP_COLUMNS)
        job = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state)
        job.trigger(availableNow=True).start().awaitTermination()
    return v.spark.read.parquet(out)


@query
def manifest_latest(v: Views) -> DataFrame:
    return gkg.newest_entry(v.manifest())


def _store(v: Views) -> DataFrame:
    return store.combine(v.reports(), v.indicators(), v.weather())


def _listed(records: DataFrame) -> DataFrame:
    return records.select(
        "source", "record_id", "date", "url", "title", "indicator_name", "value", "alert_type",
        F.size(F.coalesce("locations", F.array().cast("array<string>"))).cast("bigint").alias("n_locations"),
    )


@query
def record_store(v: Views) -> DataFrame:
    return _listed(_store(v))


@query
def landed_records(v: Views) -> DataFrame:
    """The same records landed as JSON array files and imported from there."""
    path, records = scratch_path(v.spark, "landed"), _store(v).drop("value_raw")
    files = records.count() // LANDED + 1
    arrays = records.groupBy(F.pmod(F.xxhash64("record_id"), F.lit(files))).agg(
        F.to_json(F.collect_list(F.struct("*"))).alias("value")
    )
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return _listed(store.import_json(v.spark, path))


@query
def store_overview(v: Views) -> DataFrame:
    return store.overview(_store(v)).select(
        "source", "record_id",
        F.date_format("ingestion_timestamp", "yyyy-MM-dd HH:mm:ss").alias("ingested"), "total",
    )


@query
def new_records_by_id(v: Views) -> DataFrame:
    order = [F.col("ingestion_timestamp"), F.col("tone")]
    return store.unseen_by_id(v.repeats(), v.earlier(v.reports()), order).select(
        "record_id", "tone", "ingestion_timestamp"
    )


@query
def new_records_by_url(v: Views) -> DataFrame:
    order = [F.col("ingestion_timestamp").desc(), F.col("tone")]
    return store.unseen_by_url(v.repeats(), v.earlier(v.reports()), order).select(
        "url", "tone", "ingestion_timestamp"
    )


@query
def new_records_without_id(v: Views) -> DataFrame:
    """Releases have no id, so their urls tell them apart: those not stored yet, given twice."""
    stamp = F.lit("2026-01-01").cast("timestamp")
    found = store.conform(pages.release_records(v.table("pages"), "h1", "ad", stamp))
    stored = found.filter(F.startswith("url", F.lit("https://")))
    order = [F.col("ingestion_timestamp"), F.col("title"), F.col("original_content")]
    return store.unseen_by_id(found.unionByName(found), stored, order).select("url", "title", "record_id")


def _appended(v: Views, key: str) -> DataFrame:
    """The feeds appended to a new store: the earlier part, then all of them, which repeats that part."""
    path = scratch_path(v.spark, "store")
    feed = cut(_store(v), "feed")
    store.append_unseen(v.spark, v.earlier(feed), path, key, ready=True)
    store.append_unseen(v.spark, feed, path, key, ready=True)
    return store.read_store(v.spark, path)


@query
def store_appends(v: Views) -> DataFrame:
    return _appended(v, "record_id").select("source", "record_id", "url", "date", "ingest_month")


@query
def store_appends_by_url(v: Views) -> DataFrame:
    return _appended(v, "url").groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("url").alias("urls")
    )


@query
def rejected_records(v: Views) -> DataFrame:
    """Reports in progress without their url, and alerts without their id, cannot become nodes."""
    reports = v.reports().withColumn("url", F.when(F.col("status") != "P", F.col("url")))
    warnings = v.weather().withColumn("record_id", F.when(F.size("locations") > 1, F.col("record_id")))
    routed = build.Routed(store.combine(reports, v.indicators(), warnings))
    return routed.rejected().select("source", F.coalesce("record_id", "url").alias("name"), "reason")


@query
def graph_from_store(v: Views) -> DataFrame:
    """All edges of the store's records, each built by its route."""
    return build.Routed(cut(_store(v), "store")).edges()


@query
def pairs_from_store(v: Views) -> DataFrame:
    return build.Routed(cut(_store(v), "store")).pairs()


@query
def route_by_source(v: Views) -> DataFrame:
    return store.route(_store(v)).select("record_id", "source", "route")


@query
def request_grid(v: Views) -> DataFrame:
    segments = {s: s.title() for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")}
    countries = v.table("nation").select(F.col("n_name").alias("country"))
    return indicators.request_grid(countries, segments)


@query
def indicator_feed(v: Views) -> DataFrame:
    return v.indicators().select(
        "record_id", "date", "url", "title", "indicator_name", "year", "value", "country",
        _joined("themes"), _joined("locations"),
    )


@query
def latest_indicators(v: Views) -> DataFrame:
    return indicators.most_recent(v.indicators()).select(
        "record_id", "country", "indicator_name", "year", "value",
        F.col("recency").cast("bigint").alias("recency"),
    )


@query
def portal_rows(v: Views) -> DataFrame:
    rows = indicators.portal_rows(v.portal_responses(), F.lit("2026-01-01").cast("timestamp"))
    return rows.select(
        "record_id", "date", "url", "title", _joined("locations"), "indicator_name", "value_raw",
        "value", "year", F.size("raw_row").cast("bigint").alias("n_columns"),
    )


@query
def rss_items(v: Views) -> DataFrame:
    """Orders written as a feed, read back as a feed."""
    day = F.date_format("o_orderdate", "E")
    items = v.table("orders").join(
        v.table("customer"), F.col("o_custkey") == F.col("c_custkey")
    ).join(v.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit(" Order "), F.col("o_orderkey").cast("string"), F.lit(" ")).alias("title"),
        F.when(F.col("o_orderstatus") != "P", F.concat(F.lit("https://example.com/o/"), F.col("o_orderkey").cast("string"))).alias("link"),
        F.concat("o_orderpriority", F.lit(" from "), "n_name").alias("description"),
        F.when(
            F.col("o_orderpriority") != "5-LOW",
            F.concat(day, F.lit(", "), F.date_format("o_orderdate", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT")),
        ).alias("pubDate"),
    )
    path = scratch_path(v.spark, "rss")
    items.write.format("xml").option("rootTag", "rss").option("rowTag", "item").save(path)
    records = weather.rss_records(
        weather.read_rss(v.spark, path), "https://example.com/rss",
        ["NATION_1", "NATION_2", "Urgent"], F.lit("20260101"), F.lit("2026-01-01").cast("timestamp"),
    )
    return records.select("record_id", "date", "url", "title", _joined("locations"), "alert_text", "tone")


@query
def rss_repeats(v: Views) -> DataFrame:
    """Warnings with few titles on many days: each is a record of its own."""
    items = v.table("orders").select(
        F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("https://example.com/o/"), F.col("o_custkey").cast("string")).alias("link"),
        F.lit(None).cast("string").alias("description"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("pubDate"),
    )
    records = store.conform(weather.rss_records(
        items, "https://example.com/rss", ["Urgent"], F.lit("20260101"), F.lit("2026-01-01").cast("timestamp")
    ))
    return store.unseen_by_id(records, records.limit(0), [F.col("url")]).select("record_id", "title", "url")


# --- pages and text ------------------------------------------------------------------------


@query
def page_links(v: Views) -> DataFrame:
    return pages.page_links(v.table("pages"), PAGE_MARKER, PAGE_BASE)


@query
def page_fields(v: Views) -> DataFrame:
    return pages.release_fields(v.table("pages"), "h1", "ad")


@query
def release_records(v: Views) -> DataFrame:
    found = pages.release_records(v.table("pages"), "h1", "ad", F.lit("2026-01-01").cast("timestamp"))
    return found.select("source", "url", "title", "original_content", "is_translated", "language")


@query
def page_blocks(v: Views) -> DataFrame:
    return pages.page_blocks(v.table("pages"), ["p", "li", "div"]).select("page_id", "tag", "text")


@query
def page_text(v: Views) -> DataFrame:
    return pages.page_text(v.table("pages")).withColumn("length", F.col("length").cast("bigint"))


@query
def script_detect(v: Views) -> DataFrame:
    return pages.with_language(v.table("documents"), "text", *ACCENTED).select(
        "doc_id", "is_translated", "language"
    )


@query
def alert_blocks(v: Views) -> DataFrame:
    return v.weather_alerts().select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "text", _joined("affected"), "alert_type"
    )


# --- graph ---------------------------------------------------------------------------------


@query
def normalize_entities(v: Views) -> DataFrame:
    return graph.mentions(lists.keyed(v.reports()))


@query
def article_upsert(v: Views) -> DataFrame:
    return graph.article_nodes(v.repeats())


@query
def entity_nodes(v: Views) -> DataFrame:
    return graph.entity_nodes(lists.keyed(v.reports()))


@query
def unique_keys(v: Views) -> DataFrame:
    """Urls that raw records repeat; the node tables built from them repeat none."""
    raw = graph.duplicate_keys(v.repeats(), ["url"]).select(
        F.lit("raw").alias("stage"), F.col("url").alias("key"), "n"
    )
    built = graph.duplicate_keys(v.nodes(v.repeats()), ["label", "key"]).select(
        F.lit("built").alias("stage"), "key", "n"
    )
    return raw.unionByName(built)


@query
def mention_edges(v: Views) -> DataFrame:
    return graph.article_edges(lists.keyed(v.repeats())).filter("rel_type = 'MENTIONED_IN'")


@query
def article_links(v: Views) -> DataFrame:
    return graph.article_edges(lists.keyed(v.repeats())).filter(
        F.col("rel_type").isin("HAS_THEME", "LOCATED_IN")
    ).drop("weight")


@query
def association_edges(v: Views) -> DataFrame:
    return graph.association_edges(v.repeats())


@query
def indicator_edges(v: Views) -> DataFrame:
    return graph.indicator_edges(v.indicators()).drop("weight")


@query
def weather_edges(v: Views) -> DataFrame:
    return graph.weather_edges(v.weather()).drop("weight")


def _cooccur(family: pairs.Family, min_weight: int) -> Callable[[Views], DataFrame]:
    def run(v: Views) -> DataFrame:
        return pairs.pair_counts(v.reports(), [family], min_weight)

    return run


COOCCUR = {
    "cooccur_person_org": (pairs.ASSOCIATED, 150),
    "cooccur_person_loc": (pairs.LOCATED, 150),
    "cooccur_org_loc": (pairs.OPERATES, 400),
    "cooccur_person_person": (pairs.KNOWS, 25),
}
for _name, (_family, _least) in COOCCUR.items():
    _run = _cooccur(_family, _least)
    _run.__name__ = _name
    query(_run)


@query
def cooccur_distinct_reports(v: Views) -> DataFrame:
    """All four families at the usual threshold; repeated reports count once."""
    return pairs.pair_counts(graph.latest_reports(v.repeats()), pairs.ALL_FAMILIES, 2)


def _two_runs(v: Views) -> tuple[DataFrame, DataFrame]:
    reports = cut(v.reports(), "reports")
    return (
        pairs.pair_counts(v.earlier(reports), [pairs.ASSOCIATED, pairs.KNOWS], 2),
        pairs.pair_counts(v.later(reports), [pairs.ASSOCIATED, pairs.KNOWS], 5),
    )


@query
def weight_upsert(v: Views) -> DataFrame:
    return graph.upsert_weights(*_two_runs(v))


@query
def weight_accumulate(v: Views) -> DataFrame:
    return graph.add_weights(*_two_runs(v))


def _kept_runs(v: Views, fold) -> weights.EdgeWeights:
    """Three runs and a repeated one, folded two by two while they come."""
    first, second = _two_runs(v)
    first, second = cut(first, "run"), cut(second, "run")
    kept = weights.EdgeWeights(v.spark, scratch_path(v.spark, "weights"), fold, fan=2)
    for run, edges in ((0, first), (1, second), (1, second), (2, first.filter("weight >= 5")), (2, second)):
        kept.add(run, edges)
    return kept


@query
def weight_runs(v: Views) -> DataFrame:
    """Weights that add up over the runs. The third run is tried twice, the second try counts."""
    return _kept_runs(v, weights.summed).read()


@query
def weight_runs_newest(v: Views) -> DataFrame:
    """Of every pair the weight that the last run with it gave."""
    return _kept_runs(v, weights.newest).read()


@query
def write_counters(v: Views) -> DataFrame:
    """Nodes and edges that adding the later reports would create."""
    reports = cut(v.reports(), "reports")
    old, new = lists.stored_keyed(v.earlier(reports)), lists.stored_keyed(v.later(reports))
    nodes = graph.created(graph.entity_nodes(old), graph.entity_nodes(new), ["label", "key"])
    edges = graph.created(
        graph.article_edges(old).unionByName(graph.association_edges(old, ready=True)),
        graph.article_edges(new).unionByName(graph.association_edges(new, ready=True)),
        graph.EDGE_KEY,
    )
    return nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("created"), "n").unionByName(
        edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("relationships").alias("created"), "n")
    )


@query
def graph_counts(v: Views) -> DataFrame:
    reports = cut(v.reports(), "reports")
    edges = v.retrieval_edges(reports).unionByName(v.feed_edges())
    by_type = edges.groupBy("rel_type").agg(F.count(F.lit(1)).alias("n"))
    return graph.node_counts(v.nodes(reports)).select(
        F.lit("node").alias("kind"), F.col("label").alias("name"), "n"
    ).unionByName(by_type.select(F.lit("edge").alias("kind"), F.col("rel_type").alias("name"), "n"))


# --- alerts --------------------------------------------------------------------------------


@query
def alerts_top10(v: Views) -> DataFrame:
    return alerts.heavy_relationships(v.scored_edges(v.reports()))


@query
def alert_snapshot(v: Views) -> DataFrame:
    """The top list written as a snapshot and read back."""
    heavy = alerts.heavy_relationships(v.scored_edges(v.reports()))
    now = F.lit("2026-01-01").cast("timestamp")
    rows = alerts.to_alerts(heavy, "source_entity", "target_entity", "weight_score", now, grown=False)
    path = scratch_path(v.spark, "snapshot")
    alerts.write_snapshot(rows, now, path)
    return alerts.read_snapshot(v.spark, path).select("last_scan", F.inline("active_threats"))


@query
def pair_growth_daily(v: Views) -> DataFrame:
    return alerts.growth(alerts.daily_counts(v.table("events"), PAIR, "ts"), PAIR)


@query
def growth_alerts(v: Views) -> DataFrame:
    grown = pair_growth_daily(v).withColumn("user", F.col("user_id").cast("string"))
    return alerts.to_alerts(grown, "user", "event_type", "weight", F.col("day").cast("timestamp"), grown=True)


# --- retrieval -----------------------------------------------------------------------------


def _retrieval(v: Views, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stored anchor nodes and edges, as a retrieval job would find them. The reports are read once."""
    return _graph(v, lists.stored_keyed(reports))


def _graph(v: Views, ready: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same of reports whose keyed lists are stored."""
    return cut(graph.entity_nodes(ready), "nodes"), cut(v.retrieval_edges_of(ready), "edges")


@query
def resolve_targets(v: Views) -> DataFrame:
    return expand.resolve_targets(v.targets(), cut(graph.entity_nodes(lists.keyed(v.reports())), "nodes"))


def _asked_names(v: Views) -> DataFrame:
    """Every supplier, brand and nation name as a target."""
    return (
        v.table("nation").select(F.col("n_name").alias("target"))
        .unionByName(v.table("part").select(F.col("p_brand").alias("target")))
        .unionByName(v.table("supplier").select(F.lower("s_name").alias("target")))
        .distinct()
        .withColumn("target_id", F.xxhash64("target"))
    )


@query
def resolve_names(v: Views) -> DataFrame:
    """The asked names looked up among all entities."""
    nodes = cut(graph.entity_nodes(lists.keyed(v.reports())), "nodes")
    return expand.resolve_targets(_asked_names(v), nodes).drop("target_id")


@query
def resolve_from_index(v: Views) -> DataFrame:
    """The same from a stored index: once when it holds the names of even length, and once with all names."""
    nodes = cut(graph.entity_nodes(lists.keyed(v.reports())), "nodes")
    index = nameindex.NameIndex(v.spark, scratch_path(v.spark, "names"))
    odd, found = F.length("key") % 2, []
    for batch in (0, 1):
        index.add(batch, nodes.filter(odd == batch))
        found.append(cut(index.resolve(_asked_names(v)), "resolved").withColumn("batches", F.lit(batch + 1).cast("bigint")))
    return found[0].unionByName(found[1]).drop("target_id")


@query
def search_nodes(v: Views) -> DataFrame:
    nodes = v.nodes(v.reports())
    return inspect.search_nodes(nodes, "Nation_2").unionByName(
        inspect.search_nodes(nodes, "nation_1", "Location")
    ).withColumn("title", F.coalesce("title", F.lit("")))


def _reach(v: Views, hops: int) -> DataFrame:
    nodes, edges = _retrieval(v, v.reports())
    anchors = expand.resolve_targets(v.targets(), nodes)
    found = expand.expand(edges, anchors, hops)
    return anchors.join(found, expand.ANCHOR).select(
        "target_id", *expand.ANCHOR, F.col("key").alias("url"), F.col("hop").cast("bigint").alias("hop")
    )


@query
def hop_expand_1(v: Views) -> DataFrame:
    return _reach(v, 1)


@query
def hop_expand_2(v: Views) -> DataFrame:
    return _reach(v, 2)


@query
def hop_expand_3(v: Views) -> DataFrame:
    """Three hops reach every article from every anchor, so they are reported per distance."""
    nodes, edges = _retrieval(v, v.reports())
    anchors = expand.resolve_targets(v.targets(), nodes)
    found = expand.expand(edges, anchors, 3, counted=True)
    return anchors.join(found, expand.ANCHOR).groupBy("target_id", *expand.ANCHOR, F.col("hop").cast("bigint").alias("hop")).agg(
        F.sum("targets").alias("articles"), F.min("first_key").alias("first_url"), F.max("last_key").alias("last_url"),
    )


@query
def top_articles_per_anchor(v: Views) -> DataFrame:
    nodes, edges = _retrieval(v, v.reports())
    anchors = expand.resolve_targets(v.targets(), nodes)
    found = expand.nearest(edges, anchors)
    return anchors.join(found, expand.ANCHOR).select(
        "target_id", *expand.ANCHOR, F.col("key").alias("url"),
        F.col("hop").cast("bigint").alias("hop"), F.col("rank").cast("bigint").alias("rank"),
    )


@query
def nearest_from_lists(v: Views) -> DataFrame:
    """The same from lists that were kept while the edges came in four batches, one of them twice."""
    nodes, edges = _retrieval(v, v.reports())
    anchors = expand.resolve_targets(v.targets(), nodes)
    kept = adjacency.ShortLists(v.spark, scratch_path(v.spark, "lists"), fan=4)
    for batch in (0, 1, 1, 2, 3):
        kept.add(batch, edges.filter(F.pmod(F.xxhash64("src", "dst"), F.lit(4)) == batch))
    found = expand.nearest(edges, anchors, nearby=kept.read())
    return anchors.join(found, expand.ANCHOR).select(
        "target_id", *expand.ANCHOR, F.col("key").alias("url"),
        F.col("hop").cast("bigint").alias("hop"), F.col("rank").cast("bigint").alias("rank"),
    )


@query
def nearest_by_part(v: Views) -> DataFrame:
    """Parts as places of their own: most have few articles, so the search goes several hops."""
    lines = v.table("lineitem").select("l_orderkey", "l_partkey")
    x = ranking.dealt(lines, lines.count(), "l_orderkey", "l_partkey").distinct()
    order = F.concat(F.lit("o/"), F.col("l_orderkey").cast("string"))
    part = F.concat(F.lit("p/"), F.col("l_partkey").cast("string"))
    edges = cut(x.select(
        F.lit("Article").alias("src_label"), order.alias("src"), F.lit("LOCATED_IN").alias("rel_type"),
        F.lit("Location").alias("dst_label"), part.alias("dst"), F.lit(None).cast("bigint").alias("weight"),
    ), "edges")
    anchors = v.table("part").filter(F.col("p_name") == "blue bolt").select(
        F.lit("Location").alias("anchor_label"),
        F.concat(F.lit("p/"), F.col("p_partkey").cast("string")).alias("anchor"),
    )
    found = expand.nearest(edges, anchors, hops=3, limit=40)
    return found.select("anchor", F.col("key").alias("url"), F.col("hop").cast("bigint").alias("hop"),
                        F.col("rank").cast("bigint").alias("rank"))


@query
def article_cards(v: Views) -> DataFrame:
    """A card for every article."""
    stored = cut(v.reports(), "reports")
    return cards.article_cards(stored.select("url").distinct(), stored).select("url", "card")


@query
def indicator_cards(v: Views) -> DataFrame:
    return cards.indicator_cards(v.indicators()).select("record_id", "card")


@query
def weather_cards(v: Views) -> DataFrame:
    return cards.weather_cards(v.weather()).select("record_id", "card")


@query
def mixed_cards(v: Views) -> DataFrame:
    """Articles, indicators and alerts near the targets, each with its own card."""
    records = cut(_store(v), "store")
    routed = build.Routed(records)
    nodes = cut(routed.entities(), "nodes")
    edges = cut(routed.edges(), "edges")
    near = cut(cards.mixed_hits(v.targets(), nodes, edges, hops=1), "hits")
    return cards.mixed_cards(near, records).select(
        "target_id", "label", "key", F.col("hop").cast("bigint").alias("hop"), "url", "card", "source"
    )


def _stored(v: Views) -> DataFrame:
    return cut(v.reports(), "reports")


def _cards(
    v: Views, stored: DataFrame, targets: DataFrame | None = None, n: int = 3, ready: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Cards of all targets from stored reports, keywords used where a target of several words found nothing."""
    nodes, edges = _retrieval(v, stored) if ready is None else _graph(v, ready)
    targets = v.targets() if targets is None else targets
    nearby, searched = expand.node_lists(edges), []

    def of(asked: DataFrame) -> DataFrame:
        return cards.article_cards(cut(cards.hits(asked, nodes, edges, nearby=nearby, searched=searched), "hits"), stored)

    whole = cut(of(targets).select("target_id", F.lit(0).alias("part"), "hop", "url", "card", "source"), "cards")
    lacking = evidence.needs_keywords(targets, whole)
    words = evidence.keyword_requests(lacking, n)
    asked = words.select(F.concat_ws(":", "target_id", "part").alias("target_id"), "target")
    place = F.split("target_id", ":")
    more = of(asked).select(
        F.get(place, F.lit(0)).cast("bigint").alias("target_id"),
        F.get(place, F.lit(1)).cast("int").alias("part"), "hop", "url", "card", "source",
    )
    return whole, cut(more, "keyword_cards")


@query
def keyword_fusion(v: Views) -> DataFrame:
    whole, more = _cards(v, _stored(v))
    return evidence.fuse(whole, more).select(
        "target_id", F.col("part").cast("bigint").alias("part"), F.col("hop").cast("bigint").alias("hop"), "url"
    )


@query
def keyword_fusion_first_line(v: Views) -> DataFrame:
    whole, more = _cards(v, _stored(v))
    return evidence.fuse(whole, more, compat="first_line").select(
        "target_id", F.col("part").cast("bigint").alias("part"), F.col("hop").cast("bigint").alias("hop"), "url"
    )


@query
def keyword_fusion_five(v: Views) -> DataFrame:
    """A target of more words than usual, each of which may bring its cards."""
    whole, more = _cards(v, _stored(v), v.long_target(), 5)
    return evidence.fuse(whole, more, compat="first_line").select(
        "target_id", F.col("part").cast("bigint").alias("part"), F.col("hop").cast("bigint").alias("hop"), "url"
    )


def _ranked_urls(v: Views) -> tuple[DataFrame, DataFrame]:
    """Two rankings of pages per target number: oldest first, longest first.

    A page belongs to the target its number leads to, so that all pages take part.
    """
    asked = v.targets().select(F.col("target_id").alias("query_id"))
    rows = v.table("pages").select(
        (F.pmod("page_id", F.lit(5)) + 1).alias("query_id"), "url", "page_id",
        F.length("html").alias("size"),
    ).join(asked, "query_id", "left_semi")
    first = ranking.first_k(rows, ["query_id"], [F.col("page_id")], 3)
    second = ranking.first_k(rows, ["query_id"], [F.col("size").desc(), F.col("page_id")], 3)
    return tuple(r.select("query_id", "url", F.col("rank").cast("bigint").alias("rank")) for r in (first, second))


@query
def merged_urls(v: Views) -> DataFrame:
    return evidence.merge_urls(*_ranked_urls(v)).withColumn("position", F.col("position").cast("bigint"))


@query
def direct_urls(v: Views) -> DataFrame:
    asked = v.table("pages").select(F.col("page_id").alias("query_id"), F.col("url").alias("query")).unionByName(
        v.table("nation").select(F.col("n_nationkey").cast("bigint").alias("query_id"), F.col("n_name").alias("query"))
    )
    return evidence.direct_urls(asked).withColumn("position", F.col("position").cast("bigint"))


def _live(v: Views) -> DataFrame:
    found = evidence.merge_urls(*_ranked_urls(v)).select(F.col("query_id").alias("target_id"), "position", "url")
    return evidence.live_cards(found, pages.page_text(_wanted_pages(v, found)))


def _wanted_pages(v: Views, wanted: DataFrame) -> DataFrame:
    return v.table("pages").join(wanted.select("url").distinct(), "url", "left_semi")


@query
def live_cards(v: Views) -> DataFrame:
    return _live(v).withColumn("position", F.col("position").cast("bigint"))


@query
def live_fields(v: Views) -> DataFrame:
    """What the text of a live card tells: its url, its source and its first line."""
    card = F.col("card")
    return _live(v).select(
        "target_id", F.col("position").cast("bigint").alias("position"), match.card_url(card).alias("url"),
        match.card_source(card).alias("source"), match.headline(card).alias("headline"),
    )


@query
def headlines(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", match.headline(F.col("text")).alias("headline"))


def _evidence(v: Views, stored: DataFrame | None = None, ready: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    whole, more = _cards(v, _stored(v) if stored is None else stored, ready=ready)
    live = cut(_live(v), "live")
    return evidence.evidence(evidence.with_live(evidence.fuse(whole, more), live)), live


@query
def evidence_rows(v: Views) -> DataFrame:
    return _evidence(v)[0].withColumn("id", F.col("id").cast("bigint"))


@query
def cited_sources(v: Views) -> DataFrame:
    return evidence.cited_sources(_evidence(v)[0], v.answers()).select(
        "target_id", F.col("id").cast("bigint").alias("id"), "source", "url"
    )


def _deep(v: Views, max_articles: int, ready: DataFrame | None = None) -> DataFrame:
    """``ready`` are stored reports with their keyed lists, which do not depend on the url that a page gives them."""
    nodes, edges = _retrieval(v, v.linked()) if ready is None else _graph(v, cut(v.linked(ready), "linked"))
    targets = v.targets()
    near = cards.hits(targets, nodes, edges, limit=max_articles, quotes=False)
    near = cut(near, "hits")
    return evidence.deep_context(targets, near, pages.page_text(_wanted_pages(v, near)), max_articles)


@query
def deep_context(v: Views) -> DataFrame:
    return _deep(v, 3)


@query
def prompt_assembly(v: Views) -> DataFrame:
    stored = _stored(v)
    ready = lists.stored_keyed(stored, "order_key")
    rows, live = _evidence(v, stored, ready)
    return evidence.prompts(
        v.targets(), evidence.live_context(live), _deep(v, 1, ready), evidence.first_cards(rows)
    )


@query
def last_messages(v: Views) -> DataFrame:
    return evidence.last_messages(v.table("conversations")).withColumn("back", F.col("back").cast("bigint"))


# --- inspection ----------------------------------------------------------------------------


@query
def theme_neighbours(v: Views) -> DataFrame:
    reports = v.reports()
    edges = v.retrieval_edges(reports).unionByName(v.feed_edges())
    return inspect.theme_neighbours(edges, v.nodes(reports), "ECONOMY")


@query
def sample_props(v: Views) -> DataFrame:
    nodes = v.nodes(v.reports()).drop("ingestion_timestamp")
    return inspect.sample_properties(nodes, "Article").unionByName(
        inspect.sample_properties(nodes, None, ["Article", "Theme"])
    )


# --- streaming -----------------------------------------------------------------------------


@query
def entity_summaries(v: Views) -> DataFrame:
    return enrich.enrich(v.reports()).select("record_id", "ai_insight")


def _messages(v: Views) -> DataFrame:
    """Reports as messages, and document texts among them that are no messages."""
    fields = [f.name for f in topic.MESSAGE.fields]
    return topic.to_messages(v.reports().select(*fields)).unionByName(
        v.table("documents").select(F.col("text").alias("value"))
    )


@query
def parse_messages(v: Views) -> DataFrame:
    parsed = topic.mark_dead(topic.parse_messages(_messages(v)))
    return parsed.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count("record_id").alias("n_ids"))


@query
def dead_letters(v: Views) -> DataFrame:
    return topic.dead_letters(topic.parse_messages(_messages(v)))


@query
def stream_enrich(v: Views) -> DataFrame:
    """Messages published to files, enriched as a stream in several batches, read back."""
    source, out, checkpoint = (scratch_path(v.spark, n) for n in ("topic", "enriched", "state"))
    fields = [f.name for f in topic.MESSAGE.fields]
    topic.publish_files(v.reports().select(*fields), source)
    job = enrich.enrichment(topic.subscribe_files(v.spark, source, 4), out, checkpoint, available_now=True)
    job.start().awaitTermination()
    return enrich.read_enriched(v.spark, out).select(*ENRICHED)


@query
def stream_replay(v: Views) -> DataFrame:
    """One batch written twice, as after a restart, leaves its rows once."""
    out = scratch_path(v.spark, "enriched")
    fields = [f.name for f in topic.MESSAGE.fields]
    messages = cut(topic.to_messages(v.reports().select(*fields)), "messages")
    writer = enrich.BatchWriter(out)
    writer(messages, 0)
    writer(messages, 0)
    return enrich.read_enriched(v.spark, out).select(*ENRICHED)


@query
def stream_new_files(v: Views) -> DataFrame:
    """Files that arrive between two runs of one job are read once, those of the first run not again."""
    source, out, checkpoint = (scratch_path(v.spark, n) for n in ("topic", "enriched", "state"))
    fields = [f.name for f in topic.MESSAGE.fields]
    for part in (v.earlier, v.later):
        topic.publish_files(part(v.reports()).select(*fields), source)
        job = enrich.enrichment(topic.subscribe_files(v.spark, source), out, checkpoint, available_now=True)
        job.start().awaitTermination()
    return enrich.read_enriched(v.spark, out).select(*ENRICHED)


@query
def stream_rescan(v: Views) -> DataFrame:
    """The alert snapshot after a scan of some edges and another one once all are stored."""
    edges, path = scratch_path(v.spark, "edges"), scratch_path(v.spark, "snapshot")
    scored = cut(v.scored_edges(v.reports()), "scored")
    scan = growth.rescan(edges, path, F.lit("2026-01-01").cast("timestamp"))
    for batch_id, rel_types in enumerate((["LOCATED_AT"], ["OPERATES_IN", "KNOWS_OR_COOCCURRED_WITH"])):
        scored.filter(F.col("rel_type").isin(rel_types)).write.mode("append").parquet(edges)
        scan(scored, batch_id)
    return alerts.read_snapshot(v.spark, path).select("last_scan", F.inline("active_threats"))


@query
def stream_growth(v: Views) -> DataFrame:
    """Daily weights kept by a stream over the events, open days too, then compared day by day."""
    events = v.table("events")
    source = (
        v.spark.readStream.schema(events.schema)
        .option("pathGlobFilter", "events.parquet")
        .parquet(v.folder)
        .withColumn("ts", F.col("ts").cast("timestamp"))
    )
    out, checkpoint = (scratch_path(v.spark, n) for n in ("daily", "state"))
    growth.daily_job(source, PAIR, out, checkpoint).trigger(availableNow=True).start().awaitTermination()
    return alerts.growth(growth.read_daily(v.spark, out, PAIR), PAIR)


@query
def stream_growth_alerts(v: Views) -> DataFrame:
    """The same alerts raised by keyed state while the days come, over two runs of one job."""
    # This state needs the RocksDB store; a session of its own leaves the others as they are.
    spark = v.spark.newSession()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", growth.STATE_STORE)
    source, out, checkpoint = (scratch_path(v.spark, n) for n in ("events", "raised", "state"))
    events = v.table("events").select(*PAIR, F.col("ts").cast("timestamp").alias("ts"))
    middle = events.agg(F.percentile_approx("ts", 0.5)).first()[0]
    for part in (F.col("ts") < F.lit(middle), F.col("ts") >= F.lit(middle)):
        events.filter(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        growth.alert_job(stream, PAIR, out, checkpoint).trigger(availableNow=True).start().awaitTermination()
    return growth.read_raised(v.spark, out, PAIR)


@query
def stream_graph(v: Views) -> DataFrame:
    """Mentions and associations kept by a stream over two runs of one job."""
    source, out, checkpoint = (scratch_path(v.spark, n) for n in ("topic", "graph", "state"))
    fields = [f.name for f in topic.MESSAGE.fields]
    stored = _stored(v)
    for part in (v.earlier, v.later):
        topic.publish_files(part(v.repeats(stored)).select(*fields), source)
        messages = topic.subscribe_files(v.spark, source)
        edges.edge_job(messages, out, checkpoint).trigger(availableNow=True).start().awaitTermination()
    return weights.EdgeWeights(v.spark, out).read(["MENTIONED_IN", "ASSOCIATED_WITH"])


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Reports to keyed entities to scored pairs to the heaviest places."""
    v = Views(spark, folder)
    return alerts.heavy_relationships(
        pairs.pair_counts(v.reports(), pairs.ALL_FAMILIES, 2),
        labels=["Location", "Organization"],
    )
