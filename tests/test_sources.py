"""Feeds and the record store on hand-made input."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewire.functions.fixed import BATCH_TERMS
from tidewire.schemas import GKG_COLUMNS
from tidewire.sources import archives, gkg, indicators, pages, store, topic, weather


def gkg_line(**fields):
    return "\t".join(fields.get(c, "") for c in GKG_COLUMNS)


def write_zip(path, lines):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.gkg.csv", "\n".join(lines) + "\n")


def test_zip_scan(spark, tmp_path):
    good = gkg_line(GKGRECORDID="1", DATE="20260317100000", V2Persons="A;B;", Tone="1.5")
    write_zip(tmp_path / "1.gkg.csv.zip", [good, "short\t20260101", good + "\textra", ""])
    write_zip(tmp_path / "2.gkg.csv.zip", [good.replace("1\t", "2\t", 1)])
    rows = gkg.read_zips(spark, str(tmp_path)).orderBy("GKGRECORDID").collect()
    assert [r["GKGRECORDID"] for r in rows] == ["1", "2", "short"]
    assert rows[2]["DATE"] == "20260101" and rows[2]["Extras"] is None
    record = gkg.to_records(gkg.read_zips(spark, str(tmp_path))).filter("record_id = '1'").first()
    assert record["persons"] == ["A", "B", ""] and record["themes"] == []


def test_zip_stream_reads_each_file_once(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    (tmp_path / "in").mkdir()

    def run():
        gkg.stream_zips(spark, source).writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", state
        ).trigger(availableNow=True).start().awaitTermination()
        return sorted(r["GKGRECORDID"] for r in spark.read.parquet(out).collect())

    write_zip(tmp_path / "in" / "1.zip", [gkg_line(GKGRECORDID="1")])
    assert run() == ["1"]
    write_zip(tmp_path / "in" / "2.zip", [gkg_line(GKGRECORDID="2")])
    assert run() == ["1", "2"] and run() == ["1", "2"]


def test_manifest(spark):
    lines = [("1 a http://x/20260102000000.gkg.csv.zip",), ("1 a http://x/20260103000000.gkg.csv.zip ",),
             ("1 a http://x/20260104000000.export.CSV.zip",)]
    assert gkg.newest_entry(spark.createDataFrame(lines, "value string")).first()[0].startswith("http://x/20260103")


def test_relevance(spark):
    rows = [("1", "MILITARY;GOVT", "India", "Narendra Modi", "Ministry of Defense"),
            ("2", "HEALTH;SPORTS", "USA", "John Doe", "Health Org"), ("3", None, None, None, None)]
    df = spark.createDataFrame(rows, "GKGRECORDID string, Themes string, Locations string, Persons string, Organizations string")
    assert [r[0] for r in gkg.relevant(df, BATCH_TERMS).collect()] == ["1"]


def records(spark, rows):
    return spark.createDataFrame(rows, "record_id string, url string, n int")


def test_unseen_by_id(spark):
    stored = records(spark, [("a", "u", 0), (None, "v", 0)])
    new = records(spark, [("a", "1", 1), ("b", "2", 2), ("b", "3", 3), (None, "4", 4)])
    got = lambda strict: [(r["record_id"], r["n"]) for r in store.unseen_by_id(new, stored, [F.col("n")], strict).orderBy("n").collect()]
    assert got(False) == [("b", 2), (None, 4)]
    assert got(True) == [("b", 2), ("b", 3), (None, 4)]


def test_records_without_id_go_by_url(spark):
    stored = records(spark, [(None, "v", 0), ("a", "w", 0)])
    new = records(spark, [(None, "v", 1), (None, "w", 2), (None, "x", 3), ("", "x", 4), (None, None, 5), (None, "", 6), ("a", "y", 7)])
    kept = store.unseen_by_id(new, stored, [F.col("n")]).orderBy("n").collect()
    assert [r["n"] for r in kept] == [2, 3, 5, 6]
    kept = store.unseen_by_url(new, stored, [F.col("n")]).orderBy("n").collect()
    assert [r["n"] for r in kept] == [3, 5, 6, 7]


def test_equal_titles_are_different_warnings(spark):
    items = spark.createDataFrame([("Storm", "l1", None, "Tue, 17 Mar 2026"), ("Storm", "l1", None, "Wed, 18 Mar 2026"), ("Storm", "l2", None, None)],
                                  weather.RSS_ITEM)
    assert weather.rss_records(items, "http://feed").select("record_id").distinct().count() == 3


def test_store_starts_empty_and_keeps_its_keys(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.read_store(spark, path).count() == 0
    batch = spark.createDataFrame([("IMD", "a", "u"), (None, "b", None), ("PIB", None, "w"), ("PIB", None, None)], "source string, record_id string, url string")
    for _ in range(2):
        store.append_unseen(spark, batch, path)
    got = sorted(((r["source"], r["record_id"], r["url"]) for r in store.read_store(spark, path).collect()), key=str)
    assert got == sorted([("IMD", "a", "u"), (None, "b", None), ("PIB", None, "w")] + [("PIB", None, None)] * 2, key=str)
    keys = {tuple(r) for r in store.known_keys(spark, path, "record_id").collect()}
    store.renew_keys(spark, path)
    assert {tuple(r) for r in store.known_keys(spark, path, "record_id").collect()} == keys and len(keys) == 3
    assert "records" in store.read_store(spark, path).filter("source = 'IMD'").inputFiles()[0]


def _batch(spark, first, n):
    return spark.range(first, first + n).select(
        F.lit("PIB").alias("source"), F.concat(F.lit("id"), "id").alias("record_id"), F.concat(F.lit("http://u/"), "id").alias("url"),
        F.lit("2026-01-01").cast("timestamp").alias("ingestion_timestamp"),
    )


def test_an_append_opens_only_buckets_that_may_hold_its_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "KEY_TARGET", 50)
    reads = {}
    for n in (400, 4000):
        path = str(tmp_path / f"store{n}")
        store.append_unseen(spark, _batch(spark, 0, n), path)
        buckets = store.key_buckets(spark, path)
        assert n / 50 <= buckets <= 4 * n / 50
        batch = _batch(spark, n - 2, 12).withColumn("key", F.col("record_id"))
        opened = store.possible_buckets(batch, path, "record_id")
        # The two known keys' buckets, and hardly any for the ten new ones.
        assert 1 <= len(opened) <= 4
        known = store.known_keys(spark, path, "record_id", opened)
        files = {r[0] for r in known.select(F.input_file_name()).distinct().collect()}
        assert files and all(any(f"bucket={b}/" in f for b in opened) and "by=record_id" in f for f in files)
        filters = [line for line in known._jdf.queryExecution().toString().split("\n") if "PartitionFilters" in line]
        assert filters and "bucket" in filters[-1].split("PartitionFilters")[1]
        reads[n] = known.count()
        store.append_unseen(spark, batch.drop("key"), path)
        assert store.read_store(spark, path).count() == n + 10
        store.append_unseen(spark, batch.drop("key"), path, key="url")
        assert store.read_store(spark, path).count() == n + 10
    assert reads[4000] < 3 * max(reads[400], 50)


def test_bits_never_miss_a_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "KEY_TARGET", 200)
    monkeypatch.setattr(store, "BITMAP_PARTS", 1)
    path = str(tmp_path / "store")
    for first in (0, 700, 900):
        store.append_unseen(spark, _batch(spark, first, 700), path)
    assert store.read_store(spark, path).count() == 1600
    for key in ("record_id", "url"):
        opened = store.possible_buckets(_batch(spark, 0, 1600).select(F.col(key).alias("key")), path, key)
        assert store.known_keys(spark, path, key, opened).count() == 1600
    before = {tuple(r) for r in store.known_keys(spark, path, "url").select("key").collect()}
    store.renew_keys(spark, path)
    assert {tuple(r) for r in store.known_keys(spark, path, "url").select("key").collect()} == before


def test_unseen_by_url(spark):
    stored = records(spark, [("a", "u1", 0)])
    new = records(spark, [("x", "u1", 1), ("y", "u2", 2), ("z", "u2", 3)])
    assert [r["record_id"] for r in store.unseen_by_url(new, stored, [F.col("n")]).collect()] == ["y"]


def test_store_round_trip(spark, tmp_path):
    landed = [{"source": "WorldBank", "record_id": "w", "value": 1.5, "date": 20260101, "url": "u1"},
              {"source": "NDAP", "record_id": "n", "value": "N/A", "raw_row": {"a": 1, "b": "x"}, "url": "u2"}]
    (tmp_path / "landed.json").write_text(json.dumps(landed))
    feed = store.import_json(spark, str(tmp_path / "landed.json"))
    path = str(tmp_path / "store")
    store.append(feed, path)
    store.append_unseen(spark, feed, path)
    store.append_unseen(spark, feed, path, key="url")
    rows = {r["record_id"]: r for r in store.read_store(spark, path).collect()}
    assert len(rows) == 2 and store.read_store(spark, path).count() == 2
    assert rows["w"]["value"] == 1.5 and rows["w"]["date"] == "20260101"
    assert rows["n"]["value"] is None and rows["n"]["value_raw"] == "N/A" and rows["n"]["raw_row"] == {"a": "1", "b": "x"}


def test_route(spark):
    df = spark.createDataFrame([(s,) for s in ("WorldBank", "NDAP", "IMD", "PIB", None)], "source string")
    assert [r["route"] for r in store.route(df).collect()] == ["indicator", "indicator", "weather", "article", "article"]


def test_indicator_responses(spark):
    body = '[{"page":1},[{"date":"2024","value":2.5},{"date":"2023","value":null},{"value":1}]]'
    df = spark.createDataFrame([("IN", "India", "X.Y", "Rate", body), ("IN", "India", "X.Z", "None", '[{"message":"no"}]')],
                               "country_code string, country string, indicator_code string, indicator_name string, body string")
    rows = indicators.flatten_responses(df).orderBy("record_id").collect()
    assert [r["record_id"] for r in rows] == ["wb-IN-X.Y-2024", "wb-IN-X.Y-Unknown"]
    assert rows[0]["title"] == "Rate — India (2024): 2.50" and rows[0]["date"] == "20240101"


def test_request_grid(spark):
    df = spark.createDataFrame([("IN", "India"), ("CN", "China")], "country_code string, country string")
    assert indicators.request_grid(df).count() == 12


def test_portal_rows(spark):
    rows = [{"_id": "1", "Zeta": "5", "Alpha": "6", "State": "X"}, {"State": "", "District": "D", "Year": "2020-21"}]
    bodies = [json.dumps({"success": True, "result": {"records": rows}}), json.dumps({"success": False})]
    df = spark.createDataFrame([("12345678-9", "Set", ["T"], b) for b in bodies],
                               "resource_id string, name string, themes array<string>, body string")
    got = {r["locations"][0]: r for r in indicators.portal_rows(df).collect()}
    assert set(got) == {"X", "D"}
    assert got["X"]["value"] == 5.0 and got["X"]["record_id"] == "ndap-12345678-9-1"
    assert got["D"]["value_raw"] == "N/A" and got["D"]["value"] is None and got["D"]["date"] == "20200101"
    assert got["D"]["record_id"].startswith("ndap-12345678-9-") and len(got["D"]["record_id"]) == 80


def test_alert_blocks(spark):
    texts = ["flood in Assam 12345", "flood in Assam now", "a long text about Assam only", "a flood in a place far away"]
    df = spark.createDataFrame([(t, "u") for t in texts], "text string, url string")
    found = weather.alert_blocks(df)
    assert [r["text"] for r in found.collect()] == ["flood in Assam 12345"]
    record = weather.bulletin_records(found, F.lit("20260101")).first()
    assert record["title"] == "IMD Alert: Flood — Assam" and record["themes"] == ["Weather", "Disaster", "Flood"]


def test_rss(spark, tmp_path):
    (tmp_path / "f.xml").write_text(
        "<rss><channel><item><title>Storm in Kerala</title><pubDate>Tue, 17 Mar 2026 10:00:00 GMT</pubDate></item>"
        "<item><description>no title</description></item><item><title>Calm</title><link>http://l</link></item></channel></rss>")
    rows = weather.rss_records(weather.read_rss(spark, str(tmp_path / "f.xml")), "http://feed", today=F.lit("20260101")).orderBy("title").collect()
    assert [(r["title"], r["date"], r["url"], r["locations"]) for r in rows] == [
        ("Calm", "20260101", "http://l", ["India"]), ("Storm in Kerala", "20260317", "http://feed", ["Kerala"])]


def test_release_pages(spark):
    html = '<h2> T &amp; U </h2><div class="ReleaseText"><p>भारत</p></div>'
    df = spark.createDataFrame([(1, "http://a", html), (2, "ftp://b", "<p>x</p>"), (3, "http://c", None)], "page_id int, url string, html string")
    rows = pages.release_records(df).orderBy("url").collect()
    by_url = {r["url"]: r for r in rows}
    assert by_url["http://a"]["title"] == "T & U" and by_url["http://a"]["language"] == "Hindi"
    assert by_url["ftp://b"]["title"] == "No Title" and by_url["ftp://b"]["is_translated"] is False
    assert {r["page_id"]: r["status"] for r in pages.page_text(df).collect()} == {1: "ok", 2: "not_http", 3: "no_page"}


def test_messages(spark):
    df = spark.createDataFrame([('{"record_id":"1","persons":["a"],"date":20260317}',), ("{bad",), (None,), ("plain",)], "value string")
    parsed = topic.parse_messages(df)
    good = topic.good_messages(parsed).collect()
    assert len(good) == 1 and good[0]["date"] == "20260317" and good[0]["persons"] == ["a"]
    assert sorted(str(r["value"]) for r in topic.dead_letters(parsed).collect()) == ["None", "plain", "{bad"]


def test_archives_round_trip(spark, tmp_path):
    path = str(tmp_path / "zips")
    rows = [(f"a{i % 3}", f"m{i % 2}.csv", f"line {i}é") for i in range(50)] + [("a0", "m0.csv", ""), ("b", "big.csv", "x" * 100_000)]
    archives.write_zips(spark.createDataFrame(rows, "archive string, member string, line string"), path)
    found = archives.read_lines(spark, path)
    got = sorted((r["path"].rsplit("/", 1)[1][:-4], r["member"], r["line"]) for r in found.collect())
    assert got == sorted(rows)
    assert sorted(p.name for p in (tmp_path / "zips").iterdir()) == ["a0.zip", "a1.zip", "a2.zip", "b.zip"]
    # Members are split over tasks by size; no task holds more than its share, or one member.
    scan = archives._Batch({"path": path, "partitionBytes": "1"})
    assert sorted(m for p in scan.partitions() for m in p.listed) == sorted({(f"{path}/{a}.zip", m) for a, m, _ in rows})
    assert all(len(p.listed) == 1 for p in scan.partitions())
    assert len(archives._Batch({"path": path}).partitions()) == 1
    first = archives.read_lines(spark, path, members="first").select("path", "member").distinct().collect()
    assert len(first) == 4


def test_archives_of_a_failed_write_are_not_seen(spark, tmp_path):
    path = str(tmp_path / "zips")
    rows = spark.range(100).select(F.lit("a").alias("archive"), F.lit("m").alias("member"),
                                   F.when(F.col("id") == 99, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).alias("line"))
    with pytest.raises(Exception, match="no"):
        archives.write_zips(rows, path)
    assert archives.read_lines(spark, path).count() == 0 if (tmp_path / "zips").exists() else True
    assert archives.read_lines(spark, str(tmp_path / "none")).count() == 0


def test_archives_with_no_or_broken_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "empty.zip", "w"):
        pass
    with zipfile.ZipFile(tmp_path / "two.zip", "w") as z:
        z.writestr("d/", "")
        z.writestr("d/a.csv", "1\r\n2\n\n3")
        z.writestr("b.csv", b"\xff\n")
    (tmp_path / "_hidden.zip").write_bytes(b"no archive")
    (tmp_path / "other.txt").write_text("no")
    got = sorted((r["member"], r["line"]) for r in archives.read_lines(spark, str(tmp_path)).collect())
    assert got == [("b.csv", "�"), ("d/a.csv", ""), ("d/a.csv", "1"), ("d/a.csv", "2"), ("d/a.csv", "3")]
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    with pytest.raises(Exception, match="zip"):
        archives.read_lines(spark, str(tmp_path)).count()


def test_feed_archives_grow_in_number_with_the_lines(spark, monkeypatch):
    from tidewire.plans import queries

    class Feed:
        def table(self, name):
            return spark.range(200)

        def gkg_lines(self):
            return spark.range(200).selectExpr("concat('line', id) as line")

    monkeypatch.setattr(queries, "ARCHIVED", 10)
    feed, n = queries._feed_archives(Feed())
    assert n == 21 and feed.count() == 200
    assert feed.select("archive").distinct().count() > 15


def test_first_keys_are_dealt_to_enough_buckets_at_once(spark, tmp_path, monkeypatch):
    """Keys of a large first batch are written once, in all the buckets they need, and each bucket's bits are one row per part."""
    monkeypatch.setattr(store, "KEY_TARGET", 64)
    renewed, renew = [], store.renew_keys
    monkeypatch.setattr(store, "renew_keys", lambda *a: (renewed.append(a), renew(*a)))
    path = str(tmp_path / "store")
    store.append_unseen(spark, _batch(spark, 0, 900), path)
    assert not renewed and store.key_buckets(spark, path) == 16
    bits = store._bits(spark, path, 16).groupBy("by", "bucket", "part").count()
    assert bits.filter("count > 1").isEmpty()
    store.append_unseen(spark, _batch(spark, 0, 1000), path)
    assert not renewed and store.read_store(spark, path).count() == 1000
    # A batch that would overfill them deals all keys anew, and writes none in the old layout first.
    store.append_unseen(spark, _batch(spark, 1000, 9000), path)
    assert len(renewed) == 1 and store.key_buckets(spark, path) == 256
    assert store.known_keys(spark, path, "record_id").count() == 10_000
    store.append_unseen(spark, _batch(spark, 0, 10_000), path, key="url", ready=True)
    assert store.read_store(spark, path).count() == 10_000


@pytest.mark.parametrize("key", ["record_id", "url"])
def test_appended_rows_are_those_that_are_unseen(spark, tmp_path, key):
    """Repeats, keys that are null or empty, and known keys; the rows of a key that comes once are not sorted."""
    cols = "record_id string, url string, source string, tone string, ingestion_timestamp string"

    def made(rows):
        return spark.createDataFrame(rows, cols).withColumn("ingestion_timestamp", F.to_timestamp("ingestion_timestamp"))

    old = made([("a", "u1", "GDELT", "0", "2026-01-01"), (None, "u2", "PIB", "0", "2026-01-01")])
    new = made([
        (i, u, s, str(t), f"2026-0{1 + t % 3}-01" if t else None)
        for t in range(4) for i in ("a", "b", "", None) for u in ("u1", "u2", "u3", "", None) for s in ("GDELT", None)
    ] + [("once", "only", "IMD", None, "2026-02-01")])
    order = [F.col("ingestion_timestamp").asc_nulls_last(), F.xxhash64(F.to_json(F.struct("*")))]
    unseen = store.unseen_by_url if key == "url" else store.unseen_by_id
    stored = store.conform(old)
    want = [*stored.collect(), *unseen(store.conform(new), stored, order).collect()]
    plain = lambda rows: sorted((str(r["record_id"]), str(r["url"]), str(r["source"]), str(r["ingestion_timestamp"])) for r in rows)
    for ready in (False, True):
        path = str(tmp_path / f"store{ready}")
        store.append(old, path)
        store.append_unseen(spark, new, path, key, ready)
        assert plain(store.read_store(spark, path).collect()) == plain(want)
    slim = store.conform(new).withColumn("key", F.col("url"))
    once = store._unseen_stored(slim.filter("url = 'only'"), None, order)
    assert "Window" not in once._jdf.queryExecution().optimizedPlan().toString()
