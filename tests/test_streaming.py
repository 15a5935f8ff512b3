"""Streams give what a batch gives, and a repeated batch changes nothing."""

import json

from pyspark.sql import functions as F

from tidewire.sources import topic
from tidewire.streaming import enrich, growth


def lines(*records):
    return [(json.dumps(r),) for r in records]


def test_stream_equals_batch_over_several_runs(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("topic", "out", "state"))

    def run():
        job = enrich.enrichment(topic.subscribe_files(spark, source, 1), out, state, available_now=True)
        job.start().awaitTermination()

    first = spark.createDataFrame(lines({"record_id": "1", "persons": ["a"]}) + [("{bad",)], "value string").coalesce(1)
    first.write.mode("append").text(source)
    run()
    spark.createDataFrame(lines({"record_id": "2"}), "value string").write.mode("append").text(source)
    run()
    run()
    got = {r["record_id"]: r["ai_insight"] for r in enrich.read_enriched(spark, out).collect()}
    assert got == {"1": "Persons: a", "2": "No entities"}
    assert [r["value"] for r in enrich.read_dead(spark, out).collect()] == ["{bad"]


def test_repeated_batch_is_replaced(spark, tmp_path):
    out = str(tmp_path / "out")
    writer = enrich.BatchWriter(out)
    batch = spark.createDataFrame(lines({"record_id": "1"}, {"record_id": "2"}), "value string")
    writer(batch, 7)
    writer(batch, 7)
    writer(batch.limit(0), 8)
    assert writer.counts == {7: 2, 8: 0}
    assert enrich.read_enriched(spark, out).count() == 2


def test_daily_weights_are_emitted_once_closed(spark, tmp_path):
    rows = [("a", f"2026-01-0{d} 10:00:00") for d in (1, 1, 2, 4)]
    events = spark.createDataFrame(rows, "pair string, t string").select("pair", F.to_timestamp("t").alias("ts"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    growth.daily_weights(stream, ["pair"]).writeStream.outputMode("append").format("parquet").option(
        "path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(
        availableNow=True).start().awaitTermination()
    got = sorted((str(r["day"]), r["weight"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("2026-01-01", 2), ("2026-01-02", 1)]


def test_daily_job_keeps_open_days_and_counts_late_events(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "pair string, ts timestamp"

    def run(*days):
        rows = spark.createDataFrame([("a", f"2026-01-{d:02d} 10:00:00") for d in days], "pair string, t string")
        rows.select("pair", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        query = growth.daily_job(stream, ["pair"], out, state).trigger(availableNow=True).start()
        query.awaitTermination()
        return growth.late_rows(query)

    read = lambda: sorted((r["day"].day, r["weight"]) for r in growth.read_daily(spark, out, ["pair"]).collect())
    assert run(1, 1, 2, 4) == 0
    assert read() == [(1, 2), (2, 1), (4, 1)]
    assert run(4, 5, 1) == 1
    assert read() == [(1, 2), (2, 1), (4, 2), (5, 1)]


def test_rescan_renews_the_snapshot(spark, tmp_path):
    from tidewire.operators.alerts import read_snapshot

    edges = str(tmp_path / "edges")
    spark.createDataFrame([("Person", "P", "LOCATED_AT", "Location", "K", 20)],
                          "src_label string, src string, rel_type string, dst_label string, dst string, weight bigint"
                          ).write.parquet(edges)
    scan = growth.rescan(edges, str(tmp_path / "snapshot"))
    for batch_id in (0, 1):
        scan(spark.range(1), batch_id)
    found = read_snapshot(spark, str(tmp_path / "snapshot")).collect()
    assert len(found) == 1 and found[0]["active_threats"][0]["severity"] == "CRITICAL"


def test_growth_alerts_are_raised_changed_and_withdrawn(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", growth.STATE_STORE)

    def run(*events):
        rows = session.createDataFrame([(k, f"2026-01-{d:02d} 10:00:00") for k, d in events], "pair string, t string")
        rows.select("pair", F.to_timestamp("t").alias("ts")).coalesce(1).write.mode("append").parquet(source)
        stream = session.readStream.schema("pair string, ts timestamp").parquet(source)
        query = growth.alert_job(stream, ["pair"], out, state, late="36 hours").trigger(availableNow=True).start()
        query.awaitTermination()
        found = growth.read_raised(spark, out, ["pair"]).collect()
        return sorted((r["pair"], r["day"].day, r["weight"], r["previous"]) for r in found), query

    assert run(("a", 1), ("a", 2), ("a", 2), (None, 1), ("b", 2))[0] == [("a", 2, 2, 1)]
    # Another event of the day before withdraws the alert, one more of the day raises none.
    assert run(("a", 1))[0] == []
    assert run(("a", 2), ("a", 2))[0] == [("a", 2, 4, 2)]
    # Days before the watermark's are forgotten and their late events dropped; what was raised stays.
    found, query = run(("a", 9), ("b", 9))
    assert found == [("a", 2, 4, 2)]
    found, query = run(("a", 1), ("a", 10), ("a", 10))
    assert found == [("a", 2, 4, 2), ("a", 10, 2, 1)]
    assert growth.late_rows(query) == 1


def test_edges_of_a_stream_add_up_and_repeats_change_nothing(spark, tmp_path):
    from tidewire.operators.weights import EdgeWeights
    from tidewire.session import scratch_root
    from tidewire.streaming import edges
    from pathlib import Path

    source, out = str(tmp_path / "topic"), str(tmp_path / "out")

    def run(state, *records):
        if records:
            spark.createDataFrame(lines(*records), "value string").coalesce(1).write.mode("append").text(source)
        edges.edge_job(topic.subscribe_files(spark, source, 1), out, str(tmp_path / state)).trigger(
            availableNow=True).start().awaitTermination()
        return {(r["src"], r["rel_type"], r["dst"]): r["weight"] for r in EdgeWeights(spark, out).read().collect()}

    one = {"record_id": "1", "url": "u", "persons": ["ann"], "organizations": ["org"], "themes": ["T"]}
    first = run("state", one)
    assert first == {("ann", "MENTIONED_IN", "u"): 1, ("org", "MENTIONED_IN", "u"): 1,
                     ("ann", "ASSOCIATED_WITH", "org"): 1, ("u", "HAS_THEME", "T"): None}
    both = run("state", one | {"record_id": "2"}, )
    assert both[("ann", "ASSOCIATED_WITH", "org")] == 2 and both[("u", "HAS_THEME", "T")] is None
    # Replayed from the start, as when the checkpoint of the first batches was lost.
    assert run("again") == both
    assert not list(Path(scratch_root(spark)).glob("passing-*/*"))


def test_open_days_of_a_pair_cost_one_read_and_one_write_per_batch():
    calls = []

    class State:
        held = None

        def get(self):
            calls.append("get")
            return self.held

        def update(self, value):
            calls.append("update")
            self.held = value

    class Handle:
        def getValueState(self, name, schema):
            return State()

        def registerTimer(self, at):
            calls.append(at)

    state = growth.GrowthState(["pair"], 1.5)
    state.init(Handle())
    rows = [{"day": d, "weight": 1 + (d % 2)} for d in range(10, 20)]
    found = list(state.handleInputRows(("a",), iter(rows), None))
    assert [(r["day"], r["weight"], r["previous"]) for r in found] == [(d, 2, 1) for d in range(11, 20, 2)]
    assert calls == ["get", "update", 12 * growth.DAY_MS]
    # Days that come later need no other timer.
    list(state.handleInputRows(("a",), iter([{"day": 20, "weight": 1}]), None))
    assert calls[3:] == ["get", "update"]


def test_published_files_are_compressed(spark, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("topic", "out", "state"))
    rows = [{"record_id": str(i), "persons": ["somebody with a long name"] * 9} for i in range(300)]
    records = spark.createDataFrame([(r["record_id"], r["persons"]) for r in rows], "record_id string, persons array<string>").coalesce(1)
    topic.publish_files(records, source)
    files = [f for f in (tmp_path / "topic").iterdir() if f.name.startswith("part-")]
    assert files and all(f.suffix == ".gz" for f in files)
    assert sum(f.stat().st_size for f in files) * 4 < sum(len(json.dumps(r)) for r in rows)
    enrich.enrichment(topic.subscribe_files(spark, source, 1), out, state, available_now=True).start().awaitTermination()
    assert sorted(r["record_id"] for r in enrich.read_enriched(spark, out).collect()) == sorted(r["record_id"] for r in rows)


def test_stream_graph_gathers_the_reports_once(spark, tmp_path, monkeypatch):
    from tidewire.plans import queries, views

    rows = [
        ("r1", "u1", "GDELT", "x", "20260101", ["Mr A,1"], ["B#1"], ["1#C#XX"], ["T,1"], "1", "1997-01-01 00:00:00", "P", 1),
        ("r2", "u2", "PIB", "x", "20260102", ["A"], ["B#1"], None, None, None, "1999-01-01 00:00:00", "O", 2),
    ]
    names = ("record_id string, url string, source string, source_name string, date string, persons array<string>, organizations array<string>, "
             "locations array<string>, themes array<string>, tone string, t string, status string, order_key bigint")
    reports, made = spark.createDataFrame(rows, names).withColumn("ingestion_timestamp", F.to_timestamp("t")).drop("t"), []
    monkeypatch.setattr(views.Views, "reports", lambda self: (made.append(1), reports)[1])
    found = {(r["src"], r["rel_type"], r["dst"]): r["weight"] for r in queries.REGISTRY["stream_graph"](spark, str(tmp_path)).collect()}
    # The report that is in progress comes twice.
    assert found == {
        ("A", "MENTIONED_IN", "u1"): 2, ("B#1", "MENTIONED_IN", "u1"): 2, ("A", "MENTIONED_IN", "u2"): 1, ("B#1", "MENTIONED_IN", "u2"): 1,
        ("A", "ASSOCIATED_WITH", "B#1"): 3,
    }
    assert len(made) == 1
