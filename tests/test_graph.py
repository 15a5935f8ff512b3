"""Graph tables, pairs, weights and alerts on hand-made records."""

import datetime as dt
import itertools
import random
from collections import Counter

from pyspark.sql import functions as F

from tidewire.functions.fixed import NO_ALERTS
from tidewire.operators import alerts, build, graph, lists, pairs
from tidewire.schemas import EDGE_COLUMNS, MESSAGE
from tidewire.sources import store

EDGES = "src_label string, src string, rel_type string, dst_label string, dst string, weight bigint"


def message(**fields):
    return tuple(fields.get(f.name) for f in MESSAGE.fields)


A1 = message(
    source="GDELT", record_id="1", url="https://example.com/a1", source_name="Example Source",
    date="20260101000000", tone="0.2,0,0,0,0,0,0", ingestion_timestamp="2026-01-01",
    persons=["Mr. John Doe,123", "President Jane Roe", "Ms Alice"],
    organizations=["PM Office", "Mr Acme Corp,999"],
    themes=["TAX_FNCACT_TERRORISM,123", "CRISISLEX_C02,456"], locations=["US#New York", "Kabul"],
)
A2 = message(
    source="GDELT", record_id="2", url="https://example.com/a2", date="20260102000000",
    tone="0,0,0,0,0,0,0", ingestion_timestamp="2026-01-02", persons=["Mr John Doe"],
    organizations=["Acme Corp"], themes=["USPEC_SOMETHING,12"], locations=["IN#Delhi"],
)


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), MESSAGE)


def edge_set(df):
    return {(r["src"], r["rel_type"], r["dst"], r["weight"]) for r in df.collect()}


def test_one_record(spark):
    a1 = frame(spark, A1)
    edges = edge_set(graph.article_edges(lists.keyed(a1)))
    url = "https://example.com/a1"
    assert edges == {
        ("John Doe", "MENTIONED_IN", url, 1), ("Jane Roe", "MENTIONED_IN", url, 1), ("Alice", "MENTIONED_IN", url, 1),
        ("Office", "MENTIONED_IN", url, 1), ("Acme Corp", "MENTIONED_IN", url, 1),
        (url, "LOCATED_IN", "New York", None), (url, "LOCATED_IN", "Kabul", None),
        (url, "HAS_THEME", "TAX_FNCACT_TERRORISM", None), (url, "HAS_THEME", "CRISISLEX_C02", None),
    }
    assert len(edge_set(graph.association_edges(a1))) == 6
    assert graph.article_nodes(a1).first()["title"] == "Report from Example Source"


def test_two_records_share_one_pair(spark):
    found = edge_set(pairs.pair_counts(frame(spark, A1, A2)))
    assert found == {("John Doe", "ASSOCIATED_WITH", "Acme Corp", 2)}


def test_repeated_record_counts_mentions_but_one_report(spark):
    both = frame(spark, A2, A2)
    assert ("John Doe", "MENTIONED_IN", "https://example.com/a2", 2) in edge_set(graph.article_edges(lists.keyed(both)))
    assert edge_set(pairs.pair_counts(graph.latest_reports(both), min_weight=2)) == set()


def test_last_write_wins_with_nulls(spark):
    first = message(url="u", record_id="1", tone="1", ingestion_timestamp="2026-01-01")
    second = message(url="u", record_id="1", tone=None, ingestion_timestamp="2026-01-02")
    assert [r["tone"] for r in graph.article_nodes(frame(spark, second, first)).collect()] == [None]


def test_missing_key_is_rejected(spark):
    df = frame(spark, message(url=None, record_id="1"), message(url="u", record_id="2"))
    assert [r["reason"] for r in graph.rejected(df).collect()] == ["missing url"]
    assert graph.article_nodes(df).count() == 1


def reports(spark, rows):
    return frame(spark, *[message(url=f"u{i}", source="GDELT", record_id=str(i), persons=p, organizations=o, locations=l)
                          for i, (p, o, l) in enumerate(rows)])


def test_pairs_within_a_list(spark):
    df = pairs.pair_counts(reports(spark, [(["C", "A", "B"], [], [])]), [pairs.KNOWS], 1)
    assert sorted((r["src"], r["dst"]) for r in df.collect()) == [("A", "B"), ("A", "C"), ("B", "C")]


def test_threshold_is_inclusive(spark):
    rows = [(["P"], ["A", "B", "C"], []), (["P"], ["B", "C"], []), (["P"], ["C"], [])]
    df = pairs.pair_counts(reports(spark, rows), [pairs.ASSOCIATED], 2)
    assert sorted((r["dst"], r["weight"]) for r in df.collect()) == [("B", 2), ("C", 3)]


def brute_pairs(rows, least):
    counts = Counter()
    for p, o, l in rows:
        p, o, l = set(p), set(o), set(l)
        counts.update(("ASSOCIATED_WITH", a, b) for a in p for b in o)
        counts.update(("LOCATED_AT", a, b) for a in p for b in l)
        counts.update(("OPERATES_IN", a, b) for a in o for b in l)
        counts.update(("KNOWS_OR_COOCCURRED_WITH", a, b) for a, b in itertools.combinations(sorted(p), 2))
    return {(*k, n) for k, n in counts.items() if n >= least}


def test_pairs_in_pieces_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [tuple([f"{k}{rng.randrange(12)}" for _ in range(rng.randrange(9))] for k in "pol") for _ in range(60)]
    df = reports(spark, rows)
    for left, right in ((1, 1), (3, 2), (2, 5), (256, 1024)):
        counted = pairs.pair_rows(df, pairs.ALL_FAMILIES, left, right).groupBy("rel_type", "a", "b").count().filter("count >= 2")
        assert {tuple(r) for r in counted.collect()} == brute_pairs(rows, 2)


def test_long_lists_are_cut_on_both_sides(spark):
    names = lambda k: [f"{k}{i:04d}" for i in range(5000)]
    df = reports(spark, [(names("p"), names("o"), [])])
    found = pairs.pair_rows(df, [pairs.ASSOCIATED, pairs.KNOWS]).groupBy("rel_type").count().collect()
    assert {r["rel_type"]: r["count"] for r in found} == {"ASSOCIATED_WITH": 25_000_000, "KNOWS_OR_COOCCURRED_WITH": 5000 * 4999 // 2}


def test_records_are_routed(spark):
    rows = frame(spark, message(url="u", record_id="1", source="GDELT", persons=["A", "B"], organizations=["O"], locations=["1#K#X"]),
                 message(url="i", record_id="wb", source="WorldBank", persons=["A", "B"], organizations=["World Bank"], locations=["K"], themes=["E"]),
                 message(url="w", record_id=None, source="IMD", locations=["K"]), message(url=None, record_id="2", source="PIB"))
    records = store.conform(rows)
    routed = build.Routed(records)
    made = {(r["src"], r["rel_type"], r["dst"]) for r in routed.edges().collect()}
    assert ("wb", "MEASURED_IN", "K") in made and ("A", "MENTIONED_IN", "u") in made
    assert not any("i" in (s, d) or "w" in (s, d) for s, _, d in made)
    assert {(r["src"], r["dst"]) for r in routed.pairs(min_weight=1).collect()} == {("A", "O"), ("B", "O"), ("A", "K"), ("B", "K"), ("O", "K"), ("A", "B")}
    assert sorted(r["reason"] for r in routed.rejected().collect()) == ["missing record_id", "missing url"]


def test_pair_weights_are_bounded_and_oriented(spark):
    rng = random.Random(5)
    rows = [([f"p{rng.randrange(6)}" for _ in range(4)], [], []) for _ in range(30)]
    for r in pairs.pair_counts(reports(spark, rows), [pairs.KNOWS], 1).collect():
        assert r["src"] < r["dst"] and r["weight"] <= 30


def edge(src, dst, weight, rel="ASSOCIATED_WITH", a="Person", b="Organization"):
    return (a, src, rel, b, dst, weight)


def test_upsert_overwrites_and_keeps_stale(spark):
    stored = spark.createDataFrame([edge("A", "B", 4), edge("E", "F", 9)], EDGES)
    new = spark.createDataFrame([edge("A", "B", 3), edge("C", "D", 2)], EDGES)
    assert {(r["src"], r["weight"]) for r in graph.upsert_weights(stored, new).collect()} == {("A", 3), ("C", 2), ("E", 9)}
    assert {(r["src"], r["weight"]) for r in graph.add_weights(stored, new).collect()} == {("A", 7), ("C", 2), ("E", 9)}
    assert [r["src"] for r in graph.created(stored, new, graph.EDGE_KEY).collect()] == ["C"]


def test_edges_are_stored_by_type(spark, tmp_path):
    rows = [edge("A", "B", 4), edge("A", "K", 9, "LOCATED_AT", b="Location")]
    graph.write_edges(spark.createDataFrame(rows, EDGES), str(tmp_path / "e"))
    back = spark.read.parquet(str(tmp_path / "e"))
    assert set(back.columns) == set(EDGE_COLUMNS) and back.filter("rel_type = 'LOCATED_AT'").count() == 1


def test_alert_bounds_and_snapshot(spark, tmp_path):
    rows = [edge(f"P{w}", "K", w, "LOCATED_AT", b="Location") for w in (5, 6, 15, 16)] + [edge("P", "O", 99)]
    heavy = alerts.heavy_relationships(spark.createDataFrame(rows, EDGES))
    assert [(r["source_entity"], r["weight_score"], r["severity"]) for r in heavy.collect()] == [
        ("K", 16, "CRITICAL"), ("K", 15, "HIGH"), ("K", 6, "HIGH")]
    now = F.lit(dt.datetime(2026, 1, 1))
    path = str(tmp_path / "snapshot")
    empty = alerts.read_snapshot(spark, path).first()
    assert empty["active_threats"] == [] and empty["status"] == NO_ALERTS
    for _ in range(2):
        alerts.write_snapshot(alerts.to_alerts(heavy, "source_entity", "target_entity", "weight_score", now, False), now, path)
    back = alerts.read_snapshot(spark, path).collect()
    assert len(back) == 1 and [t["weight_score"] for t in back[0]["active_threats"]] == [16, 15, 6]


def test_growth_needs_the_day_before(spark):
    rows = [("a", dt.date(2026, 1, d), w) for d, w in ((1, 2), (2, 3), (3, 5), (5, 9))]
    daily = spark.createDataFrame(rows, "pair string, day date, weight bigint")
    assert [r["day"].day for r in alerts.growth(daily, ["pair"]).collect()] == [3]


def test_plain_edges_and_duplicates(spark):
    df = spark.createDataFrame([("r", ["K", "K", "", None], ["T", None])], "record_id string, locations array<string>, themes array<string>")
    assert edge_set(graph.indicator_edges(df)) == {("r", "MEASURED_IN", "K", None), ("r", "HAS_THEME", "T", None)}
    assert edge_set(graph.weather_edges(df)) == {("r", "THREATENS", "K", None)}
    dup = spark.createDataFrame([("x",), ("x",), ("y",)], "key string")
    assert [tuple(r) for r in graph.duplicate_keys(dup, ["key"]).collect()] == [("x", 2)]


def test_rare_names_are_dropped_before_pairs_and_no_pair_is_lost(spark):
    rng = random.Random(11)
    people = [f"P{i}" for i in range(60)]
    rows = [(rng.sample(people, rng.randint(0, 8)), rng.sample(people, rng.randint(0, 5)), []) for _ in range(80)]
    df = reports(spark, rows)
    for least in (2, 4):
        want = Counter()
        for persons, organizations, _ in rows:
            want.update(("ASSOCIATED_WITH", a, b) for a in set(persons) for b in set(organizations))
            want.update(("KNOWS_OR_COOCCURRED_WITH", a, b) for a in set(persons) for b in set(persons) if a < b)
        found = pairs.pair_counts(df, [pairs.ASSOCIATED, pairs.KNOWS], least).collect()
        assert {(r["rel_type"], r["src"], r["dst"]): r["weight"] for r in found} == {k: n for k, n in want.items() if n >= least}
        assert pairs.pair_rows(df, [pairs.KNOWS], min_weight=12).count() < pairs.pair_rows(df, [pairs.KNOWS]).count()


def test_ranges_of_a_long_record_go_to_many_tasks(spark):
    df = reports(spark, [([f"P{i:03}" for i in range(120)], [], [])])
    found = pairs.pair_rows(df, [pairs.KNOWS], 16, 16)
    assert found.distinct().count() == found.count() == 120 * 119 // 2
    assert found.select(F.spark_partition_id()).distinct().count() > 1


def test_stored_keyed_lists_give_the_same_edges(spark):
    from tidewire.operators import graph, lists, pairs

    schema = "url string, source string, persons array<string>, organizations array<string>, locations array<string>, themes array<string>"
    one = ("u", "GDELT", ["Mr. ann,1", "bob,2"], ["org"], ["1#x#Y"], ["T,3"])
    rows = spark.createDataFrame([one, one, ("w", *one[1:]), ("", *one[1:]), (None, *one[1:])], schema)
    ready = lists.stored_keyed(rows)
    edges = {(r["src"], r["dst"]): r["weight"] for r in graph.article_edges(ready).collect()}
    assert edges == {("ann", "u"): 2, ("bob", "u"): 2, ("org", "u"): 2, ("u", "x"): None, ("u", "T"): None,
                     ("ann", "w"): 1, ("bob", "w"): 1, ("org", "w"): 1, ("w", "x"): None, ("w", "T"): None}
    both = [sorted(tuple(r) for r in pairs.pair_counts(x, min_weight=2, ready=x is ready).collect()) for x in (rows, ready)]
    assert both[0] == both[1] and both[0]


def test_lists_of_single_urls_do_not_travel(spark):
    schema = "url string, source string, persons array<string>, organizations array<string>, locations array<string>, themes array<string>"
    ready = lists.stored_keyed(spark.createDataFrame([("u", "GDELT", ["ann"], ["org"], ["x"], ["t"])], schema))
    plan = graph.article_edges(ready)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "LeftAnti" in plan


def test_tasks_that_gather_reports_grow_with_the_lines(spark, tmp_path, monkeypatch):
    from tidewire.plans import views

    for name in ("lineitem", "orders", "part", "supplier", "nation"):
        (tmp_path / f"{name}.parquet").symlink_to(f"/root/testdata/sf0.001/{name}.parquet")
    plain = sorted(map(str, views.Views(spark, str(tmp_path)).reports().collect()))
    monkeypatch.setattr(views, "GATHERED", 500)
    dealt = views.Views(spark, str(tmp_path)).reports()
    n = spark.read.parquet(f"{tmp_path}/lineitem.parquet").count() // 500 + 1
    assert n > 8
    assert f", {n}), REPARTITION_BY_NUM" in dealt._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, dealt.collect())) == plain


def test_only_reports_of_repeated_urls_are_compared(spark, monkeypatch):
    """The newest version of every url; urls with one record keep it without an aggregate over it."""
    rows = [(f"u{i}", f"id{i}-{k}", "GDELT", [f"p{i}", None] if k else None, ["o"], [], None, f"2026-01-0{1 + (i + k) % 3}")
            for i in range(12) for k in range(1 + (i % 4 == 0) * 2)]
    rows += [(None, "x", "GDELT", [], [], [], [], None), ("", "y", "GDELT", [], [], [], [], None), ("same", None, None, ["a"], [], [], [], None), ("same", None, None, ["b"], [], [], [], None)]
    schema = ("url string, record_id string, source string, persons array<string>, organizations array<string>, locations array<string>, "
              "themes array<string>, ingestion_timestamp string")
    records = spark.createDataFrame(rows, schema).withColumn("ingestion_timestamp", F.to_timestamp("ingestion_timestamp"))
    want = sorted(map(str, graph.latest_reports(records).collect()))
    compared, written = [], graph.last_written
    monkeypatch.setattr(graph, "last_written", lambda df, *a: (compared.append(df.count()), written(df, *a))[1])
    found = graph.latest_reports(records, ready=True)
    assert sorted(map(str, found.collect())) == want and len(want) == 13
    assert compared == [3 * 3 + 2]
