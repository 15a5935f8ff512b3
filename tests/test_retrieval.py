"""Matching, expansion, ranking, fusion and citations against brute force."""

import random
from collections import defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewire.operators import cards, evidence, expand, inspect, nameindex, ranking
from tidewire.session import scratch_root

EDGES = "src_label string, src string, rel_type string, dst_label string, dst string, weight bigint"
TARGETS = "target_id bigint, target string"
CARDS = "target_id bigint, part int, hop int, url string, card string"


def mention(entity, url, label="Person"):
    return (label, entity, "MENTIONED_IN", "Article", url, 1)


def tie(a, b, rel="ASSOCIATED_WITH"):
    return ("Person", a, rel, "Organization", b, 1)


def anchors_of(spark, *rows):
    return spark.createDataFrame(list(rows), "anchor_label string, anchor string")


def test_match_equals_brute_force(spark):
    rng = random.Random(1)
    names = sorted({"".join(rng.choice("abAB é#") for _ in range(rng.randrange(1, 9))) for _ in range(150)})
    needles = sorted({"".join(rng.choice("ab é#") for _ in range(rng.randrange(0, 5))) for _ in range(60)} | {"zzz"})
    got = expand.match_substring(
        spark.createDataFrame([("Person", n) for n in names], "label string, key string"),
        spark.createDataFrame([(n,) for n in needles + needles[:5]], "needle string"),
    )
    rows = [(r["needle"], r["key"]) for r in got.collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == {(n, k) for n in needles for k in names if n in k.lower()}


def test_targets_are_unquoted_and_labelled(spark):
    nodes = spark.createDataFrame([("Person", "Kabul Khan"), ("Article", "kabul"), ("Location", "Delhi")], "label string, key string")
    targets = spark.createDataFrame([(1, "'\"KABUL\"'"), (2, "none")], TARGETS)
    assert [tuple(r) for r in expand.resolve_targets(targets, nodes).collect()] == [(1, "'\"KABUL\"'", "Person", "Kabul Khan")]
    assert expand.resolve_targets(targets, nodes, quotes=False).count() == 0


def test_chain(spark):
    edges = spark.createDataFrame([mention("A", "a1"), ("Article", "a1", "HAS_THEME", "Theme", "T", None),
                                   ("Article", "a2", "HAS_THEME", "Theme", "T", None)], EDGES)
    start = anchors_of(spark, ("Person", "A"))
    reach = lambda f, h: {r["key"]: r["hop"] for r in f(edges, start, h).collect()}
    for f in (expand.expand, expand.nearest):
        assert reach(f, 1) == {"a1": 1} and reach(f, 2) == {"a1": 1} and reach(f, 3) == {"a1": 1, "a2": 3}
    with pytest.raises(ValueError):
        expand.expand(edges, start, 6)


def brute(edges, anchors, hops):
    near = defaultdict(set)
    for a, b, _, c, d, _ in edges:
        near[(a, b)].add((c, d))
        near[(c, d)].add((a, b))
    out = {}
    for anchor in anchors:
        seen, frontier = {anchor: 0}, {anchor}
        for hop in range(1, hops + 1):
            frontier = {m for n in frontier for m in near[n]} - set(seen)
            seen.update({n: hop for n in frontier})
        for (label, key), hop in seen.items():
            if label == "Article" and hop:
                out[(*anchor, key)] = hop
    return out


@pytest.mark.parametrize("seed, hops, limit", [(1, 3, 2), (2, 3, 5), (3, 5, 4), (4, 2, 3), (5, 4, 100)])
def test_expansion_equals_brute_force(spark, seed, hops, limit):
    rng = random.Random(seed)
    rows = [mention(f"p{int(rng.paretovariate(1)) % 90}", f"a{rng.randrange(70):02d}") for _ in range(130)]
    rows += [mention("hub", f"a{i:02d}") for i in range(0, 70, 2)]
    rows += [tie(f"p{rng.randrange(90)}", f"o{rng.randrange(8)}") for _ in range(25)]
    rows += [mention(f"o{rng.randrange(8)}", f"a{rng.randrange(70):02d}", "Organization") for _ in range(12)]
    anchors = [("Person", f"p{i}") for i in range(80)] + [("Person", "hub"), ("Organization", "o1")]
    edges, start = spark.createDataFrame(rows, EDGES), anchors_of(spark, *anchors, *anchors[:3])
    want = brute(rows, anchors, hops)
    full = expand.expand(edges, start, hops).collect()
    assert {(r["anchor_label"], r["anchor"], r["key"]): r["hop"] for r in full} == want and len(full) == len(want)
    groups = defaultdict(list)
    for (label, anchor, url), hop in want.items():
        groups[(label, anchor)].append((hop, url))
    ranked = {(*a, u, h, i) for a, g in groups.items() for i, (h, u) in enumerate(sorted(g)[:limit], 1)}
    first = expand.nearest(edges, start, hops, limit).collect()
    assert {(r["anchor_label"], r["anchor"], r["key"], r["hop"], r["rank"]) for r in first} == ranked


@pytest.mark.parametrize("fan", [2, 8])
def test_kept_lists_give_what_fresh_ones_give(spark, tmp_path, fan):
    from tidewire.operators.adjacency import ShortLists

    rng = random.Random(fan)
    rows = [mention(f"p{int(rng.paretovariate(1)) % 40}", f"a{rng.randrange(60):02d}") for _ in range(150)]
    rows += [mention("hub", f"a{i:02d}") for i in range(60)]
    rows += [tie(f"p{rng.randrange(40)}", f"o{rng.randrange(5)}") for _ in range(20)]
    rng.shuffle(rows)
    edges = spark.createDataFrame(rows, EDGES)
    anchors = anchors_of(spark, *[("Person", f"p{i}") for i in range(40)], ("Person", "hub"))
    kept = ShortLists(spark, str(tmp_path / "lists"), limit=6, fan=fan)
    for batch in range(5):
        kept.add(batch, spark.createDataFrame(rows[batch::5], EDGES))
    kept.table.write(5, expand.short_lists(spark.createDataFrame(rows[0::5], EDGES), 6))
    lists = kept.read()
    most = lists.groupBy("near_label", "near").count().agg({"count": "max"}).first()[0]
    assert most == expand.short_list_length(6)
    same = lambda nearby: sorted(map(tuple, expand.nearest(edges, anchors, 3, 6, nearby=nearby).collect()))
    assert same(lists) == same(None)


def test_limit_per_anchor(spark):
    edges = spark.createDataFrame([mention("A", f"a{i:02d}") for i in range(30)], EDGES)
    rows = expand.nearest(edges, anchors_of(spark, ("Person", "A"))).orderBy("rank").collect()
    assert [r["key"] for r in rows] == [f"a{i:02d}" for i in range(25)]


def test_numbers_of_large_groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i) for i in rng.sample(range(5000), 2000)]
    df = spark.createDataFrame(rows, "g int, v int").repartition(7)
    got = {(r["g"], r["v"]): r["id"] for r in ranking.number_rows(df, "g", ["v"]).collect()}
    for g in (1, 2, 3):
        for i, v in enumerate(sorted(v for h, v in rows if h == g), 1):
            assert got[(g, v)] == i


def test_cards(spark):
    people = [f"Mr P{i},{i}" for i in (3, 1, 1, 0, 2, 5, 4)]
    rows = [("u1", "old", "20250101", "2,0", "GDELT", "s", ["X"], [], [], "a", "2025-01-01"),
            ("u1", "t", "20260101", "2,0", "GDELT", "s", people, [], ["USPEC_A_B", "A_B,1", "C"], "b", "2026-01-01"),
            ("u2", "t", None, None, None, None, None, None, None, "c", None)]
    records = spark.createDataFrame(rows, "url string, title string, date string, tone string, source string, source_name string, "
                                    "persons array<string>, organizations array<string>, themes array<string>, record_id string, t string")
    records = records.withColumn("ingestion_timestamp", F.col("t").cast("timestamp"))
    found = cards.article_cards(records.select("url").distinct(), records).collect()
    assert {r["url"]: r["source"] for r in found} == {"u1": "GDELT", "u2": "Unknown Source"}
    got = {r["url"]: r["card"] for r in found}
    assert got["u1"] == ("TYPE: Article | SOURCE: GDELT | DATE: 2026-01-01 | SENTIMENT: Positive\nURL: u1\n"
                         "KEY PERSONS: P3, P1, P0, P2, P5\nORGANIZATIONS: None\nTHEMES: A B, C")
    assert got["u2"].startswith("TYPE: Article | SOURCE: Unknown Source | DATE: Unknown | SENTIMENT: Unknown")


def test_keywords(spark):
    targets = spark.createDataFrame([(1, "tell about the Kabul army  base today"), (2, "kabul"), (3, "two words")], TARGETS)
    found = spark.createDataFrame([(3, 0, 1, "u", "x" * 120)], CARDS)
    lacking = evidence.needs_keywords(targets, found)
    assert [r["target_id"] for r in lacking.collect()] == [1]
    assert [(r["part"], r["target"]) for r in evidence.keyword_requests(lacking).orderBy("part").collect()] == [
        (1, "kabul"), (2, "army"), (3, "base")]


def test_fuse(spark):
    whole = spark.createDataFrame([], CARDS)
    more = spark.createDataFrame([(1, 1, 1, "u1", "A\nx"), (1, 1, 2, "u2", "B\nx"), (1, 2, 1, "u2", "B\nx"),
                                  (1, 2, 2, "u3", "C\nx"), (1, 3, 1, "u4", "D\nx")], CARDS)
    urls = lambda df: sorted((r["part"], r["url"]) for r in df.collect())
    assert urls(evidence.fuse(whole, more)) == [(1, "u1"), (1, "u2"), (2, "u3"), (3, "u4")]
    assert urls(evidence.fuse(whole, more, compat="first_line")) == [(1, "u1"), (1, "u2"), (3, "u4")]
    later = [(1, 4, 1, "u5", "D\ny"), (1, 5, 1, "u6", "E\nx"), (2, 5, 1, "u7", "A\nx")]
    more = more.unionByName(spark.createDataFrame(later, CARDS))
    known = spark.createDataFrame([(2, 0, 1, "u0", "Z\nx")], CARDS)
    assert urls(evidence.fuse(known, more, compat="first_line")) == [(0, "u0"), (1, "u1"), (1, "u2"), (3, "u4"), (5, "u6"), (5, "u7")]


def test_evidence_and_citations(spark):
    graph_cards = spark.createDataFrame(
        [(1, 0, 1, "b", "TYPE: Article | SOURCE: S T | Liverpool", "S T"), (1, 0, 1, "a", " ", "x"), (1, 12, 2, "", "SOURCE: E", "E"),
         (2, 0, 1, "z", "SOURCE: Z", "Z")], CARDS + ", source string")
    live = spark.createDataFrame([(1, 1, "l", "d.x", "TYPE: Live Article | SOURCE: d.x |")],
                                 "target_id bigint, position int, url string, domain string, card string")
    rows = evidence.with_live(graph_cards, live)
    found = evidence.evidence(rows)
    assert sorted((r["target_id"], r["id"], r["url"], r["source"], r["live"]) for r in found.collect()) == [
        (1, 1, "b", "S T", False), (1, 2, "", "E", False), (1, 3, "l", "d.x", True), (2, 1, "z", "Z", False)]
    text = evidence.evidence(rows, compat="text").filter("id = 1 and target_id = 1").first()
    assert (text["source"], text["live"]) == ("S", True)
    answers = spark.createDataFrame([(1, "see [1] and [2], [7]")], "target_id bigint, answer string")
    assert sorted((r["id"], r["url"]) for r in evidence.cited_sources(found, answers).collect()) == [(1, "b"), (3, "l")]


def test_deep_context(spark):
    targets = spark.createDataFrame([(1, "a"), (2, "b")], TARGETS)
    hits = spark.createDataFrame([(1, "", 1), (1, "http://x", 2), (1, "http://y", 3)], "target_id bigint, url string, hop int")
    text = spark.createDataFrame([("http://x", "body")], "url string, text string")
    got = {r["target_id"]: r["context"] for r in evidence.deep_context(targets, hits, text, 2).collect()}
    assert got == {1: "Stored articles\n\nSOURCE URL: http://x\nCONTENT:\nbody\n\n---\n\n", 2: "NO_DEEP_CONTEXT_FOUND"}


def test_merge_urls(spark):
    schema = "query_id int, url string, rank int"
    first = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], schema)
    second = spark.createDataFrame([(1, "b", 1), (1, "d", 2), (1, "e", 3)], schema)
    got = evidence.merge_urls(first, second).orderBy("position").collect()
    assert [r["url"] for r in got] == ["a", "b", "c", "d"]


def test_last_messages(spark):
    rows = [(1, t, "user" if t % 2 else "system", str(t)) for t in range(8)]
    df = evidence.last_messages(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"))
    assert [(r["turn"], r["role"]) for r in df.orderBy("turn").collect()] == [
        (3, "user"), (4, "assistant"), (5, "user"), (6, "assistant"), (7, "user")]


def test_inspection(spark):
    nodes = spark.createDataFrame([("Article", "u1", "T1"), ("Theme", "ARMED", None), ("Location", "United States", None)],
                                  "label string, key string, title string")
    edges = spark.createDataFrame([("Article", "u1", "HAS_THEME", "Theme", "ARMED", None)], EDGES)
    assert [r["key"] for r in inspect.search_nodes(nodes, "united", "Location").collect()] == ["United States"]
    assert [(r["far"], r["title"]) for r in inspect.theme_neighbours(edges, nodes, "ARM").collect()] == [("u1", "T1")]
    assert inspect.theme_neighbours(edges, nodes, "arm").count() == 0
    shown = inspect.sample_properties(nodes, None, ["Article", "Theme"])
    assert shown.count() == 0 and inspect.sample_properties(nodes, "Article").first()["shown"] == "T1"


def test_scratch_folder_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert scratch_root(spark).startswith(named.rstrip("/")) if named else scratch_root(spark)


def index_rows(index, spark, needles):
    got = [tuple(r) for r in index.match(spark.createDataFrame([(n,) for n in needles], "needle string")).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_names_from_a_kept_index(spark, tmp_path):
    rng = random.Random(4)
    names = sorted({"".join(rng.choice("abAB é#") for _ in range(rng.randrange(1, 9))) for _ in range(90)} | {"", "a\u0001b"})
    needles = sorted({"".join(rng.choice("ab é#") for _ in range(rng.randrange(0, 5))) for _ in range(40)} | {"zzz", "\u0001", "a\u0001b"})
    index = nameindex.NameIndex(spark, str(tmp_path), fan=2)
    frame = lambda some: spark.createDataFrame([("Person", n) for n in some] + [("Person", None)], "label string, key string")
    want = lambda some: {(n, "Person", k) for n in needles for k in some if k and n in k.lower()}
    assert index.add(0, frame(names[:40])) and index.add(0, frame(names[:50]))
    assert index_rows(index, spark, [*needles, *needles[:3], None]) == want(names[:50])
    assert index.add(1, frame(names[30:]))
    assert not index.add(0, frame(["other"]))
    assert [e["level"] for e in index.pieces.manifest()["live"]] == [1]
    assert index.add(2, frame(names[:2]))
    assert index_rows(index, spark, needles) == want(names)


def test_a_lookup_reads_no_other_folders(spark, tmp_path):
    index = nameindex.NameIndex(spark, str(tmp_path))
    index.add(0, spark.createDataFrame([("Person", f"name {i:04}") for i in range(400)], "label string, key string"))
    home = spark.range(1).select(nameindex._bucket(F.lit("123"))).first()[0]
    for file in tmp_path.glob("pieces/**/*.parquet"):
        if f"bucket={home}" != file.parent.name:
            file.write_bytes(b"no parquet")
    assert index_rows(index, spark, ["123"]) == {("123", "Person", "name 0123")}
    targets = spark.createDataFrame([(1, "'123'")], TARGETS)
    assert [tuple(r) for r in index.resolve(targets).collect()] == [(1, "'123'", "Person", "name 0123")]


def test_entries_behind_the_densest_list_are_not_made_into_rows(spark):
    from tidewire.operators import expand

    near = [("Theme", "dense", f"u{i}", "Article") for i in range(5)] + [("Theme", "thin", f"u{i}", "Article") for i in (2, 7, 8)]
    lists = expand._end_lists(spark.createDataFrame(near, "near_label string, near string, far string, far_label string"))
    frontier = spark.createDataFrame(
        [(1, "Theme", "dense"), (1, "Theme", "thin"), (2, "Theme", "thin")], "anchor_id bigint, label string, key string"
    )
    found = expand._first_ends(frontier, lists, 3, 1).collect()
    # The fourth entry of the dense list ends the first anchor's; the second has no list as long as that.
    assert sorted((r["anchor_id"], r["key"]) for r in found) == [
        (1, "u0"), (1, "u1"), (1, "u2"), (1, "u2"), (1, "u3"), (2, "u2"), (2, "u7"), (2, "u8")]


def test_anchors_are_numbered_in_order(spark):
    from tidewire.operators import expand

    rows = [(label, f"{i:03d}") for i in range(40) for label in ("Theme", "Person")]
    found = expand._numbered(spark.createDataFrame(rows, "anchor_label string, anchor string").repartition(7)).collect()
    order = [(r["anchor_label"], r["anchor"]) for r in sorted(found, key=lambda r: r["anchor_id"])]
    assert order == sorted(rows)


def test_short_lists_of_a_large_table_sort_few_links_of_hubs(spark, monkeypatch):
    rows = [mention(f"hub{i % 2}", f"u{i:04}") for i in range(900)] + [mention("hub0", f"u{i:04}") for i in range(80)]
    rows += [mention(f"thin{i % 30}", f"u{i * 7 % 900:04}") for i in range(90)] + [mention("hub1", None), mention(None, "u0001")]
    edges = spark.createDataFrame(rows, EDGES)
    as_set = lambda df: sorted(map(str, df.collect()))
    want = as_set(expand.short_lists(edges, 2).distinct())
    sorted_links = []
    plain = expand.cut_lists
    monkeypatch.setattr(expand, "cut_lists", lambda links, length: sorted_links.append(links.count()) or plain(links, length))
    monkeypatch.setattr(expand, "MANY_LINKS", 1)
    found = as_set(expand.short_lists(edges, 2))
    assert found == want and len(found) == len(set(found))
    # A thirty-second of the links, and after that those of nodes that have no whole list yet.
    assert len(sorted_links) == 2 and sum(sorted_links) < len(rows) / 4
    assert as_set(expand.short_lists(edges.filter("dst is null"), 2)) == ["Row(near_label='Person', near='hub1', far_label='Article', far=None)"]


def test_lists_are_joined_once_their_bound_is_known(spark):
    lists = expand._end_lists(spark.createDataFrame([("Theme", "t", "u", "Article")], "near_label string, near string, far string, far_label string"))
    frontier = spark.createDataFrame([(1, "Theme", "t")], "anchor_id bigint, label string, key string")
    plan = expand._first_ends(frontier, lists, 3, 1)._jdf.queryExecution().optimizedPlan().toString()
    # The outermost join is that of the lists, so no array travels by its anchor.
    assert "key#" in plan.split("Join", 2)[1].split("\n", 1)[0]


def test_counted_expansion_equals_rows_of_many_blocks(spark):
    """More anchors than one row's words hold, some of them hubs, over several tasks; no row per anchor and article is made."""
    n = 1100
    links = [("Article", f"a{(7 * i + k * k) % 300:03d}", "HAS_THEME", "Theme", f"t{i}", None) for i in range(n) for k in range(1 + i % 3)]
    links += [("Person", f"p{i % 3}", "MENTIONED_IN", "Article", f"a{i:03d}", 1) for i in range(0, 300, 2)]
    edges = spark.createDataFrame(links, "src_label string, src string, rel_type string, dst_label string, dst string, weight bigint").repartition(5)
    anchors = spark.createDataFrame([("Theme", f"t{i}") for i in range(n)] + [("Person", "p1")], "anchor_label string, anchor string")
    rows = expand.expand(edges, anchors, 3).collect()
    want = {}
    for r in rows:
        want.setdefault((r["anchor_label"], r["anchor"], r["hop"]), []).append(r["key"])
    assert any(hop == 3 for *_, hop in want) and len(rows) == len(set(rows))
    counted = expand.expand(edges, anchors, 3, counted=True)
    got = {(r["anchor_label"], r["anchor"], r["hop"]): (r["targets"], r["first_key"], r["last_key"]) for r in counted.collect()}
    assert got == {k: (len(keys), min(keys), max(keys)) for k, keys in want.items()}
    plain = reach_by_walking(links, [("Theme", "t0"), ("Theme", "t1099"), ("Person", "p1")], 3)
    assert {k: sorted(keys) for k, keys in want.items() if k[1] in ("t0", "t1099", "p1")} == plain


def reach_by_walking(links, anchors, hops):
    near = {}
    for a, b, _, c, d, _ in links:
        near.setdefault((a, b), set()).add((c, d))
        near.setdefault((c, d), set()).add((a, b))
    out = {}
    for anchor in anchors:
        seen = at = {anchor}
        for hop in range(1, hops + 1):
            at = {y for x in at for y in near.get(x, ())} - seen
            seen = seen | at
            keys = sorted(key for label, key in at if label == "Article")
            if keys:
                out[(*anchor, hop)] = keys
    return out


def test_tasks_of_a_search_follow_its_rows(spark, monkeypatch):
    """Many links, and many entries around unfinished anchors, are dealt to a given number of tasks; the answer is the same."""
    draw = random.Random(5)
    rows = sorted({("Article", f"a{draw.randrange(90):02d}", "LOCATED_IN", "Location", f"l{draw.randrange(60)}") for _ in range(260)})
    edges = spark.createDataFrame([(*r, None) for r in rows], "src_label string, src string, rel_type string, dst_label string, dst string, weight bigint")
    anchors = anchors_of(spark, *[("Location", f"l{i}") for i in range(0, 60, 7)])
    search = lambda: sorted(map(tuple, expand.nearest(edges, anchors, 3, 8).collect()))
    want = search()
    monkeypatch.setattr(ranking, "PER_TASK", 20)
    monkeypatch.setattr(expand, "MANY_LINKS", 1)
    few, dealt = spark.range(20), []
    assert ranking.dealt(few, 20, "id").rdd.getNumPartitions() == few.rdd.getNumPartitions()
    assert ranking.dealt(few, 999, "id").rdd.getNumPartitions() == 50
    monkeypatch.setattr(expand, "dealt", lambda df, n, *keys: (dealt.append((n, keys)), ranking.dealt(df, n, *keys))[1])
    assert search() == want and [keys for _, keys in dealt] == [("near_label", "near"), ("anchor_id", "label", "key")]
    assert dealt[0][0] == len(rows)
    assert "REPARTITION_BY_NUM" in expand.short_lists(edges, 8)._jdf.queryExecution().executedPlan().toString()


def test_set_bits_of_words(spark):
    """Every bit of a word, the sign among them; a word without any gives none."""
    draw = random.Random(11)
    words = [0, 1, -1, -(1 << 63), (1 << 63) - 1, 1 << 32, *(draw.getrandbits(64) - (1 << 63) for _ in range(40))]
    rows = spark.createDataFrame([(w,) for w in words], "w bigint").select("w", expand._set_bits("w", 128).alias("at")).collect()
    assert {r["w"]: r["at"] for r in rows} == {w: [128 + i for i in range(64) if w >> i & 1] for w in words}


@pytest.mark.parametrize("dense, least", [(512, 50_000), (4, 10), (1, 10)])
def test_targets_of_the_last_step_are_counted_by_parts(spark, monkeypatch, dense, least):
    """As rows of bits or as lists, in one part or many; repeated links count once, targets without a key count but are no first key."""
    from tidewire.operators import reach

    draw = random.Random(3)
    links = [("Article", f"a{draw.randrange(400):03d}", "HAS_THEME", "Theme", f"t{draw.randrange(90)}", None) for _ in range(500)]
    links += [("Person", f"p{i % 4}", "MENTIONED_IN", "Article", f"a{i:03d}", 1) for i in range(0, 400, 3)] + links[:50]
    links += [("Person", "p1", "MENTIONED_IN", "Article", None, 1), ("Person", "lone", "MENTIONED_IN", "Article", None, 1)]
    edges = spark.createDataFrame(links, EDGES).repartition(3)
    anchors = [("Theme", f"t{i}") for i in range(90)] + [("Person", "p1"), ("Person", "lone"), ("Person", "nobody")]
    monkeypatch.setattr(reach, "DENSE", dense)
    monkeypatch.setattr(reach, "LEAST", least)
    monkeypatch.setattr(reach, "AT_ONCE", 3)
    asked = []
    monkeypatch.setattr(expand, "next_targets", lambda *given: (asked.append(given), reach.next_targets(*given))[1])
    for hops in (1, 2, 3):
        want = {}
        for r in expand.expand(edges, anchors_of(spark, *anchors), hops).collect():
            want.setdefault((r["anchor_label"], r["anchor"], r["hop"]), []).append(r["key"])
        found = expand.expand(edges, anchors_of(spark, *anchors), hops, counted=True).collect()
        assert len(asked) == hops
        texts = lambda keys: [k for k in keys if k is not None]
        assert {(r["anchor_label"], r["anchor"], r["hop"]): (r["targets"], r["first_key"], r["last_key"]) for r in found} == {
            k: (len(keys), min(texts(keys), default=None), max(texts(keys), default=None)) for k, keys in want.items()
        }
        assert want[("Person", "lone", 1)] == [None]


def test_a_second_search_looks_for_new_anchors_only(spark, monkeypatch):
    """Targets that share anchors: what was found for an anchor is taken over, nothing found too; the hits are those of searches of their own."""
    draw = random.Random(9)
    rows = [mention(f"p{draw.randrange(12):02d}", f"a{draw.randrange(40):02d}") for _ in range(70)] + [mention("hub", f"a{i:02d}") for i in range(40)]
    edges = spark.createDataFrame(rows, EDGES)
    nodes = spark.createDataFrame([("Person", f"p{i:02d}") for i in range(12)] + [("Person", "hub"), ("Person", "p0none")], "label string, key string")
    first = spark.createDataFrame([(1, "p0"), (2, "hub")], TARGETS)
    second = spark.createDataFrame([(3, "p0"), (4, "p11"), (5, "p0none"), (6, "nobody")], TARGETS)
    asked, searched = [], []
    whole = cards.nearest
    monkeypatch.setattr(cards, "nearest", lambda e, anchors, *rest: (asked.append(sorted(r["anchor"] for r in anchors.collect())), whole(e, anchors, *rest))[1])
    lists = expand.node_lists(edges, 4)
    found = [cards.hits(t, nodes, edges, limit=4, nearby=lists, searched=searched) for t in (first, second)]
    assert asked == [sorted(["hub", "p0none", *[f"p{i:02d}" for i in range(10)]]), ["p11"]]
    for got, targets in zip(found, (first, second)):
        want = cards.hits(targets, nodes, edges, limit=4)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_finished_anchors_take_no_step(spark, monkeypatch):
    """Only an anchor that lacks targets goes on to the nodes around it; those of a hub are not looked up."""
    rows = [mention("hub", f"a{i:02d}") for i in range(9)] + [tie("hub", f"o{i}") for i in range(5)] + [mention("p", "a00"), tie("p", "o1")]
    edges = spark.createDataFrame(rows + [mention("o1", f"a{i:02d}", "Organization") for i in range(9)], EDGES)
    going, step = [], expand._step
    monkeypatch.setattr(expand, "_step", lambda frontier, *rest: (going.append({r["key"] for r in frontier.collect()}), step(frontier, *rest))[1])
    anchors = anchors_of(spark, ("Person", "hub"), ("Person", "p"))
    found = expand.nearest(edges, anchors, 3, 3).collect()
    assert sorted((r["anchor"], r["key"], r["hop"]) for r in found) == [
        ("hub", "a00", 1), ("hub", "a01", 1), ("hub", "a02", 1), ("p", "a00", 1), ("p", "a01", 2), ("p", "a02", 2)
    ]
    assert going == [{"p"}]
    assert expand.nearest(edges, anchors, 3, 1).count() == 2 and len(going) == 1


def test_a_batch_of_edges_is_written_once_for_its_lists(spark, tmp_path, monkeypatch):
    """However often its lists read it; what is cut on the way is gone when the batch is stored."""
    from tidewire.operators import adjacency

    read, made = [], adjacency.short_lists
    monkeypatch.setattr(adjacency, "short_lists", lambda own, *rest: (read.append(own.inputFiles()), made(own, *rest))[1])
    kept = adjacency.ShortLists(spark, str(tmp_path / "lists"), limit=2)
    rows = [mention("A", f"a{i}") for i in range(5)] + [tie("A", "o")]
    assert kept.add(0, spark.createDataFrame(rows, EDGES))
    assert read[0] and all("/passing-" in f and "/batch-edges-" in f for f in read[0])
    assert not any(Path(f.removeprefix("file://")).exists() for f in read[0])
    assert sorted((r["near"], r["far"]) for r in kept.read().collect()) == [("A", f"a{i}") for i in range(3)]
