"""Traps of single functions, with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from tidewire.functions import match, names, pagetext, reports
from tidewire.functions.fixed import ALERT_KEYWORDS, REGIONS
from tidewire.sources.weather import rss_date


def value(spark, column, **inputs):
    types = {str: "string", int: "bigint", float: "double", list: "array<string>", type(None): "string"}
    schema = ", ".join(f"{k} {types[type(v)]}" for k, v in inputs.items()) or "x string"
    rows = [tuple(inputs.values())] if inputs else [("",)]
    return spark.createDataFrame(rows, schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "raw, key",
    [
        ("Mr. John Doe,123", "John Doe"), ("President Jane Roe", "Jane Roe"), ("Ms Alice", "Alice"),
        ("PM Office", "Office"), ("Mr Acme Corp,999", "Acme Corp"), ("PM President X", "X"),
        ("President PM X", "PM X"), ("mr John", "mr John"), (",123", ""),
        ("Ms.  Bo ", "Bo"), ("Mrs Smith", "Mrs Smith"), ("Mr Ms A", "A"), ("Ms Mr A", "Mr A"),
    ],
)
def test_name_key(spark, raw, key):
    assert value(spark, F.expr(names.name_key("c")), c=raw) == key


@pytest.mark.parametrize(
    "raw, key",
    [("US#New York", "New York"), ("Kabul", "Kabul"), ("1#Kabul, Afghanistan#AF#AF13", "Kabul, Afghanistan"), ("1#", "")],
)
def test_location_key(spark, raw, key):
    assert value(spark, F.expr(names.location_key("c")), c=raw) == key


def test_theme_key_only_for_the_news_graph(spark):
    for source, key in (("GDELT", "A"), ("PIB", "A,1"), (None, "A,1")):
        assert value(spark, F.expr(names.theme_key("c")), c="A,1", source=source) == key


def test_split_keeps_the_trailing_empty_and_keys_drop_it(spark):
    assert value(spark, names.split_list(F.col("c")), c="A;B;") == ["A", "B", ""]
    assert value(spark, names.split_list(F.col("c")), c=None) == []
    assert value(spark, names.entity_list("c", names.name_key), c=["A,1", "", "Mr A", ",2", "B"]) == ["A", "B"]


def test_title(spark):
    title = names.article_title(F.col("t"), F.col("s"))
    assert value(spark, title, t="No Title", s="Example Source") == "Report from Example Source"
    assert value(spark, title, t=None, s=None) == "Report from Unknown Source"
    assert value(spark, title, t="Example", s="x") == "Example"


@pytest.mark.parametrize(
    "raw, display",
    [
        ("TAX_FNCACT_TERRORISM,123", "Terrorism"), ("CRISISLEX_C02,456", "C02"),
        ("USPEC_SOMETHING,12", "Something"), ("WB_678_DIGITAL,9", "Wb 678 Digital"),
        ("TAX_WORLDLANGUAGES_O'NEIL_3RD", "O'Neil 3Rd"), ("CO-OP_19B", "Co-Op 19B"), ("", ""),
    ],
)
def test_theme_display(spark, raw, display):
    assert value(spark, names.theme_display(F.col("c")), c=raw) == display


def test_theme_display_can_strip_the_bank_prefix(spark):
    assert value(spark, names.theme_display(F.col("c"), strip_wb=True), c="WB_678_DIGITAL,9") == "Digital"


def test_clean_lists(spark):
    raw = ["A,1", "B,2", "A,3", "C,1", "D,1", "E,1", "F,1"]
    assert value(spark, names.clean_list(F.col("c")), c=raw) == ["A", "B", "C", "D", "E"]
    assert value(spark, names.clean_themes(F.col("c")), c=["USPEC_A,1", "A,2", "B_C"]) == ["A", "B C"]


@pytest.mark.parametrize(
    "raw, display",
    [("20260317", "2026-03-17"), ("20260101000000", "2026-01-01"), ("2026", "2026"), ("", "Unknown"),
     (None, "Unknown"), ("2026-03-17T10:00", "2026-03-17")],
)
def test_date_display(spark, raw, display):
    assert value(spark, reports.date_display(F.col("c")), c=raw) == display


@pytest.mark.parametrize(
    "tone, mood",
    [("1.5,0", "Positive"), ("-1.5", "Negative"), ("1", "Neutral"), ("x", "Unknown"), ("", "Unknown"),
     ("nan", "Neutral"), ("0.2,0,0,0,0,0,0", "Neutral"), (None, "Unknown"), ("1.5f", "Unknown"), ("inf", "Positive")],
)
def test_sentiment(spark, tone, mood):
    assert value(spark, reports.sentiment(F.col("c")), c=tone) == mood


def test_severity_bounds(spark):
    assert [value(spark, reports.severity(F.col("c")), c=w) for w in (6, 15, 16)] == ["HIGH", "HIGH", "CRITICAL"]


def test_summary(spark):
    line = reports.entity_summary(F.col("p"), F.col("o"), F.col("l"), F.col("t"))
    assert value(
        spark, line, p=["Mr. John Doe,123", "President Jane Roe", "Ms Alice"], o=["PM Office", "Mr Acme Corp,999"],
        l=["US#New York", "Kabul"], t=["TAX_FNCACT_TERRORISM,123", "CRISISLEX_C02,456"],
    ) == (
        "Persons: Mr. John Doe,123, President Jane Roe, Ms Alice | Orgs: PM Office, Mr Acme Corp,999 | "
        "Locations: US#New York, Kabul | Themes: TAX_FNCACT_TERRORISM,123, CRISISLEX_C02,456"
    )
    assert value(spark, line, p=[], o=[], l=[], t=[]) == "No entities"
    nulls = [F.lit(None).cast("array<string>")] * 4
    assert value(spark, reports.entity_summary(*nulls)) == "No entities"


def test_alert_words_follow_list_order(spark):
    kind = lambda text: value(spark, match.alert_type(F.col("c"), ALERT_KEYWORDS), c=text)
    assert kind("Red alert: heavy rain and storm") == "Alert"
    assert kind("thunderstorm") == "Thunderstorm"
    assert kind("calm") == "Weather Alert"
    assert value(spark, match.matching(F.col("c"), REGIONS), c="kerala, ASSAM and goa") == ["Assam", "Kerala"]


def test_script(spark):
    assert value(spark, match.has_script(F.col("c")), c="भारत एक महान देश है।") is True
    assert value(spark, match.has_script(F.col("c")), c="India is great") is False


def test_small_text_functions(spark):
    assert value(spark, match.domain(F.col("c")), c="https://h.x/a//b/c") == "b"
    assert value(spark, match.domain(F.col("c")), c="https://h.x/a") == "h.x"
    assert value(spark, match.cited_ids(F.col("c")), c="x [1] y [22] [1] [a] [99999999999]") == [1, 22]
    assert value(spark, match.strip_quotes(F.col("c")), c="'\"kabul\"'") == "kabul"
    assert value(spark, match.card_source(F.col("c")), c="TYPE: Article | SOURCE: Two Words | DATE: x") == "Two"
    assert value(spark, match.card_source(F.col("c")), c="none") == "Unknown"
    assert value(spark, match.card_url(F.col("c")), c="a\nURL: http://x/y\nKEY") == "http://x/y"
    assert value(spark, match.headline(F.col("c")), c="first\nsecond") == "first"
    assert value(spark, match.headline(F.col("c")), c="") == "Untitled page"
    assert value(spark, match.truncate(F.col("c"), 3), c="abcd") == "abc... [TRUNCATED] ..."
    assert value(spark, match.truncate(F.col("c"), 4), c="abcd") == "abcd"


def test_rss_date(spark):
    got = lambda c: value(spark, rss_date(F.col("c"), F.lit("today")), c=c)
    assert got("Tue, 17 Mar 2026 10:00:00 GMT") == "20260317"
    assert got("17/03/2026") == "today" and got(None) == "today"


def test_page_text(spark):
    html = (
        "<html><head><title>t</title></head><body><nav>menu</nav><!-- <p>no</p> --><script>var a='</p>'</script>"
        "<h1>A&nbsp;B</h1><p>x &amp;lt; y &#8217;q&#x27; &copy; &bogus; &<br>next</p><script>open"
    )
    assert value(spark, pagetext.main_text(F.col("c")), c=html) == "A B\nx &lt; y ’q' © &bogus; &\nnext"


def test_class_text_keeps_nested_elements(spark):
    html = '<div class="x">no</div><div id=1 class="big ReleaseText">a<div>b<div>c</div></div>d</div><div>e</div>'
    assert value(spark, pagetext.class_text(F.col("c"), "ReleaseText"), c=html) == "a\nb\nc\nd"
    assert value(spark, pagetext.class_text(F.col("c"), "Release"), c=html) is None


def test_blocks_hold_a_single_string(spark):
    html = "<li>one</li><li><a href='x'>two</a></li><li>a <b>b</b></li><li><br>no</li><link><p> </p>"
    assert value(spark, pagetext.blocks(F.col("c"), "li"), c=html) == ["one", "two"]
    assert value(spark, pagetext.blocks(F.col("c"), "p"), c=html) == []
