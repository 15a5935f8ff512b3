"""The same queries as plain SQL over the tables, one text per query."""

from __future__ import annotations

from ..functions.fixed import CARD_SEPARATOR, DEEP_HEADER, NAME_PREFIXES, NO_CARDS, NO_DEEP, NO_LIVE, STREAM_TERMS
from .views import ANSWER, DOCUMENT_KEYWORDS, DOCUMENT_REGIONS, LONG_TARGET, STORED_UNTIL, TARGETS


def text(s: str) -> str:
    """A string literal; line breaks become chr(10)."""
    parts = ["'" + p.replace("'", "''") + "'" for p in s.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")"


def name_key(x: str) -> str:
    out = f"split_part({x}, ',', 1)"
    for p in NAME_PREFIXES:
        out = f"regexp_replace({out}, '^{p.replace('.', '[.]')}', '')"
    return f"trim({out})"


SQL: dict[str, str] = {}

CTE: dict[str, tuple[list[str], str]] = {}


def cte(name: str, needs: list[str], body: str) -> None:
    CTE[name] = (needs, body)


def sql(name: str, needs: list[str], body: str) -> None:
    """Registers a query; the CTEs it needs are put before it in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for m in CTE[n][0]:
            visit(m)
        order.append(n)

    for n in needs:
        visit(n)
    head = "with " + ",\n".join(f"{n} as ({CTE[n][1]})" for n in order) + "\n" if order else ""
    SQL[name] = head + body


# --- views ---------------------------------------------------------------------------------

cte("lists", [], """
  select l_orderkey,
    list_sort(list(distinct case s_suppkey % 4 when 0 then 'Mr. ' when 1 then 'President '
      when 2 then '' else 'Ms ' end || s_name || ',' || cast(s_suppkey as varchar))) as persons,
    list_sort(list(distinct p_brand)) as organizations,
    list_sort(list(distinct '1#' || n_name || '#XX')) as locations,
    list_sort(list(distinct p_type || ',' || cast(p_partkey as varchar))) as themes,
    cast(round(max(l_discount) * 100) as int) - 5 as tone_i
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey
    join nation on s_nationkey = n_nationkey group by l_orderkey""")

cte("v_reports", ["lists"], """
  select 'ord-' || cast(o_orderkey as varchar) as record_id,
    'https://example.com/o/' || cast(o_orderkey as varchar) as url,
    case o_orderkey % 10 when 7 then 'PIB' else 'GDELT' end as source,
    o_orderpriority as source_name, strftime(o_orderdate, '%Y%m%d%H%M%S') as date,
    persons, organizations, locations, themes,
    cast(tone_i as varchar) || ',0,0,0,0,0,0' as tone, o_orderdate as ingestion_timestamp,
    o_orderstatus as status, o_orderkey as order_key
  from orders left join lists on o_orderkey = l_orderkey""")

cte("v_repeats", ["v_reports"], """
  select * from v_reports
  union all
  select * replace (cast(null as varchar) as tone,
    ingestion_timestamp + interval 1 day as ingestion_timestamp)
  from v_reports where status = 'P'""")

cte("v_linked", ["v_reports"], """
  select v.* replace (coalesce(p.url, v.url) as url)
  from v_reports v left join pages p on v.order_key = p.page_id""")

cte("v_indicators", [], """
  select 'wb-' || cast(c_nationkey as varchar) || '-' || c_mktsegment || '-' ||
      cast(year(o_orderdate) as varchar) as record_id,
    n_name as country, c_nationkey as code, c_mktsegment as indicator_name,
    cast(year(o_orderdate) as varchar) as yr, cast(count(*) as double) as value
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
  group by c_nationkey, n_name, c_mktsegment, year(o_orderdate)""")

cte("v_indicator_records", ["v_indicators"], """
  select record_id, yr || '0101' as date, yr as year, indicator_name, country, value,
    'https://data.worldbank.org/indicator/' || indicator_name || '?locations=' || code as url,
    indicator_name || ' — ' || country || ' (' || yr || '): ' || printf('%.2f', value) as title,
    cast(yr || '-01-01' as timestamp) as ingestion_timestamp
  from v_indicators""")

_any = lambda words: " or ".join(f"contains(lower(text), '{w}')" for w in words)
_all = " || ".join(
    f"case when contains(lower(text), '{w}') then ['{w}'] else [] end" for w in DOCUMENT_REGIONS
)
_type = " ".join(
    f"when contains(lower(text), '{w}') then '{w.title()}'" for w in DOCUMENT_KEYWORDS
)
cte("doc_lines", [], """
  select doc_id, pos - 1 as pos, trim(line) as text from (
    select doc_id, unnest(string_split(text, chr(10))) as line,
      generate_subscripts(string_split(text, chr(10)), 1) as pos from documents)""")
cte("v_alerts", ["doc_lines"], f"""
  select doc_id, pos, text, {_all} as affected, case {_type} end as alert_type
  from doc_lines where length(text) >= 20 and ({_any(DOCUMENT_KEYWORDS)})
    and ({_any(DOCUMENT_REGIONS)})""")
cte("v_weather", ["v_alerts"], """
  select doc_id || '-' || pos as record_id, '20260101' as date,
    'https://example.com/d/' || doc_id as url,
    'IMD Alert: ' || alert_type || ' — ' || array_to_string(affected[1:3], ', ') as title,
    affected as locations, left(text, 500) as alert_text, alert_type
  from v_alerts""")

_targets = ", ".join(f"({i}, {text(t)})" for i, t in enumerate(TARGETS, 1))
cte("v_targets", [], f"select * from (values {_targets}) as t(target_id, target)")


def mentions(name: str, view: str) -> None:
    """Entities per record of a view, as CTE ``name``; a record repeated counts again."""
    parts = [
        ("Person", "persons", name_key("x")),
        ("Organization", "organizations", name_key("x")),
        ("Location", "locations", "case when contains(x, '#') then split_part(x, '#', 2) else x end"),
        ("Theme", "themes", "case when source = 'GDELT' then split_part(x, ',', 1) else x end"),
    ]
    rows = " union all ".join(
        f"select distinct rid, url, label, key, tone, ts from (select record_id as rid, url, "
        f"'{label}' as label, tone, ingestion_timestamp as ts, {key} as key from "
        f"(select record_id, url, source, tone, ingestion_timestamp, unnest({arr}) as x from {view}) "
        f"where x is not null and x <> '') where key <> ''"
        for label, arr, key in parts
    )
    cte(name, [view], rows)


mentions("m", "v_reports")
mentions("mr", "v_repeats")
mentions("ml", "v_linked")


def article_edges(name: str, m: str) -> None:
    cte(name, [m], f"""
      select label as src_label, key as src, 'MENTIONED_IN' as rel_type, 'Article' as dst_label,
        url as dst, count(*) as weight
      from {m} where label in ('Person', 'Organization') group by label, key, url
      union all
      select distinct 'Article', url, case label when 'Location' then 'LOCATED_IN' else 'HAS_THEME' end,
        label, key, cast(null as bigint)
      from {m} where label in ('Location', 'Theme')""")


FAMILIES = {
    "ASSOCIATED_WITH": ("Person", "Organization"),
    "LOCATED_AT": ("Person", "Location"),
    "OPERATES_IN": ("Organization", "Location"),
    "KNOWS_OR_COOCCURRED_WITH": ("Person", "Person"),
}


def pair_sql(m: str, rel: str, least: int, where: str = "true") -> str:
    left, right = FAMILIES[rel]
    oriented = "and a.key < b.key" if left == right else ""
    return f"""
      select '{left}' as src_label, a.key as src, '{rel}' as rel_type, '{right}' as dst_label,
        b.key as dst, count(*) as weight
      from {m} a join {m} b on a.rid = b.rid and a.ts = b.ts
        and a.label = '{left}' and b.label = '{right}' {oriented}
      where {where} group by a.key, b.key having count(*) >= {least}"""


def union(*parts: str) -> str:
    return "\nunion all\n".join(parts)


article_edges("ae", "m")
article_edges("aer", "mr")
article_edges("ael", "ml")
for _name, _m, _ae in (("edges", "m", "ae"), ("edges_linked", "ml", "ael")):
    cte(_name, [_m, _ae], union(
        f"select * from {_ae}", pair_sql(_m, "ASSOCIATED_WITH", 1), pair_sql(_m, "OPERATES_IN", 2)))
cte("scored", ["m"], union(*[pair_sql("m", r, 2) for r in
                             ("LOCATED_AT", "OPERATES_IN", "KNOWS_OR_COOCCURRED_WITH")]))
cte("entities", ["m"], "select distinct label, key from m")
cte("entities_linked", ["ml"], "select distinct label, key from ml")

_EDGE_COLUMNS = "src_label, src, rel_type, dst_label, dst"
cte("i_edges", ["v_indicators"], """
  select 'EconomicIndicator' as src_label, record_id as src, 'MEASURED_IN' as rel_type,
    'Location' as dst_label, country as dst from v_indicators
  union all
  select 'EconomicIndicator', record_id, 'HAS_THEME', 'Theme', t from v_indicators,
    (select unnest(['Economics', '']) as t) where t <> ''
  union all
  select 'EconomicIndicator', record_id, 'HAS_THEME', 'Theme', indicator_name from v_indicators""")
cte("w_edges", ["v_weather"], """
  select distinct 'WeatherAlert' as src_label, record_id as src, 'THREATENS' as rel_type,
    'Location' as dst_label, unnest(locations) as dst from v_weather""")

cte("all_nodes", ["entities", "v_reports", "v_indicator_records", "v_weather"], """
  select label, key, cast(null as varchar) as title, cast(null as varchar) as date,
    cast(null as varchar) as tone, cast(null as varchar) as source, cast(null as varchar) as url
  from entities
  union all select 'Article', url, 'Report from ' || source_name, date, tone, source, url from v_reports
  union all select 'EconomicIndicator', record_id, title, date, null, 'WorldBank', url
    from v_indicator_records
  union all select 'WeatherAlert', record_id, title, date, null, 'IMD', url from v_weather""")

# --- feeds ---------------------------------------------------------------------------------

_fields = ["themes", "locations", "persons", "organizations"]
sql("relevance_filter", ["v_reports"], "select record_id from v_reports where " + " or ".join(
    f"contains(lower(coalesce(array_to_string({c}, ';'), '')), '{t.lower()}')"
    for c in _fields for t in STREAM_TERMS))

sql("canonical_records", ["v_reports"], "select 'GDELT' as source, record_id, date, url, source_name, "
    "tone, ingestion_timestamp, " + ", ".join(
        f"coalesce(array_to_string({c}, '|') || '|', '') as {c}, "
        f"coalesce(len({c}) + 1, 0) as n_{c}" for c in _fields) + " from v_reports")

sql("gkg_lines", ["v_reports"], """
  select record_id as GKGRECORDID, date as DATE, source_name as SourceCommonName,
    url as DocumentIdentifier, array_to_string(themes, ';') || ';' as V2Themes,
    array_to_string(persons, ';') || ';' as V2Persons, tone as Tone, cast(null as varchar) as Extras
  from v_reports""")

for _name in ("gkg_zip_scan", "gkg_zip_stream"):
    sql(_name, ["v_reports"], """
      select record_id as GKGRECORDID, date as DATE, url as DocumentIdentifier, array_to_string(themes, ';') || ';' as V2Themes,
        tone as Tone, cast(null as varchar) as Extras
      from v_reports""")

sql("manifest_latest", [], """
  select 'http://feeds.example.com/' || strftime(max(o_orderdate), '%Y%m%d%H%M%S') || '.gkg.csv.zip'
    as url from orders where o_orderstatus <> 'F'""")

cte("store", ["v_reports", "v_indicator_records", "v_weather"], """
  select source, record_id, date, url, cast(null as varchar) as title,
    cast(null as varchar) as indicator_name, cast(null as double) as value,
    cast(null as varchar) as alert_type, coalesce(len(locations), 0) as n_locations,
    ingestion_timestamp from v_reports
  union all select 'WorldBank', record_id, date, url, title, indicator_name, value, null, 1,
    ingestion_timestamp from v_indicator_records
  union all select 'IMD', record_id, date, url, title, null, null, alert_type, len(locations),
    timestamp '2026-01-01' from v_weather""")
sql("record_store", ["store"], "select * exclude (ingestion_timestamp) from store")
sql("landed_records", ["store"], "select * exclude (ingestion_timestamp) from store")
sql("store_overview", ["store"], """
  select source, record_id, strftime(ingestion_timestamp, '%Y-%m-%d %H:%M:%S') as ingested,
    (select count(*) from store) as total
  from store order by ingestion_timestamp desc, record_id limit 3""")
sql("route_by_source", ["store"], """
  select record_id, source, case when source in ('WorldBank', 'NDAP') then 'indicator'
    when source = 'IMD' then 'weather' else 'article' end as route from store""")

sql("new_records_by_id", ["v_repeats"], f"""
  select record_id, tone, ingestion_timestamp from (
    select *, row_number() over (partition by record_id
      order by ingestion_timestamp, tone nulls first) as n from v_repeats)
  where n = 1 and record_id not in (select record_id from v_reports
    where ingestion_timestamp < timestamp '{STORED_UNTIL}')""")
sql("new_records_by_url", ["v_repeats"], f"""
  select url, tone, ingestion_timestamp from (
    select *, row_number() over (partition by url
      order by ingestion_timestamp desc, tone nulls first) as n from v_repeats)
  where n = 1 and url not in (select url from v_reports
    where ingestion_timestamp < timestamp '{STORED_UNTIL}')""")

sql("store_appends", ["store"], """
  select source, record_id, url, date, strftime(ingestion_timestamp, '%Y%m') as ingest_month from store""")
sql("store_appends_by_url", ["store"], """
  select source, count(*) as n, count(*) as urls from (select distinct source, url from store) group by source""")
sql("rejected_records", ["v_reports", "v_weather"], """
  select source, record_id as name, 'missing url' as reason from v_reports where status = 'P'
  union all
  select 'IMD', url, 'missing record_id' from v_weather where not len(locations) > 1""")
sql("graph_from_store", ["ae", "m", "i_edges", "w_edges"], union(
    "select * from ae", pair_sql("m", "ASSOCIATED_WITH", 1), "select *, cast(null as bigint) as weight from i_edges",
    "select *, cast(null as bigint) as weight from w_edges"))
sql("pairs_from_store", ["m"], union(*[pair_sql("m", r, 2) for r in FAMILIES]))
sql("rss_repeats", [], """
  select 'imd-rss-' || sha256(o_orderpriority || chr(10) || 'https://example.com/o/' || o_custkey || chr(10) ||
    strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')) as record_id, o_orderpriority as title,
    'https://example.com/o/' || o_custkey as url
  from orders group by o_orderpriority, o_custkey, o_orderdate""")

sql("request_grid", [], """
  select n_name as country, s as indicator_code, left(s, 1) || lower(s[2:]) as indicator_name
  from nation, (select unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) as s)""")
sql("indicator_feed", ["v_indicator_records"], """
  select record_id, date, url, title, indicator_name, year, value, country,
    'Economics|' || indicator_name as themes, country as locations from v_indicator_records""")
sql("latest_indicators", ["v_indicators"], """
  select record_id, country, indicator_name, yr as year, value, recency from (
    select *, row_number() over (partition by country, indicator_name order by yr desc) as recency
    from v_indicators) where recency <= 5""")

sql("portal_rows", [], """
  select 'ndap-' || rid || '-' || l_linenumber as record_id,
    year(l_shipdate) || '0101' as date, 'https://ndap.niti.gov.in/dataset/' || rid as url,
    'Order ' || l_orderkey || ' — ' || place || ' (' || year(l_shipdate) || '): '
      || cast(l_quantity as int) as title,
    place || '|India' as locations, 'Order ' || l_orderkey as indicator_name,
    cast(cast(l_quantity as int) as varchar) as value_raw, l_quantity as value,
    cast(year(l_shipdate) as varchar) as year, 6 as n_columns
  from (select *, printf('%08d', l_orderkey) as rid,
    case when l_returnflag = 'R' then l_linestatus else l_returnflag end as place from lineitem)""")

sql("rss_items", [], """
  select 'imd-rss-' || sha256(title || chr(10) || link || chr(10) || pub) as record_id,
    case when o_orderpriority <> '5-LOW' then strftime(o_orderdate, '%Y%m%d') else '20260101' end as date,
    case when o_orderstatus <> 'P' then 'https://example.com/o/' || o_orderkey
      else 'https://example.com/rss' end as url,
    title, coalesce(nullif(array_to_string(
      case when contains(lower(body), 'nation_1') then ['NATION_1'] else [] end ||
      case when contains(lower(body), 'nation_2') then ['NATION_2'] else [] end ||
      case when contains(lower(body), 'urgent') then ['Urgent'] else [] end, '|'), ''), 'India') as locations,
    body as alert_text, '-3' as tone
  from (select *, 'Order ' || o_orderkey as title, o_orderpriority || ' from ' || n_name as body,
      case when o_orderstatus <> 'P' then 'https://example.com/o/' || o_orderkey else '' end as link,
      case when o_orderpriority <> '5-LOW' then strftime(o_orderdate, '%a, %d %b %Y %H:%M:%S GMT') else '' end as pub
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)""")

# --- pages and text ------------------------------------------------------------------------

_BLANKS = r"[ \t\r\f\x{00A0}]+"


def resolve(x: str) -> str:
    for ref, char in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
        x = f"replace({x}, '{ref}', '{char}')"
    return x


def strip(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^[\s\x{{00A0}}]+', ''), '[\s\x{{00A0}}]+$', '')"


def drop(x: str, tags: list[str]) -> str:
    parts = [r"<!--.*?(?:-->|\z)"] + [rf"<{t}\b.*?(?:</{t}\s*>|\z)" for t in tags]
    return f"regexp_replace({x}, '{'|'.join(parts)}', ' ', 'gis')"


def tag_text(x: str) -> str:
    lines = (
        rf"regexp_replace({x}, '</?(?:p|br|li|ul|ol|div|h[1-6]|tr|td|th|table|article|section|main|"
        rf"blockquote|pre|dl|dt|dd|hr)\b[^>]*>', chr(10), 'gi')"
    )
    plain = resolve(f"regexp_replace({lines}, '<[^>]*>', '', 'g')")
    blanks = f"regexp_replace({plain}, '{_BLANKS}', ' ', 'g')"
    return strip(rf"regexp_replace({blanks}, ' ?\n[ \n]*', chr(10), 'g')")


_SILENT = ["script", "style", "noscript", "template"]
_PLAIN = _SILENT + ["head", "nav", "header", "footer", "aside", "form"]
cte("texts", [], f"select page_id, url, {tag_text(drop('html', _PLAIN))} as text from pages")
sql("page_text", ["texts"], """
  select page_id, url, text, length(text) as length,
    case when text = '' then 'no_text' else 'ok' end as status from texts""")
sql("page_links", [], """
  select page_id, href, 'https://example.com' || href as link from (
    select page_id, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref="([^"]*)"', 1)) as href
    from pages) where contains(href, '/t')""")
cte("fields", [], f"""
  select page_id, url,
    coalesce(nullif({tag_text("regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1)")}, ''), 'No Title') as title,
    {tag_text('''regexp_extract(html, '(?is)<div class="ad">(.*?)</div>', 1)''')} as content
  from pages""")
sql("page_fields", ["fields"], "select * from fields")
sql("release_records", ["fields"], """
  select 'PIB' as source, url, title, content as original_content, false as is_translated,
    'English' as language from fields""")
sql("new_records_without_id", ["fields"], """
  select url, title, cast(null as varchar) as record_id from (
    select *, row_number() over (partition by url order by title, content) as n from fields
    where not starts_with(url, 'https://')) where n = 1""")
_inner = r"((?:<[a-zA-Z][^<>]*>)*[^<]*(?:</[a-zA-Z][^<>]*>)*)"
sql("page_blocks", [], "select * from (" + " union all ".join(
    f"select page_id, '{t}' as tag, {strip(resolve(r'''regexp_replace(x, '<[^>]*>', '', 'g')'''))} as text from ("
    f"select page_id, unnest(regexp_extract_all({drop('html', _SILENT)}, "
    rf"'(?i)<{t}(?:\s[^<>]*)?>{_inner}</{t}\s*>', 1)) as x from pages) "
    "where len(regexp_extract_all(x, '<[a-zA-Z]')) = len(regexp_extract_all(x, '</'))"
    for t in ("p", "li", "div")) + ") where text <> ''")
sql("script_detect", [], """
  select doc_id, regexp_matches(text, '[À-ſ]') as is_translated,
    case when regexp_matches(text, '[À-ſ]') then 'Hindi' else 'English' end as language
  from documents""")
sql("alert_blocks", ["v_alerts"], """
  select doc_id, pos, text, array_to_string(affected, '|') as affected, alert_type from v_alerts""")

# --- graph ---------------------------------------------------------------------------------

sql("normalize_entities", ["m"], "select url, label, key from m")
sql("article_upsert", ["v_repeats"], """
  select url, 'Report from ' || source_name as title, date, tone, source, ingestion_timestamp
  from (select *, row_number() over (partition by url order by ingestion_timestamp desc) as n
    from v_repeats) where n = 1""")
sql("entity_nodes", ["entities"], "select * from entities")
sql("unique_keys", ["v_repeats"], """
  select 'raw' as stage, url as key, count(*) as n from v_repeats group by url having count(*) > 1""")
sql("mention_edges", ["aer"], "select * from aer where rel_type = 'MENTIONED_IN'")
sql("article_links", ["aer"], f"select {_EDGE_COLUMNS} from aer where rel_type <> 'MENTIONED_IN'")
sql("association_edges", ["mr"], pair_sql("mr", "ASSOCIATED_WITH", 1))
sql("indicator_edges", ["i_edges"], "select * from i_edges")
sql("weather_edges", ["w_edges"], "select * from w_edges")
for _name, _rel, _least in (
    ("cooccur_person_org", "ASSOCIATED_WITH", 150), ("cooccur_person_loc", "LOCATED_AT", 150),
    ("cooccur_org_loc", "OPERATES_IN", 400), ("cooccur_person_person", "KNOWS_OR_COOCCURRED_WITH", 25),
):
    sql(_name, ["m"], pair_sql("m", _rel, _least))
sql("cooccur_distinct_reports", ["m"], union(*[pair_sql("m", r, 2) for r in FAMILIES]))

_early, _late = (f"a.ts {op} timestamp '{STORED_UNTIL}'" for op in ("<", ">="))
_two = ("ASSOCIATED_WITH", "KNOWS_OR_COOCCURRED_WITH")
cte("run1", ["m"], union(*[pair_sql("m", r, 2, _early) for r in _two]))
cte("run2", ["m"], union(*[pair_sql("m", r, 5, _late) for r in _two]))
_key = _EDGE_COLUMNS.replace(" ", "").split(",")
sql("weight_upsert", ["run1", "run2"], f"""
  select {_EDGE_COLUMNS}, coalesce(run2.weight, run1.weight) as weight
  from run1 full join run2 using ({_EDGE_COLUMNS})""")
sql("weight_accumulate", ["run1", "run2"], f"""
  select {_EDGE_COLUMNS}, cast(sum(weight) as bigint) as weight
  from (select * from run1 union all select * from run2) group by {_EDGE_COLUMNS}""")

sql("weight_runs", ["run1", "run2"], f"""
  select {_EDGE_COLUMNS}, cast(sum(weight) as bigint) as weight
  from (select * from run1 union all select * from run2 union all select * from run2) group by {_EDGE_COLUMNS}""")
sql("weight_runs_newest", ["run1", "run2"], f"""
  select * from run2 union all select * from run1 anti join run2 using ({_EDGE_COLUMNS})""")
sql("stream_graph", ["aer", "mr"], union(
    "select * from aer where rel_type = 'MENTIONED_IN'", pair_sql("mr", "ASSOCIATED_WITH", 1)))


def keys_of(where: str) -> str:
    pairs = pair_sql("m", "ASSOCIATED_WITH", 1, where)
    return f"""
      select label as src_label, key as src, 'e' as rel_type, '' as dst_label, url as dst from m a where {where}
      union select {_EDGE_COLUMNS} from ({pairs})"""


sql("write_counters", ["m"], f"""
  select 'nodes' as created, count(*) as n from (
    select label, key from m a where {_late} except select label, key from m a where {_early})
  union all
  select 'relationships', count(*) from (({keys_of(_late)}) except ({keys_of(_early)}))""")

sql("graph_counts", ["all_nodes", "edges", "i_edges", "w_edges"], f"""
  select 'node' as kind, label as name, count(*) as n from all_nodes group by label
  union all
  select 'edge', rel_type, count(*) from (select {_EDGE_COLUMNS} from edges
    union all select * from i_edges union all select * from w_edges) group by rel_type""")

# --- alerts --------------------------------------------------------------------------------

cte("heavy", ["scored"], """
  select case when weight > 15 then 'CRITICAL' else 'HIGH' end as severity, near as source_entity,
    far as target_entity, weight as weight_score, rel_type from (
    select src_label as near_label, src as near, dst as far, rel_type, weight from scored
    union all select dst_label, dst, src, rel_type, weight from scored)
  where near_label in ('Theme', 'Location') and weight > 5
  order by weight desc, near, far, rel_type limit 10""")
sql("alerts_top10", ["heavy"], "select * from heavy")
sql("alert_snapshot", ["heavy"], """
  select cast(1767225600 as double) as last_scan, severity, source_entity, target_entity, weight_score,
    'Heavy relationship between ''' || source_entity || ''' and ''' || target_entity || '''.' as description,
    cast(1767225600 as double) as timestamp from heavy""")


def grown(where: str = "true") -> str:
    return f"""
      select user_id, event_type, day, weight, previous from (
        select *, lag(day) over w as before, lag(weight) over w as previous from (
          select user_id, event_type, cast(ts as date) as day, count(*) as weight from events
          where {where} group by all)
        window w as (partition by user_id, event_type order by day))
      where before = day - interval 1 day and weight > 1.5 * previous"""


sql("pair_growth_daily", [], grown())
sql("growth_alerts", [], f"""
  select case when weight > 15 then 'CRITICAL' else 'HIGH' end as severity,
    cast(user_id as varchar) as source_entity, event_type as target_entity, weight as weight_score,
    '''' || user_id || ''' and ''' || event_type || ''' met over half as often again as on the day before.' as description, cast(epoch(day) as double) as timestamp
  from ({grown()})""")
SQL["stream_growth"] = SQL["pair_growth_daily"]
SQL["stream_growth_alerts"] = SQL["pair_growth_daily"]
SQL["stream_rescan"] = SQL["alert_snapshot"]

# --- retrieval -----------------------------------------------------------------------------

_needle = "lower(trim(trim(target, ''''), '\"'))"
cte("anchors", ["v_targets", "entities"], f"""
  select target_id, target, label as anchor_label, key as anchor
  from v_targets join entities on contains(lower(key), {_needle})""")
cte("anchors_linked", ["v_targets", "entities_linked"], """
  select target_id, target, label as anchor_label, key as anchor
  from v_targets join entities_linked on contains(lower(key), lower(target))""")
sql("resolve_targets", ["anchors"], "select * from anchors")
cte("named", ["entities"], """
  select target, label as anchor_label, key as anchor from (
    select n_name as target from nation union select p_brand from part
    union select lower(s_name) from supplier) join entities on contains(lower(key), lower(target))""")
sql("resolve_names", ["named"], "select * from named")
sql("resolve_from_index", ["named"], """
  select *, 1 as batches from named where length(anchor) % 2 = 0 union all select *, 2 from named""")
sql("search_nodes", ["all_nodes"], """
  select * from (select label, key, coalesce(title, '') as title from all_nodes
    where contains(lower(key), 'nation_2') order by label, key limit 5)
  union all
  select * from (select label, key, coalesce(title, '') from all_nodes
    where contains(lower(key), 'nation_1') and label = 'Location' order by label, key limit 5)""")


def reach(tag: str, anchors: str, edges: str, hops: int, limit: int) -> None:
    """CTEs ``reach_<tag>`` (all articles) and ``near_<tag>`` (the first ones per anchor)."""
    both = f"nb_{tag}"
    cte(both, [edges], f"""
      select distinct src_label as near_label, src as near, dst_label as far_label, dst as far from {edges}
      union select dst_label, dst, src_label, src from {edges}""")
    cte(f"h0_{tag}", [anchors], f"""
      select distinct anchor_label, anchor, anchor_label as label, anchor as key from {anchors}""")
    for h in range(1, hops + 1):
        only = "where far_label = 'Article'" if h == hops else ""
        cte(f"h{h}_{tag}", [f"h{h - 1}_{tag}", both], f"""
          select distinct anchor_label, anchor, far_label as label, far as key
          from h{h - 1}_{tag} join {both} on label = near_label and key = near {only}""")
    steps = " union all ".join(f"select *, {h} as hop from h{h}_{tag}" for h in range(1, hops + 1))
    cte(f"reach_{tag}", [f"h{h}_{tag}" for h in range(1, hops + 1)], f"""
      select anchor_label, anchor, key as url, min(hop) as hop from ({steps})
      where label = 'Article' group by anchor_label, anchor, key""")
    cte(f"near_{tag}", [f"reach_{tag}"], f"""
      select * from (select *, row_number() over (partition by anchor_label, anchor
        order by hop, url) as rank from reach_{tag}) where rank <= {limit}""")


for _n in (1, 2, 3):
    reach(f"t{_n}", "anchors", "edges", _n, 25)
    sql(f"hop_expand_{_n}", ["anchors", f"reach_t{_n}"], f"""
      select target_id, anchor_label, anchor, url, hop
      from anchors join reach_t{_n} using (anchor_label, anchor)""" if _n < 3 else f"""
      select target_id, anchor_label, anchor, hop, count(*) as articles, min(url) as first_url,
        max(url) as last_url
      from anchors join reach_t{_n} using (anchor_label, anchor) group by all""")
sql("top_articles_per_anchor", ["anchors", "near_t3"], """
  select target_id, anchor_label, anchor, url, hop, rank
  from anchors join near_t3 using (anchor_label, anchor)""")
SQL["nearest_from_lists"] = SQL["top_articles_per_anchor"]

cte("part_edges", [], """
  select distinct 'Article' as src_label, 'o/' || l_orderkey as src, 'LOCATED_IN' as rel_type,
    'Location' as dst_label, 'p/' || l_partkey as dst from lineitem""")
cte("part_anchors", [], """
  select 'Location' as anchor_label, 'p/' || p_partkey as anchor from part where p_name = 'blue bolt'""")
reach("parts", "part_anchors", "part_edges", 3, 40)
sql("nearest_by_part", ["near_parts"], "select anchor, url, hop, rank from near_parts")

_DATE = "date[1:4] || '-' || date[5:6] || '-' || date[7:8]"
_TITLE = "upper(left(lower(key), 1)) || lower(key)[2:]"


def shown(column: str, n: int) -> str:
    """The first entries of a record's list, cleaned, in the order of the list."""
    if column == "themes":
        key = "regexp_replace(case when source = 'GDELT' then split_part(x, ',', 1) else x end, ',[0-9]+$', '')"
        key = f"replace(upper(left(lower({key}), 1)) || lower({key})[2:], '_', ' ')"
    else:
        key = name_key("x")
    keys = f"list_transform({column}, lambda x: {key})"
    firsts = f"list_filter({keys}, lambda k, i: list_position({keys}, k) = i)"
    return f"coalesce(nullif(array_to_string(({firsts})[1:{n}], ', '), ''), 'None')"


for _tag, _view in (("", "v_reports"), ("_linked", "v_linked")):
    cte(f"cards{_tag}", [_view], f"""
      select url, source, 'TYPE: Article | SOURCE: ' || source || ' | DATE: ' || {_DATE} || ' | SENTIMENT: ' ||
        case when tone is null then 'Unknown' when cast(split_part(tone, ',', 1) as double) > 1 then 'Positive'
          when cast(split_part(tone, ',', 1) as double) < -1 then 'Negative' else 'Neutral' end ||
        chr(10) || 'URL: ' || url || chr(10) || 'KEY PERSONS: ' || {shown('persons', 5)} || chr(10) ||
        'ORGANIZATIONS: ' || {shown('organizations', 5)} || chr(10) || 'THEMES: ' || {shown('themes', 6)} as card
      from {_view}""")
sql("article_cards", ["cards"], "select url, card from cards")
cte("i_cards", ["v_indicator_records"], f"""
  select record_id, url, 'TYPE: Economic Indicator | TITLE: ' || title || chr(10) || 'DATE: ' || {_DATE} ||
    ' | INDICATOR: ' || indicator_name || ' | VALUE: ' || cast(value as varchar) || chr(10) || 'URL: ' || url ||
    chr(10) || 'THEMES: ' || array_to_string(['Economics', upper(left(indicator_name, 1)) ||
      lower(indicator_name[2:])], ', ') as card from v_indicator_records""")
sql("indicator_cards", ["i_cards"], "select record_id, card from i_cards")
cte("w_cards", ["v_weather"], f"""
  select record_id, url, 'TYPE: Weather Alert | TITLE: ' || title || chr(10) || 'DATE: ' || {_DATE} ||
    ' | ALERT TYPE: ' || alert_type || chr(10) || 'URL: ' || url || chr(10) || 'SUMMARY: ' ||
    left(alert_text, 280) as card from v_weather""")
sql("weather_cards", ["w_cards"], "select record_id, card from w_cards")
cte("all_links", ["ae", "m", "i_edges", "w_edges"], union(
    f"select {_EDGE_COLUMNS} from ae", f"select {_EDGE_COLUMNS} from ({pair_sql('m', 'ASSOCIATED_WITH', 1)})",
    "select * from i_edges", "select * from w_edges"))
sql("mixed_cards", ["anchors", "all_links", "cards", "i_cards", "w_cards"], """
  select target_id, label, key, 1 as hop, url, card, source from (
    select distinct target_id, label, key from (
      select *, row_number() over (partition by target_id, anchor_label, anchor order by key, label) as n from (
        select distinct target_id, anchor_label, anchor, far_label as label, far as key from anchors join (
          select src_label as near_label, src as near, dst_label as far_label, dst as far from all_links
          union select dst_label, dst, src_label, src from all_links) on anchor_label = near_label and anchor = near
        where far_label in ('Article', 'EconomicIndicator', 'WeatherAlert')))
    where n <= 25)
  join (select 'Article' as label, url as key, url, card, source from cards
    union all select 'EconomicIndicator', record_id, url, card, 'WorldBank' from i_cards
    union all select 'WeatherAlert', record_id, url, card, 'IMD' from w_cards) using (label, key)""")

# Whole targets are part 0; the words of a target of several words that found nothing follow.
def fusion(tag: str, targets: str, anchors: str, near: str, n: int) -> None:
    """CTEs of the hits of whole targets and of their first ``n`` words, and which words' hits stay."""
    hits0, words, found, hits1 = f"hits0{tag}", f"words{tag}", f"word_anchors{tag}", f"hits1{tag}"
    cte(hits0, [anchors, near], f"""
      select target_id, 0 as part, url, min(hop) as hop
      from {anchors} join {near} using (anchor_label, anchor) group by target_id, url""")
    cte(words, [targets, hits0], f"""
      select target_id, row_number() over (partition by target_id order by pos) as part, word from (
        select target_id, unnest(string_split(lower(target), ' ')) as word,
          generate_subscripts(string_split(lower(target), ' '), 1) as pos
        from {targets} where contains(target, ' ') and target_id not in (select target_id from {hits0}))
      where word not in ('about', 'tell', 'the', 'in', 'what', 'is', '')""")
    cte(found, [words, "entities"], f"""
      select target_id, part, label as anchor_label, key as anchor
      from {words} join entities on contains(lower(key), word) where part <= {n}""")
    reach(f"words{tag}", found, "edges", 3, 25)
    cte(hits1, [found, f"near_words{tag}"], f"""
      select target_id, part, url, min(hop) as hop
      from {found} join near_words{tag} using (anchor_label, anchor) group by target_id, part, url""")
    cte(f"leads{tag}", [hits1, "cards"], f"""
      select target_id, part, split_part(card, chr(10), 1) as line from (
        select *, row_number() over (partition by target_id, part order by hop, url) as n from {hits1})
      join cards using (url) where n = 1""")
    cte(f"lines{tag}", [hits1, "cards"], f"""
      select distinct target_id, part, split_part(card, chr(10), 1) as line from {hits1} join cards using (url)""")
    cte(f"keep0{tag}", [], "select 0 as target_id, 0 as part where false")
    for k in range(1, n + 1):
        cte(f"keep{k}{tag}", [f"leads{tag}", f"lines{tag}", f"keep{k - 1}{tag}"], f"""
          select * from keep{k - 1}{tag} union all select target_id, part from leads{tag} d where part = {k} and not exists (
            select 1 from lines{tag} l join keep{k - 1}{tag} k on k.target_id = l.target_id and k.part = l.part
            where l.target_id = d.target_id and l.line = d.line)""")
    cte(f"first_line{tag}", [hits0, hits1, f"keep{n}{tag}"], f"""
      select target_id, part, hop, url from {hits0}
      union all select target_id, part, hop, url from {hits1} join keep{n}{tag} using (target_id, part)""")


fusion("", "v_targets", "anchors", "near_t3", 3)
cte("long_target", [], f"select 1 as target_id, {text(LONG_TARGET)} as target")
cte("long_anchors", ["long_target", "entities"], f"""
  select target_id, target, label as anchor_label, key as anchor
  from long_target join entities on contains(lower(key), {_needle})""")
reach("long", "long_anchors", "edges", 3, 25)
fusion("_long", "long_target", "long_anchors", "near_long", 5)
cte("fused", ["hits0", "hits1"], """
  select target_id, part, hop, url from (
    select *, row_number() over (partition by target_id, url order by part, hop) as n
    from (select target_id, part, url, hop from hits0 union all select target_id, part, url, hop from hits1))
  where n = 1""")
sql("keyword_fusion", ["fused"], "select * from fused")
sql("keyword_fusion_first_line", ["first_line"], "select * from first_line")
sql("keyword_fusion_five", ["first_line_long"], "select * from first_line_long")

cte("streams", ["v_targets"], """
  select query_id, url, 0 as stream, row_number() over (partition by query_id order by page_id) as rank
  from (select page_id % 5 + 1 as query_id, * from pages)
  union all
  select query_id, url, 1, row_number() over (partition by query_id order by length(html) desc, page_id)
  from (select page_id % 5 + 1 as query_id, * from pages)""")
cte("merged", ["streams"], """
  select query_id, url, position from (
    select query_id, url, row_number() over (partition by query_id order by stream, rank) as position from (
      select *, row_number() over (partition by query_id, url order by stream, rank) as n
      from streams where rank <= 3) where n = 1) where position <= 4""")
sql("merged_urls", ["merged"], "select * from merged")
sql("direct_urls", [], """
  select query_id, query as url, 1 as position from (
    select page_id as query_id, url as query from pages
    union all select n_nationkey, n_name from nation)
  where starts_with(query, 'http://') or starts_with(query, 'https://')""")
cte("live", ["merged", "texts"], """
  select query_id as target_id, position, url, split_part(split_part(url, '//', 2), '/', 1) as domain,
    'TYPE: Live Article | SOURCE: ' || split_part(split_part(url, '//', 2), '/', 1) ||
      ' | DATE: Real-time' || chr(10) || 'URL: ' || url || chr(10) || 'SUMMARY: ' || left(text, 500) || '...' as card,
    'SOURCE: ' || url || chr(10) || 'CONTENT:' || chr(10) || left(text, 3000) || chr(10) || chr(10) ||
      '---' || chr(10) || chr(10) as block
  from merged join texts using (url)""")
sql("live_cards", ["live"], "select * from live")
sql("live_fields", ["live"], r"""
  select target_id, position, regexp_extract(card, 'URL:\s*(\S+)', 1) as url,
    coalesce(nullif(regexp_extract(card, 'SOURCE:\s*([^\s|]+)', 1), ''), 'Unknown') as source,
    left(split_part(card, chr(10), 1), 100) as headline
  from live""")
sql("headlines", [], """
  select doc_id, case when text is null or text = '' then 'Untitled page'
    else left(split_part(text, chr(10), 1), 100) end as headline
  from documents""")
cte("evidence", ["fused", "cards", "live"], """
  select target_id, row_number() over (partition by target_id order by live, part, hop, url) as id, url, card,
    source, live from (
    select target_id, false as live, part, hop, url, card, source from fused join cards using (url)
    union all select target_id, true, 0, position, url, card, domain from live)""")
sql("evidence_rows", ["evidence"], "select * from evidence")
sql("cited_sources", ["evidence"], """
  select target_id, id, source, url from (
    select *, row_number() over (partition by target_id order by id) as n from evidence
    where (id in (1, 3, 99) or live) and url <> '') where n <= 5""")


def deep(n: int) -> str:
    tag = f"deep{n}"
    reach(tag, "anchors_linked", "edges_linked", 3, n)
    cte(f"top_{tag}", ["anchors_linked", f"near_{tag}"], f"""
      select * from (select *, row_number() over (partition by target_id order by hop, url) as rank from (
        select target_id, url, min(hop) as hop from anchors_linked join near_{tag}
          using (anchor_label, anchor) group by target_id, url)) where rank <= {n}""")
    cte(f"context_{tag}", [f"top_{tag}", "texts", "v_targets"], f"""
      select target_id, coalesce({text(DEEP_HEADER)} || chr(10) || chr(10) ||
        string_agg('SOURCE URL: ' || url || chr(10) || 'CONTENT:' || chr(10) || left(coalesce(text, ''), 5000) ||
          {text(CARD_SEPARATOR)}, '' order by rank), 'NO_DEEP_CONTEXT_FOUND') as context
      from v_targets left join top_{tag} using (target_id) left join texts using (url) group by target_id""")
    return f"context_{tag}"


sql("deep_context", [deep(3)], "select * from context_deep3")
sql("prompt_assembly", [deep(1), "evidence", "live", "v_targets"], f"""
  select target_id, 'Report what the sources below state about: ' || target || chr(10) || chr(10) || '[live]' ||
    chr(10) || coalesce(l, {text(NO_LIVE)}) || chr(10) || chr(10) || '[articles]' || chr(10) ||
    case when context = 'NO_DEEP_CONTEXT_FOUND' then {text(NO_DEEP)} when length(context) > 5000
      then left(context, 5000) || '... [TRUNCATED] ...' else context end ||
    chr(10) || chr(10) || '[cards]' || chr(10) || coalesce(c, {text(NO_CARDS)}) ||
    chr(10) || chr(10) || 'Cite cards by number, like [1].' as prompt
  from v_targets
    left join (select target_id, string_agg(block, '' order by position) as l from live group by all) using (target_id)
    left join context_deep1 using (target_id)
    left join (select target_id, string_agg(card, {text(CARD_SEPARATOR)} order by id) as c from evidence
      where id <= 8 group by all) using (target_id)""")
sql("last_messages", [], """
  select conv_id, turn, case when role = 'user' then 'user' else 'assistant' end as role,
    text as content, back from (
    select *, row_number() over (partition by conv_id order by turn desc) as back from conversations)
  where back <= 5""")

# --- inspection ----------------------------------------------------------------------------

sql("theme_neighbours", ["edges", "i_edges", "all_nodes"], f"""
  select near, rel_type, far_label, far, title from (
    select dst as near, rel_type, src_label as far_label, src as far from (
      select {_EDGE_COLUMNS} from edges union all select * from i_edges)
    where dst_label = 'Theme' and contains(dst, 'ECONOMY') order by all limit 10)
  left join all_nodes on label = far_label and key = far""")
_props = ["title", "date", "tone", "source", "url"]
_sample = lambda where: f"select * from all_nodes where {where} order by label, key limit 3"
sql("sample_props", ["all_nodes"], "select * from (" + " union all ".join(
    f"select label, key, '{c}' as name, left({c}, 200) as shown from ({_sample(w)})"
    for w in ("label = 'Article'", "label not in ('Article', 'Theme')") for c in _props
) + ") where shown is not null")

# --- streaming -----------------------------------------------------------------------------

_part = lambda head, c: f"'{head}: ' || array_to_string({c}[1:5], ', ')"
cte("summaries", ["v_reports"], f"""
  select *, case when persons is null then 'No entities' else {_part('Persons', 'persons')} || ' | ' ||
    {_part('Orgs', 'organizations')} || ' | ' || {_part('Locations', 'locations')} || ' | ' ||
    {_part('Themes', 'themes')} end as ai_insight from v_reports""")
sql("entity_summaries", ["summaries"], "select record_id, ai_insight from summaries")
sql("stream_enrich", ["summaries"], """
  select record_id, url, source, source_name, date, tone, ai_insight from summaries""")
for _name in ("stream_replay", "stream_new_files"):
    SQL[_name] = SQL["stream_enrich"]
sql("parse_messages", [], """
  select 'record' as kind, count(*) as n, count(*) as n_ids from orders
  union all select 'dead', count(*), 0 from documents""")
sql("dead_letters", [], "select text as value, 'not a record' as reason from documents")
