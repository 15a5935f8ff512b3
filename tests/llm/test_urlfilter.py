import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest

from tidewire.llm import urlfilter
from tidewire.llm.urlfilter import ALPHABET, ORDER, WEIGHT


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_of(host, path):
    fits = [
        (at + start, said) for said, at, start in urlfilter.RULES
        if (host == at or host.endswith("." + at)) and path.startswith(start)
    ]
    return max(fits, key=lambda r: len(r[0]), default=(None, None))


def brute(rows):
    """Verdicts by counting every context anew."""
    seen = []
    for i, url in rows:
        host, path = parts(url)
        text, said = rule_of(host, path)
        seen.append((i, url or "", host, path, text, said, hashlib.md5((url or "").encode()).hexdigest()[0] in urlfilter.KEPT))
    counts = {k: Counter() for k in ("allow", "block")}

    def grams(url):
        padded = urlfilter.START * ORDER + url + urlfilter.END
        return [padded[j : j + ORDER + 1] for j in range(len(url) + 1)]

    for _, url, _, _, _, said, kept in seen:
        if said and not kept:
            for g in grams(url):
                for order in range(ORDER + 1):
                    counts[said][("full", g[ORDER - order :])] += 1
                    counts[said][("context", order, g[ORDER - order : ORDER])] += 1

    def probability(c, g):
        p = 1 / ALPHABET
        for order in range(ORDER + 1):
            tail = g[ORDER - order :]
            p = (c[("full", tail)] + WEIGHT * p) / (c[("context", order, tail[:-1])] + WEIGHT)
        return p

    def mean(url):
        each = [math.log(probability(counts["allow"], g)) - math.log(probability(counts["block"], g)) for g in grams(url)]
        return sum(each) / len(each)

    scores = [mean(s[1]) for s in seen]
    of = {k: [x for x, s in zip(scores, seen) if s[6] and s[5] == k] for k in ("allow", "block")}
    limit = 0.0
    if all(of.values()):
        m = {k: sum(v) / len(v) for k, v in of.items()}
        d = {k: math.sqrt(sum((x - m[k]) ** 2 for x in v) / len(v)) for k, v in of.items()}
        both = d["allow"] + d["block"]
        limit = (m["allow"] * d["block"] + m["block"] * d["allow"]) / both if both else (m["allow"] + m["block"]) / 2
    return [(i, h, p, t, said or ("allow" if x >= limit else "block")) for (i, _, h, p, t, said, _), x in zip(seen, scores)], scores


def check(spark, rows):
    frame = spark.createDataFrame([(i, u, "x", "h", 1.0) for i, u in rows], "page_id long, url string, html string, host string, score double")
    found = urlfilter.judge(frame)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict", "score"]
    got = found.collect()
    want, scores = brute(rows)
    assert sorted((str(tuple(r)[:5]) for r in got)) == sorted(map(str, want))
    assert sorted(round(r.score, 9) for r in got) == pytest.approx(sorted(round(s, 9) for s in scores), abs=1e-8)


def urls(rng, n):
    for i in range(n):
        tld = rng.choice(["com", "org", "net"])
        lang = rng.choice(["en", "fr", "de", "es"])
        word = "".join(rng.choices(["th", "er", "ing", "casino", "news"], k=2))
        yield i, f"http{rng.choice(['', 's'])}://{word}.example.{tld}/{lang}/{rng.randint(1, 300)}{rng.choice(['', '?a=1', '#top', '.html'])}"


def test_equal_to_counting_anew(spark):
    check(spark, list(urls(random.Random(1), 200)))


def test_odd_urls(spark):
    rows = [
        (1, None), (2, ""), (3, "no scheme"), (4, "://"), (5, "http://ORG/"), (6, "http://org"), (7, "http://a.org?x=/"), (8, "x://notorg/"),
        (9, "http://Example.ORG/es/a"), (10, "http://sub.example.org/en/12"), (11, "http://example.org/en/2"), (12, "http://example.com/fr/"),
        (13, "http://example.com/fr"), (14, "http://com/de/#a"), (None, "http://é.com/de/日本?q"), (15, "http://a://b.org/c"),
        (1, None), (5, "http://ORG/"), (16, "http://" + "long" * 3000 + ".net/\nline"), (17, "HTTP://ÄB.org/x%20y"),
    ]
    check(spark, rows)


def test_a_very_long_url(spark):
    """Quadratic work would take minutes here."""
    rows = [(1, "data:text/plain;base64," + "QUJD" * 100_000), (2, "http://a.org/x"), (3, "http://b.com/de/\U0001f600")]
    start = time.monotonic()
    check(spark, rows)
    assert time.monotonic() - start < 100


def test_no_rows(spark):
    check(spark, [])


def test_the_plan_holds_no_python(spark, folder):
    plan = urlfilter.judge(spark.read.parquet(f"{folder}/pages.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_query(spark, folder):
    from tidewire.llm.queries import REGISTRY

    rows = [(r.page_id, r.url) for r in spark.read.parquet(f"{folder}/pages.parquet").collect()]
    found = REGISTRY["op8_url_filter"](spark, folder)
    assert found.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert sorted(str(tuple(r)) for r in found.collect()) == sorted(map(str, brute(rows)[0]))
