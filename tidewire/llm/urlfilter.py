"""Operator 8: URL filter by rules and a character language-model ratio, in DataFrame functions alone.

Rules decide the URLs they fit. These URLs, parted by their verdict, train two Markov models over
characters; each mixes orders 0 to ``ORDER``, an order leaning on the next lower one where its context
is rare: P(c|h) = (n(hc) + WEIGHT * P'(c|h')) / (n(h) + WEIGHT). A URL's score is the mean over its
characters and its end of log P_accepted - log P_rejected. The limit lies between the two kinds of
labelled URLs kept from training, at equal distance in their deviations; URLs at or above it are allowed.

Every position gives one gram of ORDER + 1 characters. Distinct grams are counted once with a map-side
part, lower orders are sums over that table, and probabilities are joined order by order on tables of
distinct grams, not of positions. Scoring joins positions to grams; adaptive execution splits a gram that
most URLs hold.

Defined results: a URL that is null or has no ``://`` has an empty host and path; a null one is scored
as the empty text. Without labelled URLs of both kinds the limit is 0 and scores are near it. Repeated
rows are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.common import own
from tidewire.session import cut

#: (verdict, host, path) of the rules.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
ORDER, WEIGHT, ALPHABET = 4, 2.0, 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: First hexadecimal digits of a URL's MD5 that are kept from training for the limit.
KEPT = "012"
START, END = "\x02", "\x03"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(F.coalesce(url, F.lit(""))), r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, at, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == at) | host.endswith("." + at)) & path.startswith(start)
        text, verdict = F.when(fits, F.lit(at + start)).otherwise(text), F.when(fits, F.lit(said)).otherwise(verdict)
    return text, verdict


def _grams(url: Column) -> Column:
    """One gram per character and one for the end.

    The characters are split once and bound to a name, so that a gram costs the same at every place of a long URL.
    """
    characters = F.split(F.concat(F.lit(START * ORDER), url, F.lit(END)), "")

    def of(c: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(c) - (ORDER + 1))
        return F.transform(starts, lambda i: F.concat(*[F.get(c, i + k) for k in range(ORDER + 1)]))

    return F.get(F.transform(F.array(characters), of), F.lit(0))


def gram_ratios(urls: DataFrame) -> DataFrame:
    """(gram, ratio) of every gram of ``urls(u, kind)``; kind is allow or block in training rows, else null."""
    counts = (
        urls.select("kind", F.explode(_grams(F.col("u"))).alias("gram")).groupBy("gram")
        .agg(F.count_if(F.col("kind") == "allow").alias("a"), F.count_if(F.col("kind") == "block").alias("r"))
    )
    counts = cut(counts, "grams")
    lower = None
    for order in range(ORDER + 1):
        tail = F.substring("gram", ORDER + 1 - order, order + 1)
        here = counts.groupBy(tail.alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        here = here.withColumn("context", F.substring("gram", 1, order))
        contexts = here.groupBy("context").agg(F.sum("a").alias("ca"), F.sum("r").alias("cr"))
        here = here.join(contexts, "context")
        if lower is None:
            here = here.withColumns({"pa": F.lit(1.0 / ALPHABET), "pr": F.lit(1.0 / ALPHABET)})
        else:
            here = here.withColumn("low", F.substring("gram", 2, order)).join(lower, "low")
        lower = here.select(
            F.col("gram").alias("low"),
            ((F.col("a") + F.lit(WEIGHT) * F.col("pa")) / (F.col("ca") + F.lit(WEIGHT))).alias("pa"),
            ((F.col("r") + F.lit(WEIGHT) * F.col("pr")) / (F.col("cr") + F.lit(WEIGHT))).alias("pr"),
        )
    return lower.select(F.col("low").alias("gram"), (F.log("pa") - F.log("pr")).alias("ratio"))


def judge(pages: DataFrame, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row."""
    row = own("row")
    url = F.col(url_column).cast("string")
    host, path = host_of(url), path_of(url)
    text, said = fitting_rule(F.col("host"), F.col("path"))
    rows = pages.select(F.col(id_column).alias("page_id"), F.coalesce(url, F.lit("")).alias("u"), host.alias("host"), path.alias("path"))
    rows = rows.select("*", text.alias("rule"), said.alias("said"), F.md5("u").substr(1, 1).isin(*KEPT).alias("kept"))
    rows = cut(rows.withColumn(row, F.monotonically_increasing_id()), "urls")

    ratios = cut(gram_ratios(rows.select("u", F.when(~F.col("kept"), F.col("said")).alias("kind"))), "ratios")
    positions = rows.select(row, F.explode(_grams(F.col("u"))).alias("gram"))
    scores = positions.join(ratios, "gram").groupBy(row).agg((F.sum("ratio") / F.count("*")).alias("score"))
    scored = cut(rows.drop("u").join(scores, row), "scored")

    kinds = scored.where("kept and said is not null").groupBy("said").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("deviation")
    )
    found = {r.said: (r["mean"], r.deviation) for r in kinds.collect()}
    limit = 0.0
    if len(found) == 2:
        (ma, da), (mr, dr) = found["allow"], found["block"]
        limit = (ma * dr + mr * da) / (da + dr) if da + dr > 0 else (ma + mr) / 2
    verdict = F.coalesce("said", F.when(F.col("score") >= F.lit(limit), "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
