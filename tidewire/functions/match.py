"""Case-folded substring tests against short word lists."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import title_case


def mentions_any(columns: list[Column], terms: list[str]) -> Column:
    """True when any term occurs, ignoring case, inside any of the columns.

    The columns are joined by a line break, which no term holds, so one pass over one text
    answers for all of them.
    """
    pattern = "|".join(re.escape(t.lower()) for t in terms)
    return F.lower(F.concat_ws("\n", *columns)).rlike(pattern)


def matching(text: Column, words: list[str]) -> Column:
    """All words that occur in the text, in the order of the word list."""
    low = F.lower(text)
    return F.array_compact(
        F.array(*[F.when(F.contains(low, F.lit(w.lower())), F.lit(w)) for w in words])
    )


def alert_type(text: Column, keywords: list[str], default: str = "Weather Alert") -> Column:
    """First keyword in list order, title-cased. List order wins over text order."""
    return F.coalesce(title_case(F.get(matching(text, keywords), F.lit(0))), F.lit(default))


def strip_quotes(c: Column) -> Column:
    """Single quotes first, then double quotes, from both ends."""
    return F.btrim(F.btrim(c, F.lit("'")), F.lit('"'))


def is_url(c: Column) -> Column:
    return c.rlike("^https?://")


def domain(url: Column) -> Column:
    """Text after the last ``//`` up to the next ``/``."""
    return F.substring_index(F.substring_index(url, "//", -1), "/", 1)


def has_script(c: Column, first: str = "\\u0900", last: str = "\\u097F") -> Column:
    """True when any character lies in the given range (Devanagari by default)."""
    return F.coalesce(c.rlike(f"[{first}-{last}]"), F.lit(False))


def cited_ids(text: Column) -> Column:
    """Distinct numbers written as ``[n]``."""
    found = F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), F.lit(1))
    return F.array_distinct(F.array_compact(F.transform(found, lambda x: x.try_cast("int"))))


def card_url(card: Column) -> Column:
    return F.regexp_extract(card, r"URL:\s*(\S+)", 1)


def card_source(card: Column) -> Column:
    """First word after ``SOURCE:``; a source of several words is cut at its first blank."""
    found = F.regexp_extract(card, r"SOURCE:\s*([^\s|]+)", 1)
    return F.when(found == "", F.lit("Unknown")).otherwise(found)


def headline(text: Column, default: str = "Untitled page") -> Column:
    """First line cut to 100 characters."""
    line = F.left(F.substring_index(text, "\n", 1), F.lit(100))
    return F.when(text.isNull() | (text == ""), F.lit(default)).otherwise(line)


def truncate(c: Column, n: int, marker: str = "... [TRUNCATED] ...") -> Column:
    """Cut to ``n`` characters; the marker tells that something was cut."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(marker))).otherwise(c)
