"""Names, themes, places and lists of them."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import NAME_PREFIXES, THEME_PREFIXES

# The characters that count as blank at the ends of a text.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_BLANKS_SQL = "'" + "".join(f"\\u{ord(c):04x}" for c in BLANKS) + "'"

# Keys of list entries are SQL texts over the name of a lambda variable, so that the expression
# for a whole list is handed to Spark in one piece.
Key = Callable[[str], str]


def strip_space(c: Column) -> Column:
    """Trim every Unicode blank, not only the space character."""
    return F.btrim(c, F.lit(BLANKS))


def name_key(x: str) -> str:
    """Text before the first comma, without leading titles.

    Each title is tried once and in order, so ``PM President X`` gives ``X`` while
    ``President PM X`` gives ``PM X``.
    """
    titles = ", ".join(f"'{p}'" for p in NAME_PREFIXES)
    bare = f"aggregate(array({titles}), substring_index({x}, ',', 1), (n, t) -> if(startswith(n, t), substr(n, length(t) + 1), n))"
    return f"btrim({bare}, {_BLANKS_SQL})"


def theme_key(x: str, source: str = "source") -> str:
    """News-graph themes carry an offset after a comma; themes of other sources are whole."""
    return f"if({source} <=> 'GDELT', substring_index({x}, ',', 1), {x})"


def location_key(x: str) -> str:
    """Second ``#`` field when there is one, else the whole text."""
    return f"if(contains({x}, '#'), substring_index(substring_index({x}, '#', 2), '#', -1), {x})"


def whole(x: str) -> str:
    return x


def entity_list(arr: str, key: Key) -> Column:
    """Distinct non-empty keys of a raw list; a null list counts as empty."""
    keys = f"filter(transform({arr}, x -> {key('x')}), k -> k <> '')"
    return F.expr(f"coalesce(array_distinct({keys}), cast(array() as array<string>))")


def split_list(c: Column) -> Column:
    """Split on ``;`` keeping a trailing empty element; null gives an empty list."""
    return F.coalesce(F.split(c, ";"), F.array().cast("array<string>"))


def article_title(title: Column, source_name: Column) -> Column:
    missing = title.isNull() | title.isin("", "No Title")
    named = F.coalesce(source_name, F.lit("Unknown Source"))
    return F.when(missing, F.concat(F.lit("Report from "), named)).otherwise(title)


def title_case(c: Column) -> Column:
    """Upper-case the first letter of every run of letters, so ``o'neil 3rd`` is ``O'Neil 3Rd``."""
    runs = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(
        F.transform(runs, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))),
        "",
    )


def strip_offset(c: Column) -> Column:
    return F.regexp_replace(c, r",[0-9]+$", "")


def theme_display(c: Column, strip_wb: bool = False) -> Column:
    """Readable theme. ``strip_wb`` also removes a leading ``WB_<digits>_``, off by default."""
    theme = strip_offset(c)
    for prefix in THEME_PREFIXES:
        theme = F.replace(theme, F.lit(prefix), F.lit(""))
    if strip_wb:
        theme = F.regexp_replace(theme, r"^WB_[0-9]+_", "")
    return title_case(F.replace(theme, F.lit("_"), F.lit(" ")))


def clean_list(arr: Column, n: int = 5) -> Column:
    """First ``n`` distinct entries without offsets; distinct comes before the cut."""
    raw = F.coalesce(arr, F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.transform(raw, lambda x: strip_space(strip_offset(x)))), 1, n)


def clean_themes(arr: Column, n: int = 6, strip_wb: bool = False) -> Column:
    raw = F.coalesce(arr, F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.transform(raw, lambda x: theme_display(x, strip_wb))), 1, n)


def list_or_none(arr: Column) -> Column:
    return F.when(F.size(arr) > 0, F.array_join(arr, ", ")).otherwise(F.lit("None"))
