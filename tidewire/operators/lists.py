"""Entity lists of records as lists of keys."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.names import entity_list, location_key, name_key, theme_key
from ..session import cut


def keyed(records: DataFrame) -> DataFrame:
    """Entity lists as distinct keys: names without titles, themes and places without offsets,
    no empty entries. A record counts an entity once however often it names it."""
    return records.withColumns(
        {
            "persons": entity_list("persons", name_key),
            "organizations": entity_list("organizations", name_key),
            "locations": entity_list("locations", location_key),
            "themes": entity_list("themes", theme_key),
        }
    )


def stored_keyed(records: DataFrame, *more: str) -> DataFrame:
    """Urls and keyed lists, and ``more`` columns, written once for all that is built of them."""
    return cut(keyed(records).select("url", "persons", "organizations", "locations", "themes", *more), "keyed")
