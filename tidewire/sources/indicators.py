"""Economic indicators: a service that answers ``[meta, rows]`` and a portal with free columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import (
    INDICATORS,
    PORTAL_PLACE_KEYS,
    PORTAL_RESERVED,
    PORTAL_YEAR_KEYS,
)


def request_grid(countries: DataFrame, indicators: dict[str, str] = INDICATORS) -> DataFrame:
    """One request per country and indicator. The indicators are a short parameter list, so each
    country row carries and unfolds them; nothing is joined."""
    wanted = F.array(
        *[
            F.struct(F.lit(code).alias("indicator_code"), F.lit(name).alias("indicator_name"))
            for code, name in indicators.items()
        ]
    )
    return countries.select("*", F.inline(wanted))


def flatten_responses(responses: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Records from answers ``[meta, rows]`` beside their request columns; null values dropped."""
    rows = F.from_json(
        F.get_json_object("body", "$[1]"), "array<struct<date string, value double>>"
    )
    year = F.coalesce(F.col("entry.date"), F.lit("Unknown"))
    value = F.col("entry.value")
    return (
        responses.select("*", F.explode(rows).alias("entry"))
        .filter(value.isNotNull())
        .select(
            F.lit("WorldBank").alias("source"),
            F.concat_ws("-", F.lit("wb"), "country_code", "indicator_code", year).alias("record_id"),
            period_start(year).alias("date"),
            F.concat(
                F.lit("https://data.worldbank.org/indicator/"), "indicator_code",
                F.lit("?locations="), "country_code",
            ).alias("url"),
            F.format_string(
                "%s — %s (%s): %.2f", F.col("indicator_name"), F.col("country"), year, value
            ).alias("title"),
            F.array(F.lit("Economics"), F.col("indicator_name")).alias("themes"),
            F.array().cast("array<string>").alias("persons"),
            F.array(F.lit("World Bank")).alias("organizations"),
            F.array("country").alias("locations"),
            F.lit("0").alias("tone"),
            (F.current_timestamp() if ingested_at is None else ingested_at).alias(
                "ingestion_timestamp"
            ),
            "indicator_code",
            "indicator_name",
            F.format_string("%s", value).alias("value_raw"),
            value.alias("value"),
            year.alias("year"),
            "country",
        )
    )


def period_start(year: Column) -> Column:
    return F.concat(F.left(year, F.lit(4)), F.lit("0101"))


def most_recent(records: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` newest values per country and indicator; empty years are gone already."""
    w = Window.partitionBy("country", "indicator_name").orderBy(F.col("year").desc(), "record_id")
    return (
        records.filter(F.col("value").isNotNull())
        .withColumn("recency", F.row_number().over(w))
        .filter(F.col("recency") <= n)
    )


def _first_of(row: Column, keys: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.try_element_at(row, F.lit(k)), F.lit("")) for k in keys])


def portal_rows(responses: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """Records from portal answers whose rows name their columns freely.

    ``responses`` has ``resource_id``, ``name``, ``themes`` and ``body``. Answers without success
    give nothing. The value is the first column, in the order of the answer, that does not
    describe place, time or row number.
    """
    answer = F.from_json(
        "body", "struct<success boolean, result struct<records array<map<string,string>>>>"
    )
    row = F.col("row")
    place = F.coalesce(_first_of(row, PORTAL_PLACE_KEYS), F.lit("India"))
    now = F.year(F.current_timestamp()).cast("string")
    year = F.coalesce(_first_of(row, PORTAL_YEAR_KEYS), now)
    free = F.filter(F.map_keys(row), lambda k: ~k.isin(PORTAL_RESERVED))
    value = F.coalesce(F.try_element_at(row, F.get(free, F.lit(0))), F.lit("N/A"))
    row_id = F.coalesce(
        F.try_element_at(row, F.lit("_id")), F.sha2(F.to_json(row), 256)
    )
    return (
        responses.withColumn("answer", answer)
        .filter(F.col("answer.success"))
        .select("resource_id", "name", "themes", F.explode("answer.result.records").alias("row"))
        .select(
            "resource_id", "name", "themes", "row",
            place.alias("place"), year.alias("year"), value.alias("value_raw"), row_id.alias("rid"),
        )
        .select(
            F.lit("NDAP").alias("source"),
            F.concat_ws("-", F.lit("ndap"), "resource_id", "rid").alias("record_id"),
            period_start(F.col("year")).alias("date"),
            F.concat(F.lit("https://ndap.niti.gov.in/dataset/"), "resource_id").alias("url"),
            F.format_string("%s — %s (%s): %s", "name", "place", "year", "value_raw").alias("title"),
            "themes",
            F.array().cast("array<string>").alias("persons"),
            F.array(F.lit("NITI Aayog")).alias("organizations"),
            F.array("place", F.lit("India")).alias("locations"),
            F.lit("0").alias("tone"),
            (F.current_timestamp() if ingested_at is None else ingested_at).alias(
                "ingestion_timestamp"
            ),
            F.col("name").alias("indicator_name"),
            "value_raw",
            F.col("value_raw").try_cast("double").alias("value"),
            "year",
            F.col("row").alias("raw_row"),
        )
    )
