"""Knowledge-graph feed files: manifest, zip scan, relevance filter, canonical projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import BATCH_TERMS
from ..functions.match import mentions_any
from ..functions.names import split_list
from ..schemas import GKG_COLUMNS
from . import archives

def newest_entry(manifest: DataFrame, marker: str = "gkg.csv.zip") -> DataFrame:
    """The url of the newest feed file named in a manifest, a one-row table.

    A line is ``size checksum url`` and the file name starts with its 14-digit time. Line order
    does not survive a distributed read, the time in the name does.
    """
    line = F.col("value")
    url = F.element_at(F.split(F.rtrim(line), " "), -1)
    stamp = F.regexp_extract(url, r"([0-9]{14})[^/]*$", 1)
    return manifest.filter(F.contains(line, F.lit(marker))).agg(
        F.max_by(url, F.struct(stamp, url)).alias("url")
    )


def read_zips(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the first member of every archive."""
    return parse_lines(archives.read_lines(spark, path, members="first"))


def stream_zips(spark: SparkSession, path: str) -> DataFrame:
    """The same scan over archives as they arrive, each once."""
    return parse_lines(archives.stream_lines(spark, path, members="first"))


def parse_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """31 text columns from tab-separated lines; longer lines are skipped, shorter ones padded."""
    width = len(GKG_COLUMNS)
    fields = F.split(F.col(column), "\t", -1)
    kept = lines.filter((F.trim(F.col(column)) != "") & (F.size(fields) <= width))
    return kept.select(
        *[F.nullif(F.get(fields, F.lit(i)), F.lit("")).alias(c) for i, c in enumerate(GKG_COLUMNS)]
    )


def relevant(gkg: DataFrame, terms: list[str] = BATCH_TERMS) -> DataFrame:
    """Rows with any term inside the plain theme, place, person or organisation columns."""
    columns = [F.col(c) for c in ("Themes", "Locations", "Persons", "Organizations")]
    return gkg.filter(mentions_any(columns, terms))


def to_records(gkg: DataFrame, ingested_at: Column | None = None) -> DataFrame:
    """The canonical message fields; lists come from the enhanced (V2) columns."""
    return gkg.select(
        F.lit("GDELT").alias("source"),
        F.col("GKGRECORDID").alias("record_id"),
        F.col("DATE").alias("date"),
        F.col("DocumentIdentifier").alias("url"),
        F.col("SourceCommonName").alias("source_name"),
        split_list(F.col("V2Themes")).alias("themes"),
        split_list(F.col("V2Persons")).alias("persons"),
        split_list(F.col("V2Organizations")).alias("organizations"),
        split_list(F.col("V2Locations")).alias("locations"),
        F.col("Tone").alias("tone"),
        (F.current_timestamp() if ingested_at is None else ingested_at).alias(
            "ingestion_timestamp"
        ),
    )
