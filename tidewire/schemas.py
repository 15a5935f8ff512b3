"""Explicit schemas. Nothing is inferred from data."""

from pyspark.sql import types as T

S = T.StringType()
A = T.ArrayType(S)

# The 31 columns of a knowledge-graph feed file, in file order.
GKG_COLUMNS = [
    "GKGRECORDID", "DATE", "SourceCollectionIdentifier", "SourceCommonName",
    "DocumentIdentifier", "Counts", "V2Counts", "Themes", "V2Themes", "Locations",
    "V2Locations", "Persons", "V2Persons", "Organizations", "V2Organizations", "Tone",
    "EnhancedDates", "EnhancedLocations", "EnhancedThemes", "EnhancedPersons",
    "EnhancedOrganizations", "GCAM", "SharingImage", "RelatedImages", "SocialImageEmbeds",
    "SocialVideoEmbeds", "Quotations", "AllNames", "Amounts", "TranslationInfo", "Extras",
]


def _struct(*fields):
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


# The message schema of the stream.
MESSAGE = _struct(
    ("source", S), ("record_id", S), ("date", S), ("url", S), ("source_name", S),
    ("themes", A), ("persons", A), ("organizations", A), ("locations", A), ("tone", S),
    ("ingestion_timestamp", S),
)

# What the enrichment job writes; batch and kind are folders.
ENRICHED = T.StructType(
    [T.StructField("value", S), *MESSAGE.fields, *_struct(("reason", S), ("ai_insight", S), ("batch_id", T.LongType()), ("kind", S)).fields]
)

# The record store: the message fields plus what single sources add.
RECORD = T.StructType(
    MESSAGE.fields[:-1]
    + [T.StructField("ingestion_timestamp", T.TimestampType())]
    + _struct(
        ("title", S), ("indicator_code", S), ("indicator_name", S), ("country", S),
        ("year", S), ("value_raw", S), ("value", T.DoubleType()),
        ("raw_row", T.MapType(S, S)), ("alert_text", S), ("alert_type", S),
        ("original_content", S), ("processed_content", S), ("language", S),
        ("is_translated", T.BooleanType()),
    ).fields
)

NODE_KEY = ["label", "key"]
EDGE_KEY = ["src_label", "src", "rel_type", "dst_label", "dst"]
EDGE_COLUMNS = EDGE_KEY + ["weight"]
