"""The record store: an append-only Parquet table with one schema for all feeds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import RECORD
from ..session import cut


def conform(feed: DataFrame) -> DataFrame:
    """Store columns in store order; what a feed lacks is null."""
    have = set(feed.columns)
    return feed.select(
        *[
            (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in RECORD.fields
        ]
    )


def combine(*feeds: DataFrame) -> DataFrame:
    """Bag union of feeds that differ in columns."""
    return reduce(DataFrame.unionByName, [conform(f) for f in feeds])


def _there(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table, or no rows where nothing was written yet."""
    if _there(spark, path):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


_MONTH = T.StructField("ingest_month", T.StringType())
_KEYS = T.StructType([T.StructField("key", T.StringType()), T.StructField("by", T.StringType()), T.StructField("bucket", T.IntegerType())])
_BITMAPS = "by string, bucket int, part int, bits binary, n long"
#: Keys of one bucket, and parts of its bitmap; a part has as many bits as Spark's bitmap functions give it.
KEY_TARGET, BITMAP_PARTS, PART_BITS = 65_536, 8, 32_768
#: Keys per bucket from which a batch opens all buckets without a look at the bits.
DENSE = 256


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All records; a store that was never written to has none. ``source`` and ``ingest_month`` are
    folders, so a filter on either leaves the other folders unread."""
    rows = _read(spark, f"{path}/records", T.StructType([*RECORD.fields, _MONTH]))
    return rows.select(*[f.name for f in RECORD.fields], _MONTH.name)


def import_json(spark: SparkSession, path: str) -> DataFrame:
    """A landed JSON array file as records. A file that cannot be read fails the job."""
    landed = T.StructType(
        [
            T.StructField(f.name, T.StringType() if f.name == "value" else f.dataType)
            for f in RECORD.fields
            if f.name != "value_raw"
        ]
    )
    rows = spark.read.schema(landed).json(path, multiLine=True, mode="FAILFAST")
    return conform(
        rows.withColumn("value_raw", F.col("value")).withColumn(
            "value", F.col("value").try_cast("double")
        )
    )


def append(records: DataFrame, path: str, ready: bool = False) -> None:
    """Adds records and the keys they are known by. ``ready`` records are computed again at will, as rows of written tables are.

    Records go first, then the bits of their keys, then the keys: if a job dies in between, no stored key lacks its bit,
    and ``renew_keys`` brings back keys that were lost.
    """
    spark = records.sparkSession
    rows = conform(records) if ready else cut(conform(records), "batch")
    # Told before the records are written, as what is unseen may depend on the keys that are stored.
    keys = cut(_keys(rows), "keys")
    month = F.date_format("ingestion_timestamp", "yyyyMM")
    # By both folders, so that a task writes few of them; a folder with much has many files.
    rows.withColumn(_MONTH.name, month).hint("rebalance", "source", _MONTH.name).write.mode("append").partitionBy(
        "source", _MONTH.name
    ).parquet(f"{path}/records")
    buckets, needed = key_buckets(spark, path), _needed(keys)
    if buckets and needed > 2 * buckets:
        # These keys alone would overfill the buckets: all are dealt anew, at once.
        renew_keys(spark, path)
        return
    _write_keys(keys, path, buckets or needed, "append")
    _grow(spark, path)


def _grow(spark: SparkSession, path: str) -> None:
    """More buckets where one of them holds more than twice the keys that it should."""
    buckets = key_buckets(spark, path)
    largest = _bits(spark, path, buckets).groupBy("by", "bucket").agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > 2 * KEY_TARGET:
        renew_keys(spark, path)


def _needed(keys: DataFrame) -> int:
    """Buckets for written keys, a power of two; by the kind that has most, repeats included."""
    most = keys.groupBy("by").count().agg(F.max("count")).first()[0] or 0
    return 1 << max(0, -(-most // KEY_TARGET) - 1).bit_length()


def key_buckets(spark: SparkSession, path: str) -> int:
    """Into how many buckets the keys are dealt; 0 for a store without keys. A layout counts once it was written whole."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/keys")
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in system.listStatus(root)] if system.exists(root) else []
    done = [p.getName() for p in found if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return max((int(name.split("=")[1]) for name in done if name.startswith("buckets=")), default=0)


def renew_keys(spark: SparkSession, path: str) -> None:
    """The key table again, from the records, in as many buckets as they need. Layouts of other sizes go."""
    keys = cut(_keys(read_store(spark, path)), "keys")
    buckets = _needed(keys)
    _write_keys(keys, path, buckets, "overwrite")
    for name in ("keys", "bitmaps"):
        root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        system = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for found in system.listStatus(root):
            if found.getPath().getName() != f"buckets={buckets}":
                system.delete(found.getPath(), True)


def _write_keys(keys: DataFrame, path: str, buckets: int, mode: str) -> None:
    """Bits and keys of written :func:`_keys`. Keys travel once: each bucket is dealt to one task and written, and from there
    its bits are made where its keys are, and its folder is written."""
    dealt = cut(keys.withColumn("bucket", _bucket(buckets)).repartition("by", "bucket").distinct(), "dealt")
    at = _bit()
    bits = dealt.groupBy("by", "bucket", F.expr(f"{at} div {PART_BITS}").cast("int").alias("part")).agg(
        F.bitmap_construct_agg(F.expr(f"{at} % {PART_BITS}")).alias("bits"), F.count(F.lit(1)).alias("n")
    )
    bits.write.mode(mode).parquet(f"{path}/bitmaps/buckets={buckets}")
    dealt.write.mode(mode).partitionBy("by", "bucket").parquet(f"{path}/keys/buckets={buckets}")


def _keys(records: DataFrame) -> DataFrame:
    """What records are known by: ``key, by``, repeats included."""
    known = F.inline(F.array(
        F.struct(record_key().alias("key"), F.lit("record_id").alias("by")),
        F.struct(_filled("url").alias("key"), F.lit("url").alias("by")),
    ))
    return records.select(known).filter("key is not null")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int")


def _bit() -> str:
    """A key's place in its bucket's bitmap, by another hash than that of the bucket."""
    return f"pmod(xxhash64('bit', key), {BITMAP_PARTS * PART_BITS})"


def _bits(spark: SparkSession, path: str, buckets: int) -> DataFrame:
    return _read(spark, f"{path}/bitmaps/buckets={buckets}", T._parse_datatype_string(_BITMAPS))


def possible_buckets(keys: DataFrame, path: str, by: str) -> list[int]:
    """Buckets that may hold some of ``keys(key)``: those where a key's bit is set. At most as many as there are buckets;
    all of them for so many keys that each would be opened anyway."""
    spark = keys.sparkSession
    buckets = key_buckets(spark, path)
    if not buckets:
        return []
    asked = keys.filter("key is not null")
    if asked.limit(DENSE * buckets + 1).count() > DENSE * buckets:
        return list(range(buckets))
    merged = _bits(spark, path, buckets).filter(F.col("by") == by).groupBy("bucket", "part").agg(F.bitmap_or_agg("bits").alias("bits"))
    asked = asked.select(
        _bucket(buckets).alias("bucket"), F.expr(f"{_bit()} div {PART_BITS}").cast("int").alias("part"),
        F.expr(f"cast({_bit()} % {PART_BITS} as int)").alias("at"),
    ).distinct()
    byte = F.conv(F.hex(F.substring("bits", F.expr("at div 8 + 1").cast("int"), F.lit(1))), 16, 10).cast("bigint")
    held = asked.join(merged, ["bucket", "part"]).filter(F.call_function("getbit", byte, F.expr("at % 8")) == 1)
    return sorted(r["bucket"] for r in held.select("bucket").distinct().collect())


def known_keys(spark: SparkSession, path: str, by: str, only: list[int] | None = None) -> DataFrame:
    """Keys that the store holds, of one kind, of all buckets or of some: ``key, bucket``. Other buckets stay unread."""
    rows = _read(spark, f"{path}/keys/buckets={key_buckets(spark, path)}", _KEYS).filter(F.col("by") == by)
    return (rows if only is None else rows.filter(F.col("bucket").isin(only))).select("key", "bucket")


def _filled(name: str) -> Column:
    return F.nullif(F.col(name), F.lit(""))


def record_key() -> Column:
    """What tells records apart: the id, or the url where a feed gives no id."""
    return F.coalesce(_filled("record_id"), _filled("url"))


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """First row of every key. The rank filter is applied before the shuffle as well, so a key
    with very many rows sends one row per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def _unseen(incoming: DataFrame, known: DataFrame, order: list[Column], repeats: bool) -> DataFrame:
    """Rows of ``incoming`` whose ``key`` is null or not in ``known(key)``; of rows with one key
    the first, unless repeats stay. Rows without a key are all kept, as nothing says they are the same."""
    keyed = incoming.filter("key is not null")
    once = keyed if repeats else first_per(keyed, ["key"], order)
    fresh = once.join(known.select("key"), "key", "left_anti")
    return fresh.unionByName(incoming.filter("key is null")).drop("key")


def _as_known(stored: DataFrame, key: Column) -> DataFrame:
    return stored.select(key.alias("key")).distinct()


def unseen_by_id(
    incoming: DataFrame, stored: DataFrame, order: list[Column], strict: bool = False
) -> DataFrame:
    """Records that are not stored, by id, or by url where there is no id.

    Repeats inside the batch are dropped too, unless ``strict`` asks to keep them.
    """
    return _unseen(incoming.withColumn("key", record_key()), _as_known(stored, record_key()), order, strict)


def unseen_by_url(incoming: DataFrame, stored: DataFrame, order: list[Column]) -> DataFrame:
    """First record of every url that no source has stored."""
    return _unseen(incoming.withColumn("key", _filled("url")), _as_known(stored, _filled("url")), order, False)


def _unseen_stored(batch: DataFrame, known: DataFrame | None, order: list[Column]) -> DataFrame:
    """:func:`_unseen` of a written batch, read three times: keys that come twice are found by the keys alone and written, so
    only their rows travel and are sorted, and the rows of all others stay where they are."""
    keyed = batch.filter("key is not null")
    repeated = cut(keyed.groupBy("key").count().filter("count > 1").select("key"), "repeated")
    once = keyed
    if not repeated.isEmpty():
        # The order may look at whole rows, so their columns stay where they were.
        firsts = first_per(keyed.join(repeated, "key", "left_semi").select(*batch.columns), ["key"], order)
        once = keyed.join(repeated, "key", "left_anti").unionByName(firsts)
    fresh = once if known is None else once.join(known.select("key"), "key", "left_anti")
    return fresh.unionByName(batch.filter("key is null")).drop("key")


def append_unseen(spark: SparkSession, incoming: DataFrame, path: str, key: str = "record_id", ready: bool = False) -> None:
    """Append what the store does not hold yet, by ``record_id`` or by ``url``.

    Records are not read, and of the key table only the buckets where a key of the batch has its bit set. ``ready`` rows are
    those of a written table, which are not written again before they are looked up.
    """
    order = [F.col("ingestion_timestamp").asc_nulls_last(), F.xxhash64(F.to_json(F.struct("*")))]
    own = _filled("url") if key == "url" else record_key()
    batch = conform(incoming).withColumn("key", own)
    if not ready:
        batch = cut(batch, "incoming")
    opened = possible_buckets(batch.select("key"), path, key)
    known = known_keys(spark, path, key, opened) if opened else None
    append(_unseen_stored(batch, known, order), path, ready=True)


def route(records: DataFrame) -> DataFrame:
    """Adds ``route``: indicator, weather or article. A missing source goes to the articles."""
    source = F.coalesce(F.col("source"), F.lit("GDELT"))
    return records.withColumn(
        "route",
        F.when(source.isin("WorldBank", "NDAP"), "indicator")
        .when(source == "IMD", "weather")
        .otherwise("article"),
    )


def latest(records: DataFrame, n: int = 3) -> DataFrame:
    """Newest records by the text of their ingestion time; a missing time sorts last."""
    stamp = F.coalesce(F.col("ingestion_timestamp").cast("string"), F.lit(""))
    return records.orderBy(stamp.desc(), F.col("record_id")).limit(n)


def overview(records: DataFrame, n: int = 3) -> DataFrame:
    """The newest records, each beside the number of records in the store."""
    total = records.agg(F.count(F.lit(1)))
    return latest(records, n).withColumn("total", total.scalar())
