"""Session settings and the one place where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_local_scratch: dict[str, str] = {}
_passing: ContextVar[str] = ContextVar("passing", default="")


def local_session(cores: str = "*", name: str = "tidewire", **conf: str) -> SparkSession:
    """A session for tests and the bench. A cluster brings its own settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.codegen.cache.maxEntries", "1000")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may fall back to a
    temporary folder: on a cluster that folder would be a different one on every machine.
    """
    app = spark.conf.get("spark.app.id", "local")
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/tidewire-{app}"
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="tidewire-")
    return _local_scratch[app]


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what :func:`cut` wrote for this application. For the end of a job, or between jobs: no
    DataFrame that was made before can be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def passing_scratch(spark: SparkSession) -> Iterator[None]:
    """What is cut inside is deleted at the end: for the batches of a stream, which would fill the folder."""
    folder = f"{scratch_root(spark)}/passing-{uuid.uuid4().hex}"
    token = _passing.set(folder)
    try:
        yield
    finally:
        _passing.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_passing.get() or scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    The written table survives lost executors, is computed once however often it is used, and
    gives the planner a true size for the joins that follow.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
