"""Session construction and the settings every job of this library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.python.sql.dataFrameDebugging.enabled": "false",  # one stack trace less per expression
}


def build_session(app: str = "policylake", master: str | None = None, **conf: str) -> SparkSession:
    """Session with adaptive execution on and UTC timestamps; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder that the cluster names in ``spark.checkpoint.dir``; in local mode, where it may be unset, an own one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "policylake-checkpoints")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the place that all executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    files, place = _file_system(spark, path)
    return files.exists(place)


_STAGED: ContextVar[list[str] | None] = ContextVar("staged", default=None)


@contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Owner of the tables that ``materialize`` writes inside: they go when the block ends.

    For jobs that write their results; a frame that is read later must not depend on them.
    """
    mine: list[str] = []
    token = _STAGED.set(mine)
    try:
        yield
    finally:
        _STAGED.reset(token)
        for path in mine:
            files, place = _file_system(spark, path)
            files.delete(place, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate table once and read it back.

    For results that several outputs share and that are costly to derive: without it every
    output would repeat the extraction. The table survives lost executors, keeps column pruning
    and gives the following joins real sizes.
    """
    spark = df.sparkSession
    path = new_folder(spark, "stage")
    if (owned := _STAGED.get()) is not None:
        owned.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
