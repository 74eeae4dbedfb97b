"""The shared scratch folder of a session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; in local mode in a folder of the machine where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not current.isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
            current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back; cuts the lineage."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_STORED: dict[tuple, str] = {}
_KEPT: dict[tuple, DataFrame] = {}


def stamp(spark: SparkSession, folder: str) -> tuple:
    """Number, sizes and modification times of the files below a folder: another stamp, other data."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "modificationTime", "length")
    return tuple(files.agg(F.count("*"), F.sum("length"), F.sum(F.xxhash64("path", "modificationTime", "length").bitwiseAND((1 << 40) - 1))).first())


def stored(spark: SparkSession, name: str, folder: str, make) -> DataFrame:
    """The table that make() derives from a folder's files, written once a session and again once the files have changed."""
    at = (spark.sparkContext.applicationId, name, folder, *stamp(spark, folder))
    if at not in _STORED:
        path = scratch_path(spark, name)
        make().write.option("compression", "zstd").parquet(path)
        _STORED[at] = path
    return spark.read.parquet(_STORED[at])


def kept(spark: SparkSession, name: str, folder: str, make) -> DataFrame:
    """As stored, for a table whose rows make() has written already: nothing is written again."""
    at = (spark.sparkContext.applicationId, name, folder, *stamp(spark, folder))
    if at not in _KEPT:
        _KEPT[at] = make()
    return _KEPT[at]
