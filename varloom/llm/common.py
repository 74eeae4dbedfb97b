"""Shared helpers: the shared scratch folder, checkpoints, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; in local mode one of the machine where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(root or tempfile.mkdtemp(prefix="spark-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return root or current.get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str, per_file: int = 0) -> DataFrame:
    """The rows written as Parquet to the shared folder and read back; cuts the lineage. `per_file` bounds the rows of a file: rows of
    megabytes are written and read by row groups, which hold a hundred rows at least where a file has them."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", per_file).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def byte_slices(texts: pa.Array, size: int = 1 << 25):
    """A batch of texts in slices of about `size` bytes, one text at least, so that work in Arrow stays bounded."""
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield texts.slice(at, to - at)
        at = to


def lists(flat: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    """Lists over flat values; ends begins with 0."""
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def list_ends(rows: pa.ListArray) -> np.ndarray:
    """Offsets of a whole list array, from 0."""
    ends = rows.offsets.to_numpy()
    return ends - ends[0]


def id_crc(col: str = "doc_id") -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(F.col(col).cast("string"))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(u, v) links -> (id, component): the smallest id reachable from each linked id.

    Alternating large-star and small-star contraction: each round every node is tied to the
    smallest id it sees, so the number of rounds grows with the logarithm of the component
    size. Only DataFrame joins and min() with map-side combine; nothing comes to the driver but
    three numbers a round. Each round is written to the shared folder, so a lost executor costs
    one round at most. Ids without links do not appear.
    """
    e = saved(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where(F.col("u") != F.col("v")).distinct(), "links")
    mark = _mark(e)
    for _ in range(rounds):
        if mark[0] == 0:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.where(F.col("v") > F.col("u")).join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = saved(large.where(F.col("u") != F.col("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where(F.col("v") != F.col("m"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))))
        e = saved(small.where(F.col("u") != F.col("v")).distinct(), "small")
        now = _mark(e)
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return stars.unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest place linked with each of n places, by label spreading with pointer jumping."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        root = root[root]
        while (root != root[root]).any():
            root = root[root]
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    return root


def _mark(e: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(e.agg(
        F.count("*"), F.coalesce(F.sum(h.bitwiseAND(0xFFFFFFFF)), F.lit(0)),
        F.coalesce(F.sum(F.shiftrightunsigned(h, 32)), F.lit(0))).first())


def has_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra ones, whatever their names, take no part."""
    return df.select(*names)
