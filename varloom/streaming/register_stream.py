"""Incremental registration: a file stream whose micro-batches are merged into the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.operators import standing
from varloom.session import saved


def register_stream(stream: DataFrame, path: str, to_batch, checkpoint: str):
    """Starts a query that registers each micro-batch in the standing tables below `path`; to_batch makes (batch, ids) of its rows.

    A micro-batch is registered under its own number, so one that runs again writes the same partitions with the same rows.
    The caller stops the query.
    """

    def merge(rows: DataFrame, batch_id: int) -> None:
        batch, ids = to_batch(saved(rows, "micro-batch"))
        standing.register(path, batch, ids, batch_id + 1)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_batch(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events as registrations: the user's place is the definition, the event a foreign id of it."""
    one = rows.where(F.col("user_id").isNotNull()).select(
        F.col("event_id").alias("row_id"), F.sha2(F.col("user_id").cast("string"), 256).alias("variant_key"), F.lit(0).cast("long").alias("ref_id"),
        F.col("user_id").alias("n_left"), (F.col("user_id") + 1).alias("n_right"), F.lit(0).alias("category"), F.lit(0).cast("long").alias("length_change"),
        F.lit("A").alias("inserted"), F.lit("C").alias("original"), F.lit(None).cast("long").alias("given_id"))
    ids = rows.select(F.col("event_id").alias("row_id"), F.lit("dbSNP").alias("id_type"), F.col("event_id").alias("id"), F.lit(None).cast("string").alias("attrs"))
    return one, ids
