"""Binned interval joins, merging of intervals, and sequence lookup from chunk tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 16384
CHUNK, MARGIN = 4096, 64


def bins(left: Column, right: Column, size: int = BIN) -> Column:
    """The bins that [left, right] touches, as an array; right below left counts as left."""
    return F.sequence(F.floor(left / size), F.floor(F.greatest(left, right) / size))


def overlap_join(items: DataFrame, regions: DataFrame, keys: list[str], item=("left", "right"),
                 region=("from", "to"), size: int = BIN) -> DataFrame:
    """Pairs with left <= to and right > from, equal in keys.

    The region end counts as inside (an item that starts right at `to` is found), and an item of no
    length at `from` is not. Both sides are dealt to bins; a pair is kept only in the bin of its
    larger start, so none comes twice and no distinct is needed.
    """
    (l, r), (f, t) = item, region
    a = items.withColumn("__bin", F.explode(bins(F.col(l), F.greatest(F.col(l), F.col(r) - 1), size)))
    b = regions.withColumn("__bin", F.explode(bins(F.col(f), F.col(t), size)))
    met = a.join(b, [*keys, "__bin"])
    return met.where((F.col(l) <= F.col(t)) & (F.col(r) > F.col(f))
                     & (F.col("__bin") == F.floor(F.greatest(F.col(l), F.col(f)) / size))).drop("__bin")


def containment_join(items: DataFrame, blocks: DataFrame, keys: list[str], item=("left", "right"),
                     block=("b_left", "b_right"), size: int = BIN) -> DataFrame:
    """Pairs where the block holds the whole item, equal in keys; items look only into their first bin."""
    (l, r), (f, t) = item, block
    a = items.withColumn("__bin", F.floor(F.col(l) / size))
    b = blocks.withColumn("__bin", F.explode(bins(F.col(f), F.col(t), size)))
    return a.join(b, [*keys, "__bin"]).where((F.col(l) >= F.col(f)) & (F.col(r) <= F.col(t))).drop("__bin")


def merge_intervals(df: DataFrame, keys: list[str], left: str = "left", right: str = "right") -> DataFrame:
    """Overlapping or touching intervals of a key become one."""
    w = Window.partitionBy(*keys).orderBy(left, right)
    far = F.max(right).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = (far.isNull() | (F.col(left) > far)).cast("int")
    rows = df.select(*keys, left, right).withColumn("__new", new)
    rows = rows.withColumn("__isle", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "__isle").agg(F.min(left).alias(left), F.max(right).alias(right)).drop("__isle")


def bin_size(regions: DataFrame, left: str = "from", right: str = "to", least: int = 256) -> int:
    """A bin size of four mean lengths of the regions, from `least` to BIN: small regions meet few items, and dealing stays below two rows a region."""
    mean = regions.agg(F.avg(F.col(right) - F.col(left))).first()[0] or 0
    size = least
    while size < BIN and size < 4 * mean:
        size *= 2
    return size


def _at(f, step: int):
    return lambda i: f(i, step)


def ref_chunks(ref_seq: DataFrame, size: int = CHUNK, margin: int = MARGIN) -> DataFrame:
    """(ref_id, chunk_no, ctx_left, ctx, ref_len): pieces of a sequence with `margin` letters around.

    A substring is found by walking from its text's start, so long texts are cut in steps: into pieces of
    4,096 chunks, those into pieces of 64, those into chunks.
    """
    n = F.length("seq").cast("long")
    rows = ref_seq.select("ref_id", F.lit(0).cast("long").alias("at"), n.alias("end"), F.lit(0).cast("long").alias("ctx_left"),
                          F.col("seq").alias("ctx"), n.alias("ref_len"))

    def piece(i: Column, step: int) -> Column:
        at = F.col("at") + i.cast("long") * step
        end, left = F.least(at + step, "end"), F.greatest(at - margin, F.lit(0).cast("long"))
        right = F.least(end + margin, "ref_len")
        return F.struct(at.alias("at"), end.alias("end"), left.alias("ctx_left"), F.substring(
            "ctx", (left - F.col("ctx_left") + 1).cast("int"), (right - left).cast("int")).alias("ctx"))

    for step in (4096 * size, 64 * size, size):
        numbers = F.sequence(F.lit(0), F.greatest(F.floor((F.col("end") - F.col("at") - 1) / step), F.lit(0)).cast("int"))
        rows = rows.select("ref_id", "ref_len", F.explode(F.transform(numbers, _at(piece, step))).alias("p")).select("ref_id", "p.*", "ref_len")
    return rows.select("ref_id", F.floor(F.col("at") / size).alias("chunk_no"), "ctx_left", "ctx", "ref_len")


def lookup_sequence(regions: DataFrame, chunks: DataFrame, key: str, left: str = "left", right: str = "right",
                    size: int = CHUNK) -> DataFrame:
    """(key, seq) of [left, right) on ref_id for every distinct key; regions may span any number of chunks.

    Both sides are dealt by the chunk, to as many partitions as shuffles have (asks are small, the letters they stand for
    are not), and joined there by a hash of the chunks: the table, whose files unpack to many times their size, is never broadcast.
    """
    lo, hi = F.floor(F.col(left) / size), F.floor(F.greatest(F.col(left), F.col(right) - 1) / size)
    ask = regions.select(key, "ref_id", F.col(left).alias("__l"), F.col(right).alias("__r"), F.explode(F.sequence(lo, hi)).alias("chunk_no"))
    parts = int(regions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = chunks.select("ref_id", "chunk_no", "ctx_left", "ctx").hint("shuffle_hash")
    met = ask.repartition(parts, "ref_id", "chunk_no").join(text, ["ref_id", "chunk_no"])
    a = F.greatest(F.col("__l"), F.col("chunk_no") * size)
    b = F.least(F.col("__r"), (F.col("chunk_no") + 1) * size)
    part = F.substring("ctx", (a - F.col("ctx_left") + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    # A key that comes twice asks for one text: its parts are told apart by their chunk.
    return met.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_set(
        F.struct("chunk_no", part.alias("p")))), lambda x: x["p"]), "").alias("seq"))
