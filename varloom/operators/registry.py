"""The registry's tables: upsert, lookups, deletions, index rebuild.

Tables: variants(variant_key, ca_id, ref_id, n_left, n_right, category, length_change, inserted,
original) and identifiers(variant_key, id_type, id, attrs). The functions take and give DataFrames;
`standing` keeps the tables on disk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.session import saved

from .normalize import NORMAL, definition_order, variant_key

DEFINITION = ["ref_id", *NORMAL]
KEY = [c for c in DEFINITION if c != "original"]
TABLES = {"variants": "variant_key string, ca_id long, ref_id long, n_left long, n_right long, category int, "
                      "length_change long, inserted string, original string",
          "identifiers": "variant_key string, id_type string, id long, attrs string"}


def assign_ids(new: DataFrame, start: int, order: list[Column]) -> DataFrame:
    """ca_id from start + 1 on in the given order, without a window over one partition.

    Rows are range-partitioned, sorted and written with their place in their partition; the counts of the
    partitions (one number each) are summed up on the driver and added to the places.
    """
    return _numbered(new.repartitionByRange(*order), start, order)


def _numbered(ranged: DataFrame, start: int, order: list[Column]) -> DataFrame:
    # The upper bits of the id are the partition, the lower 33 the row's place in it.
    parts = saved(ranged.sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "new-variants")
    p = F.shiftright("__at", 33)
    counts = sorted((r["__p"], r["n"]) for r in parts.groupBy(p.alias("__p")).agg(F.count("*").alias("n")).collect())
    offsets, at = [], start
    for q, n in counts:
        offsets.append((q, at))
        at += n
    # A row a partition: their number is that of the shuffle partitions.
    first = parts.sparkSession.createDataFrame(offsets, "__p long, __first long")
    place = F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    return parts.withColumn("__p", p).join(F.broadcast(first), "__p").withColumn("ca_id", F.col("__first") + place).drop("__p", "__first", "__at")


def register_first(batch: DataFrame) -> DataFrame:
    """The variants table of the first batch(row_id, definition), in which no row brings an id; as register gives it.

    Equal definitions meet where they are numbered: ranges of reference and place hold all rows of a definition, so that rows
    are dealt once, and the table is written once, without its keys; those are made of the definition when they are asked for.
    """
    ranged = batch.select("row_id", *DEFINITION).repartitionByRange("ref_id", "n_left")
    # The original letters are the reference's own, the same in all rows of a definition.
    one = ranged.groupBy(*KEY).agg(F.min_by("original", "row_id").alias("original"))
    return _numbered(one, 0, definition_order()).select(variant_key().alias("variant_key"), "ca_id", *DEFINITION)


def merge_batch(batch: DataFrame) -> DataFrame:
    """One row a definition of a batch(row_id, definition, given_id): its first row, the smallest given id."""
    return batch.groupBy("variant_key").agg(
        *[F.min_by(c, "row_id").alias(c) for c in DEFINITION], F.min("given_id").alias("given_id"),
        F.min("row_id").alias("row_id"))


def upsert(batch: DataFrame, ids: DataFrame, variants: DataFrame, known_ids: DataFrame, holders: DataFrame, top: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows that batch(row_id, variant_key, definition, given_id) with ids(row_id, id_type, id, attrs) adds to both tables, and an answer a row.

    variants and known_ids need to hold the batch's definitions only, holders(ca_id, variant_key) the given ids; new ids follow `top`.
    """
    one = merge_batch(batch)
    stored = variants.select("variant_key", F.col("ca_id").alias("old_id"))
    taken = holders.select(F.col("ca_id").alias("given_id"), F.col("variant_key").alias("holder"))
    met = one.join(stored, "variant_key", "left").join(taken, "given_id", "left")
    clash = F.when(F.col("old_id").isNotNull() & F.col("given_id").isNotNull() & (F.col("old_id") != F.col("given_id")), "IdentifierMismatch") \
        .when(F.col("old_id").isNull() & F.col("holder").isNotNull(), "IdentifierTaken")
    # Written once: the given ids, the new ones and the faults all come from here.
    met = saved(met.withColumn("clash", clash), "met-definitions")
    # Two new definitions that bring one id: the first in definition order has it.
    fresh = met.where(F.col("old_id").isNull() & F.col("clash").isNull())
    rank = F.row_number().over(Window.partitionBy("given_id").orderBy(*definition_order()))
    own = fresh.where(F.col("given_id").isNotNull()).withColumn("n", rank)
    given = own.where("n = 1").drop("n").withColumn("ca_id", F.col("given_id"))
    lost = own.where("n > 1").select("variant_key")
    top = max(top, given.agg(F.max("given_id")).first()[0] or 0)
    auto = assign_ids(fresh.where(F.col("given_id").isNull()), top, definition_order())
    new = given.select("variant_key", "ca_id", *DEFINITION).unionByName(auto.select("variant_key", "ca_id", *DEFINITION))
    bad = met.where(F.col("clash").isNotNull()).select("variant_key", "clash").unionByName(
        lost.withColumn("clash", F.lit("IdentifierTaken")))
    all_ids = variants.select("variant_key", "ca_id").unionByName(new.select("variant_key", "ca_id"))
    rows = batch.join(bad, "variant_key", "left").join(all_ids, "variant_key", "left")
    wrong = F.coalesce("clash", F.when(F.col("given_id").isNotNull() & (F.col("given_id") != F.col("ca_id")), "IdentifierMismatch"))
    rows = rows.withColumn("error", wrong)
    answer = rows.select("row_id", F.when(F.col("error").isNull(), F.col("ca_id")).alias("ca_id"), "error")
    return new, new_identifiers(rows.where(F.col("error").isNull()).select("row_id", "variant_key"), ids, known_ids), answer


def new_identifiers(rows: DataFrame, ids: DataFrame, known_ids: DataFrame) -> DataFrame:
    """The identifiers that ids(row_id, id_type, id, attrs) add to the variants of rows(row_id, variant_key): the first writer's attributes."""
    added = rows.join(ids, "row_id").select("variant_key", "id_type", "id", "attrs", "row_id")
    first = added.groupBy("variant_key", "id_type", "id").agg(F.min_by("attrs", "row_id").alias("attrs"))
    return first.join(known_ids, ["variant_key", "id_type", "id"], "left_anti").select("variant_key", "id_type", "id", "attrs")


def first_identifiers(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """The identifiers table of the first batch, as new_identifiers gives it where nothing stands.

    rows(row_id, variant_key); lists(row_id, ids array<struct<id_type,id,attrs>>) has a row's identifiers together, so that they are
    dealt as one row by line and as one by variant: ranges of keys hold a variant's lists, which are taken apart and compared there.
    """
    dealt = rows.join(lists, "row_id").select("variant_key", "row_id", "ids").repartition("variant_key")
    each = dealt.select("variant_key", "row_id", F.explode("ids").alias("i")).select("variant_key", "row_id", "i.*")
    return each.groupBy("variant_key", "id_type", "id").agg(F.min_by("attrs", "row_id").alias("attrs"))


def register(batch: DataFrame, ids: DataFrame, variants: DataFrame, known_ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Upserts batch(row_id, variant_key, definition, given_id) with ids(row_id, id_type, id, attrs).

    Gives the new variants table, the new identifiers table, and one answer a row (row_id, ca_id,
    error). Known definitions keep their id; new ones take the given id or the next ones in
    definition order; a given id that disagrees with the stored one, or that another definition
    holds, makes an error row and writes nothing. Attributes of the first writer stay.
    """
    top = variants.agg(F.max("ca_id").alias("m")).first()["m"] or 0
    new, extra, answer = upsert(batch, ids, variants, known_ids, variants.select("ca_id", "variant_key"), top)
    return variants.select("variant_key", "ca_id", *DEFINITION).unionByName(new), known_ids.unionByName(extra.select(known_ids.columns)), answer


def fetch_by_definition(rows: DataFrame, variants: DataFrame) -> DataFrame:
    """rows(variant_key, given_id, ...) with ca_id; null where unknown or where the given id disagrees."""
    got = rows.join(variants.select("variant_key", "ca_id"), "variant_key", "left")
    return got.withColumn("ca_id", F.when(F.col("given_id").isNull() | (F.col("given_id") == F.col("ca_id")), F.col("ca_id")))


def fetch_by_id(rows: DataFrame, variants: DataFrame) -> DataFrame:
    """rows(ca_id, ...) with the definition; error NotFound where there is none."""
    got = rows.join(variants.select("ca_id", "variant_key", *DEFINITION), "ca_id", "left")
    return got.withColumn("error", F.when(F.col("variant_key").isNull(), "NotFound"))


def remove_identifiers(known: DataFrame, gone: DataFrame) -> DataFrame:
    """Identifiers without those in gone(variant_key, id_type, id)."""
    return known.join(gone, ["variant_key", "id_type", "id"], "left_anti")


def delete_variants(gone: DataFrame, variants: DataFrame, known: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the variants in gone(ca_id)."""
    keys = variants.join(gone, "ca_id", "left_semi").select("variant_key")
    return (variants.join(gone, "ca_id", "left_anti"), known.join(keys, "variant_key", "left_anti"),
            links.join(gone, "ca_id", "left_anti"))


def delete_identifiers_of_type(known: DataFrame, types: list[str], low: int | None = None, high: int | None = None) -> DataFrame:
    """Identifiers without the types, or without their ids in [low, high]."""
    hit = F.col("id_type").isin(types)
    if low is not None:
        hit = hit & (F.col("id") >= low)
    if high is not None:
        hit = hit & (F.col("id") <= high)
    return known.where(~hit)


def rebuild_identifier_index(known: DataFrame) -> DataFrame:
    """(id_type, id, variant_key): every identifier, and the RCVs in attrs of ClinVarVariant ones."""
    rcv = known.where((F.col("id_type") == "ClinVarVariant") & F.col("attrs").isNotNull()).select(
        F.lit("ClinVarRCV").alias("id_type"), F.explode(F.split("attrs", ",")).alias("r"), "variant_key")
    rcv = rcv.select("id_type", F.regexp_replace("r", "^RCV", "").try_cast("long").alias("id"), "variant_key")
    return known.select("id_type", "id", "variant_key").unionByName(rcv.where("id is not null")).distinct()


def has_identifier_of_type(variants: DataFrame, known: DataFrame, types: list[str]) -> DataFrame:
    return variants.join(known.where(F.col("id_type").isin(types)), "variant_key", "left_semi")


def has_identifier(variants: DataFrame, index: DataFrame, id_type: str, value: int) -> DataFrame:
    return variants.join(index.where((F.col("id_type") == id_type) & (F.col("id") == value)), "variant_key", "left_semi")
