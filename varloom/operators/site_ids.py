"""Ids of public variant sites from normal forms: what is kept of an id beside its variant, and its text rebuilt from both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.functions import sequences as S
from varloom.session import saved

from . import hgvs
from .intervals import lookup_sequence
from .normalize import NORMAL, left_aligned, normalize, right_aligned


def parse_myvariant(ids: DataFrame, assemblies: DataFrame, chunks: DataFrame, few: bool = False) -> DataFrame:
    """(row_id, ref_id, normal form, style, shift, extend, error) of ids(row_id, id) on the references of assemblies(chrom, ref_id).

    style, shift and extend are all that the text has beside its variant: shift is the way from the text's place to the
    right-aligned form, extend the number of letters that it names behind the change. The letters of a duplication come from the reference.
    `few` as in normalize. Errors: the text's own, UnknownReferenceName, and those of normalize; null ids are UnknownFormatOfMyVariantInfoIdentifier.
    """
    got = hgvs.myvariant_parts(ids.withColumn("id", F.coalesce("id", F.lit(""))))
    # 25 rows a build at most.
    got = got.join(F.broadcast(assemblies.select("chrom", "ref_id").dropDuplicates(["chrom"])), "chrom", "left")
    error = F.coalesce("error", F.when(F.col("ref_id").isNull(), "UnknownReferenceName"))
    wrong = (F.col("tail").try_cast("long") != F.col("size")) | (F.col("tail").rlike("^[ACGT]+$") & (F.length("tail") != F.col("size")))
    got = saved(got.withColumn("error", F.coalesce(error, F.when(wrong, "UnknownFormatOfMyVariantInfoIdentifier"))).drop("tail"), "site-ids")
    dup = F.col("style").startswith("duplication")
    # Only duplications meet their letters.
    twice = F.col("error").isNull() & dup
    copies = lookup_sequence(got.where(twice).select("row_id", "ref_id", (F.col("left") - F.col("size")).alias("left"), "right"), chunks, "row_id")
    twins = got.where(twice).join(copies, "row_id", "left")
    twins = twins.withColumn("error", F.when(F.col("given").isNotNull() & (F.col("given") != F.col("seq")), "IncorrectReferenceAllele"))
    rows = twins.unionByName(got.where(~F.coalesce(twice, F.lit(False))), allowMissingColumns=True)
    plain = rows.where(F.col("error").isNull()).select("row_id", "ref_id", "left", "right", F.when(dup, "").otherwise(F.coalesce("given", F.lit(""))).alias("ref"),
                                                       F.when(dup, F.col("seq")).otherwise(F.col("alt")).alias("alt"), "style", dup.alias("dup"))
    forms = right_aligned(normalize(plain, chunks, few=few)).withColumnRenamed("left", "at").withColumnRenamed("right", "end")
    extend = F.when(F.col("dup"), 0).otherwise(F.col("end") - F.greatest("at", "n_left") - (F.col("p_right") - F.col("p_left")))
    good = forms.select("row_id", "ref_id", *NORMAL, "style", (F.col("p_left") - F.col("at")).alias("shift"), extend.alias("extend"), F.col("error.type").alias("error"))
    return good.unionByName(rows.where(F.col("error").isNotNull()).select("row_id", "ref_id", "error"), allowMissingColumns=True)


def myvariant_ids(forms: DataFrame, chunks: DataFrame) -> DataFrame:
    """(row_id, id) of forms(row_id, chrom, ref_id, normal form, style, shift, extend) in the id's own build.

    The left-aligned form is turned to the text's place or gets the letters before it, then those behind it.
    """
    right = right_aligned(forms).withColumn("r_left", F.col("p_left")).drop("p_left", "p_right", "p_ref", "p_alt")
    rows = left_aligned(right).withColumn("over", F.col("p_left") + F.col("shift") - F.col("r_left"))
    before, move = F.greatest("over", F.lit(0)), F.greatest(-F.col("over"), F.lit(0))
    rows = rows.withColumns({"before": before, "move": move})
    rows = saved(rows.withColumns({"p_left": F.col("p_left") + F.col("move"), "p_right": F.col("p_right") + F.col("move"),
                                   "p_ref": S.rotate_left(F.col("p_ref"), F.col("move")), "p_alt": S.rotate_left(F.col("p_alt"), F.col("move"))}), "site-ids")
    side = lambda name, a, b: rows.where(b > a).select(F.struct("row_id", F.lit(name).alias("side")).alias("k"), "ref_id", a.alias("left"), b.alias("right"))
    asks = side("a", F.col("p_left") - F.col("before"), F.col("p_left")).unionByName(side("b", F.col("p_right"), F.col("p_right") + F.col("extend")))
    texts = lookup_sequence(asks, chunks, "k").groupBy(F.col("k.row_id").alias("row_id")).agg(
        F.max(F.when(F.col("k.side") == "a", F.col("seq"))).alias("head"), F.max(F.when(F.col("k.side") == "b", F.col("seq"))).alias("tail"))
    rows = rows.join(texts, "row_id", "left").fillna("", ["head", "tail"])
    whole = rows.withColumns({"p_left": F.col("p_left") - F.col("before"), "p_right": F.col("p_right") + F.col("extend"),
                              "p_ref": F.concat("head", "p_ref", "tail"), "p_alt": F.concat("head", "p_alt", "tail")})
    return hgvs.format_myvariant_ids(whole).select("row_id", "id")


def chrom_pos_ids(forms: DataFrame, chunks: DataFrame) -> DataFrame:
    """(row_id, id): chr-pos-ref-alt of forms(row_id, chrom, ref_id, normal form) in the id's build, left-aligned, with the letter before pure indels."""
    rows = saved(left_aligned(forms), "site-ids")
    pure = ((F.col("p_ref") == "") | (F.col("p_alt") == "")) & (F.col("p_left") > 0)
    before = lookup_sequence(rows.where(pure).select("row_id", "ref_id", (F.col("p_left") - 1).alias("left"), F.col("p_left").alias("right")), chunks, "row_id").withColumnRenamed("seq", "before")
    return hgvs.format_chrom_pos_ids(rows.join(before, "row_id", "left")).select("row_id", "id")
