"""Coordinate conversion: block joins between references, and exon joins of transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions import sequences as S
from varloom.session import saved

from .intervals import bin_size, containment_join, merge_intervals
from .normalize import DUPLICATION, SHIFTABLE_DELETION


def _through(met: DataFrame, a_left: str, b_left: str, b_right: str) -> tuple:
    """The item's place on the other side of a block."""
    plus = F.col("strand") == "+"
    off, n = F.col("left") - F.col(a_left), F.col("right") - F.col("left")
    left = F.when(plus, F.col(b_left) + off).otherwise(F.col(b_right) - off - n)
    return left, left + n


def perfect(blocks: DataFrame) -> DataFrame:
    """The blocks of equal letters: those of op '=', where there is an op."""
    return blocks.where(F.col("op") == "=").drop("op") if "op" in blocks.columns else blocks


def _keys(items: DataFrame) -> list[str]:
    """An item is one change, or several with numbers in `change`."""
    return ["item_id", "change"] if "change" in items.columns else ["item_id"]


def map_to_main(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """items(item_id[, change], trg_ref, left, right, alt) placed on the main reference.

    Exactly one perfect block must hold each change, and all changes of an item must come to one main
    reference, else each of its rows has an error; '-' turns the letters.
    """
    keys = _keys(items)
    met = containment_join(items, perfect(blocks), ["trg_ref"], ("left", "right"), ("trg_left", "trg_right"))
    l, r = _through(met, "trg_left", "src_left", "src_right")
    one = met.groupBy(*keys).agg(F.count("*").alias("n"), F.min("src_ref").alias("main_ref"), F.min(l).alias("main_left"),
                                 F.min(r).alias("main_right"), F.min("strand").alias("strand"))
    got = items.join(one, keys, "left")
    if len(keys) > 1:
        whole = got.groupBy("item_id").agg(
            F.max(F.col("n").isNull()).alias("none"), F.max(F.coalesce(F.col("n") > 1, F.lit(False))).alias("many"),
            (F.min("main_ref") != F.max("main_ref")).alias("apart"))
        got = got.join(whole, "item_id")
    else:
        got = got.withColumns({"none": F.col("n").isNull(), "many": F.col("n") > 1, "apart": F.lit(False)})
    error = F.when(F.col("none"), "NoAlignment").when(F.col("many"), "AmbiguousAlignment").when(F.col("apart"), "DifferentReferences")
    ok = error.isNull()
    return got.select(
        *keys, F.when(ok, F.col("main_ref")).alias("main_ref"), F.when(ok, F.col("main_left")).alias("main_left"),
        F.when(ok, F.col("main_right")).alias("main_right"),
        F.when(ok, F.when(F.col("strand") == "-", S.reverse_complement(F.col("alt"))).otherwise(F.col("alt"))).alias("main_alt"),
        error.alias("error"))


def map_from_main(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """items(item_id[, change], src_ref, left, right, alt) on every reference where one perfect block holds
    each of the item's changes whole.

    There may be as many pairs as items times blocks. Those with a block that meets no other one of its two references
    need no counting, so they are not dealt again.
    """
    keys = _keys(items)
    own = perfect(blocks).select("trg_ref", "trg_left", "trg_right", "src_ref", "src_left", "src_right", "strand")
    w = Window.partitionBy("trg_ref", "src_ref").orderBy("src_left", "src_right")
    far, after = F.max("src_right").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lead("src_left").over(w)
    alone = (far.isNull() | (F.col("src_left") > far)) & (after.isNull() | (after > F.col("src_right")))
    own = saved(own.withColumn("alone", alone), "perfect-blocks")
    met = containment_join(items, own, ["src_ref"], ("left", "right"), ("src_left", "src_right"), bin_size(own, "src_left", "src_right", 64))
    l, r = _through(met, "src_left", "trg_left", "trg_right")
    alt = F.when(F.col("strand") == "-", S.reverse_complement(F.col("alt"))).otherwise(F.col("alt"))
    rows = met.select(*keys, "trg_ref", l.alias("t_left"), r.alias("t_right"), alt.alias("t_alt"), "strand", "alone")
    counted = rows.where("not alone").withColumn("n", F.count("*").over(Window.partitionBy(*keys, "trg_ref"))).where("n = 1").drop("n")
    rows = rows.where("alone").unionByName(counted).drop("alone")
    if len(keys) > 1:
        total = items.groupBy("item_id").agg(F.count("*").alias("total"))
        w = Window.partitionBy("item_id", "trg_ref")
        rows = rows.join(total, "item_id").withColumn("n", F.count("*").over(w)).where("n = total").drop("n", "total")
    return rows


def turned(strand: Column) -> dict[str, Column]:
    """original and inserted of a normal form on the other strand, where strand is '-'.

    The leftmost form there is the rightmost one here: a deleted or doubled text is rotated to it first.
    """
    move, k, c = F.col("n_right") - F.col("n_left"), F.col("length_change"), F.col("category")
    text = F.when(c == SHIFTABLE_DELETION, S.rotate_left(F.col("original"), move - k)).when(
        c == DUPLICATION, S.rotate_left(F.col("original"), move)).otherwise(F.col("original"))
    turn = lambda x: F.when(strand == "-", S.reverse_complement(x[0])).otherwise(x[1])
    return {"original": turn((text, F.col("original"))), "inserted": turn((F.col("inserted"), F.col("inserted")))}


def normal_to_main(forms: DataFrame, blocks: DataFrame) -> DataFrame:
    """Normal forms(item_id, ref_id, n_left, n_right, category, length_change, inserted, original) on the main
    reference, turned on '-'; the whole shift range must lie in one perfect block, so the form stays normal."""
    items = forms.select("item_id", F.col("ref_id").alias("trg_ref"), F.col("n_left").alias("left"), F.col("n_right").alias("right"))
    met = containment_join(items, perfect(blocks), ["trg_ref"], ("left", "right"), ("trg_left", "trg_right"))
    l, r = _through(met, "trg_left", "src_left", "src_right")
    one = met.groupBy("item_id").agg(F.count("*").alias("n"), F.min("src_ref").alias("main_ref"), F.min(l).alias("main_left"),
                                     F.min(r).alias("main_right"), F.min("strand").alias("strand"))
    got = forms.join(one, "item_id", "left")
    error = F.when(F.col("n").isNull(), "NoAlignment").when(F.col("n") > 1, "AmbiguousAlignment")
    text = turned(F.col("strand"))
    return got.select("item_id", *[F.when(error.isNull(), c).alias(n) for n, c in (
        ("main_ref", F.col("main_ref")), ("main_left", F.col("main_left")), ("main_right", F.col("main_right")), ("category", F.col("category")),
        ("length_change", F.col("length_change")), ("inserted", text["inserted"]), ("original", text["original"]))], error.alias("error"))


def normal_from_main(forms: DataFrame, blocks: DataFrame, builds: DataFrame, build: str) -> DataFrame:
    """Normal forms(item_id, ref_id, normal form) of the main reference on the one reference of a build where one perfect block holds them.

    builds(ref_id, build). The form is turned on '-'. Errors as in normal_to_main: NoAlignment, AmbiguousAlignment.
    """
    own = perfect(blocks).join(builds.where(F.col("build") == build).select(F.col("ref_id").alias("trg_ref")).distinct(), "trg_ref", "left_semi")
    back = own.select(F.col("src_ref").alias("trg_ref"), F.col("src_left").alias("trg_left"), F.col("src_right").alias("trg_right"), F.col("trg_ref").alias("src_ref"),
                      F.col("trg_left").alias("src_left"), F.col("trg_right").alias("src_right"), "strand")
    return normal_to_main(forms, back).select("item_id", F.col("main_ref").alias("ref_id"), F.col("main_left").alias("n_left"), F.col("main_right").alias("n_right"),
                                              "category", "length_change", "inserted", "original", "error")


def lift_to_build(items: DataFrame, blocks: DataFrame, builds: DataFrame, build: str) -> DataFrame:
    """map_from_main restricted to the references of one build; unique, else an error."""
    want = builds.where(F.col("build") == build).select(F.col("ref_id").alias("trg_ref"))
    got = map_from_main(items, perfect(blocks).join(want, "trg_ref", "left_semi"))
    one = got.groupBy("item_id").agg(F.count("*").alias("n"), F.min("trg_ref").alias("trg_ref"), F.min("t_left").alias("t_left"))
    rows = items.join(one, "item_id", "left")
    ok = F.col("n") == 1
    return rows.select("item_id", F.when(ok, F.col("trg_ref")).alias("trg_ref"), F.when(ok, F.col("t_left")).alias("t_left"),
                       F.when(F.col("n").isNull(), "NoAlignment").when(~ok, "AmbiguousAlignment").alias("error"))


def coordinate_transform(regions: DataFrame, blocks: DataFrame, builds: DataFrame) -> DataFrame:
    """(region_id, and for each build its ref and ends): regions on a reference through the main one.

    As map_from_main, but without its pairs of regions and references: regions of one main place ask once, and references whose
    blocks lie alike there answer as one, with their number.
    """
    blocks = perfect(blocks)
    main = map_to_main(regions.select(F.col("region_id").alias("item_id"), "trg_ref", "left", "right", F.lit("").alias("alt")), blocks)
    good = saved(main.where(F.col("error").isNull()).select(F.col("item_id").alias("region_id"), F.col("main_ref").alias("src_ref"),
                                                            F.col("main_left").alias("left"), F.col("main_right").alias("right")), "main-places")
    place = ["src_ref", "left", "right"]
    met = containment_join(good.select(*place).distinct(), _shapes(blocks, builds), ["src_ref"], ("left", "right"), ("lo", "hi"), 1024)
    holding = F.filter("blocks", lambda x: (x["src_left"] <= F.col("left")) & (x["src_right"] >= F.col("right")))
    # A reference with several blocks that hold the region has no place for it.
    one = met.withColumn("h", holding).where(F.size("h") == 1).select(*place, "build", "n", F.get("h", F.lit(0)).alias("h")).select(*place, "build", "n", "h.*")
    left, right = _through(one, "src_left", "trg_left", "trg_right")
    each = one.groupBy(*place, "build").agg(F.sum("n").alias("n_refs"), F.min(left).alias("min_left"), F.max(right).alias("max_right"))
    return good.join(each, place).select("region_id", "build", "n_refs", "min_left", "max_right")


def _shapes(blocks: DataFrame, builds: DataFrame) -> DataFrame:
    """(src_ref, build, blocks, lo, hi, n): groups of blocks of one reference that overlap or touch on the main one, and how many references have the same."""
    named = builds.groupBy(F.col("ref_id").alias("trg_ref")).agg(F.array_sort(F.collect_list("build")).alias("builds"))
    own = blocks.select("trg_ref", "src_ref", "src_left", "src_right", "trg_left", "trg_right", "strand").join(named, "trg_ref")
    w = Window.partitionBy("trg_ref", "src_ref").orderBy("src_left", "src_right")
    far = F.max("src_right").over(w.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumn("new", (far.isNull() | (F.col("src_left") > far)).cast("int"))
    own = own.withColumn("isle", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    block = F.struct("src_left", "src_right", "trg_left", "trg_right", "strand")
    isles = own.groupBy("trg_ref", "src_ref", "isle", "builds").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    alike = isles.groupBy("src_ref", "builds", "blocks").agg(F.count("*").alias("n"))
    ends = F.transform("blocks", lambda x: x["src_right"])
    return alike.select("src_ref", F.explode("builds").alias("build"), "blocks", F.get("blocks", F.lit(0))["src_left"].alias("lo"), F.array_max(ends).alias("hi"), "n")


def to_unspliced(points: DataFrame, exons: DataFrame) -> DataFrame:
    """points(point_id, transcript, pos, neg, off) -> u: intronic offsets lead off the exon's edge.

    A position on a border belongs to the exon that ends there for '+', to the one that begins for '-'.
    """
    met = points.join(exons, "transcript").where((F.col("pos") >= F.col("s_left")) & (F.col("pos") <= F.col("s_right")))
    u = F.col("u_left") + F.col("pos") - F.col("s_left")
    at = F.when(F.col("neg"), u - F.col("off")).otherwise(u + F.col("off"))
    side = F.when(F.col("neg"), -F.col("n")).otherwise(F.col("n"))  # '-': the later exon; '+': the earlier
    return met.groupBy("point_id").agg(F.min_by(at, side).alias("u"))


def to_spliced(points: DataFrame, exons: DataFrame) -> DataFrame:
    """points(point_id, transcript, u, is_end) -> pos, neg, off: the nearest exon border, a tie goes to the next exon."""
    w = Window.partitionBy("transcript").orderBy("n")
    e = exons.withColumn("next_u", F.lead("u_left").over(w))
    met = points.join(e, "transcript")
    inside = F.when(F.col("is_end"), (F.col("u") > F.col("u_left")) & (F.col("u") <= F.col("u_right"))).otherwise(
        (F.col("u") >= F.col("u_left")) & (F.col("u") < F.col("u_right")))
    gap = F.when(F.col("is_end"), (F.col("u") > F.col("u_right")) & (F.col("u") <= F.col("next_u"))).otherwise(
        (F.col("u") >= F.col("u_right")) & (F.col("u") < F.col("next_u")))
    met = met.where(inside | gap)
    before, after = F.col("u") - F.col("u_right"), F.col("next_u") - F.col("u")
    neg = F.when(inside, F.lit(False)).otherwise(after <= before)
    return met.select("point_id", F.when(inside, F.col("s_left") + F.col("u") - F.col("u_left")).otherwise(F.col("s_right")).alias("pos"),
                      neg.alias("neg"), F.when(inside, 0).when(neg, after).otherwise(before).cast("long").alias("off"))


def gene_regions(genes_refs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(gene_id, src_ref, left, right): a gene's references on the main one, merged."""
    met = genes_refs.join(blocks, "trg_ref").select("gene_id", "src_ref", F.col("src_left").alias("left"), F.col("src_right").alias("right"))
    return merge_intervals(met, ["gene_id", "src_ref"])


def exons_of(exons: DataFrame, transcripts: DataFrame) -> DataFrame:
    return exons.join(transcripts, "transcript", "left_semi")


