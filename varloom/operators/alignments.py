"""Alignments verified against their texts, composed over several references, and searched by a sorted index.

Block tables are as in `references`: (align_id, idx, op, trg_ref, trg_left, trg_right, src_ref, src_left,
src_right, strand, ins).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions import sequences as S
from varloom.session import saved

from .intervals import bin_size, bins, lookup_sequence, overlap_join
from .references import cigar_steps

PIECES = (1 << 20, 1 << 14, 1 << 8)
#: Letters of an alignment that is verified within its row.
SHORT = 1 << 10


def _cut(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Rows (keep, at, a, b) with texts of one length in pieces of at most PIECES[-1] letters; in steps, so that cutting stays linear."""
    def piece(size: int):
        part = lambda c, i: F.substring(c, i * size + 1, F.lit(size))
        return lambda i: F.struct((F.col("at") + i.cast("long") * size).alias("at"), part("a", i).alias("a"), part("b", i).alias("b"))

    for size in PIECES:
        numbers = F.sequence(F.lit(0), F.floor(F.greatest(F.length("a") - 1, F.lit(0)) / size).cast("int"))
        rows = rows.select(*keep, F.explode(F.transform(numbers, piece(size))).alias("p")).select(*keep, "p.*")
    return rows


def _unlike_pieces(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The pieces that differ, and those of 'X'; equal texts go before they are cut, and texts of one piece are that piece."""
    unlike = (F.col("a") != F.col("b")) | (F.col("op") == "X")
    one = F.length("a") <= PIECES[-1]
    rows = rows.where(unlike)
    return rows.where(one).select(*keep, "at", "a", "b").unionByName(_cut(rows.where(~one), keep).where(unlike))


def _differing_runs(a: Column, b: Column) -> Column:
    """array<struct<l,r>>: the runs of places where two short texts of one length differ."""
    kind = "array<struct<l:int,r:int>>"

    def step(acc: Column, i: Column) -> Column:
        run = lambda l: F.array(F.struct(l.alias("l"), (i + 1).alias("r")))
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) > 0) & (last["r"] == i), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), run(last["l"]))).otherwise(F.concat(acc, run(i)))

    places = F.filter(F.transform(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda same, i: F.when(~same, i)), lambda i: i.isNotNull())
    return F.aggregate(places, F.array().cast(kind), step)


def verified_blocks(aligns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, errors) of aligns(align_id, cigar, src_ref, src_seq, src_start, strand, trg_ref, trg_seq, trg_start).

    src_seq and trg_seq are the aligned letters, the source's in its own direction; src_start is the source's smallest coordinate on
    '+', its largest on '-'. M falls into runs of '=' and 'X' where the texts agree and differ, '=' and 'X' are held against the texts,
    counts of zero go, and neighbouring blocks of one kind that touch are one. X and I take their letters from the target. errors(align_id, error)
    names each alignment that has no blocks: UnsupportedCigar (other letters, or a count without a letter), WrongLength (texts shorter or
    longer than the cigar), WrongMatch ('=' over unlike letters), WrongChange ('X' over equal ones), in that order.

    Whole pieces of equal letters are compared at once; only pieces that differ are looked at letter by letter. Alignments of up to SHORT
    letters are verified within their rows, and only their blocks are written; longer ones are cut in pieces, which many tasks compare.
    """
    df = aligns.withColumn("steps", cigar_steps(F.col("cigar")))
    total = lambda skip: F.aggregate("steps", F.lit(0).cast("long"), lambda a, e: a + F.when(e["op"] == skip, 0).otherwise(e["n"]))
    error = F.when(~F.col("cigar").rlike("^([0-9]+[MIDX=])*$"), "UnsupportedCigar") \
        .when((total("I") != F.length("src_seq")) | (total("D") != F.length("trg_seq")), "WrongLength")
    base = ["align_id", "src_ref", "src_start", "strand", "trg_ref", "trg_start"]
    turned = F.when(F.col("strand") == "-", S.reverse_complement(F.col("src_seq"))).otherwise(F.col("src_seq"))
    df = df.withColumn("error", error).withColumn("short", F.greatest(F.length("src_seq"), F.length("trg_seq")) <= SHORT)
    df = df.select(*base, "steps", "error", "short", F.when(F.col("error").isNull(), turned).alias("src"), F.when(F.col("error").isNull(), F.col("trg_seq")).alias("trg"))
    df = _verified_within(df)
    # Written once: blocks, errors and long alignments all come from here.
    long = F.col("error").isNull() & ~F.col("short")
    keep = lambda c: F.when(long, F.col(c)).alias(c)
    df = saved(df.select(*base, "error", "short", "blocks", keep("steps"), keep("src"), keep("trg")), "alignments")
    own = df.where(F.col("error").isNull() & F.col("short")).select("align_id", "trg_ref", "src_ref", "strand", F.posexplode("blocks").alias("idx", "b")).select("*", "b.*").select(BLOCK)
    errors = df.where(F.col("error").isNotNull()).select("align_id", "error")
    if not df.where(long).take(1):
        return own, errors
    blocks, late = _verified_in_pieces(df.where(long))
    return own.unionByName(blocks), errors.unionByName(late)


BLOCK = ["align_id", "idx", "op", "trg_ref", "trg_left", "trg_right", "src_ref", "src_left", "src_right", "strand", "ins"]


def _verified_within(df: DataFrame) -> DataFrame:
    """df(.., steps, error, short, src, trg) with blocks array<struct<op,trg_left,trg_right,src_left,src_right,ins>> of short alignments, and their errors."""
    zero, run = F.lit(0).cast("long"), "array<struct<l:bigint,r:bigint>>"
    cut = lambda text, at, n: F.substring(text, (at + 1).cast("int"), n.cast("int"))
    fine = F.col("error").isNull() & F.col("short")

    def step(e: Column) -> Column:
        a, b = cut("src", e["s"], e["n"]), cut("trg", e["t"], e["n"])
        runs = F.when(e["op"].isin("M", "=", "X") & (a != b), _differing_runs(a, b).cast(run)).otherwise(F.array().cast(run))
        return F.struct(e["op"].alias("op"), e["n"].alias("n"), e["t"].alias("t"), e["s"].alias("s"), runs.alias("runs"))

    df = df.withColumn("checked", F.when(fine, F.transform("steps", step)))
    unlike = lambda e: F.aggregate(e["runs"], zero, lambda a, r: a + r["r"] - r["l"])
    fault = F.when(F.exists("checked", lambda e: (e["op"] == "=") & (F.size(e["runs"]) > 0)), "WrongMatch") \
        .when(F.exists("checked", lambda e: (e["op"] == "X") & (unlike(e) < e["n"])), "WrongChange")
    df = df.withColumn("error", F.coalesce("error", fault))
    plus = F.col("strand") == "+"

    def part(e: Column, op: Column, l: Column, r: Column) -> Column:
        trg = F.col("trg_start") + e["t"] + F.when(op == "D", 0).otherwise(l)
        src, sn = e["s"] + F.when(op == "I", 0).otherwise(l), F.when(op == "I", 0).otherwise(r - l)
        left = F.when(plus, F.col("src_start") + src).otherwise(F.col("src_start") - src - sn)
        return F.struct(op.alias("op"), trg.alias("trg_left"), (trg + F.when(op == "D", 0).otherwise(r - l)).alias("trg_right"), left.alias("src_left"), (left + sn).alias("src_right"),
                        F.when(op.isin("X", "I"), cut("trg", e["t"] + l, r - l)).alias("ins"))

    def split(e: Column) -> Column:
        """M's equal and changed letters in turn: each run of change ends a run of equal letters, the step's end another."""
        ends = F.concat(e["runs"], F.array(F.struct(e["n"].alias("l"), e["n"].alias("r"))))
        both = F.transform(ends, lambda x, i: F.array(part(e, F.lit("="), F.when(i == 0, zero).otherwise(F.get(ends, i - 1)["r"]), x["l"]), part(e, F.lit("X"), x["l"], x["r"])))
        return F.filter(F.flatten(both), lambda p: p["trg_left"] < p["trg_right"])

    parts = F.flatten(F.transform("checked", lambda e: F.when(e["op"] == "M", split(e)).otherwise(F.array(part(e, e["op"], zero, e["n"])))))
    df = df.withColumn("parts", F.when(F.col("error").isNull(), parts)).drop("checked")
    # Neighbours of one kind touch by their order.
    kind = "array<struct<op:string,trg_left:bigint,trg_right:bigint,src_left:bigint,src_right:bigint,ins:string>>"

    def grown(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        whole = F.struct(p["op"].alias("op"), last["trg_left"].alias("trg_left"), p["trg_right"].alias("trg_right"), F.least(last["src_left"], p["src_left"]).alias("src_left"),
                         F.greatest(last["src_right"], p["src_right"]).alias("src_right"), F.concat(last["ins"], p["ins"]).alias("ins"))
        return F.when((F.size(acc) > 0) & (last["op"] == p["op"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(whole))).otherwise(F.array_append(acc, p))

    return df.withColumn("blocks", F.aggregate("parts", F.array().cast(kind), grown)).drop("parts")


def _verified_in_pieces(fine: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks, errors) of alignments (align_id, src_ref, src_start, strand, trg_ref, trg_start, steps, src, trg) of any length."""
    base = ["align_id", "src_ref", "src_start", "strand", "trg_ref", "trg_start"]
    rows = fine.select(*base, "src", "trg", F.posexplode("steps").alias("idx", "e")).select(
        *base, "idx", "e.op", "e.n", "e.t", "e.s", F.when(F.col("e.op") != "I", F.substring("src", (F.col("e.s") + 1).cast("int"), F.col("e.n").cast("int"))).alias("a"),
        F.when(F.col("e.op") != "D", F.substring("trg", (F.col("e.t") + 1).cast("int"), F.col("e.n").cast("int"))).alias("b"))
    rows = saved(rows, "alignment-steps")
    even = rows.where(F.col("op").isin("M", "=", "X")).select("align_id", "idx", "op", "n", F.lit(0).cast("long").alias("at"), "a", "b")
    pieces = _unlike_pieces(even, ["align_id", "idx", "op", "n"])
    found = pieces.select("align_id", "idx", "op", "n", F.explode(F.transform(_differing_runs(F.col("a"), F.col("b")), lambda r: F.struct(
        (F.col("at") + r["l"]).alias("l"), (F.col("at") + r["r"]).alias("r")))).alias("x")).select("align_id", "idx", "op", "n", "x.*")
    found = saved(found, "alignment-changes")
    unlike = found.groupBy("align_id", "idx", "op", "n").agg(F.sum(F.col("r") - F.col("l")).alias("k"))
    checked = rows.where(F.col("op").isin("=", "X")).select("align_id", "idx", "op", "n").join(unlike.drop("op", "n"), ["align_id", "idx"], "left")
    wrong = checked.select("align_id", F.when((F.col("op") == "=") & (F.col("k") > 0), 1).when((F.col("op") == "X") & (F.coalesce("k", F.lit(0)) < F.col("n")), 2).alias("e"))
    wrong = wrong.groupBy("align_id").agg(F.min("e").alias("e")).where(F.col("e").isNotNull())
    errors = wrong.select("align_id", F.when(F.col("e") == 1, "WrongMatch").otherwise("WrongChange").alias("error"))
    # Each run of change ends a run of equal letters, the step's end another.
    ends = found.where(F.col("op") == "M").select("align_id", "idx", "l", "r").unionByName(
        rows.where(F.col("op") == "M").select("align_id", "idx", F.col("n").alias("l"), F.col("n").alias("r")))
    w = Window.partitionBy("align_id", "idx").orderBy("l", "r")
    split = ends.withColumn("from", F.coalesce(F.lag("r").over(w), F.lit(0).cast("long"))).select("align_id", "idx", F.explode(F.array(
        F.struct(F.lit("=").alias("kind"), F.col("from").alias("l"), F.col("l").alias("r")), F.struct(F.lit("X").alias("kind"), F.col("l"), F.col("r")))).alias("p")).select("align_id", "idx", "p.*")
    split = split.where(F.col("l") < F.col("r"))
    parts = rows.join(split, ["align_id", "idx"], "left").withColumns({"l": F.coalesce("l", F.lit(0).cast("long")), "r": F.coalesce("r", F.col("n"))})
    parts = parts.withColumn("op", F.coalesce("kind", "op")).join(wrong, "align_id", "left_anti")
    size, plus = F.col("r") - F.col("l"), F.col("strand") == "+"
    trg = F.col("trg_start") + F.col("t") + F.when(F.col("op") == "D", 0).otherwise(F.col("l"))
    src = F.col("s") + F.when(F.col("op") == "I", 0).otherwise(F.col("l"))
    sn = F.when(F.col("op") == "I", 0).otherwise(size)
    blocks = parts.select(
        "align_id", F.struct("idx", "l").alias("order"), "op", "trg_ref", trg.alias("trg_left"), (trg + F.when(F.col("op") == "D", 0).otherwise(size)).alias("trg_right"), "src_ref",
        F.when(plus, F.col("src_start") + src).otherwise(F.col("src_start") - src - sn).alias("src_left"),
        F.when(plus, F.col("src_start") + src + sn).otherwise(F.col("src_start") - src).alias("src_right"), "strand",
        F.when(F.col("op").isin("X", "I"), F.substring("b", (F.col("l") + 1).cast("int"), size.cast("int"))).alias("ins"))
    # Neighbours of one kind touch by their order; each alignment's blocks are numbered anew.
    v = Window.partitionBy("align_id").orderBy("order")
    new = F.coalesce((F.lag("op").over(v) != F.col("op")).cast("int"), F.lit(1))
    blocks = blocks.withColumn("new", new).withColumn("run", F.sum("new").over(v.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "ins"))), lambda x: x["ins"]), "")
    merged = blocks.groupBy("align_id", F.col("run").cast("int").alias("idx"), "op", "trg_ref", "src_ref", "strand").agg(
        F.min("trg_left").alias("trg_left"), F.max("trg_right").alias("trg_right"), F.min("src_left").alias("src_left"), F.max("src_right").alias("src_right"), text.alias("t"))
    return merged.select(*BLOCK[:-1], F.when(F.col("op").isin("X", "I"), F.col("t")).alias("ins")), errors


def sorted_index(blocks: DataFrame, path: str, ref: str = "src_ref", left: str = "src_left", right: str = "src_right") -> tuple[DataFrame, DataFrame]:
    """(index, parts): the blocks below `path` by ranges of (ref, left), each with the greatest end so far on its reference.

    Two passes carry that end over the ranges: each range's greatest end per reference first, then the running
    one within a range from what came before it. parts(part, ref, first_left, last_end) has a row a range and reference.
    """
    dealt = blocks.repartitionByRange(ref, left).withColumn("part", F.spark_partition_id())
    dealt = saved(dealt, "index-ranges")
    tops = dealt.groupBy("part", ref).agg(F.max(right).alias("top"), F.min(left).alias("first_left"))
    w = Window.partitionBy(ref).orderBy("part")
    before = tops.select("part", ref, F.max("top").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), "first_left", F.max("top").over(w).alias("last_end"))
    own = F.max(right).over(Window.partitionBy("part", ref).orderBy(left, right).rowsBetween(Window.unboundedPreceding, 0))
    rows = dealt.join(before.select("part", ref, "before"), ["part", ref]).withColumn("max_end", F.greatest(own, F.coalesce("before", F.lit(0)))).drop("before")
    rows.repartition("part").sortWithinPartitions(ref, left).write.mode("overwrite").partitionBy("part").parquet(path)
    parts = saved(before.select("part", ref, "first_left", "last_end"), "index-parts")
    return blocks.sparkSession.read.parquet(path), parts


def search_index(index: DataFrame, parts: DataFrame, regions: DataFrame, ref: str = "src_ref", left: str = "src_left", right: str = "src_right") -> DataFrame:
    """Pairs of regions(.., ref, from, to) and indexed blocks with left <= to and right > from.

    A region asks only the ranges whose first block starts in time and whose greatest end so far passes it;
    the others' files are not read (the numbers of the ranges asked come to the driver, as many as shuffles have partitions at most).
    Within a range they meet in bins of the size of both, not each region with each block of its reference.
    """
    asked = regions.join(parts.withColumnRenamed(ref, "ref_"), (F.col(ref) == F.col("ref_")) & (F.col("first_left") <= F.col("to")) & (F.col("last_end") > F.col("from")))
    asked = saved(asked.drop("ref_", "first_left", "last_end"), "index-asks")
    wanted = [r["part"] for r in asked.select("part").distinct().collect()]
    rows = index.where(F.col("part").isin(wanted)).select(*[F.col(c).alias(f"b_{c}") if c in regions.columns and c != ref else F.col(c) for c in index.columns])
    size = max(bin_size(asked, least=64), bin_size(rows, left, right, least=64))
    return overlap_join(rows, asked, ["part", ref], (left, right), size=size).drop("part", "max_end")


def _meeting(a: DataFrame, b: DataFrame, size: int = 4096) -> DataFrame:
    """Rows of a (r, x, y, ..) and b (r_, x_, y_, ..) of one reference whose intervals share letters, by bins; each pair once."""
    left = a.withColumn("bin_", F.explode(bins(F.col("x"), F.col("y") - 1, size)))
    right = b.withColumn("bin_", F.explode(bins(F.col("x_"), F.col("y_") - 1, size))).withColumnRenamed("r_", "r")
    return left.join(right, ["r", "bin_"]).where((F.col("x") < F.col("y_")) & (F.col("y") > F.col("x_")) & (
        F.col("bin_") == F.floor(F.greatest("x", "x_") / size))).drop("bin_")


MAP = ["trg_ref", "trg_left", "trg_right", "src_ref", "src_left", "src_right", "strand", "ins"]


def sequence_map(blocks: DataFrame) -> DataFrame:
    """Blocks as a map of their targets' letters: equal ones by source, changed and inserted ones by their own letters (no source)."""
    own = F.col("op").isin("X", "I")
    null = lambda c: F.when(~own, F.col(c)).alias(c)
    return blocks.where(F.col("op") != "D").select("trg_ref", "trg_left", "trg_right", null("src_ref"), null("src_left"), null("src_right"), null("strand"),
                                                   F.when(own, F.col("ins")).alias("ins"))


def compose(upper: DataFrame, lower: DataFrame) -> DataFrame:
    """Sequence map of upper's targets through lower: where upper's source is a target of lower, its letters come from lower's sources.

    The parts that both maps cover are cut out, strands multiply, and lower's own letters are turned with upper's strand. Parts
    whose source lower doesn't know stay; parts of a known source that lower leaves open have no letters and go.
    """
    known = lower.select(F.col("trg_ref").alias("src_ref")).distinct()
    literal = upper.where(F.col("src_ref").isNull())
    based = upper.where(F.col("src_ref").isNotNull())
    stay = based.join(known, "src_ref", "left_anti").select(MAP)
    a = based.join(known, "src_ref", "left_semi").select(F.col("src_ref").alias("r"), F.col("src_left").alias("x"), F.col("src_right").alias("y"), "trg_ref", "trg_left", F.col("strand").alias("s"))
    b = lower.select(F.col("trg_ref").alias("r_"), F.col("trg_left").alias("x_"), F.col("trg_right").alias("y_"), F.col("src_ref").alias("c"), F.col("src_left").alias("cl"),
                     F.col("src_right").alias("cr"), F.col("strand").alias("s_"), F.col("ins").alias("own"))
    met = _meeting(a, b)
    lo, hi = F.greatest("x", "x_"), F.least("y", "y_")
    n = hi - lo
    at = F.col("trg_left") + F.when(F.col("s") == "-", F.col("y") - hi).otherwise(lo - F.col("x"))
    down = F.when(F.col("s_") == "-", F.col("cl") + F.col("y_") - hi).otherwise(F.col("cl") + lo - F.col("x_"))
    text = F.substring("own", (lo - F.col("x_") + 1).cast("int"), n.cast("int"))
    through = met.select("trg_ref", at.alias("trg_left"), (at + n).alias("trg_right"), F.col("c").alias("src_ref"), down.alias("src_left"), (down + n).alias("src_right"),
                         F.when(F.col("s_").isNotNull(), F.when(F.col("s") == F.col("s_"), "+").otherwise("-")).alias("strand"),
                         F.when(F.col("s") == "-", S.reverse_complement(text)).otherwise(text).alias("ins"))
    return literal.select(MAP).unionByName(stay).unionByName(through)


def sequences(asks: DataFrame, refs: DataFrame, maps: DataFrame, exons: DataFrame, coding: DataFrame, chunks: DataFrame) -> DataFrame:
    """(key, seq, error) of asks(key, ref_id, left, right) on references of any kind.

    refs(ref_id, kind, length): kind is main, mapped, transcript or protein, length in its own letters. maps: sequence map of mapped
    references and transcripts down to the main genome (see compose). exons(transcript, n, u_left, u_right, s_left, s_right); coding(protein,
    transcript, cds_left, frame_offset): a protein's residue i is read from the spliced letters cds_left + 3 i on, less the frame offset's
    letters, cut where the transcript ends, a leading X for a shifted frame, one trailing stop or X left out. Errors: UnknownReference,
    OutOfReference. Letters that no map covers are left out, as in transcripts without unaligned texts.
    """
    df = asks.select("key", "ref_id", "left", "right").join(refs.select("ref_id", "kind", "length"), "ref_id", "left")
    df = df.withColumn("error", F.when(F.col("kind").isNull(), "UnknownReference").when(
        (F.col("left") < 0) | (F.col("left") > F.col("right")) | (F.col("right") > F.col("length")), "OutOfReference"))
    df = saved(df, "sequence-asks")
    good = df.where(F.col("error").isNull() & (F.col("left") < F.col("right")))
    # Proteins ask their transcript's exons; the place in the asked text orders the parts.
    spliced = exons.groupBy("transcript").agg(F.max("s_right").alias("end_"))
    prot = good.where("kind = 'protein'").join(coding.select(F.col("protein").alias("ref_id"), "transcript", "cds_left", "frame_offset"), "ref_id").join(spliced, "transcript")
    a = F.col("left") * 3 + F.col("cds_left") + F.col("frame_offset")
    b = F.col("right") * 3 + F.col("cds_left") - F.when(F.col("frame_offset") > 0, 3 - F.col("frame_offset")).otherwise(0)
    prot = prot.select("key", "transcript", a.alias("a"), F.least(b, F.col("end_")).alias("b"))
    over = prot.join(exons, "transcript").where((F.col("s_left") < F.col("b")) & (F.col("s_right") > F.col("a")))
    lo, hi = F.greatest("a", "s_left"), F.least("b", "s_right")
    over = over.select("key", F.col("transcript").alias("ref_id"), (F.col("u_left") + lo - F.col("s_left")).alias("left"), (F.col("u_left") + hi - F.col("s_left")).alias("right"), (lo - F.col("a")).alias("at"))
    mapped = good.where("kind in ('mapped', 'transcript')").select("key", "ref_id", "left", "right", F.lit(0).cast("long").alias("at")).unionByName(over)
    x = mapped.select("key", F.col("ref_id").alias("r"), F.col("left").alias("x"), F.col("right").alias("y"), "at")
    y = maps.select(F.col("trg_ref").alias("r_"), F.col("trg_left").alias("x_"), F.col("trg_right").alias("y_"), "src_ref", "src_left", "strand", "ins")
    met = _meeting(x, y)
    lo, hi = F.greatest("x", "x_"), F.least("y", "y_")
    n, down = hi - lo, F.when(F.col("strand") == "-", F.col("src_left") + F.col("y_") - hi).otherwise(F.col("src_left") + lo - F.col("x_"))
    parts = met.select("key", (F.col("at") + lo - F.col("x")).alias("at"), F.substring("ins", (lo - F.col("x_") + 1).cast("int"), n.cast("int")).alias("text"),
                       F.col("src_ref").alias("ref_id"), down.alias("left"), (down + n).alias("right"), "strand")
    direct = good.where("kind = 'main'").select("key", F.lit(0).cast("long").alias("at"), F.lit(None).cast("string").alias("text"), "ref_id", "left", "right", F.lit("+").alias("strand"))
    parts = saved(parts.unionByName(direct).withColumn("part", F.struct("key", "at")), "sequence-parts")
    letters = lookup_sequence(parts.where(F.col("text").isNull()), chunks, "part").select("part", "seq")
    whole = parts.join(letters, "part", "left")
    text = F.coalesce("text", F.when(F.col("strand") == "-", S.reverse_complement(F.col("seq"))).otherwise(F.col("seq")), F.lit(""))
    made = whole.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", text.alias("t")))), lambda p: p["t"]), "").alias("made"))
    frame = coding.select(F.col("protein").alias("ref_id"), F.col("frame_offset").alias("shift_"))
    got = df.join(made, "key", "left").join(frame, "ref_id", "left")
    shifted = F.col("shift_") > 0
    residues = F.concat(F.when(shifted, F.lit("X")).otherwise(F.lit("")), S.translate_codons(F.coalesce("made", F.lit(""))))
    residues = F.when(F.col("left") == F.col("right"), "").otherwise(F.regexp_replace(residues, "[*X]$", ""))
    seq = F.when(F.col("kind") == "protein", residues).otherwise(F.coalesce("made", F.lit("")))
    return got.select("key", F.when(F.col("error").isNull(), seq).alias("seq"), "error")
