"""Reference sequences and alignments as tables.

An alignment is rows of a block table: (align_id, idx, op, trg_ref, trg_left, trg_right, src_ref,
src_left, src_right, strand, ins). `op` is '=' (equal), 'X' (changed, equal lengths), 'D' (only in
the source) or 'I' (only in the target); `ins` holds the target's letters for X and I. Source and
target coordinates grow together on '+', against each other on '-'.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from varloom.functions import sequences as S


def cigar_to_blocks(aligns: DataFrame) -> DataFrame:
    """aligns(align_id, cigar, seqs array<string>, src_ref, src_start, strand, trg_ref, trg_start) -> blocks.

    M counts as equal (alignments.verified_blocks splits it by the texts); lengths of zero go. src_start is the source's smallest coordinate on '+',
    its largest on '-'.
    """
    rows = aligns.withColumn("e", F.explode(cigar_steps(F.col("cigar"))))
    op, n = F.regexp_replace("e.op", "M", "="), F.col("e.n")
    left, right = _source_place(F.col("e"))
    t = F.col("trg_start") + F.col("e.t")
    return rows.select(
        "align_id", "e.idx", op.alias("op"), "trg_ref", t.alias("trg_left"), (t + F.when(op != "D", n).otherwise(0)).alias("trg_right"), "src_ref",
        left.alias("src_left"), right.alias("src_right"), "strand", F.when(op.isin("X", "I"), F.get("seqs", F.col("e.k"))).alias("ins"))


def cigar_steps(cigar: Column) -> Column:
    """array<struct<idx,op,n,t,s,k>>: a cigar's steps of one letter or more; idx is a step's place among all, t and s the letters of the target
    and the source before it, k the texts of 'X' and 'I' before it."""
    runs = F.regexp_extract_all(cigar, F.lit("([0-9]+)[MIDX=]"), F.lit(1))
    ops = F.regexp_extract_all(cigar, F.lit("[0-9]+([MIDX=])"), F.lit(1))
    steps = F.filter(F.transform(F.arrays_zip(runs.alias("n"), ops.alias("op")), lambda e, i: F.struct(i.alias("idx"), e["op"].alias("op"), e["n"].cast("long").alias("n"))), lambda e: e["n"] > 0)
    zero, kind = F.lit(0).cast("long"), "array<struct<idx:int,op:string,n:bigint,t:bigint,s:bigint,k:int>>"
    state = F.struct(zero.alias("t"), zero.alias("s"), F.lit(0).alias("k"), F.array().cast(kind).alias("out"))
    return F.aggregate(steps, state, lambda a, e: F.struct(
        (a["t"] + F.when(e["op"] == "D", 0).otherwise(e["n"])).alias("t"), (a["s"] + F.when(e["op"] == "I", 0).otherwise(e["n"])).alias("s"),
        (a["k"] + e["op"].isin("X", "I").cast("int")).alias("k"),
        F.array_append(a["out"], F.struct(e["idx"].alias("idx"), e["op"].alias("op"), e["n"].alias("n"), a["t"].alias("t"), a["s"].alias("s"), a["k"].alias("k"))).alias("out")), lambda a: a["out"])


def _source_place(e: Column) -> tuple[Column, Column]:
    """Where a step lies on the source; src_start is its smallest coordinate on '+', its largest on '-'."""
    n = F.when(e["op"] != "I", e["n"]).otherwise(0)
    left = F.when(F.col("strand") == "+", F.col("src_start") + e["s"]).otherwise(F.col("src_start") - e["s"] - n)
    return left, left + n


def blocks_to_cigar(blocks: DataFrame) -> DataFrame:
    """(align_id, cigar): '=', 'X', and D before I in one gap."""
    n = F.greatest(F.col("trg_right") - F.col("trg_left"), F.col("src_right") - F.col("src_left"))
    part = F.struct("idx", F.concat(n.cast("string"), "op").alias("t"))
    return blocks.groupBy("align_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(part)), lambda x: x["t"]), "").alias("cigar"))


def apply_alignment(blocks: DataFrame, src_seq: DataFrame) -> DataFrame:
    """(align_id, seq): the target's letters from (src_ref, seq) and the blocks' own letters."""
    met = blocks.join(src_seq.select("src_ref", F.col("seq").alias("s")), "src_ref")
    piece = F.substring("s", (F.col("src_left") + 1).cast("int"), (F.col("src_right") - F.col("src_left")).cast("int"))
    text = F.when(F.col("op") == "=", F.when(F.col("strand") == "-", S.reverse_complement(piece)).otherwise(piece)) \
        .when(F.col("op") == "D", F.lit("")).otherwise(F.col("ins"))
    return met.groupBy("align_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("idx", text.alias("t")))), lambda x: x["t"]), "").alias("seq"))


def apply_cigars(aligns: DataFrame, src_seq: DataFrame) -> DataFrame:
    """(align_id, seq) of the rows of cigar_to_blocks, as apply_alignment gives it for their blocks: an alignment goes to its source once, as one row.
    Texts are never broadcast: Spark sizes them by their files."""
    met = aligns.select("align_id", "cigar", "seqs", "src_ref", "src_start", "strand").join(src_seq.select("src_ref", F.col("seq").alias("s")).hint("merge"), "src_ref")

    def text(e: Column) -> Column:
        left, right = _source_place(e)
        piece = F.substring("s", (left + 1).cast("int"), (right - left).cast("int"))
        return F.when(e["op"].isin("M", "="), F.when(F.col("strand") == "-", S.reverse_complement(piece)).otherwise(piece)) \
            .when(e["op"] == "D", F.lit("")).otherwise(F.get("seqs", e["k"]))

    met = met.withColumn("steps", cigar_steps(F.col("cigar"))).where(F.size("steps") > 0)
    return met.select("align_id", F.array_join(F.transform("steps", text), "").alias("seq"))


def reverse_alignment(blocks: DataFrame, src_text: Column | None = None) -> DataFrame:
    """Source and target change places; I and D, too; the order turns on '-'. src_text: letters of the source for X and D."""
    ins = F.when(F.col("op").isin("X", "D"), src_text) if src_text is not None else F.lit(None).cast("string")
    return blocks.select(
        "align_id", F.when(F.col("strand") == "-", -F.col("idx")).otherwise(F.col("idx")).alias("idx"),
        F.when(F.col("op") == "I", "D").when(F.col("op") == "D", "I").otherwise(F.col("op")).alias("op"),
        F.col("src_ref").alias("trg_ref"), F.col("src_left").alias("trg_left"), F.col("src_right").alias("trg_right"),
        F.col("trg_ref").alias("src_ref"), F.col("trg_left").alias("src_left"), F.col("trg_right").alias("src_right"),
        "strand", ins.alias("ins"))


def clip_alignment(blocks: DataFrame, left: Column, right: Column, aligned: bool = False) -> DataFrame:
    """The part of each alignment in [left, right) of the target.

    Equal and changed blocks are cut, insertions only if not `aligned`; deletions stay where they
    lie inside. Rows that nothing is left of go.
    """
    hit = blocks.where(((F.col("trg_left") < right) & (F.col("trg_right") > left))
                       | ((F.col("op") == "D") & (F.col("trg_left") > left) & (F.col("trg_left") < right)))
    a, b = F.greatest(F.col("trg_left"), left), F.least(F.col("trg_right"), right)
    whole = F.col("op") == "D" if not aligned else F.col("op").isin("D", "I")
    da, db = a - F.col("trg_left"), F.col("trg_right") - b
    even = F.col("op").isin("=", "X") & ~whole
    plus = F.col("strand") == "+"
    return hit.select(
        "align_id", "idx", "op", "trg_ref", F.when(whole, F.col("trg_left")).otherwise(a).alias("trg_left"),
        F.when(whole, F.col("trg_right")).otherwise(b).alias("trg_right"), "src_ref",
        F.when(~even, F.col("src_left")).when(plus, F.col("src_left") + da).otherwise(F.col("src_left") + db).alias("src_left"),
        F.when(~even, F.col("src_right")).when(plus, F.col("src_right") - db).otherwise(F.col("src_right") - da).alias("src_right"),
        "strand", F.when(whole | F.col("ins").isNull(), F.col("ins")).otherwise(
            F.substring("ins", (da + 1).cast("int"), (b - a).cast("int"))).alias("ins"))


def append_alignments(blocks: DataFrame) -> DataFrame:
    """Neighbouring blocks of one kind that touch on both sides become one."""
    w = Window.partitionBy("align_id").orderBy("idx", "trg_left")
    lag = lambda c: F.lag(c).over(w)
    plus = F.col("strand") == "+"
    joins = ((lag("op") == F.col("op")) & F.col("op").isin("=", "X") & (lag("trg_right") == F.col("trg_left"))
             & (lag("src_ref") == F.col("src_ref")) & (lag("strand") == F.col("strand"))
             & F.when(plus, lag("src_right") == F.col("src_left")).otherwise(lag("src_left") == F.col("src_right")))
    rows = blocks.withColumn("new", F.coalesce((~joins).cast("int"), F.lit(1)))
    rows = rows.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("align_id", "run", "op", "trg_ref", "src_ref", "strand").agg(
        F.min("idx").alias("idx"), F.min("trg_left").alias("trg_left"), F.max("trg_right").alias("trg_right"),
        F.min("src_left").alias("src_left"), F.max("src_right").alias("src_right"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "ins"))), lambda x: x["ins"]), "").alias("ins")).drop("run")


def unsplice_transcripts(lengths: DataFrame) -> DataFrame:
    """exons(transcript, n, u_left, u_right, s_left, s_right) from (transcript, n, len, intron).

    Spliced coordinates count exons only, unspliced ones exons and the introns between.
    """
    w = Window.partitionBy("transcript").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    u = F.coalesce(F.sum(F.col("len") + F.col("intron")).over(w), F.lit(0))
    s = F.coalesce(F.sum("len").over(w), F.lit(0))
    return lengths.select("transcript", "n", u.alias("u_left"), (u + F.col("len")).alias("u_right"),
                          s.alias("s_left"), (s + F.col("len")).alias("s_right"))


def lengths_and_builds(refs: DataFrame, exons: DataFrame) -> DataFrame:
    """(ref_id, name, length, spliced_length, build, chromosome) from refs(ref_id, name, file, length)."""
    spliced = exons.groupBy(F.col("transcript").alias("ref_id")).agg(
        F.max("u_right").alias("u"), F.sum(F.col("s_right") - F.col("s_left")).alias("s"))
    rows = refs.join(spliced, "ref_id", "left")
    nc = F.regexp_extract("name", r"^NC_0000([0-9]{2})", 1)
    chrom = F.when(nc != "", nc.try_cast("int")).when(F.col("name").isin("NC_012920.1", "NC_001807.4"), 25)
    return rows.select("ref_id", "name", F.coalesce("u", "length").alias("length"), F.coalesce("s", "length").alias("spliced_length"),
                       F.nullif(F.regexp_extract("file", r"(GRCh38|GRCh37|NCBI36)", 1), F.lit("")).alias("build"), chrom.alias("chromosome"))


def protein_sequence(cds: DataFrame) -> DataFrame:
    """(protein, seq) from (protein, seq, cds_left, cds_right, frame_offset): seq is the spliced transcript.

    A frame offset gives a leading X; one trailing stop or X goes.
    """
    part = F.substring("seq", (F.col("cds_left") + F.col("frame_offset") + 1).cast("int"),
                       (F.least(F.col("cds_right"), F.length("seq")) - F.col("cds_left") - F.col("frame_offset")).cast("int"))
    full = F.concat(F.when(F.col("frame_offset") > 0, F.lit("X")).otherwise(F.lit("")), S.translate_codons(part))
    return cds.select("protein", F.regexp_replace(full, "[*X]$", "").alias("seq"))


def select_best_alignment(rows: DataFrame) -> DataFrame:
    """(target, left, right, source) from (target, left, right, source).

    The target is split at all ends; in each piece the only NC source stays, else the only NT, else
    the only NW; neighbours of one source merge, pieces without choice have a null source.
    """
    ends = rows.select("target", F.explode(F.array("left", "right")).alias("p")).distinct()
    w = Window.partitionBy("target").orderBy("p")
    pieces = ends.select("target", F.col("p").alias("a"), F.lead("p").over(w).alias("b")).where("b is not null")
    # Each row knows its pieces by the ends inside it, through bins.
    from .intervals import overlap_join

    met = overlap_join(pieces.withColumnsRenamed({"a": "x", "b": "y"}),
                       rows.select("target", "source", F.col("left").alias("from"), (F.col("right") - 1).alias("to")),
                       ["target"], ("x", "y"), ("from", "to"))
    kind = F.substring("source", 1, 2)
    got = met.groupBy("target", "x", "y").agg(*[F.count(F.when(kind == k, 1)).alias(f"n{k}") for k in ("NC", "NT", "NW")],
                                              *[F.max(F.when(kind == k, F.col("source"))).alias(f"s{k}") for k in ("NC", "NT", "NW")])
    pick = F.when(F.col("nNC") == 1, F.col("sNC")).when(F.col("nNC") > 1, None).when(F.col("nNT") == 1, F.col("sNT")) \
        .when(F.col("nNT") > 1, None).when(F.col("nNW") == 1, F.col("sNW"))
    all_ = pieces.select("target", F.col("a").alias("x"), F.col("b").alias("y")).join(
        got.select("target", "x", "y", pick.alias("source")), ["target", "x", "y"], "left")
    v = Window.partitionBy("target").orderBy("x")
    new = F.coalesce((~F.lag("source").over(v).eqNullSafe(F.col("source"))).cast("int"), F.lit(1))
    isle = all_.withColumn("new", F.when(F.row_number().over(v) == 1, 1).otherwise(new))
    isle = isle.withColumn("run", F.sum("new").over(v.rowsBetween(Window.unboundedPreceding, 0)))
    return isle.groupBy("target", "run", "source").agg(F.min("x").alias("left"), F.max("y").alias("right")).drop("run")


def resolve_reference(rows: DataFrame, names: DataFrame, col: str = "ref_name") -> DataFrame:
    """rows with ref_id by alias; RS numbers are padded to six digits; unknown names make an error."""
    rs = F.regexp_extract(col, "^RS([0-9]+)$", 1)
    key = F.when(rs != "", F.concat(F.lit("RS"), F.lpad(rs, F.greatest(F.length(rs), F.lit(6)), F.lit("0")))).otherwise(F.col(col))
    got = rows.withColumn("__alias", key).join(names.select(F.col("alias").alias("__alias"), "ref_id"), "__alias", "left").drop("__alias")
    return got.withColumn("error", F.when(F.col("ref_id").isNull(), "UnknownReferenceName"))


def resolve_assembly(rows: DataFrame, refs: DataFrame) -> DataFrame:
    """rows(build, chromosome) with ref_id; the mitochondrial chromosome matches any build."""
    m = refs.where("chromosome = 25").groupBy("chromosome").agg(F.min("ref_id").alias("m_id"))
    got = rows.join(refs.select("build", "chromosome", "ref_id"), ["build", "chromosome"], "left").join(m, "chromosome", "left")
    return got.withColumn("ref_id", F.coalesce("ref_id", "m_id")).drop("m_id")


def assign_refs_to_genes(refs: DataFrame) -> DataFrame:
    return refs.groupBy("gene_id").agg(F.array_sort(F.collect_list("ref_id")).alias("ref_ids"))


def subsequence_by_digest(ask: DataFrame, digests: DataFrame, ref_seq: DataFrame) -> DataFrame:
    """ask(digest, start, end) with seq: of the first known name of the digest; start < end is needed."""
    first = digests.groupBy("digest").agg(F.min("ref_id").alias("ref_id"))
    got = ask.join(first, "digest", "left").join(ref_seq, "ref_id", "left")
    good = F.col("start") < F.col("end")
    return got.withColumn("subseq", F.when(good, F.substring("seq", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))) \
        .withColumn("error", F.when(F.col("seq").isNull(), "NotFound").when(~good, "IncorrectRegion")).drop("seq")


def aliases_by_digest(digests: DataFrame) -> DataFrame:
    return digests.groupBy("digest").agg(F.array_sort(F.collect_set("ref_id")).alias("ref_ids"))


def truncated_digest(seq: Column) -> Column:
    """The first 24 bytes of SHA-512, url-safe base64."""
    raw = F.unhex(F.substring(F.sha2(seq, 512), 1, 48))
    return F.translate(F.base64(raw), "+/", "-_")
