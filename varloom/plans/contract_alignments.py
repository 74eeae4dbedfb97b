"""Queries: verified alignments, the sorted reverse index, and sequences of references of every kind."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions import sequences as S
from varloom.operators import alignments, references
from varloom.session import saved, scratch_path

from . import derived as D
from .contract import query
from .contract_core import RC, translate_sql

KEY = "((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000"
#: Sixty letters of a text against a copy with five changed letters and, but for one kind, two inserted and three deleted ones; four kinds are wrong.
CIGARS = {0: "15M10=2I3D32M", 1: "15M10=2I3D32M", 2: "12=13M2I3D32M", 3: "10=5X10M0D2I3D32=", 4: "9M6X10M2I3D32M", 5: "15M10=2I3D32", 6: "60M"}
FAULTS = {1: "WrongLength", 2: "WrongMatch", 4: "WrongChange", 5: "UnsupportedCigar"}
ALIGNED = f""", a as (select {KEY} as align_id, l_suppkey % 7 as k, l_linestatus = 'O' as neg, 100 + l_partkey as pos, l_orderkey as trg_ref,
   substr(seq, (l_orderkey * 7 % (length(seq) - 60))::int + 1, 60) as a from lineitem join ref_seq on ref_id = l_partkey % (select count(*) from documents) where length(seq) > 60),
 b as (select *, translate(substr(a, 11, 5), 'ACGT', 'CGTA') as x from a where k in (0, 3, 6)),
 c as (select align_id, trg_ref, pos, neg, x, unnest(case when k = 6 then [{{'i': 0, 'op': '=', 't': 0, 'tn': 10, 's': 0, 'sn': 10}}, {{'i': 1, 'op': 'X', 't': 10, 'tn': 5, 's': 10, 'sn': 5}}, {{'i': 2, 'op': '=', 't': 15, 'tn': 45, 's': 15, 'sn': 45}}]
   else [{{'i': 0, 'op': '=', 't': 0, 'tn': 10, 's': 0, 'sn': 10}}, {{'i': 1, 'op': 'X', 't': 10, 'tn': 5, 's': 10, 'sn': 5}}, {{'i': 2, 'op': '=', 't': 15, 'tn': 10, 's': 15, 'sn': 10}},
    {{'i': 3, 'op': 'I', 't': 25, 'tn': 2, 's': 25, 'sn': 0}}, {{'i': 4, 'op': 'D', 't': 27, 'tn': 0, 's': 25, 'sn': 3}}, {{'i': 5, 'op': '=', 't': 27, 'tn': 32, 's': 28, 'sn': 32}}] end) as e from b)
 select align_id, e.i::bigint as idx, e.op as op, (e.t)::bigint as trg_left, (e.t + e.tn)::bigint as trg_right, (case when neg then pos - e.s - e.sn else pos + e.s end)::bigint as src_left,
  (case when neg then pos - e.s else pos + e.s + e.sn end)::bigint as src_right, case e.op when 'X' then x when 'I' then 'GT' end as ins, null as error from c
 union all select align_id, null, null, null, null, null, null, null, case k when 1 then 'WrongLength' when 2 then 'WrongMatch' when 4 then 'WrongChange' else 'UnsupportedCigar' end from a where k in (1, 2, 4, 5)"""


@query(D.with_ctes(["ref_seq"], ALIGNED))
def r1_verified_alignments(spark, d):
    docs = D.table(spark, d, "documents").count()
    n = F.length("seq")
    rows = D.table(spark, d, "lineitem").withColumn("ref_id", F.col("l_partkey") % docs).repartition("ref_id").join(D.ref_seq(spark, d).where(n > 60), "ref_id")
    k, a = F.col("l_suppkey") % 7, F.substring("seq", (F.col("l_orderkey") * 7 % (n - 60) + 1).cast("int"), F.lit(60))
    rows = rows.select(D.row_key().alias("align_id"), k.alias("k"), a.alias("a"), F.col("l_orderkey").alias("trg_ref"), "ref_id", (100 + F.col("l_partkey")).alias("src_start"),
                       F.when(F.col("l_linestatus") == "O", "-").otherwise("+").alias("strand"))
    part = lambda i, m: F.substring("a", i, m)
    changed = F.concat(part(1, 10), F.translate(part(11, 5), "ACGT", "CGTA"))
    trg = F.when(F.col("k") == 6, F.concat(changed, part(16, 45))).otherwise(F.concat(changed, part(16, 10), F.lit("GT"), part(29, 32), F.when(F.col("k") == 1, "A").otherwise("")))
    cigar = F.create_map(*[F.lit(x) for item in CIGARS.items() for x in item])[F.col("k").cast("int")]
    src = F.when(F.col("strand") == "-", S.reverse_complement(F.col("a"))).otherwise(F.col("a"))
    blocks, errors = alignments.verified_blocks(rows.select("align_id", cigar.alias("cigar"), F.col("ref_id").alias("src_ref"), src.alias("src_seq"), "src_start", "strand", "trg_ref",
                                                            trg.alias("trg_seq"), F.lit(0).cast("long").alias("trg_start")))
    return blocks.select("align_id", F.col("idx").cast("long").alias("idx"), "op", "trg_left", "trg_right", "src_left", "src_right", "ins").unionByName(errors, allowMissingColumns=True)


def _index(spark, d):
    reverse = references.reverse_alignment(D.align_blocks(spark, d).withColumn("idx", F.lit(0)))
    return alignments.sorted_index(reverse.select("align_id", "trg_ref", "trg_left", "trg_right", "src_ref", "strand"), scratch_path(spark, "reverse-index"), "trg_ref", "trg_left", "trg_right")


@query(D.with_ctes(["blocks"], """select align_id, src_ref as main_ref, src_left as "left", src_right as "right",
  max(src_right) over (partition by src_ref order by src_left, src_right rows unbounded preceding) as max_end from blocks"""))
def r8_sorted_reverse_index(spark, d):
    index, _ = _index(spark, d)
    return index.select("align_id", F.col("trg_ref").alias("main_ref"), F.col("trg_left").alias("left"), F.col("trg_right").alias("right"), "max_end")


@query(D.with_ctes(["blocks"], """, q as (select s_suppkey as region_id, s_suppkey % 26 as ref, 900 + s_suppkey * 31 % 4000 as f, 900 + s_suppkey * 31 % 4000 + s_suppkey % 3 * 20 as t from supplier)
 select region_id, align_id, src_left as "left", src_right as "right" from q join blocks on src_ref = ref where src_left <= t and src_right > f"""))
def r8_search_reverse_index(spark, d):
    index, parts = _index(spark, d)
    a = 900 + F.col("s_suppkey") * 31 % 4000
    regions = D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("region_id"), (F.col("s_suppkey") % 26).alias("trg_ref"), a.alias("from"), (a + F.col("s_suppkey") % 3 * 20).alias("to"))
    return alignments.search_index(index, parts, regions, "trg_ref", "trg_left", "trg_right").select("region_id", "align_id", F.col("trg_left").alias("left"), F.col("trg_right").alias("right"))


MILLION = 1_000_000
KINDS = f""", m as (select ref_id, seq, length(seq) as n, length(seq) // 2 as h, least(length(seq) // 2 - 2, 50) as q, ref_id % 4 as cds, ref_id % 3 as fo from ref_seq where length(seq) >= 60),
 t as (select *, {RC.format('substr(seq, (n - h)::int + 1, h::int)')} || 'ACGT' || substr(seq, 1, (n - h)::int) as mapped from m),
 u as (select *, {RC.format('substr(mapped, (h - q + 2)::int + 1, q::int)')} || 'TTT' || substr(mapped, 1, 20) as transcript from t),
 v as (select *, substr(transcript, 1, q::int) || substr(transcript, q::int + 4) as spliced from u),
 r as (select *, (q + 20 - cds - 3) // 3 as aa from v),
 k as (select {KEY} as key, l_linenumber % 4 as kind, l_suppkey % 10 = 0 as beyond, l_orderkey * 7 as pos, l_quantity::bigint * 40 as w, r.* from lineitem join r on ref_id = l_partkey % (select count(*) from documents)),
 l as (select *, case kind when 0 then n when 1 then length(mapped) when 2 then length(transcript) else aa end as len from k),
 a as (select *, pos % len as "left", case when beyond then len + 5 else least(len, pos % len + w) end as "right" from l),
 p as (select *, substr(spliced, (cds + fo + 3 * "left")::int + 1, (least(cds + 3 * "right" - case when fo > 0 then 3 - fo else 0 end, length(spliced)) - cds - fo - 3 * "left")::int) as coding from a),
 w as (select *, case when fo > 0 then 'X' else '' end || {translate_sql('coding')} || case when length(coding) % 3 = 0 then '' else
   case when length(coding) % 3 = 1 then 'X' else coalesce({{rest}}, 'X') end end as residues from p)
 select key, md5(case when beyond then null when kind = 0 then substr(seq, "left"::int + 1, ("right" - "left")::int) when kind = 1 then substr(mapped, "left"::int + 1, ("right" - "left")::int)
  when kind = 2 then substr(transcript, "left"::int + 1, ("right" - "left")::int) else regexp_replace(residues, '[*X]$', '') end) as seq, case when beyond then 'OutOfReference' end as error from w"""
_REST = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in S.partial_codon_table().items()) + "}[right(coding, 2)]"


@query(D.with_ctes(["ref_seq"], KINDS.replace("{rest}", _REST)))
def r9_sequences_of_all_kinds(spark, d):
    """Parts of texts, of mapped references over them, of transcripts over those, and of their proteins; both strands, own letters."""
    n, h = F.length("seq").cast("long"), F.floor(F.length("seq") / 2)
    base = saved(D.ref_seq(spark, d).where(F.length("seq") >= 60).select("ref_id", n.alias("n"), h.alias("h"), F.least(h - 2, F.lit(50).cast("long")).alias("q")), "kinds")
    zero, null = F.lit(0).cast("long"), F.lit(None)
    block = lambda op, left, right, src, a, b, strand, ins: F.struct(
        F.lit(op).alias("op"), left.alias("trg_left"), right.alias("trg_right"), src.alias("src_ref"), a.alias("src_left"), b.alias("src_right"), F.lit(strand).alias("strand"), ins.cast("string").alias("ins"))
    n, h, q, doc, mapped = F.col("n"), F.col("h"), F.col("q"), F.col("ref_id"), F.col("ref_id") + MILLION
    low = base.select(mapped.alias("trg_ref"), F.explode(F.array(
        block("=", zero, h, doc, n - h, n, "-", null), block("I", h, h + 4, doc, zero, zero, "+", F.lit("ACGT")), block("=", h + 4, n + 4, doc, zero, n - h, "+", null))).alias("b")).select("trg_ref", "b.*")
    high = base.select((doc + 2 * MILLION).alias("trg_ref"), F.explode(F.array(
        block("=", zero, q, mapped, h - q + 2, h + 2, "-", null), block("X", q, q + 3, mapped, zero, zero, "+", F.lit("TTT")),
        block("=", q + 3, q + 23, mapped, zero, F.lit(20).cast("long"), "+", null))).alias("b")).select("trg_ref", "b.*")
    low = alignments.sequence_map(low)
    maps = saved(alignments.compose(alignments.sequence_map(high), low).unionByName(low), "maps")
    cds, shift = doc % 4, (doc % 3).cast("int")
    aa = F.floor((q + 20 - cds - 3) / 3)
    refs = base.select(F.explode(F.array(*(F.struct((doc + i * MILLION).alias("ref_id"), F.lit(kind).alias("kind"), length.alias("length")) for i, (kind, length) in enumerate(
        (("main", n), ("mapped", n + 4), ("transcript", q + 23), ("protein", aa)))))).alias("r")).select("r.*")
    exons = base.select((doc + 2 * MILLION).alias("transcript"), F.explode(F.array(
        F.struct(F.lit(0).alias("n"), zero.alias("u_left"), q.alias("u_right"), zero.alias("s_left"), q.alias("s_right")),
        F.struct(F.lit(1).alias("n"), (q + 3).alias("u_left"), (q + 23).alias("u_right"), q.alias("s_left"), (q + 20).alias("s_right")))).alias("e")).select("transcript", "e.*")
    coding = base.select((doc + 3 * MILLION).alias("protein"), (doc + 2 * MILLION).alias("transcript"), cds.alias("cds_left"), shift.alias("frame_offset"))
    docs = D.table(spark, d, "documents").count()
    lines = D.table(spark, d, "lineitem").select(D.row_key().alias("key"), (F.col("l_partkey") % docs + F.col("l_linenumber") % 4 * MILLION).alias("ref_id"), (F.col("l_suppkey") % 10 == 0).alias("beyond"),
                                                 (F.col("l_orderkey") * 7).alias("pos"), (F.col("l_quantity").cast("long") * 40).alias("w"))
    size = F.col("length")
    asks = lines.join(refs, "ref_id").select("key", "ref_id", (F.col("pos") % size).alias("left"), F.when(F.col("beyond"), size + 5).otherwise(F.least(size, F.col("pos") % size + F.col("w"))).alias("right"))
    return alignments.sequences(asks, refs, maps, exons, coding, D.chunks(spark, d)).select("key", F.md5("seq").alias("seq"), "error")
