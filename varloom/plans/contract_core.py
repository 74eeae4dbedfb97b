"""Queries: normalisation, proteins, references and lift-over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.functions import sequences as S
from varloom.operators import intervals, liftover, normalize, protein, references
from varloom.session import kept, saved

from . import derived as D
from .contract import query

CODONS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in S.codon_table().items()) + "}"
THREE = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in S.THREE_LETTERS.items()) + "}"


def translate_sql(s: str) -> str:
    return (f"coalesce(array_to_string(list_transform(range(0, (length({s}) // 3)::bigint), "
            f"lambda i: coalesce({CODONS}[substr({s}, (3 * i + 1)::int, 3)], 'X')), ''), '')")


def three_sql(s: str) -> str:
    return f"coalesce(array_to_string(list_transform(range(1, length({s}) + 1), lambda i: {THREE}[substr({s}, i::int, 1)]), ''), '')"


RC = "reverse(translate({}, 'ACGTMRYKVHDB', 'TGCAKYRMBDHV'))"


def normal(spark: SparkSession, d: str) -> DataFrame:
    """The lines' changes in normal form: made once a session; the changes themselves are not written for it."""
    return kept(spark, "normal", d, lambda: normalize.normalize(D.fresh_variants(spark, d), D.chunks(spark, d)))


def exons(spark: SparkSession, d: str) -> DataFrame:
    return references.unsplice_transcripts(D.exon_lengths(spark, d))


@query(D.with_ctes(["trim"], "select row_id, prefix::bigint as prefix, suffix::bigint as suffix, org2, alt2 from trim"))
def c1_trim_alleles(spark, d):
    rows = normalize.trim_alleles(D.raw_variants(spark, d).withColumn("org", F.col("ref")))
    return rows.select("row_id", F.col("prefix").cast("long").alias("prefix"), F.col("suffix").cast("long").alias("suffix"), "org2", "alt2")


@query(D.with_ctes(["norm"], "select row_id, n_left, n_right from norm"))
def c2_shift_range(spark, d):
    return normal(spark, d).select("row_id", "n_left", "n_right")


@query(D.with_ctes(["norm"], "select row_id, category::bigint as category, length_change::bigint as length_change, inserted, original from norm"))
def c3_classify(spark, d):
    return normal(spark, d).select("row_id", F.col("category").cast("long").alias("category"), "length_change", "inserted", "original")


@query(D.with_ctes(["norm"], f"""select row_id, n_left as p_left, case category when 0 then n_right when 3 then n_left + length_change else n_left end as p_right,
  case when category in (0, 3) then original else '' end as p_ref, case category when 0 then inserted when 1 then original || inserted
  when 2 then {D.tile_sql('original', 'length_change')} else '' end as p_alt from norm"""))
def c4_left_aligned(spark, d):
    return normalize.left_aligned(normal(spark, d)).select("row_id", "p_left", "p_right", "p_ref", "p_alt")


@query(D.with_ctes(["norm"], f"""select row_id, n_right as p_right, case category when 0 then n_left when 3 then n_right - length_change else n_right end as p_left,
  case category when 0 then original when 3 then {D.rot_left_sql('original', 'n_right - n_left - length_change')} else '' end as p_ref,
  case category when 0 then inserted when 1 then inserted || original when 2 then {D.rot_left_sql('original', 'n_right - n_left')} else '' end as p_alt from norm"""))
def c4_right_aligned(spark, d):
    return normalize.right_aligned(normal(spark, d)).select("row_id", "p_left", "p_right", "p_ref", "p_alt")


@query(D.with_ctes(["norm"], """,
 m as (select ref_id * 1000 + "left" // 500 as hap, n_left, n_right, category, length_change, length(inserted) as ni, inserted, original from norm),
 o as (select *, row_number() over w as k, lag(n_left) over w as pl, lag(n_right) over w as pr, lag(category) over w as pc from m
   window w as (partition by hap order by n_left, n_right, ni, inserted, category, length_change, original)),
 g as (select *, case when pl = n_left and pr = n_right and pc = category and category >= 2 then 0 else 1 end as fresh from o),
 h as (select hap, n_left, n_right, sum(fresh) over (partition by hap order by k rows unbounded preceding) as grp, length_change from g),
 f as (select hap, grp, min(n_left) as n_left, min(n_right) as n_right, sum(length_change)::bigint as lc from h group by hap, grp),
 q as (select *, lag(n_left) over w as pl, lag(n_right) over w as pr from f window w as (partition by hap order by grp))
 select hap, count(*) as n_mods, sum(lc)::bigint as length_change, bool_or(coalesce(pr > n_left or pl = n_left, false)) as clash from q group by hap"""))
def c5_canonicalize_genomic(spark, d):
    rows = normal(spark, d).withColumn("hap", F.col("ref_id") * 1000 + F.floor(F.col("left") / 500)).drop("error")
    return normalize.merge_modifications(rows, ["hap"]).select(
        "hap", F.size("mods").cast("long").alias("n_mods"),
        F.aggregate("mods", F.lit(0).cast("long"), lambda a, m: a + m["length_change"]).alias("length_change"), F.col("error").isNotNull().alias("clash"))


PROTEINS = f"""select ref_id, {translate_sql("seq")} as seq from ref_seq"""
RAW_P = """select ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000 as row_id, ref_id, seq, l_orderkey % (length(seq) - 6) as "left",
  l_orderkey % (length(seq) - 6) + l_linenumber % 3 as "right", substr(seq, l_orderkey % (length(seq) - 6) + 1, l_linenumber % 3) as ref,
  substr(seq, l_suppkey % (length(seq) - 6) + 1, l_suppkey % 3) as alt from lineitem
  join proteins on ref_id = l_partkey % (select count(*) from documents) where length(seq) >= 10"""


def proteins(spark, d):
    return D.ref_seq(spark, d).select("ref_id", S.translate_codons(F.col("seq"), tail=False).alias("seq"))


@query(D.with_ctes(["norm"], "select row_id, n_left, n_right, category::bigint as category, inserted from norm")
       .replace("raw as (" + D.CTES["raw"] + ")", f"proteins as materialized ({PROTEINS}),\nraw as ({RAW_P})"))
def c6_canonicalize_protein(spark, d):
    seqs = proteins(spark, d)
    n = F.length("seq")
    docs = D.table(spark, d, "documents").count()
    rows = D.table(spark, d, "lineitem").withColumn("ref_id", F.col("l_partkey") % docs).join(seqs.where(n >= 10), "ref_id")
    left, k = F.col("l_orderkey") % (n - 6), F.col("l_linenumber") % 3
    rows = rows.select(D.row_key().alias("row_id"), "ref_id", left.alias("left"), (left + k).alias("right"),
                       F.substring("seq", (left + 1).cast("int"), k).alias("ref"),
                       F.substring("seq", (F.col("l_suppkey") % (n - 6) + 1).cast("int"), (F.col("l_suppkey") % 3).cast("int")).alias("alt"))
    out = normalize.canonicalize_protein(rows, intervals.ref_chunks(seqs))
    return out.select("row_id", "n_left", "n_right", F.col("category").cast("long").alias("category"), "inserted")


@query(D.with_ctes(["raw"], f"""select row_id // 1000000000 as order_id, string_agg(case row_id % 3 when 0 then 'ACGT' when 1 then substr(seq, "left" + 1, 7)
  else {RC.format('substr(seq, "left" + 1, 7)')} end, '' order by row_id) as alt from raw group by all"""))
def c7_expand_hgvs_sequences(spark, d):
    v = D.raw_variants(spark, d)
    parts = v.select(F.floor(F.col("row_id") / 1000000000).alias("order_id"), F.col("row_id").alias("idx"), F.when(F.col("row_id") % 3 == 0, "ACGT").alias("literal"),
                     "ref_id", "left", (F.col("left") + 7).alias("right"), (F.col("row_id") % 3 == 2).alias("inverted"))
    return normalize.expand_hgvs_sequences(parts, D.chunks(spark, d), "order_id")


@query(D.with_ctes(["raw"], f"""select row_id, ({D.lcp_sql('substr(seq, "left" + 1)', D.tile_sql('substr(seq, "left" + 1, 2)', 'length(substr(seq, "left" + 1))'))}) // 2 as copies,
  case when row_id % 5 < copies then 'deletion' when row_id % 5 = copies then 'identity' else 'insertion' end as kind from raw"""))
def c8_expand_repeats(spark, d):
    v, chunks = D.raw_variants(spark, d).select("row_id", "ref_id", "left", (F.col("left") + 2).alias("right")), D.chunks(spark, d)
    unit = intervals.lookup_sequence(v, chunks, "row_id").withColumnRenamed("seq", "unit")
    rows = v.drop("right").join(unit, "row_id").withColumn("n", F.col("row_id") % 5)
    return normalize.expand_repeats(rows, chunks).select("row_id", "copies", "kind")


@query(D.with_ctes(["norm"], """select ref_id, count(*) as n_rows, count(distinct (n_left, n_right, category, length_change, inserted)) as n_keys from norm group by ref_id"""))
def c9_variant_key(spark, d):
    return normal(spark, d).withColumn("k", normalize.variant_key()).groupBy("ref_id").agg(F.count("*").alias("n_rows"), F.countDistinct("k").alias("n_keys"))


@query(D.with_ctes(["ref_seq"], f"select ref_id, md5({RC.format('seq')}) as rc from ref_seq"))
def c10_reverse_complement(spark, d):
    return D.ref_seq(spark, d).select("ref_id", F.md5(S.reverse_complement(F.col("seq"))).alias("rc"))


@query(D.with_ctes(["ref_seq"], f"select ref_id, {translate_sql('seq')} as protein from ref_seq"))
def p1_translate_codons(spark, d):
    return D.ref_seq(spark, d).select("ref_id", S.translate_codons(F.col("seq"), tail=False).alias("protein"))


@query(D.with_ctes(["raw"], """, a as (select ref_id, min(row_id) as r from raw group by ref_id), b as (select raw.* from raw join a on row_id = r),
 c as (select raw.ref_id, min(raw.row_id) as r from raw join b on raw.ref_id = b.ref_id where raw."left" >= b."right" and raw.row_id > b.row_id group by raw.ref_id),
 e as (select raw.* from raw join c on row_id = r)
 select b.ref_id, md5(substr(b.seq, 1, b."left") || b.alt || case when e.row_id is null then substr(b.seq, b."right" + 1)
  else substr(b.seq, b."right" + 1, e."left" - b."right") || e.alt || substr(b.seq, e."right" + 1) end) as seq from b left join e on b.ref_id = e.ref_id"""))
def p2_apply_mods(spark, d):
    v = D.raw_variants(spark, d)
    first = v.groupBy("ref_id").agg(F.min_by(F.struct("left", "right", "alt"), "row_id").alias("m"), F.min("row_id").alias("r"))
    later = v.join(first, "ref_id").where((F.col("left") >= F.col("m.right")) & (F.col("row_id") > F.col("r"))).groupBy("ref_id").agg(
        F.min_by(F.struct("left", "right", "alt"), "row_id").alias("m2"))
    rows = first.join(later, "ref_id", "left").join(D.ref_seq(spark, d), "ref_id")
    mods = F.filter(F.array("m", "m2"), lambda x: x.isNotNull())
    return rows.select("ref_id", F.md5(S.apply_mods(F.col("seq"), mods)).alias("seq"))


def _changes(spark, d):
    """Whole texts as coding sequences: without T no stop lies inside; the last 40 letters follow the stop. Changes lie all over them."""
    body = (F.floor((F.length("seq") - 40) / 3) * 3).cast("int")
    seqs = D.ref_seq(spark, d).where(F.length("seq") >= 100).withColumn("n", body)
    cds = F.concat(F.lit("ATG"), F.translate(F.substring("seq", F.lit(1), F.col("n")), "T", "C"), F.lit("TAA"))
    k, left = F.col("ref_id") % 4, F.col("ref_id") * 37 % (F.col("n") - 6) + 6
    return seqs.select(F.col("ref_id").alias("row_id"), cds.alias("cds"), F.substring("seq", F.col("n") + 1, F.length("seq")).alias("tail"), F.array(F.struct(
        left.alias("left"), (left + k).alias("right"), F.substring(F.lit("GATTACA"), F.lit(1), (F.col("ref_id") % 3).cast("int")).alias("alt"))).alias("mods"))


CHANGES = f""", a as (select *, (length(seq) - 40) // 3 * 3 as n from ref_seq where length(seq) >= 100),
 b as (select ref_id, 'ATG' || translate(substr(seq, 1, n), 'T', 'C') || 'TAA' as cds, substr(seq, n + 1) as tail, ref_id * 37 % (n - 6) + 6 as l, ref_id % 4 as k, substr('GATTACA', 1, ref_id % 3) as alt from a),
 c as (select *, substr(cds || tail, 1, l) || alt || substr(cds || tail, l + k + 1) as made from b),
 e as (select *, {translate_sql('cds')} as old, {translate_sql('made')} as t from c),
 f as (select *, case when strpos(t, '*') > 0 then substr(t, 1, strpos(t, '*')) else t end as fresh from e),
 g as (select *, {D.lcp_sql('old', 'fresh')} as lead from f)"""
KIND = """case when old = fresh then 'synonymous' when substr(old, lead + 1, 1) = '*' and substr(fresh, lead + 1, 1) <> '*' then 'extension'
  when substr(fresh, lead + 1, 1) = '*' then 'stop' when (length(alt) - k) % 3 <> 0 then 'frameshift' else 'substitution' end"""
#: The text of a protein change from its label and the differing middle of both proteins.
TEXT_P = f"""select *, lead as pl, length(old) - same as pr, substr(old, lead + 1, length(old) - same - lead) as x, substr(fresh, lead + 1, length(fresh) - same - lead) as y,
   {KIND} as label, strpos(substr(fresh, lead + 1), '*') as stop, {three_sql('substr(old, lead + 1, 1)')} as a1, {three_sql('substr(fresh, lead + 1, 1)')} as b1
  from (select *, {D.lcp_sql('reverse(substr(old, lead + 1))', 'reverse(substr(fresh, lead + 1))')} as same from g)"""


@query(D.with_ctes(["ref_seq"], CHANGES + f""", h as ({TEXT_P}),
 i as (select *, a1 || (pl + 1) || case when length(x) > 1 then '_' || {three_sql('substr(x, length(x), 1)')} || pr else '' end as place from h)
 select ref_id as row_id, pl::bigint as p_left, pr::bigint as p_right, x as p_ref, y as p_alt, 'p.' || case label when 'synonymous' then '='
  when 'extension' then 'Ter' || (lead + 1) || b1 || 'extTer' || case when stop > 0 then (stop - 1)::varchar else '?' end
  when 'stop' then a1 || (lead + 1) || 'Ter' when 'frameshift' then a1 || (lead + 1) || b1 || 'fsTer' || case when stop > 0 then stop::varchar else '?' end
  else case when length(x) = 1 and length(y) = 1 then place || {three_sql('y')}
   when length(x) = 0 then {three_sql('substr(old, pl, 1)')} || pl || '_' || {three_sql('substr(old, pl + 1, 1)')} || (pl + 1) || 'ins' || {three_sql('y')}
   when length(y) = 0 then place || 'del' else place || 'delins' || {three_sql('y')} end end as hgvs from i"""))
def p3_transcript_to_protein_change(spark, d):
    return protein.transcript_to_protein_change(_changes(spark, d)).select("row_id", "hgvs", "p_left", "p_right", "p_ref", "p_alt")


@query(D.with_ctes(["ref_seq"], CHANGES + f" select ref_id as row_id, {KIND} as label from g"))
def p4_effect_labels(spark, d):
    return protein.transcript_to_protein_change(_changes(spark, d)).select("row_id", "label")


@query()
def p5_match_transcript_variants(spark, d):
    rows = saved(protein.transcript_to_protein_change(_changes(spark, d)).select("row_id", "cds", "tail", "mods", "new"), "proteins")
    m = F.get("mods", F.lit(0))
    changes = rows.select(F.col("row_id").alias("change_id"), F.col("row_id").alias("transcript"), m["left"].alias("left"), m["right"].alias("right"), "cds", "tail",
                          F.col("new").alias("protein"))
    own = rows.select(F.col("row_id").alias("transcript"), (F.col("row_id") * 4).alias("var_id"), m["left"].alias("left"), m["right"].alias("right"), m["alt"].alias("alt"))
    other = own.select("transcript", (F.col("var_id") + 1).alias("var_id"), F.lit(3).cast("long").alias("left"), F.lit(4).cast("long").alias("right"), F.lit("A").alias("alt"))
    got = protein.match_transcript_variants(changes, own.unionByName(other))
    return got.select("change_id", F.array_join(F.col("combination").cast("array<string>"), ",").alias("combination"))


@query()
def p6_minimal_protein_edit(spark, d):
    rows = protein.transcript_to_protein_change(_changes(spark, d))
    return protein.minimal_protein_edit(rows.select(F.col("row_id").alias("pair_id"), F.col("old").alias("a"), F.col("new").alias("b")))


@query(D.with_ctes(["ref_seq"], f", a as (select ref_id, {translate_sql('seq')} as p from ref_seq) select ref_id, {three_sql('p')} as three from a"))
def p7_amino_acid_codes(spark, d):
    return D.ref_seq(spark, d).select("ref_id", S.three_letters(S.translate_codons(F.col("seq"), tail=False)).alias("three"))


# References

CIG = "l_quantity::bigint || '=' || l_linenumber || 'D' || l_suppkey % 3 || 'I5M'"
CIG_BLOCKS = """, a as (select ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000 as align_id, l_quantity::bigint as q, l_linenumber::bigint as dl, l_suppkey % 3 as il from lineitem),
 b as (select align_id, 0 as idx, '=' as op, 0 as t, q as tn, 0 as s, q as sn from a union all select align_id, 1, 'D', q, 0, q, dl from a
  union all select align_id, 2, 'I', q, il, q + dl, 0 from a where il > 0 union all select align_id, 3, '=', q + il, 5, q + dl, 5 from a)
""".lstrip(", ")


def _cigars(spark, d):
    q = F.col("l_quantity").cast("long").cast("string")
    cigar = F.concat(q, F.lit("="), F.col("l_linenumber").cast("string"), F.lit("D"), (F.col("l_suppkey") % 3).cast("string"), F.lit("I5M"))
    docs = D.table(spark, d, "documents").count()
    return D.table(spark, d, "lineitem").select(
        D.row_key().alias("align_id"), cigar.alias("cigar"),
        F.array(F.substring(F.lit("GT"), F.lit(1), (F.col("l_suppkey") % 3).cast("int"))).alias("seqs"), (F.col("l_partkey") % docs).alias("src_ref"),
        F.lit(100).cast("long").alias("src_start"), F.when(F.col("l_linestatus") == "O", "-").otherwise("+").alias("strand"),
        F.col("l_orderkey").alias("trg_ref"), F.lit(0).cast("long").alias("trg_start"))


@query("with " + CIG_BLOCKS + """ select b.align_id, idx::bigint as idx, op, t::bigint as trg_left, (t + tn)::bigint as trg_right,
  case when l_linestatus = 'O' then 100 - s - sn else 100 + s end::bigint as src_left, case when l_linestatus = 'O' then 100 - s else 100 + s + sn end::bigint as src_right
  from b join lineitem on align_id = ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000""")
def r1_cigar_to_blocks(spark, d):
    return references.cigar_to_blocks(_cigars(spark, d)).select("align_id", F.col("idx").cast("long").alias("idx"), "op", "trg_left", "trg_right", "src_left", "src_right")


@query("""select ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000 as align_id, l_quantity::bigint || '=' || l_linenumber || 'D' ||
  case when l_suppkey % 3 > 0 then (l_suppkey % 3) || 'I' else '' end || '5=' as cigar from lineitem""")
def r2_blocks_to_cigar(spark, d):
    return references.blocks_to_cigar(references.cigar_to_blocks(_cigars(spark, d)))


@query(D.with_ctes(["ref_seq"], f""", a as (select ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000 as align_id, l_quantity::int as q, l_linenumber::int as dl, substr('GT', 1, l_suppkey % 3) as ins, l_linestatus = 'O' as neg, seq
   from lineitem join ref_seq on ref_id = l_partkey % (select count(*) from documents))
 select align_id, case when neg then {RC.format('substr(seq, 101 - q, q)')} || ins || {RC.format('substr(seq, 101 - q - dl - 5, 5)')}
  else substr(seq, 101, q) || ins || substr(seq, 101 + q + dl, 5) end as seq from a"""))
def r3_apply_alignment(spark, d):
    return references.apply_cigars(_cigars(spark, d), D.ref_seq(spark, d).withColumnRenamed("ref_id", "src_ref"))


def _blocks(spark, d):
    return D.align_blocks(spark, d).withColumn("idx", F.lit(0)).withColumn("op", F.lit("=")).withColumn("ins", F.lit(None).cast("string"))


@query(D.with_ctes(["blocks"], "select align_id, src_ref as trg_ref, src_left as trg_left, src_right as trg_right, trg_ref as src_ref, trg_left as src_left, trg_right as src_right, strand from blocks"))
def r4_reverse_alignment(spark, d):
    return references.reverse_alignment(_blocks(spark, d)).select("align_id", "trg_ref", "trg_left", "trg_right", "src_ref", "src_left", "src_right", "strand")


@query(D.with_ctes(["blocks"], """select align_id, greatest(trg_left, 110) as trg_left, least(trg_right, 320) as trg_right,
  case when strand = '+' then src_left + greatest(110 - trg_left, 0) else src_left + greatest(trg_right - 320, 0) end as src_left,
  case when strand = '+' then src_right - greatest(trg_right - 320, 0) else src_right - greatest(110 - trg_left, 0) end as src_right
  from blocks where trg_left < 320 and trg_right > 110"""))
def r5_clip_alignment(spark, d):
    return references.clip_alignment(_blocks(spark, d), F.lit(110), F.lit(320)).select("align_id", "trg_left", "trg_right", "src_left", "src_right")


@query(D.with_ctes(["blocks"], "select align_id, trg_left, trg_right, src_left, src_right from blocks"))
def r6_append_alignments(spark, d):
    """Blocks cut in two and appended again."""
    b = _blocks(spark, d)
    cut = F.floor((F.col("trg_left") + F.col("trg_right")) / 2)
    halves = references.clip_alignment(b, F.col("trg_left"), cut).unionByName(
        references.clip_alignment(b, cut, F.col("trg_right")).withColumn("idx", F.lit(1)))
    return references.append_alignments(halves.where("trg_left < trg_right")).select("align_id", "trg_left", "trg_right", "src_left", "src_right")


@query(D.with_ctes(["exons"], "select transcript, n, u_left, u_right, s_left, s_right from exons"))
def r7_unsplice_transcripts(spark, d):
    return exons(spark, d)


@query(D.with_ctes(["blocks"], """select src_ref as main_ref, bin, count(*) as n_blocks, min(src_left) as first_left from (
  select src_ref, src_left, unnest(range(src_left // 512, src_right // 512 + 1)) as bin from blocks) group by all"""))
def r8_build_reverse_index(spark, d):
    b = references.reverse_alignment(_blocks(spark, d))
    rows = b.withColumn("bin", F.explode(intervals.bins(F.col("trg_left"), F.col("trg_right"), 512)))
    return rows.groupBy(F.col("trg_ref").alias("main_ref"), "bin").agg(F.count("*").alias("n_blocks"), F.min("trg_left").alias("first_left"))


@query(D.with_ctes(["raw"], """select row_id, md5(substr(seq, "left" + 1, 5000)) as seq from raw"""))
def r9_get_sequence(spark, d):
    chunks = D.chunks(spark, d)
    rows = D.raw_variants(spark, d).join(chunks.where("chunk_no = 0").select("ref_id", F.col("ref_len").alias("n")), "ref_id")
    ask = rows.select("row_id", "ref_id", "left", F.least(F.col("left") + 5000, F.col("n")).alias("right"))
    return intervals.lookup_sequence(ask, chunks, "row_id").select("row_id", F.md5("seq").alias("seq"))


@query(D.with_ctes(["exons", "ref_seq"], """select transcript, md5(string_agg(substr(seq, u_left::int + 1, (u_right - u_left)::int), '' order by n)) as seq
  from exons join ref_seq on ref_id = transcript % (select count(*) from documents) group by transcript"""))
def r10_get_spliced_sequence(spark, d):
    docs = D.table(spark, d, "documents").count()
    e = exons(spark, d).select(F.concat_ws("/", "transcript", "n").alias("k"), "transcript", "n", (F.col("transcript") % docs).alias("ref_id"), "u_left", "u_right")
    got = e.join(intervals.lookup_sequence(e, D.chunks(spark, d), "k", "u_left", "u_right"), "k", "left")
    one = got.groupBy("transcript").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "seq"))), lambda x: x["seq"]), "").alias("seq"))
    return one.select("transcript", F.md5("seq").alias("seq"))


@query(D.with_ctes(["ref_seq"], f"""select ref_id as protein, regexp_replace(case when ref_id % 3 > 0 then 'X' else '' end ||
  {translate_sql("substr(seq, ref_id % 3 + 11, 300 - ref_id % 3 * 3)")}, '[*X]$', '') as seq from ref_seq where length(seq) >= 400"""))
def r11_protein_sequence(spark, d):
    k = F.col("ref_id") % 3
    rows = D.ref_seq(spark, d).where(F.length("seq") >= 400).select(
        F.col("ref_id").alias("protein"), "seq", F.lit(10).alias("cds_left"), (F.lit(310) - k * 2).alias("cds_right"), k.alias("frame_offset"))
    return references.protein_sequence(rows)


@query("""select doc_id as ref_id, length(text) as length, least(length(text), 1000) as spliced_length, case doc_id % 3 when 0 then 'GRCh38' when 1 then 'GRCh37' end as build,
  case when doc_id % 30 between 1 and 24 then doc_id % 30 when doc_id % 30 = 25 then 25 end::int as chromosome from documents""")
def r12_lengths_and_builds(spark, d):
    k = F.col("doc_id") % 30
    refs = D.table(spark, d, "documents").select(
        F.col("doc_id").alias("ref_id"), F.when(k.between(1, 24), F.concat(F.lit("NC_0000"), F.lpad(k.cast("string"), 2, "0"), F.lit(".1"))).when(k == 25, "NC_012920.1").otherwise("NT_1").alias("name"),
        F.when(F.col("doc_id") % 3 == 0, "main_GRCh38.fasta").when(F.col("doc_id") % 3 == 1, "GRCh37_x.fasta").otherwise("other").alias("file"), F.length("text").cast("long").alias("length"))
    e = refs.select(F.col("ref_id").alias("transcript"), F.col("length").alias("u_right"), F.lit(0).cast("long").alias("s_left"), F.least(F.col("length"), F.lit(1000)).alias("s_right"))
    return references.lengths_and_builds(refs, e).drop("name")


@query("select doc_id % 50 as gene_id, string_agg(doc_id::varchar, ',' order by doc_id) as refs from documents group by all")
def r13_assign_refs_to_genes(spark, d):
    refs = D.table(spark, d, "documents").select((F.col("doc_id") % 50).alias("gene_id"), F.col("doc_id").alias("ref_id"))
    return references.assign_refs_to_genes(refs).select("gene_id", F.array_join(F.col("ref_ids").cast("array<string>"), ",").alias("refs"))


@query(D.with_ctes(["regions"], """, r as (select chrom as target, "left" as l, "right" as r, case region_id % 3 when 0 then 'NC_' when 1 then 'NT_' else 'NW_' end || region_id % 7 as source from regions),
 e as (select target, l as p from r union select target, r from r), p as (select target, p as x, lead(p) over (partition by target order by p) as y from e),
 q as (select p.target, x, y, count(source) filter (source like 'NC%') as nc, count(source) filter (source like 'NT%') as nt, count(source) filter (source like 'NW%') as nw,
   max(source) filter (source like 'NC%') as sc, max(source) filter (source like 'NT%') as st, max(source) filter (source like 'NW%') as sw
   from p left join r on p.target = r.target and r.l <= x and r.r >= y where y is not null group by all),
 s as (select target, x, y, case when nc = 1 then sc when nc > 1 then null when nt = 1 then st when nt > 1 then null when nw = 1 then sw end as source from q),
 t as (select *, case when row_number() over w = 1 or lag(source) over w is distinct from source then 1 else 0 end as fresh from s window w as (partition by target order by x)),
 u as (select *, sum(fresh) over (partition by target order by x rows unbounded preceding) as run from t)
 select target, source, min(x) as "left", max(y) as "right" from u group by target, run, source"""))
def r14_select_best_alignment(spark, d):
    kind = F.element_at(F.array(*map(F.lit, ("NC_", "NT_", "NW_"))), (F.col("region_id") % 3 + 1).cast("int"))
    rows = D.regions(spark, d).select(F.col("chrom").alias("target"), "left", "right", F.concat(kind, (F.col("region_id") % 7).cast("string")).alias("source"))
    return references.select_best_alignment(rows)


@query("""select ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000 as row_id, case when l_partkey <= 150 then l_partkey end as ref_id, case when l_partkey > 150 then 'UnknownReferenceName' end as error from lineitem""")
def r15_resolve_reference(spark, d):
    rows = D.table(spark, d, "lineitem").select(D.row_key().alias("row_id"), F.concat(F.lit("RS"), F.col("l_partkey").cast("string")).alias("ref_name"))
    names = D.table(spark, d, "part").where("p_partkey <= 150").select(F.concat(F.lit("RS"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("alias"), F.col("p_partkey").alias("ref_id"))
    return references.resolve_reference(rows, names).select("row_id", "ref_id", "error")


@query("""select o_orderkey as row_id, case when o_custkey % 26 = 25 then 25 when o_custkey % 2 = 0 and o_custkey % 26 < 25 then o_custkey % 26 end::bigint as ref_id from orders""")
def r16_resolve_assembly(spark, d):
    rows = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.when(F.col("o_custkey") % 2 == 0, "GRCh38").otherwise("GRCh37").alias("build"), (F.col("o_custkey") % 26).alias("chromosome"))
    refs = rows.select("chromosome").distinct().select(F.lit("GRCh38").alias("build"), "chromosome", F.col("chromosome").alias("ref_id"))
    return references.resolve_assembly(rows, refs.unionByName(spark.range(25, 26).select(F.lit("GRCh38").alias("build"), F.col("id").alias("chromosome"), F.col("id").alias("ref_id"))).distinct()).select("row_id", "ref_id")


@query(D.with_ctes(["ref_seq"], """, g as (select md5(seq) as digest, min(ref_id) as ref_id from ref_seq group by 1)
 select o_orderkey as row_id, case when r.ref_id is not null and o_custkey % 20 < o_custkey % 31 then substr(s.seq, o_custkey % 20 + 1, o_custkey % 31 - o_custkey % 20) end as subseq,
 case when o_custkey % 20 >= o_custkey % 31 then 'IncorrectRegion' end as error from orders join ref_seq r on r.ref_id = o_custkey % (select count(*) from documents)
 join g on g.digest = md5(r.seq) join ref_seq s on s.ref_id = g.ref_id"""))
def r17_subsequence_by_digest(spark, d):
    seqs = D.ref_seq(spark, d)
    digests = seqs.select("ref_id", F.md5("seq").alias("digest"))
    docs = D.table(spark, d, "documents").count()
    ask = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), (F.col("o_custkey") % docs).alias("ref_id"), (F.col("o_custkey") % 20).alias("start"), (F.col("o_custkey") % 31).alias("end"))
    return references.subsequence_by_digest(ask.join(digests, "ref_id").drop("ref_id"), digests, seqs).select("row_id", "subseq", "error")


@query(D.with_ctes(["ref_seq"], "select md5(seq) as digest, string_agg(ref_id::varchar, ',' order by ref_id) as refs from ref_seq group by 1"))
def r18_aliases_by_digest(spark, d):
    digests = D.ref_seq(spark, d).select("ref_id", F.md5("seq").alias("digest"))
    return references.aliases_by_digest(digests).select("digest", F.array_join(F.col("ref_ids").cast("array<string>"), ",").alias("refs"))


# Lift-over

ITEMS = """, items as (select o_orderkey as item_id, o_orderkey as trg_ref, 100 + o_custkey % 700 as "left", 100 + o_custkey % 700 + o_custkey % 3 as "right", 'ACG' as alt from orders)"""


def _items(spark, d):
    a = 100 + F.col("o_custkey") % 700
    return D.table(spark, d, "orders").select(F.col("o_orderkey").alias("item_id"), F.col("o_orderkey").alias("trg_ref"), a.alias("left"), (a + F.col("o_custkey") % 3).alias("right"), F.lit("ACG").alias("alt"))


@query(D.with_ctes(["perfect"], ITEMS + f""" , m as (select item_id, src_ref, case when strand = '+' then src_left + "left" - trg_left else src_right - ("right" - trg_left) end as l, "right" - "left" as n, strand
   from items join perfect using (trg_ref) where "left" >= trg_left and "right" <= trg_right),
 o as (select item_id, count(*) as k, min(src_ref) as main_ref, min(l) as main_left, min(l + n) as main_right, min(strand) as strand from m group by item_id)
 select i.item_id, case when k = 1 then main_ref end as main_ref, case when k = 1 then main_left end as main_left, case when k = 1 then main_right end as main_right,
 case when k = 1 then case when strand = '-' then 'CGT' else 'ACG' end end as main_alt, case when k is null then 'NoAlignment' when k > 1 then 'AmbiguousAlignment' end as error
 from items i left join o on i.item_id = o.item_id"""))
def j1_map_to_main_genome(spark, d):
    return liftover.map_to_main(_items(spark, d), D.align_blocks(spark, d))


@query(D.with_ctes(["perfect"], """, items as (select o_orderkey as item_id, unnest([0, 1, 2]) as change, o_orderkey as trg_ref, 100 + o_custkey % 30 as base from orders),
 c as (select item_id, change, trg_ref, base + change * 100 as "left", base + change * 100 + 2 as "right" from items where change <= item_id % 3),
 m as (select item_id, change, count(*) as k, min(src_ref) as main_ref, min(case when strand = '+' then src_left + "left" - trg_left else src_right - ("right" - trg_left) end) as l, min(strand) as strand
   from c join perfect using (trg_ref) where "left" >= trg_left and "right" <= trg_right group by all),
 g as (select c.item_id, c.change, k, main_ref, l, strand from c left join m on c.item_id = m.item_id and c.change = m.change),
 w as (select item_id, case when bool_or(k is null) then 'NoAlignment' when bool_or(k > 1) then 'AmbiguousAlignment' when min(main_ref) <> max(main_ref) then 'DifferentReferences' end as error from g group by item_id)
 select g.item_id, change::bigint as change, case when error is null then main_ref end as main_ref, case when error is null then l end as main_left,
  case when error is null then case strand when '-' then 'GT' else 'AC' end end as main_alt, error from g join w on g.item_id = w.item_id"""))
def j1_map_haplotypes_to_main_genome(spark, d):
    """Variants of one to three changes."""
    a = 100 + F.col("o_custkey") % 30 + F.col("change") * 100
    rows = D.table(spark, d, "orders").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("o_orderkey") % 3)).alias("change")).select(
        F.col("o_orderkey").alias("item_id"), "change", F.col("o_orderkey").alias("trg_ref"), a.alias("left"), (a + 2).alias("right"), F.lit("AC").alias("alt"))
    return liftover.map_to_main(rows, D.align_blocks(spark, d)).select("item_id", "change", "main_ref", "main_left", "main_alt", "error")


def _turned_sql(text: str) -> str:
    return f"case when strand = '-' then {RC.format(text)} else {{}} end"


LONG = """, forms as materialized (select row_id, ref_id, n_left, n_right, category, length_change, inserted, original from norm), longer as materialized (select ref_id as trg_ref, 0 as trg_left, length(seq) // 2 as trg_right, ref_id % 25 as src_ref, 70000 as src_left, 70000 + length(seq) // 2 as src_right,
   case when ref_id % 2 = 0 then '-' else '+' end as strand from ref_seq where ref_id % 7 <> 3
 union all select ref_id, length(seq) // 2, length(seq), ref_id % 25, 10, 10 + length(seq) - length(seq) // 2, '+' from ref_seq),
 m as (select row_id, count(*) as k, min(src_ref) as main_ref, min(case when strand = '+' then src_left + n_left - trg_left else src_right - (n_right - trg_left) end) as l, min(strand) as strand
   from forms join longer on trg_ref = ref_id where n_left >= trg_left and n_right <= trg_right group by row_id),
 g as (select n.*, k, main_ref, l, strand, case when category = 3 then {rot3} when category = 2 then {rot2} else original end as text from forms n left join m on n.row_id = m.row_id)
""".format(rot3=D.rot_left_sql("original", "n_right - n_left - length_change"), rot2=D.rot_left_sql("original", "n_right - n_left"))


@query(D.with_ctes(["norm"], LONG + f""" select row_id as item_id, case when k = 1 then main_ref end as main_ref, case when k = 1 then l end as main_left,
  case when k = 1 then l + n_right - n_left end as main_right, case when k = 1 then category end::bigint as category, case when k = 1 then length_change end::bigint as length_change,
  case when k = 1 then {_turned_sql('inserted').format('inserted')} end as inserted, case when k = 1 then {_turned_sql('text').format('original')} end as original,
  case when k is null then 'NoAlignment' when k > 1 then 'AmbiguousAlignment' end as error from g"""))
def j1_map_normal_forms(spark, d):
    """Normal forms through blocks on both strands, turned and rotated on '-'."""
    n, half = F.length("seq").cast("long"), F.floor(F.length("seq") / 2)
    r = D.ref_seq(spark, d)
    src = (F.col("ref_id") % 25).alias("src_ref")
    first = r.where("ref_id % 7 <> 3").select(F.col("ref_id").alias("trg_ref"), F.lit(0).cast("long").alias("trg_left"), half.alias("trg_right"), src, F.lit(70000).cast("long").alias("src_left"),
                                              (half + 70000).alias("src_right"), F.when(F.col("ref_id") % 2 == 0, "-").otherwise("+").alias("strand"))
    second = r.select(F.col("ref_id").alias("trg_ref"), half.alias("trg_left"), n.alias("trg_right"), src, F.lit(10).cast("long").alias("src_left"), (n - half + 10).alias("src_right"), F.lit("+").alias("strand"))
    forms = normal(spark, d).where("error is null").withColumnRenamed("row_id", "item_id")
    got = liftover.normal_to_main(forms, first.unionByName(second))
    return got.withColumn("category", F.col("category").cast("long"))


MAIN = """, items as (select s_suppkey as item_id, s_suppkey % 25 as src_ref, 1100 + s_suppkey % 500 as "left", 1100 + s_suppkey % 500 + 2 as "right", 'AC' as alt from supplier),
 m as (select item_id, trg_ref, case when strand = '+' then trg_left + "left" - src_left else trg_right - ("right" - src_left) end as t_left, strand,
   count(*) over (partition by item_id, trg_ref) as k from items join perfect using (src_ref) where "left" >= src_left and "right" <= src_right)"""


def _main_items(spark, d):
    a = 1100 + F.col("s_suppkey") % 500
    return D.table(spark, d, "supplier").select(F.col("s_suppkey").alias("item_id"), (F.col("s_suppkey") % 25).alias("src_ref"), a.alias("left"), (a + 2).alias("right"), F.lit("AC").alias("alt"))


@query(D.with_ctes(["perfect"], MAIN + " select item_id, trg_ref, t_left, t_left + 2 as t_right, case when strand = '-' then 'GT' else 'AC' end as t_alt, strand from m where k = 1"))
def j2_map_from_main_genome(spark, d):
    return liftover.map_from_main(_main_items(spark, d), D.align_blocks(spark, d))


@query(D.with_ctes(["perfect"], MAIN + """ , o as (select item_id, count(*) as c, min(trg_ref) as trg_ref, min(t_left) as t_left from m where k = 1 and trg_ref % 40 = 1 group by item_id)
 select i.item_id, case when c = 1 then trg_ref end as trg_ref, case when c = 1 then t_left end as t_left, case when c is null then 'NoAlignment' when c > 1 then 'AmbiguousAlignment' end as error
 from items i left join o on i.item_id = o.item_id"""))
def j3_lift_to_build(spark, d):
    builds = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("ref_id"), F.when(F.col("o_orderkey") % 40 == 1, "GRCh37").otherwise("GRCh38").alias("build"))
    return liftover.lift_to_build(_main_items(spark, d), D.align_blocks(spark, d), builds, "GRCh37")


@query(D.with_ctes(["exons"], """, p as (select o_orderkey as point_id, o_orderkey as transcript, o_custkey % 90 as pos, o_custkey % 2 = 1 as neg, o_custkey % 7 as off from orders),
 m as (select point_id, case when neg then u_left + pos - s_left - off else u_left + pos - s_left + off end as u, case when neg then -n else n end as side
  from p join exons using (transcript) where pos between s_left and s_right)
 select point_id, arg_min(u, side)::bigint as u from m group by point_id"""))
def j4_to_unspliced(spark, d):
    p = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("point_id"), F.col("o_orderkey").alias("transcript"), (F.col("o_custkey") % 90).alias("pos"),
                                           (F.col("o_custkey") % 2 == 1).alias("neg"), (F.col("o_custkey") % 7).alias("off"))
    return liftover.to_unspliced(p, exons(spark, d))


@query(D.with_ctes(["exons"], """, p as (select o_orderkey as point_id, o_orderkey as transcript, o_custkey % 150 as u from orders),
 e as (select *, lead(u_left) over (partition by transcript order by n) as nu from exons),
 m as (select *, u >= u_left and u < u_right as inside, nu - u <= u - u_right as later from p join e using (transcript) where (u >= u_left and u < u_right) or (u >= u_right and u < nu))
 select point_id, (case when inside then s_left + u - u_left else s_right end)::bigint as pos, not inside and later as neg,
 (case when inside then 0 when later then nu - u else u - u_right end)::bigint as off from m"""))
def j5_to_spliced(spark, d):
    p = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("point_id"), F.col("o_orderkey").alias("transcript"), (F.col("o_custkey") % 150).alias("u"), F.lit(False).alias("is_end"))
    return liftover.to_spliced(p, exons(spark, d))


@query(D.with_ctes(["perfect"], ITEMS + """ , m as (select item_id, src_ref, case when strand = '+' then src_left + "left" - trg_left else src_right - ("right" - trg_left) end as l, "right" - "left" as w
   from items join perfect using (trg_ref) where "left" >= trg_left and "right" <= trg_right),
 o as (select item_id, min(src_ref) as src_ref, min(l) as l, min(w) as w from m group by item_id having count(*) = 1),
 f as (select item_id, trg_ref, case when strand = '+' then trg_left + l - src_left else trg_right - (l + w - src_left) end as t, w, count(*) over (partition by item_id, trg_ref) as k
   from o join perfect using (src_ref) where l >= src_left and l + w <= src_right)
 select item_id as region_id, case when trg_ref % 2 = 0 then 'GRCh37' else 'GRCh38' end as build, count(*) as n_refs, min(t) as min_left, max(t + w) as max_right from f where k = 1 group by all"""))
def j6_coordinate_transform(spark, d):
    builds = D.table(spark, d, "orders").select(F.col("o_orderkey").alias("ref_id"), F.when(F.col("o_orderkey") % 2 == 0, "GRCh37").otherwise("GRCh38").alias("build"))
    ask = _items(spark, d).withColumnRenamed("item_id", "region_id")
    return liftover.coordinate_transform(ask, D.align_blocks(spark, d), builds)


@query(D.with_ctes(["regions"], """, a as (select *, max("right") over (partition by chrom order by "left", "right" rows between unbounded preceding and 1 preceding) as far from regions),
 b as (select *, sum(case when far is null or "left" > far then 1 else 0 end) over (partition by chrom order by "left", "right" rows unbounded preceding) as isle from a)
 select chrom, min("left") as "left", max("right") as "right" from b group by chrom, isle"""))
def j7_gene_regions(spark, d):
    return intervals.merge_intervals(D.regions(spark, d), ["chrom"])


@query(D.with_ctes(["exons"], "select transcript, n, s_left, s_right from exons where transcript in (select o_orderkey from orders where o_custkey % 3 = 0)"))
def j8_exons(spark, d):
    want = D.table(spark, d, "orders").where("o_custkey % 3 = 0").select(F.col("o_orderkey").alias("transcript"))
    return liftover.exons_of(exons(spark, d), want).select("transcript", "n", "s_left", "s_right")
