"""Domain tables derived from the driver's tables, the same way in Spark and in SQL.

Each table has a function that gives the DataFrame and a text with the DuckDB SQL of its common
table expression; `with_ctes` puts the needed ones in front of a query.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.operators.intervals import ref_chunks
from varloom.session import stored

LETTERS, BASES = "BDEFHIJKLMNOPQRSUVWXYZ", "CATGCATGCATGCATGCATGCA"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key():
    """A line's key; line numbers repeat within an order, so part and supplier take part."""
    return F.expr("((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000")


def ref_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref_id, seq): every document's letters as nucleotides."""
    letters = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ref_id"), F.translate(letters, LETTERS, BASES).alias("seq"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those sequences as a chunk table: derived once a session, as a standing table would be."""
    return stored(spark, "chunks", sf_dir, lambda: ref_chunks(ref_seq(spark, sf_dir)))


def raw_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, ref_id, left, right, ref, alt): plain changes on those sequences; derived once a session."""
    return stored(spark, "plain", sf_dir, lambda: fresh_variants(spark, sf_dir))


def chromosome_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same kinds of changes, all of them on the texts 1 to 22, which stand for chromosomes."""
    return fresh_variants(spark, sf_dir, F.col("l_partkey") % 22 + 1)


def fresh_variants(spark: SparkSession, sf_dir: str, pick=None) -> DataFrame:
    """raw_variants, not written."""
    seqs = ref_seq(spark, sf_dir).withColumn("n", F.length("seq")).where(F.col("n") >= 32)
    lines = table(spark, sf_dir, "lineitem")
    if pick is None:
        pick = F.col("l_partkey") % table(spark, sf_dir, "documents").count()
        rows = lines.withColumn("ref_id", pick).repartition("ref_id").join(seqs, "ref_id")
    else:
        # 22 texts at most: dealt by text, lines of any number would lie in 22 tasks.
        rows = lines.repartition("l_orderkey").withColumn("ref_id", pick).join(F.broadcast(seqs.where("ref_id between 1 and 22")), "ref_id")
    pos = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % (F.col("n") - 12)
    k = F.col("l_linenumber") % 4
    return rows.select(
        row_key().alias("row_id"), "ref_id", pos.alias("left"),
        (pos + k).alias("right"), F.substring("seq", (pos + 1).cast("int"), k).alias("ref"),
        F.substring("seq", (F.col("l_orderkey") % (F.col("n") - 12) + 1).cast("int"), (F.col("l_suppkey") % 4).cast("int")).alias("alt"))


def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, id_type, id): three foreign ids a line."""
    li = table(spark, sf_dir, "lineitem")
    row = row_key().alias("row_id")
    return li.select(row, F.expr(
        "stack(3, 'dbSNP', l_orderkey, 'ClinVarAllele', l_partkey, 'ClinVarVariant', l_suppkey) as (id_type, id)"))


def identifier_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(row_id, ids array<struct<id_type,id,attrs>>): those identifiers, a row a line."""
    one = lambda kind, c: F.struct(F.lit(kind).alias("id_type"), F.col(c).alias("id"), F.lit(None).cast("string").alias("attrs"))
    named = F.array(one("dbSNP", "l_orderkey"), one("ClinVarAllele", "l_partkey"), one("ClinVarVariant", "l_suppkey"))
    return table(spark, sf_dir, "lineitem").select(row_key().alias("row_id"), named.alias("ids"))


def exon_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(transcript, n, len, intron): exons of an order's lines, and the intron after each."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("transcript"), F.expr("(cast(l_linenumber as bigint) * 100000 + l_partkey) * 1000 + l_suppkey % 1000").alias("n"),
        F.col("l_quantity").cast("long").alias("len"), (20 + F.col("l_linenumber")).cast("long").alias("intron"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(region_id, chrom, left, right): one interval an order on 25 chromosomes."""
    left = F.col("o_orderkey") * 13 % 100000
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("region_id"), (F.col("o_custkey") % 25).alias("chrom"), left.alias("left"),
        (left + 1 + F.floor("o_totalprice") % 900).alias("right"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ca_id, src_id, params): links of an order to its line's supplier."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("ca_id"), F.col("l_suppkey").alias("src_id"),
        F.array(F.col("l_partkey").cast("string"), "l_returnflag").alias("params")).distinct()


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_id, src_name, url, param_types, gui_name, gui_label, gui_url): up to 249 suppliers."""
    return table(spark, sf_dir, "supplier").where("s_suppkey between 1 and 249").select(
        F.col("s_suppkey").alias("src_id"), F.col("s_name").alias("src_name"),
        F.lit("http://example.org/{id}/{p1_4}?f={p2}").alias("url"), F.lit("IS").alias("param_types"),
        F.concat(F.lit("Source "), "s_name").alias("gui_name"), F.lit("{p2}-{p1}").alias("gui_label"),
        F.lit("http://example.org/gui/{p1}").alias("gui_url"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_id, user_name): customers by nation."""
    return table(spark, sf_dir, "customer").select(
        (F.col("c_nationkey") % 249 + 1).cast("long").alias("src_id"), F.col("c_name").alias("user_name"))


def genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(hgnc_id, symbol, name, active, aliases): parts; those of size 1 count as withdrawn."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("hgnc_id"), F.concat(F.lit("G"), F.col("p_partkey").cast("string")).alias("symbol"),
        F.col("p_name").alias("name"), (F.col("p_size") != 1).alias("active"), F.split("p_name", " ").alias("aliases"))


def align_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(align_id, trg_ref, trg_left, trg_right, src_ref, src_left, src_right, strand, op): ungapped blocks, some of them with changed letters.

    Line i of an order lies at 100*i of its target and, by strand, at the same place or mirrored in
    its source.
    """
    a = F.col("l_linenumber").cast("long") * 100
    k = F.col("l_quantity").cast("long")
    strand = F.when(F.col("l_linestatus") == "O", "-").otherwise("+")
    s = F.when(F.col("l_linestatus") == "O", 5000 - a - k).otherwise(a + 1000)
    return table(spark, sf_dir, "lineitem").select(
        row_key().alias("align_id"), F.col("l_orderkey").alias("trg_ref"),
        a.alias("trg_left"), (a + k).alias("trg_right"), (F.col("l_partkey") % 25).alias("src_ref"),
        s.alias("src_left"), (s + k).alias("src_right"), strand.alias("strand"),
        F.when(F.col("l_suppkey") % 5 == 3, "X").otherwise("=").alias("op"))


def lcp_sql(a: str, b: str) -> str:
    return (f"coalesce(nullif(list_position(list_transform(list_zip(string_split({a}, ''), string_split({b}, '')), lambda p: p[1] = p[2]), "
            f"false), 0) - 1, least(length({a}), length({b})))")


def tile_sql(s: str, n: str) -> str:
    return f"substr(repeat({s}, ({n} // greatest(length({s}), 1) + 1)::int), 1, {n})"


def rot_left_sql(s: str, k: str) -> str:
    m = f"((({k}) % greatest(length({s}), 1) + greatest(length({s}), 1)) % greatest(length({s}), 1))"
    return f"(substr({s}, {m} + 1) || substr({s}, 1, {m}))"


def raw_sql(pick: str) -> str:
    """SQL of raw_variants, the text of a line chosen by `pick`."""
    return f"""select ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000 as row_id, ref_id, seq,
  (l_orderkey * 7 + l_linenumber) % (length(seq) - 12) as "left",
  (l_orderkey * 7 + l_linenumber) % (length(seq) - 12) + l_linenumber % 4 as "right",
  substr(seq, (l_orderkey * 7 + l_linenumber) % (length(seq) - 12) + 1, l_linenumber % 4) as ref,
  substr(seq, l_orderkey % (length(seq) - 12) + 1, l_suppkey % 4) as alt
  from lineitem join ref_seq on ref_id = {pick} where length(seq) >= 32"""


CTES = {
    "ref_seq": f"""select doc_id as ref_id,
  translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{LETTERS}', '{BASES}') as seq from documents""",
    "raw": raw_sql("l_partkey % (select count(*) from documents)"),
    "trim0": f"""select *, case when ref = alt then 0 else {lcp_sql('reverse(ref)', 'reverse(alt)')} end as suffix from raw""",
    "trim1": f"""select *, case when ref = alt then 0 else
  {lcp_sql('substr(ref, 1, length(ref) - suffix)', 'substr(alt, 1, length(alt) - suffix)')} end as prefix from trim0""",
    "trim": """select *, substr(ref, prefix + 1, length(ref) - suffix - prefix) as org2,
  substr(alt, prefix + 1, length(alt) - suffix - prefix) as alt2, "left" + prefix as l0, "right" - suffix as r0,
  case when ref = alt or (length(ref) - suffix - prefix > 0 and length(alt) - suffix - prefix > 0) then ''
  else substr(ref, prefix + 1, length(ref) - suffix - prefix) || substr(alt, prefix + 1, length(alt) - suffix - prefix) end as pattern
  from trim1""",
    "shift": f"""select *, case when pattern = '' then 0 else
  {lcp_sql('substr(seq, r0 + 1)', tile_sql('pattern', '(length(seq) - r0)'))} end as sr,
  case when pattern = '' then 0 else
  {lcp_sql('reverse(substr(seq, 1, l0))', tile_sql('reverse(pattern)', 'l0'))} end as sl from trim""",
    "cat": """select *, case when pattern = '' or sl + sr = 0 then 0 when length(alt2) > sl + sr then 1
  when length(alt2) > 0 then 2 else 3 end as category from shift""",
    "norm": f"""select row_id, ref_id, "left", "right", ref, alt, seq, l0 - sl as n_left, r0 + sr as n_right, category,
  case when category >= 2 then length(pattern) else 0 end as length_change,
  case category when 0 then alt2 when 1 then substr(alt2, sr + 1, length(alt2) - sl - sr) else '' end as inserted,
  case category when 0 then org2 when 1 then substr({rot_left_sql('pattern', '-sl')}, 1, sl + sr)
  else {rot_left_sql('pattern', '-sl')} end as original from cat""",
    "ids": """select ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000 as row_id, 'dbSNP' as id_type, l_orderkey as id from lineitem
  union all select ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000, 'ClinVarAllele', l_partkey from lineitem
  union all select ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000, 'ClinVarVariant', l_suppkey from lineitem""",
    "exon_lengths": """select l_orderkey as transcript, (l_linenumber::bigint * 100000 + l_partkey) * 1000 + l_suppkey % 1000 as n, l_quantity::bigint as len,
  20 + l_linenumber::bigint as intron from lineitem""",
    "exons": """select transcript, n, coalesce(sum(len + intron) over w, 0)::bigint as u_left,
  (coalesce(sum(len + intron) over w, 0) + len)::bigint as u_right, coalesce(sum(len) over w, 0)::bigint as s_left,
  (coalesce(sum(len) over w, 0) + len)::bigint as s_right from exon_lengths
  window w as (partition by transcript order by n rows between unbounded preceding and 1 preceding)""",
    "regions": """select o_orderkey as region_id, o_custkey % 25 as chrom, o_orderkey * 13 % 100000 as "left",
  o_orderkey * 13 % 100000 + 1 + floor(o_totalprice)::bigint % 900 as "right" from orders""",
    "links": """select distinct l_orderkey as ca_id, l_suppkey as src_id, [l_partkey::varchar, l_returnflag] as params from lineitem""",
    "genes": """select p_partkey as hgnc_id, 'G' || p_partkey as symbol, p_name as name, p_size <> 1 as active,
  string_split(p_name, ' ') as aliases from part""",
    "blocks": """select ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 1000 + l_suppkey % 1000 as align_id, l_orderkey as trg_ref, l_linenumber::bigint * 100 as trg_left,
  l_linenumber::bigint * 100 + l_quantity::bigint as trg_right, l_partkey % 25 as src_ref,
  case when l_linestatus = 'O' then 5000 - l_linenumber::bigint * 100 - l_quantity::bigint else l_linenumber::bigint * 100 + 1000 end as src_left,
  case when l_linestatus = 'O' then 5000 - l_linenumber::bigint * 100 else l_linenumber::bigint * 100 + 1000 + l_quantity::bigint end as src_right,
  case when l_linestatus = 'O' then '-' else '+' end as strand, case when l_suppkey % 5 = 3 then 'X' else '=' end as op from lineitem""",
    "perfect": "select * from blocks where op = '='",
}
NEEDS = {"raw": ["ref_seq"], "trim0": ["raw"], "trim1": ["trim0"], "trim": ["trim1"], "shift": ["trim"], "cat": ["shift"],
         "norm": ["cat"], "perfect": ["blocks"], "exons": ["exon_lengths"]}


def with_ctes(names: list[str], query: str, **other: str) -> str:
    """The query after WITH for the named tables and those they need; `other` gives texts of its own to some of them."""
    order: list[str] = []

    def visit(name: str) -> None:
        for other in NEEDS.get(name, []):
            visit(other)
        if name not in order:
            order.append(name)

    for n in names:
        visit(n)
    # A query that begins with a comma adds tables of its own.
    return "with " + ",\n".join(f"{n} as ({(CTES | other)[n]})" for n in order) + "\n" + query
