"""Readers and writers of the domain's text files. All parse whole files as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from varloom.operators.intervals import CHUNK, MARGIN
from varloom.session import saved

#: Columns a bulk file may declare, and which of them are lists. Fixed values.
BULK_COLUMNS = ("hgvs", "id", "dbSNP.rs", "ClinVar.alleleId", "ClinVar.variationId", "ClinVar.preferredName", "ClinVar.RCV",
                "MyVariantInfo_hg19.id", "MyVariantInfo_hg38.id", "ExAC.id", "gnomAD.id", "COSMIC.id")
KEY_COLUMNS = ("hgvs", "id", "MyVariantInfo_hg19.id", "MyVariantInfo_hg38.id", "ExAC.id", "gnomAD.id")


def _from(values: Column, at: int) -> Column:
    """The elements from place `at` (1: the first) on."""
    return F.slice(values, F.lit(at), F.size(values))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): a line's number grows within each file."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), F.regexp_replace("value", "\r$", "").alias("value"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq): '>' begins a record, its first word is the name; comments and blanks go."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "^>", "").alias("v")).where(F.trim("v") != "")
    head = F.split_part("v", F.lit("\n"), F.lit(1))
    body = F.concat(F.lit("\n"), F.expr("substring(v, length(split_part(v, '\n', 1)) + 1)"))
    return rows.select(F.regexp_extract(head, r"^\s*(\S+)", 1).alias("name"), F.upper(F.regexp_replace(
        F.regexp_replace(body, r"\n#[^\n]*", "\n"), r"\s+", "")).alias("seq"))


def fasta_chunks(spark: SparkSession, path: str, size: int = CHUNK, margin: int = MARGIN) -> DataFrame:
    """(ref_id, chunk_no, ctx_left, ctx, ref_len) as intervals.ref_chunks gives them, straight from the lines; ref_id is the record's name.

    Files are read in splits. Within a split a window carries the header on and adds up letters; across splits one row a split
    and record does. Each line's letters go to the chunks that they, or a chunk's margin, lie in, so no record is ever one row; the
    longest row is a line. Comments, blanks and lines before the first header go; names are those of one record each.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = rows.withColumn("line", F.monotonically_increasing_id()).where(~F.col("value").startswith("#") & (F.trim(F.regexp_replace("value", r"\s+", "")) != ""))
    header = F.when(F.col("value").startswith(">"), F.struct("block", "line", F.regexp_extract("value", r"^>\s*(\S*)", 1).alias("name")))
    text = F.when(~F.col("value").startswith(">"), F.upper(F.regexp_replace("value", r"\s+", ""))).otherwise("")
    rows = rows.select("file", "block", "line", header.alias("header"), text.alias("text"))
    in_split = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("record", F.last("header", True).over(in_split))
    splits = rows.groupBy("file", "block").agg(F.max("header").alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = splits.select("file", "block", F.last("last", True).over(before).alias("carried"))
    rows = rows.join(carried, ["file", "block"]).withColumn("record", F.coalesce("record", "carried")).where(F.col("record").isNotNull())
    rows = saved(rows.select("file", "block", "line", "record", "text"), "fasta-lines")
    sums = rows.groupBy("file", "record", "block").agg(F.sum(F.length("text")).alias("n"))
    over = Window.partitionBy("file", "record").orderBy("block")
    sums = sums.select("file", "record", "block", F.coalesce(F.sum("n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    lengths = rows.groupBy("file", "record").agg(F.sum(F.length("text")).alias("ref_len"))
    own = Window.partitionBy("file", "record", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(F.length("text")).over(own), F.lit(0))).join(sums, ["file", "record", "block"]).withColumn("at", F.col("at") + F.col("start"))
    end = F.col("at") + F.length("text")
    first, last = F.floor(F.greatest(F.col("at") - margin, F.lit(0)) / size), F.floor((end - 1 + margin) / size)
    parts = rows.where("text <> ''").select("file", "record", "at", "text", F.explode(F.sequence(first, last)).alias("chunk_no"))
    a = F.greatest(F.col("at"), F.col("chunk_no") * size - margin)
    b = F.least(F.col("at") + F.length("text"), (F.col("chunk_no") + 1) * size + margin)
    parts = parts.where(a < b).select("file", "record", "chunk_no", F.struct(a.alias("at"), F.substring("text", (a - F.col("at") + 1).cast("int"), (b - a).cast("int")).alias("t")).alias("p"))
    texts = parts.groupBy("file", "record", "chunk_no").agg(F.array_sort(F.collect_list("p")).alias("p"))
    got = lengths.join(texts, ["file", "record"], "left").where(F.col("chunk_no").isNull() | (F.col("chunk_no") * size < F.col("ref_len")))
    zero = F.lit(0).cast("long")
    return got.select(F.col("record.name").alias("ref_id"), F.coalesce("chunk_no", zero).alias("chunk_no"), F.coalesce(F.col("p")[0]["at"], zero).alias("ctx_left"),
                      F.coalesce(F.array_join(F.transform("p", lambda x: x["t"]), ""), F.lit("")).alias("ctx"), "ref_len")


def read_align(spark: SparkSession, path: str) -> DataFrame:
    """(name, idx, unaligned, ref, strand, offset, cigar, seqs, trg_start): '>' lines name what follows.

    One task reads one file; the running target position comes from a window per name.
    """
    rows = spark.read.text(path, wholetext=True)
    parts = rows.select(F.explode(F.filter(F.split("value", r"(?m)^>"), lambda x: F.trim(x) != "")).alias("v"))
    recs = parts.select(F.regexp_extract("v", r"^\s*(\S+)", 1).alias("name"), F.posexplode(F.filter(
        F.transform(_from(F.split("v", "\r?\n"), 2), lambda s: F.regexp_replace(s, "#.*$", "")), lambda s: F.trim(s) != "")).alias("idx", "s"))
    f = F.split("s", "[\t ]", -1)
    recs = recs.select("name", F.col("idx").try_cast("long").alias("idx"), F.get(f, F.lit(0)).alias("unaligned"), F.get(f, F.lit(1)).alias("ref"), F.get(f, F.lit(2)).alias("strand"),
                       F.get(f, F.lit(3)).try_cast("long").alias("offset"), F.get(f, F.lit(4)).alias("cigar"),
                       F.filter(_from(f, 6), lambda x: x != "").alias("seqs"))
    total = lambda ops: F.aggregate(F.transform(F.regexp_extract_all("cigar", F.lit(f"([0-9]+)[{ops}]"), F.lit(1)), lambda x: x.try_cast("long")), F.lit(0).try_cast("long"), lambda a, x: a + x)
    w = Window.partitionBy("name").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    span = F.length("unaligned") + total("M=XI")
    return recs.withColumn("trg_start", F.coalesce(F.sum(span).over(w), F.lit(0)) + F.length("unaligned")).withColumn("src_span", total("M=XD"))


def bad_transcripts(align: DataFrame) -> DataFrame:
    """(name, problem): more than one reference or strand, exons out of order, or unaligned parts inside."""
    w = Window.partitionBy("name").orderBy("idx")
    plus = F.col("strand") == "+"
    rows = align.withColumn("end", F.when(plus, F.col("offset") + F.col("src_span")).otherwise(F.col("offset")))
    rows = rows.withColumn("prev", F.when(plus, F.lag("end").over(w)).otherwise(F.lag("offset").over(w)))
    wrong = F.when(plus, F.col("offset") < F.col("prev")).otherwise(F.col("offset") + F.col("src_span") > F.col("prev"))
    one = rows.groupBy("name").agg(F.countDistinct("ref").alias("refs"), F.countDistinct("strand").alias("strands"), F.max(wrong.try_cast("int")).alias("order"),
                                   F.max(F.when((F.col("idx") > 0) & (F.col("unaligned") != ""), 1).otherwise(0)).alias("inside"))
    return one.select("name", F.when(F.col("refs") > 1, "references").when(F.col("strands") > 1, "strands").when(F.col("order") == 1, "order")
                      .when(F.col("inside") == 1, "unaligned inside").alias("problem")).where("problem is not null")


def _tsv(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
    return df.toDF(*[c.strip('"') for c in df.columns])


def read_genes(spark: SparkSession, path: str) -> DataFrame:
    """(hgnc_id, symbol, name, active, aliases, entrez_id, ensembl_id)."""
    df, c = _tsv(spark, path), F.col
    listed = lambda x: F.filter(F.transform(F.split(F.coalesce(c(f"`{x}`"), F.lit("")), ","), lambda v: F.trim(v)), lambda v: v != "")
    gone = c("`Approved Symbol`").endswith("~withdrawn")
    return df.select(F.regexp_extract("HGNC ID", "([0-9]+)$", 1).try_cast("long").alias("hgnc_id"), F.regexp_replace("Approved Symbol", "~withdrawn$", "").alias("symbol"),
                     c("`Approved Name`").alias("name"), (~gone).alias("active"), F.array_distinct(F.concat(
                         listed("Previous Symbols"), listed("Synonyms"), F.filter(F.array(c("`Ensembl Gene ID`"), c("`Entrez Gene ID`")), lambda v: v.isNotNull()))).alias("aliases"),
                     c("`Entrez Gene ID`").try_cast("long").alias("entrez_id"), c("`Ensembl Gene ID`").alias("ensembl_id"))


def read_mane(spark: SparkSession, path: str) -> DataFrame:
    """(hgnc_id, refseq, ensembl): the last row of an id wins."""
    df = _tsv(spark, path).withColumn("n", F.monotonically_increasing_id())
    return df.groupBy(F.regexp_replace("HGNC_ID", "^HGNC:", "").try_cast("long").alias("hgnc_id")).agg(
        F.max_by("RefSeq", "n").alias("refseq"), F.max_by("Ensembl_ID", "n").alias("ensembl"))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path).select(F.col("`#Sequence`").alias("name"), F.col("TRUNC512").alias("digest")).distinct()


def read_ref_names(spark: SparkSession, path: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alias, ref_id) of rows that match one known(name, ref_id), and the rejected ids that match several."""
    # Numbers are padded, never cut: a cut one would be another record's.
    df = _tsv(spark, path).withColumn("rs", F.concat(F.lit("RS"), F.lpad("Id", F.greatest(F.length("Id"), F.lit(6)), F.lit("0"))))
    rows = df.select("rs", F.explode(F.array("rs", "RefSeq", "GenBank", "ENSEMBL", "LRG")).alias("alias")).where(F.length("alias") > 0)
    met = rows.join(known.withColumnRenamed("name", "alias"), "alias").groupBy("rs").agg(F.countDistinct("ref_id").alias("n"), F.min("ref_id").alias("ref_id"))
    return rows.join(met.where("n = 1").select("rs", "ref_id"), "rs").select("alias", "ref_id"), met.where("n > 1").select("rs")


def read_transcript_meta(spark: SparkSession, path: str, known: DataFrame, genes: DataFrame) -> DataFrame:
    """(ref_id, reference, gene, cds_left, cds_right, protein, frame_offset) of known references; genes by Entrez id only."""
    df = _tsv(spark, path)
    opt = lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string")
    rows = df.select(F.col("Reference").alias("name"), F.col("Gene").try_cast("long").alias("entrez_id"), F.col("CDSleft").try_cast("long").alias("cds_left"),
                     F.col("CDSright").try_cast("long").alias("cds_right"), opt("Protein").alias("protein"), F.coalesce(opt("Frameshift").try_cast("int"), F.lit(0)).alias("frame_offset"))
    return rows.join(known, "name").join(genes.select("entrez_id", "hgnc_id"), "entrez_id", "left")


def parse_bulk_spec(spec: str) -> list[str | None]:
    """The columns of a bulk file; an empty word ignores one. Unknown and repeated names, and files without key, are errors."""
    out: list[str | None] = []
    for w in spec.split("+"):
        if w and w not in BULK_COLUMNS and not (w.startswith("externalSource.") and len(w) > 15):
            raise ValueError(f"unknown column {w!r}")
        if w and w in out:
            raise ValueError(f"column {w!r} twice")
        out.append(w or None)
    if not any(w in KEY_COLUMNS for w in out):
        raise ValueError("no column gives a definition or an id")
    return out


def read_variant_tsv(spark: SparkSession, path: str, spec: str) -> DataFrame:
    """(line, value, columns..., error): declared columns by their names, dots as underscores."""
    cols = parse_bulk_spec(spec)
    f = F.split("value", "\t", -1)
    rows = read_lines(spark, path).where("value <> ''")
    wrong = F.when(F.size(f) != len(cols), "IncorrectNumberOfColumns")
    return rows.select("line", "value", *[F.when(wrong.isNull(), F.nullif(F.get(f, F.lit(i)), F.lit(""))).alias(c.replace(".", "_"))
                                          for i, c in enumerate(cols) if c], wrong.alias("error"))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(line, text, chrom, accession, assembly, left, right, ref, alt, alt_no, ids): one row an alternative.

    The header's contigs name accessions; it is a few lines and comes from the same files.
    """
    rows = read_lines(spark, path)
    head = rows.where(F.col("value").startswith("##"))
    contig = head.where(F.col("value").startswith("##contig=")).select(
        F.regexp_extract("value", r"[<,]ID=([^,>]+)", 1).alias("chrom"), F.nullif(F.regexp_extract("value", r"[<,]assembly=([^,>]+)", 1), F.lit("")).alias("accession"))
    assembly = head.where(F.col("value").startswith("##assembly=")).select(F.regexp_extract("value", "^##assembly=(.*)$", 1).alias("assembly")).limit(1)
    return explode_vcf(rows).join(contig.dropDuplicates(["chrom"]), "chrom", "left").join(
        assembly.withColumn("one", F.lit(1)), F.col("one") == F.lit(1), "left").drop("one")


def explode_vcf(rows: DataFrame) -> DataFrame:
    """Body lines (line, value) -> a row an alternative; '.' stands for the reference; positions from 0."""
    f = F.split("value", "\t")
    body = rows.where(~F.col("value").startswith("#") & (F.col("value") != ""))
    got = body.select("line", F.col("value").alias("text"), F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).try_cast("long").alias("pos"), F.get(f, F.lit(2)).alias("ids"),
                      F.upper(F.get(f, F.lit(3))).alias("ref"), F.posexplode(F.split(F.upper(F.get(f, F.lit(4))), ",")).alias("alt_no", "a"))
    return got.select("line", "text", "chrom", (F.col("pos") - 1).alias("left"), (F.col("pos") - 1 + F.length("ref")).alias("right"), "ref",
                      F.when(F.col("a") == ".", F.col("ref")).otherwise(F.col("a")).alias("alt"), "alt_no", "ids")


def read_vcf_simple(spark: SparkSession, path: str, assembly: str) -> DataFrame:
    """(line, text, chrom, assembly, left, right, ref, alt, ids, error): one alternative of ACGT only, other rows are errors."""
    rows = explode_vcf(read_lines(spark, path))
    n = F.size(F.split(F.get(F.split("text", "\t"), F.lit(4)), ","))
    bad = F.when(n > 1, "MultiAllelic").when(~F.col("ref").rlike("^[ACGT]+$") | ~F.col("alt").rlike("^[ACGT]+$"), "IncorrectSequence")
    return rows.where("alt_no = 0").withColumn("assembly", F.lit(assembly)).withColumn("error", bad).drop("alt_no")


def parse_vcf_lines(lines: DataFrame) -> DataFrame:
    """(line, chrom, left, right, ref, alt, error) of the body lines of (line, text), strictly: one alternative, in capitals.

    chrom is a number (X 23, Y 24, M 25), with or without `chr`; '.' as alternative stands for the reference. What can't be read has error
    VcfParsingError: missing columns, other chromosomes or letters, several alternatives. Header lines (`#`), empty and null ones give no row.
    """
    f = F.split("text", "\t", -1)
    body = lines.where(~F.col("text").startswith("#") & (F.col("text") != "")).select("line", f.alias("f"))
    field = lambda i: F.coalesce(F.get("f", F.lit(i)), F.lit(""))
    name = F.regexp_extract(field(0), "^(?:chr)?([0-9]{1,2}|X|Y|M|MT)$", 1)
    chrom = F.when(name == "X", 23).when(name == "Y", 24).when(name.isin("M", "MT"), 25).otherwise(F.when(name.try_cast("int").between(1, 22), name.try_cast("int")))
    alt = F.when(field(4) == ".", field(3)).otherwise(field(4))
    pos = F.when(field(1).rlike("^[0-9]{1,10}$"), field(1).try_cast("long"))
    ok = chrom.isNotNull() & pos.isNotNull() & (field(2) != "") & field(3).rlike("^[ACGT]+$") & alt.rlike("^[ACGT]+$")
    keep = lambda x: F.when(ok, x)
    return body.select("line", keep(chrom).alias("chrom"), keep(pos - 1).alias("left"), keep(pos - 1 + F.length(field(3))).alias("right"), keep(field(3)).alias("ref"),
                       keep(alt).alias("alt"), F.when(~ok, "VcfParsingError").alias("error"))


def with_new_vcf_ids(lines: DataFrame, new: DataFrame) -> DataFrame:
    """(line, text, error) of lines(line, text): ids of new(line, new array<string>, error) appended to the ID column, a dot replaced.

    Ids that stand there, apart by commas or semicolons, are left as they are and not repeated. Lines without new ids do not change.
    """
    got = lines.join(new, "line", "left")
    f = F.split("text", "\t", -1)
    old = F.get(f, F.lit(2))
    more = F.array_except("new", F.split(old, "[,;]"))
    joined = F.concat_ws(",", F.when(old != ".", old), F.when(F.size(more) > 0, F.array_join(more, ",")))
    text = F.array_join(F.concat(F.slice(f, 1, 2), F.array(joined), _from(f, 4)), "\t")
    return got.select("line", F.when(F.size("new") > 0, text).otherwise(F.col("text")).alias("text"), "error")


def merged_ids(old: Column, new: Column) -> Column:
    """A VCF ID field with new ids behind the kept ones, each once; '.' when there is none."""
    kept = F.filter(F.split(old, "[,;]"), lambda x: (x != ".") & (x != ""))
    got = F.array_distinct(F.concat(kept, F.coalesce(new, F.array().cast("array<string>"))))
    return F.when(F.size(got) == 0, ".").otherwise(F.array_join(got, ","))


def with_vcf_ids(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """(line, text) with the ID column rewritten from ids(line, new array<string>)."""
    f = F.split("text", "\t", -1)
    got = lines.join(ids, "line", "left")
    text = F.array_join(F.concat(F.slice(f, 1, 2), F.array(merged_ids(F.get(f, F.lit(2)), F.col("new"))), _from(f, 4)), "\t")
    return got.select("line", text.alias("text"))


def write_lines(df: DataFrame, path: str, order: str = "line") -> None:
    """Text files in the order of a column, over range partitions."""
    df.repartitionByRange(order).sortWithinPartitions(order).select("text").write.text(path)


def write_json(docs: DataFrame, path: str) -> None:
    docs.write.json(path)


def tsv_rows(docs: DataFrame) -> DataFrame:
    """`hgvs<TAB>id` lines, or ERROR, type and message."""
    return docs.select("line", F.when(F.col("error").isNull(), F.concat_ws("\t", "hgvs", "ident")).otherwise(
        F.concat_ws("\t", F.lit("ERROR"), F.col("error.type"), F.col("error.message"))).alias("text"))


def explode_vcf_ids(vcf: DataFrame) -> DataFrame:
    """chr-pos-ref-alt of every alternative."""
    return vcf.select("line", "alt_no", F.concat_ws("-", "chrom", (F.col("left") + 1).cast("string"), "ref", "alt").alias("id"))
