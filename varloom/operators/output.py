"""Field masks, nested documents and external records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LAYOUTS = ("none", "default", "all")
HIDDEN = {"externalSources"}


def parse_mask(spec: str, fields: list[str]) -> list[str]:
    """The dotted paths a mask leaves: a base layout, then +path and -path in order.

    `default` is all but the external sources.
    """
    words = spec.split()
    base = words[0] if words and words[0] in LAYOUTS else "default"
    rest = words[1:] if words and words[0] in LAYOUTS else words
    on = {"none": set(), "all": set(fields), "default": {f for f in fields if f.split(".")[0] not in HIDDEN}}[base]
    for w in rest:
        if w[:1] not in "+-" or len(w) < 2:
            raise ValueError(f"mask word {w!r}")
        hit = {f for f in fields if f == w[1:] or f.startswith(w[1:] + ".")}
        if not hit:
            raise ValueError(f"no field {w[1:]!r}")
        on = on | hit if w[0] == "+" else on - hit
    return [f for f in fields if f in on]


def field_mask(docs: DataFrame, spec: str) -> DataFrame:
    """docs with the columns and struct fields that the mask leaves; dropped ones are not computed."""
    from pyspark.sql.types import StructType

    def leaves(schema, prefix=""):
        for f in schema.fields:
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, f"{prefix}{f.name}.")
            else:
                yield prefix + f.name

    paths = parse_mask(spec, list(leaves(docs.schema)))

    def build(prefix: str, names: list[str]) -> list[Column]:
        out, seen = [], []
        for n in names:
            head = n.split(".")[0]
            if head in seen:
                continue
            seen.append(head)
            below = [x.split(".", 1)[1] for x in names if x.startswith(head + ".")]
            full = f"{prefix}{head}"
            out.append(F.struct(*build(full + ".", below)).alias(head) if below else F.col(full).alias(head))
        return out

    return docs.select(*build("", paths))


def needs(spec: str, fields: list[str], section: str) -> bool:
    """Whether a mask leaves anything of a section: if not, the section's join can be left out."""
    return any(f.split(".")[0] == section for f in parse_mask(spec, fields))


def drop_empty(x: Column) -> Column:
    """Null for an empty array: to_json leaves nulls out."""
    return F.when(F.size(x) > 0, x)


def canonical_name(ca_id: Column, prefix: str = "CA") -> Column:
    text = ca_id.cast("string")
    return F.concat(F.lit(prefix), F.lpad(text, F.greatest(F.lit(6), F.length(text)), "0"))


def external_record(id_type: Column, ident: Column, attrs: Column) -> Column:
    """The link of a foreign id. The public sites' address forms."""
    i = ident.cast("string")
    return F.when(id_type == "dbSNP", F.concat(F.lit("http://www.ncbi.nlm.nih.gov/snp/"), i)) \
        .when(id_type == "ClinVarAllele", F.concat(F.lit("http://www.ncbi.nlm.nih.gov/clinvar/?term="), i, F.lit("[alleleid]"))) \
        .when(id_type == "ClinVarVariant", F.concat(F.lit("http://www.ncbi.nlm.nih.gov/clinvar/variation/"), i)) \
        .when((id_type == "COSMIC") & attrs.contains("active"), F.concat(
            F.lit("http://cancer.sanger.ac.uk/cosmic/"), F.when(attrs.contains("noncoding"), "ncv").otherwise("mutation"),
            F.lit("/overview?id="), i)) \
        .when(id_type == "MyVariantInfo_hg19", F.concat(F.lit("http://myvariant.info/v1/variant/"), attrs, F.lit("?assembly=hg19"))) \
        .when(id_type == "MyVariantInfo_hg38", F.concat(F.lit("http://myvariant.info/v1/variant/"), attrs, F.lit("?assembly=hg38"))) \
        .when(id_type == "ExAC", F.concat(F.lit("http://exac.broadinstitute.org/variant/"), attrs)) \
        .when(id_type == "gnomAD", F.concat(F.lit("http://gnomad.broadinstitute.org/variant/"), attrs))


def rcv_name(ident: Column) -> Column:
    return F.concat(F.lit("RCV"), F.lpad(ident.cast("string"), 9, "0"))


def expand_variants(variants: DataFrame, placed: DataFrame, refs: DataFrame) -> DataFrame:
    """variants with arrays of their places by class of reference: genomes, gene regions, transcripts.

    placed(variant_key, ref_id, hgvs), refs(ref_id, kind) with kind genome, gene or transcript.
    """
    rows = placed.join(refs, "ref_id")
    pick = lambda k, name: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("ref_id", "hgvs")))).alias(name)
    one = rows.groupBy("variant_key").agg(pick("genome", "genomic"), pick("gene", "geneRegions"), pick("transcript", "transcripts"))
    return variants.join(one, "variant_key", "left")


def expand_protein_variants(proteins: DataFrame, matches: DataFrame) -> DataFrame:
    """proteins(protein, variant_key, hgvs) with the transcript combinations that explain each, grouped by protein once."""
    one = matches.groupBy("protein", "variant_key").agg(F.array_sort(F.collect_list("combination")).alias("matchingTranscripts"))
    return proteins.join(one, ["protein", "variant_key"], "left")


def attach_links(docs: DataFrame, rendered: DataFrame) -> DataFrame:
    """docs(ca_id, ...) with externalSources: their rendered links by source."""
    one = rendered.groupBy("ca_id").agg(F.array_sort(F.collect_list(F.struct("src_id", "at_id", "gui_label", "gui_url"))).alias("externalSources"))
    return docs.join(one, "ca_id", "left")


def variant_document(df: DataFrame) -> DataFrame:
    """(ca_id, json) of (ca_id, ref_id, n_left, n_right, inserted, original, ids array<struct<id_type,id>>)."""
    body = F.struct(
        F.concat(F.lit("/allele/"), canonical_name(F.col("ca_id"))).alias("@id"), F.lit("nucleotide").alias("type"),
        F.array(F.struct(F.col("ref_id").cast("string").alias("referenceSequence"), F.array(F.struct(
            F.col("n_left").alias("start"), F.col("n_right").alias("end"), F.col("inserted").alias("allele"),
            F.col("original").alias("referenceAllele"))).alias("coordinates"))).alias("genomicAlleles"),
        drop_empty(F.col("ids")).alias("externalRecords"))
    return df.select("ca_id", F.to_json(body).alias("json"))


def vr_allele(df: DataFrame) -> DataFrame:
    """(ca_id, json, digest) of single changes: location and state with truncated SHA-512 digests."""
    from .references import truncated_digest

    interval = F.struct(F.col("n_right").alias("end"), F.col("n_left").alias("start"), F.lit("SimpleInterval").alias("type"))
    loc = F.to_json(F.struct(interval.alias("interval"), F.concat(F.lit("ref."), F.col("ref_id").cast("string")).alias("sequence_id"), F.lit("SequenceLocation").alias("type")))
    rows = df.withColumn("loc_digest", truncated_digest(loc))
    allele = F.to_json(F.struct(F.col("loc_digest").alias("location"), F.struct(
        F.col("inserted").alias("sequence"), F.lit("SequenceState").alias("type")).alias("state"), F.lit("Allele").alias("type")))
    return rows.select("ca_id", allele.alias("json"), F.concat(F.lit("ga4gh:VA."), truncated_digest(allele)).alias("digest"))


def observed(df: DataFrame, name: str, text: str):
    """df and an observation of its rows and the bytes of a text column, made while it runs."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("documents"), F.sum(F.octet_length(text)).alias("bytes")), seen


def paginate(df: DataFrame, order: list, skip: int, limit: int | None) -> DataFrame:
    """Rows skip .. skip+limit of a total order."""
    out = df.orderBy(*order).offset(skip)
    return out if limit is None else out.limit(limit)


def restore_order(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    return df.orderBy(row_id)


def set_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b, a.columns, "left_anti")


def set_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.distinct().join(b, a.columns, "left_semi")


def union_all(genomic: DataFrame, protein: DataFrame) -> DataFrame:
    """Genomic rows, then protein rows: `kind_order` keeps the order for a later sort."""
    return genomic.withColumn("kind_order", F.lit(0)).unionByName(protein.withColumn("kind_order", F.lit(1)))
