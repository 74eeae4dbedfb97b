"""Bulk registration from a file to text lines."""

from pyspark.sql import functions as F

from varloom.operators import intervals, registry
from varloom.plans import bulk
from varloom.sources import files

R = "ACGTTTGCACACAGGATCCAAA" + "G" * 8
SPEC = "hgvs+gnomAD.id+MyVariantInfo_hg19.id+id+dbSNP.rs+ClinVar.alleleId+ClinVar.preferredName++externalSource.S1"


def run(spark, tmp_path, lines, variants=None, known=None):
    path = tmp_path / f"in{len(list(tmp_path.iterdir()))}.tsv"
    path.write_text("".join("\t".join((line + [""] * 9)[:9] if len(line) != 3 else line) + "\n" for line in lines))
    refs = [("r1", 1, len(R), None, None), ("m1", 50, len(R), None, None), ("t1", 1, len(R), 3, 15)]
    names = spark.createDataFrame(refs, "ref_name string, ref_id long, length long, cds_left long, cds_right long")
    chunks = intervals.ref_chunks(spark.createDataFrame([(1, R), (50, R[::-1].translate(str.maketrans("ACGT", "TGCA")))], "ref_id long, seq string"))
    blocks = spark.createDataFrame([(50, 0, 20, 1, len(R) - 20, len(R), "-", "=")], "trg_ref long, trg_left long, trg_right long, src_ref long, src_left long, src_right long, strand string, op string")
    sources = spark.createDataFrame([(9, "S1", "IS")], "src_id long, src_name string, param_types string")
    none = spark.createDataFrame([], registry.TABLES["variants"]), spark.createDataFrame([], registry.TABLES["identifiers"])
    new, ids, links, answers = bulk.register_file(
        files.read_variant_tsv(spark, str(path), SPEC), names, spark.createDataFrame([("GRCh37", 1, 1)], "build string, chrom int, ref_id long"), chunks, blocks,
        variants or none[0], known or none[1], spark.createDataFrame([], "ca_id long, src_id long, params array<string>"), sources)
    text = [r.text for r in files.tsv_rows(answers).orderBy("line").collect()]
    return [t.split("\t")[:2] for t in text], new, ids, sorted((r.ca_id, r.src_id, *r.params) for r in links.collect())


def test_lines_of_every_kind(spark, tmp_path):
    lines = [["r1:g.1A>C", "1-1-A-C", "chr1:g.1A>C", "", "12,13", "5", "a name", "", "7,x"],  # three keys, one definition
             ["r1:g.1A>C", "1-1-A-G"],  # two definitions
             ["r1:g.8_9del"], ["r1:g.7_8dup"], ["r1:g.3_5inv"], ["r1:g.23G[6]"], ["t1:c.1T>A"], ["r1:g.2="],
             ["m1:g.1C>A"], ["m1:g.25A>G"], ["junk"], ["r9:g.1A>C"], ["r1:g.1G>C"], ["r1:g.[1A>C;4T>A]"], ["", "", "chr1:g.1del", ""], ["", "1-1-A-C"],
             ["a", "b", "c"], [""], ["r1:g.4T>A", "", "", "", "x1"], ["r1:g.4T>C", "", "", "", "", "", "only a name"], ["r1:g.5T>C", "", "", "", "", "", "", "", "no,x"], ["", "", "", "CA99"], ["r1:g.5T>G", "", "", "CA55"]]
    got, new, ids, links = run(spark, tmp_path, lines)
    seen = [x[1] if x[0] == "ERROR" else x[0] for x in got]
    assert seen == ["1:g.1A>C", "KeysDisagree", "1:g.12_13del", "1:g.7_8dup", "1:g.3_5delinsAAC", "1:g.29_30del", "1:g.4T>A", "1:g.2C=", "1:g.30G>T", "NoAlignment", "HgvsParsingError at 0", "UnknownReferenceName",
                    "IncorrectReferenceAllele", "ComplexAllele", "1:g.1del", "1:g.1A>C", "IncorrectNumberOfColumns", "NoKey", "IncorrectIdentifier", "AttributeWithoutIdentifier", "IncorrectParameters",
                    "NotFound", "1:g.5T>G"]
    assert got[0][1] == got[15][1] and got[22][1] == "CA000055" and len(got) == len(lines)
    first = int(got[0][1][2:])
    assert sorted((r.id_type, r.id, r.attrs) for r in ids.join(new.where(F.col("ca_id") == first), "variant_key").collect()) == [("ClinVarAllele", 5, "a name"), ("dbSNP", 12, None), ("dbSNP", 13, None)]
    assert links == [(first, 9, "7", "x")]
    # Again over what stands: the same ids; an id alone finds its variant; one that disagrees is refused.
    more = [lines[0], ["", "", "", f"CA{first}"], ["r1:g.4T>A", "", "", f"CA{first}"]]
    again, table, _, _ = run(spark, tmp_path, more, new, ids)
    assert again == [got[0], got[0], ["ERROR", "IdentifierMismatch"]] and table.count() == new.count()


VCF = ["##fileformat=VCFv4.2", "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO", "1\t1\t.\tA\tC\t.\t.\ta", "chr01\t1\tx;CA1\tA\tC\t.\t.\tb", "1\t7\tq\tGCA\tG\t.\t.\tc", "1\t9\t.\tACA\tA\t.\t.\td",
       "1\t2\t.\tC\t.\t.\t.\te", "1\t2\t.\tC\tA,G\t.\t.\tf", "1\t2\t.\tc\tA\t.\t.\tg", "23\t2\t.\tC\tA\t.\t.\th", "1\t2\t.\tG\tA\t.\t.\ti", "X\t2\t.\tC\tA\t.\t.\tj", "1\t2\t.\tC", "",
       "M\t1\t.\tA\tC\t.\t.\tm", "2\t1\t.\tC\tA\t.\t.\tn", "2\t25\t.\tA\tG\t.\t.\to", "1\t900000\t.\tA\tC\t.\t.\tp", "1\t0\t.\tA\tC\t.\t.\tq", "1\t1\t.\tA\tC\t.\t.\ta"]


def annotated(spark, tmp_path, assembly, spec, register, variants=None, known=None, lines=VCF):
    path = tmp_path / f"v{len(list(tmp_path.iterdir()))}.vcf"
    path.write_text("".join(x + "\n" for x in lines))
    chunks = intervals.ref_chunks(spark.createDataFrame([(1, R), (50, R[::-1].translate(str.maketrans("ACGT", "TGCA")))], "ref_id long, seq string"))
    blocks = spark.createDataFrame([(50, 0, 20, 1, len(R) - 20, len(R), "-", "=")], "trg_ref long, trg_left long, trg_right long, src_ref long, src_left long, src_right long, strand string, op string")
    assemblies = spark.createDataFrame([("GRCh37", 1, 1), ("GRCh37", 2, 50), ("GRCh38", 25, 1)], "build string, chrom int, ref_id long")
    variants = variants or spark.createDataFrame([], registry.TABLES["variants"])
    known = known or spark.createDataFrame([], registry.TABLES["identifiers"])
    table, out = bulk.annotate_vcf(files.read_lines(spark, str(path)), assembly, spec, assemblies, chunks, blocks, variants, known, register)
    out = out.orderBy("line").collect()
    assert len(out) == len(lines)
    same = [i for i, (x, r) in enumerate(zip(lines, out)) if x == r.text]
    return table, [r.text.split("\t")[2] if i not in same else None for i, r in enumerate(out)], [r.error for r in out]


def test_annotate_vcf(spark, tmp_path):
    table, ids, errors = annotated(spark, tmp_path, "GRCh37", "CA", True)
    # A>C at 1 and the deletion of CA, in two forms, a reference letter, and A>C on the turned reference.
    a, b, e, n = ids[2], ids[5], ids[6], ids[15]
    assert len({a, b, e, n}) == 4 and None not in (a, b, e, n) and table.count() == 4
    assert ids == [None, None, a, f"x;CA1,{a}" if a != "CA1" else None, f"q,{b}", b, e, *[None] * 7, a, n, None, None, None, a]
    assert [x for x in errors if x] == ["VcfParsingError"] * 3 + ["IncorrectReferenceAllele"] + ["VcfParsingError"] * 2 + ["NoAlignment", "UnknownReferenceSequence", "UnknownReferenceSequence"]
    # Nothing is registered without the flag; hg19 has no mitochondrial genome.
    keys = {f"CA{r.ca_id}": r.variant_key for r in table.collect()}
    known = spark.createDataFrame([(keys[a], "dbSNP", 12, None), (keys[a], "dbSNP", 3, None), (keys[a], "COSMIC", 9, "noncoding,active"), (keys[a], "ClinVarVariant", 5, "RCV000000007,RCV000000002"),
                                   (keys[b], "gnomAD", None, "1-7-GCA-G"), (keys[e], "ClinVarAllele", 4, "name")], registry.TABLES["identifiers"])
    same, ids, errors = annotated(spark, tmp_path, "hg19", "dbSNP.rs+COSMIC.id+ClinVar.RCV+gnomAD.id", False, table.where(F.col("ca_id") != int(e[2:])), known)
    text = "rs3,rs12,COSN9,RCV000000002,RCV000000007"
    assert ids == [None, None, text, f"x;CA1,{text}", "q,1-7-GCA-G", "1-7-GCA-G", *[None] * 13, text] and same.count() == 3
    assert errors[14] == "VcfParsingError"
    assert annotated(spark, tmp_path, "hg19", "CA", False, lines=VCF[:2])[2] == [None, None]
    for bad in (("hg17", "CA"), ("hg19", "CA+rs")):
        try:
            annotated(spark, tmp_path, *bad, False)
            raise AssertionError
        except ValueError:
            pass
