"""Golden values on a tiny reference set."""

from pyspark.sql import functions as F

from varloom.functions import sequences as S
from varloom.operators import hgvs, intervals, liftover, normalize, output, protein, references, registry

R3 = ("ATGCCGACCTCATTTGACCCTGACATTCGGCCTGTTCGGATTTGTTACATGTTGGTTGTGCATGGTCGAGCTATACGTCAGTTACGTCGCTTGTTGAAAGTTATTTACCATCGTGATCAT"
      "TATTATTACATCCACGTGGATAAAAGATCGGACTACCTGT")


def norm(spark, rows):
    seqs = spark.createDataFrame([(3, R3)], "ref_id long, seq string")
    df = spark.createDataFrame(rows, "row_id long, ref_id long, left long, right long, ref string, alt string")
    return {r.row_id: r for r in normalize.normalize(df, intervals.ref_chunks(seqs)).collect()}


def test_normal_forms(spark):
    got = norm(spark, [(1, 3, 0, 1, "A", "T"), (2, 3, 1, 1, "", "GCC"), (3, 3, 12, 12, "", "TT"), (4, 3, 12, 14, "", ""),
                       (5, 3, 0, 1, "G", "T"), (6, 3, 150, 400, "", "A"), (7, 9, 0, 1, "", "A"), (8, 3, 0, 1, "", "N"), (9, 3, 2, 3, "", "G")])
    f = lambda r: (r.n_left, r.n_right, r.category, r.length_change, r.inserted, r.original)
    assert f(got[1]) == (0, 1, 0, 0, "T", "A")
    assert f(got[2]) == (1, 1, 0, 0, "GCC", "")
    assert f(got[3]) == (12, 15, 2, 2, "", "TT")
    assert f(got[4]) == (12, 15, 3, 2, "", "TT")
    assert got[5].error.type == "IncorrectReferenceAllele" and got[5].n_left is None
    assert got[6].error.type == "OutOfReference" and got[7].error.type == "UnknownReferenceSequence"
    assert got[8].error.type == "IncorrectSequence"
    assert f(got[9])[:5] == (2, 3, 0, 0, "G")  # identity stays


def test_long_shift(spark):
    seqs = spark.createDataFrame([(1, "G" + "AC" * 5000 + "T")], "ref_id long, seq string")
    df = spark.createDataFrame([(1, 1, 5001, 5003, "", "")], "row_id long, ref_id long, left long, right long, ref string, alt string")
    r = normalize.normalize(df, intervals.ref_chunks(seqs)).first()
    assert (r.n_left, r.n_right, r.category, r.length_change) == (1, 10001, 3, 2)


def test_alignments(spark):
    a = spark.createDataFrame([(1, "2=1X3=1D2=1X3=1X4=", ["A", "C", "G"], 7, 100, "-", 9, 0)],
                              "align_id long, cigar string, seqs array<string>, src_ref long, src_start long, strand string, trg_ref long, trg_start long")
    back = references.reverse_alignment(references.cigar_to_blocks(a))
    assert references.blocks_to_cigar(back).first().cigar == "4=1X3=1X2=1I3=1X2="
    src = spark.createDataFrame([(3, R3)], "src_ref long, seq string")
    t2 = spark.createDataFrame([(1, "10=", [], 3, 130, "-", 1, 0)], a.schema)
    assert references.apply_alignment(references.cigar_to_blocks(t2), src).first().seq == "TGTAATAATA"


def test_spliced_coordinates(spark):
    rows = [(1, 1, 39, 12), (1, 2, 27, 11), (1, 3, 20, 0), (2, 1, 10, 18), (2, 2, 30, 12), (2, 3, 8, 0)]
    exons = references.unsplice_transcripts(spark.createDataFrame(rows, "transcript long, n long, len long, intron long"))
    p = spark.createDataFrame([(1, 1, 10, False), (2, 1, 80, True), (3, 1, 40, False), (4, 1, 50, True), (5, 2, 20, False), (6, 2, 68, True)],
                              "point_id long, transcript long, u long, is_end boolean")
    got = {r.point_id: (r.pos, r.neg, r.off) for r in liftover.to_spliced(p, exons).collect()}
    assert got == {1: (10, False, 0), 2: (66, False, 2), 3: (39, False, 1), 4: (39, True, 1), 5: (10, True, 8), 6: (40, True, 2)}
    q = spark.createDataFrame([(k, 1 if k < 5 else 2, *v) for k, v in got.items()], "point_id long, transcript long, pos long, neg boolean, off long")
    assert {r.point_id: r.u for r in liftover.to_unspliced(q, exons).collect()} == {1: 10, 2: 80, 3: 40, 4: 50, 5: 20, 6: 68}


def test_translation(spark):
    one = lambda s: spark.range(1).select(S.translate_codons(F.lit(s))).first()[0]
    assert (one("ATGTAA"), one("ATGGC"), one("ATGAA"), one("")) == ("M*", "MA", "MX", "")
    assert spark.range(1).select(S.one_letter(F.lit("MetTer")), S.three_letters(F.lit("M*"))).first()[:] == ("M*", "MetTer")


def test_protein_effects(spark):
    rows = [(1, [(6, 7, "A")]), (2, [(15, 16, "")])]
    df = spark.createDataFrame([(i, "ATG" + "TTTCAACAAGCGACGCTGACGTAT" + "TAA", "CAGCTCTAA", [dict(left=a, right=b, alt=c) for a, b, c in m]) for i, m in rows],
                               "row_id long, cds string, tail string, mods array<struct<left:long,right:long,alt:string>>")
    got = {r.row_id: r for r in protein.transcript_to_protein_change(df).collect()}
    assert got[1].hgvs == "p.Gln3Lys" and got[1].label == "substitution"
    assert got[2].label == "frameshift" and "fsTer" in got[2].hgvs


def test_edit_description(spark):
    df = spark.createDataFrame([(1, "CTAAAACCACCTA", "CTAAACCACCACCTA"), (2, "AAAA", ""), (3, "ACGT", "ACGT"), (4, "AAAAAAAAAA", "CCCCCCCCCC")], "pair_id long, a string, b string")
    got = {r.pair_id: r.cigar for r in protein.minimal_protein_edit(df).collect()}
    assert got == {1: "5=2I8=", 2: "4D", 3: "4=", 4: None}


def test_overlap_join_matches_brute_force(spark):
    import random

    rng = random.Random(5)
    B = intervals.BIN
    near = [0, 1, B - 1, B, B + 1, 2 * B]
    items = [(i, 1, a, a + rng.choice([0, 1, 3, B, 2 * B])) for i, a in enumerate(rng.choice(near) for _ in range(200))]
    regs = [(i, 1, a, a + rng.choice([0, 1, 5, B])) for i, a in enumerate(rng.choice(near) for _ in range(80))]
    got = intervals.overlap_join(spark.createDataFrame(items, "i long, k long, left long, right long"), spark.createDataFrame(regs, "j long, k long, from long, to long"), ["k"])
    want = {(i, j) for i, _, l, r in items for j, _, f, t in regs if l <= t and r > f}
    rows = [(r.i, r.j) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want


def test_hgvs_parser(spark):
    texts = ["NM_1:c.-5T>G", "NM_1:c.10+2_12-1del", "r:g.[3A>T;5del]", "p:p.Gln3Lys", "p:p.Thr6ArgfsTer3", "r:g.5_6insACG", "r:g.4CA[3]", "r:g.7=", "junk", "r:z.1A>T", "r:g.1A>"]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, hgvs string")
    got = [(r.row_id, r.idx, r.op, r.pos1, r.off1, r.error) for r in hgvs.parse_hgvs(df).orderBy("row_id", "idx").collect()]
    assert got[0] == (0, 0, "snv", "-5", 0, None) and got[1] == (1, 0, "del", "10", 2, None)
    assert [g[:3] for g in got[2:4]] == [(2, 0, "snv"), (2, 1, "del")]
    assert got[4][2] == "snv" and got[5][2] == "frameshift" and got[6][2] == "ins" and got[7][2] == "repeat" and got[8][2] == "identity"
    assert [g[5] is not None for g in got[9:]] == [True] * 3


def test_register_rules(spark):
    d = "row_id long, variant_key string, ref_id long, n_left long, n_right long, category int, length_change long, inserted string, original string, given_id long"
    row = lambda i, k, left, given=None: (i, k, 1, left, left + 1, 0, 0, "A", "C", given)
    ids = lambda *x: spark.createDataFrame(list(x) or [], "row_id long, id_type string, id long, attrs string")
    none = spark.createDataFrame([], registry.TABLES["variants"]), spark.createDataFrame([], registry.TABLES["identifiers"])
    b = spark.createDataFrame([row(1, "b", 20), row(2, "a", 10), row(3, "b", 20), row(4, "c", 5, 7)], d)
    v, k, a = registry.register(b, ids((1, "dbSNP", 5, "x"), (3, "dbSNP", 5, "y"), (3, "dbSNP", 6, None)), *none)
    assert {r.row_id: r.ca_id for r in a.collect()} == {1: 9, 2: 8, 3: 9, 4: 7}
    assert sorted((r.id, r.attrs) for r in k.collect()) == [(5, "x"), (6, None)]
    b2 = spark.createDataFrame([row(1, "a", 10, 99), row(2, "d", 1, 8), row(3, "e", 2)], d)
    v2, _, a2 = registry.register(b2, ids(), v, k)
    got = {r.row_id: (r.ca_id, r.error) for r in a2.collect()}
    assert got == {1: (None, "IdentifierMismatch"), 2: (None, "IdentifierTaken"), 3: (10, None)} and v2.count() == 4


def test_masks():
    fields = ["a.x", "a.y", "externalSources.n", "b"]
    assert output.parse_mask("default -a.y", fields) == ["a.x", "b"]
    assert output.parse_mask("none +externalSources", fields) == ["externalSources.n"]
    assert output.parse_mask("all", fields) == fields and not output.needs("default", fields, "externalSources")
