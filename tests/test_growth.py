"""Steps whose cost must not outgrow their input: what they write, and their results against plain versions."""

import random
import re

from pyspark.sql import functions as F

from varloom import session
from varloom.functions import sequences as S
from varloom.operators import alignments, consequences, hgvs, intervals, liftover, lookups, normalize, references, registry
from varloom.plans import contract_registry, derived

SF = "/root/testdata/sf0.001"


def test_variants_are_written_once_and_without_identifiers(spark, tmp_path, monkeypatch):
    made, path = [], session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda spark, name: made.append(name) or path(spark, name))
    for name in ("documents", "lineitem"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    variants = contract_registry.registered_variants(spark, str(tmp_path))
    assert variants.count() > 0 and set(made) == {"chunks", "normal", "new-variants"}
    # The batch registered in the general way has the same ids.
    batch = contract_registry.batch(spark, str(tmp_path))
    want = registry.register(batch, contract_registry.ids(spark, str(tmp_path)), *contract_registry.empty(spark))[0]
    assert variants.count() == want.count() and variants.select(want.columns).exceptAll(want).count() == 0


def test_keys_are_short_and_tell_definitions_apart(spark):
    form = "ref_id long, n_left long, n_right long, category int, length_change long, inserted string"
    rows = spark.createDataFrame([(1, i, i + k, c, 0, t) for i in range(20) for k in range(3) for c in range(2) for t in ("", "A", "AC")], form)
    keys = [r.k for r in rows.select(normalize.variant_key().alias("k")).collect()]
    assert len(set(keys)) == len(keys) and {len(k) for k in keys} == {22}


def test_small_regions_have_small_bins(spark):
    regions = spark.range(200).select(F.col("id").alias("region_id"), F.lit(1).cast("long").alias("ref_id"), (F.col("id") * 37 % 9000).alias("from"), (F.col("id") * 37 % 9000 + F.col("id") % 90).alias("to"))
    variants = spark.range(3000).select(F.col("id").alias("ca_id"), F.lit(1).cast("long").alias("ref_id"), (F.col("id") * 3).alias("n_left"), (F.col("id") * 3 + F.col("id") % 400).alias("n_right"))
    assert intervals.bin_size(regions) == 256 and intervals.bin_size(regions.withColumn("to", F.col("from") + 10 ** 6)) == intervals.BIN
    got = {(r.region_id, r.ca_id) for r in lookups.by_region(regions, variants).collect()}
    a, b = regions.collect(), variants.collect()
    assert got == {(x.region_id, y.ca_id) for x in a for y in b if y.n_left <= x.to and y.n_right > x["from"]}


def test_length_check_needs_no_text(spark):
    """A billion letters are too many whether or not they are at hand."""
    from varloom.operators import reconcile

    rows = spark.createDataFrame([(0, 3, 10_000), (0, 10_001, 1), (0, 1, 10_001), (0, 1, 10 ** 12)], "left long, right long, letters long")
    assert [r.ok for r in rows.select(reconcile.valid_length(F.col("left"), F.col("right"), F.col("letters")).alias("ok")).collect()] == [True, False, False, False]


def test_references_alike_answer_together(spark):
    """Against the pairs of map_from_main; some references have two blocks that hold a region, some are of no or two builds."""
    import random

    from varloom.operators import liftover

    rng = random.Random(5)
    rows = []
    for ref in range(120):
        for i in range(rng.randint(1, 3)):
            k, a = rng.choice((10, 20)), rng.choice((0, 10, 20, 25))
            rows.append((ref, i * 50, i * 50 + k, rng.randint(0, 1), a, a + k, rng.choice("+-"), rng.choice("===X")))
    blocks = spark.createDataFrame(rows, "trg_ref long, trg_left long, trg_right long, src_ref long, src_left long, src_right long, strand string, op string")
    builds = spark.createDataFrame([(r, b) for r in range(110) for b in (("a",), ("b",), ("a", "b"))[r % 3]], "ref_id long, build string")
    regions = spark.createDataFrame([(r, r, i, i + r % 3) for r in range(120) for i in (4,)], "region_id long, trg_ref long, left long, right long")
    got = liftover.coordinate_transform(regions, blocks, builds)
    main = liftover.map_to_main(regions.select(F.col("region_id").alias("item_id"), "trg_ref", "left", "right", F.lit("").alias("alt")), blocks).where("error is null")
    pairs = liftover.map_from_main(main.select("item_id", F.col("main_ref").alias("src_ref"), F.col("main_left").alias("left"), F.col("main_right").alias("right"), F.lit("").alias("alt")), blocks)
    want = pairs.join(builds.withColumnRenamed("ref_id", "trg_ref"), "trg_ref").groupBy("item_id", "build").agg(F.count("*"), F.min("t_left"), F.max("t_right"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 50
    # Answers meet by places and shapes, whose number copies of the references do not raise.
    shapes = lambda k: liftover._shapes(blocks.join(spark.range(k).withColumnRenamed("id", "c")).withColumn("trg_ref", F.col("trg_ref") + F.col("c") * 1000).drop("c"), builds.join(
        spark.range(k).withColumnRenamed("id", "c")).withColumn("ref_id", F.col("ref_id") + F.col("c") * 1000).drop("c")).count()
    assert shapes(1) == shapes(4)


def test_common_starts_without_lambdas(spark):
    texts = ["", "A", "C", "AC", "ACGTACGT", "ACGTACGTA", "ACGTACGTACGTT", "ACGTACGTACGTA", None]
    rows = [(a, b) for a in texts for b in texts]
    want = [None if a is None or b is None else next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in rows]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", S.lcp_short("a", "b").alias("n")).collect()
    assert {(r["a"], r["b"]): r["n"] for r in got} == dict(zip(rows, want))


def test_expressions_are_matched_once(spark):
    rows = hgvs.parse_hgvs(spark.createDataFrame([(1, "r:g.5_6delACinsT"), (2, "r:c.-5+3A>G"), (3, "r:p.Arg5GlyfsTer9"), (4, "r:g.4ACG[12]"), (5, "r:g.5delins")], "row_id long, hgvs string"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 6
    assert [(r["op"], r["pos1"], r["off1"], r["given"], r["alt"], r["n"]) for r in rows.orderBy("row_id").collect()] == [
        ("delins", "5", 0, "AC", "T", None), ("snv", "-5", 3, "A", "G", None), ("frameshift", "5", 0, "R", "G", None), ("repeat", "4", 0, None, "ACG", 12), (None, None, None, None, None, None)]


def test_lines_of_22_texts_are_not_dealt_by_text(spark):
    plan = derived.chromosome_variants(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(ref_id" not in plan


def test_codons_of_any_letters(spark):
    """What a cast to a number would bear is no base."""
    codes, letters = S.codon_table(), "ACGT0123+-. \n\tNé日"
    rows = [a + b + c for a in letters for b in letters for c in letters] + ["", "ACGTA", "ACG012TTT"]
    got = spark.createDataFrame([(r,) for r in rows], "s string").select("s", S.translate_codons(F.col("s"), tail=False).alias("p")).collect()
    assert {r.s: r.p for r in got} == {s: "".join(codes.get(s[i:i + 3], "X") for i in range(0, len(s) - 2, 3)) for s in rows}


def test_changes_meet_the_exons_near_them(spark):
    """Against all pairs; exons and changes lie over the borders of bins."""
    import random

    rng = random.Random(8)
    exons, mods, at = [], [], 0
    for e in range(60):
        to = at + rng.choice((20, 45, 300, 700))
        exons.append((1, at, to, 1000 * e))
        at = to + rng.choice((1, 15, 240))
    for v in range(900):
        left = rng.randint(0, at + 100)
        mods.append((v, 1, left, left + rng.choice((0, 1, 2, 60, 600)), "A"))
    mods.append((900, 2, 5, 6, "A"))
    got = consequences.to_exonic(spark.createDataFrame(mods + mods[:5], "var_id long, transcript long, left long, right long, alt string"), spark.createDataFrame(exons, "transcript long, u_left long, u_right long, s_left long"))
    want = {}
    for v, t, left, right, _ in mods:
        hit = [e for e in exons if e[0] == t and left < e[2] and right > e[1]]
        own = [e[3] + left - e[1] for e in hit if left >= e[1] and right <= e[2]]
        want[v] = ("exon", own[0]) if own else ("crossing" if hit else "intron", None)
    rows = got.collect()
    assert len(rows) == len(mods) and {r.var_id: (r.place, r.s_left if r.place == "exon" else None) for r in rows} == want and len(set(want.values())) > 100
    assert "b_" in got._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[1].splitlines()[0]


def test_transcripts_are_read_once(spark, monkeypatch):
    """However many variants a transcript has, its three frames are written once and its residues are taken from there."""
    made, path = [], session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda spark, name: made.append(name) or path(spark, name))
    tx = spark.createDataFrame([(1, "p1", "CC" + "ATGTTTCAGGGA" * 20 + "TAA" + "ACGTT" * 4, 2, 242, 0)], "transcript long, protein string, seq string, cds_left long, cds_right long, frame_offset int")
    mods = spark.createDataFrame([(v, 1, 6 + v, 7 + v, "") for v in range(200)], "var_id long, transcript long, left long, right long, alt string")
    exons = spark.createDataFrame([(1, 0, 265, 0)], "transcript long, u_left long, u_right long, s_left long")
    rows = consequences.transcript_consequences(mods, exons, tx).collect()
    assert made.count("reading-frames") == 1
    seq = tx.first().seq
    read = lambda s: "".join(S.codon_table()[s[i:i + 3]] for i in range(0, len(s) - 2, 3))
    protein = read(seq[2:242])
    for r in rows:
        if r.changes:
            (c,), cut = r.changes, seq[2:6 + r.var_id] + seq[7 + r.var_id:]
            assert protein[:c.left] + c.alt + protein[c.right:] == read(cut).split("*")[0] and protein[c.left:c.right] == c.ref.split("*")[0][:c.right - c.left]
    assert sum(map(bool, (r.changes for r in rows))) > 150


def test_identifiers_are_dealt_as_lists(spark):
    """A line's identifiers go as one row by line and as one by variant; the table is that of the general way."""
    rows = spark.range(600).select(F.col("id").alias("row_id"), (F.col("id") % 250).cast("string").alias("variant_key"))
    ids = spark.range(2000).select((F.col("id") % 700).alias("row_id"), F.element_at(F.array(F.lit("dbSNP"), F.lit("ClinVarAllele"), F.lit("ClinVarVariant")), (F.col("id") % 3 + 1).cast("int")).alias("id_type"),
                                   (F.col("id") % 11).alias("id"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string")).alias("attrs"))
    # One row of each identifier of a line: of two, either may be the first.
    ids = ids.dropDuplicates(["row_id", "id_type", "id"])
    lists = ids.groupBy("row_id").agg(F.collect_list(F.struct("id_type", "id", "attrs")).alias("ids"))
    got, want = registry.first_identifiers(rows, lists), registry.new_identifiers(rows, ids, contract_registry.empty(spark)[1])
    assert got.count() == want.count() > 250 and got.exceptAll(want).count() == 0
    assert {tuple(r) for r in derived.identifier_lists(spark, SF).select("row_id", F.explode("ids").alias("i")).select("row_id", "i.id_type", "i.id").collect()} == {
        (r.row_id, r.id_type, r.id) for r in derived.identifiers(spark, SF).collect()}
    plan = registry.first_identifiers(rows, derived.identifier_lists(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(variant_key" in plan and "id_type" not in "".join(line for line in plan.splitlines() if "hashpartitioning" in line)


def test_equal_texts_are_not_cut(spark, monkeypatch):
    """Only unlike texts of several pieces are cut; the pieces are those that cutting everything leaves."""
    from varloom.operators import alignments

    rows = [(1, "=", "ACGT" * 10, "ACGT" * 10), (2, "X", "A", "A"), (3, "M", "A" * 300, "A" * 299 + "C"), (4, "M", "A" * 256, "C" + "A" * 255), (5, "=", "A" * 900, "A" * 900)]
    df = spark.createDataFrame(rows, "align_id long, op string, a string, b string").withColumn("at", F.lit(0).cast("long"))
    want = alignments._cut(df, ["align_id", "op"]).where((F.col("a") != F.col("b")) | (F.col("op") == "X")).collect()
    cut, seen = alignments._cut, []
    monkeypatch.setattr(alignments, "_cut", lambda rows, keep: seen.append([r.align_id for r in rows.collect()]) or cut(rows, keep))
    got = alignments._unlike_pieces(df, ["align_id", "op"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want)) and seen == [[3]]


def test_searched_regions_meet_blocks_in_bins(spark, tmp_path):
    """within a range each region met every block of its reference; existing tests hold the rows against brute force."""
    blocks = spark.range(4000).select("id", (F.col("id") % 2).alias("src_ref"), (F.col("id") * 3).alias("src_left"), (F.col("id") * 3 + 20).alias("src_right"))
    regions = spark.range(50).select(F.col("id").alias("j"), (F.col("id") % 2).alias("src_ref"), (F.col("id") * 100).alias("from"), (F.col("id") * 100 + 5).alias("to"))
    found = alignments.search_index(*alignments.sorted_index(blocks, str(tmp_path / "index")), regions)
    assert "__bin" in found._jdf.queryExecution().optimizedPlan().toString()
    want = {(j, i) for j in range(50) for i in range(4000) if i % 2 == j % 2 and i * 3 <= j * 100 + 5 and i * 3 + 20 > j * 100}
    rows = [(r.j, r.id) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_only_pairs_with_blocks_that_meet_are_counted(spark):
    """F8: every pair of item and reference was dealt and sorted to see whether it is the only one."""
    rng = random.Random(5)
    blocks = [(rng.randint(0, 40), a, a + n, rng.randint(0, 2), b, b + n, rng.choice("+-")) for a, b, n in ((rng.randint(0, 900), rng.randint(0, 900), rng.choice([0, 1, 8, 30, 300])) for _ in range(600))]
    blocks += [(50, 0, 10, 0, 100, 110, "+"), (50, 10, 20, 0, 110, 120, "+"), (51, 0, 10, 0, 100, 110, "+"), (51, 0, 10, 0, 100, 110, "+")]
    items = [(i, rng.randint(0, 2), a, a + rng.choice([0, 1, 2, 20]), "AC") for i, a in enumerate(rng.randint(0, 950) for _ in range(300))] + [(900, 0, 110, 110, "A"), (901, 0, 109, 110, "A"), (902, 0, 109, 111, "A")]
    want = set()
    for i, ref, l, r, _ in items:
        for trg in {b[0] for b in blocks}:
            own = [b for b in blocks if b[0] == trg and b[3] == ref and b[4] <= l and r <= b[5]]
            if len(own) == 1:
                b = own[0]
                want.add((i, trg, b[1] + l - b[4] if b[6] == "+" else b[2] - (l - b[4]) - (r - l)))
    rows = liftover.map_from_main(spark.createDataFrame(items, "item_id long, src_ref long, left long, right long, alt string"), spark.createDataFrame(
        blocks, "trg_ref long, trg_left long, trg_right long, src_ref long, src_left long, src_right long, strand string"))
    got = [(r.item_id, r.trg_ref, r.t_left) for r in rows.collect()]
    assert set(got) == want and len(got) == len(want)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "NOT alone" in plan.split("Window", 1)[1]


def test_cigars_are_applied_without_dealing_blocks(spark):
    """each block of an alignment was dealt three times (by alignment, by source, by alignment) to make one text."""
    rng = random.Random(3)
    texts = {i: "".join(rng.choice("ACGT") for _ in range(400)) for i in range(3)}
    rows = []
    for i in range(80):
        cigar = "".join(f"{rng.choice([0, 1, 4, 17])}{op}" for op in rng.choices("MIDX=", k=rng.randint(1, 7)))
        seqs = [("ACGTACGTACGTACGTA"[:int(n)]) for n, op in re.findall(r"(\d+)([MIDX=])", cigar) if op in "XI" and int(n)]
        rows.append((i, cigar, seqs, rng.randint(0, 3), 200, rng.choice("+-"), 9, 5))
    aligns = spark.createDataFrame(rows, "align_id long, cigar string, seqs array<string>, src_ref long, src_start long, strand string, trg_ref long, trg_start long")
    src = spark.createDataFrame(list(texts.items()), "src_ref long, seq string")
    turn = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
    want = {}
    for i, cigar, seqs, ref, at, strand, _, _ in rows:
        steps, own = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDX=])", cigar) if int(n)], iter(seqs)
        if ref == 3 or not steps:
            continue
        out = ""
        for n, op in steps:
            if op in "M=":
                out += texts[ref][at:at + n] if strand == "+" else turn(texts[ref][at - n:at])
            elif op in "XI":
                out += next(own)
            if op != "I":
                at += n if strand == "+" else -n
        want[i] = out
    got = references.apply_cigars(aligns, src)
    assert {r.align_id: r.seq for r in got.collect()} == want
    assert {r.align_id: r.seq for r in references.apply_alignment(references.cigar_to_blocks(aligns), src).collect()} == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(align_id" not in plan and "Window" not in plan and "BroadcastHashJoin" not in plan
    assert "Exchange" not in references.cigar_to_blocks(aligns)._jdf.queryExecution().executedPlan().toString()


def test_short_alignments_are_verified_in_their_rows(spark, monkeypatch):
    """texts were written twice and blocks dealt eight times; now only blocks are written, and nothing is dealt."""
    made, old = {}, alignments.saved
    monkeypatch.setattr(alignments, "saved", lambda df, name: made.setdefault(name, old(df, name)))
    rows = [(i, "15M10=2I3D32M", 1, "A" * 60, 100, "+", 2, "A" * 10 + "C" * 5 + "A" * 10 + "GT" + "A" * 32, 0) for i in range(50)] + [(99, "3M2X", 1, "ACGTT", 100, "-", 2, "ACGTT", 0)]
    df = spark.createDataFrame(rows, "align_id long, cigar string, src_ref long, src_seq string, src_start long, strand string, trg_ref long, trg_seq string, trg_start long")
    blocks, errors = alignments.verified_blocks(df)
    got = [(r.idx, r.op, r.trg_left, r.trg_right, r.src_left, r.src_right, r.ins) for r in blocks.where("align_id = 7").orderBy("idx").collect()]
    assert got == [(0, "=", 0, 10, 100, 110, None), (1, "X", 10, 15, 110, 115, "CCCCC"), (2, "=", 15, 25, 115, 125, None), (3, "I", 25, 27, 125, 125, "GT"), (4, "D", 27, 27, 125, 128, None),
                   (5, "=", 27, 59, 128, 160, None)]
    assert blocks.count() == 300 and [tuple(r) for r in errors.collect()] == [(99, "WrongChange")]
    assert set(made) == {"alignments"} and made["alignments"].where("src is not null or trg is not null").count() == 0
    assert "Exchange" not in blocks._jdf.queryExecution().executedPlan().toString()
    monkeypatch.undo()
    long = df.where("align_id < 3").withColumns({"cigar": F.lit("2000M4I"), "src_seq": F.lit("AC" * 1000), "trg_seq": F.lit("AC" * 999 + "GGTTTT")})
    got = [(r.idx, r.op, r.trg_left, r.trg_right, r.src_left, r.src_right, r.ins) for r in alignments.verified_blocks(long.unionByName(df.where("align_id = 3")))[0].where("align_id = 2").orderBy("idx").collect()]
    assert got == [(0, "=", 0, 1998, 100, 2098, None), (1, "X", 1998, 2000, 2098, 2100, "GG"), (2, "I", 2000, 2004, 2100, 2100, "TTTT")]
