"""Ids of public sites: texts to forms and back, against plain Python."""

import random
import re

from varloom.operators import hgvs, intervals, liftover, normalize, site_ids

random.seed(5)
R = "".join(random.choice("ACGT") for _ in range(40)) + "CACACACACA" + "T" * 9 + "".join(random.choice("AC") for _ in range(60))


def tables(spark):
    return (spark.createDataFrame([(1, 1)], "chrom int, ref_id long"), intervals.ref_chunks(spark.createDataFrame([(1, R)], "ref_id long, seq string")))


def test_texts_come_back(spark):
    """Every place and style: the text read and written is the same, and it names the same change."""
    texts = []
    for i in range(0, len(R) - 4):
        for n in (1, 2, 4):
            at = f"{i + 1}_{i + n}" if n > 1 else f"{i + 1}"
            cut = R[i:i + n]
            texts += [f"chr1:g.{at}{x}" for x in ("del", f"del{n}", f"del{cut}", "dup", f"dup{n}", f"dup{cut}")]
            texts += [f"chr1:g.{at}delins{x}" for x in (cut[:1], cut + "A", R[i + n - 1] + "GG") if n > 1 or len(x) > 1]
        texts += [f"chr1:g.{i + 1}{R[i]}>{x}" for x in "ACGT"] + [f"chr1:g.{i + 1}_{i + 2}ins{x}" for x in ("A", "CA", "TTTG")]
    texts = sorted(set(texts))
    assemblies, chunks = tables(spark)
    ids = spark.createDataFrame(list(enumerate(texts)), "row_id long, id string")
    forms = site_ids.parse_myvariant(ids, assemblies, chunks)
    assert forms.where("error is not null").count() == 0
    from pyspark.sql import functions as F

    got = {r.row_id: r.id for r in site_ids.myvariant_ids(forms.withColumn("chrom", F.lit(1)), chunks).collect()}
    assert [got[i] for i in range(len(texts))] == texts


def test_wrong_texts(spark):
    """Nulls, other chromosomes, wrong sizes and letters have errors; every row answers."""
    cases = [(0, None), (1, ""), (2, "chr2:g.1del"), (3, "chr1:g.1_3del2"), (4, f"chr1:g.1_2dup{'G' if R[0] != 'G' else 'C'}A"), (5, "chr1:g.1_3delAA"), (6, "chr1:g.500del"), (7, "chr1:g.3_1del"), (8, "chr1:g.1_9insA"),
             (9, f"chr1:g.1{'G' if R[0] != 'G' else 'C'}>A")]
    assemblies, chunks = tables(spark)
    got = {r.row_id: r.error for r in site_ids.parse_myvariant(spark.createDataFrame(cases, "row_id long, id string"), assemblies, chunks).collect()}
    form = "UnknownFormatOfMyVariantInfoIdentifier"
    assert got == {0: form, 1: form, 2: "UnknownReferenceName", 3: form, 4: "IncorrectReferenceAllele", 5: form, 6: "OutOfReference", 7: form, 8: form, 9: "IncorrectReferenceAllele"}


def test_chrom_pos_ids_and_builds(spark):
    """Left-aligned with the letter before; on a turned block the form that comes back is the one that went."""
    from pyspark.sql import functions as F

    rows, want = [], []
    for i in range(0, 70):
        for ref, alt in ((R[i:i + 2], ""), ("", "CA"), (R[i:i + 1], "G"), (R[i:i + 3], R[i:i + 1])):
            if ref == alt:
                continue
            rows.append((len(rows), 1, i, i + len(ref), ref, alt))
            # Plain Python: drop common ends, then step to the left while the last letter is the one before.
            a, b, at = ref, alt, i
            while a and b and a[-1] == b[-1]:
                a, b = a[:-1], b[:-1]
            while a and b and a[0] == b[0]:
                a, b, at = a[1:], b[1:], at + 1
            while at > 0 and not (a and b) and (a or b)[-1] == R[at - 1]:
                a, b, at = (R[at - 1] + a)[:len(a)], (R[at - 1] + b)[:len(b)], at - 1
            base = R[at - 1] if not (a and b) and at > 0 else ""
            want.append(f"1-{at + 1 - len(base)}-{base}{a}-{base}{b}")
    _, chunks = tables(spark)
    forms = normalize.normalize(spark.createDataFrame(rows, "row_id long, ref_id long, left long, right long, ref string, alt string"), chunks).select("row_id", "ref_id", *normalize.NORMAL)
    blocks = spark.createDataFrame([(1, 0, len(R), 9, 1000, 1000 + len(R), "-", "="), (5, 0, 10, 9, 1000, 1010, "+", "=")],
                                   "trg_ref long, trg_left long, trg_right long, src_ref long, src_left long, src_right long, strand string, op string")
    main = liftover.normal_to_main(forms.withColumnRenamed("row_id", "item_id"), blocks).where("error is null").select(
        "item_id", F.col("main_ref").alias("ref_id"), F.col("main_left").alias("n_left"), F.col("main_right").alias("n_right"), "category", "length_change", "inserted", "original")
    builds = spark.createDataFrame([(1, "GRCh37"), (5, "GRCh38")], "ref_id long, build string")
    back = liftover.normal_from_main(main, blocks, builds, "GRCh37").drop("error").withColumnRenamed("item_id", "row_id")
    key = lambda df: sorted(tuple(r) for r in df.select("row_id", "ref_id", *normalize.NORMAL).collect())
    assert key(back) == key(forms)
    got = {r.row_id: r.id for r in site_ids.chrom_pos_ids(back.withColumn("chrom", F.lit(1)), chunks).collect()}
    assert [got[i] for i in range(len(rows))] == want
    empty = site_ids.chrom_pos_ids(back.withColumn("chrom", F.lit(1)).limit(0), chunks)
    assert empty.count() == 0


def test_expressions_of_transcripts(spark):
    """Every letter's name against a walk over exons and introns; several changes, places outside, unknown references."""
    from varloom.operators import hgvs

    exons = [(0, 9), (14, 30), (33, 50), (51, 70)]  # introns of 5, 3 and 1 letters
    spliced = 0
    names, table = {}, []
    for i, (a, b) in enumerate(exons):
        table.append((1, i, a, b, spliced, spliced + b - a))
        for u in range(a, b):
            spliced += 1
            names[u + 1] = (spliced, "")
        if i + 1 < len(exons):
            gap = exons[i + 1][0] - b
            for j in range(1, gap + 1):  # the j-th letter behind the exon stands gap - j + 1 before the next one
                names[b + j] = (spliced + 1, f"-{gap - j + 1}") if gap - j <= j else (spliced, f"+{j}")
    table += [(2, i, a, b, s, t) for _, i, a, b, s, t in table]

    def name(p, left, right):
        at, off = names[p]
        if left is None:
            return f"{at}{off}"
        return (f"-{left - at + 1}" if at <= left else f"{at - left}" if at <= right else f"*{at - right}") + off

    cols = "row_id long, ref_id long, n_left long, n_right long, category int, length_change long, inserted string, original string"
    rows, want = [], {}
    for ref, cds in ((1, (6, 40)), (2, (None, None))):
        head = f"t{ref}:{'c' if ref == 1 else 'n'}."
        for p in range(1, 71):
            i = len(rows)
            rows.append((i, ref, p - 1, p, 0, 0, "G", "A"))
            want[i] = head + name(p, *cds) + "A>G"
            rows.append((i + 1, ref, p, p, 0, 0, "TT", ""))
            want[i + 1] = head + f"{name(p, *cds)}_{name(p + 1, *cds)}insTT" if p < 70 else None
            rows.append((i + 2, ref, p - 1, min(p + 2, 70), 0, 0, "", "A" * (min(p + 2, 70) - p + 1)))
            want[i + 2] = head + (f"{name(p, *cds)}_{name(p + 2, *cds)}del" if p < 69 else f"{name(p, *cds)}_{name(70, *cds)}del" if p < 70 else f"{name(70, *cds)}del")
    more = [(1000, 1, 0, 0, 0, 0, "T", ""), (1001, 7, 3, 4, 0, 0, "G", "A"), (1002, 1, 20, 21, 0, 0, "G", "A"), (1002, 1, 3, 4, 0, 0, "G", "C")]
    want |= {1000: None, 1001: None, 1002: f"t1:c.[{name(4, 6, 40)}C>G;{name(21, 6, 40)}A>G]"}
    transcripts = spark.createDataFrame([(1, "t1", 6, 40), (2, "t2", None, None)], "ref_id long, ref_name string, cds_left long, cds_right long")
    exon_table = spark.createDataFrame(table, "transcript long, n int, u_left long, u_right long, s_left long, s_right long")
    got = hgvs.format_hgvs_spliced(spark.createDataFrame(rows + more, cols), exon_table, transcripts).collect()
    assert {r.row_id: r.hgvs for r in got} == want
    assert {r.row_id: r.error for r in got if r.error} == {1000: "OutOfReference", 1001: "UnknownReferenceName"} | {i: "OutOfReference" for i, w in want.items() if w is None and i < 1000}
    assert hgvs.format_hgvs_spliced(spark.createDataFrame([], cols), exon_table, transcripts).count() == 0


def test_ids_are_matched_once(spark):
    """each group of a text was matched anew, fifty times a row, and all rows met the few with letters of their own."""
    texts = ["chr1:g.5A>G", "chr22:g.7_9del", "chrX:g.7_9del3", "chrMT:g.7_8delAC", "chr1:g.4dup", "chr1:g.4_5dupAC", "chr3:g.4_5insACG", "chr3:g.4_5delinsT", "chr3:g.4delinsTT", "chr1:g.5A>G\n", "chr1:g.5A>G\n\n",
             "chr1:g.0A>G", "chr1:g.9_9del", "chr1:g.4_6insA", "chr1:g.1_20000del", "chr1|g.5A>G", "|", "", "1|2|3|4|5|6|7|8|9|10|11|12|13", "chr1:g.99999999999999999999del", None]
    form = re.compile(hgvs.MYVARIANT, re.ASCII)
    names = {"X": 23, "Y": 24, "M": 25, "MT": 25}
    want = {}
    for i, t in enumerate(texts):
        if t is None:
            want[i] = (None, None, None, None, "", "delins", None, None)
            continue
        m = form.match(t)
        bad = (None,) * 6 + ("UnknownFormatOfMyVariantInfoIdentifier", None)
        if not m:
            want[i] = bad
            continue
        c, a, b = m[1], int(m[2]), int(m[3] or m[2])
        tail = m[7] or m[11] or None
        if a >= 1 << 63:
            continue
        if a == 0 or (m[3] and b <= a) or (m[8] and b - a != 1):
            want[i] = (*bad[:-1], tail)
        elif b - a >= 10000:
            want[i] = (*bad[:6], "VariationTooLong", tail)
        else:
            kind = ("deletion" if m[6] else "duplication" if m[10] else "delins") + ("" if not tail else "WithLength" if tail.isdigit() else "WithSequence")
            want[i] = (names.get(c) or int(c), a if m[8] else b if m[10] else a - 1, a if m[8] else b, m[12] or (tail if tail and not tail.isdigit() else None), m[5] or m[9] or m[13] or "", kind, None, tail)
    rows = hgvs.myvariant_parts(spark.createDataFrame(list(enumerate(texts)), "row_id long, id string"))
    got = {r.row_id: (r.chrom, r.left, r.right, r.given, r.alt, r.style, r.error, r.tail) for r in rows.collect()}
    assert {i: got[i] for i in want} == want
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan and plan.count("regexp_replace(") == 1
