"""Lift-over, spliced texts, chunk tables and digests against small brute-force versions."""

import base64
import hashlib
import json
import random
import time

import duckdb
from pyspark.sql import functions as F

from varloom.functions import sequences as S
from varloom.operators import intervals, liftover, output

BLOCKS = "trg_ref long, trg_left long, trg_right long, src_ref long, src_left long, src_right long, strand string, op string"


def test_changed_blocks_hold_nothing(spark):
    blocks = spark.createDataFrame([(1, 0, 10, 9, 100, 110, "+", "="), (1, 10, 12, 9, 110, 112, "+", "X"), (1, 12, 30, 9, 112, 130, "+", "="), (1, 30, 40, 8, 0, 10, "-", "=")], BLOCKS)
    items = spark.createDataFrame([(1, 0, 1, 2, 4, "A"), (2, 0, 1, 10, 11, "A"), (3, 0, 1, 2, 4, "A"), (3, 1, 1, 10, 11, "A"), (4, 0, 1, 3, 4, "A"), (4, 1, 1, 31, 32, "AC"),
                                   (5, 0, 1, 31, 33, "AC")], "item_id long, change long, trg_ref long, left long, right long, alt string")
    got = {(r.item_id, r.change): (r.main_ref, r.main_left, r.main_alt, r.error) for r in liftover.map_to_main(items, blocks).collect()}
    assert got == {(1, 0): (9, 102, "A", None), (2, 0): (None, None, None, "NoAlignment"), (3, 0): (None, None, None, "NoAlignment"), (3, 1): (None, None, None, "NoAlignment"),
                   (4, 0): (None, None, None, "DifferentReferences"), (4, 1): (None, None, None, "DifferentReferences"), (5, 0): (8, 7, "GT", None)}
    back = spark.createDataFrame([(1, 0, 9, 102, 103, "A"), (2, 0, 9, 102, 103, "A"), (2, 1, 9, 110, 111, "A")], "item_id long, change long, src_ref long, left long, right long, alt string")
    assert [(r.item_id, r.t_left) for r in liftover.map_from_main(back, blocks).collect()] == [(1, 2)]


def test_turned_forms_describe_the_same_change(spark):
    """A form turned to the other strand makes the reverse complement of the changed sequence."""
    from varloom.operators import normalize

    rng = random.Random(3)
    turn = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    seqs, rows = [], []
    for i in range(60):
        s = "".join(rng.choice("AC") for _ in range(60))
        a = rng.randint(5, 50)
        b = a + rng.randint(0, 3)
        seqs.append((i, s))
        rows.append((i, i, a, b, "", "".join(rng.choice("AC") for _ in range(rng.randint(0, 3)))))
    chunks = intervals.ref_chunks(spark.createDataFrame(seqs, "ref_id long, seq string"))
    forms = normalize.normalize(spark.createDataFrame(rows, "item_id long, ref_id long, left long, right long, ref string, alt string"), chunks)
    blocks = spark.createDataFrame([(i, 0, 60, 1000 + i, 0, 60, "-", "=") for i in range(60)], BLOCKS)
    got = liftover.normal_to_main(forms, blocks).select(
        "item_id", F.col("main_left").alias("n_left"), F.col("main_right").alias("n_right"), "category", "length_change", "inserted", "original")
    seen = 0
    for r in normalize.left_aligned(got).collect():
        i, _, a, b, _, alt = rows[r.item_id]
        s = seqs[i][1]
        other = turn(s)
        assert other[:r.p_left] + r.p_alt + other[r.p_right:] == turn(s[:a] + alt + s[b:])
        seen += r.category > 0
    assert seen > 10


def test_a_stop_ends_spliced_texts(spark):
    mods = "array(struct(1L as left, 2L as right, 'X*' as alt), struct(3L as left, 4L as right, 'Z' as alt))"
    row = spark.range(1).select(S.apply_mods(F.lit("ABCDEF"), F.expr(mods)).alias("a"), S.apply_mods(F.lit("ABCDEF"), F.expr(mods.replace("*", ""))).alias("b")).first()
    assert (row.a, row.b) == ("AX*", "AXCZEF")


def test_chunks_are_pieces_with_margins(spark):
    text = "".join(random.Random(1).choice("ACGT") for _ in range(1000))
    rows = spark.createDataFrame([(1, text), (2, ""), (3, "ACG")], "ref_id long, seq string")
    got = {(r.ref_id, r.chunk_no): (r.ctx_left, r.ctx, r.ref_len) for r in intervals.ref_chunks(rows, size=2, margin=3).collect()}
    want = {(1, k): (max(2 * k - 3, 0), text[max(2 * k - 3, 0):2 * k + 5], 1000) for k in range(500)}
    assert got == want | {(2, 0): (0, "", 0), (3, 0): (0, "ACG", 3), (3, 1): (0, "ACG", 3)}


def test_allele_digests(spark):
    rows = spark.createDataFrame([(1, 7, 3, 5, "T"), (2, 7, 3, 3, "")], "ca_id long, ref_id long, n_left long, n_right long, inserted string")
    short = lambda s: base64.urlsafe_b64encode(hashlib.sha512(s.encode()).digest()[:24]).decode()
    for r, (a, b, text) in zip(output.vr_allele(rows).orderBy("ca_id").collect(), ((3, 5, "T"), (3, 3, ""))):
        place = json.dumps({"interval": {"end": b, "start": a, "type": "SimpleInterval"}, "sequence_id": "ref.7", "type": "SequenceLocation"}, separators=(",", ":"))
        want = json.dumps({"location": short(place), "state": {"sequence": text, "type": "SequenceState"}, "type": "Allele"}, separators=(",", ":"))
        assert r.json == want and r.digest == "ga4gh:VA." + short(want)


def _protein(text):
    codes = S.codon_table()
    out = "".join(codes[text[i:i + 3]] for i in range(0, len(text) - 2, 3))
    return out[:out.index("*") + 1] if "*" in out else out


def _spliced(text, mods):
    for left, right, alt in sorted(mods, reverse=True):
        text = text[:left] + alt + text[right:]
    return text


def test_combinations_match_brute_force(spark):
    """Single variants and pairs that give a protein; a pair that holds a match of one is left out."""
    from varloom.operators import protein

    rng = random.Random(5)
    changes, variants, want = [], [], set()
    for t in range(40):
        cds = "ATG" + "".join(rng.choice("ACG") for _ in range(30)) + "TAA"
        own = []
        for v in range(6):
            a = rng.randint(3, 32)
            own.append((t * 10 + v, a, a + rng.randint(0, 1), rng.choice(["", "A", "C", "G"])))
        first, second = sorted(rng.sample(own, 2), key=lambda x: x[1])
        target = _protein(_spliced(cds, [first[1:]] + ([second[1:]] if second[1] > first[2] else [])) + "ACGT")
        changes.append((t, t, 10, 11, cds, "ACGT", target))
        variants += [(t, *v) for v in own]
        ones = {(v[0],) for v in own if _protein(_spliced(cds, [v[1:]]) + "ACGT") == target}
        pairs = {(a[0], b[0]) for a in own for b in own if b[1] > a[2] and _protein(_spliced(cds, [a[1:], b[1:]]) + "ACGT") == target}
        want |= {(t, c) for c in ones | {p for p in pairs if not any((x,) in ones for x in p)}}
    got = protein.match_transcript_variants(
        spark.createDataFrame(changes, "change_id long, transcript long, left long, right long, cds string, tail string, protein string"),
        spark.createDataFrame(variants, "transcript long, var_id long, left long, right long, alt string")).collect()
    assert {(r.change_id, tuple(r.combination)) for r in got} == want and len(got) == len(want)
    assert any(len(c) == 2 for _, c in want) and any(len(c) == 1 for _, c in want)


def test_a_batch_s_definitions_are_merged_once(spark, monkeypatch):
    """the given ids, the new ones and the faults each merged the batch anew, with a shuffle of their own."""
    from varloom.operators import registry

    names, write = [], registry.saved
    monkeypatch.setattr(registry, "saved", lambda df, name: names.append(name) or write(df, name))
    kind = "row_id long, variant_key string, ref_id long, n_left long, n_right long, category int, length_change long, inserted string, original string, given_id long"
    batch = spark.createDataFrame([(1, "a", 1, 5, 6, 0, 0, "A", "C", None), (2, "a", 1, 5, 6, 0, 0, "A", "C", None), (3, "b", 1, 2, 3, 0, 0, "A", "C", 7), (4, "c", 1, 1, 2, 0, 0, "G", "C", 7)], kind)
    ids = spark.createDataFrame([], "row_id long, id_type string, id long, attrs string")
    answer = registry.register(batch, ids, *[spark.createDataFrame([], registry.TABLES[t]) for t in ("variants", "identifiers")])[2]
    assert names.count("met-definitions") == 1 and not answer._jdf.queryExecution().optimizedPlan().toString().count("min_by")
    assert {r.row_id: (r.ca_id, r.error) for r in answer.collect()} == {1: (8, None), 2: (8, None), 3: (None, "IdentifierTaken"), 4: (7, None)}


def test_silent_combinations_are_not_grown(spark, monkeypatch):
    """states that are those of the unchanged text were grown by every further candidate."""
    from varloom.operators import protein

    cds = "ATG" + "GCTTTACGA" * 8 + "TAA"
    # In every third codon a silent letter, a deleted letter that the next insertion makes good, and one change that is seen.
    variants = [(1, 10 * k + j, at, to, alt) for k in range(7) for j, (at, to, alt) in enumerate([
        (9 * k + 5, 9 * k + 6, "A"), (9 * k + 7, 9 * k + 8, ""), (9 * k + 9, 9 * k + 9, "T")])] + [(1, 900, 66, 67, "A")]
    target = _protein(cds[:66] + "A" + cds[67:] + "ACGT")
    texts = spark.createDataFrame([(1, cds, "ACGT", *[_read(cds[i:] + "ACGT") for i in range(3)])], "transcript long, cds string, tail string, f0 string, f1 string, f2 string")
    rows, write = [], protein.saved

    def counted(df, name):
        out = write(df, name)
        if name == "combinations":
            rows.append(out.count())
        return out

    monkeypatch.setattr(protein, "saved", counted)
    got = protein.match_transcript_variants(spark.createDataFrame([(5, 1, 66, 67, target)], "change_id long, transcript long, left long, right long, protein string"),
                                            spark.createDataFrame(variants, "transcript long, var_id long, left long, right long, alt string"), texts=texts).collect()
    assert [(r.change_id, r.combination, r.error) for r in got] == [(5, [900], None)]
    assert sum(rows) < 4 * len(variants)


def _read(s):
    table = S.codon_table()
    return "".join(table[s[i:i + 3]] for i in range(0, len(s) - 2, 3))


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_descriptions_are_minimal(spark):
    """A description's edits are as many as the distance of both texts, and it leads from one to the other."""
    import re

    from varloom.operators import protein

    rng = random.Random(6)
    pairs = []
    for i in range(200):
        a = "".join(rng.choice("ACD") for _ in range(rng.randint(1, 25)))
        b = list(a)
        for _ in range(rng.randint(0, 9)):
            at = rng.randint(0, len(b))
            b[at:at + rng.randint(0, 1)] = rng.choice(["", "A", "C", "DA"])
        pairs.append((i, a, "".join(b)))
    got = {r.pair_id: r.cigar for r in protein.minimal_protein_edit(spark.createDataFrame(pairs, "pair_id long, a string, b string")).collect()}
    for i, a, b in pairs:
        if not b:
            assert got[i] == f"{len(a)}D"
            continue
        if _distance(a, b) > protein.MAX_COST:
            assert not got[i]
            continue
        at, to, edits = 0, 0, 0
        for n, op in re.findall("([0-9]+)([=XDI])", got[i]):
            n = int(n)
            x, y = a[at:at + n * (op != "I")], b[to:to + n * (op != "D")]
            assert op in "DI" or (len(x) == len(y) == n and all((p == q) == (op == "=") for p, q in zip(x, y)))
            at, to, edits = at + n * (op != "I"), to + n * (op != "D"), edits + n * (op != "=")
        assert (at, to, edits) == (len(a), len(b), _distance(a, b))


def test_least_edits_of_long_texts_take_few_comparisons(spark):
    """every pair of texts went through all levels of edits in array lambdas, each of 30 steps; the helper stops at the level that it needs."""
    from varloom.operators import protein

    rng = random.Random(7)
    p = "".join(rng.choice("ACDEFGHIKLMNPQRSTVWY") for _ in range(20_000))
    pairs = [(i, p, p[:i * 9] + p[i * 9 + 2:i * 9 + 500] + "W" + p[i * 9 + 501:]) for i in range(1000)]
    start = time.process_time()
    one = protein.least_edits()
    got = {i: one(a, b) for i, a, b in pairs}
    assert time.process_time() - start < 5
    some = {r.pair_id: r.cigar for r in protein.minimal_protein_edit(spark.createDataFrame(pairs[:20], "pair_id long, a string, b string")).collect()}
    assert some == {i: got[i] for i in range(20)}
    assert one("AAAB", "AAB") == "2=1D1=" and one("", "AC") == "2I" and one("AC", "DC") == "1X1=" and one("A" * 9, "C" * 9) is None
    assert all(c.endswith("=") for c in got.values())



def test_reference_numbers_of_seven_digits_are_not_cut(spark, tmp_path):
    """RS1000000 was cut to RS100000, another record's name, and both were rejected."""
    from varloom.operators import references
    from varloom.plans import contract_text
    from varloom.plans.contract import SQL
    from varloom.sources import files

    lines = ["Id\tRefSeq\tGenBank\tENSEMBL\tLRG", "42\tNM_42\t\t\t", "100000\tNM_100000\t\t\t", "1000000\tNM_1000000\t\t\t"]
    (tmp_path / "refs.txt").write_text("\n".join(lines) + "\n")
    known = spark.createDataFrame([(f"NM_{i}", i) for i in (42, 100000, 1000000)], "name string, ref_id long")
    names, rejected = files.read_ref_names(spark, str(tmp_path / "refs.txt"), known)
    want = {("RS000042", 42), ("NM_42", 42), ("RS100000", 100000), ("NM_100000", 100000), ("RS1000000", 1000000), ("NM_1000000", 1000000)}
    assert {(r.alias, r.ref_id) for r in names.collect()} == want and rejected.count() == 0
    asked = references.resolve_reference(spark.createDataFrame([("RS42",), ("RS1000000",), ("RS1000001",)], "ref_name string"), names)
    assert {r.ref_name: r.ref_id for r in asked.collect()} == {"RS42": 42, "RS1000000": 1000000, "RS1000001": None}
    spark.createDataFrame([(i,) for i in (7, 42, 100000, 1000000, 1000002)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    got = [(r.alias, r.ref_id) for r in contract_text.s7_read_ref_names(spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(con.execute(SQL["s7_read_ref_names"]).fetchall())


def test_repeats_go_on_to_the_end_of_the_run(spark):
    from varloom.operators import normalize

    chunks = intervals.ref_chunks(spark.createDataFrame([(1, "GG" + "AC" * 700 + "AGTTT")], "ref_id long, seq string"))
    rows = spark.createDataFrame([(1, 1, 2, "AC", 3), (2, 1, 2, "AC", 700), (3, 1, 1404, "T", 9), (4, 1, 0, "C", 2)], "row_id long, ref_id long, left long, unit string, n long")
    got = {r.row_id: (r.copies, r.right, r.kind) for r in normalize.expand_repeats(rows, chunks).collect()}
    assert got == {1: (700, 1402, "deletion"), 2: (700, 1402, "identity"), 3: (3, 1407, "insertion"), 4: (0, 0, "insertion")}
