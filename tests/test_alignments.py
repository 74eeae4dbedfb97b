"""Verified, composed and indexed alignments against brute force."""

import random
import re

from pyspark.sql import functions as F

from varloom.functions import sequences as S
from varloom.operators import alignments, intervals, references

TURN = str.maketrans("ACGT", "TGCA")


def turn(s):
    return s[::-1].translate(TURN)


def test_cigars_are_split_and_verified(spark):
    rng = random.Random(6)
    rows, want, bad = [], {}, {}
    for i in range(150):
        src, trg, cigar, steps = "", "", "", []
        for _ in range(rng.randint(1, 6)):
            op, n = rng.choice("MMID=X"), rng.choice([0, 1, 2, 5, 300])
            a = "".join(rng.choice("ACGT") for _ in range(n))
            b = a if op == "=" else "".join(rng.choice([x for x in "ACGT" if x != y]) for y in a) if op == "X" else "".join(y if rng.random() < 0.7 else rng.choice("ACGT") for y in a)
            cigar += f"{n}{op}"
            src, trg = src + ("" if op == "I" else a), trg + ("" if op == "D" else b)
            for k in range(n):
                steps.append("D" if op == "D" else "I" if op == "I" else "=" if a[k] == b[k] else "X")
        strand = rng.choice("+-")
        fault = rng.choice([None] * 6 + ["WrongLength", "UnsupportedCigar", "WrongMatch", "WrongChange"])
        if fault == "WrongLength":
            trg += "A"
        elif fault == "UnsupportedCigar":
            cigar += rng.choice(["3", "2N"])
        elif fault == "WrongMatch":
            cigar, src, trg = cigar + "2=1X", src + "ACA", trg + "AGT"
        elif fault == "WrongChange":
            cigar, src, trg = cigar + "2X", src + "AC", trg + "GC"
        rows.append((i, cigar, 1, turn(src) if strand == "-" else src, 1000 if strand == "-" else 50, strand, 2, trg, 7))
        if fault:
            bad[i] = fault
            continue
        blocks, t, s = [], 0, 0
        for op in steps:
            if not blocks or blocks[-1][0] != op:
                blocks.append([op, t, t, s, s])
            t, s = t + (op != "D"), s + (op != "I")
            blocks[-1][2], blocks[-1][4] = t, s
        want[i] = [(op, 7 + a, 7 + b, *((50 + c, 50 + e) if strand == "+" else (1000 - e, 1000 - c)), trg[a:b] if op in "XI" else None) for op, a, b, c, e in blocks]
    df = spark.createDataFrame(rows, "align_id long, cigar string, src_ref long, src_seq string, src_start long, strand string, trg_ref long, trg_seq string, trg_start long")
    blocks, errors = alignments.verified_blocks(df)
    got = {}
    for r in blocks.orderBy("align_id", "idx").collect():
        own = got.setdefault(r.align_id, [])
        assert r.idx == len(own)
        own.append((r.op, r.trg_left, r.trg_right, r.src_left, r.src_right, r.ins))
    assert {i: b for i, b in want.items() if b} == got
    assert {r.align_id: r.error for r in errors.collect()} == bad and errors.count() == len(bad)
    # From the blocks back to the target's text.
    made = {r.align_id: r.seq for r in references.apply_alignment(blocks.withColumn("src_ref", F.col("align_id")), spark.createDataFrame(
        [(r[0], "." * (50 if r[5] == "+" else 1000 - len(r[3])) + r[3]) for r in rows], "src_ref long, seq string")).collect()}
    assert all(made[r[0]] == r[7] for r in rows if r[0] in got)


def test_index_finds_what_the_overlap_join_finds(spark, tmp_path):
    rng = random.Random(8)
    blocks = [(i, rng.randint(0, 2), left, left + rng.choice([0, 1, 5, 40, 3000])) for i, left in enumerate(rng.randint(0, 20000) for _ in range(3000))]
    regions = [(j, rng.randint(0, 3), a, a + rng.choice([0, 3, 100])) for j, a in enumerate(rng.randint(0, 23000) for _ in range(60))]
    b = spark.createDataFrame(blocks, "i long, src_ref long, src_left long, src_right long")
    q = spark.createDataFrame(regions, "j long, src_ref long, from long, to long")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index, parts = alignments.sorted_index(b, str(tmp_path / "index"))
        got = sorted((r.i, r.j) for r in alignments.search_index(index, parts, q).collect())
        join = intervals.overlap_join(b, q, ["src_ref"], ("src_left", "src_right"))
        assert got == sorted((r.i, r.j) for r in join.collect()) == sorted((i, j) for i, k, l, r in blocks for j, m, f, t in regions if k == m and l <= t and r > f)
        far, rows = {}, index.collect()
        for r in sorted(rows, key=lambda r: (r.src_ref, r.src_left, r.src_right)):
            far[r.src_ref] = max(far.get(r.src_ref, 0), r.src_right)
        for ref, top in far.items():
            assert max(r.max_end for r in rows if r.src_ref == ref) == top
        for r in rows:
            assert r.max_end >= r.src_right and r.max_end == max(x.src_right for x in rows if x.src_ref == r.src_ref and (x.part, x.src_left, x.src_right) <= (r.part, r.src_left, r.src_right))
        # One region reads few of the files.
        one = spark.createDataFrame([(0, 1, 100, 120)], q.schema)
        plan = alignments.search_index(index, parts, one)
        scan = re.search(r"PartitionFilters: \[([^\]]*)", plan._jdf.queryExecution().toString()).group(1)
        asked = one.join(parts, "src_ref").where("first_left <= to and last_end > from").select("part").distinct().count()
        assert "part" in scan and 1 <= asked <= 3
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def chain(rng):
    """Main texts, mapped references over them, transcripts over those or over main ones, all with both strands and own letters."""
    texts, blocks, number = {}, [], 0

    def add(ref, over):
        nonlocal number
        text = ""
        for _ in range(rng.randint(1, 5)):
            number += 1
            if rng.random() < 0.3:
                own = "".join(rng.choice("ACGT") for _ in range(rng.randint(1, 6)))
                blocks.append((ref, number, rng.choice("XI"), len(text), len(text) + len(own), over[0], 0, 0, "+", own))
                text += own
            else:
                src = rng.choice(over)
                a = rng.randint(0, len(texts[src]) - 1)
                b = rng.randint(a + 1, len(texts[src]))
                strand = rng.choice("+-")
                part = texts[src][a:b]
                blocks.append((ref, number, "=", len(text), len(text) + b - a, src, a, b, strand, None))
                text += turn(part) if strand == "-" else part
        texts[ref] = text

    for i in range(4):
        texts[i] = "".join(rng.choice("ACGT") for _ in range(rng.choice([30, 200, 9000])))
    for i in range(10, 22):
        add(i, [0, 1, 2, 3])
    for i in range(30, 45):
        add(i, rng.sample(range(10, 22), 3) + [0])
    return texts, blocks


def test_sequences_of_all_kinds(spark):
    rng = random.Random(12)
    texts, blocks = chain(rng)
    table = spark.createDataFrame(blocks, "trg_ref long, idx long, op string, trg_left long, trg_right long, src_ref long, src_left long, src_right long, strand string, ins string")
    low = alignments.sequence_map(table.where("trg_ref < 30"))
    maps = alignments.compose(alignments.sequence_map(table.where("trg_ref >= 30")), low).unionByName(low)
    code = S.codon_table()
    kinds = [(i, "main" if i < 10 else "mapped" if i < 30 else "transcript", len(t)) for i, t in texts.items()]
    exons, coding, proteins = [], [], {}
    for i in range(30, 45):
        cuts = sorted(rng.sample(range(len(texts[i]) + 1), min(4, len(texts[i]) + 1)))[:len(texts[i]) // 2 * 2]
        cuts = cuts[:len(cuts) // 2 * 2]
        at = 0
        for n, (a, b) in enumerate(zip(cuts[::2], cuts[1::2])):
            exons.append((i, n, a, b, at, at + b - a))
            at += b - a
        spliced = "".join(texts[i][a:b] for _, _, a, b, _, _ in [e for e in exons if e[0] == i])
        if at > 20:
            shift = rng.choice([0, 0, 1, 2])
            n = (at - 4) // 3
            coding.append((100 + i, i, 4, shift))
            kinds.append((100 + i, "protein", n))
            proteins[100 + i] = (spliced, shift, n)
    asks, want = [], {}
    for k in range(400):
        ref, kind, n = rng.choice(kinds)
        a = rng.randint(0, n)
        b = rng.randint(a, n)
        asks.append((k, ref, a, b))
        if kind != "protein":
            want[k] = (texts[ref][a:b], None)
        elif a == b:
            want[k] = ("", None)
        else:
            spliced, shift, _ = proteins[ref]
            part = spliced[4 + 3 * a + shift:4 + 3 * b - (3 - shift if shift else 0)]
            p = ("X" if shift else "") + "".join(code[part[i:i + 3]] for i in range(0, len(part) - 2, 3))
            rest = part[len(part) // 3 * 3:]
            if rest:
                may = {code[rest + x] for x in "ACGT"} if len(rest) == 2 else set()
                p += may.pop() if len(may) == 1 else "X"
            want[k] = (p[:-1] if p[-1:] in ("*", "X") else p, None)
    asks += [(900, 0, 5, len(texts[0]) + 1), (901, 777, 0, 1), (902, 0, 3, 2)]
    want |= {900: (None, "OutOfReference"), 901: (None, "UnknownReference"), 902: (None, "OutOfReference")}
    main = spark.createDataFrame([(i, texts[i]) for i in range(4)], "ref_id long, seq string")
    got = alignments.sequences(
        spark.createDataFrame(asks, "key long, ref_id long, left long, right long"), spark.createDataFrame(kinds, "ref_id long, kind string, length long"), maps,
        spark.createDataFrame(exons, "transcript long, n long, u_left long, u_right long, s_left long, s_right long"),
        spark.createDataFrame(coding, "protein long, transcript long, cds_left long, frame_offset int"), intervals.ref_chunks(main)).collect()
    assert len(got) == len(asks)
    for r in got:
        assert (r.seq, r.error) == want[r.key], (r, want[r.key], asks[r.key] if r.key < 400 else None)
    assert len(proteins) > 3


def test_lookup_of_repeated_keys(spark):
    main = spark.createDataFrame([(1, "ACGT" * 3000)], "ref_id long, seq string")
    asks = spark.createDataFrame([(1, 1, 4090, 4100), (1, 1, 4090, 4100), (2, 1, 0, 12000)], "k long, ref_id long, left long, right long")
    got = {r.k: r.seq for r in intervals.lookup_sequence(asks, intervals.ref_chunks(main), "k").collect()}
    assert got == {1: ("ACGT" * 3000)[4090:4100], 2: "ACGT" * 3000}


def test_transcripts_that_break_the_rules(spark, tmp_path):
    from varloom.sources import files

    (tmp_path / "t.align").write_text(
        "# good\n>good\n\tr1\t+\t11\t39=\n\tr1\t+\t62\t27=\n>back\n\tr3\t-\t120\t10=\n\tr3\t-\t72\t30=\nAAA\tr3\t-\t52\t8=\n"
        ">two refs\n\tr1\t+\t1\t4=\n\tr2\t+\t9\t4=\n>strands\n\tr1\t+\t1\t4=\n\tr1\t-\t9\t4=\n>order\n\tr1\t+\t50\t4=\n\tr1\t+\t9\t4=\n>order-\n\tr1\t-\t9\t4=\n\tr1\t-\t50\t4=\n")
    got = {r.name: r.problem for r in files.bad_transcripts(files.read_align(spark, str(tmp_path / "t.align"))).collect()}
    assert got == {"back": "unaligned inside", "two": "references", "strands": "strands", "order": "order", "order-": "order"}
