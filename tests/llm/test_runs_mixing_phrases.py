"""Periodic runs, mixing and collocations against brute force, and odd rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from varloom.llm import collocations, mixing, runs

SF = "/root/testdata/sf0.001"


def brute_lyndon(s):
    """Length of the longest Lyndon word at each place: a word below all its proper suffixes."""
    out = []
    for i in range(len(s)):
        best = 0
        for j in range(i + 1, len(s) + 1):
            w = s[i:j]
            if 0 in w:
                break
            if all(w < w[k:] for k in range(1, len(w))):
                best = len(w)
        out.append(best)
    return out


def brute_runs(w, shortest=6, exponent=4):
    found = []
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(shortest, exponent * q) and not any(all(w[x] == w[x + r] for x in range(i, i + n - r)) for r in range(1, q)):
                found.append((i, n, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def test_lyndon_lengths_in_both_orders():
    rng = random.Random(1)
    for _ in range(800):
        k, s = rng.randint(1, 4), [0]
        for _ in range(rng.randint(1, 3)):
            s += [rng.randint(1, k) for _ in range(rng.randint(0, 14))] + [0]
        for text in (s, [k + 1 - x if x else 0 for x in s]):
            got = runs.lyndon_lengths(text, k)
            assert [n if x else 0 for n, x in zip(got, text)] == brute_lyndon(text), text


def test_runs_equal_brute_force():
    rng = random.Random(2)
    for _ in range(800):
        k, docs = rng.randint(1, 4), []
        for _ in range(rng.randint(1, 4)):
            w = [rng.randint(1, k) for _ in range(rng.randint(0, 20))]
            u = [rng.randint(1, k) for _ in range(rng.randint(1, 4))]
            docs.append(w + (u * 6)[:rng.randint(0, 20)] + [rng.randint(1, k) for _ in range(rng.randint(0, 5))])
        ids = np.array([x for w in docs for x in w], np.int64)
        of = np.repeat(np.arange(len(docs)), [len(w) for w in docs])
        first = np.concatenate(([0], np.cumsum([len(w) for w in docs])))
        for shortest, exponent in ((6, 4), (4, 2), (1, 3)):
            got = sorted((int(of[s]), int(s - first[of[s]]), int(n), int(q)) for s, n, q in zip(*runs.find_runs(ids, of, shortest, exponent)))
            assert got == sorted((d, *r) for d, w in enumerate(docs) for r in brute_runs(w, shortest, exponent)), (docs, shortest, exponent)


def brute_digest(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in found)),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def test_runs_of_odd_rows(spark):
    texts = [None, "", " \t", "a", "a a a a a a", "a a a a a", "x y " * 5 + "z", "a b a b a b a b c c c c c c", "\x1c b \x1c b \x1c b \x1c b", "é\x85é é\x85é " * 4, "w " * 30000,
             "one two three " * 9 + "other words", "a\x0bb\x0ca\rb a\nb a\tb"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (4, texts[4]), (None, texts[7]), (None, None)]
    rows += [(i, "p q r s t u v w x y " * 3) for i in range(1000, 1040)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("start", F.lit("x"))
    got = sorted(map(tuple, runs.digest(docs).collect()), key=str)
    assert got == sorted((brute_digest(*r) for r in rows), key=str)
    assert sum(r[1] > 0 for r in got) > 8 and runs.digest(docs.limit(0)).count() == 0
    assert [r.collapsed for r in runs.periodic_runs(docs.where("doc_id = 11")).collect()] == ["one two three other words"]


def _hash(v, seed):
    """Spark's xxhash64 of a value (a text, a long or null) from the hash of those before it."""
    if v is None:
        return seed
    return xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), seed)


def brute_mix(rows, share=(3, 2), most=2, weights=(3, 1, 2), group=256, unit=20):
    """Copies by (source, doc_id, size), in plain Python."""
    from fractions import Fraction
    from math import floor

    items = Counter((s, d, len((t or "").split())) for d, t, s in rows)
    size = Counter()
    for (s, _, n), k in items.items():
        size[s] += n * k
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full, target = Fraction(sum(size.values()) * share[0], share[1]), set(), {}
    while True:
        rest = total - sum(most * size[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        target = {s: Fraction(most * size[s]) if s in full else rest * weight[s] / w for s in names}
        more = {s for s in names if target[s] > most * size[s]}
        if not more:
            break
        full |= more
    copies = {}
    for s in names:
        units = floor(float(target[s]) / size[s] * (1 << unit) + 0.5) if size[s] else 0
        base, part = units >> unit, units & ((1 << unit) - 1)
        open_ = []
        for (s2, d, n), k in items.items():
            if s2 != s:
                continue
            copies[s, d, n] = [base, k, (k * part) >> unit]
            mass = n * (k * part & ((1 << unit) - 1))
            if mass:
                seed = _hash(n, _hash(d, _hash(s, 42)))
                open_.append((n, seed & ((1 << 62) - 1), d, mass))
        groups = {}
        buckets = -(-len(open_) // group)
        for x in open_:
            groups.setdefault(x[1] % buckets, []).append(x)
        level = 0
        while groups:
            up = {}
            for b, xs in groups.items():
                xs = sorted([(n, xxhash.xxh64_intdigest(level.to_bytes(4, "little"), _hash(r, 42)) & ((1 << 62) - 1), d, m) for n, r, d, m in xs],
                            key=lambda x: (x[0], x[1]), reverse=True)
                cur = None
                for x in xs:
                    if cur is None:
                        cur = x
                        continue
                    a, b2 = cur[0] << unit, x[0] << unit
                    rise, fall = min(a - cur[3], x[3]), min(cur[3], b2 - x[3])
                    c, y = (cur[3] + rise, x[3] - rise) if x[1] % (rise + fall) < fall else (cur[3] - fall, x[3] + fall)
                    for item, m, whole in ((cur, c, a), (x, y, b2)):
                        if m == whole:
                            copies[s, item[2], item[0]][2] += 1
                    cur = (*cur[:3], c) if 0 < c < a else (*x[:3], y) if 0 < y < b2 else None
                if cur:
                    up.setdefault(b // group, []).append(cur)
            level += 1
            if buckets == 1:
                for cur in up.get(0, []):
                    if 2 * cur[3] >= cur[0] << unit:
                        copies[s, cur[2], cur[0]][2] += 1
                break
            groups, buckets = up, -(-buckets // group)
    return copies, target, size


def _mixed(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("target", F.lit(1))


def test_mixing_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP", 4)  # several levels
    rng = random.Random(5)
    rows = [(i, "w " * rng.choice((0, 1, 3, 10, 40, 200)), rng.choice(["a", "a", "a", "b", "Z", "é", "", None])) for i in range(300)]
    rows += [(7, rows[7][1], rows[7][2])] * 3 + [(None, "x y z", "a")] * 5 + [(None, None, None), (900, None, "only nulls")]
    got = mixing.taken_words(_mixed(spark, rows)).collect()
    copies, target, size = brute_mix(rows, group=4)
    want = Counter()
    for (s, d, n), (base, k, more) in copies.items():
        want[d, n, size[s], n * (base + 1)] += more
        want[d, n, size[s], n * base] += k - more
    assert Counter((r.doc_id, r.size, r.source_size, r.taken) for r in got) == +want
    by = {size[s]: float(t) for s, t in target.items()}
    assert all(r.target == pytest.approx(by[r.source_size]) and r.taken <= 2 * r.size for r in got)
    again = mixing.taken_words(_mixed(spark, rows[::-1]).repartition(7)).collect()
    assert Counter(again) == Counter(got)


def test_copies_of_counts_are_never_broadcast(spark):
    """the copies of the counts were sized by the files of the counts, 64 times too low, and came to the driver."""
    docs = spark.createDataFrame([(i, "en", "a b c d. b c d e, " * 40) for i in range(4)], "doc_id long, lang string, text string")
    plan = collocations.collocations(docs)._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert len(joins) <= 1 and all("phrase" not in line.split("[", 1)[1].split("]")[0] for line in joins) and plan.count("SortMergeJoin") >= 3


def test_slices_of_texts_lie_in_small_files(spark, monkeypatch):
    """a task held all its slices, 4 MB each, when it wrote them and when it read them."""
    made, old = {}, collocations.saved
    monkeypatch.setattr(collocations, "saved", lambda df, name, *more: made.setdefault(name, old(df, name, *more)))
    docs = spark.createDataFrame([(i, "en", "a b c d. " * 9) for i in range(60)], "doc_id long, lang string, text string").coalesce(1)
    counts, totals = collocations.phrase_counts(docs, limits=collocations.Limits(slice=100))
    rows = made["collocation-words"].groupBy(F.input_file_name()).count().collect()
    assert sum(r["count"] for r in rows) == 60 and max(r["count"] for r in rows) <= 4
    assert {(r.phrase, r.f) for r in counts.collect()} == {(p, 540) for p in ("a", "b", "c", "d", "a b", "b c", "c d", "a b c", "b c d", "a b c d")} and totals.first().n == 2160


def test_targets_of_large_tables(spark):
    """a weight times the words to share was taken as an int where both are ints."""
    items = spark.createDataFrame([("a", 1, 200_000_000, 1), ("b", 2, 50_000_000, 2), ("c", 3, 150_000_000, 1)], "source string, doc_id long, size long, rows long")
    got = {r.source: (r.source_size, r.target) for r in mixing.targets(items).collect()}
    assert got == {"a": (200_000_000, 337_500_000.0), "b": (100_000_000, 112_500_000.0), "c": (150_000_000, 225_000_000.0)}


def test_mixing_comes_near_its_targets(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    joined = mixing.taken_words(docs).join(docs.select("doc_id", "source"), "doc_id")
    for r in joined.groupBy("source").agg(F.sum("taken").alias("t"), F.sum("size").alias("s"), F.max("source_size").alias("ss"), F.max("target").alias("aim"), F.max("size").alias("m")).collect():
        assert r.s == r.ss and abs(r.t - r.aim) <= r.m / 2 + 1
    monkeypatch.setattr(mixing, "SMALL", 0)  # the join by salted keys
    other = mixing.taken_words(docs)
    assert Counter(other.collect()) == Counter(mixing.taken_words(docs).collect())


def test_mixing_odd_tables(spark, monkeypatch):
    assert mixing.taken_words(_mixed(spark, [(1, "a", "s")]).limit(0)).count() == 0
    assert {tuple(r) for r in mixing.taken_words(_mixed(spark, [(1, None, None), (2, " ", None)])).collect()} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}
    monkeypatch.setattr(mixing, "CHUNK", 8)
    same = mixing.taken_words(_mixed(spark, [(None, "a b", "s")] * 41 + [(1, "word " * 100000, "t")])).collect()
    assert len(same) == 42 and sum(r.taken for r in same if r.doc_id is None) in (164, 162)


def brute_phrases(rows, least, longest=4, top=2000, cover=80):
    import re

    f, n, out = Counter(), Counter(), []
    for lang, text in rows:
        lang = "und" if lang is None else lang
        t = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        n[lang] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", t):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i:i + m])] += 1
    cand = {k: a for k, a in f.items() if a >= least and len(k[1]) > 1}
    covered = set()
    for (lang, w), a in cand.items():
        for m in range(2, len(w)):
            for i in range(len(w) - m + 1):
                if 100 * a >= cover * f[lang, w[i:i + m]]:
                    covered.add((lang, w[i:i + m]))
    for lang in n:
        own = []
        for (x, w), a in cand.items():
            if x == lang and (x, w) not in covered:
                cut = min((2_000_000 * a // (f[x, w[:k]] + f[x, w[k:]]), k) for k in range(1, len(w)))
                own.append((-cut[0], -a, " ".join(w).encode(), f[x, w[:cut[1]]], f[x, w[cut[1]:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(own)[:top])]
    return sorted(out)


def test_collocations_equal_brute_force(spark):
    rng = random.Random(9)
    words = ["a", "B", "the", "x\x00", "é", "日本", "\x1c", "new", "york", "12"]
    rows = [(rng.choice(["en", "en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", " ", "\t", ". ", ",", "\n", " \r ", "!?"]) for _ in range(rng.randint(0, 60)))) for _ in range(150)]
    rows += [(None, None), ("en", ""), ("fr", "only here"), ("en", "new york city " * 3000), rows[0], rows[0]]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, text string").withColumn("words", F.lit(1)).withColumn("n", F.lit("x"))
    want = brute_phrases(rows, 6)
    assert len(want) > 100
    assert sorted(map(tuple, collocations.collocations(docs, least=6).collect())) == want
    # Small slices, parts and tries, shared counters: bursts and spills change nothing.
    small = collocations.Limits(500, 64, 4, 40, 8, 6)
    assert sorted(map(tuple, collocations.collocations(docs, least=6, limits=small).collect())) == want
    few = collocations.collocations(docs, least=6, top=5).collect()
    assert sorted(map(tuple, few)) == brute_phrases(rows, 6, top=5)
    assert collocations.collocations(docs.limit(0)).count() == 0


def test_hat_trie_bursts_and_counts():
    rng = random.Random(3)
    for burst in (1, 3, 50):
        trie, want, bits = collocations.HatTrie(4, burst), Counter(), collocations.HatTrie.BITS
        for _ in range(2000):
            path = tuple(rng.randint(1, 5) for _ in range(rng.randint(2, 4)))
            trie.add(path[0], sum(w << (bits * k) for k, w in enumerate(path[1:])))
            for k in range(2, len(path) + 1):
                want[path[:k]] += 1
        got = Counter()
        for first in list(trie.root):
            got.update(dict(trie.take(first)))
        assert got == want and trie.held == 0
