"""Language identification and quality: held-out accuracy, and defined results for odd rows."""

from pyspark.sql import functions as F

from varloom.llm import langid, quality

SF = "/root/testdata/sf0.01"


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.held_out_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right / n > 0.98


def test_language_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (1, "the cat and the dog", "en"), (2, "der Hund und die Katze", "de"), (None, "the end", None),
            (3, None, "en"), (4, "", "de"), (5, "123 -- !!", "en"), (6, "the dog " * 40000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1)).withColumn("held_out", F.lit("x"))
    got = langid.held_out_languages(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (3, 4, 5)] == ["und"] * 3 and by[None].held_out is False
    assert langid.held_out_languages(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.held_out_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_hypervector_counts_every_trigram():
    import numpy as np

    a, b, c = langid._letters()
    s = [0, 1, 2, 1, 0]  # boundary a b a boundary
    want = sum((a[x].astype(int) * b[y] * c[z] for x, y, z in zip(s, s[1:], s[2:])), np.zeros(langid.DIM, int))
    assert np.allclose(langid.hypervector("aba"), want / np.linalg.norm(want), atol=1e-6)


def test_quality_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.held_out_quality(docs, labels).join(labels, "doc_id").where("held_out")
    right, n = got.agg(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 80 and right / n > 0.95


def test_quality_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (3, "a"), (None, "b"), (4, "xyz " * 60000)], "doc_id long, text string").withColumn("quality", F.lit(9))
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.held_out_quality(docs, none).collect()} == {0.5}
    some = spark.createDataFrame([(2, 1), (3, 0), (4, 1), (1, None), (None, 1)], "doc_id long, quality int")
    model = quality.train(docs, some, per_class=2)
    got = docs.select("doc_id", quality.score(F.col("text"), model).alias("s")).collect()
    assert len(got) == 6 and all(0 <= r.s <= 1 for r in got)


def test_features_cover_the_whole_text():
    import numpy as np

    rng = np.random.default_rng(1)
    tables = rng.normal(size=(quality.WIDTH, 256, quality.FILTERS)).astype(np.float32)
    raw = bytes(rng.integers(0, 256, 150_000, dtype=np.uint8))
    got = quality.features(raw, tables, np.zeros(quality.FILTERS, np.float32)).max(0)
    a = np.frombuffer(raw, np.uint8)
    n = len(a) - quality.WIDTH + 1
    want = np.maximum(sum(tables[k][a[k:k + n]] for k in range(quality.WIDTH)).max(0), 0)
    assert np.allclose(got, want, atol=1e-4)


def test_texts_in_unknown_letters_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    odd = spark.createDataFrame([(1, "日本語の文章がここにあります、そしてまだ続きます。" * 5), (2, "это совсем другой язык и он здесь неизвестен"), (3, "12 34"), (4, None)], "doc_id long, text string")
    assert langid.in_known_language(odd, model).count() == 0
    clean = docs.where(F.length("text") > 0)
    assert langid.in_known_language(clean, model).count() >= 0.999 * clean.where(F.col("text").rlike("[a-zA-Z]")).count()


def brute_language(rows):
    """Prototypes, cosines and arg max without arrays' help; rows (doc_id, text, lang)."""
    import zlib

    import numpy as np

    a, b, c = langid._letters()
    table = langid._symbols()

    def vector(text):
        s = [0] + [int(table[ord(x)]) for x in (text or "").lower()] + [0]
        if not any(s):
            return None
        s = [s[0]] + [x for y, x in zip(s, s[1:]) if x or y]
        v = [0] * langid.DIM
        for x, y, z in zip(s, s[1:], s[2:]):
            for i in range(langid.DIM):
                v[i] += int(a[x][i]) * int(b[y][i]) * int(c[z][i])
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v] if n else None

    proto = {}
    for d, t, lang in rows:
        v = vector(t)
        if lang is not None and d is not None and v and zlib.crc32(str(d).encode()) % 5:
            p = proto.setdefault(lang, np.zeros(langid.DIM))
            p += np.array(v)
    out = {}
    for d, t, _ in rows:
        v = vector(t)
        cos = {k: float(np.dot(p, v) / np.linalg.norm(p)) for k, p in proto.items()} if v else {}
        best = min(cos, key=lambda k: (-cos[k], k)) if cos else "und"
        out[d] = (d is not None and zlib.crc32(str(d).encode()) % 5 == 0, best, min(1.0, max(0.0, cos.get(best, 0.0))))
    return out


def test_languages_equal_brute_force(spark):
    rows = [(r.doc_id, (r.text or "")[:120], r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    rows += [(500, "Same words", "xa"), (501, "Same words", "xb"), (502, "same words", None), (503, None, "en"), (504, "!?", "de")]
    want = brute_language(rows)
    got = {r.doc_id: r for r in langid.held_out_languages(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for d, (held, lang, score) in want.items():
        assert (got[d].held_out, got[d].lang_pred) == (held, lang) and abs(got[d].score - score) < 1e-4, d
    # Equal prototypes tie; the first name wins.
    tie = spark.createDataFrame([(1, "same words", "b"), (2, "same words", "a"), (3, "same words", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid.identify(tie, langid.train(tie)).select("langid.*").collect()} == {"a"}


def test_scores_equal_an_explicit_forward_pass(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    p = {"E": rng.normal(size=(256, quality.EMBED)), "W": rng.normal(size=(quality.WIDTH, quality.EMBED, quality.FILTERS)), "b": rng.normal(size=quality.FILTERS),
         "u": rng.normal(size=quality.FILTERS) * 0.05, "c": np.array([0.1])}
    p = {k: v.astype(np.float32) for k, v in p.items()}

    def forward(text):
        raw = text.encode()
        raw += b"\0" * (quality.WIDTH - len(raw))
        n = len(raw) - quality.WIDTH + 1
        z = [[sum(float(p["E"][raw[i + k]] @ p["W"][k][:, f]) for k in range(quality.WIDTH)) for f in range(quality.FILTERS)] for i in range(n)]
        logits = []
        for s in range(0, max(1, n - quality.HALF), quality.HALF):  # chunks that overlap by half
            pooled = [max(0.0, max(z[i][f] for i in range(s, min(n, s + 2 * quality.HALF))) + float(p["b"][f])) for f in range(quality.FILTERS)]
            logits.append(sum(x * float(u) for x, u in zip(pooled, p["u"])))
        return 1 / (1 + np.exp(-(sum(logits) / len(logits) + float(p["c"][0]))))

    texts = ["", "ab", "hello world", "x y z " * 60, "é" * 300, "The end. " * 120]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, text string").select("i", quality.score(F.col("text"), p).alias("s")).collect()
    assert all(abs(r.s - forward(texts[r.i])) < 1e-3 for r in got)


def test_one_step_of_learning_follows_the_gradient():
    """Weights move against the numeric gradient of the weighted loss."""
    import numpy as np

    texts, y = [b"good words here", b"bad ### text"], np.array([1, 0], np.float32)
    small = quality.fit(texts, y, epochs=0)
    once = quality.fit(texts, y, epochs=1, batch=2)

    def loss(p):
        tables = np.einsum("be,kef->kbf", p["E"].astype(float), p["W"].astype(float))
        out = 0.0
        for t, want in zip(texts, y):
            logit = float((quality.features(t, tables, p["b"]) @ p["u"]).mean() + p["c"][0])
            out += np.log(1 + np.exp(-logit if want else logit))
        return out

    for key in ("c", "u", "b"):
        for at in range(len(small[key])):
            up, down = ({k: v.astype(float).copy() for k, v in small.items()} for _ in range(2))
            up[key][at] += 1e-3
            down[key][at] -= 1e-3
            slope = loss(up) - loss(down)
            if abs(slope) > 1e-5:
                assert np.sign(once[key][at] - small[key][at]) == -np.sign(slope), (key, at)


def test_one_long_text_takes_no_others_along(spark):
    rows = [(i, ("good plain words " if i % 2 else "### $$$ %%% ") * 20) for i in range(60)]
    first = 100
    docs = spark.createDataFrame([*rows, (first, "good plain words " * 4000)], "doc_id long, text string")
    labels = spark.createDataFrame([*((i, i % 2) for i in range(60)), (first, 1)], "doc_id long, quality int")
    model = quality.train(docs, labels, size=30_000)
    assert "E" in model
    got = docs.select("doc_id", quality.score(F.col("text"), model).alias("s")).collect()
    assert all((r.s >= 0.5) == bool(r.doc_id % 2 or r.doc_id == first) for r in got)
    assert quality.fitting([(0, 1, 10), (0, 2, 99), (0, 3, 20), (1, 1, 500), (1, 2, 400)], 30) == [(0, 1), (0, 3), (1, 2)]


def test_held_out_labels_do_not_count(spark):
    import zlib

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.held_out_quality(docs, x).collect())) for x in (labels, turned))
    assert a == b and all(r[1] == (zlib.crc32(str(r[0]).encode()) % 3 == 1) for r in a)


def test_short_and_long_texts_go_one_way():
    """One floor over the number of trigrams, rising, no switch."""
    floor = [langid.least_cosine(n) for n in range(0, 2000)]
    assert floor == sorted(floor) and floor[0] < 0 < floor[-1] < 0.16
