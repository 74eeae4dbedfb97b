"""The pipeline on a small fixture with planted cases."""

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from varloom.llm import queries, secretscan

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    src = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = src.join(labels.where("quality = 1"), "doc_id", "left_semi").orderBy("doc_id").limit(3).collect()
    mark = "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\""
    extra = [(9001, "12 34 !!", "en", "s", 8), (9002, None, "en", "s", None), (9003, good[0].text, "en", "s", 1), (9004, good[1].text + " " + mark, "en", "s", 1),
             (None, good[2].text, "en", "s", 1), (9005, "### &&& $$$ %%% " * 40, "en", "s", 1)]
    docs = src.unionByName(spark.createDataFrame(extra, src.schema)).withColumn("langid", F.lit(1)).withColumn("key", F.lit(2))
    kept = {}
    for name, stage in pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, SF).write.parquet(path)
        out = spark.read.parquet(path)
        if name != "packing":
            assert out.columns == docs.columns
        docs, kept[name] = out, out
    ids = {k: {r.doc_id for r in v.select("doc_id").collect()} for k, v in kept.items()}
    assert not {9001, 9002, 9005} & ids["language_id"]
    clean = {r.doc_id for r in labels.where("quality = 1").join(src, "doc_id", "left_semi").collect()}
    assert len(clean & ids["quality"]) > 0.97 * len(clean)
    assert 9003 not in ids["near_duplicates"] and None not in ids["near_duplicates"]
    assert ids["secrets"] == ids["near_duplicates"] == ids["packing"]
    assert kept["secrets"].where(F.col("text").contains("04dbebab91ab85687d33eeaaf9ac699e1188f962")).count() == 0


def test_linked_secrets_do_not_reach_packing(spark, tmp_path):
    bare = "aB3dEf7hIj1kLmN0pQr5tUv8wXyZ2aB4cD6eF8gH"
    texts = [f"plain user = bob_99 at https://db.example.com:5432/x with {bare} ok", f"{bare} alone", "user = bob_99 alone",
             f"token=abcdefgh {'x ' * 300} user=eve_77 {bare}", None]
    docs = spark.createDataFrame([(i, t, "k", "l", 0) for i, t in enumerate(texts + texts[:1])],
                                 "doc_id long, text string, key string, parts string, n_chars int")
    out = pipeline.secrets(spark, docs, SF)
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == 6 and {(r.key, r.parts) for r in got.values()} == {("k", "l")}
    assert got[0].text == got[5].text == "plain [REDACTED] at [REDACTED]/x with [REDACTED] ok"
    assert [got[i].text for i in (1, 2, 4)] == [texts[1], texts[2], None]
    assert got[3].text == f"[REDACTED] {'x ' * 300} [REDACTED] [REDACTED]"
    assert got[0].n_chars == len(got[0].text) and got[4].n_chars is None
    spans = {r.doc_id: r.spans for r in secretscan.scan(docs).collect()}
    assert [len(spans[i]) for i in range(6)] == [3, 0, 0, 3, 0, 3]


def test_stages_equal_brute_force(spark):
    """Each stage's decisions on its own input, in plain Python."""
    import re

    from varloom.llm import langid, quality

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    copies = docs.limit(20).withColumn("doc_id", F.col("doc_id") + 5000).withColumn("text", F.concat("text", F.lit(" one more word")))
    docs = docs.unionByName(copies).unionByName(spark.createDataFrame([(7000, None, "en", "s", 0), (7001, "12 !", "en", "s", 4), (7002, "日本語" * 60, None, None, 180), (7003, "the", None, None, 3)], docs.schema))
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    sf = "/root/testdata/sf0.001"
    _, proto = langid.train(docs)
    want = set()
    for i, t in rows.items():
        v, grams = langid.bundle(t)
        if v is not None and max(float(p @ v) for p in proto) >= langid.least_cosine(grams):
            want.add(i)
    assert kept(pipeline.language_id(spark, docs, sf)) == want and {7003} <= want and not {7000, 7001, 7002} & want
    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    import numpy as np

    tables = np.einsum("be,kef->kbf", model["E"], model["W"]).astype(np.float32)
    score = lambda t: 1 / (1 + np.exp(-(float((quality.features((t or "").encode(), tables, model["b"]) @ model["u"].astype(float)).mean()) + float(model["c"][0]))))
    assert kept(pipeline.quality_filter(spark, docs, sf)) == {i for i, t in rows.items() if score(t) >= 0.5}
    sets = {}
    for i, t in rows.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in rows}
    ids = sorted(rows)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = sorted((root[a], root[b]), reverse=True)
                root = {i: new if r == old else r for i, r in root.items()}
    assert kept(pipeline.near_duplicates(spark, docs, sf)) == {i for i in ids if root[i] == i} and len(set(root.values())) < len(ids) - 10
    spans = {r.doc_id: r.spans for r in secretscan.scan(docs).collect()}
    for r in pipeline.secrets(spark, docs, sf).collect():
        t, out, at = rows[r.doc_id], "", 0
        for s in spans[r.doc_id]:
            if s.s >= at:
                out += t[at:s.s] + "[REDACTED]"
            at = max(at, s.e)
        assert r.text == (t if not spans[r.doc_id] else out + t[at:])


def test_stages_on_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name


def test_registered():
    names = set(queries.queries())
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)} | {"pipeline"} and set(queries.oracle_sql()) <= names
    assert 4 <= len(pipeline.STAGES) <= 5
