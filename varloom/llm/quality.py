"""Quality classifier: a byte-level convolutional network, trained and run with numpy.

Each byte has a learned embedding; learned filters over five neighbouring bytes run over the whole
document; their rectified outputs are max-pooled in chunks of 512 bytes that overlap by half; a
learned linear layer turns each chunk's pooled outputs into a logit, and the mean logit of all
chunks gives the document's one probability.

Defined results: null and empty text are scored as one empty chunk; without training rows of both
classes every score is the share of label 1 (0.5 without any). Rows are scored alone, so repeated
rows get equal scores. Columns other than those named are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import has_columns, id_crc

WIDTH, FILTERS, EMBED, HALF = 5, 24, 8, 256
#: At most so many training documents a class, and so many bytes of them together.
TRAIN_DOCS, TRAIN_BYTES = 1000, 8 << 20
BLOCK = 1 << 16


def _pad(raw: bytes) -> np.ndarray:
    a = np.frombuffer(raw, np.uint8)
    return a if len(a) >= WIDTH else np.concatenate((a, np.zeros(WIDTH - len(a), np.uint8)))


def features(raw: bytes, tables: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Max-pooled filter outputs of every overlapping chunk of the whole byte string."""
    a = _pad(raw)
    n = len(a) - WIDTH + 1
    halves = []
    for i in range(0, n, BLOCK):
        m = min(BLOCK, n - i)
        z = tables[0][a[i:i + m]]
        for k in range(1, WIDTH):
            z += tables[k][a[i + k:i + k + m]]
        halves.append(np.maximum.reduceat(z, np.arange(0, m, HALF), axis=0))
    h = np.concatenate(halves)
    pooled = np.maximum(h[:-1], h[1:]) if len(h) > 1 else h
    return np.maximum(pooled + bias, 0)


def fit(texts: list[bytes], labels: np.ndarray, epochs: int = 8, batch: int = 16, seed: int = 7) -> dict:
    """Adam on the logistic loss of whole texts; the two classes weigh the same."""
    rng = np.random.default_rng(seed)
    p = {"E": rng.normal(0, 0.5, (256, EMBED)), "W": rng.normal(0, 0.3, (WIDTH, EMBED, FILTERS)),
         "b": np.zeros(FILTERS), "u": rng.normal(0, 0.1, FILTERS), "c": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m = {k: np.zeros_like(v) for k, v in p.items()}
    s = {k: np.zeros_like(v) for k, v in p.items()}
    weight = np.where(labels == 1, 0.5 / max(labels.mean(), 1e-9), 0.5 / max(1 - labels.mean(), 1e-9))
    step = 0
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            g = {k: np.zeros_like(v) for k, v in p.items()}
            tables = np.einsum("be,kef->kbf", p["E"], p["W"])
            gt = np.zeros_like(tables)
            for i in order[at:at + batch]:
                a = _pad(texts[i])
                n = len(a) - WIDTH + 1
                z = tables[0][a[:n]]
                for k in range(1, WIDTH):
                    z += tables[k][a[k:k + n]]
                starts = list(range(0, max(1, n - HALF), HALF))
                where = np.stack([x + z[x:x + 2 * HALF].argmax(0) for x in starts])
                pooled = np.take_along_axis(z, where, 0) + p["b"]
                on = pooled > 0
                f = pooled * on
                logit = (f @ p["u"]).mean() + p["c"][0]
                d = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - labels[i]) * weight[i] / batch
                g["c"] += d
                g["u"] += d * f.mean(0)
                df = on * p["u"] * (d / len(starts))
                g["b"] += df.sum(0)
                cols = np.broadcast_to(np.arange(FILTERS), where.shape)
                for k in range(WIDTH):
                    np.add.at(gt[k], (a[where + k], cols), df)
            g["E"] = np.einsum("kbf,kef->be", gt, p["W"]) + 1e-5 * p["E"]
            g["W"] = np.einsum("be,kbf->kef", p["E"], gt) + 1e-5 * p["W"]
            step += 1
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.001 * (g[k] ** 2 - s[k])
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
    return p


def fitting(rows: list[tuple[int, int, int]], size: int) -> list[tuple[int, int]]:
    """(class, place) of the texts (class, place, bytes) that fit into `size` bytes a class, by place; the shortest where none fits."""
    out = []
    for q in sorted({r[0] for r in rows}):
        own, used = sorted((place, n) for c, place, n in rows if c == q), 0
        kept = []
        for place, n in own:
            if used + n <= size:
                used += n
                kept.append((q, place))
        out += kept or [(q, min(own, key=lambda x: x[1])[0])]
    return out


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS, size: int = TRAIN_BYTES) -> dict:
    """Learns labels.quality (1 or 0) from whole documents joined by doc_id.

    The sample is at most per_class documents of each class, those with the smallest hash of their
    id, and of them, in this order, each that still fits into `size` bytes a class; where none fits, the
    shortest one. Rows with both labels count for both. The bounded sample is fitted in one task; only
    the lengths of at most 2 * per_class texts and the weights come to the driver.
    """
    docs = has_columns(docs, "doc_id", "text")
    labels = has_columns(labels, "doc_id", "quality").where(F.col("doc_id").isNotNull()).join(docs.select("doc_id"), "doc_id", "left_semi")
    picked = None
    for q in (0, 1):
        part = labels.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    sample = docs.join(F.broadcast(picked), "doc_id").select(
        "quality", F.coalesce("text", F.lit("")).cast("binary").alias("raw"), F.xxhash64("doc_id").alias("h"),
        F.col("doc_id").cast("string").alias("key"))
    # One task ranks a bounded number of rows a class.
    by = Window.partitionBy("quality").orderBy("h", "key", "raw")
    sample = sample.withColumn("place", F.row_number().over(by)).where(F.col("place") <= per_class)
    lengths = sample.select("quality", "place", F.octet_length("raw").alias("n")).collect()
    chosen = docs.sparkSession.createDataFrame(fitting([tuple(r) for r in lengths], size), "quality int, place int")
    sample = sample.join(F.broadcast(chosen), ["quality", "place"], "left_semi")

    def learn(batches):
        parts = list(batches)
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True).sort_values(["h", "key", "raw", "quality"])
        y = pdf["quality"].to_numpy(np.float32)
        if len(y) and 0 < y.mean() < 1:
            p = fit([bytes(x) for x in pdf["raw"]], y)
            yield pd.DataFrame([(k, v.astype(np.float32).tobytes()) for k, v in p.items()], columns=["k", "v"])
        elif len(y):
            yield pd.DataFrame([("share", np.float32(y.mean()).tobytes())], columns=["k", "v"])

    got = (sample.select("h", "key", "raw", "quality").repartition(1)
           .mapInPandas(learn, "k string, v binary").collect())
    p = {r.k: np.frombuffer(bytes(r.v), np.float32) for r in got}
    if "E" not in p:
        return {"share": float(p["share"][0]) if "share" in p else 0.5}
    shape = {"E": (256, EMBED), "W": (WIDTH, EMBED, FILTERS)}
    return {k: v.reshape(shape.get(k, v.shape)) for k, v in p.items()}


def score(text: Column, model: dict) -> Column:
    """The probability of label 1, from the whole text."""
    if "share" in model:
        return F.lit(float(model["share"]))
    tables = np.einsum("be,kef->kbf", model["E"], model["W"]).astype(np.float32)
    bias, u, c = model["b"], model["u"].astype(np.float64), float(model["c"][0])

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            f = features((t or "").encode("utf-8", "replace"), tables, bias)
            x = float((f @ u).mean()) + c
            out.append(1 / (1 + np.exp(-np.clip(x, -30, 30))))
        return pd.Series(out, dtype="float64")

    return judge(text)


def held_out_quality(docs: DataFrame, labels: DataFrame, folds: int = 3, fold: int = 1) -> DataFrame:
    """Learns from rows whose crc32(doc_id) mod folds is not fold and scores all documents."""
    docs = has_columns(docs, "doc_id", "text")
    rest = id_crc() % folds
    model = train(docs, labels.where(rest != fold))
    scored = docs.select("doc_id", F.coalesce(rest == fold, F.lit(False)).alias("held_out"),
                         score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
