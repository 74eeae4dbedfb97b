"""Language identification with hyperdimensional letter n-gram profiles.

Every letter has a fixed random +-1 vector. A trigram's vector binds (multiplies) the vectors of
its letters, permuted (rolled) by their place; a document bundles (adds) the vectors of all its
trigrams; a language's prototype bundles the unit vectors of its training documents. The predicted
language is the prototype with the highest cosine.

Defined results: null text or text without letters gives `und` and score 0; ties go to the
alphabetically first language; without any training row every text is `und`. Each row is judged
alone, so repeated rows get equal results. Columns other than those named are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import has_columns, id_crc

DIM = 512
SYMBOLS = 256
#: Training rows a language, about: rows are kept by a hash of their id once a language has more.
TRAIN_ROWS = 4000
#: A label set larger than this is taken for a mistake: prototypes are held by every task.
MAX_LANGS = 4096
UNDETERMINED = "und"
#: Cosines of unrelated texts scatter by this, whatever their length.
SCATTER = 1 / math.sqrt(DIM)
#: What the best cosine of a text in a known language exceeds, in scatters: it rises with its trigrams, from
#: -LOW for none (any scatter will do) to RISE - LOW for many; HALF trigrams bring it to RISE / sqrt(2) - LOW.
RISE, LOW, HALF = 5.5, 2.25, 64


@lru_cache(1)
def _symbols() -> np.ndarray:
    """Code point -> symbol: 0 for what is no letter, 1..26 a-z, others spread over the rest."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        if not 0xD800 <= cp < 0xE000 and chr(cp).isalpha():
            table[cp] = cp - 96 if 97 <= cp <= 122 else 27 + (cp * 2654435761 >> 7) % (SYMBOLS - 27)
    return table


@lru_cache(1)
def _letters() -> tuple[np.ndarray, ...]:
    v = np.random.default_rng(20240607).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIM))
    return tuple(np.ascontiguousarray(np.roll(v, k, 1)) for k in (2, 1, 0))


def hypervector(text: str | None) -> np.ndarray | None:
    """The bundled trigram vectors of the whole text; None without a letter."""
    return bundle(text)[0]


def bundle(text: str | None) -> tuple[np.ndarray | None, int]:
    """The hypervector of the whole text and the number of its trigrams."""
    if not text:
        return None, 0
    s = _symbols()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
    if not s.any():
        return None, 0
    s = np.concatenate(([0], s, [0])).astype(np.uint32)
    s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
    grams, counts = np.unique(s[:-2] << 16 | s[1:-1] << 8 | s[2:], return_counts=True)
    a, b, c = _letters()
    out = np.zeros(DIM, np.float32)
    for i in range(0, len(grams), 4096):
        g = grams[i:i + 4096]
        v = a[g >> 16] * b[g >> 8 & 255] * c[g & 255]
        out += counts[i:i + 4096].astype(np.float32) @ v.astype(np.float32)
    n = np.sqrt(out @ out)
    return (out / n if n else None), len(s) - 2


def least_cosine(grams: int) -> float:
    """The least best cosine of a text of so many trigrams that counts as one in a known language."""
    return SCATTER * (RISE * math.sqrt(grams / (grams + HALF)) - LOW)


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Prototypes from (doc_id, text, lang) rows: about `rows` of each language, chosen by id."""
    docs = has_columns(docs, "doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r.lang: r.n for r in docs.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages")
    if not sizes:
        return [], np.zeros((0, DIM), np.float32)
    step = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, math.ceil(n / rows))])
    kept = docs.where(F.pmod(F.xxhash64("doc_id"), step[F.col("lang")]) == 0).select("lang", "text")

    def sums(batches):
        part: dict[str, np.ndarray] = {}
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                v = hypervector(text)
                if v is not None:
                    part[lang] = part.get(lang, 0) + np.rint(v * 2**20).astype(np.int64)
        for lang, v in part.items():
            yield pd.DataFrame({"lang": lang, "i": np.arange(DIM, dtype=np.int32), "x": v})

    got = kept.mapInPandas(sums, "lang string, i int, x long").groupBy("lang", "i").agg(F.sum("x").alias("x")).toPandas()
    langs = sorted(set(got["lang"]))
    proto = np.zeros((len(langs), DIM))
    for k, lang in enumerate(langs):
        g = got[got["lang"] == lang]
        proto[k, g["i"]] = g["x"]
    norm = np.linalg.norm(proto, axis=1, keepdims=True)
    return langs, (proto / np.where(norm, norm, 1)).astype(np.float32)


def predict(text: Column, model: tuple[list[str], np.ndarray]) -> Column:
    """struct<lang_pred string, score double, known boolean>: the best prototype, its cosine, 0 to 1, and whether
    the cosine is enough for a text of so many trigrams."""
    langs, proto = model

    @F.pandas_udf("lang_pred string, score double, known boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            v, grams = bundle(t) if langs else (None, 0)
            if v is None:
                rows.append((UNDETERMINED, 0.0, False))
            else:
                cos = proto @ v
                k = int(cos.argmax())
                rows.append((langs[k], float(min(1.0, max(0.0, cos[k]))), bool(cos[k] >= least_cosine(grams))))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "known"])

    return judge(text)


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], out: str = "langid") -> DataFrame:
    """All columns of docs and the struct column `out`."""
    return docs.withColumn(out, predict(F.col("text"), model))


def in_known_language(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """The rows of docs whose best prototype has the cosine that least_cosine() asks for; their columns stay as they are."""
    return docs.where(predict(F.col("text"), model)["known"])


def held_out_languages(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learns from documents whose crc32(doc_id) mod folds is not 0 and predicts all documents."""
    docs = has_columns(docs, "doc_id", "text", "lang")
    rest = id_crc() % folds
    model = train(docs.where(rest != 0))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "langid.lang_pred", "langid.score")
