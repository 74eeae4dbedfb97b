"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong (base) spans are reported always: keyword assignments, access identifiers and long hex runs.
Weak candidates say little alone: account names, bare mixed tokens and endpoint addresses. They are
reported only when complementary parts lie within SCOPE code points of them in the same text, which
a binned interval join decides: a name needs a secret near it, a bare token needs an identifier or
an endpoint, an endpoint needs both an identifier and a secret. Base spans count as parts.

Matches are leftmost and non-overlapping per kind; spans count code points, end exclusive. The
starts come from the lengths of the pieces between the matches, since Spark's regular expressions
give texts but no places. Defined results: null text is empty text and has no spans; repeated rows
get equal spans; the spans of a text do not depend on doc_id. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import has_columns, saved

SCOPE = 200
BIN = 512
#: kind -> (pattern, a literal without which it can't match, role). Fixed values of the base kinds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
NAME = r"""(?i)(access_?id|client_?id|account|username|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,64})"""
BARE = r"[A-Za-z0-9+/_-]{32,}"
ENDPOINT = r"[a-z][a-z0-9+]{1,9}://[A-Za-z0-9.-]+(?::[0-9]{1,5})?"
KINDS = ("assign", "access", "hex", "name", "bare", "endpoint")
BASE = KINDS[:3]
IDENTIFIER, SECRET, PLACE = ("access", "name"), ("assign", "hex", "bare"), ("endpoint",)
STEP = 256
SPAN = "array<struct<s:int,k:int,e:int>>"


def _spans(text: Column, kind: str, pattern: str, may: Column, keep=None) -> Column:
    """array<struct<s,k,e>> of the pattern's matches; k is the kind's place in KINDS."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    k = F.lit(KINDS.index(kind))
    # The lengths of gap and match alternate, so a running end is enough. Arrays grow by copying: runs of
    # STEP matches are walked apart, each from the sum of the lengths before it.
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(found)).alias("g"), F.transform(found, F.length).alias("m"),
                         (found if keep is None else F.transform(found, keep)).alias("t"))
    none, zero = F.array().cast(SPAN), F.lit(0)

    def one(a: Column, x: Column) -> Column:
        more = F.array_append(a["out"], _span(a["at"] + x["g"], k, a["at"] + x["g"] + x["m"]))
        return F.struct((a["at"] + x["g"] + x["m"]).alias("at"),
                        (more if keep is None else F.when(x["t"], more).otherwise(a["out"])).alias("out"))

    def begins(z: Column) -> Column:
        sums = F.transform(_runs(z), lambda i: F.aggregate(
            _run(z, i), zero, lambda a, x: a + x["g"] + x["m"]))
        return F.aggregate(sums, F.struct(zero.alias("at"), F.array().cast("array<int>").alias("out")), lambda a, n: F.struct(
            (a["at"] + n).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])

    walk = F.transform(F.array(pairs), lambda z: F.flatten(F.transform(begins(z), lambda at, i: F.aggregate(
        _run(z, i), F.struct(at.alias("at"), none.alias("out")), one, lambda a: a["out"]))))[0]
    return F.when(may & text.rlike(pattern), walk).otherwise(F.array().cast(SPAN))


def _runs(z: Column) -> Column:
    return F.sequence(F.lit(0), ((F.size(z) - 1) / STEP).cast("int"))


def _run(z: Column, i: Column) -> Column:
    return F.slice(z, i * STEP + 1, F.lit(STEP))


def _cleared(text: Column, spans: Column, mark: str) -> Column:
    """text with each of its sorted spans replaced by the mark; a run of STEP spans works on its own part of the text."""
    def reached(z: Column) -> Column:  # where the text is done before each run, and after the last
        tops = F.transform(_runs(z), lambda i: F.aggregate(_run(z, i), F.lit(0), lambda a, x: F.greatest(a, x["e"])))
        return F.aggregate(tops, F.array(F.lit(0)), lambda a, n: F.array_append(a, F.greatest(F.element_at(a, -1), n)))

    def done(z: Column, at: Column, i: Column) -> Column:
        part = F.array(F.substring(text, at[i] + 1, at[i + 1] - at[i]))
        return F.transform(part, lambda p: F.aggregate(
            _run(z, i), F.struct(at[i].alias("at"), F.lit("").alias("out")), lambda a, x: F.struct(
                F.greatest(a["at"], x["e"]).alias("at"),
                F.when(x["s"] < a["at"], a["out"]).otherwise(
                    F.concat(a["out"], F.substring(p, a["at"] - at[i] + 1, x["s"] - a["at"]), F.lit(mark))).alias("out")),
            lambda a: a["out"]))[0]

    return F.transform(F.array(spans), lambda z: F.transform(F.array(reached(z)), lambda at: F.concat(
        F.array_join(F.transform(_runs(z), lambda i: done(z, at, i)), ""),
        F.substring(text, F.element_at(at, -1) + 1, F.length(text))))[0])[0]


def _span(s: Column, k: Column, e: Column) -> Column:
    return F.struct(s.cast("int").alias("s"), k.alias("k"), e.cast("int").alias("e"))


def _parts(text: Column) -> tuple[Column, Column]:
    sign = text.contains("=") | text.contains(":")
    strong = F.concat(
        _spans(text, "assign", ASSIGN, sign, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
        _spans(text, "access", ACCESS, text.contains("AKIA")),
        _spans(text, "hex", HEX, F.lit(True)))
    mixed = lambda m: (F.length(m) <= 128) & m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]")
    weak = F.concat(
        _spans(text, "name", NAME, sign),
        _spans(text, "bare", BARE, F.lit(True), mixed),
        _spans(text, "endpoint", ENDPOINT, text.contains("://")))
    return strong, weak


def _keyed(text: Column) -> Column:
    """struct<strong,weak,key>: the parts of text, and its key where parts may be linked."""
    strong, weak = _parts(text)
    return F.transform(F.array(F.struct(strong.alias("strong"), weak.alias("weak"))), lambda p: F.struct(
        p["strong"].alias("strong"), p["weak"].alias("weak"),
        F.when((F.size(p["weak"]) > 0) & (F.size(p["strong"]) + F.size(p["weak"]) > 1), F.sha2(text, 256)).alias("key")))[0]


def _role(k: Column) -> Column:
    at = lambda names: k.isin([KINDS.index(x) for x in names])
    return F.when(at(IDENTIFIER), "i").when(at(SECRET), "s").otherwise("p")


def _linked(rows: DataFrame) -> DataFrame:
    """(key, linked): the weak spans that have their complement near, per distinct text."""
    texts = rows.where(F.col("key").isNotNull()).select("key", "strong", "weak").dropDuplicates(["key"])
    parts = texts.select("key", F.explode(F.concat("strong", "weak")).alias("p")).select("key", "p.*")
    bins = lambda lo, hi: F.explode(F.sequence(F.floor(lo / BIN), F.floor(hi / BIN))).alias("bin")
    near = parts.select("key", F.col("s").alias("s2"), F.col("e").alias("e2"), _role(F.col("k")).alias("role"),
                        bins(F.greatest(F.col("s") - SCOPE, F.lit(0)), F.col("e") + SCOPE))
    weak = (texts.select("key", F.explode("weak").alias("p")).select("key", "p.*")
            .select("*", bins(F.col("s"), F.col("e"))))
    has = lambda r: F.max((F.col("role") == r).cast("int"))
    met = (weak.join(near, ["key", "bin"])
           .where((F.col("s2") <= F.col("e") + SCOPE) & (F.col("s") <= F.col("e2") + SCOPE)
                  & (F.col("role") != _role(F.col("k"))))
           .groupBy("key", "s", "k", "e").agg(has("i").alias("i"), has("s").alias("x"), has("p").alias("p")))
    role = _role(F.col("k"))
    ok = ((role == "i") & (F.col("x") == 1)) | ((role == "s") & ((F.col("i") == 1) | (F.col("p") == 1))) \
        | ((role == "p") & (F.col("i") == 1) & (F.col("x") == 1))
    return met.where(ok).groupBy("key").agg(F.collect_list(F.struct("s", "k", "e")).alias("linked"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans): arrays of struct<s,k,e> sorted by start, then kind; all by text."""
    docs = has_columns(docs, "doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = saved(docs.select("doc_id", _keyed(text).alias("parts")).select("doc_id", "parts.*"), "secret-parts")
    joined = rows.join(_linked(rows), "key", "left")
    base = F.array_sort("strong")
    return joined.select("doc_id", base.alias("base"), F.array_sort(
        F.concat("strong", F.coalesce("linked", F.array().cast(SPAN)))).alias("spans"))


def _text(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.col(spans), lambda x: F.concat_ws(
        ":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Counts by base kind, the digest of the base spans, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return scan(docs).select("doc_id", *map(count, BASE), F.sha2(_text("base"), 256).alias("base_sha256"),
                             _text("spans").alias("spans"))


def redact(docs: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """docs with every span of text that scan() reports, base or linked, replaced by the mark (overlapping spans by one).

    Other columns stay, but n_chars, where there is one, is counted anew. Only rows whose text may
    hold linked spans are joined with them, by the text's key; the rest is done in place.
    """
    own = "parts"
    while own in docs.columns:
        own += "_"
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = saved(docs.withColumn(own, _keyed(text)), "secret-rows")
    key = F.col(own)["key"]
    linked = _linked(rows.select(f"{own}.*")).select(F.col("key").alias(f"{own}_key"), F.col("linked").alias(f"{own}_linked"))
    open_ = rows.where(key.isNotNull()).join(linked, key == F.col(f"{own}_key"), "left")
    strong = F.col(own)["strong"]
    spans = F.concat(strong, F.coalesce(f"{own}_linked", F.array().cast(SPAN)))
    return _marked(rows.where(key.isNull()), docs, strong, mark).unionByName(_marked(open_, docs, spans, mark))


def _marked(rows: DataFrame, docs: DataFrame, spans: Column, mark: str) -> DataFrame:
    """rows with the columns of docs and the spans of text replaced by the mark."""
    text = F.coalesce(F.col("text"), F.lit(""))
    done = _cleared(text, F.array_sort(spans), mark)
    rows = rows.withColumn("text", F.when(F.size(spans) > 0, done).otherwise(F.col("text"))).select(docs.columns)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows
