"""Normalisation of sequence variants: trimming, shift range, category, and back to plain forms.

Coordinates are 0-based and half-open. Every input row gives one output row; a failure leaves the
normal form null and fills `error` with a type and a message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions import sequences as S
from varloom.functions.sequences import let
from varloom.session import saved

from .intervals import CHUNK, MARGIN, lookup_sequence

NON_SHIFTABLE, SHIFTABLE_INSERTION, DUPLICATION, SHIFTABLE_DELETION = 0, 1, 2, 3
MAX_LENGTH = 10_000
NORMAL = ["n_left", "n_right", "category", "length_change", "inserted", "original"]


def error(kind: str, message: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), message.cast("string").alias("message"))


def trimmed(org: Column, alt: Column) -> Column:
    """struct<prefix,suffix,org,alt>: the common suffix cut first, then the prefix; identities stay whole."""
    cut = lambda c, k: F.substring(c, F.lit(1), F.length(c) - k)
    tail = lambda c, p, k: F.substring(c, p + 1, F.length(c) - k - p)
    return let(F.when(org == alt, 0).otherwise(S.lcp(F.reverse(org), F.reverse(alt))), lambda k: let(
        F.when(org == alt, 0).otherwise(S.lcp(cut(org, k), cut(alt, k))), lambda p: F.struct(
            p.alias("prefix"), k.alias("suffix"), tail(org, p, k).alias("org"), tail(alt, p, k).alias("alt"))))


def trim_alleles(df: DataFrame, org: str = "org", alt: str = "alt") -> DataFrame:
    """Adds prefix, suffix, org2, alt2."""
    return df.withColumn("__t", trimmed(F.col(org), F.col(alt))).withColumns({
        "prefix": F.col("__t.prefix"), "suffix": F.col("__t.suffix"), "org2": F.col("__t.org"), "alt2": F.col("__t.alt")}).drop("__t")


def _checks(org: Column, alphabet: str) -> Column:
    return F.coalesce(
        F.when(F.col("ref_len").isNull(), error("UnknownReferenceSequence", F.col("ref_id"))),
        F.when((F.col("left") < 0) | (F.col("right") < F.col("left")) | (F.col("right") > F.col("ref_len")),
               error("OutOfReference", F.concat_ws("-", "left", "right"))),
        F.when(F.greatest(F.col("right") - F.col("left"), F.length("alt")) > MAX_LENGTH,
               error("VariationTooLong", F.greatest(F.col("right") - F.col("left"), F.length("alt")))),
        F.when((F.coalesce(F.col("ref"), F.lit("")) != "") & (F.col("ref") != org),
               error("IncorrectReferenceAllele", F.concat_ws(" ", F.lit("given"), F.col("ref"), F.lit("actual"), org))),
        F.when(~F.col("alt").rlike(f"^[{alphabet}]*$"), error("IncorrectSequence", F.col("alt"))))


def _in_context(df: DataFrame, window: int, alphabet: str, keep: list[str]) -> DataFrame:
    """keep, the normal form, error, ref_len and __open (the context was too short) from ctx, ctx_left.

    The letters within the window are cut out once; all else works on them. Each step's columns feed the next: a value is computed
    once, and letters are compared in plain expressions.
    """
    rows = [F.col(c) for c in keep] + [F.col("ref_len")]
    inside = F.col("left") - F.col("ctx_left")
    skip = F.greatest(inside - window, F.lit(0))
    df = df.select(*rows, (F.col("ctx_left") + F.length("ctx")).alias("__last"), (F.col("ctx_left") + skip).alias("__off"),
                   F.substring("ctx", (skip + 1).cast("int"), (inside - skip + F.greatest(F.col("right") - F.col("left"), F.lit(0)) + window).cast("int")).alias("__ctx"))
    off, ctx = F.col("__off"), F.col("__ctx")
    wide = F.col("ref_len").isNotNull() & (F.col("right") > F.col("__last")) & (F.col("right") <= F.col("ref_len"))
    org = F.substring(ctx, (F.col("left") - off + 1).cast("int"), F.greatest(F.col("right") - F.col("left"), F.lit(0)).cast("int"))
    df = df.select(*rows, off, ctx, F.coalesce(wide, F.lit(False)).alias("__wide"), F.coalesce(org, F.lit("")).alias("__org"))
    df = df.select("*", _checks(F.col("__org"), alphabet).alias("__error"))
    # Rows with errors, and those without their letters, go on without texts.
    fine = F.col("__error").isNull() & ~F.col("__wide")
    df = df.select(*rows, off, ctx, "__wide", "__error", F.when(fine, F.col("__org")).alias("__org"), F.when(fine, F.col("alt")).alias("__alt"))
    none = F.col("__alt").isNull() & F.col("__org").isNotNull()
    differ = F.when(none, False).otherwise(F.col("__org") != F.col("__alt"))
    df = df.withColumns({"__x": F.when(differ, F.reverse("__org")).when(~differ, ""), "__y": F.when(differ, F.reverse("__alt")).when(~differ, "")})
    df = df.withColumn("__k", S.lcp_short("__x", "__y"))
    cut = lambda c: F.when(differ, F.substring(c, F.lit(1), F.length(c) - F.col("__k"))).when(~differ, "")
    df = df.withColumns({"__x": cut("__org"), "__y": cut("__alt")})
    df = df.withColumn("__p", S.lcp_short("__x", "__y"))
    tail = lambda c: F.substring(c, F.col("__p") + 1, F.length(c) - F.col("__k") - F.col("__p"))
    carry = [*rows, "__wide", "__error"]
    df = df.select(*carry, off, ctx, tail("__org").alias("__org"), tail("__alt").alias("__alt"),
                   (F.col("left") + F.col("__p")).alias("__l0"), (F.col("right") - F.col("__k")).alias("__r0"))
    org, alt, l0, r0 = (F.col(c) for c in ("__org", "__alt", "__l0", "__r0"))
    pattern = F.when(none | ((F.length(org) > 0) & (F.length(alt) > 0)), "").otherwise(F.concat(org, alt))
    carry += ["__org", "__alt", "__l0", "__r0", "__pattern"]
    before = F.substring(ctx, F.greatest((l0 - off).cast("int") - window, F.lit(0)) + 1, F.least((l0 - off).cast("int"), F.lit(window)))
    df = df.withColumn("__pattern", pattern).select(*carry, F.when(F.length("__pattern") > 0, F.reverse(before)).otherwise("").alias("__l"),
                                                    F.when(F.length("__pattern") > 0, F.substring(ctx, (r0 - off + 1).cast("int"), F.lit(window))).otherwise("").alias("__r"))
    # The change moves while the letters it passes repeat it; its copies are written out only where one letter does.
    turned = F.reverse("__pattern")
    copies = lambda p, c: F.when(F.substring(p, 1, 1) == F.substring(c, 1, 1), S.tile(p, F.length(c))).otherwise("")
    df = df.withColumns({"__tl": copies(turned, "__l"), "__tr": copies(F.col("__pattern"), "__r")})
    df = df.withColumns({"__sl": S.lcp_short("__l", "__tl"), "__sr": S.lcp_short("__r", "__tr")})
    sl, sr, n = F.col("__sl"), F.col("__sr"), F.length("__alt")
    some = F.length("__pattern") > 0
    over = ((some & (sl == F.length("__l")) & (l0 - sl > 0)) | (some & (sr == F.length("__r")) & (r0 + sr < F.col("ref_len"))))
    category = F.when(F.col("__pattern").isNull(), None).when((F.length("__pattern") == 0) | (sl + sr == 0), NON_SHIFTABLE).when(n > sl + sr, SHIFTABLE_INSERTION) \
        .when(n > 0, DUPLICATION).when(n == 0, SHIFTABLE_DELETION)
    df = df.select(*carry, "__sl", "__sr", F.coalesce(over, F.lit(False)).alias("__over"), category.alias("__c"))
    df = df.withColumn("__turned", F.when(F.col("__c") != NON_SHIFTABLE, S.rotate_right(F.col("__pattern"), sl)))
    c = F.col("__c")
    form = {"n_left": l0 - sl, "n_right": r0 + sr, "category": c,
            "length_change": F.when(c >= DUPLICATION, F.length("__pattern")).when(c.isNotNull(), 0).cast("long"),
            "inserted": F.when(c == NON_SHIFTABLE, alt).when(c == SHIFTABLE_INSERTION, F.substring(alt, sr + 1, n - sl - sr)).when(c.isNotNull(), ""),
            "original": F.when(c == NON_SHIFTABLE, org).when(c == SHIFTABLE_INSERTION, F.substring("__turned", F.lit(1), sl + sr)).when(c.isNotNull(), F.col("__turned"))}
    return df.select(*keep, *(form[x].alias(x) for x in NORMAL), F.when(~F.col("__wide"), F.col("__error")).alias("error"), "ref_len",
                     (F.col("__wide") | F.col("__over")).alias("__open"))


def normalize(variants: DataFrame, chunks: DataFrame, rounds: int = 8, alphabet: str = "ACGT", few: bool = False) -> DataFrame:
    """variants(ref_id, left, right, ref, alt, ...) with the normal form and error.

    One equi-join with the chunk that holds the variant's start gives its context. Rows whose shift
    range or allele passes the context go through rounds with ever wider contexts; their number
    falls fast, and the loop ends when none is left. `few`: the chunks are those of a few short texts; they go to the rows, which
    would lie in a few tasks if they were dealt by chunk.
    """
    keep = variants.columns
    # Dealt by the join's key: rows of a chunk meet it in one place, and the letters' work is spread.
    df = variants.withColumn("__chunk", F.floor(F.col("left") / CHUNK))
    texts = chunks.withColumnRenamed("chunk_no", "__chunk")
    df = (df if few else df.repartition("ref_id", "__chunk")).join(F.broadcast(texts) if few else texts, ["ref_id", "__chunk"], "left")
    cols = [*keep, *NORMAL, "error"]
    # Written once: the finished rows and the open ones both come from here.
    near = saved(_in_context(df, MARGIN, alphabet, keep), "normal")
    done = near.where(~F.col("__open")).select(cols)
    rest = near.where(F.col("__open")).select(*keep, "ref_len")
    if not rest.take(1):
        return done
    return done.unionByName(_wide(rest, chunks, keep, cols, 1024, rounds, alphabet))


def _wide(rest: DataFrame, chunks: DataFrame, keep: list[str], cols: list[str], window: int, rounds: int,
          alphabet: str) -> DataFrame:
    """The rows whose context must be wider, by sequence lookup; the last round sees whole references."""
    key = F.sha2(F.to_json(F.struct("ref_id", "left", "right", "alt")), 256)
    rest = rest.withColumn("__key", key)
    size = window if rounds > 1 else 1 << 30
    ask = rest.select("__key", "ref_id", F.greatest(F.col("left") - size, F.lit(0)).alias("left"),
                      F.least(F.col("right") + size, F.col("ref_len")).alias("right")).dropDuplicates(["__key"])
    ctx = lookup_sequence(ask, chunks, "__key").withColumnRenamed("seq", "ctx").join(
        ask.select("__key", F.col("left").alias("ctx_left")), "__key")
    got = saved(_in_context(rest.join(ctx, "__key"), size, alphabet, keep), "normal")
    done = got.where(~F.col("__open")).select(cols)
    if rounds <= 1:
        return done
    left = got.where(F.col("__open")).select(*keep, "ref_len")
    if not left.take(1):
        return done
    return done.unionByName(_wide(left, chunks, keep, cols, window * 8, rounds - 1, alphabet))


def variant_key(prefix: str = "") -> Column:
    """Equality key of a normal form: the original sequence takes no part. The first 22 characters (132 bits) of its SHA-256 in base64."""
    c = lambda x: F.col(prefix + x)
    whole = F.sha2(F.concat_ws("|", c("ref_id").cast("string"), c("n_left").cast("string"), c("n_right").cast("string"),
                               c("category").cast("string"), c("length_change").cast("string"), c("inserted")), 256)
    return F.substring(F.base64(F.unhex(whole)), 1, 22)


def definition_order() -> list[Column]:
    """Sort order of definitions: inserted sequences by length, then text."""
    return [F.col("ref_id"), F.col("n_left"), F.col("n_right"), F.col("category"), F.col("length_change"),
            F.length("inserted"), F.col("inserted")]


def left_aligned(df: DataFrame) -> DataFrame:
    """Adds p_left, p_right, p_ref, p_alt: the plain form furthest to the left."""
    c, k, o = F.col("category"), F.col("length_change"), F.col("original")
    return df.withColumns({
        "p_left": F.col("n_left"),
        "p_right": F.when(c == NON_SHIFTABLE, F.col("n_right")).when(c == SHIFTABLE_DELETION, F.col("n_left") + k).otherwise(F.col("n_left")),
        "p_ref": F.when((c == NON_SHIFTABLE) | (c == SHIFTABLE_DELETION), o).otherwise(F.lit("")),
        "p_alt": F.when(c == NON_SHIFTABLE, F.col("inserted")).when(c == SHIFTABLE_INSERTION, F.concat(o, "inserted"))
        .when(c == DUPLICATION, S.tile(o, k)).otherwise(F.lit(""))})


def right_aligned(df: DataFrame) -> DataFrame:
    """Adds p_left, p_right, p_ref, p_alt: the plain form furthest to the right, texts rotated to their place."""
    c, k, o = F.col("category"), F.col("length_change"), F.col("original")
    turned = S.rotate_left(o, F.col("n_right") - F.col("n_left") - k)
    return df.withColumns({
        "p_right": F.col("n_right"),
        "p_left": F.when(c == NON_SHIFTABLE, F.col("n_left")).when(c == SHIFTABLE_DELETION, F.col("n_right") - k).otherwise(F.col("n_right")),
        "p_ref": F.when(c == NON_SHIFTABLE, o).when(c == SHIFTABLE_DELETION, turned).otherwise(F.lit("")),
        "p_alt": F.when(c == NON_SHIFTABLE, F.col("inserted")).when(c == SHIFTABLE_INSERTION, F.concat("inserted", o))
        .when(c == DUPLICATION, S.rotate_left(o, F.col("n_right") - F.col("n_left"))).otherwise(F.lit(""))})


def merge_modifications(mods: DataFrame, keys: list[str]) -> DataFrame:
    """Haplotypes: equal regions merge (deletions, or duplications), overlaps are errors.

    (keys, mods array<struct>, error) from one row a modification, each in normal form.
    """
    one = F.struct("n_left", "n_right", F.length("inserted").alias("n"), "inserted", "category", "length_change", "original")
    rows = mods.groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("mods"))
    may = lambda a, b: (a["n_left"] == b["n_left"]) & (a["n_right"] == b["n_right"]) & (
        a["category"] == b["category"]) & (a["category"] >= DUPLICATION)
    merged = F.aggregate(
        "mods", F.slice("mods", 1, 0),
        lambda acc, m: F.when((F.size(acc) > 0) & may(F.element_at(acc, -1), m), F.concat(
            F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
                m["n_left"].alias("n_left"), m["n_right"].alias("n_right"), m["n"].alias("n"), m["inserted"].alias("inserted"),
                m["category"].alias("category"), (F.element_at(acc, -1)["length_change"] + m["length_change"]).alias("length_change"),
                F.concat(F.element_at(acc, -1)["original"], m["original"]).alias("original")))))
        .otherwise(F.concat(acc, F.array(m))))
    rows = rows.withColumn("mods", merged)
    clash = F.exists(F.zip_with(F.slice("mods", F.lit(1), F.greatest(F.size("mods") - 1, F.lit(0))),
                                F.slice("mods", F.lit(2), F.greatest(F.size("mods") - 1, F.lit(0))), lambda a, b:
                                (a["n_right"] > b["n_left"]) | (a["n_left"] == b["n_left"])), lambda x: x)
    return rows.withColumn("error", F.when(clash, error("OverlappingModifications", F.lit(""))))


def canonicalize_protein(variants: DataFrame, chunks: DataFrame) -> DataFrame:
    """Normal forms of single protein changes: as for nucleotides, over residues and the stop."""
    return normalize(variants, chunks, alphabet="A-Z*")


def expand_repeats(df: DataFrame, chunks: DataFrame) -> DataFrame:
    """rows(ref_id, left, unit, n, ...): unit[n] at `left`, how many copies stand there, and the plain change.

    Adds copies, right and alt: fewer copies delete, equal ones change nothing, more insert. A run goes
    on for as far as an insertion of the unit may move to the right, so its length has no limit.
    """
    k = F.length("unit")
    rows = df.select("*", F.col("left").alias("right"), F.lit("").alias("ref"), F.col("unit").alias("alt"))
    df = normalize(rows, chunks).select(*df.columns, F.floor((F.col("n_right") - F.col("left")) / k).cast("long").alias("copies"))
    have, want = F.col("copies"), F.col("n")
    return df.withColumn("right", F.col("left") + have * k).withColumn(
        "alt", F.call_function("repeat", F.col("unit"), want.cast("int"))).withColumn(
        "kind", F.when(want < have, "deletion").when(want == have, "identity").otherwise("insertion"))


def expand_hgvs_sequences(parts: DataFrame, chunks: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, alt) from ordered parts: literal texts, copied ranges and inverted ranges of a reference."""
    ask = parts.where(F.col("literal").isNull()).select(F.concat_ws("#", key, "idx").alias("__k"), "ref_id", "left", "right")
    seq = lookup_sequence(ask, chunks, "__k")
    rows = parts.withColumn("__k", F.concat_ws("#", key, "idx")).join(seq, "__k", "left")
    text = F.coalesce("literal", F.when(F.col("inverted"), S.reverse_complement(F.col("seq"))).otherwise(F.col("seq")), F.lit(""))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(
        F.struct("idx", text.alias("t")))), lambda x: x["t"]), "").alias("alt"))
