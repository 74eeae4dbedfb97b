"""Variant expressions as bulk column jobs: HGVS, MyVariant, ExAC/gnomAD and short ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varloom.functions import sequences as S
from varloom.session import saved

from .liftover import to_spliced
from .normalize import DUPLICATION, right_aligned

POSITION = r"([-*]?[0-9]+)([+-][0-9]+)?"
FULL = r"^([^:]+):([cgmnpr])\.(.+)$"
#: After a position or a range: substitution, identity, del, dup, ins, delins, inv and repeats.
CHANGE = r"^" + POSITION + r"(?:_" + POSITION + r")?(?:([ACGT]+)>([ACGT]+)|([ACGT]*)(=)|del([ACGT]*|[0-9]+)ins([ACGT]+)|(delins)([ACGT]+)|(del)([ACGT]*|[0-9]*)|(dup)([ACGT]*|[0-9]*)|(ins)([ACGT]+)|(inv)|([ACGT]+)\[([0-9]+)\])$"
PROTEIN = r"^\(?([A-Z][a-z]{2}|[A-Z*])([0-9]+)(?:_([A-Z][a-z]{2}|[A-Z*])([0-9]+))?(?:(=)|(delins|ins|del|dup)((?:[A-Z][a-z]{2}|[A-Z*])*)|([A-Z][a-z]{2}|[A-Z*])(fs.*)?)\)?$"


def parse_hgvs(df: DataFrame, col: str = "hgvs") -> DataFrame:
    """A row a change of every expression (row_id, col): ref_name, kind, idx, positions, op, given, alt, n, error.

    Haplotypes [a;b] give a row each. What no form fits has error HgvsParsingError and the place
    where the form breaks off: after the reference, after the type, or at the change.
    """
    def groups(text: Column, form: str, n: int, fits: Column) -> Column:
        """The n groups of a form that a text fits, from one pass; n empty texts where it does not. Only the last group of a form may hold tabs, and is then asked for its presence alone."""
        return F.when(fits, F.split(F.regexp_replace(text, form, "\t".join(f"${i}" for i in range(1, n + 1)) + "\t"), "\t")).when(
            fits.isNotNull(), F.array_repeat(F.lit(""), n))

    ref, kind, body = (F.regexp_extract(col, FULL, i) for i in (1, 2, 3))
    rows = df.select("row_id", col, ref.alias("ref_name"), kind.alias("kind"), body.alias("body"))
    inner = F.when(F.col("body").rlike(r"^\[.*\]$"), F.expr("substring(body, 2, length(body) - 2)")).otherwise(F.col("body"))
    rows = rows.withColumn("inner", inner).select("*", F.posexplode(F.split("inner", ";")).alias("idx", "change"))
    rows = rows.withColumns({"__c": F.col("change").rlike(CHANGE), "__q": F.col("change").rlike(PROTEIN)})
    rows = rows.withColumns({"__g": groups(F.col("change"), CHANGE, 21, F.col("__c")), "__p": groups(F.col("change"), PROTEIN, 9, F.col("__q"))})
    g = lambda i: F.nullif(F.get("__g", F.lit(i - 1)), F.lit(""))
    fits = F.col("__c") & (F.col("kind") != "p")
    digits = lambda x: F.when(x.rlike("^[0-9]+$"), x.try_cast("long"))
    op = F.when(g(6).isNotNull(), "snv").when(g(8).isNotNull(), "identity").when(g(10).isNotNull() | g(11).isNotNull(), "delins") \
        .when(g(13).isNotNull(), "del").when(g(15).isNotNull(), "dup").when(g(17).isNotNull(), "ins").when(g(19).isNotNull(), "inv") \
        .when(g(20).isNotNull(), "repeat")
    letters = F.coalesce(g(5), g(7), g(9), g(14), g(16))
    p = lambda i: F.nullif(F.get("__p", F.lit(i - 1)), F.lit(""))
    p_fits = F.col("__q") & (F.col("kind") == "p")
    p_op = F.when(p(5).isNotNull(), "identity").when(p(6).isNotNull(), p(6)).when(p(9).isNotNull(), "frameshift").otherwise("snv")
    one = lambda x: F.when(F.length(x) == 3, S.one_letter(x)).otherwise(x)
    p_seq = F.when(p(7).rlike("[a-z]"), S.one_letter(p(7))).otherwise(p(7))
    pick = lambda a, b: F.when(fits, a).when(p_fits, b)
    at = F.when(F.col("ref_name") == "", 0).when(~F.col("kind").isin(*"cgmnpr"), F.length("ref_name") + 1).otherwise(F.length("ref_name") + 3)
    bad = ~(F.coalesce(fits, F.lit(False)) | F.coalesce(p_fits, F.lit(False)))
    return rows.select(
        "row_id", F.nullif("ref_name", F.lit("")).alias("ref_name"), F.nullif("kind", F.lit("")).alias("kind"), F.col("idx").try_cast("long").alias("idx"),
        pick(g(1), p(2)).alias("pos1"), pick(F.coalesce(g(2).try_cast("long"), F.lit(0)), F.lit(0)).alias("off1"),
        pick(F.coalesce(g(3), g(1)), F.coalesce(p(4), p(2))).alias("pos2"),
        pick(F.coalesce(F.when(g(3).isNotNull(), g(4)).otherwise(g(2)).try_cast("long"), F.lit(0)), F.lit(0)).alias("off2"),
        pick(op, p_op).alias("op"), pick(F.when(letters.rlike("^[ACGT]+$"), letters), F.concat(one(p(1)), F.coalesce(one(p(3)), F.lit("")))).alias("given"),
        pick(F.coalesce(g(6), g(10), g(12), g(18), g(20)), F.coalesce(p_seq, one(p(8)))).alias("alt"),
        pick(F.coalesce(g(21).try_cast("long"), digits(letters)), F.lit(None).try_cast("long")).alias("n"),
        F.when(bad, F.concat(F.lit("HgvsParsingError at "), at.cast("string"))).alias("error"))


def resolve_hgvs(changes: DataFrame, refs: DataFrame) -> DataFrame:
    """parse_hgvs rows with ref_id and 0-based left, right in the reference's own space.

    refs(ref_name, ref_id, length, cds_left, cds_right). c. positions count from the coding start,
    -n lies before it, *n after its end; n., r., g., m. and p. count from 1. Intronic offsets stay
    in off1, off2 (of spliced references; resolve them with liftover.to_unspliced). An insertion
    needs a range of two neighbours; frameshifts can't be placed; ends outside are errors.
    """
    got = changes.join(refs, "ref_name", "left")

    def place(c: str) -> Column:
        n = F.regexp_extract(c, "([0-9]+)$", 1).try_cast("long")
        sign = F.substring(c, 1, 1)
        coding = F.when(sign == "-", F.col("cds_left") - n).when(sign == "*", F.col("cds_right") + n - 1).otherwise(F.col("cds_left") + n - 1)
        return F.when(F.col("kind") == "c", coding).when(sign.isin("-", "*"), None).otherwise(n - 1)

    got = got.withColumn("a", place("pos1")).withColumn("b", place("pos2"))
    ins = F.col("op") == "ins"
    bad = F.coalesce(
        F.col("error"), F.when(F.col("ref_id").isNull(), "UnknownReferenceName"),
        F.when(F.col("op") == "frameshift", "FrameshiftNotSupported"),
        F.when(F.col("a").isNull() | F.col("b").isNull(), "IncorrectPosition"),
        F.when(ins & ((F.col("b") - F.col("a") != 1) & (F.col("off1") == 0) & (F.col("off2") == 0)), "InsertionNeedsNeighbours"),
        F.when((F.col("a") < 0) | (F.col("b") >= F.col("length")) | (F.col("b") < F.col("a")), "OutOfReference"))
    got = got.withColumn("error", bad)
    ok = F.col("error").isNull()
    left = F.when(ins, F.col("a") + 1).when(F.col("op") == "dup", F.col("b") + 1).otherwise(F.col("a"))
    right = F.when(ins, F.col("a") + 1).otherwise(F.col("b") + 1)
    return got.select(*changes.columns[:-1], "ref_id", F.when(ok, left).alias("left"), F.when(ok, right).alias("right"), "error")


def _at(first: Column, last: Column) -> Column:
    """Positions from 1, one or a range."""
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("_", first.cast("string"), last.cast("string")))


def genomic_change(df: DataFrame) -> DataFrame:
    """Adds `change`: the text of one normal form, right-aligned."""
    df = right_aligned(df)
    k, l, r = F.col("length_change"), F.col("p_left"), F.col("p_right")
    nr, na = F.length("p_ref"), F.length("p_alt")
    dup = (F.col("category") == DUPLICATION) & (F.col("n_right") - F.col("n_left") >= k)
    text = F.when(dup, F.concat(_at(F.col("n_right") - k + 1, F.col("n_right")), F.lit("dup"))) \
        .when((nr == 1) & (na == 1) & (F.col("p_ref") == F.col("p_alt")), F.concat(r.cast("string"), "p_ref", F.lit("="))) \
        .when((nr == 1) & (na == 1), F.concat(r.cast("string"), "p_ref", F.lit(">"), "p_alt")) \
        .when(nr == 0, F.concat(l.cast("string"), F.lit("_"), (r + 1).cast("string"), F.lit("ins"), "p_alt")) \
        .otherwise(F.concat(_at(l + 1, r), F.lit("del"), F.when(na > 0, F.concat(F.lit("ins"), "p_alt")).otherwise(F.lit(""))))
    return df.withColumn("change", text).drop("p_left", "p_right", "p_ref", "p_alt")


def format_hgvs_genomic(df: DataFrame, kind: Column | str = "g") -> DataFrame:
    """(variant id columns row_id, ref_id) and hgvs: changes of one row in order, several in brackets."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    rows = genomic_change(df).withColumn("kind", kind)
    one = rows.groupBy("row_id", "ref_id", "kind").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_left", "n_right", "change"))), lambda x: x["change"]).alias("c"))
    text = F.when(F.size("c") == 1, F.get("c", F.lit(0))).otherwise(F.concat(F.lit("["), F.array_join("c", ";"), F.lit("]")))
    return one.select("row_id", "ref_id", F.concat(F.col("ref_id").cast("string"), F.lit(":"), "kind", F.lit("."), text).alias("hgvs"))


def format_hgvs_spliced(df: DataFrame, exons: DataFrame, transcripts: DataFrame) -> DataFrame:
    """(row_id, ref_id, hgvs, error): normal forms in the unspliced space of transcripts, as c. or n. expressions with intron offsets.

    df(row_id, ref_id, normal form), distinct changes of a row in one text; exons(transcript, n, u_left, u_right, s_left, s_right);
    transcripts(ref_id, ref_name, cds_left, cds_right) in spliced places, null ends for n. A letter of an intron is named from the nearer exon,
    from the later one when it stands in the middle. -n lies before the coding region, *n behind it. Errors: UnknownReferenceName, and
    OutOfReference where a letter to be named lies outside the transcript.
    """
    rows = right_aligned(df)
    k, l, r = F.col("length_change"), F.col("p_left"), F.col("p_right")
    nr, na = F.length("p_ref"), F.length("p_alt")
    dup = (F.col("category") == DUPLICATION) & (F.col("n_right") - F.col("n_left") >= k)
    first = F.when(dup, F.col("n_right") - k + 1).when(nr == 0, l).otherwise(l + 1)
    last = F.when(dup, F.col("n_right")).when(nr == 0, r + 1).otherwise(r)
    tail = F.when(dup, "dup").when((nr == 1) & (na == 1), F.concat("p_ref", F.when(F.col("p_ref") == F.col("p_alt"), "=").otherwise(F.concat(F.lit(">"), "p_alt")))) \
        .when(nr == 0, F.concat(F.lit("ins"), "p_alt")).otherwise(F.concat(F.lit("del"), F.when(na > 0, F.concat(F.lit("ins"), "p_alt")).otherwise(F.lit(""))))
    change = F.struct("n_left", "n_right", tail.alias("tail"))
    ends = F.array(F.struct(F.lit(0).alias("side"), first.alias("u")), F.struct(F.lit(1).alias("side"), last.alias("u")))
    points = rows.select("row_id", "ref_id", change.alias("change"), F.explode(ends).alias("e")).select("row_id", "ref_id", "change", "e.*").distinct()
    points = saved(points.withColumn("point_id", F.struct("row_id", "ref_id", "change", "side")), "points")
    named = to_spliced(points.select("point_id", F.col("ref_id").alias("transcript"), "u", F.lit(True).alias("is_end")), exons)
    got = points.join(named, "point_id", "left").join(transcripts.select("ref_id", "ref_name", "cds_left", "cds_right"), "ref_id", "left")
    at, a, b = F.col("pos") + F.col("neg").cast("int"), F.col("cds_left"), F.col("cds_right")
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    coding = a.isNotNull() & b.isNotNull()
    number = F.when(~coding, at.cast("string")).when(at <= a, text("-", a - at + 1)).when(at <= b, (at - a).cast("string")).otherwise(text("*", at - b))
    number = F.concat(number, F.when(F.col("neg"), text("-", F.col("off") + 1)).when(F.col("off") > 0, text("+", F.col("off"))).otherwise(F.lit("")))
    one = got.groupBy("row_id", "ref_id", "change").agg(F.max("ref_name").alias("ref_name"), F.max(F.when(coding, "c").otherwise("n")).alias("kind"), F.min("u").alias("u0"), F.max("u").alias("u1"),
                                                       F.max(F.when(F.col("side") == 0, number)).alias("x"), F.max(F.when(F.col("side") == 1, number)).alias("y"))
    whole = F.concat(F.when(F.col("u0") == F.col("u1"), F.col("x")).otherwise(F.concat_ws("_", "x", "y")), "change.tail")
    one = one.withColumn("text", F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), whole))
    each = one.groupBy("row_id", "ref_id").agg(F.max("ref_name").alias("ref_name"), F.max("kind").alias("kind"), F.array_sort(F.collect_list(F.struct("change", "text"))).alias("c"))
    error = F.when(F.col("ref_name").isNull(), "UnknownReferenceName").when(F.exists("c", lambda x: x["text"].isNull()), "OutOfReference")
    joined = F.array_join(F.transform("c", lambda x: x["text"]), ";")
    hgvs = F.concat("ref_name", F.lit(":"), "kind", F.lit("."), F.when(F.size("c") == 1, joined).otherwise(F.concat(F.lit("["), joined, F.lit("]"))))
    return each.select("row_id", "ref_id", F.when(error.isNull(), hgvs).alias("hgvs"), error.alias("error"))


def format_hgvs_protein(df: DataFrame) -> DataFrame:
    """Adds `hgvs` for plain protein changes (p_left, p_right, p_ref, p_alt, before, after, length).

    before and after are the residues around an insertion; a deletion up to the last residue is
    shown as a stop; length counts the stop.
    """
    three = lambda c: S.three_letters(F.col(c))
    to_end = (F.col("p_alt") == "") & (F.col("p_right") + 1 == F.col("length"))
    first, last = F.substring("p_ref", 1, 1), F.substring("p_ref", -1, 1)
    pos = lambda aa, n: F.concat(S.three_letters(aa), n.cast("string"))
    whole = F.when(F.length("p_ref") > 1, F.concat(pos(first, F.col("p_left") + 1), F.lit("_"), pos(last, F.col("p_right")))) \
        .otherwise(pos(first, F.col("p_left") + 1))
    text = F.when(to_end, F.concat(pos(first, F.col("p_left") + 1), F.lit("Ter"))) \
        .when((F.length("p_ref") == 1) & (F.col("p_ref") == F.col("p_alt")), F.concat(pos(first, F.col("p_right")), F.lit("="))) \
        .when((F.length("p_ref") == 1) & (F.length("p_alt") == 1), F.concat(pos(first, F.col("p_right")), three("p_alt"))) \
        .when(F.length("p_ref") == 0, F.concat(F.when(F.col("p_left") > 0, F.concat(
            pos(F.col("before"), F.col("p_left")), F.lit("_"), pos(F.col("after"), F.col("p_right") + 1))).otherwise(F.lit("Met1")), F.lit("ins"), three("p_alt"))) \
        .otherwise(F.concat(whole, F.lit("del"), F.when(F.length("p_alt") > 0, F.concat(F.lit("ins"), three("p_alt"))).otherwise(F.lit(""))))
    return df.withColumn("hgvs", F.concat(F.lit("p."), text))


MYVARIANT = r"^chr([0-9]{1,2}|X|Y|M|MT):g\.([0-9]+)(?:_([0-9]+))?(?:(delins)([ACGT]+)|(del)([ACGT]*|[0-9]*)|(ins)([ACGT]+)|(dup)([ACGT]*|[0-9]*)|([ACGT])>([ACGT]))$"


def chromosome(c: Column) -> Column:
    return F.when(c == "X", 23).when(c == "Y", 24).when(c.isin("M", "MT"), 25).otherwise(c.try_cast("int"))


def chromosome_label(c: Column) -> Column:
    return F.when(c == 23, "X").when(c == 24, "Y").when(c == 25, "M").otherwise(c.cast("string"))


def parse_myvariant_ids(df: DataFrame, col: str = "id") -> DataFrame:
    """(row_id, chrom, left, right, given, alt, style, error) of chrN:g... texts."""
    return myvariant_parts(df, col).drop("size", "tail")


def myvariant_parts(df: DataFrame, col: str = "id") -> DataFrame:
    """parse_myvariant_ids with size, the letters between the text's places, and tail, what it names behind `del` or `dup`.

    A text is matched once and written as its groups; all else works on these.
    """
    line_end = r"(?:\r\n|[\n\r\u0085\u2028\u2029])?$"  # what `$` lets stand behind a match
    groups = F.split(F.regexp_replace(F.col(col), F.lit(MYVARIANT[:-1] + line_end), F.lit("|".join(f"${i}" for i in range(1, 14)))), "[|]")
    df = df.withColumn("__g", F.when(F.col(col).rlike(MYVARIANT), groups))
    g = lambda i: F.nullif(F.get("__g", F.lit(i - 1)), F.lit(""))
    df = df.select("row_id", F.col(col).isNotNull().alias("__text"), "__g", g(2).try_cast("long").alias("__a"), F.coalesce(g(3), g(2)).try_cast("long").alias("__b"),
                   F.coalesce(g(7), g(11)).alias("tail"))
    a, b, tail = F.col("__a"), F.col("__b"), F.col("tail")
    style = lambda name: F.when(tail.isNull(), name).when(tail.rlike("^[0-9]+$"), name + "WithLength").otherwise(name + "WithSequence")
    kind = F.when(g(6).isNotNull(), style("deletion")).when(g(10).isNotNull(), style("duplication")).otherwise("delins")
    error = F.when((F.col("__text") & F.col("__g").isNull()) | (a == 0) | (g(3).isNotNull() & (b <= a)) | (g(8).isNotNull() & (b - a != 1)),
                   "UnknownFormatOfMyVariantInfoIdentifier").when(b - a + 1 > 10000, "VariationTooLong")
    df = df.withColumn("error", error)
    ins, dup = g(8).isNotNull(), g(10).isNotNull()
    ok = F.col("error").isNull()
    return df.select(
        "row_id", F.when(ok, chromosome(g(1))).alias("chrom"), F.when(ok, F.when(ins, a).when(dup, b).otherwise(a - 1)).alias("left"),
        F.when(ok, F.when(ins, a).otherwise(b)).alias("right"), F.when(ok, F.coalesce(g(12), F.when(tail.rlike("^[ACGT]+$"), tail))).alias("given"),
        F.when(ok, F.coalesce(g(5), g(9), g(13), F.lit(""))).alias("alt"), F.when(ok, kind).alias("style"), "error", (b - a + 1).alias("size"), "tail")


def format_myvariant_ids(df: DataFrame) -> DataFrame:
    """Adds `id` from (chrom, p_left, p_right, p_ref, p_alt, style): the plain form already shifted and extended."""
    dup = F.col("style").startswith("duplication")
    left = F.when(dup, F.col("p_left") - F.length("p_alt")).otherwise(F.col("p_left"))
    n = F.col("p_right") - left
    where = F.when(n == 0, F.concat_ws("_", left.cast("string"), (left + 1).cast("string"))).otherwise(_at(left + 1, F.col("p_right")))
    tail = F.when(F.col("style") == "deletion", "del").when(F.col("style") == "deletionWithLength", F.concat(F.lit("del"), F.length("p_ref").cast("string"))) \
        .when(F.col("style") == "deletionWithSequence", F.concat(F.lit("del"), "p_ref")).when(F.col("style") == "duplication", "dup") \
        .when(F.col("style") == "duplicationWithLength", F.concat(F.lit("dup"), F.length("p_alt").cast("string"))) \
        .when(F.col("style") == "duplicationWithSequence", F.concat(F.lit("dup"), "p_alt")) \
        .when((n == 1) & (F.length("p_alt") == 1), F.concat("p_ref", F.lit(">"), "p_alt")).when(n == 0, F.concat(F.lit("ins"), "p_alt")) \
        .otherwise(F.concat(F.lit("delins"), "p_alt"))
    return df.withColumn("id", F.concat(F.lit("chr"), chromosome_label(F.col("chrom")), F.lit(":g."), where, tail))


def parse_chrom_pos_ids(df: DataFrame, col: str = "id") -> DataFrame:
    """(row_id, chrom, left, right, ref, alt, error) of chr-pos-ref-alt texts."""
    form = r"^([0-9]{1,2}|X|Y|M|MT)-([0-9]+)-([ACGT]+)-([ACGT]+)$"
    g = lambda i: F.regexp_extract(col, form, i)
    ok = F.col(col).rlike(form) & (g(2).try_cast("long") > 0)
    return df.select("row_id", F.when(ok, chromosome(g(1))).alias("chrom"), F.when(ok, g(2).try_cast("long") - 1).alias("left"),
                     F.when(ok, g(2).try_cast("long") - 1 + F.length(g(3))).alias("right"), F.when(ok, g(3)).alias("ref"), F.when(ok, g(4)).alias("alt"),
                     F.when(~ok, "UnknownFormatOfExACOrGnomADIdentifier").alias("error"))


def format_chrom_pos_ids(df: DataFrame) -> DataFrame:
    """Adds `id` from (chrom, p_left, p_ref, p_alt, before): pure insertions and deletions get the base before them."""
    pure = ((F.col("p_ref") == "") | (F.col("p_alt") == "")) & (F.col("p_left") > 0)
    add = F.when(pure, F.col("before")).otherwise(F.lit(""))
    return df.withColumn("id", F.concat_ws("-", chromosome_label(F.col("chrom")), (F.col("p_left") + 1 - F.length(add)).cast("string"),
                                           F.concat(add, "p_ref"), F.concat(add, "p_alt")))


def parse_short_ids(df: DataFrame, col: str = "text") -> DataFrame:
    """(row_id, id_type, id, attrs, error): CA, PA, rs, RCV, COSMIC and comma lists of them, a row each."""
    rows = df.select("row_id", F.explode(F.split(col, ",")).alias("t")).withColumn("t", F.trim("t"))
    form = r"^(CA|PA|rs|RCV|COSM|COSN)0*([0-9]{1,10})(?:/([01]))?$"
    kind, num, flag = (F.regexp_extract("t", form, i) for i in (1, 2, 3))
    value = num.try_cast("long")
    ok = F.col("t").rlike(form) & (value < 4294967295) & ((flag == "") | kind.startswith("COS"))
    name = F.when(kind == "rs", "dbSNP").when(kind == "RCV", "ClinVarRCV").when(kind.startswith("COS"), "COSMIC").otherwise(kind)
    attrs = F.when(kind.startswith("COS"), F.concat(F.when(kind == "COSM", "coding").otherwise("noncoding"), F.when(flag == "0", "").otherwise(",active")))
    return rows.select("row_id", F.when(ok, name).alias("id_type"), F.when(ok, value).alias("id"), F.when(ok, attrs).alias("attrs"),
                       F.when(~ok, "IncorrectIdentifier").alias("error"))


def sort_myvariant_ids(df: DataFrame, col: str = "id") -> DataFrame:
    """Rows by chromosome and position; malformed ones first, as they are."""
    form = r"^chr([0-9]{1,2}|X|Y|M|MT):g\.([0-9]+)"
    ok = F.col(col).rlike(form)
    return df.orderBy(ok, chromosome(F.regexp_extract(col, form, 1)), F.regexp_extract(col, form, 2).try_cast("long"), "row_id")
