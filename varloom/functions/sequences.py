"""Column builders over nucleotide and amino-acid strings; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The standard genetic code in TCAG order, and amino-acid codes.
CODON_ORDER = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
THREE_LETTERS = {
    "A": "Ala", "C": "Cys", "D": "Asp", "E": "Glu", "F": "Phe", "G": "Gly", "H": "His", "I": "Ile", "K": "Lys",
    "L": "Leu", "M": "Met", "N": "Asn", "P": "Pro", "Q": "Gln", "R": "Arg", "S": "Ser", "T": "Thr", "V": "Val",
    "W": "Trp", "Y": "Tyr", "U": "Sec", "X": "Xaa", "*": "Ter"}


def codon_table() -> dict[str, str]:
    return {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate(CODON_ORDER)
            for j, b in enumerate(CODON_ORDER) for k, c in enumerate(CODON_ORDER)}


def partial_codon_table() -> dict[str, str]:
    """Two bases that decide the residue whatever the third is."""
    full, out = codon_table(), {}
    for a in CODON_ORDER:
        for b in CODON_ORDER:
            if len(got := {full[a + b + c] for c in CODON_ORDER}) == 1:
                out[a + b] = got.pop()
    return out


#: Letters that a number may hold.
NO_BASES = "0123456789+-." + "".join(map(chr, range(33))) + "\x7f"


def _residues_by_number() -> list[str]:
    """The residue of each codon at the number that its bases' places in CODON_ORDER make, in decimal digits."""
    out = ["X"] * 334
    for codon, residue in codon_table().items():
        out[int("".join(str(CODON_ORDER.index(b)) for b in codon))] = residue
    return out


def _map(d: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in d.items() for x in pair])


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lcp(a: Column, b: Column) -> Column:
    """Length of the longest common prefix: whole pieces of falling powers of two are compared, so that a
    letter costs no step of its own."""
    def grow(x: Column, powers: int) -> Column:
        return F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(powers))]), F.lit(0), lambda at, n: F.when(
            (at + n <= x["n"]) & (F.substring(x["a"], at + 1, n) == F.substring(x["b"], at + 1, n)), at + n).otherwise(at))

    one = F.lit(1)
    return let(F.struct(a.alias("a"), b.alias("b"), F.least(F.length(a), F.length(b)).alias("n")), lambda x: F.when(
        (x["n"] == 0) | (F.substring(x["a"], one, one) != F.substring(x["b"], one, one)), 0)
        .when(x["n"] < 8, grow(x, 3)).when(x["n"] < 128, grow(x, 7)).when(x["n"].isNotNull(), grow(x, 30)))


def lcp_short(a: str, b: str, most: int = 8) -> Column:
    """lcp of two columns of a table: ends within the first letters are found without lambdas, whose steps are far dearer; the rest is left to lcp."""
    at = lambda c, i: F.substring(c, i, 1)
    ends = F.when(F.col(a).isNull() | F.col(b).isNull(), None).when((at(a, 1) != at(b, 1)) | (F.length(a) < 1), 0)
    for i in range(2, most + 1):
        ends = ends.when((at(a, i) != at(b, i)) | (F.length(a) < i), i - 1)
    return ends.otherwise(lcp(F.col(a), F.col(b)))


def reverse_complement(s: Column) -> Column:
    """IUPAC letters; W, S, N and X stay."""
    return F.reverse(F.translate(s, "ACGTMRYKVHDB", "TGCAKYRMBDHV"))


def rotate_left(s: Column, n: Column) -> Column:
    k = F.when(F.length(s) > 0, F.pmod(n.cast("int"), F.length(s))).otherwise(F.lit(0))
    return F.concat(F.substring(s, k + 1, F.length(s)), F.substring(s, F.lit(1), k))


def rotate_right(s: Column, n: Column) -> Column:
    return rotate_left(s, F.when(F.length(s) > 0, F.length(s) - F.pmod(n.cast("int"), F.length(s))).otherwise(F.lit(0)))


def tile(s: Column, n: Column) -> Column:
    """s repeated and cut to n letters."""
    times = (n / F.greatest(F.length(s), F.lit(1))).cast("int") + 1
    return F.substring(F.call_function("repeat", s, times), F.lit(1), n.cast("int"))


def translate_codons(s: Column, tail: bool = True) -> Column:
    """Protein of a coding sequence; an incomplete last codon gives its residue if it is certain, else X."""
    part = _map(partial_codon_table())
    # Cut in one pass: a substring per codon would start from the first letter each time. A codon is read as a number and its residue
    # found by place, since a map would be searched from its start each time; what a cast to a number would bear is no base.
    bases = F.translate(s, CODON_ORDER + NO_BASES, "0123" + "N" * len(NO_BASES))
    codons = F.regexp_extract_all(bases, F.lit(r"([\s\S]{3})"), F.lit(1))
    residues = F.split(F.lit(",".join(_residues_by_number())), ",")
    body = F.when(s.isNotNull(), F.array_join(F.transform(codons, lambda c: F.coalesce(F.get(residues, c.try_cast("int")), F.lit("X"))), "")).otherwise(F.lit(""))
    if not tail:
        return body
    rest = F.substring(s, F.floor(F.length(s) / 3).cast("int") * 3 + 1, F.lit(3))
    return F.concat(body, F.when(F.length(rest) == 0, F.lit("")).otherwise(
        F.coalesce(F.element_at(part, rest), F.lit("X"))))


def three_letters(s: Column) -> Column:
    codes = _map(THREE_LETTERS)
    return F.when(F.length(s) == 0, F.lit("")).otherwise(
        F.array_join(F.transform(F.split(s, ""), lambda c: F.element_at(codes, c)), ""))


def one_letter(s: Column) -> Column:
    codes = _map({v: k for k, v in THREE_LETTERS.items()})
    parts = F.regexp_extract_all(s, F.lit("([A-Z][a-z]{2})"), F.lit(1))
    return F.array_join(F.transform(parts, lambda c: F.element_at(codes, c)), "")


def apply_edit(seq: Column, left: Column, right: Column, alt: Column) -> Column:
    """seq with [left, right) replaced."""
    return F.concat(F.substring(seq, F.lit(1), left.cast("int")), alt,
                    F.substring(seq, right.cast("int") + 1, F.length(seq)))


def apply_mods(seq: Column, mods: Column) -> Column:
    """seq with sorted, disjoint array<struct<left,right,alt>> spliced in; once the result ends with a stop, the rest is dropped."""
    stopped = lambda a: a["s"].endswith("*")
    part = lambda a, n: F.substring(seq, (a["at"] + 1).cast("int"), n)
    return F.aggregate(
        mods, F.struct(F.lit("").alias("s"), F.lit(0).cast("long").alias("at")),
        lambda a, m: F.struct(
            F.when(stopped(a), a["s"]).otherwise(F.concat(a["s"], part(a, (m["left"] - a["at"]).cast("int")), m["alt"])).alias("s"),
            m["right"].cast("long").alias("at")),
        lambda a: F.when(stopped(a), a["s"]).otherwise(F.concat(a["s"], part(a, F.length(seq)))))


def until_stop(protein: Column) -> Column:
    """The residues up to and with the first stop."""
    at = F.locate("*", protein)
    return F.when(at > 0, F.substring(protein, F.lit(1), at)).otherwise(protein)
