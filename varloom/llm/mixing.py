"""Mixing sources to target weights by pivotal rounding, in DataFrame functions only.

Each source gets a target of words. Its documents are all wanted the same number of times, target over
source size; the whole part is taken at once, and the fractional parts are rounded dependently: two
documents meet, and words are moved from one's share to the other's, in a direction drawn so that the
expected share of both stays, until one of them is taken wholly or not at all. The source's words stay as
they are in every meeting. Documents meet within buckets of about GROUP, largest first; what each bucket
leaves open, one document at most, meets others of its source in the next level of a reduction tree. The
last one is rounded to the nearer side, so a source misses its target by less than half a document's size
(and by rounding shares to 2**-20).

Equal rows (doc_id, source and size) are counted first and rounded as one: that keeps hot ids and repeated
rows out of single groups. The draws are hashes of source, id and size, so reruns agree.

Targets: sources by code point, null last, weigh as `weights` repeats, and share `share` of all words; a
target stops at `most` times its source's size, and what is above goes to the others by weight. All sums
are exact; a target is rounded once, to a double.

Defined results: null text has no words; documents without words are taken zero words; a null source is a
source of its own; repeated rows each give a row, and of equal ones some may be taken once more than others;
an empty table gives no rows. Columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import has_columns, saved

WORD = r"[^\x20\x09-\x0D]+"
GROUP, UNIT, CHUNK, SALTS = 256, 20, 1 << 16, 32
#: Source tables of up to so many bytes are broadcast; larger ones are joined by salted keys.
SMALL = 4 << 20
KEYS = ("source", "doc_id", "size")
BIG = "decimal(38,0)"


def sizes(docs: DataFrame) -> DataFrame:
    """(source, doc_id, size, rows): how many rows there are of each; size in words."""
    docs = has_columns(docs, "doc_id", "text", "source")
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))).cast("long")
    return docs.select(F.col("source").cast("string").alias("source"), "doc_id", words.alias("size")).groupBy(*KEYS).agg(
        F.count("*").alias("rows"))


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with their places from 0 by code point, null last: by ranges of the source and one offset a range."""
    order = [F.col("source").asc_nulls_last()]
    dealt = saved(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "mix-sources")
    sums = dealt.groupBy("part").agg(F.count("*").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row a partition
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("place", place).join(F.broadcast(sums), "part").withColumn("place", F.col("place") + F.col("before")).drop("part", "before")


def targets(items: DataFrame, share: tuple[int, int] = (3, 2), most: int = 2, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """(source, source_size, target) for the rows of sizes()."""
    sources = items.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    at = F.pmod(F.col("place"), F.lit(len(weights))).cast("int") + 1
    ranked = saved(_ranked(sources).select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), at).alias("weight")), "mix-weights")
    wanted = (ranked.agg(F.sum("source_size")).first()[0] or 0) * share[0]  # in parts of share[1]
    cap = F.lit(most * share[1]) * F.col("source_size").cast(BIG)
    num, den = wanted, 0
    while True:
        # A source is full once its weight's share, num / den for a weight of 1, is above its cap; shares only grow.
        full = (F.col("weight").cast(BIG) * F.lit(num).cast(BIG) > cap * F.lit(den).cast(BIG)) if den else F.lit(False)
        capped, open_ = ranked.agg(F.sum(F.when(full, cap)), F.sum(F.when(~full, F.col("weight")))).first()
        now = (wanted - int(capped or 0), int(open_ or 0))
        if now == (num, den) or not now[1]:
            break
        num, den = now
    by_weight = (F.col("weight").cast("long") * F.lit(num)).cast("double") / F.lit(max(1, den) * share[1]).cast("double")
    return ranked.select("source", "source_size", F.when(full, (most * F.col("source_size")).cast("double")).otherwise(by_weight).alias("target"))


def _with_source(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with the columns of their source."""
    size = sources.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 64)).first()[0] or 0
    names = [c for c in sources.columns if c != "source"]
    found = sources.withColumnRenamed("source", "source_")
    if size <= SMALL:
        return rows.join(F.broadcast(found), F.col("source").eqNullSafe(F.col("source_"))).select(*rows.columns, *names)
    salted = found.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)) == F.col("salt_")
    return rows.join(salted, F.col("source").eqNullSafe(F.col("source_")) & salt).select(*rows.columns, *names)


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def _meet(a: Column, x: Column, won_type: str) -> Column:
    """State a = struct<open, won> after item x: the open item meets x."""
    won = lambda i: F.struct(i["doc_id"].alias("doc_id"), i["size"].alias("size"))
    left = lambda i, mass: F.struct(*(i[c].alias(c) for c in ("size", "draw", "doc_id")), mass.alias("mass"))
    whole = lambda i: F.shiftleft(i["size"], UNIT)

    def moved(o: Column, m: Column) -> Column:
        to_open = F.pmod(x["draw"], m["up"] + m["down"]) < m["down"]
        return F.struct(F.when(to_open, o["mass"] + m["up"]).otherwise(o["mass"] - m["down"]).alias("o"),
                        F.when(to_open, x["mass"] - m["up"]).otherwise(x["mass"] + m["down"]).alias("x"))

    def settled(o: Column, n: Column) -> Column:
        first = F.when(n["o"] == whole(o), F.array(won(o))).when(n["x"] == whole(x), F.array(won(x))).otherwise(F.array().cast(won_type))
        both = F.when((n["o"] == whole(o)) & (n["x"] == whole(x)), F.array(won(o), won(x))).otherwise(first)
        rest = F.when((n["o"] > 0) & (n["o"] < whole(o)), left(o, n["o"])).when((n["x"] > 0) & (n["x"] < whole(x)), left(x, n["x"]))
        return F.struct(rest.alias("open"), F.when(F.size(both) > 0, F.concat(a["won"], both)).otherwise(a["won"]).alias("won"))

    o = a["open"]
    room = F.struct(F.least(whole(o) - o["mass"], x["mass"]).alias("up"), F.least(o["mass"], whole(x) - x["mass"]).alias("down"))
    return F.when(o.isNull(), F.struct(x.alias("open"), a["won"].alias("won"))).otherwise(
        _let(room, lambda m: _let(moved(o, m), lambda n: settled(o, n))))


def rounded(items: DataFrame, levels: int) -> DataFrame:
    """(source, doc_id, size) of the items taken once more; items are (source, buckets, doc_id, size, draw, mass) with 0 < mass < size << UNIT."""
    id_type = items.schema["doc_id"].dataType.simpleString()
    item, won = f"struct<size:bigint,draw:bigint,doc_id:{id_type},mass:bigint>", f"array<struct<doc_id:{id_type},size:bigint>>"
    open_ = items.withColumn("bucket", F.pmod("draw", "buckets"))
    taken = None
    for level in range(levels):
        draw = F.xxhash64("draw", F.lit(level)).bitwiseAND((1 << 62) - 1)
        one = F.struct("size", draw.alias("draw"), "doc_id", "mass")
        groups = open_.groupBy("source", "bucket").agg(F.sort_array(F.collect_list(one), False).alias("items"))
        start = F.struct(F.lit(None).cast(item).alias("open"), F.array().cast(won).alias("won"))
        groups = saved(groups.select("source", "bucket", F.aggregate("items", start, lambda a, x: _meet(a, x, won)).alias("end")).select(
            "source", "bucket", "end.*"), "mix-level")
        out = groups.select("source", F.explode("won").alias("w")).select("source", "w.doc_id", "w.size")
        taken = out if taken is None else taken.unionByName(out)
        open_ = groups.where(F.col("open").isNotNull()).select("source", "open.*", F.floor(F.col("bucket") / GROUP).alias("bucket"))
    nearer = open_.where(2 * F.col("mass") >= F.shiftleft("size", UNIT)).select("source", "doc_id", "size")
    return nearer if taken is None else taken.unionByName(nearer)


def mix(docs: DataFrame, share: tuple[int, int] = (3, 2), most: int = 2, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """(doc_id, size, source_size, target, copies): how often each document is taken."""
    items = saved(sizes(docs), "mix-sizes")
    aims = targets(items, share, most, weights)
    ratio = F.col("target") / F.col("source_size")
    units = F.when(F.col("source_size") > 0, F.floor(ratio * (1 << UNIT) + 0.5)).otherwise(0)
    found = _with_source(items, saved(aims.withColumn("units", units), "mix-targets"))
    # Equal rows meet one another first: whole copies for some, the rest for one of them, none for the others.
    low = (1 << UNIT) - 1
    part = F.col("rows") * F.col("units").bitwiseAND(low)
    found = saved(found.withColumns({"base": F.shiftright("units", UNIT), "more": F.shiftright(part, UNIT), "mass": F.col("size") * part.bitwiseAND(low)}), "mix-items")
    draw = F.xxhash64(*KEYS).bitwiseAND((1 << 62) - 1)
    open_ = found.where(F.col("mass") > 0).select(*KEYS, draw.alias("draw"), "mass")
    counts = saved(open_.groupBy("source").agg(F.count("*").alias("n")).select("source", F.ceil(F.col("n") / GROUP).alias("buckets")), "mix-counts")
    most_buckets, levels = counts.agg(F.max("buckets")).first()[0] or 0, 0
    while most_buckets:
        levels, most_buckets = levels + 1, 0 if most_buckets == 1 else -(-most_buckets // GROUP)
    taken = rounded(_with_source(open_, counts), levels)
    columns = ("source_size", "target", "base", "more", "rows")
    # One more for the items taken, by a union: keys may be null.
    ends = found.select(*KEYS, *columns).unionByName(taken.select(*KEYS, F.lit(1).alias("one")), allowMissingColumns=True)
    ends = ends.groupBy(*KEYS).agg(*(F.max(c).alias(c) for c in columns), F.coalesce(F.sum("one"), F.lit(0)).alias("one"))
    more = F.col("more") + F.col("one")
    split = ends.select("doc_id", "size", "source_size", "target", F.explode(F.array(
        F.struct((F.col("base") + 1).alias("copies"), more.alias("n")), F.struct(F.col("base").alias("copies"), (F.col("rows") - more).alias("n")))).alias("e"))
    split = split.select("doc_id", "size", "source_size", "target", "e.copies", "e.n").where(F.col("n") > 0)
    # Very many equal rows are written out by many tasks.
    many = split.where(F.col("n") > CHUNK).withColumn("at", F.explode(F.sequence(F.lit(0), F.expr(f"(n - 1) div {CHUNK}")))).withColumn(
        "n", F.least(F.lit(CHUNK), F.col("n") - F.col("at") * CHUNK)).repartition("doc_id", "size", "copies", "at").drop("at")
    rows = split.where(F.col("n") <= CHUNK).unionByName(many)
    return rows.withColumn("row_", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("row_", "n")


def taken_words(docs: DataFrame) -> DataFrame:
    """The mix in words: (doc_id, size, source_size, target, taken)."""
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
