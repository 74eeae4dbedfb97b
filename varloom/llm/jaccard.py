"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A text's set holds the hashes of its distinct five-word shingles. Texts with equal sets are one
class, and classes are joined:

1. Shingles whose hash lies below a bound are a sample, the same in all texts, and the number of
   classes that hold each is counted. A class with more than n - ceil(t*n) sampled shingles of its
   own only can have no link and is out.
2. Every shingle has a place in one global order: sampled ones by that number, rare ones first, then
   the others. Two sets that reach the threshold share a shingle among the first n - ceil(t*n) + 1
   of each. Classes that meet there at sizes that could reach the threshold are tied into groups
   (components of the ties, made by joins). Classes outside groups have no links.
3. Within a group, an inverted index over whole sets answers a T-occurrence query per class: the
   long lists are set apart, the short ones are heap-merged, candidates with enough occurrences are
   looked up in the long lists by binary search, and those that reach the overlap T are links. Lists
   whose members all are in the class's own component already can add no new tie and are skipped, so
   a big group of copies takes time near its size. Groups above GROUP classes are dealt out as pairs
   of parts, each pair one unit of work.

Only ties (a spanning forest per unit) leave a unit, never all pairs; their components are the
result. Sets are compared by 64-bit hashes of their shingles.

Defined results: null texts and texts without words have an empty set and link with nothing; fewer
words than five are one shingle; repeated rows are one class; a null doc_id links like any other, but
a component's id is the smallest one that is not null. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, has_columns, saved

N = 5
#: Shingles with a hash below this bound, two fifths of all, are the sample whose counts are made.
BOUND = (1 << 65) // 5
GROUP = 1024
#: Merged by a heap up to so many members.
HEAP = 256
_SPACE = re.compile(r"[\x20\x09-\x0d]+")
_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


#: A value a byte: upper-case letters have that of their lower case, white space has none.
_KEYS = _mix((np.arange(1, 257, dtype=np.uint64)) * _M1)
_KEYS[65:91] = _KEYS[97:123]
_KEYS[_BLANK] = 0
_ODD = 0x9E3779B97F4A7C15
_LONG = 1 << 16
_POWERS = np.multiply.accumulate(np.full(_LONG, _ODD, np.uint64))
_INVERSE = np.multiply.accumulate(np.full(_LONG, pow(_ODD, -1, 1 << 64), np.uint64))
_TURN = np.multiply.accumulate(np.full(8, 0xD6E8FEB86659FD93, np.uint64))


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash a word of the lower-cased text: a polynomial over its bytes, mixed with its length."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    parts = []
    at = 0
    while at < len(raw):
        a = raw[at:at + _LONG]
        if at + len(a) < len(raw) and not _BLANK[a[-1]]:  # end the block at a word's end
            gaps = np.flatnonzero(_BLANK[a])
            if not len(gaps):
                return _long_words(text)
            a = a[:gaps[-1] + 1]
        at += len(a)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _BLANK[a], [True]))))
        starts, ends = edge[::2], edge[1::2]
        if len(starts):
            h = np.add.reduceat(_KEYS[a] * _POWERS[:len(a)], starts) * _INVERSE[starts]
            parts.append(_mix(h + (ends - starts).astype(np.uint64) * _M1))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def _long_words(text: str) -> np.ndarray:
    """The same for texts with words of over _LONG bytes: those are hashed by pieces."""
    import hashlib

    out = []
    for word in filter(None, _SPACE.split(text)):
        raw = word.encode("utf-8", "replace")
        if len(raw) < _LONG:
            out.append(word_hashes(word))
        else:
            digest = hashlib.blake2b(re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw), digest_size=8).digest()
            out.append(np.frombuffer(digest, np.uint64))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """The sorted distinct hashes of the text's n-word shingles."""
    w = word_hashes(text) if text else np.zeros(0, np.uint64)
    if not len(w):
        return w
    k = min(n, len(w))
    m = len(w) - k + 1
    h = np.full(m, k, np.uint64)
    for i in range(k):
        h += w[i:m + i] * _TURN[i]
    h = np.sort(_mix(h))
    return h[np.concatenate(([True], h[1:] != h[:-1]))]


def need(n: int, percent: int) -> int:
    """ceil(percent/100 * n): the least overlap of a set of n with any set that it links with."""
    return -(-percent * n // 100)


def overlap(a: int, b: int, percent: int) -> int:
    """The least intersection of linked sets of sizes a and b."""
    return -(-percent * (a + b) // (100 + percent))


def class_id(h: np.ndarray) -> int | None:
    """A 64-bit name of a set, None for the empty one; equal sets have equal names."""
    if not len(h):
        return None
    x = np.array([_mix(h + _M2).sum(), np.bitwise_xor.reduce(_mix(h * _M3)), len(h)], np.uint64)
    return int(_mix(_mix(_mix(x[:1]) + x[1:2]) + x[2:]).view(np.int64)[0])


def _survey(docs: DataFrame) -> DataFrame:
    """(doc_id, n, cls) of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                got = [shingles(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(g) for g in got], pa.int32()),
                     pa.array(map(class_id, got), pa.int64())], ["doc_id", "n", "cls"])

    return saved(docs.mapInArrow(count, f"doc_id {kind}, n int, cls long"), "shingle-survey")


def _low(h: np.ndarray, percent: int) -> np.ndarray:
    """The hashes below the sample's bound, and at least the prefix's number of the smallest."""
    prefix = len(h) - need(len(h), percent) + 1
    return h[:max(prefix, int(np.searchsorted(h, np.uint64(BOUND))))]


def _sampled(docs: DataFrame, percent: int) -> DataFrame:
    """(h, n, k, cls) of every class's sampled shingles; k is their number. Copies in one task come once."""

    def cut(batches):
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                hs, ns, ks, cs = [], [], [], []
                for t in batch.column("text").slice(at, 256).to_pylist():
                    h = shingles(t)
                    c = class_id(h)
                    if c is None or c in seen:
                        continue
                    if len(seen) < 500_000:
                        seen.add(c)
                    low = _low(h, percent)
                    hs.append(low.view(np.int64))
                    ns.append(np.full(len(low), len(h), np.int32))
                    ks.append(np.full(len(low), len(low), np.int32))
                    cs.append(np.full(len(low), c, np.int64))
                if hs:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x)) for x in (hs, ns, ks, cs)], ["h", "n", "k", "cls"])

    return docs.select("text").mapInArrow(cut, "h long, n int, k int, cls long")


def _prefixes(sampled: DataFrame, percent: int) -> DataFrame:
    """(h, n, cls): the shared shingles of the prefixes of classes that can have a link at all.

    The order of shingles: sampled ones by (number of classes, hash), then the others by hash. A
    class with more than n - need(n) sampled shingles that no other class has can't reach the
    overlap with any, and goes here.
    """
    w = Window.partitionBy("h").orderBy("n", "cls")
    rows = sampled.withColumn("again", F.coalesce(F.lag("cls").over(w) == F.col("cls"), F.lit(False)))
    rows = rows.withColumn("df", F.sum(F.when(F.col("again"), 0).otherwise(1)).over(Window.partitionBy("h")))
    shared = rows.where(~F.col("again") & (F.col("df") > 1))
    # Unsigned order: hashes from 2**63 on are negative as long, and beyond the sample's bound.
    beyond = (F.col("h") < 0) | (F.col("h") >= BOUND)
    one = F.struct(beyond.alias("x"), F.when(beyond, 0).otherwise(F.col("df")).alias("df"),
                   F.col("h").bitwiseXOR(F.lit(-(1 << 63))).alias("o"), "h")
    listed = shared.groupBy("cls", "n", "k").agg(F.collect_list(one).alias("s"))
    free = F.expr(f"n - cast(({percent} * n + 99) div 100 as int)")  # shingles that a link may do without
    alone = F.col("k") - F.size("s")
    kept = listed.where(alone <= free).withColumn("s", F.slice(F.array_sort("s"), F.lit(1), free + 1 - alone))
    return kept.select(F.explode(F.transform("s", lambda x: x["h"])).alias("h"), "n", "cls")


def _ties(prefixes: DataFrame, percent: int) -> DataFrame:
    """(u, v): classes tied to the first of their run, runs of one shingle cut where sizes are too far apart."""
    w = Window.partitionBy("h").orderBy("n", "cls")
    before = F.lag("n").over(w)
    first = before.isNull() | (F.col("n") * percent > before * 100)
    rows = prefixes.withColumn("first", first)
    pivot = F.last(F.when(F.col("first"), F.col("cls")), ignorenulls=True).over(w)
    rows = rows.withColumn("pivot", pivot).where(~F.col("first") & (F.col("pivot") != F.col("cls")))
    return rows.select(F.col("cls").alias("u"), F.col("pivot").alias("v")).distinct()


BITS = 1 << 26


def _grouped_sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(cls, n, s) of the classes in members(cls); a bitmap of fixed size drops most others early."""
    # The bitmap comes as rows of 64 bits: at most BITS / 64 of them, whatever the number of classes.
    words = members.groupBy(F.expr(f"cast(shiftright(cls & {BITS - 1}, 6) as int)").alias("w")).agg(
        F.expr("bit_or(shiftleft(1L, cast(cls & 63 as int)))").alias("b")).toPandas()
    bitmap = np.zeros(BITS // 64, np.int64)
    bitmap[words["w"]] = words["b"]
    held = docs.sparkSession.sparkContext.broadcast(bitmap)

    def build(batches):
        bits = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                got = [shingles(t) for t in batch.column("text").slice(at, 512).to_pylist()]
                rows = [(c, g) for g in got if (c := class_id(g)) is not None
                        and int(bits[(c & (BITS - 1)) >> 6]) >> (c & 63) & 1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([c for c, _ in rows], pa.int64()), pa.array([len(g) for _, g in rows], pa.int32()),
                     pa.array([g.tobytes() for _, g in rows], pa.binary())], ["cls", "n", "s"])

    return docs.select("text").mapInArrow(build, "cls long, n int, s binary").dropDuplicates(["cls"])


def long_share(low: int, longest: int) -> int:
    """How many lists DivideSkip sets apart as long: low / (mu * log2(length) + 1), mu as published."""
    return int(low / (0.0085 * np.log2(max(longest, 2)) + 1))


def divide_skip(lists: list[np.ndarray], low: int, share: int, skip: np.ndarray | None = None) -> dict[int, int]:
    """members -> occurrences of those in at least `low` of the ascending lists.

    The `share` longest lists are probed by binary search; the others are merged, a few members with
    a heap, many by sorting their runs. Members marked in skip are passed over.
    """
    lists = sorted(lists, key=len)
    share = max(0, min(share, low - 1, len(lists) - 1))
    short, long_ = lists[:len(lists) - share], lists[len(lists) - share:]
    if sum(map(len, short)) > HEAP:
        member, n = np.unique(np.concatenate(short), return_counts=True)
    else:
        heap = [(x[0], k, 0) for k, x in enumerate(short) if len(x)]
        heapq.heapify(heap)
        merged: list[list[int]] = []
        while heap:
            head, k, at = heap[0]
            if merged and merged[-1][0] == head:
                merged[-1][1] += 1
            else:
                merged.append([head, 1])
            if at + 1 < len(short[k]):
                heapq.heapreplace(heap, (short[k][at + 1], k, at + 1))
            else:
                heapq.heappop(heap)
        member, n = np.array(merged, np.int64).reshape(-1, 2).T
    keep = n >= low - share
    if skip is not None:
        keep &= ~skip[member]
    member, n = member[keep], n[keep]
    for k, x in enumerate(long_):
        may = n + len(long_) - k >= low
        if not may.all():
            member, n = member[may], n[may]
        if not len(member):
            return {}
        at = np.searchsorted(x, member)
        n = n + (np.asarray(x)[np.minimum(at, len(x) - 1)] == member)
    return dict(zip(member[n >= low].tolist(), n[n >= low].tolist()))


def join_unit(names: np.ndarray, arrays: list[np.ndarray], percent: int) -> np.ndarray:
    """The component (a place) of each set of one unit, by one T-occurrence query a set."""
    m = len(arrays)
    order = np.lexsort((names, [len(a) for a in arrays]))
    sizes = [len(arrays[i]) for i in order]
    token, inverse, count = np.unique(
        np.concatenate([arrays[i] for i in order]), return_inverse=True, return_counts=True)
    cuts = np.split(inverse, np.cumsum(sizes)[:-1])
    shared = count > 1  # the others are in one set only
    comp = np.arange(m)
    owner = np.full(len(token), -1)  # a member while all members are of one component, -2 else
    last = np.full(len(token), -1)
    # The inverted lists of all tokens in one array; of each, the first `filled` members are in the index.
    posts = np.repeat(np.arange(m), sizes)[np.argsort(inverse, kind="stable")]
    begin = np.concatenate(([0], np.cumsum(count)[:-1]))
    filled = np.zeros(len(token), np.int64)
    kept: list[np.ndarray] = []

    def tie(a: int, b: int) -> None:
        x, y = comp[a], comp[b]
        comp[comp == max(x, y)] = min(x, y)

    for q in range(m):
        t = cuts[q][shared[cuts[q]]]
        kept.append(t)
        low = need(sizes[q], percent)
        if len(t) >= low:
            near = last[t]
            near = near[near >= 0]
            if len(near):
                c = int(np.bincount(near).argmax())
                if len(np.intersect1d(t, kept[c], assume_unique=True)) >= overlap(sizes[q], sizes[c], percent):
                    tie(q, c)
            o = owner[t]
            open_ = t[(o == -2) | ((o >= 0) & (comp[o] != comp[q]))]
            if len(open_) >= low:
                asked = [posts[a:a + n] for a, n in zip(begin[open_].tolist(), filled[open_].tolist())]
                found = divide_skip(asked, low, long_share(low, max(map(len, asked))), comp == comp[q])
                # Shared lists of q's own component were left out: its members' counts are too low,
                # those of all others are exact.
                for c, n in found.items():
                    if comp[c] != comp[q] and n >= overlap(sizes[q], sizes[c], percent):
                        tie(q, c)
        o = owner[t]
        owner[t[o == -1]] = q
        owner[t[(o >= 0) & (comp[o] != comp[q])]] = -2
        last[t] = q
        filled[t] += 1
    root = np.empty(m, np.int64)
    root[order] = order[comp]
    return root


def _links(grouped: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """(u, v): a forest of the links, from the sets and (cls, grp) members."""
    size = members.groupBy("grp").agg(F.ceil(F.count("*") / (GROUP // 2)).alias("parts"))
    dealt = members.join(size.where(F.col("parts") > 2), "grp", "left").withColumn(
        "part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("cls"), F.col("parts"))))
    other = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda x: x != F.col("part")))
    units = dealt.select("cls", "grp", "part", F.explode(other).alias("o")).select(
        "cls", "grp", F.coalesce(F.least("part", "o"), F.lit(0)).alias("p"),
        F.when(F.col("part").isNull(), 0).otherwise(F.greatest("part", "o")).alias("q"))
    rows = grouped.join(units, "cls")

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        names = pdf["cls"].to_numpy()
        root = join_unit(names, [np.frombuffer(s, np.uint64) for s in pdf["s"]], percent)
        met = root != np.arange(len(root))
        return pd.DataFrame({"u": names[met], "v": names[root[met]]})

    return rows.groupBy("grp", "p", "q").applyInPandas(work, "u long, v long")


def join(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    docs = has_columns(docs, id_col, text_col).toDF("doc_id", "text")
    rows = _survey(docs)
    groups = connected_components(_ties(_prefixes(_sampled(docs, percent), percent), percent))
    members = saved(groups.select(F.col("id").alias("cls"), F.col("component").alias("grp")), "shingle-groups")
    links = _links(_grouped_sets(docs, members), members, percent)
    comp = connected_components(links).select(F.col("id").alias("cls"), F.col("component").alias("root"))
    low = rows.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min("doc_id").alias("low"))
    named = low.join(comp, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = named.join(named.groupBy("root").agg(F.min("low").alias("component")), "root").select("cls", "component")
    return rows.join(named, "cls", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
