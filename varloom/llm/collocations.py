"""Phrase collocations, counted in tries with hash containers.

Texts are cut into pieces and words once and kept as word numbers, a slice of texts of one language a row.
Phrases are counted from them: a task keeps, for each language, a shallow trie over word numbers whose leaves
are hash containers of (rest of the phrase -> count); a container that grows past its limit is burst into children
by its next word. When a task holds more entries than it may, its largest subtrees are written out as runs sorted
by phrase until half are gone. The runs, kept in the shared folder, are dealt by ranges of (language, phrase), so
that a partition holds whole prefixes and a prefix that many phrases share is split over partitions, and merged there.

Only phrases that can be frequent enter the tries: a phrase is at most as frequent as each shorter phrase in it.
Words are counted exactly first; then, length by length, phrases all of whose parts may be frequent are counted in
2**sieve hashed counters (a shared counter lets more phrases through, never fewer), and a phrase goes on where its counter
is high enough. Tasks get each length's counters as a bitmap of 2**sieve bits, 8 MB whatever the corpus. A task sends its counts as
arrays by range of counters, and each range is added up in an array of its own.

Defined results: null text is empty; null lang is `und`; words hold any characters but space and tab, pieces
end at . , ; : ! ? and line ends; repeated rows all count; a language without frequent phrases gives no rows.
Columns other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import itemgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import byte_slices, has_columns, saved



class Limits(NamedTuple):
    """Sizes that bound memory and change no result."""

    slice: int = 1 << 22  # bytes of texts in a row of word numbers
    part: int = 1 << 18  # words that enter a trie between two looks at its size
    burst: int = 1 << 14  # entries of a hash container
    held: int = 1 << 18  # entries and words of a task's tries
    sieve: int = 26  # binary digits of a hashed counter's place
    range: int = 20  # binary digits of a place within its range of counters, 6 at least


#: What ends a piece besides the full stop, all turned into full stops.
ENDS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)
SALTS = 64
#: Phrases of a sorted run, about.
RUN = 1 << 15
#: Slices of texts in a file, which a task holds at once when it writes and reads them.
SLICES = 4


class _Ids(dict):
    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def word_numbers(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(lang, words, counts, ids): for each slice of texts of a language its words, how often each occurs, and the texts as
    word numbers from 1; 0 ends a piece."""
    docs = has_columns(docs, "lang", "text").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                                                    F.coalesce("text", F.lit("")).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in pc.unique(batch.column(0)).to_pylist():
                for texts in byte_slices(batch.column(1).filter(pc.equal(batch.column(0), lang)), limits.slice):
                    known = _Ids({b".": 0})
                    rows = []
                    for t in texts:
                        found = t.as_py().encode().lower().translate(ENDS).replace(b".", b" . ").split()
                        found.append(b".")
                        rows.append(np.fromiter(map(known.__getitem__, found), np.int32, len(found)))
                    ids = np.concatenate(rows)
                    words = pa.array([w.decode() for w in known][1:], pa.string())
                    counts = np.bincount(ids, minlength=len(known))[1:]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]), lists_of(words), lists_of(counts), lists_of(ids)], ["lang", "words", "counts", "ids"])

    return docs.mapInArrow(work, "lang string, words array<string>, counts array<bigint>, ids array<int>")


def lists_of(values) -> pa.ListArray:
    """One list of all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values) if isinstance(values, np.ndarray) else values)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))).astype(np.uint64)


def _bitmap(masks: DataFrame, sieve: int) -> np.ndarray:
    """The bits of (first, mask array<bigint>) rows: 2**(sieve - 6) masks of 64 bits at most."""
    bits = np.zeros(1 << (sieve - 6), np.int64)
    for r in masks.toLocalIterator():
        own = np.array(r["mask"], np.int64)
        bits[r["first"]:r["first"] + len(own)] |= own
    return bits.view(np.uint64)


def _counted(sent: DataFrame, least: int, limits: Limits) -> DataFrame:
    """(first, mask) bits of the counters that reach `least`, from (part, place array, n array); one range of counters is held at a time."""
    size = min(limits.sieve, limits.range)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = None, None

        def bits() -> pa.RecordBatch:
            mask = np.packbits(counts >= least, bitorder="little")
            mask = np.concatenate((mask, np.zeros(-len(mask) % 8, np.uint8))).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([(part << size) >> 6]), lists_of(mask)], ["first", "mask"])

        for batch in batches:
            for r in range(batch.num_rows):
                own = batch.column(0)[r].as_py()
                if own != part:
                    if part is not None:
                        yield bits()
                    part, counts = own, np.zeros(1 << size, np.int64)
                counts[batch.column(1)[r].values.to_numpy()] += batch.column(2)[r].values.to_numpy()
        if part is not None:
            yield bits()

    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(add, "first bigint, mask array<bigint>")


def _holds(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def _hashes(lang: str, words: list[str]) -> np.ndarray:
    """Spark's xxhash64(lang, word) of each word."""
    seed = xxhash.xxh64_intdigest(lang, 42)
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def _going(lang: str, words: list[str], ids: np.ndarray, sieves: list[np.ndarray], sieve: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Per length from 1 on, where phrases of that length start that pass the sieves; the last sieve's are those of
    length len(sieves). Also the counters of the phrases one word longer whose two parts pass."""
    h = np.concatenate((np.zeros(1, np.uint64), _hashes(lang, words)))
    may = _holds(sieves[0], h & np.uint64((1 << sieve) - 1))
    may[0] = False
    on = [may[ids]]
    key = h[ids]
    place = key
    for k in range(1, len(sieves) + 1):
        key = _mixed(key[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[ids[k:]])
        place = key >> np.uint64(64 - sieve)
        both = on[-1][:-1] & on[-1][1:]
        if k < len(sieves):
            both[both] = _holds(sieves[k], place[both])
        on.append(both)
    return on, place


class HatTrie:
    """Counts of tuples of 1 to `depth` word numbers below 2**BITS: a shallow trie with hash containers as leaves."""

    BITS = 20

    def __init__(self, depth: int, burst: int = Limits().burst):
        self.depth, self.burst, self.root, self.size, self.held = depth, burst, {}, {}, 0

    def add(self, first: int, rest: int) -> None:
        """`rest` packs the further words, the next one lowest; 0 ends it."""
        node = self.root.get(first)
        if node is None:
            self.root[first] = {rest: 1}
            self.size[first] = 1
            self.held += 1
            return
        parent, left = None, self.depth - 1  # words that a container's keys may have
        while type(node) is list:  # a burst container: [count of what ends here, children by word]
            word, rest = rest & ((1 << self.BITS) - 1), rest >> self.BITS
            if not word:
                node[0] += 1
                return
            parent, left, node = (node[1], word), left - 1, node[1].get(word)
            if node is None:
                node = parent[0][word] = {}
        if rest in node:
            node[rest] += 1
            return
        node[rest] = 1
        self.size[first] += 1
        self.held += 1
        if len(node) > self.burst and left > 1:
            where, word = parent or (self.root, first)
            where[word] = self._burst(node)

    def _burst(self, container: dict) -> list:
        children: dict[int, dict] = {}
        ends = container.pop(0, 0)
        low = (1 << self.BITS) - 1
        for rest, n in container.items():
            children.setdefault(rest & low, {})[rest >> self.BITS] = n
        return [ends, children]

    def take(self, first: int) -> list[tuple[tuple[int, ...], int]]:
        """Removes the subtree of a first word: (words, count of what begins with them)."""
        counts: dict[tuple[int, ...], int] = {}
        low = (1 << self.BITS) - 1
        open_ = [((first,), self.root.pop(first))]
        self.held -= self.size.pop(first)
        while open_:
            path, node = open_.pop()
            if type(node) is list:
                if node[0]:
                    for k in range(2, len(path) + 1):
                        counts[path[:k]] = counts.get(path[:k], 0) + node[0]
                open_ += [((*path, w), child) for w, child in node[1].items()]
                continue
            for rest, n in node.items():
                words = path
                while rest:
                    words += (rest & low,)
                    rest >>= self.BITS
                for k in range(2, len(words) + 1):
                    counts[words[:k]] = counts.get(words[:k], 0) + n
        return list(counts.items())


def _paths(ids: np.ndarray, on: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """(first word, packed further words): from each place the longest phrase that may be frequent, of two words at least."""
    starts = np.flatnonzero(on[1])
    rest, going = np.zeros(len(starts), np.int64), np.ones(len(starts), bool)
    for k in range(1, len(on)):
        inside = starts < len(on[k])
        going &= inside & on[k][np.where(inside, starts, 0)] if len(on[k]) else False
        rest |= np.where(going, ids[np.minimum(starts + k, len(ids) - 1)], 0) << (HatTrie.BITS * (k - 1))
    return ids[starts].tolist(), rest.tolist()


def _tries(chunks: Iterator[pa.RecordBatch], sieves: list[np.ndarray], longest: int, limits: Limits) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, n): sorted runs of phrases of two words or more with the counts of a task."""
    tries: dict[str, tuple[HatTrie, _Ids, list[str]]] = {}

    def spill(lang: str, firsts: list[int]) -> Iterator[pa.RecordBatch]:
        trie, _, names = tries[lang]
        run: list[tuple[str, int]] = []
        for k, f in enumerate(firsts):
            run += [(" ".join(map(names.__getitem__, path)), n) for path, n in trie.take(f)]
            if len(run) >= RUN or k == len(firsts) - 1:
                run.sort(key=itemgetter(0))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(run), pa.string()), pa.array([p for p, _ in run], pa.string()),
                                                  pa.array([n for _, n in run], pa.int64())], ["lang", "phrase", "n"])
                run = []

    def weight(lang: str) -> int:
        return tries[lang][0].held + len(tries[lang][2])

    for batch in chunks:
        for r in range(batch.num_rows):
            lang, words, ids = batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), batch.column(3)[r].values.to_numpy()
            on = _going(lang, words, ids, sieves, limits.sieve)[0][:longest]
            for at in range(0, len(ids) - 1, limits.part):
                own = [x[at:at + limits.part] for x in on]
                if not own[1].any():
                    continue
                to = min(len(ids), at + limits.part + longest)
                used = np.unique(ids[at:to])
                used = used[used > 0].tolist()
                if lang in tries and len(tries[lang][2]) + len(used) > 1 << HatTrie.BITS:  # out of numbers: a new trie
                    yield from spill(lang, sorted(tries[lang][0].root))
                    del tries[lang]
                trie, known, names = tries.setdefault(lang, (HatTrie(longest, limits.burst), _Ids({"": 0}), [""]))
                number = np.zeros(len(words) + 1, np.int64)
                for u in used:
                    number[u] = known[words[u - 1]]
                    if number[u] == len(names):
                        names.append(words[u - 1])
                for f, x in zip(*_paths(number[ids[at:to]], own)):
                    trie.add(f, x)
                over = sum(map(weight, tries)) - limits.held
                for big in sorted(tries, key=weight, reverse=True) if over > 0 else ():
                    if len(tries[big][2]) > tries[big][0].held // 2:  # names weigh too much: a new trie
                        over -= weight(big)
                        yield from spill(big, sorted(tries[big][0].root))
                        del tries[big]
                    else:  # the largest subtrees first, until half is free
                        sizes, gone, firsts = tries[big][0].size, 0, []
                        for f in sorted(sizes, key=sizes.get, reverse=True):
                            if gone >= over + limits.held // 2:
                                break
                            gone += sizes[f]
                            firsts.append(f)
                        yield from spill(big, firsts)
                        over -= gone
                    if over <= -(limits.held // 2):
                        break
    for lang in tries:
        yield from spill(lang, sorted(tries[lang][0].root))


def phrase_counts(docs: DataFrame, least: int = 30, longest: int = 4, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f) of phrases of up to `longest` words with `least` occurrences or more, (lang, n) of all words)."""
    if longest > 1 + 63 // HatTrie.BITS:
        raise ValueError(f"phrases of at most {1 + 63 // HatTrie.BITS} words")
    spark = docs.sparkSession
    chunks = saved(word_numbers(docs, limits), "collocation-words", SLICES)
    words = (chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w"))
             .groupBy("lang", F.col("w.words").alias("phrase")).agg(F.sum("w.counts").alias("f")))
    words = saved(words, "collocation-unigrams")
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    words = words.where(F.col("f") >= least)
    low = F.lit((1 << limits.sieve) - 1)
    size = min(limits.sieve, limits.range)
    place = F.xxhash64("lang", "phrase").bitwiseAND(low)
    first = words.select(F.shiftright(place, 6).alias("first"), F.expr("shiftleft(1L, cast(xxhash64(lang, phrase) & 63 as int))").alias("bit")).groupBy("first").agg(F.array(F.bit_or("bit")).alias("mask"))
    sieves = [spark.sparkContext.broadcast(_bitmap(first, limits.sieve))]
    for _ in range(longest - 1):
        so_far = list(sieves)

        def counters(batches: Iterator[pa.RecordBatch], held=so_far) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    on, place = _going(batch.column(0)[r].as_py(), batch.column(1)[r].as_py(), batch.column(3)[r].values.to_numpy(), [b.value for b in held], limits.sieve)
                    at, n = np.unique(place[on[-1]], return_counts=True)
                    parts, begin = np.unique(at >> np.uint64(size), return_index=True)
                    ends = np.append(begin, len(at)).astype(np.int32)
                    # A counter needs to tell `least` from less only.
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(parts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(ends), pa.array((at & np.uint64((1 << size) - 1)).astype(np.int32))),
                         pa.ListArray.from_arrays(pa.array(ends), pa.array(np.minimum(n, least).astype(np.int32)))], ["part", "place", "n"])

        sent = chunks.mapInArrow(counters, "part bigint, place array<int>, n array<int>")
        sieves.append(spark.sparkContext.broadcast(_bitmap(_counted(sent, least, limits), limits.sieve)))
    runs = saved(chunks.mapInArrow(lambda b: _tries(b, [x.value for x in sieves], longest, limits), "lang string, phrase string, n bigint"),
                 "collocation-runs")
    merged = runs.repartitionByRange("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return words.unionByName(merged), totals


def _part(lo: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice("words", lo, n), " ")


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, top: int = 2000, cover: int = 80, scale: int = 2_000_000,
                 limits: Limits = Limits()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to `longest` words.

    A phrase's score is that of its weakest cut in two, floor(scale * a / (l + r)); phrases are left out that lie within a
    longer candidate with `cover` percent of their occurrences.
    """
    counts, totals = phrase_counts(docs, least, longest, limits)
    counts = saved(counts, "collocation-counts")
    words = F.split("phrase", " ")
    phrases = counts.select("lang", "phrase", F.col("f").alias("a"), words.alias("words")).where(F.size("words") > 1)
    size = F.size("words")
    cuts = phrases.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"), "words").select(
        "lang", "phrase", "a", "k", _part(1, F.col("k")).alias("head"), _part(F.col("k") + 1, size - F.col("k")).alias("tail"))
    part = lambda name, out: counts.select("lang", F.col("phrase").alias(name), F.col("f").alias(out))
    # A word that many phrases begin or end with is one key: heads and tails are counted by salted keys.
    cuts = _looked_up(_looked_up(cuts, part("head", "l"), "head"), part("tail", "r"), "tail")
    score = F.expr(f"cast(cast({scale} as decimal(10,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as bigint)")
    scored = (cuts.withColumn("score", score).groupBy("lang", "phrase", "a")
              .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    # A phrase of m words lies in longer ones at each of their places but those of full length.
    inner = phrases.where(size > 2).select("lang", F.col("a").alias("longer"), "words", F.explode(F.sequence(F.lit(2), size - 1)).alias("m")).select(
        "lang", "longer", "words", "m", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)).alias("at")).select(
        "lang", _part(F.col("at"), F.col("m")).alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    # Never broadcast, as below.
    kept = scored.join(inner.hint("merge"), ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < cover * F.col("a")))
    order = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    first = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def _looked_up(cuts: DataFrame, parts: DataFrame, key: str) -> DataFrame:
    """cuts joined with parts by (lang, key); a row goes to one of SALTS copies of single words' counts. The copies are never
    broadcast: Spark sizes them by the files of the counts, without compression and copying."""
    salt, one = F.pmod(F.xxhash64("phrase", "k"), F.lit(SALTS)), F.instr(F.col(key), " ") == 0
    copies = parts.withColumn("salt", F.explode(F.when(one, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return cuts.withColumn("salt", F.when(one, salt).otherwise(0).cast("int")).join(copies.hint("merge"), ["lang", key, "salt"]).drop("salt")
