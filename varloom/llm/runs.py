"""Periodic runs of words, found by grouping suffixes by their Lyndon prefixes.

A run is a longest stretch with smallest period q. The runs theorem says that in every run some place
starts a longest Lyndon word of length q, under an order of the words or under the reversed order. The
first phase of a suffix sorter gives these words' lengths directly (Baier's grouping): suffixes lie in
groups by the Lyndon word they are known to start with, greatest group first; when a group with word u
is reached, the nearest places before its members that lie in lower groups have their words extended by
the u's that follow, and move to new groups right above their old ones. A member's length is final when
its group is reached. Each Lyndon word is then extended to both sides, as far as the text agrees with
itself one period on, by longest common extensions from a table of names of blocks of 2**k words.

Both phases run over all texts of a slice at once, apart by separators smaller than any word. Words that
can't lie in a run are left out first: a run of exponent e holds each of its windows of three words
e - 1 times, so a text is cut where windows occur less often in their stretch, again until nothing
changes. All of it is linear in the words, but for sorting (the windows, and the names for each power of two).

Defined results: null text has no words and no runs; repeated rows get equal results; a row without id
counts as any other. Columns other than those named are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, has_columns

SLICE = 1 << 23
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def lyndon_lengths(symbols: list[int], top: int) -> list[int]:
    """Length of the longest Lyndon word at each place of a text over 1..top; 0, which must come first, parts texts and is below all symbols."""
    n = len(symbols)
    members: list[list[int]] = [[] for _ in range(top + 1)]
    for i, s in enumerate(symbols):
        members[s].append(i)
    group = list(symbols)
    size = [1] * (top + 1)
    below, above = list(range(-1, top)), list(range(1, top + 2))
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    out = [0] * n
    left.append(n - 1)
    g = top
    while g > 0:
        u, at, k = size[g], -1, 0
        met: list[tuple[int, int]] = []  # (place before, how many members follow it)
        for i in members[g]:
            if group[i] != g:
                continue  # moved on to a higher group
            # Members leave the chain of open places in ascending order: what is left of i lies in a lower group.
            p, r = left[i], right[i]
            right[p], left[r] = r, p
            out[i] = u
            if p == at:
                k += 1
            else:
                if k:
                    met.append((at, k))
                at, k = p, 1
        if k:
            met.append((at, k))
        moved: dict[tuple[int, int], list[int]] = {}
        for p, k in met:
            if group[p]:
                moved.setdefault((k, group[p]), []).append(p)
        for k, h in sorted(moved, reverse=True) if len(moved) > 1 else list(moved):
            places = moved[k, h]
            new = len(members)
            members.append(places)
            for p in places:
                group[p] = new
            size.append(size[h] + k * u)
            over = above[h]
            below.append(h)
            above.append(over)
            above[h] = new
            if over < len(below):
                below[over] = new
        members[g] = []
        g = below[g]
    return out


def _block_names(base: np.ndarray, longest: int) -> list[np.ndarray]:
    """Names of the blocks of 2**k symbols at each place: equal names, equal blocks; blocks beyond the end have names of their own."""
    n, names = len(base), [base.astype(np.int64)]
    while 2 << (len(names) - 1) <= longest:
        half = 1 << (len(names) - 1)
        a = names[-1]
        key = a[:n - half] * (2 * n + 1) + a[half:] if half < n else a[:0]
        u, inverse = np.unique(key, return_inverse=True)
        if len(u) == len(key):
            break
        names.append(np.concatenate([inverse, len(u) + np.arange(n - len(key))]))
    return names


def _extension(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
    """How far the texts agree from places i < j on, or up to before them."""
    n, total = len(names[0]), np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        step = 1 << k
        a, b = (i - total - step, j - total - step) if back else (i + total, j + total)
        inside = (a >= 0) & (b < n)
        total += step * (inside & (names[k][np.where(inside, a, 0)] == names[k][np.where(inside, b, 0)]))
    return total


def _stretches(ids: np.ndarray, docs: np.ndarray, shortest: int, exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words that may lie in a run, and the number of each one's stretch; stretches may share words.

    A run's windows of three words occur exponent - 1 times in it (windows of one word, exponent times).
    Windows are told apart by hashes: equal hashes of unlike ones keep more, never less.
    """
    wide, often = (3, exponent - 1) if exponent >= 3 and shortest > exponent else (1, exponent)
    n = max(0, len(ids) - wide + 1)
    word = np.zeros(n, np.uint64)
    for k in range(wide):
        word = word * np.uint64(0x9E3779B97F4A7C15) + ids[k:k + n].astype(np.uint64) + np.uint64(1)
    place = np.flatnonzero(docs[:n] == docs[wide - 1:wide - 1 + n])
    part, size = docs[place].astype(np.uint64), np.zeros(0, np.int64)
    while len(place):
        key = word[place] ^ (part + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        keep = counts[inverse] >= often
        p, s = place[keep], part[keep]
        s = np.cumsum(np.concatenate(([0], (np.diff(p) != 1) | (s[1:] != s[:-1])))[:len(p)])
        size = np.bincount(s, minlength=1)
        keep = size[s] >= shortest - wide + 1
        p, s = p[keep], s[keep]
        done = len(p) == len(place)
        place, part = p, s.astype(np.uint64)
        if done:
            break
    if not len(place):
        return place, part
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    size = np.diff(np.append(first, len(place))) + wide - 1
    begin = np.cumsum(size) - size
    return np.repeat(place[first] - begin, size) + np.arange(size.sum()), np.repeat(np.arange(len(size)), size)


def find_runs(ids: np.ndarray, docs: np.ndarray, shortest: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, length, period) of the runs in all texts; `ids` are words, `docs` their ascending text numbers."""
    none = np.zeros(0, np.int64)
    place, part = _stretches(ids, docs, max(shortest, exponent), exponent)
    if not len(place):
        return none, none, none
    first = np.concatenate(([True], np.diff(part) != 0))
    at = np.arange(len(place)) + np.cumsum(first)  # a separator before each stretch
    words, symbols = np.unique(ids[place], return_inverse=True)
    text = np.zeros(at[-1] + 2, np.int64)
    text[at] = symbols + 1
    apart = np.flatnonzero(text == 0)
    base = text.copy()
    base[apart] = len(words) + 1 + np.arange(len(apart))
    longest = int(np.diff(apart).max()) - 1
    i, p = [], []
    for order in (text, np.where(text > 0, len(words) + 1 - text, 0)):
        lengths = np.array(lyndon_lengths(order.tolist(), len(words)), np.int64)
        i.append(at)
        p.append(lengths[at])
    i, p = np.concatenate(i), np.concatenate(p)
    few = p * exponent <= longest
    i, p = i[few], p[few]
    names = _block_names(base, longest)
    start = i - _extension(names, i, i + p, True)
    length = i + p + _extension(names, i, i + p, False) - start
    ok = (length >= exponent * p) & (length >= shortest)
    found = np.unique(np.stack([start[ok], p[ok], length[ok]]), axis=1)
    origin = np.zeros(len(text), np.int64)
    origin[at] = place
    return origin[found[0]], found[2], found[1]


def planted_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, in a tenth of the documents with a tail that repeats a stretch, all as crc32 of the id tells."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _judged(doc_ids: list, texts: pa.Array, rewrite, shortest: int, exponent: int) -> tuple[list, list[str]]:
    """(runs, collapsed text) of each text."""
    rows = [(t.as_py() or "").encode().split() for t in texts]
    if rewrite is not None:
        rows = [rewrite(w, d) for w, d in zip(rows, doc_ids)]
    known = _Ids()
    sizes = np.array([len(w) for w in rows], np.int64)
    ids = np.fromiter(map(known.__getitem__, chain.from_iterable(rows)), np.int64, int(sizes.sum()))
    docs = np.repeat(np.arange(len(rows)), sizes)
    start, length, period = find_runs(ids, docs, shortest, exponent)
    begin = np.concatenate(([0], np.cumsum(sizes)))
    runs: list[list] = [[] for _ in rows]
    drop = np.zeros(len(ids) + 1, np.int64)
    np.add.at(drop, start + period, 1)
    np.add.at(drop, start + length, -1)
    drop = np.cumsum(drop) > 0
    for d, s, n, q in sorted(zip(docs[start].tolist(), start.tolist(), length.tolist(), period.tolist()), key=lambda r: (r[1], r[3])):
        runs[d].append({"start": s - int(begin[d]), "length": n, "period": q})
    text = [b" ".join(w if not runs[d] else [x for x, gone in zip(w, drop[begin[d]:begin[d + 1]].tolist()) if not gone]).decode()
            for d, w in enumerate(rows)]
    return runs, text


def periodic_runs(docs: DataFrame, shortest: int = 6, exponent: int = 4,
                  rewrite: Callable[[list[bytes], int | None], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, runs, collapsed): the runs of `shortest` words and `exponent` periods or more by start, then period, and
    the words outside their repeats joined by spaces. `rewrite`, if given, changes the words first."""
    docs = has_columns(docs, "doc_id", "text")
    kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for texts in byte_slices(batch.column(1), SLICE):
                ids = batch.column(0).slice(done, len(texts))
                done += len(texts)
                runs, text = _judged(ids.to_pylist(), texts, rewrite, shortest, exponent)
                yield pa.RecordBatch.from_arrays([ids, pa.array(runs, kind), pa.array(text, pa.string())], ["doc_id", "runs", "collapsed"])

    return docs.mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, runs array<{RUN}>, collapsed string")


def strongest(runs: Column) -> Column:
    """The run with the greatest exponent; of equal ones the first."""
    more = lambda a, x: a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"])
    return F.aggregate(runs, F.lit(None).cast(RUN), lambda a, x: F.when(more(a, x), x).otherwise(a))


def digest(docs: DataFrame, rewrite=planted_tail) -> DataFrame:
    """Number of runs, the strongest run, and digests of all runs and of the collapsed text."""
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[x].cast("string") for x in ("start", "length", "period"))), F.lit("\n")))
    found = periodic_runs(docs, rewrite=rewrite).withColumn("best", strongest(F.col("runs")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
