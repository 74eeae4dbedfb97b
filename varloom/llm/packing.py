"""Lexical retrieval packing: windows filled with BM25 neighbours.

Every document becomes token ids and a closing id. Whole windows are cut off long documents at
once; the rest, shorter than a window, is what retrieval packs. Documents are dealt to shards by content:
each gets a vector (its terms, weighted by rarity, folded to FOLDED dimensions and turned to the AXES
principal ones), the nearest of at most CELLS centroids, and within a large cell the side of the
centroid on as many axes as the table's size asks for. Mean, axes and centroids come from about SAMPLE
documents; vectors, frequencies and lengths are those of all documents. A place that holds more than a
shard should (SHARD_IDS ids, SHARD_ROWS documents) is salted into several shards.

Each shard has a BM25 inverted index over token ids, with document frequencies and the mean length
counted over all documents. The longest unused rest is a window's seed; all its terms query the index,
and the unused neighbours are put into the window by falling score. The first that doesn't fit is cut to
fill the window, and its rest stays in the pool. Without neighbours left, the longest rests follow.
Neighbours in other shards are not found: README gives the share of the best ones that are.

Cuts lie at multiples of GRAIN ids of a document, so a window's padding is below GRAIN ids, but for
the last window of a shard. A document's ids are read once: the encoder keeps a CRC-32 of every
GRAIN ids, from which any piece's CRC-32 follows.

Defined results: null text is empty text and gives one id, the closing one; repeated rows are
packed each on their own; ties go by falling length, then by place in the shard; an empty table gives no
pieces. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import os
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, has_columns, list_ends, lists, saved

WINDOW, GRAIN, CLOSE = 4096, 32, 2
#: Ids of rests and documents that a shard holds at most, on average, and whole windows that count as one of a rest.
SHARD_IDS, SHARD_ROWS, WHOLE = 512 * WINDOW, 16384, 64
SAMPLE, FOLDED, AXES, CELLS = 8192, 1024, 32, 256
K1, B = 1.2, 0.75
#: A word of these letters alone is lower-cased and composed letter by letter and cut as _CUT cuts it,
#: as the tokenizer would; other words go to the tokenizer whole.
_PLAIN = r"^[!-&(-~\x{a1}-\x{ac}\x{ae}-\x{12f}\x{131}-\x{24f}]*$"
_CUT = r"([^\pL\pN]+|\pN)"
#: The tokenizer's letters for bytes: printable Latin-1 is itself, the others follow from U+0100 on.
_OTHER = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_BYTES = {b: 0x100 + i for i, b in enumerate(_OTHER)}


class Encoder:
    """Token ids of texts. The tokenizer's pieces never hold white space, so a text's ids are those of its
    words; each word of a batch is encoded once, as its pieces, and the texts gather the ids by place.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.vocabulary = self.tokenizer.get_vocab_size()
        # A word that holds one of these as it stands gets its id there.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for ids in got for i in ids], np.uint32), np.array([len(ids) for ids in got], np.int64)

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces and how many each has. A piece needs the merges only, over one letter a byte."""
        merge, flat, sizes = self.tokenizer.model.tokenize, [], []
        for p in pieces:
            ids = [t.id for t in merge(p if p.isascii() else p.encode().decode("latin-1").translate(_BYTES))]
            flat += ids
            sizes.append(len(ids))
        return np.array(flat, np.uint32), np.array(sizes, np.int64)

    def _words(self, words: pa.Array) -> pa.ListArray:
        """Ids of distinct words."""
        plain = pc.match_substring_regex(words, _PLAIN)
        for token in self.special:
            plain = pc.and_not(plain, pc.match_substring(words, token))
        cut = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(words.filter(plain)), _CUT, r" \1 "))
        coded = cut.flatten().dictionary_encode()
        pieces = coded.dictionary.to_pylist()
        full = np.array([bool(p) for p in pieces], bool)  # a cut at a word's end leaves an empty piece
        flat, sizes = self._pieces([p for p in pieces if p])
        n = np.zeros(len(pieces), np.int64)
        n[full] = sizes
        ids = lists(flat, np.append(0, np.cumsum(n))).take(coded.indices)
        ends = list_ends(ids)[list_ends(cut)]
        odd_flat, odd_sizes = self._whole(words.filter(pc.invert(plain)).to_pylist())
        both = lists(np.concatenate([ids.flatten().to_numpy(), odd_flat]), np.append(ends, ends[-1] + np.cumsum(odd_sizes)))
        is_plain = plain.to_numpy(zero_copy_only=False)
        place = np.empty(len(words), np.int64)
        place[is_plain] = np.arange(is_plain.sum())
        place[~is_plain] = np.arange(is_plain.sum(), len(words))
        return both.take(pa.array(place))

    def encode_batch(self, texts: pa.Array, close: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's ids end, from 0; `close` follows each text's ids."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = split.flatten().dictionary_encode()
        ids, at, ends = self._words(coded.dictionary), coded.indices.to_numpy(), list_ends(split)
        if close is not None:
            flat = np.append(ids.flatten().to_numpy(), np.uint32(close))
            ids = lists(flat, np.append(list_ends(ids), len(flat)))
            at = np.insert(at, ends[1:], len(ids) - 1)
            ends = ends + np.arange(len(ends))
        got = ids.take(pa.array(at))
        return got.flatten().to_numpy(), list_ends(got)[ends]

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch(pa.array([text], pa.string()))[0].astype("<u4").tobytes()


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@lru_cache(1)
def _shifts() -> tuple[np.ndarray, np.ndarray]:
    """Tables that carry a CRC-32 over k blocks of GRAIN ids, and over k ids."""
    first = np.array([zlib.crc32(bytes([i])) ^ zlib.crc32(b"\x00") for i in range(256)], np.uint32)

    def step(c, n):
        for _ in range(n):
            c = (c >> np.uint32(8)) ^ first[c & np.uint32(255)]
        return c

    def table(basis):
        out = np.zeros((4, 256), np.uint32)
        for place in range(4):
            for bit in range(8):
                on = (np.arange(256) >> bit) & 1 == 1
                out[place, on] ^= basis[8 * place + bit]
        return out

    blocks, ids = [], []
    c = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(WINDOW // GRAIN):
        blocks.append(table(c))
        c = step(c, 4 * GRAIN)
    c = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(GRAIN + 1):
        ids.append(table(c))
        c = step(c, 4)
    return np.stack(blocks), np.stack(ids)


def _carry(tables: np.ndarray, k, c):
    return tables[k, 0, c & 255] ^ tables[k, 1, c >> 8 & 255] ^ tables[k, 2, c >> 16 & 255] ^ tables[k, 3, c >> 24]


def piece_crc(crcs: np.ndarray, n: int, start: int, length: int) -> int:
    """CRC-32 of ids start .. start+length of a document of n ids, from its blocks' CRCs."""
    blocks, ids = _shifts()
    a, whole, rest = start // GRAIN, length // GRAIN, length % GRAIN
    c = crcs[a:a + whole].astype(np.int64)
    total = int(np.bitwise_xor.reduce(_carry(blocks, np.arange(whole)[::-1], c))) if whole else 0
    if rest:
        total = int(_carry(ids, rest, total)) ^ int(crcs[a + whole])
    return total


def _encoded(docs: DataFrame, path: str) -> DataFrame:
    """A row a document: (doc_id, r, n, crcs, terms, tfs); and rows of document frequencies (n=term, r=count)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "r", "n", "crcs", "terms", "tfs"]

    def encode(batches):
        from pyspark import TaskContext

        enc, row = encoder(path), TaskContext.get().partitionId() << 33
        df = np.zeros(max(enc.vocabulary, CLOSE + 1), np.int64)
        for batch in batches:
            id_type, done = batch.column("doc_id").type, 0
            for texts in byte_slices(batch.column("text")):
                flat, ends = enc.encode_batch(texts, CLOSE)
                raw, crcs, terms, tfs = memoryview(flat.astype("<u4", copy=False)).cast("B"), [], [], []
                step, m = 4 * GRAIN, len(texts)
                for a, b in itertools.pairwise(ends.tolist()):
                    crcs.append(np.array([zlib.crc32(raw[k:min(k + step, 4 * b)]) for k in range(4 * a, 4 * b, step)], "<u4").tobytes())
                    t, tf = np.unique(flat[a:b], return_counts=True)
                    df[t] += 1
                    terms.append(t.astype("<u4").tobytes())
                    tfs.append(tf.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(done, m), pa.array(range(row, row + m), pa.int64()), pa.array(np.diff(ends), pa.int64()),
                     *(pa.array(x, pa.binary()) for x in (crcs, terms, tfs))], names)
                row, done = row + m, done + m
        if (at := np.flatnonzero(df)).size:
            m = len(at)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(m, id_type), pa.array(df[at]), pa.array(at.astype(np.int64)), *[pa.nulls(m, pa.binary())] * 3], names)

    return saved(docs.mapInArrow(encode, f"doc_id {kind}, r long, n long, crcs binary, terms binary, tfs binary"), "packing-encoded")


class Index:
    """BM25 over one shard's documents."""

    def __init__(self, terms: list[np.ndarray], tfs: list[np.ndarray], lengths: np.ndarray, idf: np.ndarray, mean: float):
        sizes = np.array([len(t) for t in terms])
        doc = np.repeat(np.arange(len(terms)), sizes)
        term, tf = np.concatenate(terms), np.concatenate(tfs).astype(np.float32)
        norm = (K1 * (1 - B + B * lengths / mean)).astype(np.float32)
        weight = (idf[term] * tf * (K1 + 1) / (tf + norm[doc])).astype(np.float32)
        self.queries = terms
        order = np.argsort(term, kind="stable")
        self.doc, self.weight, term = doc[order], weight[order], term[order]
        self.known, at = np.unique(term, return_index=True)
        self.ends = np.append(at, len(term))

    def scores(self, seed: int) -> np.ndarray:
        at = np.searchsorted(self.known, self.queries[seed])
        parts = [slice(self.ends[k], self.ends[k + 1]) for k in at]
        return np.bincount(np.concatenate([self.doc[p] for p in parts]),
                           np.concatenate([self.weight[p] for p in parts]), len(self.queries))


def fill(lengths: np.ndarray, index: Index, window: int = WINDOW) -> list[list[tuple[int, int, int]]]:
    """Windows as lists of (document, start, length) over rests shorter than a window."""
    start, left = np.zeros(len(lengths), np.int64), lengths.copy()
    order = np.lexsort((np.arange(len(left)), -left))
    heads, out = 0, []
    while True:
        while heads < len(order) and left[order[heads]] == 0:
            heads += 1
        if heads == len(order):
            return out
        seed = int(order[heads])
        row, room = [(seed, int(start[seed]), int(left[seed]))], int(window - left[seed])
        left[seed] = 0
        if room >= GRAIN:
            score = index.scores(seed)
            score[left == 0] = 0
            near = np.flatnonzero(score)
            for i in near[np.argsort(-score[near], kind="stable")].tolist():
                room = _put(row, i, start, left, room)
                if room < GRAIN:
                    break
            k = heads
            while room >= GRAIN and k < len(order):
                if left[order[k]]:
                    room = _put(row, int(order[k]), start, left, room)
                k += 1
        out.append(row)


def _put(row, i, start, left, room):
    take = int(left[i]) if left[i] <= room else room // GRAIN * GRAIN
    row.append((i, int(start[i]), take))
    start[i] += take
    left[i] -= take
    return room - take


def _folded(terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The dimension and the sign of each term."""
    h = terms.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(40)).astype(np.int64) % FOLDED, np.where(h >> np.uint64(63), 1, -1).astype(np.float32)


class Places:
    """Where documents lie by content: centroids and axes fitted on a sample."""

    def __init__(self, terms: list[np.ndarray], tfs: list[np.ndarray], idf: np.ndarray, cells: int, sides: int, rounds: int = 8):
        self.idf, self.sides = idf, sides
        at, sign = _folded(np.arange(len(idf)))
        x = np.zeros((len(terms), FOLDED), np.float32)
        for row, t, tf in zip(x, terms, tfs):
            v = idf[t] * np.sqrt(tf) * sign[t]
            row += np.bincount(at[t], v, FOLDED) / (np.linalg.norm(v) + 1e-9)
        mean = x.mean(0)
        axes = np.linalg.eigh((x - mean).T @ (x - mean))[1][:, :-AXES - 1:-1]
        self.turned = (axes[at] * sign[:, None]).astype(np.float32)  # a row a term
        self.shift = mean @ axes
        z = x @ axes - self.shift
        self.centres = z[np.random.default_rng(0).choice(len(z), min(cells, len(z)), replace=False)]
        for _ in range(rounds):
            near = self._near(z)
            size = np.bincount(near, minlength=len(self.centres))
            total = np.zeros_like(self.centres)
            np.add.at(total, near, z)
            self.centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], self.centres)

    def _near(self, z: np.ndarray) -> np.ndarray:
        return np.argmax(z @ self.centres.T - 0.5 * (self.centres ** 2).sum(1), 1)

    def find(self, terms: list[np.ndarray], tfs: list[np.ndarray]) -> np.ndarray:
        """The place of each document."""
        t, sizes = np.concatenate(terms), np.array([len(x) for x in terms])
        v = self.idf[t] * np.sqrt(np.concatenate(tfs), dtype=np.float32)
        row = np.repeat(np.arange(len(sizes)), sizes)
        norm = np.sqrt(np.bincount(row, v * v, len(sizes))) + 1e-9
        z = np.zeros((len(sizes), AXES), np.float32)
        some = sizes > 0
        if some.any():
            z[some] = np.add.reduceat(self.turned[t] * v[:, None], (np.cumsum(sizes) - sizes)[some])
        z = z / norm[:, None] - self.shift
        near = self._near(z)
        side = (z[:, :self.sides] > self.centres[near][:, :self.sides]) @ (1 << np.arange(self.sides, dtype=np.int64))
        return near << 16 | side


def _arrays(column) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4") for x in column]


def _dealt(rows: DataFrame, idf: np.ndarray) -> DataFrame:
    """The rows with their shard's number."""
    rest = F.col("n") % WINDOW
    need = F.greatest(F.ceil(F.sum(rest) / SHARD_IDS), F.ceil(F.count("*") / SHARD_ROWS), F.ceil(F.sum("n") / (WHOLE * SHARD_IDS)), F.lit(1))
    n, shards = rows.agg(F.count("*"), need).first()
    if shards == 1:
        return rows.withColumn("shard", F.lit(0).cast("long"))
    share = F.lit(int(min(1.0, SAMPLE / n) * (1 << 31)))
    some = rows.where((F.xxhash64("r").bitwiseAND((1 << 31) - 1) < share)).select("terms", "tfs").toPandas()
    if some.empty:
        return rows.withColumn("shard", F.pmod(F.xxhash64("r"), F.lit(shards)))
    cells = min(CELLS, shards)
    places = Places(_arrays(some["terms"]), _arrays(some["tfs"]), idf, cells, min(16, math.ceil(math.log2(shards / cells))))
    held = rows.sparkSession.sparkContext.broadcast(places)

    def locate(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                got = held.value.find(*(_arrays(part.column(c).to_pylist()) for c in ("terms", "tfs")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.int64())], [*part.schema.names, "place"])

    ddl = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", place long"
    rows = saved(rows.mapInArrow(locate, ddl), "packing-places")
    sizes = rows.groupBy("place").agg(need.alias("parts"))
    salt = F.pmod(F.xxhash64("r"), F.col("parts"))
    return rows.join(sizes, "place").withColumn("shard", F.shiftleft("place", 19) + salt).drop("place", "parts")


def pack(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): the pieces of all windows."""
    docs = has_columns(docs, "doc_id", "text")
    all_rows = _encoded(docs, path)
    rows = all_rows.where(F.col("crcs").isNotNull())
    df = all_rows.where(F.col("crcs").isNull()).groupBy("n").agg(F.sum("r").alias("c")).toPandas()
    n, mean = rows.agg(F.count("*"), F.avg("n")).first()
    idf = np.zeros(int(df["n"].max()) + 1 if len(df) else 1, np.float32)
    idf[df["n"].to_numpy(np.int64)] = np.log1p((n - df["c"] + 0.5) / (df["c"] + 0.5))
    held = docs.sparkSession.sparkContext.broadcast((idf, float(mean or 1)))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        idf, mean = held.value
        pdf = pdf.sort_values("r", ignore_index=True)
        total = pdf["n"].to_numpy(np.int64)
        crcs = _arrays(pdf["crcs"])
        cut = total // WINDOW * WINDOW
        index = Index(_arrays(pdf["terms"]), _arrays(pdf["tfs"]), total, idf, mean)
        pieces = [[(i, s, WINDOW)] for i in range(len(total)) for s in range(0, int(cut[i]), WINDOW)]
        pieces += [[(i, int(cut[i]) + s, m) for i, s, m in row] for row in fill(total - cut, index)]
        base, out = int(pdf["shard"].iloc[0]) << 20, []
        for k, row in enumerate(pieces):
            at = 0
            for i, s, m in row:
                out.append((i, s, m, piece_crc(crcs[i], int(total[i]), s, m), int(total[i]), base + k, at))
                at += m
        got = pd.DataFrame(out, columns=["i", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
        got.insert(0, "doc_id", pdf["doc_id"].to_numpy()[got["i"]])
        return got.drop(columns="i")

    # Ids travel as text: pandas would make floats of a nullable number.
    dealt = _dealt(rows, idf).withColumn("doc_id", F.col("doc_id").cast("string"))
    out = dealt.groupBy("shard").applyInPandas(
        work, "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def sequences(pieces: DataFrame, docs: DataFrame, path: str) -> DataFrame:
    """(sequence_id, ids array<int>): the windows' token ids, for docs with distinct ids."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        flat, ends = encoder(path).encode_batch(texts, CLOSE)
        return lists(flat.astype(np.int32), ends)

    coded = has_columns(docs, "doc_id", "text").select("doc_id", ids("text").alias("ids"))
    part = pieces.join(coded, "doc_id").select("sequence_id", F.struct(
        "offset", F.expr("slice(ids, cast(start + 1 as int), cast(length as int))").alias("ids")).alias("p"))
    return part.groupBy("sequence_id").agg(F.flatten(F.transform(
        F.array_sort(F.collect_list("p")), lambda p: p["ids"])).alias("ids"))
