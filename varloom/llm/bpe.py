"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

The bytes of many pre-tokens form linked lists, one a pre-token. Each neighbouring pair that is a
token waits in the bucket of its rank; a three-level bitmap over the ranks finds the lowest
non-empty bucket by find-first-set. The bucket's positions are merged together: pre-tokens do not
touch each other, and within one the leftmost of overlapping pairs comes first; where a merge would
bring up a lower rank, only the pre-token's leftmost position is merged and the others wait. A merge
changes two pairs, whose old entries stay in their buckets and are skipped as stale when they come
up. So n bytes take O(n log n) steps, whether in one pre-token or in many.

Defined results: null text encodes as the empty text, that is to no ids; null ids decode to no
bytes, unknown ids raise. Rows are encoded alone, so repeated rows get equal ids. Other columns of
the input are kept by encode() and decode().
"""

from __future__ import annotations

import base64
import itertools
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, list_ends, lists

#: Pre-tokens whose ids a Python worker keeps; others are encoded anew.
CACHE = 400_000
#: Bytes of text that are encoded together.
SLICE = 1 << 23
#: White space other than single spaces and newlines between words, for which a text is split as a whole.
_ODD = (r"[\x00-\x09\x0b-\x1f\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
        r"|[ \n][ \n]|\A[ \n]|[ \n]\z")


class RankQueue:
    """Positions by rank. A bit of `low` stands for a rank with a bucket, a bit of `mid` for a word of
    `low` with bits, a bit of `top` for a word of `mid` with bits."""

    def __init__(self, ranks: int):
        self.low = [0] * (ranks // 64 + 1)
        self.mid = [0] * (len(self.low) // 64 + 1)
        self.top = 0
        self.buckets: dict[int, list[np.ndarray]] = {}

    def push(self, at: np.ndarray, ranks: np.ndarray) -> None:
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
        for a, b in itertools.pairwise(cuts):
            r = int(ranks[a])
            bucket = self.buckets.get(r)
            if bucket is not None:
                bucket.append(at[a:b])
                continue
            self.buckets[r] = [at[a:b]]
            self.low[r >> 6] |= 1 << (r & 63)
            self.mid[r >> 12] |= 1 << (r >> 6 & 63)
            self.top |= 1 << (r >> 12)

    def pop(self) -> tuple[int, np.ndarray]:
        """The lowest rank and its positions."""
        x = (self.top & -self.top).bit_length() - 1
        m = self.mid[x]
        y = x << 6 | (m & -m).bit_length() - 1
        w = self.low[y]
        rank = y << 6 | (w & -w).bit_length() - 1
        self.low[y] = w & w - 1
        if not self.low[y]:
            self.mid[x] = m & m - 1
            if not self.mid[x]:
                self.top &= self.top - 1
        bucket = self.buckets.pop(rank)
        return rank, bucket[0] if len(bucket) == 1 else np.concatenate(bucket)


def _parts(texts: list[str], size: int):
    """Runs of texts of about `size` letters together."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield texts[at:i + 1]
            at, total = i + 1, 0
    if at < len(texts):
        yield texts[at:]


class Codec:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.known = np.zeros(len(self.tokens), bool)
        self.known[list(self.ranks.values())] = True
        self.table = pa.array(self.tokens, pa.binary())
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.pattern = regex.compile(pattern)
        # Ranks of two bytes, and of any two tokens whose bytes together are a token.
        size = len(self.tokens)
        self.single = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        self.double = np.full((256, 256), -1, np.int32)
        pairs = []
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.double[token[0], token[1]] = rank
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append((a * (size + 1) + b, rank))
        pairs.sort()
        self.keys, self.found = np.array(pairs or [(-1, -1)], np.int64).T.copy()
        self.pieces: dict[str, bytes] = {}
        # Splitting at single spaces and newlines equals the pattern's own cuts for the public
        # pattern only; for another one every text goes through the pattern.
        import public_tokenizers

        self.simple = pattern == public_tokenizers.PATTERN

    def rank(self, a, b) -> np.ndarray:
        """The ranks of pairs of tokens, -1 where they are no token together."""
        key = np.asarray(a, np.int64) * (len(self.tokens) + 1) + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.found[at], -1)

    def merge(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pre-tokens in one array, and where each one's ids end, from 0."""
        raw = np.frombuffer(b"".join(raws), np.uint8)
        n, stop = len(raw), np.cumsum([len(r) for r in raws], dtype=np.int64)
        # Place n is the end of every list; its token goes with no other.
        token = np.append(self.single[raw], np.int32(len(self.tokens)))
        if (token < 0).any():
            raise KeyError("a byte is no token")
        after, before, alive = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32), np.ones(n, bool)
        after[stop - 1] = n
        before[np.append(0, stop[:-1])] = n
        pair = np.full(n + 1, -1, np.int32)
        pair[:n - 1] = self.double[raw[:-1], raw[1:]]
        pair[stop - 1] = -1
        queue, at = RankQueue(len(self.tokens)), np.flatnonzero(pair >= 0)
        if len(at):
            queue.push(at, pair[at])
        while queue.top:
            rank, at = queue.pop()
            at = np.unique(at[pair[at] == rank])  # the others are stale
            if not len(at):
                continue
            every, after_at = at, after[at]
            linked = np.append(False, after_at[:-1] == at[1:])
            if linked.any():  # of overlapping pairs every second one, from the left
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(linked, 0, place))) % 2 == 0]
                after_at = after[at]
            end, head = after[after_at], before[at]
            beside = np.flatnonzero(end[:-1] == at[1:])
            left_token = token[head]
            left_token[beside + 1] = rank
            right, left = self.rank(rank, token[end]), self.rank(left_token, rank)
            lower = (right >= 0) & (right < rank) | (left >= 0) & (left < rank)
            if lower.any():
                word = np.searchsorted(stop, at, "right")
                go = np.append(True, word[1:] != word[:-1]) | ~np.isin(word, word[lower])
                waits = every[np.isin(np.searchsorted(stop, every, "right"), word[lower]) & ~np.isin(every, at[go])]
                if len(waits):
                    queue.push(waits, np.full(len(waits), rank))
                    at = at[go]
                    after_at, head = after[at], before[at]
                    end = after[after_at]
                    beside = np.flatnonzero(end[:-1] == at[1:])
                    left_token = token[head]
                    left_token[beside + 1] = rank
                    right, left = self.rank(rank, token[end]), self.rank(left_token, rank)
            right[beside] = left[beside + 1]
            token[at] = rank
            after[at] = end
            before[end] = at
            head[beside + 1] = at[beside]
            pair[after_at] = -1
            alive[after_at] = False
            pair[head] = left
            pair[at] = right
            pair[n] = -1
            new, ranks = np.concatenate([at, head]), np.concatenate([right, left])
            met = ranks >= 0
            if met.any():
                queue.push(new[met], ranks[met])
        return token[:n][alive].astype(np.int32), np.append(0, np.cumsum(alive)[stop - 1]) if n else np.zeros(1, np.int64)

    def _cut(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        letters = text[1:] if text[:1] == " " else text
        one = self.simple and letters < "\u0250" and letters.isalpha()  # such a text is one match of the pattern
        return [text] if one else self.pattern.findall(text)

    def _chunks(self, texts: list[str]) -> list[bytes]:
        """The ids of texts as packed int32; their new pre-tokens are merged together."""
        known, cut = self.pieces, list(map(self._cut, texts))
        new = list({p for ps in cut for p in ps if p not in known})
        got: dict[str, bytes] = {}
        for some in _parts(new, 1 << 20):
            raws = [p.encode("utf-8", "replace") for p in some]
            whole = [self.ranks.get(r) for r in raws]
            rest = [i for i, r in enumerate(whole) if r is None]
            ids, ends = self.merge([raws[i] for i in rest])
            packed, ends = ids.tobytes(), (4 * ends).tolist()
            got.update((p, r.to_bytes(4, "little")) for p, r in zip(some, whole) if r is not None)
            got.update((some[i], packed[a:b]) for i, (a, b) in zip(rest, itertools.pairwise(ends)))
        if len(known) + len(got) > CACHE:
            out = [b"".join([known[p] if p in known else got[p] for p in ps]) for ps in cut]
            known.clear()
            known.update((p, b) for p, b in got.items() if len(p) < 64)
            return out
        known.update(got)
        out = [b"".join([known[p] for p in ps]) for ps in cut]
        for p in [p for p in got if len(p) >= 64]:
            del known[p]
        return out

    def encode_batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's ids end, from 0. Each distinct word of
        the batch is encoded once; the texts gather the ids by place."""
        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, _ODD) if self.simple else pa.array([True] * len(texts))
        marked = pc.replace_substring(pc.replace_substring(pc.if_else(odd, "", texts), " ", "\0 "), "\n", "\0\n\0")
        chunks = pc.split_pattern(marked, "\0")
        coded = chunks.flatten().dictionary_encode()
        parts = self._chunks(coded.dictionary.to_pylist())
        ids = lists(np.frombuffer(b"".join(parts), np.int32), np.cumsum([0, *map(len, parts)]) // 4).take(coded.indices)
        flat, ends = ids.flatten().to_numpy(), list_ends(ids)[list_ends(chunks)]
        if pc.any(odd).as_py():
            places = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
            whole = {i: np.frombuffer(raw, np.int32) for i, raw in zip(places, self._chunks(texts.filter(odd).to_pylist()))}
            rows = [whole[i] if i in whole else flat[a:b] for i, (a, b) in enumerate(itertools.pairwise(ends.tolist()))]
            flat, ends = np.concatenate(rows), np.append(0, np.cumsum([len(r) for r in rows]))
        return flat, ends

    def encode(self, text: str) -> bytes:
        """The ids as packed int32."""
        return self.encode_batch(pa.array([text], pa.string()))[0].tobytes()

    def decode_batch(self, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
        """The bytes of each row's ids; ends begins with 0."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.known) or not self.known[ids].all()):
            raise ValueError("unknown ids")
        cuts = np.append(0, np.cumsum(self.sizes[ids]))[ends].astype(np.int32)
        raw = []
        for k in range(0, len(ids), 1 << 22):
            part = self.table.take(pa.array(ids[k:k + (1 << 22)]))
            raw.append(part.buffers()[2].slice(0, int(self.sizes[ids[k:k + (1 << 22)]].sum())).to_pybytes())
        return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(b"".join(raw))])

    def decode(self, ids: np.ndarray) -> bytes:
        return self.decode_batch(np.asarray(ids, np.int64), np.array([0, len(ids)]))[0].as_py()


@lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encoded(text: Column, path: str, pattern: str) -> Column:
    """array<int>: the ids of the whole text."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        c = codec(path, pattern)
        return pa.concat_arrays([lists(*c.encode_batch(part)) for part in byte_slices(texts, SLICE)] or [pa.array([], pa.list_(pa.int32()))])

    return ids(text)


def decoded(ids: Column, path: str, pattern: str) -> Column:
    """binary: the bytes of the ids."""

    @F.arrow_udf("binary")
    def raw(arrays: pa.Array) -> pa.Array:
        arrays = pc.fill_null(arrays, pa.scalar([], arrays.type)) if arrays.null_count else arrays
        return codec(path, pattern).decode_batch(arrays.flatten().to_numpy(zero_copy_only=False), list_ends(arrays))

    return raw(ids)


def coded(text: Column, path: str, pattern: str) -> Column:
    """struct<ids array<int>, decoded binary>: the ids and, from them, the bytes, in one pass."""

    @F.arrow_udf("ids array<int>, decoded binary")
    def both(texts: pa.Array) -> pa.Array:
        c = codec(path, pattern)
        got = [c.encode_batch(part) for part in byte_slices(texts, SLICE)]
        ids = pa.concat_arrays([lists(*g) for g in got] or [pa.array([], pa.list_(pa.int32()))])
        raw = pa.concat_arrays([c.decode_batch(*g) for g in got] or [pa.array([], pa.binary())])
        return pa.StructArray.from_arrays([ids, raw], ["ids", "decoded"])

    return both(text)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """All columns of docs and the ids."""
    return docs.withColumn(out, encoded(F.col(text), path, pattern))


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of docs and the bytes."""
    return docs.withColumn(out, decoded(F.col(ids), path, pattern))


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: its id, the number of ids, and SHA-256 of the decimal ids and decoded bytes."""
    rows = docs.select("doc_id", coded(F.col("text"), path, pattern).alias("c"))
    return rows.select(
        "doc_id", F.size("c.ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("c.ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("c.decoded"), 256).alias("decoded_sha256"))
