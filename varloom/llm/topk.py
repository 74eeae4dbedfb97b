"""Exact top-k inner-product search on a bit-sliced index.

Vectors are quantised to integers; a block of candidates is stored as bit slices: for every
component and binary digit, one bitmap over the block's rows. A query's scores are the weighted sum
of the slices. The sum is made with bitmap arithmetic only: every slice is placed at the binary
weights of the query's component, and full adders (three bitmaps of one weight give a sum bitmap and
a carry bitmap of the next weight) reduce each weight to one slice. The top rows are then selected
from the most significant slice downward; the rows that tie at the boundary are resolved by the
smaller id. Negative query components add the complemented slice, which shifts all scores of the
query by a constant.

Blocks of candidates meet blocks of queries by a cogroup on both blocks' numbers: the few queries are
sent to the candidates' blocks, whose slices are built once a pair of blocks, and the k best of each
pair are merged per query.

Defined results: vectors that are null or hold null or non-finite components, and rows with a null
id, take no part; shorter vectors count as padded with zeros; a quantised component of 2**62 or more, or
a reported score beyond a long, raises; rows with the query's own id are no candidates for it; repeated candidates all count, ties
beyond the id are equal rows. Each query row gets its own k rows: equal query rows get equal ones, unlike vectors under one query id are
ranked apart. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import has_columns, list_ends

BLOCK_ROWS, BLOCK_QUERIES, LIMIT = 8192, 1024, 1 << 62


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(id, q array<int>) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    q = F.transform(v, lambda x: F.when(F.abs(x * scale) < LIMIT, F.floor(x * scale)).otherwise(
        F.raise_error(F.lit("a quantised component is too large")).cast("long")))
    return (has_columns(vectors, id_col, vec_col).where(F.col(id_col).isNotNull() & v.isNotNull() & fine)
            .select(F.col(id_col).cast("long").alias("id"), q.alias("q")))


def _matrix(rows: pa.Table, dims: int) -> np.ndarray:
    """The vectors of a table as rows of a matrix, padded with zeros."""
    q = rows.column("q").combine_chunks()
    q = q if isinstance(q, pa.ListArray) else q.chunk(0)
    ends, flat = list_ends(q), q.flatten().to_numpy()
    out = np.zeros((len(q), dims), np.int64)
    out[np.arange(dims) < np.diff(ends)[:, None]] = flat
    return out


def slices(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Bit slices (dims, digits, words) of m - min, the minima, and the number of digits."""
    low = m.min(0) if len(m) else np.zeros(m.shape[1], np.int64)
    u = m.astype(np.uint64) - low.astype(np.uint64)  # right modulo 2**64
    digits = max(1, int(u.max(initial=0)).bit_length())
    words = -(-len(m) // 64)
    bits = np.zeros((m.shape[1], digits, words * 64), np.uint8)
    for b in range(digits):
        bits[:, b, :len(m)] = ((u >> np.uint64(b)) & np.uint64(1)).T
    return np.packbits(bits, axis=2, bitorder="little").view(np.uint64), low, digits


def add(placed: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """Sums bitmaps by weight with full adders; gives one slice a weight, least first."""
    out, w = [], 0
    while placed:
        here = placed.pop(w, [])
        if here:
            x = np.concatenate([a if a.ndim == 2 else a[None] for a in here])
            carries = []
            while len(x) > 1:
                if len(x) == 2:
                    carries.append((x[0] & x[1])[None])
                    x = (x[0] ^ x[1])[None]
                    continue
                n = len(x) // 3
                a, b, c = x[:n], x[n:2 * n], x[2 * n:3 * n]
                t = a ^ b
                carries.append((a & b) | (c & t))
                x = np.concatenate([t ^ c, x[3 * n:]])
            out.append(x[0])
            if carries:
                placed.setdefault(w + 1, []).extend(carries)
        else:
            out.append(None)
        w += 1
    zero = next((np.zeros_like(x) for x in out if x is not None), None)
    return [zero if x is None else x for x in out]


def query_sum(index: np.ndarray, digits: int, q: np.ndarray, valid: np.ndarray) -> list[np.ndarray]:
    """The slices of sum_d q_d * row_d, up to a constant, over the block's rows."""
    placed: dict[int, list[np.ndarray]] = {}
    plus, minus = index, ~index & valid
    for bit in range(int(np.abs(q).max(initial=0)).bit_length()):
        on = (np.abs(q) >> bit) & 1 == 1
        use = np.concatenate([plus[on & (q > 0)], minus[on & (q < 0)]])
        if len(use):
            for b in range(digits):
                placed.setdefault(bit + b, []).append(use[:, b])
    return add(placed)


def count_bits(x: np.ndarray) -> int:
    return int(np.bitwise_count(x).sum())


def select(total: list[np.ndarray], alive: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(surely in, tied at the boundary, how many of the tied are to be taken)."""
    sure, tied = np.zeros_like(alive), alive.copy()
    for s in reversed(total):
        more = sure | (tied & s)
        n = count_bits(more)
        if n > k:
            tied &= s
        else:
            sure, tied = more, tied & ~s
            if n == k:
                return sure, np.zeros_like(alive), 0
    return sure, tied, k - count_bits(sure)


def _places(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(x.view(np.uint8), bitorder="little"))


def search_block(ids: np.ndarray, m: np.ndarray, qids: np.ndarray, qm: np.ndarray, k: int) -> list[tuple]:
    """(query_id, vec_id, score, query's place) of the k best rows of a block for each query."""
    order = np.argsort(ids, kind="stable")
    ids, m = ids[order], m[order]  # rows by id: the first set bits of a tie are the smallest ids
    index, _, digits = slices(m)
    valid = np.packbits(np.arange(index.shape[2] * 64) < len(ids), bitorder="little").view(np.uint64)
    # Where no sum can overflow, scores come from numpy.
    small = float((np.abs(m).max(0, initial=0).astype(float) * np.abs(qm).max(0, initial=0)).sum()) < 1 << 62
    out = []
    for place, (qid, q) in enumerate(zip(qids.tolist(), qm)):
        alive = valid.copy()
        a, b = np.searchsorted(ids, [qid, qid + 1])
        for i in range(a, b):
            alive[i >> 6] &= ~np.uint64(1 << (i & 63))
        sure, tied, rest = select(query_sum(index, digits, q, valid), alive, k)
        for i in np.concatenate([_places(sure), _places(tied)[:rest]]).tolist():
            out.append((qid, int(ids[i]), int(m[i] @ q) if small else sum(a * b for a, b in zip(m[i].tolist(), q.tolist())), place))
            if not -(1 << 63) <= out[-1][2] < 1 << 63:
                raise OverflowError("a score is beyond a long")
    return out


def search(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
           scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for every row where `queries` holds.

    `queries` is a condition on the column `id`.
    """
    rows = quantised(vectors, id_col, vec_col, scale)
    # Equal query rows are asked once; a vector's digest keeps unlike ones under one id apart.
    asks = rows.where(queries).groupBy("id", "q").agg(F.count("*").alias("times")).withColumn(
        "key", F.sha2(F.concat_ws(",", F.col("q").cast("array<string>")), 256))
    n, nq = rows.count(), asks.count()
    blocks, qblocks = max(1, math.ceil(n / BLOCK_ROWS)), max(1, math.ceil(nq / BLOCK_QUERIES))
    number = lambda parts: F.pmod(F.xxhash64(F.col("id") + parts), F.lit(parts))
    each = lambda parts: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    left = rows.select(number(blocks).alias("block"), each(qblocks).alias("qblock"), "id", "q")
    right = asks.select(each(blocks).alias("block"), number(qblocks).alias("qblock"), "id", "q", "key", "times")
    found = pa.schema([("query_id", pa.int64()), ("key", pa.string()), ("times", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def work(mine: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if mine.num_rows and asked.num_rows:
            dims = max(int(pc.max(pc.list_value_length(t.column("q"))).as_py()) for t in (mine, asked))
            out = search_block(mine.column("id").to_numpy(), _matrix(mine, dims), asked.column("id").to_numpy(), _matrix(asked, dims), k)
        numbers = [pa.array([r[c] for r in out], pa.int64()) for c in range(4)]
        return pa.table([numbers[0], *(asked.column(c).combine_chunks().take(numbers[3]) for c in ("key", "times")), *numbers[1:3]], schema=found)

    best = left.groupBy("block", "qblock").cogroup(right.groupBy("block", "qblock")).applyInArrow(
        work, "query_id long, key string, times long, vec_id long, score long")
    w = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .withColumn("time", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("query_id", "rank", "vec_id", "score"))
