"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are rotated to the principal axes of all rows, so the leading dimensions carry most of
a product. Two unit vectors with cosine >= t differ by at most sqrt(2 - 2t) along any axis, so rows
are cut into cells of that width on the two leading axes and only neighbouring cells of one label
are compared. Cells are split into tiles of at most about TILE rows, and pairs of tiles are the
units of work. Within a pair, products accumulate over groups of leading dimensions; after each
group the rest is bounded by the product of the suffix norms, and pairs that can't reach t any more
are dropped. What is left is decided by the cosine of the original vectors in double precision.

Equal vectors are one class: classes are compared, and counts come from class sizes.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, rows with
a null label, and vectors of different lengths link with nothing; such a row is its own component
and kept. Rows with one repeated id are copies of each other in every count. A row with a null id
links like any other, but its component is the smallest id that is not null. Other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, has_columns, local_roots, saved

TILE = 1024
GROUP = 8


def _axes(unit: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal axes of all unit vectors, from sums made on the executors."""

    def sums(batches):
        part: dict[int, np.ndarray] = {}
        for pdf in batches:
            for d, g in pdf.groupby("d"):
                x = np.stack(g["x"].to_numpy())
                x = np.hstack([x, np.ones((len(x), 1))])
                part[d] = part.get(d, 0) + x.T @ x
        for d, m in part.items():
            yield pd.DataFrame({"d": d, "i": np.arange(m.size), "s": m.ravel()})

    got = (unit.select("x", F.size("x").alias("d")).mapInPandas(sums, "d int, i int, s double")
           .groupBy("d", "i").agg(F.sum("s").alias("s")).toPandas())
    if got.empty:
        return np.zeros(0), np.zeros((0, 0))
    # The most common length is rotated; others keep their axes.
    by = {d: g.sort_values("i")["s"].to_numpy().reshape(d + 1, d + 1) for d, g in got.groupby("d")}
    m = max(by.values(), key=lambda a: a[-1, -1])
    n = m[-1, -1]
    mean = m[-1, :-1] / n
    _, axes = np.linalg.eigh(m[:-1, :-1] / n - np.outer(mean, mean))
    return mean, np.ascontiguousarray(axes[:, ::-1])


def similar(a: np.ndarray, b: np.ndarray, threshold: float, group: int = GROUP) -> tuple[np.ndarray, np.ndarray]:
    """Places of row pairs whose products may reach the threshold; rows are unit vectors in PCA order."""
    rest = lambda x: np.sqrt(np.maximum(np.cumsum((x * x)[:, ::-1], 1)[:, ::-1], 0))
    ra, rb = rest(a), rest(b)
    dims, slack = a.shape[1], 1e-6
    first = min(group, dims)
    s = a[:, :first] @ b[:, :first].T
    bound = np.outer(ra[:, first], rb[:, first]) if first < dims else 0
    i, j = np.nonzero(s + bound >= threshold - slack)
    s = s[i, j]
    for at in range(first, dims, group):
        if not len(i):
            break
        end = min(at + group, dims)
        s = s + np.einsum("ij,ij->i", a[i, at:end], b[j, at:end])
        bound = ra[i, end] * rb[j, end] if end < dims else 0
        keep = s + bound >= threshold - slack
        i, j, s = i[keep], j[keep], s[keep]
    return i, j


def links(rows: DataFrame, threshold: float = 0.98) -> DataFrame:
    """(cls, root, more) of each class with links in a pair of tiles: a class it is tied to there, and
    the rows it links with there; from (cls, label, size, v array<double>) classes. A row a class and
    pair of tiles, however many links there are.
    """
    # Scaled by the largest component first: squares neither overflow nor vanish.
    unit = rows.withColumn("x", F.expr("transform(v, x -> x / array_max(transform(v, y -> abs(y))))")).select(
        "cls", "label", "size", "v", F.expr("transform(x, y -> y / sqrt(aggregate(x, 0D, (s, z) -> s + z * z)))").alias("x"))
    mean, axes = _axes(unit)
    width = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    dims = len(mean)

    def rotate(batches):
        for pdf in batches:
            z = [x @ axes if len(x) == dims else np.asarray(x) for x in pdf["x"]]
            cell = [[int(np.floor(y[k] / width)) if len(y) > k else 0 for k in (0, 1)] for y in z]
            out = pdf[["cls", "label", "size", "v"]].copy()
            out["z"] = z
            out["cx"], out["cy"] = [c[0] for c in cell], [c[1] for c in cell]
            yield out

    kind = dict(rows.dtypes)
    cells = saved(unit.mapInPandas(
        rotate, f"cls long, label {kind['label']}, size long, v array<double>, z array<double>, cx int, cy int"), "cells")
    tiles = cells.groupBy("label", "cx", "cy").agg(F.ceil(F.count("*") / TILE).alias("tiles"))
    # A row goes to every pair of tiles that its own tile is in: with those of its own cell, and with
    # those of the neighbouring cells, the smaller cell first.
    near = tiles.select("label", F.col("cx").alias("nx"), F.col("cy").alias("ny"), F.col("tiles").alias("ntiles"))
    around = near.withColumn("dx", F.explode(F.array(*map(F.lit, (-1, 0, 1))))) \
        .withColumn("dy", F.explode(F.array(*map(F.lit, (-1, 0, 1))))) \
        .select("label", (F.col("nx") + F.col("dx")).alias("cx"), (F.col("ny") + F.col("dy")).alias("cy"),
                "nx", "ny", "ntiles")
    around = around.join(tiles, ["label", "cx", "cy"]).groupBy("label", "cx", "cy", "tiles").agg(
        F.collect_list(F.struct("nx", "ny", "ntiles")).alias("around"))  # nine at most
    dealt = cells.join(around, ["label", "cx", "cy"]).withColumn(
        "tile", F.pmod(F.xxhash64("cls"), F.col("tiles")))
    own = F.struct("cx", "cy", "tile")
    spread = dealt.withColumn("n", F.explode("around")).withColumn(
        "t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n.ntiles") - 1)))
    other = F.struct(F.col("n.nx").alias("cx"), F.col("n.ny").alias("cy"), F.col("t").alias("tile"))
    tasks = spread.select("label", "cls", "size", "v", "z", F.least(own, other).alias("p"), F.greatest(own, other).alias("q"),
                          (own == F.least(own, other)).alias("first"), (own == F.greatest(own, other)).alias("second"))
    tasks = tasks.select("label", F.concat_ws("/", *[F.col(f"{x}.{y}").cast("string") for x in "pq"
                                                     for y in ("cx", "cy", "tile")]).alias("unit"),
                         "cls", "size", "v", "z", "first", "second").groupBy("label", "unit")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        pdf = pdf.assign(d=pdf["z"].map(len))
        for _, g in pdf.groupby("d"):
            g = g.sort_values("cls", ignore_index=True)
            first, second = np.flatnonzero(g["first"]), np.flatnonzero(g["second"])
            if not len(first) or not len(second):
                continue
            z, v = np.stack(g["z"].to_numpy()), np.stack(g["v"].to_numpy())
            i, j = similar(z[first], z[second], threshold)
            i, j = first[i], second[j]
            keep = i < j if bool(g["second"].iloc[first[0]]) else i != j
            i, j = i[keep], j[keep]
            # A power of two as the scale changes no rounding.
            v = np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])
            norm = np.sqrt((v * v).sum(1))
            ok = np.concatenate([(v[x] * v[y]).sum(1) / (norm[x] * norm[y]) >= threshold for x, y in (
                (i[k:k + 65536], j[k:k + 65536]) for k in range(0, len(i), 65536))] or [np.zeros(0, bool)])
            i, j = i[ok], j[ok]
            size, more = g["size"].to_numpy(), np.zeros(len(g), np.int64)
            np.add.at(more, i, size[j])
            np.add.at(more, j, size[i])
            cls, root = g["cls"].to_numpy(), local_roots(len(g), i, j)
            met = more > 0
            out.append(pd.DataFrame({"cls": cls[met], "root": cls[root[met]], "more": more[met]}))
        return pd.concat(out) if out else pd.DataFrame({"cls": [], "root": [], "more": []}, dtype="int64")

    return saved(tasks.applyInPandas(compare, "cls long, root long, more long"), "vector-links")


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id",
                    vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = has_columns(vectors, id_col, vec_col, label_col).select(
        F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"),
        F.when(fine & F.col(label_col).isNotNull(), F.transform(v, lambda x: F.when(x == 0, 0.0).otherwise(x))).alias("v"))
    # Classes of equal vectors under one label; a class without an id that isn't null has none to give.
    key = F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws(
        ",", F.col("label").cast("string"), F.col("v").cast("array<string>")), 256))
    rows = rows.withColumn("key", key)
    classes = rows.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.first("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("size"),
        F.min("vec_id").alias("low"))
    classes = saved(classes.withColumn("cls", F.xxhash64("key")), "vector-classes")
    found = links(classes.select("cls", "label", "size", "v"), threshold)
    sizes = classes.select("cls", "size", "low")
    degree = found.groupBy("cls").agg(F.sum("more").alias("more"))
    comp = connected_components(found.select(F.col("cls").alias("u"), F.col("root").alias("v"))).select(
        F.col("id").alias("cls"), F.col("component").alias("root"))
    named = sizes.join(comp, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    low = named.groupBy("root").agg(F.min("low").alias("component"))
    info = (classes.select("key", "cls", "size").join(named.select("cls", "root"), "cls").join(low, "root")
            .join(degree, "cls", "left")
            .select("key", (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component"))
    out = rows.select("vec_id", "key").join(info, "key", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
