"""Embedding near-duplicates: int8 tile products with error bounds, then exact recomputing.

Unit vectors are quantised to int8 with a scale of their own. The product of two quantised
tiles is exact in whole numbers; with each vector's measured quantisation error it bounds the
true cosine from above. Only pairs whose bound reaches the threshold are computed again in
double precision. A tile pair gives back link counts and a spanning forest, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratewright.llm.common import land
from ratewright.llm.components import components

THRESHOLD = 0.9
TILE = 4096
#: Rows of one product that are held at a time.
STRIP = 512
#: Components up to which sums of products of int8 are whole numbers below 2 ** 24, which float32 holds
#: exactly; longer vectors are multiplied in float64.
EXACT_IN_FLOAT32 = (1 << 24) // 127**2
#: Covers the rounding of the double-precision arithmetic that the bounds are made with.
SLACK = 1e-9


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales, error norms and norms of the quantised vectors, of unit rows."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    return q, scale, np.linalg.norm(x - near, axis=1), np.linalg.norm(near, axis=1)


def linked(x: np.ndarray, y: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows with cosine >= threshold, strip by strip; of one tile each pair once."""
    qx, sx, ex, _ = quantised(x)
    qy, sy, ey, ny = (qx, sx, ex, _) if same else quantised(y)
    # x.y = near_x.near_y + error_x.near_y + x.error_y, and x has length 1
    kind = np.float32 if x.shape[1] <= EXACT_IN_FLOAT32 else np.float64
    right = qy.astype(kind).T
    for start in range(0, len(x), STRIP):
        rows = slice(start, start + STRIP)
        product = qx[rows].astype(kind) @ right
        # bound: sx sy product + ex ny + ey >= threshold, kept as a limit for each column and row
        bound = product * sx[rows, None].astype(np.float32) * sy.astype(np.float32)
        bound += (ex[rows, None] * ny).astype(np.float32)
        bound += (ey + 1e-5).astype(np.float32)  # also covers float32 rounding of the bound
        i, j = np.nonzero(bound >= threshold - SLACK)
        i += start
        if same:
            i, j = i[i < j], j[i < j]
        if len(i):
            exact = np.einsum("ij,ij->i", x[i], y[j])
            sure = exact >= threshold
            yield i[sure], j[sure]


class Forest:
    """Union-find over the rows of a tile pair."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (``vec_id,
    embedding``).

    Equal vectors form one class, which is compared once and counts as often as it has rows.
    Vectors of different lengths have no cosine and never link. Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing and are their own component,
    as is any vector without a link. A repeated vec_id is a row of its own that links like any
    other; null vec_ids come last as component ids: a component is named by its smallest id and
    is null if it has none. Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).withColumn(
        "usable",
        F.col("x").isNotNull()
        & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        & F.exists("x", lambda v: v != 0),
    )
    rows = rows.withColumn("usable", F.coalesce("usable", F.lit(False)))
    h1, h2 = F.xxhash64("x"), F.xxhash64(F.lit("second"), "x")
    keyed = rows.withColumn("h1", F.when(F.col("usable"), h1)).withColumn("h2", F.when(F.col("usable"), h2))
    classes = land(
        keyed.where("usable")
        .groupBy("h1", "h2")
        .agg(F.first("x").alias("x"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("node", F.struct("h1", "h2")),
        "vector-classes",
    )
    count = classes.count()
    tiles = max(1, -(-count // tile))
    # a class is in one tile of its length; tile pairs (i, j) with i <= j meet in a task of their own
    placed = classes.withColumn("tile", F.pmod("h2", F.lit(tiles)).cast("int"))
    partners = F.sequence(F.lit(0), F.lit(tiles - 1))
    spread = placed.withColumn("other", F.explode(partners)).select(
        F.size("x").alias("size"),
        F.least("tile", "other").alias("i"),
        F.greatest("tile", "other").alias("j"),
        "tile",
        "h1",
        "h2",
        "copies",
        "x",
    )

    def meet(table: pa.Table) -> pa.Table:
        part = table.select(["tile", "h1", "h2", "copies"]).to_pandas()
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        x = np.array(table["x"].combine_chunks().flatten(), np.float64).reshape(len(part), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        one, two = np.flatnonzero(part["tile"] == i), np.flatnonzero(part["tile"] == j)
        copies = part["copies"].to_numpy()
        links, forest, a, b = np.zeros(len(part), np.int64), Forest(len(part)), [], []
        for p, q in linked(x[one], x[two], threshold, i == j):
            p, q = one[p], two[q]
            links += np.bincount(p, copies[q], len(part)).astype(np.int64)
            links += np.bincount(q, copies[p], len(part)).astype(np.int64)
            for s, t in zip(p.tolist(), q.tolist()):
                if forest.join(s, t):
                    a.append(s)
                    b.append(t)
        some = np.flatnonzero(links)
        h1, h2 = part["h1"].to_numpy(), part["h2"].to_numpy()
        none = np.zeros(len(a), np.int64)
        return pa.table(
            {
                "h1": np.concatenate([h1[some], h1[a]]),
                "h2": np.concatenate([h2[some], h2[a]]),
                "links": np.concatenate([links[some], none]),
                "to1": pa.array(np.concatenate([h1[some] * 0, h1[b]]), mask=np.arange(len(some) + len(a)) < len(some)),
                "to2": pa.array(np.concatenate([h2[some] * 0, h2[b]]), mask=np.arange(len(some) + len(a)) < len(some)),
            }
        )

    found = land(
        spread.groupBy("size", "i", "j").applyInArrow(meet, "h1 long, h2 long, links long, to1 long, to2 long"),
        "vector-links",
    )
    links = found.where("to1 IS NULL").groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    groups = components(
        found.where("to1 IS NOT NULL").select(
            F.struct("h1", "h2").alias("a"), F.struct(F.col("to1").alias("h1"), F.col("to2").alias("h2")).alias("b")
        )
    ).select(F.col("node.h1").alias("h1"), F.col("node.h2").alias("h2"), "component")
    state = (
        classes.select("h1", "h2", "copies", "least")
        .join(links, ["h1", "h2"], "left")
        .join(groups, ["h1", "h2"], "left")
        .withColumn("component", F.coalesce("component", F.struct("h1", "h2")))
    )
    names = state.groupBy("component").agg(F.min("least").alias("component_id"))
    state = state.join(names, "component").select("h1", "h2", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = keyed.select("vec_id", "h1", "h2").join(state, ["h1", "h2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
