"""Nearest vectors of one label by inner product: found by matrix products, scored term by term."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a label that a task takes of either side, about; products made at once.
TILE, CELLS = 4096, 1 << 21


def candidates(vectors: DataFrame, k: int, digits: int) -> DataFrame:
    """``vec_id, near_id, score``: for each of ``vec_id, embedding, label`` the best ``k`` others of its label, and some more.

    What is left out comes after ``k`` others by the score, rounded to ``digits``, and the smaller id.  A score
    is the sum of the products from the first element on; it is null, and last, for vectors that are null,
    have a null or differ in length.  A label's rows are dealt to tiles, and each tile meets each.
    """
    known = vectors.filter("label is not null and vec_id is not null").select("label", F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    n = known.groupBy("label").agg(F.ceil(F.count("*") / F.lit(TILE)).cast("int").alias("n"))
    v = known.join(n, "label").withColumn("tile", F.pmod(F.xxhash64("vec_id", "embedding"), F.col("n")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
    rows = v.select("label", F.col("tile").alias("i"), every.alias("j"), F.lit(True).alias("row"), "vec_id", "embedding")
    near = v.select("label", every.alias("i"), F.col("tile").alias("j"), F.lit(False).alias("row"), "vec_id", "embedding")

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).combine_chunks()
        for x, y, z in tile(np.asarray(t["row"]), np.asarray(t["vec_id"]), t["embedding"].combine_chunks(), k, digits):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(z, pa.float64())], ["vec_id", "near_id", "score"])

    meet.__annotations__ = {"key": tuple[pa.Scalar, ...], "batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return rows.unionByName(near).groupBy("label", "i", "j").applyInArrow(meet, "vec_id bigint, near_id bigint, score double")


def tile(row: np.ndarray, ids: np.ndarray, vectors: pa.Array, k: int, digits: int) -> Iterator[tuple]:
    """``vec_id, near_id, score`` of the rows against the others."""
    size = np.asarray(pc.list_value_length(vectors).fill_null(0)).astype(np.int64)
    start, flat = np.cumsum(size) - size, pc.list_flatten(vectors)
    gaps = np.bincount(np.asarray(pc.list_parent_indices(vectors)).astype(np.int64), np.asarray(flat.is_null()).astype(float), len(size))
    size[(gaps > 0) | np.asarray(vectors.is_null())] = -1
    flat = np.asarray(flat.fill_null(0)).astype(float)
    for length in np.unique(size[row]).tolist():
        a, b = np.flatnonzero(row & (size == length)), np.flatnonzero(~row & (size == length) & (size >= 0))
        if len(b):
            of = lambda at: flat[start[at][:, None] + np.arange(length)]  # noqa: B023, E731
            yield from _best(ids[a], of(a), ids[b], of(b), k, digits)
        # whoever has less than k others with a score gets some without
        rest, scored = np.sort(ids[~row & ((size != length) | (size < 0))]), np.sort(ids[b])
        for i in ids[a][len(b) - (np.searchsorted(scored, ids[a], "right") - np.searchsorted(scored, ids[a])) < k].tolist():
            other = np.concatenate([rest[: np.searchsorted(rest, i)][:k], rest[np.searchsorted(rest, i, "right") :][:k]])[:k]
            yield np.full(len(other), i), other, pa.nulls(len(other), pa.float64())


def _best(ai: np.ndarray, a: np.ndarray, bi: np.ndarray, b: np.ndarray, k: int, digits: int) -> Iterator[tuple]:
    """Equal vectors are compared once, and of those only the first ids matter."""
    length = a.shape[1]
    whole = np.ascontiguousarray(b).view(np.dtype((np.void, 8 * length))).ravel() if length else np.zeros(len(b))
    _, first, group = np.unique(whole, return_index=True, return_inverse=True)
    often = int(np.unique(bi, return_counts=True)[1].max())
    order = np.lexsort((bi, group))
    ids, count = bi[order], np.bincount(group)
    start, b, most = np.cumsum(count) - count, b[first], k + often
    with np.errstate(all="ignore"):
        far = np.sqrt((b * b).sum(1)).max()
        for lo in range(0, len(a), max(1, CELLS // len(b))):
            x, xi = a[lo : lo + max(1, CELLS // len(b))], ai[lo : lo + max(1, CELLS // len(b))]
            s = x @ b.T
            s[np.isnan(s)] = np.inf
            least = np.full(len(x), -np.inf) if len(b) <= most else np.partition(s, len(b) - most, axis=1)[:, len(b) - most]
            slack = np.nan_to_num(1.001 * 10.0**-digits + 1e-12 * far * np.sqrt((x * x).sum(1)), nan=np.inf, posinf=np.inf)
            q, g = np.nonzero(s >= np.where(np.isinf(least), least, least - slack)[:, None])
            score = np.zeros(len(q))
            for c in range(length):
                score += x[q, c] * b[g, c]
            n = np.minimum(count[g], most)
            of = np.repeat(np.arange(len(g)), n)
            near = ids[np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + start[g][of]]
            q, score = q[of], score[of]
            other = near != xi[q]
            q, near, score = q[other], near[other], score[other]
            # a score next to where the rounding turns is kept, the others are ranked
            scaled = score * 10.0**digits + 0.5
            place = np.floor(scaled)
            sure = np.abs(scaled - np.round(scaled)) > 1e-4 + np.abs(scaled) * 1e-15
            kept = ~sure
            at = np.flatnonzero(sure)
            at = at[np.lexsort((near[at], -place[at], q[at]))]
            nth = np.arange(len(at)) - np.searchsorted(q[at], q[at])
            kept[at[nth < k]] = True
            yield xi[q[kept]], near[kept], score[kept]
