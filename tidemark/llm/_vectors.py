"""Whole-number vectors for exact searches: rows that take part, packed vectors, exact scores, and bounded samples."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a sample (those of the smallest id hashes) and its bytes; dimension counts that have one.
SAMPLE, SAMPLE_BYTES, DIMENSIONS = 8192, 64 << 20, 16
#: Largest squared length (of whole numbers) at which double arithmetic gives exact inner products.
EXACT = 2.0**52


def whole_vectors(vectors: DataFrame, scale: float, id_col: str, vector_col: str, **more: Column) -> DataFrame:
    """(id, dim, v, and `more`): floor(scale * vector) as doubles. Vectors that are null, empty or hold a null or non-finite component, and null ids, take no part."""
    fine = F.col(id_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    scaled = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    return vectors.where(fine).select(F.col(id_col).cast("long").alias("id"), F.size(vector_col).alias("dim"), scaled.alias("v"), *[c.alias(n) for n, c in more.items()])


def samples(rows: DataFrame, *columns: str) -> dict[int, dict[str, np.ndarray]]:
    """For each of the commonest dimension counts: `id`, `v` and columns of a sample, SAMPLE_BYTES at most in all."""
    found = {}
    for dim in [r["dim"] for r in rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(DIMENSIONS).collect()]:
        most = max(1, min(SAMPLE, SAMPLE_BYTES // DIMENSIONS // (8 * dim)))
        some = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("id"), "id").select("id", "v", *columns).limit(most).toPandas()
        found[dim] = {"v": np.stack(some["v"].to_numpy())} | {c: some[c].to_numpy() for c in ("id", *columns)}
    return found


def pack(data: np.ndarray) -> bytes:
    """A matrix of whole numbers, in 4 bytes each if they fit."""
    return data.astype(np.int32 if np.abs(data).max(initial=0) < 2**31 else np.float64).tobytes()


def unpack(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.int32 if len(data) == 4 * dim * rows else np.float64).astype(np.float64).reshape(-1, dim)


def lengths(x: np.ndarray) -> np.ndarray:
    """Squared lengths."""
    return (x**2).sum(1)


def scores(queries: np.ndarray, rows: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products as 64-bit numbers. exact: doubles hold them; else they are taken in 64-bit arithmetic, which is right if the product itself fits."""
    return (queries @ rows.T).astype(np.int64) if exact else queries.astype(np.int64) @ rows.astype(np.int64).T


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances by differences, so that near ones lose no digits."""
    out = np.empty((len(x), len(points)))
    step = max(1, (1 << 20) // max(1, points.size))
    for at in range(0, len(x), step):
        out[at : at + step] = np.sqrt(((x[at : at + step, None] - points[None]) ** 2).sum(2))
    return out
