"""Exact top-k search by inner product: a table of distances to pivots bounds every score, and candidates are scored in the order of their bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import discard, read, written
from ._vectors import EXACT, lengths, pack, samples, scores, unpack, whole_vectors

#: Pivots of each dimension count, chosen among a sample; each costs 4 bytes a row in the stored table of distances.
PIVOTS = 1024
#: Vectors of a block of candidates, and queries that are broadcast in one round.
BLOCK, QUERIES = 1024, 8192
#: Pivots looked at between two eliminations, and candidates scored between two looks at the next bound.
CHUNK, STEP = 64, 64
#: Share of candidates that a chunk of pivots must eliminate for the next to be looked at.
LEAST_SPARED = 0.01
#: What rounding may do to a distance, as a share of both vectors' lengths, and to a squared length, as a share of it.
SLACK, SLACK_2 = 1e-6, 1e-11


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances up to SLACK of the lengths of both."""
    return np.sqrt(np.maximum(lengths(x)[:, None] + lengths(pivots)[None] - 2 * (x @ pivots.T), 0)).astype(np.float32)


def farthest_first(x: np.ndarray, k: int) -> np.ndarray:
    """Rows of x, each the one farthest from all before it; fewer where no other row is left."""
    chosen, low = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(k, len(x)):
        far = int(np.argmax(low))
        if low[far] <= 0:
            break
        chosen.append(far)
        np.minimum(low, ((x - x[far]) ** 2).sum(1), out=low)
    return np.array(chosen)


def kth_best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """A score that each query's k-th best candidate reaches: its k-th best among the given rows; the least number if they are fewer."""
    out = np.full(len(q), -(2**63), np.int64)
    exact = max(lengths(q).max(initial=0), lengths(rows).max(initial=0)) < EXACT
    for at in range(0, len(q), 1024) if len(rows) > k else ():
        part = slice(at, at + 1024)
        score = scores(q[part], rows, exact)
        own = q_ids[part][:, None] == ids[None]
        score[own] = -(2**63)
        best = np.partition(score, len(rows) - k, axis=1)[:, len(rows) - k]
        out[part] = best
    return out


def search_block(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, pivots: np.ndarray, k: int, threshold: np.ndarray | None = None, dq: np.ndarray | None = None, dc: np.ndarray | None = None) -> tuple[list[tuple[int, int, int]], int]:
    """(rows (query, candidate, score): of the block's candidates those that can be among the k best of each query, k at most, ties to the smaller id;
    candidates scored). threshold: a score that each query's k-th best reaches; dq, dc: distances to the pivots, if they are known.

    |d(q, p) - d(c, p)| over pivots p bounds the distance of q and c from below, and so their inner product from above. Pivots are looked at a few at a time,
    until they eliminate few more, and candidates whose bound is below the threshold leave. The others are scored in the order of their bounds until
    the next is below the k-th best score. What rounding may do follows the lengths of all three (SLACK), so a long pivot bounds less, and never too much.
    """
    dq = distances(q, pivots) if dq is None else dq
    dc = distances(c, pivots) if dc is None else dc
    nq, nc = lengths(q), lengths(c)
    rough, rough_p = SLACK * np.sqrt(nc), 2 * SLACK * np.sqrt(lengths(pivots))
    exact = max(nq.max(initial=0), nc.max(initial=0)) < EXACT
    out, scored = [], 0
    for i, query in enumerate(q_ids):
        least = -(2**63) if threshold is None else int(threshold[i])
        alive, low = np.flatnonzero(c_ids != query), np.zeros(len(c))
        ceiling = (nq[i] + nc) * (0.5 + SLACK_2) + 1
        for p in range(0, pivots.shape[0], CHUNK):
            gap = (np.abs(dc[alive, p : p + CHUNK] - dq[i, p : p + CHUNK]) - rough_p[p : p + CHUNK]).max(1)
            low[alive] = np.maximum(low[alive], gap - rough[alive] - SLACK * np.sqrt(nq[i]))
            left = alive[ceiling[alive] - low[alive] ** 2 / 2 >= least]
            spared, alive = len(alive) - len(left), left
            if len(alive) <= STEP or (p and spared < LEAST_SPARED * len(alive)):
                break
        bound = ceiling[alive] - low[alive] ** 2 / 2
        order = np.argsort(-bound, kind="stable")
        best: list[tuple[int, int]] = []
        for at in range(0, len(order), STEP):
            if len(best) == k and bound[order[at]] < -best[-1][0]:
                break
            take = alive[order[at : at + STEP]]
            score = scores(q[i : i + 1], c[take], exact)[0].tolist()
            scored += len(take)
            best = sorted([*best, *((-s, int(j)) for s, j in zip(score, c_ids[take].tolist(), strict=True) if s >= least)])[:k]
        out += [(int(query), j, -s) for s, j in best]
    return out, scored


def topk_inner_product(vectors: DataFrame, queries: Column, k: int = 10, scale: float = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where `queries` holds, the k other rows of highest integer inner product of floor(scale * vector).

    Rows are packed once into blocks of bounded size, each with its rows' distances to the pivots; queries get theirs, and their k-th best score in the sample
    as threshold, once. Queries go to all blocks in rounds of about QUERIES, so what is broadcast is bounded, and blocks return few rows. Vectors that
    are null, empty or hold a null or non-finite component take no part; vectors meet only those of their own length. Ties go to the
    smaller id; fewer than k candidates give fewer rows. A null id takes no part. Rows that repeat an id are candidates each, but never of
    a query with that id. Scores must fit 64 bits. No rows give no rows.
    """
    spark = vectors.sparkSession
    rows = written(whole_vectors(vectors, scale, id_col, vector_col, q=F.coalesce(queries, F.lit(False))), "topk-vectors")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("m")).first()
    blocks, rounds = 1 + total["n"] // BLOCK, 1 + total["m"] // QUERIES
    known = {dim: (s["id"].astype(np.int64), s["v"], s["v"][farthest_first(s["v"], min(PIVOTS, len(s["v"]) // 2 + 1))]) for dim, s in samples(rows).items()}

    def of(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return known.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim)), np.zeros((0, dim))))

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        data, dim = np.stack(pdf["v"].to_numpy()), int(pdf["dim"].iloc[0])
        return pdf[["dim", "block"]].head(1).assign(ids=[pdf["id"].to_numpy(np.int64).tobytes()], data=[pack(data)], far=[distances(data, of(dim)[2]).tobytes()])

    def asking(pdf: pd.DataFrame) -> pd.DataFrame:
        data, dim, ids = np.stack(pdf["v"].to_numpy()), int(pdf["dim"].iloc[0]), pdf["id"].to_numpy(np.int64)
        return packed(pdf).assign(least=[kth_best(ids, data, *of(dim)[:2], k).tobytes()])

    def blocked(df: DataFrame, n: int, name: str, f, schema: str) -> DataFrame:
        return written(df.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")).repartition(min(n, 256 + n // 16), "dim", "block").groupBy("dim", "block").applyInPandas(f, schema), name)

    schema = "dim int, block int, ids binary, data binary, far binary"
    candidates = blocked(rows, blocks, "topk-blocks", packed, schema)
    asked = blocked(rows.where("q"), rounds, "topk-queries", asking, f"{schema}, least binary")
    discard(rows)
    found = None
    for r in range(rounds):
        sent = spark.sparkContext.broadcast({q["dim"]: tuple(q) for q in asked.where(F.col("block") == r).toLocalIterator()})

        def search(parts: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            for part in parts:
                for dim, _, ids, data, far in part.itertuples(index=False):
                    if dim in sent.value:
                        _, _, q_ids, q, q_far, least = sent.value[dim]
                        (q_ids, n), (ids, m), pivots = (np.frombuffer(q_ids, np.int64), len(q_ids) // 8), (np.frombuffer(ids, np.int64), len(ids) // 8), of(dim)[2]
                        rows = search_block(q_ids, unpack(q, n, dim), ids, unpack(data, m, dim), pivots, k, np.frombuffer(least, np.int64), np.frombuffer(q_far, np.float32).reshape(n, -1), np.frombuffer(far, np.float32).reshape(m, -1))[0]
                        yield pd.DataFrame(rows, columns=["query_id", "vec_id", "score"])

        part = written(candidates.mapInPandas(search, "query_id long, vec_id long, score long"), "topk-found")
        sent.destroy()
        found = part if found is None else found.union(part)
    discard(candidates, asked)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_inner_product(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE_SQL = {
    "op7_topk_search": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 10"""
}
