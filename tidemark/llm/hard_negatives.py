"""Hard negatives: vectors stored in the order of (pivot, distance) keys, and exact searches by widening key intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import discard, read, written
from ._vectors import EXACT, distances, lengths, pack, samples, scores, unpack, whole_vectors
from ._words import ragged

#: Pivots of each dimension count; vectors of a stored block, and of the blocks that are searched together; queries broadcast in one round.
PIVOTS, BLOCK, TOGETHER, QUERIES = 64, 2048, 16_384, 8192
#: The first interval reaches so far, as a share of the distance at which nothing is left to find; each following is twice as wide.
FIRST = 1 / 16

STORED = "dim int, keys binary, ids binary, labels binary, data binary"


class Space:
    """Vectors of one dimension count, with one coordinate more that gives all the same length: the nearer two such vectors, the higher their score.

    top: the largest squared length. Keys are pivot * span + distance to the nearest pivot; slack is what rounding may do to a distance.
    """

    def __init__(self, sample: np.ndarray, top: float, pivots: int):
        self.top, self.exact = top, top < EXACT
        self.span = 4 * np.sqrt(top) + 1
        self.slack = np.sqrt(top) * (1e-10 if self.exact else 1e-5)
        points = self.lifted(sample)
        centres = points[: min(pivots, len(points))]
        for _ in range(5):  # means of the sample's cells
            cell = distances(points, centres).argmin(1)
            n = np.bincount(cell, minlength=len(centres))
            sums = np.zeros_like(centres)
            np.add.at(sums, cell, points)
            centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        self.pivots = centres

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.top - lengths(x), 0))])

    def keys(self, x: np.ndarray) -> np.ndarray:
        d = distances(self.lifted(x), self.pivots)
        near = d.argmin(1)
        return near * self.span + d[np.arange(len(x)), near]

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        """Distances of queries, whose extra coordinate is 0, to the pivots."""
        return distances(np.column_stack([q, np.zeros(len(q))]), self.pivots)

    def reach(self, squared: float, score: float) -> float:
        """The distance from a query (squared: its squared length) beyond which scores are below `score`."""
        return float(np.sqrt(max(squared + self.top - 2 * score, 0) * (1 + 1e-9))) + 2 * self.slack

    def best(self, squared: float, radius: float) -> float:
        """No vector farther than radius from the query has a higher score."""
        near = max(radius - 2 * self.slack, 0)
        return (squared + self.top - near**2) / 2 + 1 + 1e-12 * (squared + self.top)


class Wanted:
    """The k best of the scored vectors whose score lies between low and high; ties to the smaller id."""

    def __init__(self, k: int, low: int, high: int):
        self.k, self.low, self.high = k, low, high
        self.ids = self.scores = np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, found: np.ndarray) -> None:
        fine = (found >= self.low) & (found <= self.high)
        ids, found = np.concatenate([self.ids, ids[fine]]), np.concatenate([self.scores, found[fine]])
        first = np.lexsort((ids, -found))[: self.k]
        self.ids, self.scores = ids[first], found[first]

    def least(self) -> int:
        """What a further vector must reach."""
        return int(self.scores[-1]) if len(self.scores) == self.k else self.low


def search(space: Space | None, q: np.ndarray, dq: np.ndarray, keys: np.ndarray, ids: np.ndarray, rows: np.ndarray, take: np.ndarray, wanted: list[Wanted]) -> int:
    """Fills each of `wanted` with what it wants of the rows (sorted by key) that `take` allows, and returns how many rows were scored.

    |d(q, p) - d(c, p)| bounds the distance of q and c from below, so a radius is an interval of keys at each pivot, and no row closer than the highest
    wanted score allows is of use: an annulus. It is widened until no row outside can be wanted. Without a space (a rare dimension count) all rows are scored.
    """
    if space is None:
        for w in wanted:
            w.add(ids[take], scores(q[None], rows[take], False)[0])
        return int(take.sum())
    squared = float((q**2).sum())
    least = min(w.least() for w in wanted)
    furthest = space.reach(squared, least)
    high = max(w.high for w in wanted)
    inner = 0.0 if high >= 2**62 else max(float(np.sqrt(max(squared + space.top - 2 * float(high), 0))) * (1 - 1e-9) - 2 * space.slack, 0.0)
    base = np.arange(len(dq)) * space.span
    begin = np.searchsorted(keys, base)
    end = np.append(begin[1:], len(keys))
    full = end > begin
    base, dq, begin, end = base[full], dq[full], begin[full], end[full]
    least_d, most_d = keys[begin] - base, keys[end - 1] - base
    near = float(np.maximum(np.maximum(dq - most_d, least_d - dq), 0).min(initial=np.inf))
    done_low = done_high = None
    scored, width = 0, furthest * FIRST
    radius = max(near, inner) + width
    while len(base):
        low = np.maximum(np.searchsorted(keys, base + np.maximum(np.maximum(dq - radius, inner - dq), 0) - space.slack, "left"), begin)
        high_at = np.minimum(np.searchsorted(keys, base + dq + radius + space.slack, "right"), end)
        high_at = np.maximum(high_at, low)
        if done_low is None:
            parts = [(low, high_at - low)]
        else:
            parts = [(low, np.maximum(done_low - low, 0)), (done_high, np.maximum(high_at - done_high, 0))]
        at = np.concatenate([ragged(s, n) for s, n in parts])
        at = at[take[at]]
        if len(at):
            found = scores(q[None], rows[at], space.exact)[0]
            for w in wanted:
                w.add(ids[at], found)
            scored += len(at)
        done_low, done_high = low, high_at
        if radius >= furthest or space.best(squared, radius) < min(w.least() for w in wanted):
            break
        width *= 2
        radius = min(radius + width, furthest)
    return scored


def spaces(rows: DataFrame, pivots: int) -> tuple[dict[int, Space], dict[int, dict[str, np.ndarray]]]:
    known = samples(rows, "label")
    tops = {r["dim"]: r["top"] for r in rows.where(F.col("dim").isin(list(known))).groupBy("dim").agg(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("top")).collect()}
    return {d: Space(s["v"], tops[d], pivots) for d, s in known.items()}, known


def stored(rows: DataFrame, space: dict[int, Space], name: str) -> DataFrame:
    """Blocks (dim, keys, ids, labels, data) of rows (id, dim, v, label) in the order of dimension count and key; a key's rows may fill many blocks."""

    def keyed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for dim, group in part.groupby("dim"):
                data = np.stack(group["v"].to_numpy())
                yield pd.DataFrame({"dim": dim, "key": space[dim].keys(data) if dim in space else 0.0, "id": group["id"], "label": group["label"], "data": [pack(x) for x in data]})

    def blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for (dim, _), group in part.groupby(["dim", part.groupby("dim").cumcount() // BLOCK]):
                data = np.concatenate([unpack(x, 1, dim) for x in group["data"]])
                yield pd.DataFrame({"dim": [dim], "keys": [group["key"].to_numpy(float).tobytes()], "ids": [group["id"].to_numpy(np.int64).tobytes()], "labels": [group["label"].to_numpy(np.int64).tobytes()], "data": [pack(data)]})

    keys = written(rows.select("id", "dim", "v", "label").mapInPandas(keyed, "dim int, key double, id long, label long, data binary"), f"{name}-keys")
    order = ["dim", "key", "id"]
    out = written(keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(blocks, STORED), f"{name}-blocks")
    discard(keys)
    return out


def searched(blocks: DataFrame, queries: DataFrame, space: dict[int, Space], known: dict[int, dict[str, np.ndarray]], k: int, same_label: bool) -> DataFrame:
    """(query, goal, id, score): of each block stretch, what each of `queries` (query, id, label, dim, v, goals) may want: for every goal (low, high) the k best
    scores in between, of rows of the query's label or of other ones. Queries are broadcast in rounds of about QUERIES, with their distances to the
    pivots and, for every goal, what the k-th best of the sample reaches; both are computed once.
    """
    spark = blocks.sparkSession
    rounds = 1 + queries.count() // QUERIES

    def prepared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for query, own, label, dim, v, goals in batch.itertuples(index=False):
                wanted = [Wanted(k, g["low"], g["high"]) for g in goals]
                if dim in space:  # what the sample gives, all further vectors must reach
                    s = known[dim]
                    mine = (s["id"] != own) & ((s["label"] == label) == same_label)
                    given = scores(v[None], s["v"][mine], space[dim].exact)[0]
                    for w in wanted:
                        w.add(s["id"][mine], given)
                dq = space[dim].of_queries(v[None])[0].tobytes() if dim in space else b""
                out.append((query, own, label, dim, v.tobytes(), dq, [w.least() for w in wanted], [w.high for w in wanted]))
            yield pd.DataFrame(out, columns=["query", "id", "label", "dim", "v", "dq", "low", "high"])

    asked = queries.select("query", "id", "label", "dim", "v", "goals").mapInPandas(prepared, "query long, id long, label long, dim int, v binary, dq binary, low array<long>, high array<long>")
    asked = written(asked.withColumn("round", F.pmod(F.xxhash64("query"), F.lit(rounds)).cast("int")), "negative-queries")
    found = None
    for r in range(rounds):
        of_round = [(q["query"], q["id"], q["label"], q["dim"], np.frombuffer(q["v"]), np.frombuffer(q["dq"]), list(zip(q["low"], q["high"], strict=True))) for q in asked.where(F.col("round") == r).toLocalIterator()]
        sent = spark.sparkContext.broadcast(of_round)

        def stretch(dim: int, rows: pd.DataFrame, sent=sent) -> pd.DataFrame:
            keys, ids, labels = (np.concatenate([np.frombuffer(x, t) for x in rows[c]]) for c, t in (("keys", float), ("ids", np.int64), ("labels", np.int64)))
            data = np.concatenate([unpack(d, len(i) // 8, dim) for d, i in zip(rows["data"], rows["ids"], strict=True)])
            out = []
            for query, own, label, of, v, dq, goals in sent.value:
                if of == dim:
                    wanted = [Wanted(k, low, high) for low, high in goals]
                    search(space.get(dim), v, dq, keys, ids, data, ((labels == label) == same_label) & (ids != own), wanted)
                    out += [(query, g, i, s) for g, w in enumerate(wanted) for i, s in zip(w.ids.tolist(), w.scores.tolist(), strict=True)]
            return pd.DataFrame(out, columns=["query", "goal", "id", "score"])

        def run(batches: Iterator[pd.DataFrame], stretch=stretch) -> Iterator[pd.DataFrame]:
            for batch in batches:
                n = batch["ids"].map(len) // 8
                for (dim, _), rows in batch.groupby(["dim", n.groupby(batch["dim"]).cumsum() // TOGETHER]):
                    yield stretch(dim, rows)

        part = written(blocks.mapInPandas(run, "query long, goal int, id long, score long"), "negative-found")
        sent.destroy()
        found = part if found is None else found.union(part)
    best = Window.partitionBy("query", "goal").orderBy(F.desc("score"), "id")
    return written(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k), "negative-best")


def hard_negatives(vectors: DataFrame, anchors: Column, label: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each row where `anchors` holds, its `positives` best other rows of its label by
    integer inner product of floor(scale * vector), and for each of them the `negatives` best rows of other labels whose score lies between low and high per cent of the positive's.

    Ties go to the smaller id; fewer candidates give fewer rows. Vectors that are null, empty or hold a null or non-finite component, null labels and null ids take no part;
    vectors meet only those of their own length. Rows that repeat an id are candidates each, but never of an anchor with that id; anchors that agree in id, label and vector
    are one. Scores must fit 64 bits. No rows give no rows. Negative positive scores leave no room for negatives.
    """
    rows = whole_vectors(vectors, scale, id_col, vector_col, label=label.cast("long"), q=F.coalesce(anchors, F.lit(False))).where("label IS NOT NULL")
    rows = written(rows, "negative-vectors")
    space, known = spaces(rows, PIVOTS)
    blocks = stored(rows, space, "negative")
    whole = F.array(F.struct(F.lit(-(2**63)).alias("low"), F.lit(2**63 - 1).alias("high")))
    queries = rows.where("q").select(F.xxhash64("id", "label", "v").alias("query"), "id", "label", "dim", "v").dropDuplicates(["query"])
    near = searched(blocks, queries.withColumn("goals", whole), space, known, positives, True).select("query", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    s = F.col("positive_score").cast("decimal(38,0)")
    bounds = F.struct(F.ceil(s * low / 100).cast("long").alias("low"), F.floor(s * high / 100).cast("long").alias("high"), F.col("positive_score").alias("of"))
    goals = written(near.where("positive_score >= 0").groupBy("query").agg(F.array_sort(F.collect_set(bounds)).alias("goals")), "negative-goals")
    far = searched(blocks, queries.join(goals, "query"), space, known, negatives, False)
    of = goals.select("query", F.posexplode("goals").alias("goal", "g")).select("query", "goal", F.col("g.of").alias("positive_score"))
    both = near.join(of, ["query", "positive_score"]).join(far.select("query", "goal", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["query", "goal"])
    out = both.join(queries.select("query", F.col("id").alias("anchor_id")), "query")
    discard(blocks)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


ORACLE_SQL = {
    "op13_hard_negatives": r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
}
