"""Toxicity: maximum-scoring segments over token log-odds with Dirichlet priors, calibrated by extreme-value statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, read, written
from ._words import owners, released, text_chunks, word_hashes

#: Labelled rows that the model is fitted on, those of the smallest id hashes. They bound the words of the lexicon, and so what is broadcast.
LABELLED = 20_000
#: Standard errors by which a word's log-odds must differ from zero; those of others are taken for zero.
LEAST_Z = 3.0
#: Strength of a word's prior as a part of its own count, and what every word's score is lowered by, so that clean text scores less than zero.
PRIOR, DRIFT = 0.5, -0.25
#: Expected number of segments as good in a clean text of the same length, below which a segment is significant.
SIGNIFICANT = 0.01
#: Bins of the calibration.
BINS = 80


@dataclass
class Model:
    """Sorted word hashes with scores, Karlin and Altschul's lambda and log K, and the logistic calibration (weight, offset)."""

    words: np.ndarray
    scores: np.ndarray
    lam: float = 1.0
    log_k: float = 0.0
    weight: float = 1.0
    offset: float = 0.0


def segments(at: list[int], score: list[float], drift: float, more: list[float] | None = None) -> list[tuple[int, int, float]]:
    """(first place, end, score) of all maximal scoring segments (Ruzzo and Tompa), where each place but those in `at` scores drift < 0, and the places
    between at[i - 1] and at[i] together more[i] <= 0 besides.

    Only segments that begin and end at a positive score can be maximal, so the scan is linear in len(at).
    """
    found: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, end
    total, last = 0.0, 0
    for place, s, besides in zip(at, score, more or [0.0] * len(at), strict=True):
        total += drift * (place - last) + besides
        low, high, first = total, total + s, place
        total, last = high, place + 1
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= low:
                j -= 1
            if j < 0 or found[j][1] >= high:
                found.append((low, high, first, place + 1))
                break
            low, first = found[j][0], found[j][2]
            del found[j:]
    return [(f, e, high - low) for low, high, f, e in found]


def spaced(of: np.ndarray, word: np.ndarray, at: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Which hits (document, word, place), in order of place, count: a document's first one of a word, and each that is apart[word] places or more
    after the last that counted. The drift has then spent that one's score, so repeating one word is no better than having it once."""
    counts = np.ones(len(at), bool)
    again = np.lexsort((at, word, of))
    same = (of[again[1:]] == of[again[:-1]]) & (word[again[1:]] == word[again[:-1]])
    if not same.any():
        return counts
    last = 0
    for i, repeated in zip(again.tolist(), [False, *same.tolist()], strict=True):
        if repeated and at[i] - last < apart[word[i]]:
            counts[i] = False
        else:
            last = at[i]
    return counts


def scan(texts: pa.Array, words: np.ndarray, scores: np.ndarray) -> Iterator[tuple[int, np.ndarray, dict[int, list[tuple[int, int, float]]]]]:
    """(first row, words of each text, segments of the texts that have some) of each chunk. Words of the lexicon count wherever they stand, but for close repeats (see spaced)."""
    for at, _, data, offsets in text_chunks(texts):
        hashes, _, first = word_hashes(data, offsets, lower=True, letters=True)
        sizes = np.diff(first)
        found: dict[int, list[tuple[int, int, float]]] = {}
        if len(words) and len(hashes):
            place = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
            known = words[place] == hashes
            clean = np.flatnonzero(known & (scores[place] < 0))
            spent = np.concatenate([[0.0], np.cumsum(scores[place[clean]] - DRIFT)])
            hit = np.flatnonzero(known & (scores[place] > 0))
            of = owners(first)[hit]
            hit = hit[spaced(of, place[hit], hit, scores / -DRIFT + 1)]
            of = owners(first)[hit]
            edges = np.flatnonzero(np.diff(of, prepend=-1, append=len(sizes)))
            local, value = hit - first[of], scores[place[hit]]
            more = np.minimum(np.diff(spent[np.searchsorted(clean, hit)], prepend=0.0), 0.0)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                found[int(of[a])] = segments(local[a:b].tolist(), value[a:b].tolist(), DRIFT, more[a:b].tolist())
        yield at, sizes, found


def statistic(n: int, found: list[tuple[int, int, float]], lam: float, log_k: float) -> float:
    """-log of the expected number of clean texts' segments that are as good: over all significant segments, else the best one. 0 where nothing is found."""
    if not found:
        return 0.0
    each = sorted((max(0.0, lam * s - log_k - math.log(max(n, 1))) for _, _, s in found), reverse=True)
    significant = [x for x in each if x >= -math.log(SIGNIFICANT)]
    return math.fsum(significant) if significant else each[0]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, toxic, clean): documents of either label that hold the word."""
    for batch in batches:
        label = batch.column(1).to_numpy().astype(bool)
        for at, end, data, offsets in text_chunks(batch.column(0)):
            hashes, _, first = word_hashes(data, offsets, lower=True, letters=True)
            pairs = np.unique(np.stack([hashes, owners(first).astype(np.uint64)], 1), axis=0)
            words, inverse = np.unique(pairs[:, 0], return_inverse=True)
            toxic = np.bincount(inverse, label[at:end][pairs[:, 1].astype(np.int64)], len(words)).astype(np.int64)
            clean = np.bincount(inverse, minlength=len(words)) - toxic
            yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(toxic), pa.array(clean)], names=["word", "toxic", "clean"])


def solve_lambda(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1 for scores of negative mean, some of them positive."""
    if not len(s) or (p * s).sum() >= 0 or s.max() <= 0:
        return 1.0
    low, high = 1e-6, 1.0
    while (p * np.exp(high * s)).sum() < 1:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(mid * s)).sum() < 1 else (low, mid)
    return (low + high) / 2


def fit_logistic(x: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> tuple[float, float]:
    """(weight, offset) of the logistic curve for binned counts, with a prior of half a document of either label at both ends."""
    x = np.concatenate([x, [x.min(), x.max()]])
    positive, negative = np.concatenate([positive, [0.5, 0.5]]), np.concatenate([negative, [0.5, 0.5]])
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], 1)
    n = positive + negative
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (positive - n * p) - 1e-3 * w
        step = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + 1e-3 * np.eye(2), gradient)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of labelled documents: labels (doc_id, toxic 0 or 1) of at most LABELLED rows, so labels are broadcast and of docs only labelled texts are shuffled, to count copies once.

    A word's score is its log-odds between toxic and clean documents, with a Dirichlet prior that deals out its count by the labels' shares, where it differs
    from zero by LEAST_Z standard errors, to either side: clean words cut segments. Other words score DRIFT. Of equal texts with several labels the
    toxic one counts. lambda comes from the words' shares in clean documents, K from clean documents' best segments by
    maximum likelihood, and a logistic curve takes the statistic to a probability.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(LABELLED)
    known = written(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.max("toxic").alias("toxic")), "toxicity-labelled")
    counted = known.mapInArrow(_counts, "word long, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    sums = counted.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    t, c = float(sums["t"] or 0), float(sums["c"] or 0)
    if not t or not c:
        discard(known)
        return Model(np.zeros(0, np.uint64), np.zeros(0), weight=0.0, offset=-10.0 if not t else 10.0)
    n = F.col("toxic") + F.col("clean")
    in_toxic, in_clean = F.col("toxic") + PRIOR * n * t / (t + c), F.col("clean") + PRIOR * n * c / (t + c)
    total_t, total_c = t * (1 + PRIOR), c * (1 + PRIOR)
    odds = F.log(in_toxic / (total_t - in_toxic)) - F.log(in_clean / (total_c - in_clean))
    z = odds / F.sqrt(1 / in_toxic + 1 / in_clean)
    top = counted.withColumns({"odds": odds, "z": z, "share": in_clean / total_c}).where(((F.col("z") >= LEAST_Z) & (F.col("toxic") > 1)) | (F.col("z") <= -LEAST_Z)).select("word", "odds", "share").toPandas()
    words = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    model = Model(words[order], top["odds"].to_numpy(float)[order])
    share = top["share"].to_numpy(float)[order]
    model.lam = solve_lambda(np.append(share, max(0.0, 1 - share.sum())), np.append(model.scores, DRIFT))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy()
            for at, sizes, found in scan(batch.column(0), model.words, model.scores):
                top_ = np.array([max((s for _, _, s in found.get(i, [])), default=0.0) for i in range(len(sizes))])
                yield pa.RecordBatch.from_arrays([pa.array(label[at : at + len(sizes)].astype(np.int32)), pa.array(sizes * np.exp(-model.lam * top_))], names=["toxic", "n"])

    clean = known.mapInArrow(best, "toxic int, n double").where("toxic = 0").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("n")).first()
    model.log_k = math.log(max(1.0, clean["docs"]) / max(1e-9, clean["n"]))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(1).to_numpy()
            for at, sizes, found in scan(batch.column(0), model.words, model.scores):
                x = [min(BINS - 1, int(2 * statistic(int(n), found.get(i, []), model.lam, model.log_k))) for i, n in enumerate(sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(label[at : at + len(sizes)].astype(np.int32)), pa.array(np.array(x, np.int32))], names=["toxic", "bin"])

    bins = known.mapInArrow(binned, "toxic int, bin int").groupBy("bin").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") == 0).alias("c")).toPandas()
    discard(known)
    model.weight, model.offset = fit_logistic(bins["bin"].to_numpy(float) / 2, bins["t"].to_numpy(float), bins["c"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted, passages), a row for each row of docs, by one pass over whole texts.

    passages are the significant segments as (first word, end word, score), words counted from 0 as runs of letters and digits. score is the
    calibrated probability, predicted 1 from 0.5 on. Null and empty texts, and texts without a word of the lexicon, have no passage and the
    lowest score. Null ids and repeated rows are scored like others. No rows give no rows. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = -math.log(SIGNIFICANT)
        for batch in batches:
            for at, sizes, found in scan(batch.column(1), model.words, model.scores):
                x = np.array([statistic(int(n), found.get(i, []), model.lam, model.log_k) for i, n in enumerate(sizes)])
                p = 1 / (1 + np.exp(-np.clip(model.weight * x + model.offset, -700, 700)))
                passages = [[{"start": f, "end": e, "score": s} for f, e, s in found.get(i, []) if model.lam * s - model.log_k - math.log(max(n, 1)) >= least] for i, n in enumerate(sizes.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sizes)), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(passages, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))], names=["doc_id", "score", "predicted", "passages"])
        released()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int, passages array<struct<start: int, end: int, score: double>>")


def filter_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text is predicted clean, all columns as they are. Null and empty texts are judged like texts without toxic words."""
    column = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for at, sizes, found in scan(batch.column(column), model.words, model.scores):
                x = np.array([statistic(int(n), found.get(i, []), model.lam, model.log_k) for i, n in enumerate(sizes)])
                keep[at : at + len(sizes)] = model.weight * x + model.offset < 0
            yield batch.filter(pa.array(keep))
        released()

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    """Whether the crc32 of the id as text is divisible by 5; such labels are never learned from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "passages")
