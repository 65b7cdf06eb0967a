"""Substring dedup: suffix automata of reference shards, and documents streamed through them for matching statistics."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import SPACE, WORD, discard, document_key, read, unclashed, written
from ._words import grams, released, text_chunks, word_hashes

WINDOW = 35
#: Words of the grams whose minimum names the shard of a window.
GRAM = 10
#: Segments of one anchor beyond which its segments are cut into single windows, each a shard key of its own.
HOT = 500
#: Anchors up to which the hot ones are broadcast, 8 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 500_000

RUN_SCHEMA = "anchor long, k1 long, k2 long, start int, n int"


def window_minima(hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(minimum, its leftmost place) of each `width` consecutive hashes."""

    def least(low: np.ndarray, at: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
        right = low[by:] < low[:-by]
        return np.where(right, low[by:], low[:-by]), np.where(right, at[by:], at[:-by])

    low, at, have = hashes, np.arange(len(hashes), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        low, at = least(low, at, step)
        have += step
    return low, at


def anchor_runs(words: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, document, first window's start, windows) of each run of consecutive windows of a document with the same place of their smallest gram."""
    none = (np.zeros(0, np.int64),) * 4
    if len(words) < window:
        return none
    lows, places = window_minima(grams(words, gram), window - gram + 1)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(doc[: len(lows)] == doc[window - 1 : window - 1 + len(lows)])
    if not len(inside):
        return none
    place, of = places[inside], doc[inside]
    at = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (of[1:] != of[:-1])]))
    return lows[inside[at]].view(np.int64), of[at], inside[at] - first[of[at]], np.diff(np.append(at, len(inside)))


class SuffixAutomaton:
    """Of several word sequences with weights; a state's count is the weighted number of places where its strings end."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def _state(self, length: int, link: int, edges: dict[str, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.count.append(0)
        return len(self.link) - 1

    def _split(self, p: int, word: str, q: int) -> int:
        """A copy of q for the strings that reach it over p."""
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list[str], weight: int) -> None:
        last = 0
        for word in words:
            p, q = last, self.next[last].get(word)
            if q is not None:
                last = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            else:
                last = self._state(self.length[p] + 1, 0, {})
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = last
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
            self.count[last] += weight

    def close(self) -> None:
        """Passes counts on from longer to shorter strings."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[s]] += self.count[s]

    def repeats(self, words: list[str], window: int) -> list[int]:
        """Starts of the windows of `words` that occur twice or more. Keeps the longest match that ends at each word."""
        state, matched, found = 0, 0, []
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word not in self.next[state]:
                continue
            state = self.next[state][word]
            matched += 1
            while self.length[self.link[state]] >= window:
                state = self.link[state]
                matched = self.length[state]
            if matched >= window and self.count[state] >= 2:
                found.append(i - window + 1)
        return found


def _runs(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            for at, _, data, offsets in text_chunks(batch.column(2)):
                words, _, first = word_hashes(data, offsets)
                anchor, of, start, n = anchor_runs(words, first, window, gram)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(k1[at + of]), pa.array(k2[at + of]), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["anchor", "k1", "k2", "start", "n"])
        released()

    return run


SEGMENT_SCHEMA = "k1 long, k2 long, start int, anchor long, key binary, segment string, n long"


def _segments(window: int):
    """Of the candidate runs of each document: rows (k1, k2, start, key) of their places, and (anchor, key, segment, n) of the distinct segments of a stretch of documents."""
    word = re.compile(WORD)
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int32()), ("anchor", pa.int64()), ("key", pa.binary()), ("segment", pa.string()), ("n", pa.int64())])

    def rows(places: list[tuple], kinds: dict[tuple[int, bytes], list]) -> pa.RecordBatch:
        found = [*places, *((None, None, None, *k, *v) for k, v in kinds.items())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(schema)], schema=schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places: list[tuple] = []
            kinds: dict[tuple[int, bytes], list] = {}
            for at in range(batch.num_rows):
                k1, k2, text, runs = (batch.column(i)[at].as_py() for i in range(4))
                words = word.findall(text or "")
                for r in runs:
                    anchor, start, n, hot = r["anchor"], r["start"], r["n"], r["hot"]
                    for s, m in [(s, 1) for s in range(start, start + n)] if hot else [(start, n)]:
                        segment = " ".join(words[s : s + m + window - 1])
                        key = hashlib.md5(segment.encode()).digest()
                        places.append((k1, k2, s, None, key, None, None))
                        kinds.setdefault((int.from_bytes(key[:7], "little") if hot else anchor, key), [segment, 0])[1] += 1
                if len(places) > 20_000:
                    yield rows(places, kinds)
                    places, kinds = [], {}
            yield rows(places, kinds)
        released()

    return cut


def _match(window: int):
    """Of a shard: (key, hits), the repeated windows' starts in each distinct segment that has some."""

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, group in pdf.groupby("anchor"):
            segments = [(k, s.split(" "), int(n)) for k, s, n in zip(group["key"], group["segment"], group["n"], strict=True)]
            if len(segments) == 1 and (segments[0][2] > 1 or len(set(segments[0][1])) == len(segments[0][1])):
                key, words, n = segments[0]
                if n > 1:
                    out.append((key, list(range(len(words) - window + 1))))
                continue
            automaton = SuffixAutomaton()
            for _, words, n in segments:
                automaton.add(words, n)
            automaton.close()
            for key, words, n in segments:
                if hits := list(range(len(words) - window + 1)) if n > 1 else automaton.repeats(words, window):
                    out.append((key, hits))
        return pd.DataFrame(out, columns=["key", "hits"])

    return shard


def _cut(window: int):
    word = re.compile(WORD)

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for k1, k2, text, starts in part.itertuples(index=False):
                words = word.findall(text or "")
                edge = np.zeros(len(words) + 1, np.int64)
                starts = np.unique(np.concatenate(list(starts)))
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                keep = np.cumsum(edge[:-1]) == 0
                out.append((k1, k2, int((~keep).sum()), " ".join(w for w, k in zip(words, keep, strict=True) if k)))
            yield pd.DataFrame(out, columns=["k1", "k2", "n_removed", "kept_text"])

    return cut


def repeated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, n_removed, kept_text) of the documents that lose words; k1, k2 are document_key().

    1. Each window of `window` words belongs to its smallest `gram`-word hash, so all its occurrences meet under one anchor. Only anchors
       that occur twice matter. 2. Their windows are cut from the texts as segments: a shard's reference, distinct segments with their
       numbers. 3. Each shard's suffix automaton counts, on words and not on hashes, where each string ends; segments are streamed through
       it. 4. The union of repeated windows goes. An anchor with more than HOT segments is dealt out window by window.
    """
    keys = document_key(id_col, text_col)
    source = docs.select(*keys, F.col(text_col).alias("text"))
    runs = written(source.mapInArrow(_runs(window, gram), RUN_SCHEMA), "anchor-runs")
    count = written(runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "anchor-counts")
    often = count.where(F.col("c") > HOT).select("anchor")
    if often.count() <= BROADCAST_ROWS:  # so their many runs stay where they are
        often = F.broadcast(often)
    marked = runs.join(often.withColumn("hot", F.lit(True)), "anchor", "left")
    wanted = marked.where("hot").union(marked.where("hot is null").join(count.select("anchor"), "anchor").withColumn("hot", F.lit(False)))
    wanted = wanted.groupBy("k1", "k2").agg(F.collect_set(F.struct("anchor", "start", "n", "hot")).alias("runs"))
    cut = written(source.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "runs").mapInArrow(_segments(window), SEGMENT_SCHEMA), "anchor-segments")
    distinct = cut.where("segment is not null").groupBy("anchor", "key").agg(F.first("segment").alias("segment"), F.sum("n").alias("n"))
    shards = max(1, runs.count() // 50_000)
    hits = distinct.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInPandas(_match(window), "key binary, hits array<int>")
    places = cut.where("segment is null").select("k1", "k2", "start", "key")
    starts = written(places.join(hits, "key").groupBy("k1", "k2").agg(F.collect_set(F.transform("hits", lambda h: h + F.col("start"))).alias("starts")), "repeated-starts")
    discard(runs, count, cut)
    return source.join(starts, ["k1", "k2"]).select("k1", "k2", "text", "starts").mapInPandas(_cut(window), "k1 long, k2 long, n_removed long, kept_text string").dropDuplicates(["k1", "k2"])


def substring_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the words of repeated windows removed: n_words, n_removed, and kept_text (words joined by one space; null where nothing was removed).

    A window repeats if its words also start anywhere else in docs, overlapping places of the same document included. Null and empty texts
    have no words. Rows that repeat id and text count each, so both lose all their windows. No rows give no rows. Columns of docs stay as they are,
    but for those named like the three new ones, which are replaced.
    """
    k1, k2 = document_key(id_col, text_col)
    lost = repeated(docs, window, id_col=id_col, text_col=text_col).withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    n_words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("n_words")
    whole = docs.select(F.struct(*docs.columns).alias("row"), k1, k2, n_words)
    both = whole.join(lost, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    return unclashed(both, docs.columns, n_words=F.col("n_words"), n_removed=F.coalesce("n_removed", F.lit(0)).cast("long"), kept_text=F.col("kept_text"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " ")), 256).alias("whole"))
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.coalesce(F.sha2("kept_text", 256), "whole").alias("kept_sha256"))


ORACLE_SQL = {
    "op2_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w),
h AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h FROM s),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM h) WHERE c > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM r),
x AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM g GROUP BY doc_id),
u AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT u.doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM u ANTI JOIN g ON u.doc_id = g.doc_id AND u.p = g.p GROUP BY u.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN x USING (doc_id) LEFT JOIN k USING (doc_id)"""
}
