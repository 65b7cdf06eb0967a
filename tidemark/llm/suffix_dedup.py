"""Suffix-array dedup: suffix arrays of shards by linear grouping find every repeated string of bytes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import CROWDED_ROWS, discard, document_key, joined, read, unclashed, written
from ._suffixes import repeats
from ._words import byte_grams, released, text_chunks
from .substring_dedup import window_minima

WINDOW = 400
#: Bytes of the grams whose minimum names the shard of a window.
GRAM = 64
#: Bytes of one anchor's different segments beyond which they are cut into single windows, which are counted by their hashes.
CROWDED = 24_000
#: Windows of a segment; longer stretches of one anchor are cut.
LONGEST = 4096
#: Bytes whose suffix arrays are made at once.
BATCH = 3_000_000

RUN_SCHEMA = "anchor long, k1 long, k2 long, start int, n int, places int"
CUT_SCHEMA = "k1 long, k2 long, start int, key binary, anchor long, segment binary, n long"
HITS = "key binary, hits array<struct<at:int,n:int>>"
_CUT = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("start", pa.int32()), ("key", pa.binary()), ("anchor", pa.int64()), ("segment", pa.binary()), ("n", pa.int64())])


def anchor_runs(data: np.ndarray, offsets: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, document, first window's start, windows, places of the anchor) of each run of consecutive windows of a document with the same smallest gram."""
    none = (np.zeros(0, np.int64),) * 5
    if len(data) < window:
        return none
    lows, places = window_minima(byte_grams(data, gram), window - gram + 1)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = np.flatnonzero(doc[: len(lows)] == doc[window - 1 : window - 1 + len(lows)])
    if not len(inside):
        return none
    low, place, of = lows[inside], places[inside], doc[inside]
    change = (low[1:] != low[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(np.concatenate([[True], change]))
    seen = np.add.reduceat(np.concatenate([[True], change | (place[1:] != place[:-1])]).astype(np.int64), at)
    return low[at].view(np.int64), of[at], inside[at] - offsets[of[at]], np.diff(np.append(at, len(inside))), seen


def _runs(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(i).to_numpy() for i in (0, 1))
            for at, _, data, offsets in text_chunks(batch.column(2)):
                anchor, of, start, n, places = anchor_runs(data, offsets, window, gram)
                small = [pa.array(x.astype(np.int32)) for x in (start, n, places)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(k1[at + of]), pa.array(k2[at + of]), *small], names=["anchor", "k1", "k2", "start", "n", "places"])
        released()

    return run


def _segments(window: int):
    """Of the runs wanted of each document: rows (k1, k2, start, key) of their places, and (key, anchor, segment, n) of the different segments of a stretch of documents."""

    def rows(places: list[tuple], kinds: dict[tuple[int, bytes], list]) -> pa.RecordBatch:
        found = [*((*p, None, None, None) for p in places), *((None, None, None, key, anchor, *v) for (anchor, key), v in kinds.items())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], f.type) for i, f in enumerate(_CUT)], schema=_CUT)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places: list[tuple] = []
            kinds: dict[tuple[int, bytes], list] = {}
            for at in range(batch.num_rows):
                k1, k2, text, runs = (batch.column(i)[at].as_py() for i in range(4))
                data = (text or "").encode()
                for r in runs:
                    for start in range(r["start"], r["start"] + r["n"], LONGEST):
                        segment = data[start : min(start + LONGEST, r["start"] + r["n"]) + window - 1]
                        key = hashlib.md5(segment).digest()
                        places.append((k1, k2, start, key))
                        kinds.setdefault((r["anchor"], key), [segment, 0])[1] += 1
                if len(places) > 10_000:
                    yield rows(places, kinds)
                    places, kinds = [], {}
            yield rows(places, kinds)
        released()

    return cut


def _windows(window: int):
    """Of segments: (two hashes of the window, key, place in the segment, n) of every window."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, segment, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = np.frombuffer(segment, np.uint8)
                first, second = (pa.array(byte_grams(data, window, x).view(np.int64)) for x in (False, True))
                many = len(first)
                yield pa.RecordBatch.from_arrays([first, second, pa.array([key] * many, pa.binary()), pa.array(np.arange(many, dtype=np.int32)), pa.array(np.full(many, n, np.int64))], names=["h1", "h2", "key", "at", "n"])
        released()

    return each


def stretches(starts: np.ndarray) -> list[dict[str, int]]:
    """Ascending starts as stretches (at, n) of consecutive ones."""
    at = np.flatnonzero(np.concatenate([[True], starts[1:] != starts[:-1] + 1]))
    return [{"at": a, "n": n} for a, n in zip(starts[at].tolist(), np.diff(np.append(at, len(starts))).tolist(), strict=True)]


def _match(window: int):
    """Of a shard: (key, hits): the stretches of repeated windows of each segment that has some, by the suffix arrays of all segments of each anchor.
    Where every segment of an anchor occurs twice or more, all their windows do, and nothing is left to find out."""

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        size = pdf["segment"].map(len)
        total = size.groupby(pdf["anchor"]).transform("sum")
        whole = (pdf["n"].groupby(pdf["anchor"]).transform("min") > 1).to_numpy()
        found = [(k, [{"at": 0, "n": n}]) for k, n in zip(pdf["key"][whole], (size[whole] - window + 1).tolist(), strict=True)]
        order = np.lexsort((pdf["anchor"], total))  # texts of like size, as they are worked on side by side
        order = order[~whole[order]]
        if not len(order):
            return pd.DataFrame(found, columns=["key", "hits"])
        keys, strings, weights, anchors = (pdf[c].to_numpy()[order] for c in ("key", "segment", "n", "anchor"))
        first = np.flatnonzero(np.concatenate([[True], anchors[1:] != anchors[:-1]]))
        ends = np.append(first[1:], len(anchors))
        batch = np.cumsum(size.to_numpy()[order])[ends - 1] // BATCH
        for b in np.unique(batch):
            some = np.flatnonzero(batch == b)
            part = slice(first[some[0]], ends[some[-1]])
            hits = repeats(strings[part].tolist(), weights[part].astype(np.int64), ends[some] - first[some], window)
            found += [(k, stretches(h)) for k, h in zip(keys[part], hits, strict=True) if len(h)]
        released()
        return pd.DataFrame(found, columns=["key", "hits"])

    return shard


def _gathered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        yield pd.DataFrame({"key": part["key"], "hits": [stretches(np.asarray(x)) for x in part["at"]]})


def _kept(window: int):
    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for k1, k2, text, spans in part.itertuples(index=False):
                data = (text or "").encode()
                edge = np.zeros(len(data) + 1, np.int64)
                at, n = np.array([(s["at"], s["n"]) for s in spans], np.int64).T
                np.add.at(edge, at, 1)
                np.add.at(edge, at + n + window - 1, -1)
                gone = np.cumsum(edge[:-1]) > 0
                n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((k1, k2, int(gone.sum()), n_spans, np.frombuffer(data, np.uint8)[~gone].tobytes()))
            yield pd.DataFrame(out, columns=["k1", "k2", "n_removed", "n_spans", "kept"])

    return cut


def repeated_bytes(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k1, k2, n_removed, n_spans, kept) of the documents that lose bytes; k1, k2 are document_key().

    1. Each window of `window` bytes belongs to its smallest `gram`-byte hash, its anchor, so all its occurrences meet under one. Only anchors with
    several places matter. 2. Their windows are cut from the texts as segments, and equal segments of an anchor become one with a number. 3. A shard
    makes the suffix array of all segments of each of its anchors; equal windows are neighbours there. An anchor whose segments exceed CROWDED
    bytes is dealt out window by window instead, and those whose two hashes occur twice are repeated. 4. The union of repeated windows goes.
    """
    gram = min(gram, max(1, window // 6))
    source = docs.select(*document_key(id_col, text_col), F.col(text_col).alias("text"))
    runs = written(source.mapInArrow(_runs(window, gram), RUN_SCHEMA), "byte-runs")
    several = written(runs.groupBy("anchor").agg(F.sum("places").alias("c")).where("c > 1").select("anchor"), "byte-anchors")
    wanted = runs.join(several, "anchor").groupBy("k1", "k2").agg(F.collect_set(F.struct("anchor", "start", "n")).alias("runs"))
    cut = written(source.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "runs").mapInArrow(_segments(window), CUT_SCHEMA), "byte-segments")
    distinct = written(cut.where("segment is not null").groupBy("anchor", "key").agg(F.first("segment").alias("segment"), F.sum("n").alias("n")), "byte-kinds")
    crowded = written(distinct.groupBy("anchor").agg(F.sum(F.length("segment")).alias("size")).where(F.col("size") > CROWDED).select("anchor"), "byte-crowded")
    many = distinct.join(crowded, "anchor")
    windows = written(many.select("key", "segment", "n").mapInArrow(_windows(window), "h1 long, h2 long, key binary, at int, n long"), "byte-windows")
    twice = written(windows.groupBy("h1", "h2").agg(F.sum("n").alias("n")).where("n > 1").select("h1", "h2"), "byte-twice")
    of_windows = windows.select("h1", "h2", "key", "at").join(twice, ["h1", "h2"], "left_semi").groupBy("key").agg(F.array_sort(F.collect_set("at")).alias("at")).mapInPandas(_gathered, HITS)
    few = distinct.join(crowded, "anchor", "left_anti").select("anchor", "key", "segment", "n")
    shards = 1 + runs.count() // 100_000
    found = written(few.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards))).groupBy("shard").applyInPandas(_match(window), HITS), "byte-hits")
    hits = written(found.union(of_windows), "byte-hits")
    places = cut.where("segment is null").select("k1", "k2", "start", "key")
    moved = F.transform("hits", lambda h: F.struct((h["at"] + F.col("start")).alias("at"), h["n"].alias("n")))
    spans = written(joined(places, hits, ["key"], distinct.where(F.col("n") >= CROWDED_ROWS)).groupBy("k1", "k2").agg(F.flatten(F.collect_list(moved)).alias("spans")), "byte-spans")
    discard(runs, several, cut, distinct, crowded, windows, twice, found, hits)
    return source.join(spans, ["k1", "k2"]).select("k1", "k2", "text", "spans").mapInPandas(_kept(window), "k1 long, k2 long, n_removed long, n_spans long, kept binary").dropDuplicates(["k1", "k2"])


def suffix_dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the bytes of repeated strings of `window` bytes (UTF-8): n_bytes, n_removed, n_spans (runs of removed bytes), and kept (the other bytes; null where nothing was removed).

    A string repeats if it also starts anywhere else in docs, overlapping places of the same document included; no match crosses documents. A cut may part a
    letter of several bytes, so kept is binary. Null and empty texts have no bytes. Rows that repeat id and text count each, so both lose all their
    strings. No rows give no rows. Columns of docs stay as they are, but for those named like the four new ones, which are replaced.
    """
    k1, k2 = document_key(id_col, text_col)
    lost = repeated_bytes(docs, window, id_col=id_col, text_col=text_col).withColumnsRenamed({"k1": "_k1", "k2": "_k2"})
    n_bytes = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("n_bytes")
    whole = docs.select(F.struct(*docs.columns).alias("row"), k1, k2, n_bytes)
    both = whole.join(lost, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")), "left")
    none = F.lit(0).cast("long")
    return unclashed(both, docs.columns, n_bytes=F.col("n_bytes"), n_removed=F.coalesce("n_removed", none), n_spans=F.coalesce("n_spans", none), kept=F.col("kept"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("whole"))
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.coalesce(F.sha2("kept", 256), "whole").alias("kept_sha256"))
