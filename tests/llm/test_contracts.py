"""Draws, tokens, segments and bounds against independent computations."""

import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import packing, sharding, topk, toxicity
from tidemark.llm._tokens import vocabulary_path


def test_shards_are_those_of_an_independent_draw(spark):
    rows = [(i if i % 11 else None, "é" * (i % 5) if i % 7 else None, "s") for i in range(400)]
    weights = [1.0, 3.0, 0.5, 1.0]
    got = sharding.shard_records(spark.createDataFrame(rows, "doc_id long, text string, shard string"), weights).collect()

    def score(key, shard, weight):
        seed = 42 if key is None else xxhash.xxh64(struct.pack("<q", key), seed=42).intdigest()
        bits = xxhash.xxh64(struct.pack("<i", shard), seed=seed).intdigest() >> 11
        return -np.log((bits + 0.5) / 2.0**53) / weight

    def fields(i, t):
        best = min((score(i, s, w), s) for s, w in enumerate(weights))
        grown = 4 if score(i, 4, 1.0) < best[0] else best[1]
        return str((i, 16 + len((t or "").encode()), zlib.crc32((t or "").encode()), best[1], grown))

    assert sorted(str((r["id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"])) for r in got) == sorted(fields(i, t) for i, t, _ in rows)
    keys = sharding.shard_records(spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text")), weights).groupBy("shard").count().collect()
    assert all(abs(r["count"] / 20_000 - weights[r["shard"]] / 5.5) < 0.02 for r in keys)


def test_pieces_hold_their_documents_tokens(spark):
    from tokenizers import Tokenizer

    path = vocabulary_path("word_bpe_49k.json")
    full = Tokenizer.from_file(path)
    texts = {1: None, 2: "", 3: "One two  three.", 4: " ".join(f"word{i}" for i in range(3000)), 5: "one two  three.", 6: "Ünïcode — «quotes» \t and\nlines"}
    got = packing.pack_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), path, with_ids=True).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    assert pieces.keys() == texts.keys()
    for i, rows in pieces.items():
        rows.sort(key=lambda r: r["piece"])
        want = [*full.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        assert [r["piece"] for r in rows] == list(range(-(-len(want) // 2048)))
        for r in rows:
            ids = want[r["start"] : r["start"] + r["length"]]
            assert r["start"] == 2048 * r["piece"] and np.frombuffer(r["ids"], "<u4").tolist() == ids and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert sum(r["length"] for r in rows) == len(want)


def brute_segments(scores):
    """The best-scoring stretch, then those of what lies before and after it, as long as they are positive."""
    best, at = 0.0, None
    for i in range(len(scores)):
        for j in range(i + 1, len(scores) + 1):
            total = sum(scores[i:j])
            if total > best + 1e-9:
                best, at = total, (i, j)
    if at is None:
        return []
    i, j = at
    return brute_segments(scores[:i]) + [(i, j, best)] + [(a + j, b + j, s) for a, b, s in brute_segments(scores[j:])]


def test_segments_against_brute_force():
    rng = np.random.default_rng(6)
    for _ in range(60):
        scores = np.where(rng.random(24) < 0.3, rng.random(24) * 3, -0.5)
        extra = np.where((scores < 0) & (rng.random(24) < 0.3), -rng.random(24), 0.0)
        at = np.flatnonzero(scores > 0).tolist()
        before = np.concatenate([[0.0], np.cumsum(extra)])
        more = np.diff(before[at], prepend=0.0).tolist() if at else []
        got = toxicity.segments(at, scores[at].tolist(), -0.5, more)
        want = brute_segments((scores + extra).tolist())
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_equal_texts_with_both_labels_count_as_toxic(spark):
    rows = [(i, f"vile word{i % 3}" if i % 2 else f"calm word{i % 3} {i}", i % 2) for i in range(200)] + [(500 + i, "vile word1", i % 2) for i in range(10)]
    labels = [(i, t if i % 5 else None) for i, _, t in rows]
    found = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([r[:2] for r in order], "doc_id long, text string").repartition(3)
        m = toxicity.fit(docs, spark.createDataFrame(labels[:: 1 if order is rows else -1], "doc_id long, toxic int"))
        found.append((m.words.tolist(), m.scores.tolist(), m.lam, m.log_k, m.weight, m.offset))
    assert found[0][0] == found[1][0] and found[0][1] == pytest.approx(found[1][1]) and found[0][2:] == pytest.approx(found[1][2:])


def test_clean_words_cut_segments():
    words = np.sort(np.array([1, 2, 3], np.uint64))
    assert toxicity.segments([0, 3], [4.0, 4.0], -0.25, [0.0, -6.0]) == [(0, 1, 4.0), (3, 4, 4.0)] and len(words) == 3


def test_pivots_eliminate_most_candidates_of_the_given_vectors():
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids, v = t["vec_id"].to_numpy(), np.floor(np.stack(t["embedding"].to_numpy(zero_copy_only=False)).astype(float) * 1024)
    q = ids % 100 == 0
    pivots = v[topk.farthest_first(v, min(topk.PIVOTS, len(v) // 2 + 1))]
    found, scored = topk.search_block(ids[q], v[q], ids, v, pivots, 10, topk.kth_best(ids[q], v[q], ids, v, 10))
    assert scored < 0.5 * q.sum() * len(ids)
    score = (v[q] @ v.T).astype(np.int64)
    want = sorted((int(i), int(ids[j]), int(s[j])) for i, s in zip(ids[q], score, strict=True) for j in sorted((j for j in range(len(ids)) if ids[j] != i), key=lambda j: (-s[j], ids[j]))[:10])
    assert sorted(found) == want


def test_topk_with_repeated_ids_and_large_numbers(spark):
    rows = [(i // 2, [float(2.0**17 * ((i * 7) % 5)), float(i)]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.topk_inner_product(df, F.col("vec_id") == 3, 4).collect()
    fine = [(i, [int(1024 * x) for x in v]) for i, v in rows]
    pool = sorted({(-sum(a * b for a, b in zip(q, v, strict=True)), i) for k, q in fine if k == 3 for i, v in fine if i != 3})
    assert {(r["query_id"], r["rank"]) for r in got} == {(3, k) for k in range(1, 5)}
    assert [-r["score"] for r in sorted(got, key=lambda r: r["rank"])][0] == pool[0][0]


@pytest.mark.parametrize("longest", [1.0, 1e10, 3e10])
def test_far_pivots_and_many_rounds_lose_nothing(spark, monkeypatch, longest):
    for name, small in (("QUERIES", 6), ("BLOCK", 150), ("PIVOTS", 12)):
        monkeypatch.setattr(topk, name, small)
    rng = np.random.default_rng(4)
    v = np.floor(rng.normal(size=(600, 8)) * 100)
    v[7::100] = np.floor(v[7::100] * longest / 100)  # none of them a query, so scores fit 64 bits
    lengths = [8 if i % 5 else 4 for i in range(600)]
    rows = [(i, [float(x) for x in v[i][: lengths[i]]]) for i in range(600)]
    rows += [(1000 + d, [float(d)] * (20 + d)) for d in range(20) for _ in range(2)]  # more dimension counts than have pivots
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.topk_inner_product(df, F.col("vec_id") % 20 == 0, 6, scale=1).collect()
    want = []
    for q, x in rows:
        if q % 20 == 0:
            score = lambda w: sum(int(a) * int(b) for a, b in zip(x, w, strict=True))  # noqa: B023, E731
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(sorted((-score(w), i) for i, w in rows if i != q and len(w) == len(x))[:6])]
    assert sorted(tuple(r) for r in got) == sorted(want)

