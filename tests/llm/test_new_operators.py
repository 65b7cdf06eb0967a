"""Suffix-array dedup, conversation trie and hard negatives against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import _suffixes, conversation_trie, hard_negatives, suffix_dedup


def test_suffix_arrays_of_many_texts_at_once():
    rng = random.Random(3)
    for _ in range(200):
        texts = []
        for _ in range(rng.randint(1, 6)):
            t = bytes(rng.choice(b"abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(0, 30))) * rng.randint(1, 3)
            texts.append(b"\0".join([t, t[2:], t][: rng.randint(1, 3)]) + b"\0")
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        order = _suffixes.suffix_arrays(np.frombuffer(b"".join(texts), np.uint8).astype(np.int16), first)
        for t, at, end in zip(texts, first, first[1:], strict=False):
            assert (order[at:end] - at).tolist() == sorted(range(len(t)), key=lambda i: t[i:])
    assert len(_suffixes.suffix_arrays(np.zeros(0, np.int16), np.zeros(1, np.int64))) == 0


def brute_bytes(texts, window):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + window] for d in data for i in range(len(d) - window + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - window + 1):
            if count[d[i : i + window]] > 1:
                gone[i : i + window] = True
        spans = int((gone[1:] & ~gone[:-1]).sum()) + int(gone[:1].sum())
        out.append((len(d), int(gone.sum()), spans, np.frombuffer(d, np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("crowded", [24_000, 300])
def test_suffix_dedup(spark, monkeypatch, crowded):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared, other = text(90), text(60)
    rows = [(i, text(rng.randint(0, 120)) + (shared if i % 3 == 0 else other[: rng.randint(20, 60)]) + text(rng.randint(0, 60))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "x" * 700), (103, "xy" * 200), (104, rows[0][1]), (104, rows[0][1]), (None, text(200)), (105, "é" * 39), (106, shared[:39]), (107, "ab" * 9)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_spans int")
    got = suffix_dedup.suffix_dedup(docs, window=40).collect()
    want = brute_bytes([t for _, t in rows], 40)
    key = lambda i, t, rest: (str(i), t or "", *rest)
    whole = lambda r: r["kept"] if r["kept"] is not None else (r["text"] or "").encode()
    assert sorted(key(r["doc_id"], r["text"], (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(whole(r)))) for r in got) == sorted(key(i, t, w) for (i, t), w in zip(rows, want, strict=True))
    assert suffix_dedup.suffix_dedup(docs.limit(0), window=40).count() == 0


def brute_trie(rows, every, heads):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((turn is not None, turn or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    rebuilt = {c: own.get(c - c % every, [])[: heads(c)] + x[heads(c) :] for c, x in own.items()}
    members = defaultdict(list)
    for c, x in rebuilt.items():
        for d in range(len(x) + 1):
            members[tuple(x[:d])].append(c)
    out = []
    for node, ids in members.items():
        below = [n for n in members if n[: len(node)] == node]
        leaves = sum(not any(len(m) == len(n) + 1 and m[:-1] == n for m in members) for n in below)
        saved = sum((len(members[n]) - 1) * len(n[-1][1].split()) for n in below if n)
        ends = ",".join(str(c) for c in sorted(ids) if len(rebuilt[c]) == len(node))
        children = sum(len(m) == len(node) + 1 and m[:-1] == node for m in members)
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def test_conversation_trie(spark, monkeypatch):
    for name, small in (("TURNS", 3), ("BLOCK", 4), ("IDS", 5), ("FAN_IN", 2)):
        monkeypatch.setattr(conversation_trie, name, small)
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a b", "c", "", None, "d  e\nf"])) for c in range(1, 90) if c % 13 for t in range(rng.randint(1, 9))]
    rows += [(40, None, "user", "z"), (40, None, None, None), (41, 2, "user", "y"), (41, 2, "user", "y"), (None, 1, "user", "x"), (200, 0, "user", None), (205, 0, "user", "a b")]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, depth int").repartition(5)
    heads = F.crc32(F.col("conv_id").cast("string")) % 4
    trie = lambda df: conversation_trie.prefix_trie(*conversation_trie.with_borrowed_heads(conversation_trie.numbered_turns(df), 20, heads))
    got = trie(table).collect()
    want = brute_trie(rows, 20, lambda c: zlib.crc32(str(c).encode()) % 4)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert trie(table.limit(0)).count() == 0
    alone = conversation_trie.prefix_trie(conversation_trie.numbered_turns(table)).where("depth = 0").first()
    assert alone["n_convs"] == len({r[0] for r in rows if r[0] is not None})


def brute_negatives(rows, scale=256):
    fine = [(i, lab, [int(np.floor(scale * x)) for x in v]) for i, v, lab in rows if i is not None and lab is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, lab, v in fine:
        if i % 5:
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w, strict=True))  # noqa: B023, E731
        other = [(-score(w), j, m) for j, m, w in fine if j != i and len(w) == len(v)]
        for s, p in sorted((s, j) for s, j, m in other if m == lab)[:5]:
            far = sorted((t, j) for t, j, m in other if m != lab and 50 * -s <= 100 * -t <= 95 * -s)[:3]
            out |= {(i, p, r + 1, j, -s, -t) for r, (t, j) in enumerate(far)}
    return out


@pytest.mark.parametrize("lengths", [(1,), (1, 1e3, 1e6)])
def test_hard_negatives(spark, monkeypatch, lengths):
    for name, small in (("PIVOTS", 5), ("BLOCK", 7), ("TOGETHER", 20), ("QUERIES", 8)):
        monkeypatch.setattr(hard_negatives, name, small)
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(4, 6))
    rows = [(i, [float(x) for x in (centre[i % 4] + rng.normal(size=6) * 0.3) * lengths[i % len(lengths)]], int(rng.integers(0, 3))) for i in range(150)]
    rows += [(200 + i, rows[0][1], i % 2) for i in range(20)]  # ties
    rows += [(300, None, 1), (301, [], 1), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (303, [float("inf")] * 6, 1), (304, rows[3][1], None), (None, rows[3][1], 1)]
    rows += [(305, [1.0, 2.0], 0), (310, [1.0, 2.0], 0), (306, [0.9, 1.2], 1), (5, rows[9][1], 0)]
    table = spark.createDataFrame([(*r, 3) for r in rows], "vec_id long, embedding array<double>, label int, rank int")
    got = hard_negatives.hard_negatives(table, F.col("vec_id") % 5 == 0, F.col("label")).collect()
    assert len(got) == len({tuple(r) for r in got}) and {r["anchor_id"] for r in got} <= {r[0] for r in rows}
    want = brute_negatives([r for r in rows if r[0] != 5])
    once = table.where("vec_id != 5 OR vec_id IS NULL")
    got = {tuple(r) for r in hard_negatives.hard_negatives(once, F.col("vec_id") % 5 == 0, F.col("label")).collect()}
    assert got == want
    assert hard_negatives.hard_negatives(table.limit(0), F.col("vec_id") % 5 == 0, F.col("label")).count() == 0
