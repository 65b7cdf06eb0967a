"""The ten operators against brute force on small rows with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, line_dedup, mixing, ngram_jaccard, packing, sharding, substring_dedup, token_output, topk, toxicity
from tidemark.llm._tokens import vocabulary_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"w{i}" for i in range(60))
LINES = "\n".join(f"a line of number {i}" for i in range(6))
TEXTS = [
    (1, "same  text"), (2, "same\ttext"), (3, " same text"), (4, None), (5, ""), (6, "  "), (7, PASSAGE + " tail one"), (8, "head " + PASSAGE), (9, "x " * 100),
    (10, LINES), (11, "first\n" + LINES + "\nlast"), (12, LINES.replace("number", "other")), (13, "ÄÖ é naïve ñ"), (14, "one two"), (15, "one two"), (None, "same text"), (None, None),
    (16, " ".join(f"v{i % 977}" for i in range(9000))), (17, " ".join(f"v{i % 977}" for i in range(9000)) + " more"), (18, PASSAGE), (18, PASSAGE), (19, "One TWO three four five"), (20, "one two three four five six"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "s" + str((i or 0) % 3) if i != 5 else None, "en", 1, "k1", "c") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n int, k1 string, hub string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_exact_dedup(docs, empty):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in TEXTS]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    want = sorted(str((i, min((x for x in groups[t] if x is not None), default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest())) for i, t in norm)
    got = exact_dedup.exact_dedup(docs, fan_in=2, lane_rows=3).collect()
    assert sorted(str((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"])) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_merge_refuses_digest_collisions():
    a = np.array([(b"x" * 32, 1, 1, 1, 1)], exact_dedup.ENTRY)
    b = np.array([(b"x" * 32, 2, 1, 2, 1)], exact_dedup.ENTRY)
    with pytest.raises(ValueError):
        exact_dedup.merge_runs([a, b])


@pytest.mark.parametrize("hot", [500, 1])
def test_substring_dedup(docs, empty, hot, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    words = [WORD.findall(t or "") for _, t in TEXTS]
    seen = Counter(" ".join(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = []
    for (i, t), w in zip(TEXTS, words, strict=True):
        gone = {j for s in range(len(w) - 34) if seen[" ".join(w[s : s + 35])] > 1 for j in range(s, s + 35)}
        want.append(str((i, t, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone) if gone else None)))
    got = substring_dedup.substring_dedup(docs).collect()
    assert sorted(str((r["doc_id"], r["text"], r["n_words"], r["n_removed"], r["kept_text"])) for r in got) == sorted(want)
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_suffix_automaton_counts():
    a = substring_dedup.SuffixAutomaton()
    a.add(list("abab"), 1)
    a.close()
    assert a.repeats(list("abab"), 2) == [0, 2]


def test_token_output(spark, docs, empty, tmp_path):
    from tokenizers import Tokenizer

    path = vocabulary_path("word_bpe_49k.json")
    full = Tokenizer.from_file(path)
    token_output.write_token_ids(docs, path, str(tmp_path / "a"))
    got = token_output.read_token_ids(spark, str(tmp_path / "a")).orderBy("start").collect()
    start = 0
    texts = defaultdict(list)
    for i, t in TEXTS:
        texts[i].append([*full.encode(t or "", add_special_tokens=False).ids, 2])
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i))
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids in texts[r["doc_id"]] and r["start"] == start and r["n_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    token_output.write_token_ids(empty, path, str(tmp_path / "b"))
    assert token_output.read_token_ids(spark, str(tmp_path / "b")).count() == 0


def test_code_lengths_are_bounded_and_complete():
    counts = np.array([2**i for i in range(30)] + [0])
    lengths = token_output.code_lengths(counts, 6)
    assert lengths.max() <= 6 and lengths[-1] == 0 and math.isclose(sum(2.0 ** -int(x) for x in lengths if x), 1.0)


def brute_lines(rows, run=3, words=50):
    """(lines, removed lines, kept text) of each (doc_id, text), ids in order; rows that repeat are one place."""
    seen, out = set(), {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (t or "").split("\n")
        full = [p for p, x in enumerate(raw) if x.strip(" \t\r")]
        lines = [raw[p].strip(" \t\r") for p in full]
        gone = set()
        for n in range(1, run + 1):
            for s in range(len(lines) - n + 1):
                key = tuple(lines[s : s + n])
                if n < run and sum(len(WORD.findall(x)) for x in key) < words:
                    continue
                if key in seen:
                    gone |= {full[p] for p in range(s, s + n)}
                seen.add(key)
        out[(i, t)] = (len(lines), len(gone), t if t is None or not gone else "\n".join(x for p, x in enumerate(raw) if p not in gone))
    return out


LONG = " ".join(f"q{i}" for i in range(55))
PAIR = " ".join(f"r{i}" for i in range(30))
LINE_TEXTS = [*TEXTS, (30, LONG), (31, f"{LONG}\nshort"), (32, f"before\n {LONG}\t\nafter"), (33, f"{PAIR}\n\n{PAIR} x"), (34, f"{PAIR}\n{PAIR} x\nmore"), (35, f"{PAIR}\nother"), (36, f"a\nb\na\nb\na\nb\na\nb"), (37, "")]


def test_line_dedup(spark, docs, empty):
    more = docs.select("doc_id", "text").union(spark.createDataFrame(LINE_TEXTS[len(TEXTS) :], "doc_id long, text string"))
    # two texts share the null id and their order is that of a hash, but they have no windows
    want = brute_lines(LINE_TEXTS)
    got = line_dedup.line_dedup(more).collect()
    assert len(got) == len(LINE_TEXTS)
    for r in got:
        assert (r["n_lines"], r["n_removed"], r["kept_text"]) == want[(r["doc_id"], r["text"])], r
    by = {r["doc_id"]: r for r in got}
    assert by[11]["kept_text"] == "first\nlast" and by[10]["kept_text"] == LINES
    assert by[31]["kept_text"] == "short" and by[32]["kept_text"] == "before\nafter" and by[34]["kept_text"] == "more" and by[35]["n_removed"] == 0
    assert line_dedup.line_dedup(empty).count() == 0


def test_clashing_columns_are_replaced_and_operators_chain(docs):
    named = docs.withColumns({c: F.lit("mine") for c in ("_a", "_b", "_k1", "k2", "runs", "row", "kept_text", "N_REMOVED", "lines")})
    once = line_dedup.line_dedup(named)
    both = substring_dedup.substring_dedup(once)
    twice = line_dedup.line_dedup(both.withColumn("text", F.coalesce("kept_text", "text")))
    assert {r[0] for r in twice.select(F.concat("_a", "_b", "_k1", "k2", "runs", "row", "lines")).distinct().collect()} == {"mine" * 7}
    assert len(twice.columns) == len({c.lower() for c in twice.columns}) and twice.count() == len(TEXTS)


def brute_components(rows, n, a, b):
    def shingles(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and b * len(sets[x] & sets[y]) >= a * len(sets[x] | sets[y]):
                root[find(x)] = find(y)
    ids = defaultdict(list)
    for x, (i, _) in enumerate(rows):
        ids[find(x)].append(i)
    return sorted(str((rows[x][0], len(sets[x]), min((i for i in ids[find(x)] if i is not None), default=None))) for x in range(len(rows)))


@pytest.mark.parametrize("block, small, crowded", [(1500, 32, 10_000), (3, 2, 3)])
def test_ngram_jaccard(spark, docs, empty, block, small, crowded, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "CROWDED", crowded)
    monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
    monkeypatch.setattr(ngram_jaccard, "SMALL", small)
    base = [f"t{i}" for i in range(40)]
    chain = [(100 + k, " ".join(base[k : k + 30] + [f"z{k}"])) for k in range(9)]
    rows = TEXTS + chain
    more = docs.select("doc_id", "text").union(spark.createDataFrame(chain, "doc_id long, text string"))
    got = ngram_jaccard.ngram_jaccard(more, 4, (85, 100)).collect()
    assert sorted(str((r["doc_id"], r["n_shingles"], r["component_id"])) for r in got) == brute_components(rows, 4, 85, 100)
    assert ngram_jaccard.ngram_jaccard(empty).count() == 0


def test_sharding(docs, empty):
    got = sharding.shard_records(docs, [1.0] * 7).collect()
    assert len(got) == len(TEXTS)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 7)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r["shard"] for r in sharding.shard_records(docs, [1.0, 0.0001]).collect()} <= {0, 1}
    one_more = {(r["id"], r["text_crc32"]): r["shard"] for r in sharding.shard_records(docs, [1.0] * 8).collect()}
    assert all(one_more[(r["id"], r["text_crc32"])] == r["grown_shard"] for r in got)
    assert sharding.shard_records(empty, [1.0] * 3).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 4) / 4]) for i in range(60)] + [(60, None), (61, [1.0, None, 0.0, 0.0]), (62, [float("nan")] * 4), (None, [1.0] * 4), (63, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.topk_inner_product(df, F.col("vec_id") % 10 == 0, 5).collect()
    fine = {i: [math.floor(1024 * x) for x in v] for i, v in rows[:60]}
    want = []
    for q in range(0, 60, 10):
        best = sorted((-sum(a * b for a, b in zip(fine[q], fine[i], strict=True)), i) for i in fine if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)
    assert topk.topk_inner_product(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_pivots_spare_work():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 6)) * 1000
    x = np.floor(np.repeat(centres, 200, 0) + rng.normal(size=(1600, 6)))
    x /= np.linalg.norm(x, axis=1, keepdims=True) / 1024
    x = np.floor(x)
    _, scored = topk.search_block(np.arange(2), x[:2], np.arange(1600), x, x[::200], 5)
    assert scored < 2 * 1600


def test_mixing(docs, empty):
    got = mixing.mix_sources(docs, [5, 2, 1]).collect()
    assert len(got) == len(TEXTS)
    per = defaultdict(list)
    for r in got:
        per[r["source"]].append(r)
        assert r["taken"] <= 2 * r["size"]
    total = sum(r["size"] for r in got)
    assert sum(v[0]["target"] for v in per.values()) == pytest.approx(min(1.5 * total, 2 * total))
    for v in per.values():
        assert v[0]["target"] <= 2 * v[0]["source_size"] + 1e-9
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= max(r["size"] for r in v) / 2 + 1
    again = mixing.mix_sources(docs, [5, 2, 1]).collect()
    assert sorted(str(r) for r in got) == sorted(str(r) for r in again)
    assert mixing.mix_sources(empty, [5, 2, 1]).count() == 0


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    path = vocabulary_path("word_bpe_49k.json")
    full = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, with_ids=True).collect()
    ids = sum(len(full.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in TEXTS)
    assert sum(r["length"] for r in got) == ids
    sequences = defaultdict(list)
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and sum(n for _, n in s) <= 2048
    assert len(sequences) <= -(-ids // 2048) + 1
    assert packing.pack_documents(empty, path).count() == 0


def test_plan_is_optimal_on_small_cases():
    def best(items, capacity):
        bins = len(items)

        def place(i, rooms):
            nonlocal bins
            if len(rooms) >= bins:
                return
            if i == len(items):
                bins = len(rooms)
                return
            for k in range(len(rooms)):
                if rooms[k] >= items[i] and rooms[k] not in rooms[:k]:
                    place(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
            place(i + 1, [*rooms, capacity - items[i]])

        place(0, [])
        return bins

    rng = np.random.default_rng(3)
    more = 0
    for _ in range(60):
        items = sorted(rng.integers(1, 21, 9).tolist(), reverse=True)
        left = [0] * 21
        for n in items:
            left[n] += 1
        fixed = packing.reduce_by_dominance(left, 20)
        used = sum(p.times for p in fixed) + sum(p.times for p in packing.best_fit(left, 20))
        more += used - best(items, 20)
    assert more <= 3


def test_segments_are_maximal():
    # scores 5 1 -2x3 (drift) 4: one passage if the way between costs less than either side
    assert [(a, b) for a, b, _ in toxicity.segments([0, 1, 5], [5.0, 1.0, 4.0], -0.5)] == [(0, 6)]
    assert [(a, b) for a, b, _ in toxicity.segments([0, 20], [2.0, 3.0], -0.5)] == [(0, 1), (20, 21)]


def test_toxicity(spark, docs, empty):
    bad, good = [f"vile{i}" for i in range(30)], [f"word{i}" for i in range(300)]
    rng = np.random.default_rng(2)
    rows = []
    for i in range(400):
        w = list(rng.choice(good, 60))
        if i % 4 == 0:
            w[20:28] = rng.choice(bad, 8)
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", "toxic").where(~toxicity.held_out(F.col("doc_id")))
    model = toxicity.fit(df.drop("toxic"), labels)
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    assert np.mean([got[i]["predicted"] == t for i, _, t in rows]) > 0.97
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == len(TEXTS) and all(0 <= r["score"] < 0.5 for r in odd)
    assert toxicity.score(empty, model).count() == 0 and toxicity.filter_clean(docs, model).columns == docs.columns
    assert toxicity.fit(empty, labels.limit(0)).weight == 0
