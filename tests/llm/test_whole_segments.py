"""Segments of which nothing is left to find out make no suffix arrays."""

import random

import pandas as pd

from tidemark.llm import suffix_dedup


def noted(monkeypatch):
    seen, plain = [], suffix_dedup.repeats
    monkeypatch.setattr(suffix_dedup, "repeats", lambda strings, *rest: seen.extend(strings) or plain(strings, *rest))
    return seen


def test_anchors_whose_segments_all_repeat_need_no_suffix_array(monkeypatch):
    seen = noted(monkeypatch)
    rng = random.Random(4)
    a, b, c, d, e = (bytes(rng.choice(b"abcd") for _ in range(60)) for _ in range(5))
    rows = [(1, b"a", a, 2), (2, b"b1", b + c[:9], 1), (2, b"b2", c[20:] + b, 1), (3, b"c", c, 1), (4, b"d1", d, 3), (4, b"d2", d + e, 2), (5, b"e1", e, 1), (5, b"e2", e[:50], 4)]
    frame = lambda rows: pd.DataFrame(rows, columns=["anchor", "key", "segment", "n"])
    got = {k: [(h["at"], h["n"]) for h in hits] for k, hits in suffix_dedup._match(40)(frame(rows)).itertuples(index=False)}
    assert got == {b"a": [(0, 21)], b"b1": [(0, 21)], b"b2": [(40, 21)], b"d1": [(0, 21)], b"d2": [(0, 81)], b"e1": [(0, 11)], b"e2": [(0, 11)]}
    assert sorted(seen) == sorted([b + c[:9], c[20:] + b, c, e, e[:50]])
    seen.clear()
    assert len(suffix_dedup._match(40)(frame(rows[:1]))) == 1 and len(suffix_dedup._match(40)(frame([]).astype({"n": int}))) == 0 and not seen
