"""Draws of blocks: both sides of the join grow with the data, so neither may be broadcast."""

import hashlib
from collections import defaultdict

from tidemark.operators import grid


def test_draws_are_not_broadcast(spark):
    rows = [("a", h, p, 3 * b, 10 * b + h) for h in (4, 16) for p in range(3) for b in range(40 + 7 * p)]
    drawn = grid.stratified_draws(spark.createDataFrame(rows, "symbol string, horizon int, part int, block long, n_a long"), 5, seed=2)
    got = {(r["symbol"], r["horizon"], r["draw"]): r["n_a"] for r in drawn.collect()}
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    groups = defaultdict(list)
    for symbol, horizon, part, _, n in rows:
        groups[symbol, horizon, part].append(n)
    want = defaultdict(int)
    for (symbol, horizon, part), values in groups.items():
        for draw in range(5):
            for b in range(len(values)):
                want[symbol, horizon, draw] += values[int(hashlib.md5(f"2:{draw}:{part}:{b}".encode()).hexdigest()[:12], 16) % len(values)]
    assert got == want
