"""Quoted pairs in folds, and halves and thirds of records, against plain loops."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import selection
from tidemark.operators import quoting

T0 = dt.datetime(2024, 1, 1)


def series(spark, n, seed=0):
    draw, mid, at, rows = random.Random(seed), 10_000, 0.0, []
    for k in range(n):
        mid += draw.choice([-3, -1, 0, 0, 1, 3])
        at += draw.choice([1, 1, 1, 4000])
        half = draw.choice([1, 1, 3])
        rows.append(("x", T0 + dt.timedelta(seconds=at), k, mid - half, mid + half))
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq long, bid_c long, ask_c long"), rows


def test_pairs_equal_a_plain_loop(spark):
    fill, ahead, trail = 4, 10, 6
    ticks, rows = series(spark, 400)
    bid, ask, at = [r[3] for r in rows], [r[4] for r in rows], [r[1] for r in rows]
    mid, want = [(b + a) / 2 for b, a in zip(bid, ask)], {}
    for i in range(fill + 1 + trail, 400 - ahead):
        if i % (fill + 1):
            continue
        near, late = range(i + 1, i + fill + 1), range(i + 2, i + fill + 2)
        both = min(bid[k] for k in near) <= bid[i] and max(ask[k] for k in near) >= ask[i]
        late_both = min(bid[k] for k in late) <= bid[i + 1] and max(ask[k] for k in late) >= ask[i + 1]
        most = max(abs(mid[k] - mid[i]) for k in range(i + 1, i + ahead + 1))
        clear = all((at[k] - at[k - 1]).total_seconds() < 3600 for k in range(i + 1, i + ahead + 1))
        want[i] = (both, late_both, abs(mid[i] - mid[i - trail]), abs(mid[i + ahead] - mid[i]), most, ask[i] - bid[i] - 2.0 if both else 0.0, clear)
    got = {r.anchor: (r.both, r.late_both, r.trail_c, r.moved_c, r.most_c, r.net_c, r.gap_clear) for r in quoting.quote_pairs(ticks, fill, ahead, trail).collect()}
    assert got == want and {w[0] for w in want.values()} == {True, False}


def test_late_pairs_are_false_where_the_series_ends(spark):
    rows = [("x", T0 + dt.timedelta(seconds=k), k, 99, 101) for k in range(12)]
    ticks = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, seq long, bid_c long, ask_c long")
    got = {r.anchor: (r.both, r.late_both) for r in quoting.quote_pairs(ticks, 2, 2, 1).collect()}
    assert got == {6: (True, True), 9: (True, False)}


@pytest.mark.parametrize("n, want", [(0, {}), (3, {4: 3}), (5, dict.fromkeys(range(5), 1)), (13, {0: 2, 1: 2, 2: 2, 3: 2, 4: 5})])
def test_folds_hold_as_many_events_and_the_last_the_rest(spark, n, want):
    e = spark.createDataFrame([("x", T0 + dt.timedelta(days=k // 4), k, k) for k in range(n)], "symbol string, ts timestamp_ntz, anchor long, v long")
    got = quoting.in_folds(e).collect()
    assert {f: sum(r.fold == f for r in got) for f in {r.fold for r in got}} == want
    assert [r.fold for r in sorted(got, key=lambda r: r.anchor)] == sorted(r.fold for r in got)


def pair(fold, state, both, late, moved, most, spread=12.0):
    return ("x", fold, 0, state, both, late, moved, most, spread, spread - 2 if both else 0.0)


def test_a_fold_passes_only_above_every_floor(spark):
    schema = "symbol string, fold int, block long, state string, both boolean, late_both boolean, moved_c double, most_c double, spread_c double, net_c double"
    good = [pair(0, "calm", True, True, 10.0, 20.0), pair(0, "calm", True, True, 10.0, 20.0), pair(0, "wild", False, False, 40.0, 50.0), pair(0, "wild", True, True, 40.0, 50.0)]
    still = [pair(1, "calm", True, True, 10.0, 20.0)] * 2 + [pair(1, "wild", True, True, 40.0, 50.0)] * 2
    e = spark.createDataFrame(good + still + [pair(2, "calm", True, True, 10.0, 20.0)], schema)
    t = quoting.judged(quoting.compared(e, ("symbol", "fold")), 2)
    rows = {r.fold: r for r in t.collect()}
    assert {k: r.status for k, r in rows.items()} == {0: "passed", 1: "failed", 2: "inconclusive"}
    assert (rows[0].lift, rows[0].ratio, rows[0].gap, rows[0].net_twice, rows[0].risk_f, rows[0].risk_u) == (0.5, 4.0, 30.0, 22.0, 0.5, 0.1)
    assert rows[2].p_u is None and rows[2].lift is None
    whole = quoting.judged(quoting.compared(e, ("symbol",)), 2)
    decisions = [quoting.stable(t.where(F.col("fold").isin(f)), whole, len(f)).first().decision for f in ([0], [0, 1], [0, 1, 2])]
    assert decisions == ["tested", "rejected", "inconclusive"]
    assert quoting.stable(t.where("fold = 0"), whole).first().decision == "inconclusive"


@pytest.mark.parametrize("train, test, want", [(0.0, 0.0, 0.0), (0.0, -1.0, 0.0), (0.0, 0.5, math.inf), (2.0, 1.0, 0.5), (-1.0, 0.5, -0.5)])
def test_efficiency(spark, train, test, want):
    assert spark.range(1).select(selection.efficiency(F.lit(train), F.lit(test))).first()[0] == want


@pytest.mark.parametrize("sharpe, want", [(-0.1, 999_999), (0.0, 999_999), (0.5, 50), (0.2, 100), (0.1, 500), (0.05, 2000), (0.001, 5000)])
def test_shortest_record(spark, sharpe, want):
    assert spark.range(1).select(selection.shortest_record(F.lit(sharpe), F.lit(0.0), F.lit(3.0))).first()[0] == want


def test_nothing_passes_if_one_stretch_alone_earns(spark):
    def passed(nets):
        run = spark.createDataFrame([("x", T0 + dt.timedelta(hours=k), x) for k, x in enumerate(nets)], "symbol string, ts timestamp_ntz, net double")
        return {r.regime: r.passed for r in selection.regime_records(run, 1638.0).collect()}

    up, flat, down = [0.01, 0.02, 0.01, 0.03], [0.0] * 4, [-0.01, -0.02, -0.01, -0.03]
    assert passed(up + flat + flat) == {"trend": False, "range": False, "high_vol": False}
    assert passed(up + up + down) == {"trend": True, "range": True, "high_vol": False}
    assert passed(flat + flat + flat) == {"trend": True, "range": True, "high_vol": True}
    assert passed([0.01, 0.02]) == {} or set(passed([0.01, 0.02])) == {"high_vol"}
    assert passed([]) == {}
