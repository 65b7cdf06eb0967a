"""Closed trades by what they have in common, under rules, and beside another ledger, against plain loops."""

import datetime as dt
import random
from statistics import fmean, median

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cohorts

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "symbol string, position long, ts timestamp_ntz, seq long, side string, lots double, net double, period int"


def trades(spark, n, seed=1):
    draw = random.Random(seed)
    rows = [("x", draw.randrange(n // 2 + 1), T0 + dt.timedelta(hours=draw.randrange(24 * 40)), k, draw.choice(["BUY", "SELL", None]), float(draw.randrange(1, 9)), draw.choice([None, float(draw.randrange(-50, 60))] + [float(draw.randrange(-50, 60))] * 9), draw.choice([1, 2])) for k in range(n)]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_breakdowns_equal_plain_means_and_medians(spark):
    t, rows = trades(spark, 300)
    groups = {}
    for r in rows:
        if r[6] is not None:
            week = "{}-W{:02d}".format(*r[2].isocalendar()[:2])
            for key in (("whole", "whole"), ("side", r[4]), ("week", week)):
                groups.setdefault(key, []).append(r[6])
    want = {}
    for key, x in groups.items():
        win, loss = fmean([v for v in x if v > 0]), fmean([v for v in x if v < 0])
        want[key] = pytest.approx((len(x), sum(x), fmean(x), median(x), sum(v > 0 for v in x) / len(x), win, loss, -loss / (win - loss)))
    got = cohorts.breakdowns(t, F.col("net"), {"side": F.col("side"), "week": cohorts.iso_week("ts")}).collect()
    assert {(r["kind"], r["name"]): tuple(r)[2:] for r in got} == want


def test_weeks_belong_to_the_year_of_their_thursday(spark):
    days = [dt.datetime(2024, 12, 30), dt.datetime(2021, 1, 1), dt.datetime(2020, 12, 31), dt.datetime(2024, 2, 5)]
    d = spark.createDataFrame([(x,) for x in days], "ts timestamp_ntz").select(cohorts.iso_week("ts").alias("w"))
    assert [r.w for r in d.collect()] == ["2025-W01", "2020-W53", "2020-W53", "2024-W06"]


def test_breakdowns_without_wins_or_trades(spark):
    t, _ = trades(spark, 10)
    assert cohorts.breakdowns(t.limit(0), F.col("net"), {}).count() == 0
    one = cohorts.breakdowns(t.limit(1).withColumn("net", F.lit(-5)), F.col("net"), {}).first()
    assert (one["trades"], one["median"], one["win_rate"], one["mean_win"], one["hurdle"]) == (1, -5.0, 0.0, None, None)


def test_kept_variants_equal_plain_sums(spark):
    t, rows = trades(spark, 200)
    keep = {"all": F.lit(True), "bought": F.col("side") == "BUY", "none": F.lit(False)}
    plain = {"all": lambda r: True, "bought": lambda r: r[4] == "BUY", "none": lambda r: False}
    got = cohorts.kept_variants(t, F.col("net"), F.col("lots"), keep, (2, 5))
    want = {}
    for period in (1, 2):
        mine = [r for r in rows if r[7] == period]
        total = sum(r[6] or 0 for r in mine)
        for name, rule in plain.items():
            k = [r for r in mine if rule(r)]
            net, size, wins = sum(r[6] or 0 for r in k), sum(r[5] for r in k), sum((r[6] or 0) > 0 for r in k)
            want[period, name] = (len(k), wins, wins / len(k) if k else None, net, size, [net - 2 * size, net - 5 * size], len(mine) - len(k), total - net, net - total)
    assert {(r.period, r.variant): tuple(r)[2:] for r in got.collect()} == want
    every = {r.variant: (r.periods, r.better, r.above) for r in cohorts.in_every_period(got, 0).collect()}
    assert every == {v: (2, all(want[p, v][8] > 0 for p in (1, 2)), all(want[p, v][5][0] > 0 for p in (1, 2))) for v in plain}


def test_arms_equal_a_walk_over_deals(spark):
    t, rows = trades(spark, 150)
    balance = peak = fall = 0.0
    for r in sorted(rows, key=lambda r: (r[2], r[3])):
        balance += r[6] or 0
        peak = max(peak, balance)
        fall = max(fall, peak - balance)
    positions = {}
    for r in rows:
        positions[r[1]] = positions.get(r[1], 0) + (r[6] or 0)
    win, loss = sum(x for x in positions.values() if x > 0), -sum(x for x in positions.values() if x < 0)
    got = cohorts.ledger_arm(t, 1000.0).first()
    assert tuple(got)[1:] == pytest.approx((150, len(positions), balance, balance / len(positions), win / loss, fall * 100 / 1000))


def test_days_without_deals_count_in_a_comparison(spark):
    row = lambda day, net: ("x", 1, T0 + dt.timedelta(days=day), 1, "BUY", 1.0, net, 1)
    a, b = spark.createDataFrame([row(0, 10.0), row(0, 10.0), row(3, None)], SCHEMA), spark.createDataFrame([row(4, 5.0)], SCHEMA)
    got = [(r.ts.day, r.difference) for r in cohorts.paired_days(a, b, (100.0, 50.0)).orderBy("ts").collect()]
    assert got == [(1, 20.0), (2, 0.0), (3, 0.0), (4, 0.0), (5, -10.0)]
    short = cohorts.compare_ledgers(a, b, (100.0, 50.0), 100).first()
    assert (short.days, short["mean"], short.lower) == (5, 2.0, None)
    even = spark.createDataFrame([row(k, 1.0) for k in range(30)], SCHEMA)
    assert cohorts.compare_ledgers(even, a.limit(0), (100.0, 100.0), 100).first().lower == pytest.approx(1.0)
