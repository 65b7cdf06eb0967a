"""Bars whose mid is 0: features follow the same division rules as the SQL twins."""

import datetime as dt
import math

from tidemark.functions.indicators import log_ratio
from tidemark.operators import drivers, ledger


def test_features_of_a_mid_of_zero(spark):
    t0 = dt.datetime(2024, 1, 1)
    mids = [100, 200, 0, 0, 400, 400, 800]
    bars = spark.createDataFrame([("a", t0 + dt.timedelta(minutes=i), m - 1, m + 1, 2.0) for i, m in enumerate(mids)], "symbol string, ts timestamp_ntz, close_bid long, close_ask long, mean_spread double")
    got = [tuple(r)[2:] for r in drivers.bar_features(bars, (1, 2), (2,)).orderBy("ts").collect()]
    inf, nan, log2 = math.inf, math.nan, math.log(2)
    want = [(-inf, -inf, inf, inf), (nan, -inf, nan, inf), (inf, inf, nan, 50.0), (0.0, inf, inf, 50.0), (log2, log2, log2 / 2, 25.0)]
    assert len(got) == len(want)
    for row, expected in zip(got, want, strict=True):
        assert all(math.isnan(x) if math.isnan(y) else math.isclose(x, y, abs_tol=1e-12) for x, y in zip(row, expected, strict=True)), (row, expected)


def test_log_ratio_follows_ieee_rules(spark):
    pairs = [(1.0, 1.0), (0.0, 1.0), (1.0, 0.0), (0.0, 0.0), (-1.0, 1.0), (None, 1.0), (1.0, None)]
    got = [r[0] for r in spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, x double, y double").orderBy("i").select(log_ratio("x", "y")).collect()]
    assert got[:3] == [0.0, -math.inf, math.inf] and math.isnan(got[3]) and math.isnan(got[4]) and got[5:] == [None, None]


def test_quote_costs_count_entries_at_a_mid_of_zero(spark):
    samples = [("zero", 1, 0.0, -5.0, 3.0), ("zero", -1, 100.0, -3.0, 1.0), ("none", 1, 0.0, 0.0, 0.0), ("plain", 1, 100.0, 1.0, -3.0), ("plain", 0, 0.0, 1.0, 1.0)]
    got = {r["symbol"]: tuple(r)[1:] for r in ledger.quote_costs(spark.createDataFrame(samples, "symbol string, direction int, entry_mid double, pnl_long double, pnl_short double")).collect()}
    assert got["zero"] == (2, -math.inf, math.inf, -math.inf)
    assert got["none"][0] == 1 and all(math.isnan(x) for x in got["none"][1:])
    assert got["plain"] == (1, 200.0, 100.0, 100.0)
