"""Deals that share (ts, seq): what is in by then counts them together, as the running sum of the SQL twin does, and their order is fixed."""

import datetime as dt
from itertools import permutations

from tidemark.operators import lifecycle


def test_tied_deals_have_one_order(spark):
    t0, t1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)
    tied = [(t1, 2, False, "buy", 1), (t1, 2, False, "sell", 2)]
    rows = [(i, *deal, 100, 0, 0) for i, order in enumerate(permutations([(t0, 7, True, "sell", 2), *tied])) for deal in order]
    deals = spark.createDataFrame(rows, "position_key int, ts timestamp_ntz, seq int, is_entry boolean, side string, qty int, price int, gross int, charge int")
    for parts in (1, 3):
        got = [r["status"] for r in lifecycle.round_trips(deals.repartition(parts)).collect()]
        assert got == ["exit_too_large"] * 6
