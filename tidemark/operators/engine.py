"""Fixed units between decisions: fills at opens, stops inside bars, financing by elapsed days, and a forced close."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "symbol string, ts timestamp_ntz, side int, units double, equity double, exits array<struct<exit_reason:string,entry_ts:timestamp_ntz,entry:double,exit:double,pnl:double>>"


def run_plan(plan: DataFrame, side_bps: float, financing_year: float = 0.0, equity: float = 1.0) -> DataFrame:
    """A row for each bar of plan (symbol, ts, open, high, low, close, target, size, stop_dist): what is held at its close, equity, and the trades that ended in it.

    target (1, 0, -1; null changes nothing) is decided at a close and filled at the next open for size * equity. A stop lies stop_dist from the
    entry (null: none); it fills at the worse of the open and the stop, and its side stays barred until the target changes. An entry's own bar can
    stop it. Financing is charged on the last close's value for the days since. What is held at the last bar is closed at its close. Bars
    without prices are left out. One fold for each symbol's bars.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["open", "high", "low", "close"]).sort_values("ts").reset_index(drop=True)
        cash, side, units, stop, barred, opened, last_bar = equity, 0, 0.0, None, 0, (None, 0.0, 0.0), len(pdf) - 1
        wanted, size, distance, before, out, exits = None, 0.0, None, None, [], []
        rate = side_bps / 1e4

        def leave(price: float, reason: str):
            nonlocal cash, side, units
            cash += units * price - abs(units) * price * rate
            exits.append({"exit_reason": reason, "entry_ts": opened[0], "entry": opened[1], "exit": price, "pnl": cash - opened[2]})
            side, units = 0, 0.0

        for i, b in enumerate(pdf.itertuples(index=False)):
            exits = []
            if side and before is not None:
                cash -= abs(units) * before[1] * financing_year * (b.ts - before[0]).total_seconds() / 86400 / 365
            if wanted is not None and wanted != barred:
                barred = 0
            if wanted is not None and wanted != side:
                if side:
                    leave(b.open, "target")
                if wanted and wanted != barred and b.open > 0 and cash > 0:
                    start = cash
                    side, units = wanted, wanted * size * cash / b.open
                    cash -= units * b.open + abs(units) * b.open * rate
                    stop = None if distance is None else b.open - side * distance
                    opened = (b.ts, b.open, start)
            if side and stop is not None and (b.low <= stop if side > 0 else b.high >= stop):
                barred = side
                leave(min(b.open, stop) if side > 0 else max(b.open, stop), "stop")
            if side and i == last_bar:
                leave(b.close, "end")
            out.append((b.symbol, b.ts, side, units, cash + units * b.close, exits))
            known = lambda x: x is not None and not math.isnan(x)
            if known(b.target):
                wanted, size, distance = int(b.target), float(b.size) if known(b.size) else 1.0, float(b.stop_dist) if known(b.stop_dist) else None
            before = (b.ts, b.close)
        return pd.DataFrame(out, columns=["symbol", "ts", "side", "units", "equity", "exits"])

    d = plan.select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), *[F.col(x).cast("double").alias(x) for x in ("open", "high", "low", "close", "target", "size", "stop_dist")])
    return d.groupBy("symbol").applyInPandas(run, SCHEMA)


def trades(run: DataFrame) -> DataFrame:
    """(symbol, entry_ts, exit_ts, entry, exit, pnl, exit_reason) of a run's trades."""
    return run.select("symbol", F.col("ts").alias("exit_ts"), F.explode("exits").alias("x")).select("symbol", "x.entry_ts", "exit_ts", "x.entry", "x.exit", "x.pnl", "x.exit_reason")
