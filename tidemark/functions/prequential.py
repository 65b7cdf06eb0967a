"""Forecasts that learn as they go: each month a ridge regression on earlier months only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import along, prior, trailing
from ..operators.asof import asof
from .indicators import c

FEATURES = ("mom_1m", "mom_3m", "vol_21", "slope", "mom_x_slope")


def monthly_features(daily: DataFrame, slope: DataFrame, fresh_s: float = 5 * 86400) -> DataFrame:
    """(symbol, ts, close, FEATURES): each month's last daily close (symbol, ts, close) with returns of one and three months, yearly volatility of 21 daily returns, and the slope (symbol, ts, value)
    as known one observation earlier, within fresh_s. Nothing after ts counts."""
    w = along()
    r = daily.withColumn("_r", c("close") / F.lag("close").over(w) - 1)
    vol = F.when(F.count("_r").over(trailing(21)) == 21, F.stddev_samp("_r").over(trailing(21)) * np.sqrt(252.0))
    month = F.trunc("ts", "month")
    last = r.withColumn("vol_21", vol).groupBy("symbol", month.alias("_m")).agg(F.max_by(F.struct("ts", "close", "vol_21"), "ts").alias("x")).select("symbol", "x.*")
    m = last.withColumns({f"mom_{k}m": c("close") / F.lag("close", k).over(w) - 1 for k in (1, 3)})
    earlier = slope.where("value IS NOT NULL").withColumn("value", F.lag("value").over(w)).where("value IS NOT NULL")
    m = asof(m, earlier, max_age_s=fresh_s).drop("matched_ts").withColumnRenamed("value", "slope")
    return m.withColumn("mom_x_slope", c("mom_3m") * c("slope"))


def ridge(x: np.ndarray, y: np.ndarray, now: np.ndarray, strength: float, most: float) -> float:
    """The forecast at `now`: features are centred and scaled by what was learnt from, and cut at `most` deviations; the mean is not shrunk."""
    centre, scale = x.mean(0), x.std(0, ddof=1)
    scale = np.where(scale < 1e-10, 1.0, scale)
    z, at = (np.clip((v - centre) / scale, -most, most) for v in (x, now))
    weights = np.linalg.solve(z.T @ z + strength * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return float(y.mean() + at @ weights)


def prequential_ridge(monthly: DataFrame, features: tuple[str, ...] = FEATURES, lookback: int = 120, least: int = 60, strength: float = 20.0, threshold: float = 0.003, most: float = 5.0) -> DataFrame:
    """(symbol, ts, forecast, long, training_rows, training_last, usable) for each row of monthly (symbol, ts, close, features).

    A row learns from the `lookback` rows before it whose features and next returns are known; the return of the row before ends with this row's close. With fewer than
    `least` of them, or an unknown feature, there is no forecast and no position. long: the forecast exceeds the threshold. Every row carries its own bounded
    window, so rows are solved wherever they lie.
    """
    if lookback < least or least < 24 or strength <= 0 or threshold < 0 or most < 1:
        raise ValueError("too little history, or settings out of range")
    w = along()
    known = F.array(*[c(f).cast("double") for f in features])
    full = ~F.exists(known, lambda v: v.isNull() | F.isnan(v))
    m = monthly.select("symbol", "ts", "close", F.when(full, known).alias("_x"), (F.lead("close").over(w) / c("close") - 1).alias("_y"))
    past = F.collect_list(F.when(c("_x").isNotNull() & c("_y").isNotNull(), F.struct("ts", "_x", "_y"))).over(prior(lookback))
    m = m.withColumn("_past", past).select("symbol", "ts", "_x", "_past")

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for symbol, ts, now, past in part.itertuples(index=False):
                usable, forecast = now is not None and len(past) >= least, None
                if usable:
                    x, y = np.array([list(p["_x"]) for p in past]), np.array([p["_y"] for p in past])
                    forecast = ridge(x, y, np.array(list(now)), strength, most)
                out.append((symbol, ts, forecast, int(usable and forecast > threshold), len(past), past[-1]["ts"] if len(past) else None, usable))
            yield pd.DataFrame(out, columns=["symbol", "ts", "forecast", "long", "training_rows", "training_last", "usable"])

    stamp = monthly.schema["ts"].dataType.simpleString()
    return m.mapInPandas(solve, f"symbol string, ts {stamp}, forecast double, long int, training_rows int, training_last {stamp}, usable boolean")


def held_through_next(forecasts: DataFrame, daily: DataFrame) -> DataFrame:
    """(symbol, ts, position): each day holds the last forecast made by then; fills at the next open are the backtest's."""
    return asof(daily.select("symbol", "ts"), forecasts.select("symbol", "ts", c("long").cast("double").alias("value"))).select("symbol", "ts", F.coalesce("value", F.lit(0.0)).alias("position"))
