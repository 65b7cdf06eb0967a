"""Ticks to bars and bars to longer bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ticks_to_bars(ticks: DataFrame, width: str = "6 hours") -> DataFrame:
    """OHLC bars of mid prices, labelled by their start; empty bars are absent. Partial aggregation leaves one row for each task and bar to shuffle."""
    at = F.struct("ts", "seq")
    mid = F.col("mid_c") / 100.0
    bars = ticks.groupBy("symbol", F.window("ts", width).alias("w")).agg(F.min_by(mid, at).alias("open"), F.max(mid).alias("high"), F.min(mid).alias("low"), F.max_by(mid, at).alias("close"), F.count(F.lit(1)).cast("double").alias("volume"))
    return bars.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def quote_bars(ticks: DataFrame, width: str = "15 minutes") -> DataFrame:
    """First and last quotes of each bar, its extreme prices and mean spread, in integer cents."""
    at = F.struct("ts", "seq")
    bars = ticks.groupBy("symbol", F.window("ts", width).alias("w")).agg(F.min_by("bid_c", at).alias("open_bid"), F.min_by("ask_c", at).alias("open_ask"), F.max_by("bid_c", at).alias("close_bid"), F.max_by("ask_c", at).alias("close_ask"), F.max("ask_c").alias("high_ask"), F.min("bid_c").alias("low_bid"), F.avg(F.col("ask_c") - F.col("bid_c")).alias("mean_spread"))
    return bars.select("symbol", F.col("w.start").alias("ts"), *[c for c in bars.columns if c not in ("symbol", "w")])


def resample(bars: DataFrame, width: str, start: str | None = None) -> DataFrame:
    """OHLCV of longer bars, closed and labelled on the left. Weeks from Sunday: width "7 days", start "3 days"."""
    w = F.window("ts", width, width, start) if start else F.window("ts", width)
    out = bars.groupBy("symbol", w.alias("w")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_bars"))
    return out.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume", "n_bars")


def complete(bars: DataFrame, width: str, parts: int) -> DataFrame:
    """Longer bars that have all of their parts."""
    return resample(bars, width).where(F.col("n_bars") == parts)


def trading_days(bars: DataFrame, roll_hours: int = 7, least: int = 1) -> DataFrame:
    """Daily bars whose day begins roll_hours before midnight, where at least `least` bars are known."""
    label = F.to_date(F.col("ts") + F.make_interval(hours=F.lit(roll_hours)))
    out = bars.groupBy("symbol", label.alias("ts")).agg(F.min_by("open", "ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("n_bars"))
    return out.where(F.col("n_bars") >= least)
