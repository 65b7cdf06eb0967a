"""Tick and bar assays: quote states, transitions, first passage, signals with entries and exits, and impulse events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import along, gap_prefix, numbered, previous, prior
from ..functions.indicators import back, c, gated
from .signals import greedy

TICK = ("ts", "seq")


def quote_moves(ticks: DataFrame) -> DataFrame:
    """ticks with state 0 to 8: (sign of the bid's move + 1) * 3 + sign of the ask's + 1; null at a symbol's first tick. Windows go over days."""
    p = previous(ticks, ["bid_c", "ask_c"], order=TICK)
    up = lambda x: F.signum((c(x) - c(f"prev_{x}")).cast("double")).cast("int") + 1
    return p.withColumn("state", up("bid_c") * 3 + up("ask_c")).drop("prev_bid_c", "prev_ask_c")


def transitions(states: DataFrame, state: str = "state") -> DataFrame:
    """(symbol, from_state, to_state, n) of consecutive known states."""
    p = previous(states.where(c(state).isNotNull()), [state], order=TICK).where(c(f"prev_{state}").isNotNull())
    return p.groupBy("symbol", c(f"prev_{state}").alias("from_state"), c(state).alias("to_state")).agg(F.count(F.lit(1)).alias("n"))


def mutual_information(joint: DataFrame) -> DataFrame:
    """Bits that from_state tells about to_state, and the entropy of to_state, from transition counts."""
    n = F.sum("n").over(Window.partitionBy("symbol"))
    rows, columns = (F.sum("n").over(Window.partitionBy("symbol", k)) for k in ("from_state", "to_state"))
    j = joint.withColumns({"_p": c("n") / n, "_a": rows / n, "_b": columns / n})
    return j.groupBy("symbol").agg(F.sum("n").alias("n"), F.sum(c("_p") * F.log2(c("_p") / (c("_a") * c("_b")))).alias("bits"), (-F.sum(c("_p") * F.log2("_b"))).alias("entropy"))


def run_histogram(ticks: DataFrame) -> DataFrame:
    """(symbol, direction, length, runs) of completed runs of mid moves of one sign; the last run of a symbol stays open and is not counted."""
    p = previous(ticks, ["mid_c"], order=TICK).where("prev_mid_c IS NOT NULL").withColumn("direction", F.signum((c("mid_c") - c("prev_mid_c")).cast("double")).cast("int"))
    i = day_islands(p.select("symbol", *TICK, "direction"), "direction").groupBy("symbol", "island", "direction").agg(F.count(F.lit(1)).alias("length"))
    last = i.groupBy("symbol").agg(F.max("island").alias("last"))
    return i.join(last, "symbol").where("island < last").groupBy("symbol", "direction", "length").agg(F.count(F.lit(1)).alias("runs"))


def day_islands(rows: DataFrame, value: str) -> DataFrame:
    """rows with island, the number of the run of equal values that they belong to, from 1. Windows go over days; a table of one row for each day carries the count on."""
    p = previous(rows, [value], order=TICK).withColumns({"_day": F.to_date("ts"), "_new": (~c(value).eqNullSafe(c(f"prev_{value}"))).cast("int")})
    days = p.groupBy("symbol", "_day").agg(F.sum("_new").alias("_n"))
    days = days.select("symbol", "_day", F.coalesce(F.sum("_n").over(Window.partitionBy("symbol").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = F.sum("_new").over(Window.partitionBy("symbol", "_day").orderBy(*TICK).rowsBetween(Window.unboundedPreceding, 0))
    return p.join(days, ["symbol", "_day"]).withColumn("island", c("_before") + inside).drop("_day", "_new", "_before", f"prev_{value}")


def with_ahead(rows: DataFrame, ahead: int, behind: int = 0, stretch: int = 50_000) -> DataFrame:
    """rows (symbol, row, ...) in stretches, each with `behind` rows before it and `ahead` after it: column `stretch`, and `own` for a stretch's own rows.

    Windows over (symbol, stretch) then see every neighbour an own row needs, and a long series is many tasks."""
    size = max(stretch, ahead + behind)
    home = (c("row") / size).cast("long")
    touched = F.array_distinct(F.transform(F.array(c("row") - ahead, c("row"), c("row") + behind), lambda r: F.greatest(F.lit(0), r / size).cast("long")))
    return rows.withColumn("stretch", F.explode(touched)).withColumn("own", c("stretch") == home)


def passage(mid: np.ndarray, cents: int, horizon: int) -> np.ndarray:
    """In how many rows each mid is first left by `cents` or more within the horizon, 0 if it isn't. Extremes of 1, 2, 4, ... rows are looked up
    from long to short, so a row costs the logarithm of the horizon and no path is built."""
    levels = max(1, int(horizon).bit_length())
    high = [np.append(mid[1:], np.iinfo(np.int64).min)]  # high[k][i]: of the 2**k rows after i
    low = [np.append(mid[1:], np.iinfo(np.int64).max)]
    at = np.arange(len(mid))
    for k in range(levels - 1):
        later = np.minimum(at + (1 << k), len(mid) - 1)
        high.append(np.maximum(high[k], high[k][later]))
        low.append(np.minimum(low[k], low[k][later]))
    free = at.copy()  # up to this row nothing was hit
    for k in reversed(range(levels)):
        free = np.where((high[k][free] < mid + cents) & (low[k][free] > mid - cents), np.minimum(free + (1 << k), len(mid) - 1), free)
    rows = free + 1 - at
    return np.where((free < len(mid) - 1) & (rows <= horizon), rows, 0)


def first_passage(ticks: DataFrame, cents: int, horizon: int) -> DataFrame:
    """(symbol, row, hit_rows, hit): for every row, in how many rows the mid moves by `cents` or more within the horizon, and to which side; null if it doesn't.

    Each stretch of rows with the horizon after it is a task of its own."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row")
        mid = pdf["mid_c"].to_numpy(np.int64)
        rows = passage(mid, cents, horizon)
        side = np.sign(mid[np.minimum(np.arange(len(mid)) + rows, len(mid) - 1)] - mid)
        out = pd.DataFrame({"symbol": pdf["symbol"], "row": pdf["row"], "hit_rows": pd.array(rows, "Int32"), "hit": pd.array(side, "Int32")})
        out.loc[rows == 0, ["hit_rows", "hit"]] = pd.NA
        return out[pdf["own"].to_numpy()]

    s = with_ahead(numbered(ticks).select("symbol", "row", "mid_c"), horizon)
    return s.groupBy("symbol", "stretch").applyInPandas(search, "symbol string, row long, hit_rows int, hit int")


def bar_samples(bars: DataFrame, direction: Column, hold: int, limit_s: float) -> DataFrame:
    """Bars with a direction of 1 or -1, entered at the next bar's open quotes and left at the close `hold` bars later, where no gap lies between: net_c pays the spread. Events don't overlap."""
    w = along()
    d = gap_prefix(bars, limit_s).withColumn("direction", direction.cast("int"))
    d = d.withColumns({"in_bid": F.lead("open_bid").over(w), "in_ask": F.lead("open_ask").over(w), "out_bid": F.lead("close_bid", hold).over(w), "out_ask": F.lead("close_ask", hold).over(w), "end_group": F.lead("gap_group", hold).over(w)})
    d = d.withColumn("ok", (c("direction") != 0) & (c("end_group") == c("gap_group")))
    taken = greedy(d, "ok", hold)
    net = F.when(c("direction") == 1, c("out_bid") - c("in_ask")).otherwise(c("in_bid") - c("out_ask"))
    return taken.select("symbol", "ts", "direction", net.alias("net_c"))


def reversal_direction(n: int = 48, k: float = 2.0) -> Column:
    """Against closes k population deviations off the mean of the n bars before."""
    x = c("close_bid") + c("close_ask")
    mean, sd = gated(F.avg(x), x, prior(n), n), gated(F.stddev_pop(x), x, prior(n), n)
    z = (x - mean) / F.nullif(sd, F.lit(0.0))
    return F.when(z <= -k, 1).when(z >= k, -1).otherwise(0)


def with_assay_moves(bars: DataFrame) -> DataFrame:
    """Quote bars with x, twice the mid at the close, r, its step, and width, the bar's range over it."""
    x = c("close_bid") + c("close_ask")
    d = bars.withColumn("x", x)
    return d.withColumns({"r": c("x") - back("x"), "width": (c("high_ask") - c("low_bid")) / F.nullif(c("x"), F.lit(0))}).withColumn("width_mid", gated(F.percentile("width", 0.5), c("width"), prior(32), 32))


def assay_directions() -> dict[str, Column]:
    """Directions of bar assays over with_assay_moves(): 1, -1 or 0 at the bar that shows one."""
    size, w = F.abs("r"), along()
    step = F.signum(c("r").cast("double")).cast("int")
    ratio = gated(F.avg(size), c("r"), w.rowsBetween(-11, 0), 12) / F.nullif(gated(F.avg(size), c("r"), w.rowsBetween(-59, -12), 48), F.lit(0.0))
    since = lambda n: F.signum((c("x") - F.lag("x", n).over(w)).cast("double")).cast("int")
    up, down = (F.sum(F.greatest(c("r") * k, F.lit(0))).over(w.rowsBetween(-1, 0)) for k in (1, -1))
    strength = F.coalesce(100.0 * up / F.nullif(up + down, F.lit(0)), F.lit(50.0))
    quiet = c("width_mid") < gated(F.percentile("width_mid", 0.5), c("width_mid"), prior(256), 256)
    top, bottom = gated(F.max("high_ask"), c("high_ask"), prior(32), 32), gated(F.min("low_bid"), c("low_bid"), prior(32), 32)
    return {
        "volatility_ratio": F.when(ratio >= 1.5, step).when(ratio <= 0.75, -step).otherwise(0),
        "sequence": F.when((step == F.lag(step).over(w)) & (step == F.lag(step, 2).over(w)), step).otherwise(0),
        "alignment": F.when((since(3) == since(12)) & (since(3) == since(48)), since(3)).otherwise(0),
        "short_strength": F.when(F.lag("r").over(w).isNull(), 0).when(strength <= 10, 1).when(strength >= 90, -1).otherwise(0),
        "compression": F.when(quiet & (c("x") > 2 * top), 1).when(quiet & (c("x") < 2 * bottom), -1).otherwise(0),
    }


def opening_range(bars: DataFrame, hour: int, hours: int, least: int = 1) -> DataFrame:
    """(symbol, day, ts, direction) of the first bar, in `hours` after the opening hour, whose high or low leaves that hour's range; days on which it leaves both
    sides at once, or whose range has fewer than `least` bars, have none."""
    d = bars.withColumn("day", F.to_date("ts")).where(F.hour("ts").between(hour, hour + hours))
    opening = F.hour("ts") == hour
    ranges = d.groupBy("symbol", "day").agg(F.max(F.when(opening, c("high_ask"))).alias("top"), F.min(F.when(opening, c("low_bid"))).alias("bottom"), F.count_if(opening).alias("bars")).where(c("bars") >= least)
    side = F.when((c("high_ask") > c("top")) & (c("low_bid") < c("bottom")), 0).when(c("high_ask") > c("top"), 1).when(c("low_bid") < c("bottom"), -1)
    breaks = d.where(~opening).join(ranges, ["symbol", "day"]).withColumn("direction", side).where("direction IS NOT NULL")
    return breaks.groupBy("symbol", "day").agg(F.min("ts").alias("ts"), F.min_by("direction", "ts").alias("direction")).where("direction <> 0")


def outcomes(samples: DataFrame) -> DataFrame:
    """Wins, losses, means and profit factor of each symbol; if any result is unknown, its means and factor are too."""
    known = F.count("net_c") == F.count(F.lit(1))
    win, loss = F.sum(F.greatest("net_c", F.lit(0))), -F.sum(F.least("net_c", F.lit(0)))
    return samples.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(c("net_c") > 0).alias("wins"), F.count_if(c("net_c") < 0).alias("losses"), F.when(known, F.avg("net_c")).alias("mean_net_c"), F.when(known, win / F.nullif(loss, F.lit(0))).alias("profit_factor"))


def detectors(k: float = 2.0, lookback: int = 20) -> dict[str, Column]:
    """Impulse detectors, 1 or -1 at the bar that shows one, else 0; each knows only bars before it as its scale."""
    side = F.when(c("close") >= c("open"), 1).otherwise(-1)
    usual = gated(F.percentile(c("high") - c("low"), 0.5), c("high"), prior(lookback), lookback)
    move = c("close") - back("close", 3)
    spread = gated(F.stddev_pop("move3"), c("move3"), along().rowsBetween(-lookback - 3, -4), lookback)
    top, bottom = gated(F.max("high"), c("high"), prior(lookback), lookback), gated(F.min("low"), c("low"), prior(lookback), lookback)
    breakout = F.when(c("close") > top, 1).when(c("close") < bottom, -1).otherwise(0)
    expansion = F.when(c("high") - c("low") > k * usual, side).otherwise(0)
    # volatility of 6 returns against that of the 18 before them
    recent = gated(F.stddev_pop("return1"), c("return1"), along().rowsBetween(-5, 0), 6)
    before = gated(F.stddev_pop("return1"), c("return1"), along().rowsBetween(-23, -6), 18)
    drift = F.signum(c("close") - back("close", 6)).cast("int")
    return {
        "vol_expansion": F.when((before > 0) & (recent > k * before), drift).otherwise(0),
        "range_expansion": expansion,
        "price_velocity": F.when(F.abs(move) > k * spread, F.signum(move).cast("int")).otherwise(0),
        "range_breakout": breakout,
        "breakout_with_expansion": F.when(breakout == expansion, breakout).otherwise(0),
    }


def impulse_events(bars: DataFrame, family: str, suppress: int = 12, **parameters) -> DataFrame:
    """(symbol, ts, direction) of a detector's events; bars within `suppress` bars after an event are none."""
    d = bars.withColumns({"move3": c("close") - back("close", 3), "return1": c("close") / F.nullif(back("close"), F.lit(0.0)) - 1}).withColumn("direction", detectors(**parameters)[family])
    return greedy(d.withColumn("shown", c("direction") != 0), "shown", suppress).select("symbol", "ts", "direction")


def measure_paths(bars: DataFrame, events: DataFrame, horizon: int, target_bps: float, stop_bps: float) -> DataFrame:
    """Events with their best and worst excursion in bps within `horizon` bars after their close, the horizon's return, and which of target and stop comes first
    (the stop, if one bar shows both). Events whose path is cut off have result "excluded"."""
    w = along().rowsBetween(1, horizon)
    b = bars.withColumns({"path": F.collect_list(F.struct("high", "low", "close")).over(w)}).select("symbol", "ts", c("close").alias("entry"), "path")
    e = events.join(b, ["symbol", "ts"])
    up = lambda p: c("direction") * (p / c("entry") - 1) * 1e4
    good = F.transform("path", lambda x: F.greatest(up(x["high"]), up(x["low"])))
    bad = F.transform("path", lambda x: F.least(up(x["high"]), up(x["low"])))
    e = e.withColumns({"good": good, "bad": bad})
    hit = F.array_position(F.transform("good", lambda x: x >= target_bps), True)
    stop = F.array_position(F.transform("bad", lambda x: x <= -stop_bps), True)
    result = F.when(F.size("path") < horizon, "excluded").when((stop > 0) & ((hit == 0) | (stop <= hit)), "stop").when(hit > 0, "target").otherwise("time")
    whole = F.size("path") == horizon
    return e.select("symbol", "ts", "direction", result.alias("result"), F.when(whole, F.array_max("good")).alias("mfe_bps"), F.when(whole, F.array_min("bad")).alias("mae_bps"), F.when(whole, up(F.get("path", F.lit(horizon - 1))["close"])).alias("return_bps"))
