"""Rules tied to the hours of a day, and rules that wait for an unbroken run of bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import along, seconds, so_far
from ..functions.indicators import c, channel, simple_return, true_range, wilder
from .signals import in_hours, sign


def session_breakout(bars: DataFrame, buffer: float, hours: tuple[int, int] = (0, 7), entry_end: int = 16, flat_from: int = 19, least: int = 8, atr_bars: int = 14, risk: float = 0.01, most: float = 1.0) -> DataFrame:
    """bars with position, stop_distance and size: a day's first close that leaves the range of its hours [from, to) by more than `buffer` mean true ranges, before
    entry_end, sets the side until flat_from; outside those hours the position is 0, and null while the mean true range is unknown. A range needs `least` bars.

    stop_distance is the way to the range's other side and size the share that loses `risk` there, both on the entry's bar only. Nothing depends on what is held,
    so this is windows over (symbol, day); only the mean true range goes along a symbol.
    """
    d = wilder(bars.withColumn("_tr", true_range()), "_tr", atr_bars, "_atr")
    hour, day = F.hour("ts"), Window.partitionBy("symbol", "_day")
    now = day.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    ranged = (hour >= hours[0]) & (hour < hours[1])
    d = d.withColumn("_day", F.to_date("ts")).withColumns({"_top": F.max(F.when(ranged, c("high"))).over(day), "_bottom": F.min(F.when(ranged, c("low"))).over(day), "_known": F.sum(ranged.cast("int")).over(day)})
    may = (hour >= hours[1]) & (hour < entry_end) & (c("_known") >= least)
    d = d.withColumn("_side", F.when(may & (c("close") > c("_top") + buffer * c("_atr")), 1).when(may & (c("close") < c("_bottom") - buffer * c("_atr")), -1))
    d = d.withColumns({"_first": F.first("_side", True).over(now), "_entry": c("_side").isNotNull() & (F.count("_side").over(now) == 1)})
    held = F.when((hour < hours[1]) | (hour >= flat_from), 0).otherwise(F.coalesce("_first", F.lit(0)))
    stop = F.when(c("_entry"), F.when(c("_side") > 0, c("close") - c("_bottom")).otherwise(c("_top") - c("close")))
    d = d.withColumns({"position": F.when(c("_atr").isNotNull(), held), "stop_distance": stop})
    d = d.withColumn("size", F.when(c("stop_distance") > 0, F.least(F.lit(most), risk / (c("stop_distance") / c("close")))))
    return d.drop("_tr", "_atr", "_day", "_top", "_bottom", "_known", "_side", "_first", "_entry")


def unbroken(bars: DataFrame, step_s: float, out: str = "run") -> DataFrame:
    """bars with `out`: how many bars up to this one, itself included, followed each other step_s seconds apart."""
    w = along()
    broken = F.coalesce(seconds() - seconds(F.lag("ts").over(w)) != step_s, F.lit(True))
    d = bars.withColumn("_n", F.row_number().over(w)).withColumn("_start", F.when(broken, c("_n")))
    return d.withColumn(out, c("_n") - F.last("_start", True).over(so_far()) + 1).drop("_n", "_start")


def waiting(position: Column, n: int, run: str = "run") -> Column:
    """position where the run holds n bars or more, else 0; unknown is 0."""
    return F.when(c(run) >= n, F.coalesce(position, F.lit(0))).otherwise(0)


def run_rules(bars: DataFrame, step_s: float) -> DataFrame:
    """bars with run and four sides at the close: trend of 12 bars, reversal of 4, breakout of the 32 before, and momentum of 4 from 7 to 18 o'clock. Each waits for
    one bar more than it looks back."""
    high, low = channel(32)
    breakout = F.when(c("close") > high, 1).when(c("close") < low, -1)
    momentum = sign(simple_return("close", 4))
    rules = {"trend": (sign(simple_return("close", 12)), 13), "reversal": (-momentum, 5), "breakout": (breakout, 33), "session": (F.when(in_hours(7, 18), momentum), 5)}
    return unbroken(bars, step_s).withColumns({k: waiting(p, n) for k, (p, n) in rules.items()})
