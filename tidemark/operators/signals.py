"""Position rules: columns in [-1, 1] at the bar that decides them, before any lag; and folds where the next state depends on the state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import along, prior, so_far
from ..functions.indicators import back, c, channel, gated, rolling_quantile, rolling_z, simple_return, sma, std


def sign(x: Column) -> Column:
    return F.signum(x).cast("int")


def time_series_momentum(n: int) -> Column:
    return sign(simple_return("close", n))


def sma_cross(fast: int, slow: int) -> Column:
    return sign(sma("close", fast) - sma("close", slow))


def above_sma(n: int, long_only: bool = True) -> Column:
    above = c("close") > sma("close", n)
    return F.when(sma("close", n).isNull(), None).otherwise(F.when(above, 1).otherwise(0 if long_only else -1))


def low_quantile(x: str, q: float, n: int) -> Column:
    """1 below the trailing quantile, else 0: contrarian on a ratio or a net position."""
    return (c(x) < rolling_quantile(x, q, n)).cast("int")


def z_fade(x: str, n: int, k: float) -> Column:
    z = rolling_z(x, n)
    return F.when(z <= -k, 1).when(z >= k, -1).when(z.isNotNull(), 0)


def in_hours(start: int, end: int) -> Column:
    """Whether the hour lies in [start, end), over midnight if start > end."""
    h = F.hour("ts")
    return (h >= start) & (h < end) if start <= end else (h >= start) | (h < end)


def turn_of_month(before: int = 2, after: int = 3) -> Column:
    return ((F.dayofmonth("ts") <= after) | (F.dayofmonth("ts") > F.dayofmonth(F.last_day("ts")) - before)).cast("int")


def vol_managed(target: float, vol: Column, most: float = 1.0) -> Column:
    return F.least(F.lit(most), F.lit(target) / F.nullif(vol, F.lit(0.0)))


def persistent(enter_long: Column, enter_short: Column) -> Column:
    """The last entry's side, until the other side enters; 0 before the first."""
    event = F.when(enter_long, 1).when(enter_short, -1)
    return F.coalesce(F.last(event, True).over(so_far()), F.lit(0))


def donchian_persistent(n: int) -> Column:
    high, low = channel(n)
    return persistent(c("close") > high, c("close") < low)


def expanding_drift(x: str, t_floor: float, least: int, keys) -> Column:
    """Sign of the mean of all earlier values of the same keys, where its t statistic reaches the floor."""
    w = along(keys).rowsBetween(-(2**31), -1)
    n, mean, sd = F.count(c(x)).over(w), F.avg(c(x)).over(w), F.stddev_samp(c(x)).over(w)
    t = mean / F.nullif(sd / F.sqrt(n), F.lit(0.0))
    return F.when((n >= least) & (F.abs(t) >= t_floor), sign(mean)).otherwise(0)


def fold(df: DataFrame, out: str, step, order=("ts",), keys=("symbol",), start=0) -> DataFrame:
    """`out` by state = step(state, row): the state after each row, int. For rules whose exits depend on what is held; one group for each symbol."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out}` int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, states = pdf.sort_values(list(order)), start, []
        for row in pdf.itertuples(index=False):
            state = step(state, row)
            states.append(state)
        return pdf.assign(**{out: pd.array(states, "Int32")})

    return df.groupBy(*keys).applyInPandas(run, schema)


def channel_rule(bars: DataFrame, entry: int, leave: int, out: str = "position") -> DataFrame:
    """Breakout of the entry channel, left at the shorter channel's other side; no turn within a bar; a null channel keeps the state."""
    high, low = channel(entry)
    exit_high, exit_low = channel(leave)
    code = (c("close") > high).cast("int") + 2 * (c("close") < low).cast("int") + 4 * (c("close") < exit_low).cast("int") + 8 * (c("close") > exit_high).cast("int")
    coded = bars.withColumn("code", F.coalesce(code, F.lit(-1)))

    def step(state: int, row) -> int:
        if row.code < 0:
            return state
        if state == 0:
            return 1 if row.code & 1 else -1 if row.code & 2 else 0
        return 0 if (state > 0 and row.code & 4) or (state < 0 and row.code & 8) else state

    return fold(coded, out, step).drop("code")


def band_rule(bars: DataFrame, n: int, k: float, out: str = "position") -> DataFrame:
    """Fades closes k deviations off the mean of n bars, until the mean is crossed."""
    z = (c("close") - sma("close", n)) / F.nullif(std("close", n), F.lit(0.0))

    def step(state: int, row) -> int:
        z = row.z
        if z is None or z != z:
            return state
        if state == 0:
            return 1 if z <= -k else -1 if z >= k else 0
        return 0 if state * z >= 0 else state

    return fold(bars.withColumn("z", z), out, step).drop("z")


def greedy(df: DataFrame, flag: str, hold: int, out: str = "taken", keys=("symbol",)) -> DataFrame:
    """Of flagged rows, those more than `hold` rows after the last one taken: events never overlap. Row numbers are per symbol, from 0."""
    numbered = df.withColumn("_n", F.row_number().over(along(keys)) - 1)
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in numbered.schema)}, `{out}` boolean"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, last, taken = pdf.sort_values("_n"), -(10**12), []
        for n, flagged in zip(pdf["_n"], pdf[flag], strict=True):
            taken.append(bool(flagged) and n > last + hold)
            last = n if taken[-1] else last
        return pdf.assign(**{out: taken})

    flagged = numbered.where(F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))
    return flagged.groupBy(*keys).applyInPandas(run, schema).where(out).drop("_n", out)


def prior_extreme(x: str, n: int) -> tuple[Column, Column]:
    return gated(F.max(c(x)), c(x), prior(n), n), gated(F.min(c(x)), c(x), prior(n), n)


def regimes(bars: DataFrame, n: int = 20, high_vol: float = 0.8, trend: float = 0.3) -> DataFrame:
    """regime: HIGH_VOL where the volatility's trailing rank is high, else TREND_UP or TREND_DOWN where the efficiency ratio is, else RANGE; UNKNOWN in warm-up."""
    from ..functions.indicators import efficiency_ratio, trailing_percentile

    d = bars.withColumns({"_r": simple_return("close"), "close_step": F.abs(c("close") - back("close"))})
    d = d.withColumn("_vol", gated(F.stddev_samp("_r"), c("_r"), along().rowsBetween(-(n - 1), 0), n))
    d = d.withColumns({"vol_rank": trailing_percentile("_vol", 4 * n, n), "er": efficiency_ratio("close", n), "drift": c("close") - back("close", n)})
    label = F.when(c("vol_rank").isNull() | c("er").isNull(), "UNKNOWN").when(c("vol_rank") >= high_vol, "HIGH_VOL").when(c("er") >= trend, F.when(c("drift") > 0, "TREND_UP").otherwise("TREND_DOWN")).otherwise("RANGE")
    return d.withColumn("regime", label).drop("_r", "_vol", "close_step")


def adaptive_regimes(bars: DataFrame, n: int = 20, back_atr: int = 60) -> DataFrame:
    """label: trend_up or trend_down at an efficiency ratio of 0.3 or more, range at 0.2 or less, else transition; with _high_vol where the mean true range
    exceeds 1.5 times the median of the `back_atr` before; warming_up where a part is unknown."""
    from ..functions.indicators import efficiency_ratio, true_range

    d = bars.withColumns({"close_step": F.abs(c("close") - back("close")), "_tr": true_range()})
    d = d.withColumns({"er": efficiency_ratio("close", n), "drift": c("close") - back("close", n), "_atr": sma("_tr", n)})
    d = d.withColumn("_usual", gated(F.percentile("_atr", 0.5), c("_atr"), prior(back_atr), back_atr))
    base = F.when(c("er") >= 0.3, F.when(c("drift") > 0, "trend_up").otherwise("trend_down")).when(c("er") <= 0.2, "range").otherwise("transition")
    label = F.when(c("er").isNull() | c("_usual").isNull(), "warming_up").otherwise(F.concat(base, F.when(c("_atr") > 1.5 * c("_usual"), "_high_vol").otherwise("")))
    return d.withColumn("label", label).drop("close_step", "_tr", "_atr", "_usual")


def timed_rule(bars: DataFrame, direction: Column, hold: int, out: str = "position") -> DataFrame:
    """bars with the side of the last direction for `hold` bars from its bar on, 0 else; directions are 1, -1, or null or 0 for none."""
    n = F.row_number().over(along())
    d = bars.withColumns({"_n": n, "_side": direction}).withColumn("_event", F.when(c("_side") != 0, F.struct("_n", "_side")))
    last = F.last("_event", True).over(so_far())
    d = d.withColumn("_last", last)
    return d.withColumn(out, F.when(c("_n") - c("_last._n") < hold, c("_last._side")).otherwise(0)).drop("_n", "_side", "_event", "_last")


def hysteresis(bars: DataFrame, x: str, band: float, long_only: bool = False, out: str = "position") -> DataFrame:
    """1 once x is above the band, -1 (0 if long_only) once it is below the negative band, else what was held; 0 before the first. A carried value, no fold."""
    event = F.when(c(x) > band, 1).when(c(x) < -band, 0 if long_only else -1)
    return bars.withColumn("_event", event).withColumn(out, F.coalesce(F.last("_event", True).over(so_far()), F.lit(0))).drop("_event")


def sampled(bars: DataFrame, x: str, every: int, out: str = "position") -> DataFrame:
    """x as of the last bar 0, every, 2 * every, ... before this one, held one bar later; null is 0."""
    d = bars.withColumn("_n", F.row_number().over(along()) - 1)
    d = d.withColumn("_kept", F.max_by(F.struct(c(x).alias("v")), F.when(c("_n") % every == 0, c("_n"))).over(so_far()))
    return d.withColumn(out, F.coalesce(F.lag(c("_kept.v")).over(along()), F.lit(0))).drop("_n", "_kept")


def short_rsi_rule(bars: DataFrame, x: str, low: float, trend: int, leave: int, most: int, out: str = "position") -> DataFrame:
    """Long from flat when x is under `low` over the long mean, short when it is over 100 - low under it; left when the close crosses the mean of `leave` bars, or after `most` bars."""
    slow, fast = sma("close", trend), sma("close", leave)
    code = F.when((c(x) < low) & (c("close") > slow), 1).when((c(x) > 100 - low) & (c("close") < slow), 2).otherwise(0) + F.when(c("close") > fast, 4).when(c("close") < fast, 8).otherwise(0)
    coded = bars.withColumn("code", F.coalesce(code, F.lit(0)))

    def step(state: int, row) -> int:
        # the state counts bars held, with the side as its sign
        if state == 0:
            return 1 if row.code & 1 else -1 if row.code & 2 else 0
        done = abs(state) >= most or row.code & (4 if state > 0 else 8)
        return 0 if done else state + (1 if state > 0 else -1)

    return fold(coded, out, step).drop("code").withColumn(out, sign(c(out)))
