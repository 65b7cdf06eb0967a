"""Rolling indicators as columns over a frame (symbol, ts, open, high, low, close). Null until their window is full, unless said."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import along, gated, prior, trailing


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def back(x: Column | str, n: int = 1) -> Column:
    return F.lag(c(x), n).over(along())


def ratio(x: Column | str, y: Column | str) -> Column:
    """x / y of doubles by IEEE rules: over 0 an infinity with the sign of x, or NaN for 0 / 0. Null where either is null."""
    x, y = c(x).cast("double"), c(y).cast("double")
    return F.when(y == 0, x * F.lit(math.inf)).otherwise(x / F.nullif(y, F.lit(0.0)))


def log_ratio(x: Column | str, y: Column | str) -> Column:
    """ln(x / y) by IEEE rules: an infinity where one of them is 0, NaN where both are or where signs differ."""
    r = ratio(x, y)
    return F.when(r == 0, F.lit(-math.inf)).when(r < 0, F.lit(math.nan)).otherwise(F.log(r))


def simple_return(x: Column | str = "close", n: int = 1) -> Column:
    return c(x) / F.nullif(back(x, n), F.lit(0.0)) - 1


def log_return(x: Column | str = "close") -> Column:
    return F.when((c(x) > 0) & (back(x) > 0), F.log(c(x) / back(x)))


def sma(x: Column | str, n: int) -> Column:
    return gated(F.avg(c(x)), c(x), trailing(n), n)


def std(x: Column | str, n: int) -> Column:
    return gated(F.stddev_samp(c(x)), c(x), trailing(n), n)


def true_range() -> Column:
    """greatest() leaves nulls out, so the first bar's is high - low."""
    return F.greatest(c("high") - c("low"), F.abs(c("high") - back("close")), F.abs(c("low") - back("close")))


def rolling_z(x: Column | str, n: int) -> Column:
    return (c(x) - sma(x, n)) / F.nullif(std(x, n), F.lit(0.0))


def rolling_quantile(x: Column | str, q: float, n: int, least: int | None = None) -> Column:
    return gated(F.percentile(c(x), q), c(x), trailing(n), least or n)


def prior_quantile(x: Column | str, q: float, n: int) -> Column:
    return gated(F.percentile(c(x), q), c(x), prior(n), n)


def channel(n: int) -> tuple[Column, Column]:
    """(highest high, lowest low) of the n bars before."""
    return gated(F.max("high"), c("high"), prior(n), n), gated(F.min("low"), c("low"), prior(n), n)


def efficiency_ratio(x: str, n: int) -> Column:
    """|x - x n bars back| over the path's length, from a column <x>_step = |x - x one bar back|."""
    return F.least(F.lit(1.0), F.abs(c(x) - back(x, n)) / F.nullif(gated(F.sum(c(f"{x}_step")), c(f"{x}_step"), trailing(n), n), F.lit(0.0)))


def trailing_percentile(x: str, n: int, least: int) -> Column:
    """Mid-rank of the current value among the last n known ones, as a share."""
    values = F.collect_list(c(x)).over(trailing(n))
    rank = F.size(F.filter(values, lambda v: v < c(x))) + 0.5 * F.size(F.filter(values, lambda v: v == c(x)))
    return F.when((F.size(values) >= least) & c(x).isNotNull(), rank / F.size(values))


def rolling_ols_z(y: str, x: str, n: int) -> Column:
    """Residual of y on x over the window, by its standard error with n - 2 degrees of freedom; null where degenerate."""
    w = trailing(n)
    both = F.when(c(x).isNotNull() & c(y).isNotNull(), c(y))
    slope, intercept = F.regr_slope(c(y), c(x)).over(w), F.regr_intercept(c(y), c(x)).over(w)
    ssr = F.regr_syy(c(y), c(x)).over(w) - slope * F.regr_sxy(c(y), c(x)).over(w)
    z = (c(y) - intercept - slope * c(x)) / F.sqrt(F.nullif(F.greatest(ssr, F.lit(0.0)) / (n - 2), F.lit(0.0)))
    return F.when(F.count(both).over(w) == n, z)


def realized_vol(x: str, n: int, bars_per_year: float, least: int | None = None) -> Column:
    """Annualised deviation of a column of returns."""
    return gated(F.stddev_samp(c(x)), c(x), trailing(n), least or n) * math.sqrt(bars_per_year)


def run_length(island: str = "island", keys=("symbol",)) -> Column:
    """Place of the row in its island."""
    return F.row_number().over(along((*keys, island)))


def exponential(df: DataFrame, x: str, alpha: float, out: str, least: int = 1, keys=("symbol",)) -> DataFrame:
    """Exponentially weighted mean e = alpha x + (1 - alpha) e, from the first known x on, null until `least` values. Keys (a gap group among them, to reset
    at gaps) are folded group by group: a value depends on all before it, which no window frame expresses in linear time."""
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in df.schema)}, `{out}` double"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts")
        e = pdf[x].ewm(alpha=alpha, adjust=False, ignore_na=True).mean()
        return pdf.assign(**{out: e.where(pdf[x].notna().cumsum() >= least)})

    return df.groupBy(*keys).applyInPandas(fold, schema)


def ema(df: DataFrame, x: str, n: int, out: str, keys=("symbol",)) -> DataFrame:
    return exponential(df, x, 2 / (n + 1), out, n, keys)


def wilder(df: DataFrame, x: str, n: int, out: str, keys=("symbol",)) -> DataFrame:
    return exponential(df, x, 1 / n, out, n, keys)


def rsi(df: DataFrame, n: int, out: str, zero_loss: float | None = None) -> DataFrame:
    """Wilder's RSI of close; where nothing was lost it is zero_loss (null, 50 or 100 by convention)."""
    move = c("close") - back("close")
    d = df.withColumns({"_up": F.greatest(move, F.lit(0.0)), "_down": F.greatest(-move, F.lit(0.0))})
    d = d.withColumns({"_up": F.when(move.isNotNull(), F.col("_up")), "_down": F.when(move.isNotNull(), F.col("_down"))})
    d = wilder(wilder(d, "_up", n, "_gain"), "_down", n, "_loss")
    value = F.when(F.col("_loss") == 0, F.lit(zero_loss).cast("double")).otherwise(100 - 100 / (1 + F.col("_gain") / F.col("_loss")))
    return d.withColumn(out, value).drop("_up", "_down", "_gain", "_loss")
