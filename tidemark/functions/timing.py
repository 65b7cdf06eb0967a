"""Whether a rule holds once its inputs can be known: lags that hours of the day require, and the rule's alpha at each lag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frames import along
from .indicators import c

# Hours (UTC) at which daily prices are struck and drivers are known.
PRICE_HOURS = {"lbma_am_fix": 10.5, "m15_utc_close": 24.0}
DRIVER_HOURS = {"dxy_close": 22.0, "y10_close": 22.0, "fred_observation_date": 24.0, "miners_equity_close": 21.0}


def required_lag(price_hour: float, *driver_hours: float) -> int:
    """Bars that a decision must wait: 0 if the price is struck after every driver is known, else 1, the smallest delay of daily bars."""
    return int(any(price_hour <= h for h in driver_hours))


def lag_sweep(bars: DataFrame, position: str, lags: tuple[int, ...] = (0, 1, 2, 3), cost_bps: float = 0.0, bars_per_year: float = 252.0) -> DataFrame:
    """(symbol, lag, n, beta, alpha_ann, alpha_t): least squares of the net on the bars' returns when the position is held lag + 1 bars after the bar that decides it.

    All lags are columns of one pass over the bars and one aggregation. alpha_t is null where the line fits exactly or nothing varies.
    """
    if min(lags) < 0:
        raise ValueError("a negative lag looks ahead")
    w = along()
    d = bars.withColumns({"_r": c("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1} | {f"_h{k}": F.coalesce(F.lag(position, k).over(w), F.lit(0)).cast("double") for k in sorted({k + i for k in lags for i in (1, 2)})})
    d = d.where("_r IS NOT NULL")
    fits = []
    for k in lags:
        net = c(f"_h{k + 1}") * c("_r") - F.abs(c(f"_h{k + 1}") - c(f"_h{k + 2}")) * cost_bps / 1e4
        fits.append(F.struct(F.lit(k).alias("lag"), F.count(F.lit(1)).alias("n"), F.avg("_r").alias("mx"), F.avg(net).alias("my"), F.regr_sxx(net, "_r").alias("sxx"), F.regr_sxy(net, "_r").alias("sxy"), F.regr_syy(net, "_r").alias("syy")))
    g = d.groupBy("symbol").agg(*[f.alias(f"f{i}") for i, f in enumerate(fits)])
    g = g.select("symbol", F.explode(F.array(*[f"f{i}" for i in range(len(fits))])).alias("f")).select("symbol", "f.*")
    g = g.withColumn("beta", c("sxy") / F.nullif("sxx", F.lit(0.0))).withColumn("a", c("my") - c("beta") * c("mx"))
    left = c("syy") - c("beta") * c("sxy")
    error = F.sqrt(left / F.nullif(c("n") - 2, F.lit(0)) * (1 / c("n") + c("mx") * c("mx") / F.nullif("sxx", F.lit(0.0))))
    return g.select("symbol", "lag", "n", "beta", (c("a") * bars_per_year).alias("alpha_ann"), F.when(left > 1e-12 * c("syy"), c("a") / F.nullif(error, F.lit(0.0))).alias("alpha_t"))


def survives(sweep: DataFrame, required: int, threshold: float) -> DataFrame:
    """(symbol, required_lag, alpha_ann, alpha_t, lag0_alpha_ann, lag0_alpha_t, decay, survives) at the lag that the data permit; a symbol without that lag or without lag 0 is an error."""
    at = lambda x, k: F.max(F.when(c("lag") == k, c(x)))
    g = sweep.groupBy("symbol").agg(F.count_if(c("lag").isin(0, required)).alias("known"), *[at(x, k).alias(n) for n, x, k in (("alpha_ann", "alpha_ann", required), ("alpha_t", "alpha_t", required), ("lag0_alpha_ann", "alpha_ann", 0), ("lag0_alpha_t", "alpha_t", 0))])
    known = F.assert_true(c("known") == (2 if required else 1), F.lit(f"lag 0 or {required} is missing"))
    ok = F.coalesce((c("alpha_ann") > 0) & (c("alpha_t") >= threshold), F.lit(False))
    g = g.withColumn("missing", known).where("missing IS NULL")
    return g.select("symbol", F.lit(required).alias("required_lag"), "alpha_ann", "alpha_t", "lag0_alpha_ann", "lag0_alpha_t", (c("lag0_alpha_t") - c("alpha_t")).alias("decay"), ok.alias("survives"))


def alignment(drivers: DataFrame, prices: DataFrame, on: str, columns: list[str]) -> DataFrame:
    """One row (driver_rows, price_rows, overlapping, constant, usable): rows of both sides, stamps of drivers that prices hold, and columns with at most one value. No driver rows are an error."""
    counted = drivers.agg(F.count(F.lit(1)).alias("driver_rows"), *[F.min(x).eqNullSafe(F.max(x)).alias(f"_{i}") for i, x in enumerate(columns)])
    both = drivers.select(on).distinct().join(prices.select(on).distinct(), on).agg(F.count(F.lit(1)).alias("overlapping"))
    all3 = counted.join(F.broadcast(prices.agg(F.count(F.lit(1)).alias("price_rows"))), F.lit(True)).join(F.broadcast(both), F.lit(True))
    constant = F.filter(F.array(*[F.when(c(f"_{i}"), F.lit(x)) for i, x in enumerate(columns)]), lambda x: x.isNotNull())
    all3 = all3.withColumn("_none", F.assert_true(c("driver_rows") > 0, F.lit("no driver rows"))).where("_none IS NULL").withColumn("constant", constant)
    return all3.select("driver_rows", "price_rows", "overlapping", F.array_join("constant", ",").alias("constant"), ((c("overlapping") > 0) & (F.size("constant") == 0)).alias("usable"))
