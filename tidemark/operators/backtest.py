"""Costed P&L of positions on bars, its metrics, and attributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import along, islands, so_far
from ..functions.indicators import back, c, simple_return


def per_side_bps(price, spread: float, commission: float, slippage: float):
    """Half the spread, commission per 100 ounces, and slippage, in bps of the price."""
    return (F.lit(spread) / 2 + F.lit(commission) / 100 + F.lit(slippage)) / price * 1e4


def compound(net: str, over=None):
    """Product of 1 + net, by logs of sizes and the parity of signs: a loss beyond the capital turns it negative, as multiplying would."""
    f = 1 + c(net)
    parts = [F.count_if(f == 0), F.sum(F.log(F.abs(F.nullif(f, F.lit(0.0))))), F.count_if(f < 0)]
    zeros, logs, minus = parts if over is None else [p.over(over) for p in parts]
    return F.when(zeros > 0, 0.0).otherwise(F.exp(logs) * F.when(minus % 2 == 1, -1.0).otherwise(1.0))


def run_vector(bars: DataFrame, position: str, cost_bps: float, lag: int = 1) -> DataFrame:
    """bars with r, held, gross, cost and net: the position decided `lag` bars ago earns this bar's return, and pays cost_bps for each unit traded."""
    d = bars.withColumns({"r": simple_return("close"), "held": F.coalesce(back(position, lag), F.lit(0)).cast("double")})
    d = d.withColumn("traded", F.abs(c("held") - F.coalesce(back("held"), F.lit(0.0))))
    return d.withColumns({"gross": c("held") * c("r"), "cost": c("traded") * cost_bps / 1e4}).withColumn("net", c("gross") - c("cost"))


def metrics(run: DataFrame, bars_per_year: float, keys=("symbol",)) -> DataFrame:
    """Of each key: bars, total return, Sharpe and Sortino ratio, deepest drawdown, profit factor, win rate, exposure, turnover and trades."""
    d = islands(run.where(c("net").isNotNull()), "held", keys=keys)
    d = d.withColumn("equity", compound("net", so_far(keys)))
    d = d.withColumn("drawdown", 1 - c("equity") / F.greatest(F.lit(1.0), F.max("equity").over(so_far(keys))))
    win, loss = F.sum(F.greatest("net", F.lit(0.0))), -F.sum(F.least("net", F.lit(0.0)))
    down = F.stddev_samp(F.when(c("net") < 0, c("net")))
    year = F.sqrt(F.lit(float(bars_per_year)))
    return d.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_bars"),
        (compound("net") - 1).alias("total_return"),
        F.coalesce(F.avg("net") / F.nullif(F.stddev_samp("net"), F.lit(0.0)) * year, F.lit(0.0)).alias("sharpe"),
        F.coalesce(F.avg("net") / F.nullif(down, F.lit(0.0)) * year, F.lit(0.0)).alias("sortino"),
        F.max("drawdown").alias("max_drawdown"),
        (win / F.nullif(loss, F.lit(0.0))).alias("profit_factor"),
        F.avg((c("net") > 0).cast("double")).alias("win_rate"),
        F.avg((c("held") != 0).cast("double")).alias("exposure"),
        F.sum("traded").alias("turnover"),
        F.count_distinct(F.when(c("held") != 0, c("island"))).alias("trades"),
    )


def by_period(run: DataFrame, period: str = "month") -> DataFrame:
    """Compounded return and bars of each calendar period."""
    return run.where(c("net").isNotNull()).groupBy("symbol", F.date_trunc(period, "ts").cast("date").alias("period")).agg(F.count(F.lit(1)).alias("n_bars"), (compound("net") - 1).alias("total_return"))


def by_side(run: DataFrame) -> DataFrame:
    """Net and bars of long, short and flat."""
    side = F.when(c("held") > 0, "long").when(c("held") < 0, "short").otherwise("flat")
    return run.where(c("net").isNotNull()).groupBy("symbol", side.alias("side")).agg(F.count(F.lit(1)).alias("n_bars"), F.sum("net").alias("net"), F.sum("cost").alias("cost"))


def alpha(run: DataFrame, bars_per_year: float, benchmark: str = "r") -> DataFrame:
    """Least squares of net on the benchmark: alpha, beta, and the t of alpha, where 30 bars or more are known."""
    d = run.where(c("net").isNotNull() & c(benchmark).isNotNull())
    a = d.groupBy("symbol").agg(F.regr_slope("net", benchmark).alias("beta"), F.regr_intercept("net", benchmark).alias("a"), F.count(F.lit(1)).alias("n"), F.regr_syy("net", benchmark).alias("syy"), F.regr_sxy("net", benchmark).alias("sxy")).where("n >= 30")
    residual = F.sqrt(F.greatest(c("syy") - c("beta") * c("sxy"), F.lit(0.0)) / (c("n") - 1))
    return a.select("symbol", "n", "beta", (c("a") * bars_per_year).alias("alpha"), (c("a") / F.nullif(residual / F.sqrt("n"), F.lit(0.0))).alias("alpha_t"))


def newey_west(run: DataFrame, x: str = "net", lags: int = 5) -> DataFrame:
    """Mean of x and its t with Bartlett weights over `lags` lagged products."""
    w = along()
    mean = F.avg(x).over(Window.partitionBy("symbol"))
    d = run.where(c(x).isNotNull()).withColumn("u", c(x) - mean)
    d = d.withColumns({f"u{k}": c("u") * F.lag("u", k).over(w) for k in range(1, lags + 1)}).withColumn("u0", c("u") * c("u"))
    s = F.sum("u0")
    for k in range(1, lags + 1):
        s = s + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(f"u{k}"), F.lit(0.0))
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), s.alias("s")).select("symbol", "n", "mean", (c("mean") / F.nullif(F.sqrt(F.greatest("s", F.lit(0.0))) / c("n"), F.lit(0.0))).alias("t"))


def stress(bars: DataFrame, position: str, cost_bps: float, multiples: list[float], bars_per_year: float) -> DataFrame:
    """metrics() at each multiple of the cost, in one job; a row's multiple is its cost_multiple."""
    many = bars.withColumn("cost_multiple", F.explode(F.array(*[F.lit(float(m)) for m in multiples])))
    w = Window.partitionBy("symbol", "cost_multiple").orderBy("ts")
    d = many.withColumns({"r": c("close") / F.lag("close").over(w) - 1, "held": F.coalesce(F.lag(position).over(w), F.lit(0)).cast("double")})
    d = d.withColumn("traded", F.abs(c("held") - F.coalesce(F.lag("held").over(w), F.lit(0.0))))
    d = d.withColumn("net", c("held") * c("r") - c("traded") * c("cost_multiple") * cost_bps / 1e4)
    return metrics(d, bars_per_year, ("symbol", "cost_multiple"))


def by_label(run: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(symbol, label, n_bars, net) of a run's bars by the label of the bar before, which was known when they began."""
    known = labels.select("symbol", "ts", F.lag(label).over(along()).alias(label))
    return run.where(c("net").isNotNull()).join(known, ["symbol", "ts"]).groupBy("symbol", label).agg(F.count(F.lit(1)).alias("n_bars"), F.sum("net").alias("net"))


def expectancy(trades: DataFrame, pnl: str, keys=("symbol",)) -> DataFrame:
    """Of each key's trades: n, mean, mean win, mean loss, and the 5th percentile."""
    x = c(pnl)
    return trades.where(x.isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.avg(F.when(x > 0, x)).alias("mean_win"), F.avg(F.when(x < 0, x)).alias("mean_loss"), F.percentile(x, 0.05).alias("worst_5"))


def hac_alpha(run: DataFrame, bars_per_year: float, benchmark: str = "r", lags: int = 5) -> DataFrame:
    """(symbol, n, alpha, beta, t) of net on the benchmark, t from Bartlett-weighted lagged products of residuals; 18 bars at least."""
    w, whole = along(), Window.partitionBy("symbol")
    d = run.where(c("net").isNotNull() & c(benchmark).isNotNull()).withColumn("b", c(benchmark))
    d = d.withColumns({"beta": F.regr_slope("net", "b").over(whole), "a": F.regr_intercept("net", "b").over(whole)}).withColumn("u", c("net") - c("a") - c("beta") * c("b"))
    sums = {"s00": F.sum(c("u") * c("u")), "s01": F.sum(c("u") * c("u") * c("b")), "s11": F.sum(c("u") * c("u") * c("b") * c("b"))}
    for k in range(1, lags + 1):
        d = d.withColumns({f"u{k}": F.lag("u", k).over(w), f"b{k}": F.lag("b", k).over(w)})
        q, uu = 1 - k / (lags + 1), c("u") * c(f"u{k}")
        for name, x in (("s00", 2 * uu), ("s01", uu * (c("b") + c(f"b{k}"))), ("s11", 2 * uu * c("b") * c(f"b{k}"))):
            sums[name] = sums[name] + q * F.coalesce(F.sum(x), F.lit(0.0))
    g = d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("sb"), F.sum(c("b") * c("b")).alias("sbb"), F.max("a").alias("a"), F.max("beta").alias("beta"), *[v.alias(k) for k, v in sums.items()])
    det = c("n") * c("sbb") - c("sb") * c("sb")
    p, q = c("sbb") / F.nullif(det, F.lit(0.0)), -c("sb") / F.nullif(det, F.lit(0.0))
    variance = p * p * c("s00") + 2 * p * q * c("s01") + q * q * c("s11")
    return g.where(c("n") >= 18).select("symbol", "n", (c("a") * bars_per_year).alias("alpha"), "beta", (c("a") / F.nullif(F.sqrt(F.greatest(variance, F.lit(0.0))), F.lit(0.0))).alias("t"))


def chronological(rows: DataFrame, shares: tuple[float, float] = (0.6, 0.2), keys=("symbol",)) -> DataFrame:
    """rows with part: discovery, validation or locked by place in time, cut at whole rows below each share."""
    n, i = F.count(F.lit(1)).over(Window.partitionBy(*keys)), F.row_number().over(along(keys)) - 1
    first, second = F.floor(n * shares[0]), F.floor(n * (shares[0] + shares[1]))
    return rows.withColumn("part", F.when(i < first, "discovery").when(i < second, "validation").otherwise("locked"))


def growth(metrics: DataFrame, bars_per_year: float) -> DataFrame:
    """(symbol, cagr, calmar) from metrics(): yearly growth, null where all was lost, and its ratio to the deepest drawdown."""
    total = 1 + c("total_return")
    cagr = F.when(total > 0, F.pow(total, bars_per_year / c("n_bars")) - 1)
    return metrics.select("symbol", cagr.alias("cagr"), (cagr / F.nullif(c("max_drawdown"), F.lit(0.0))).alias("calmar"))
