"""Choosing among variants of a rule without looking ahead: nets of all in one pass, walk-forward choice, and the chance of overfitting."""

from __future__ import annotations

from itertools import combinations
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import along, so_far
from .inference import block_bootstrap

#: Lengths of a record that are tried, the longest standing for any beyond, and what stands for a rule that earns nothing.
LENGTHS, ENDLESS = (50, 100, 200, 500, 1000, 2000, 5000), 999_999
#: Names of the three stretches of regime_records() in their order.
REGIMES = ("trend", "range", "high_vol")


def variant_nets(bars: DataFrame, positions: dict[str, Column], cost_bps: float) -> DataFrame:
    """(symbol, variant, ts, row, rows, net): returns after costs of each position column, held one bar later. Every window is over a symbol's bars: variants add columns, not shuffles."""
    w = along()
    d = bars.withColumns({f"_p{i}": p for i, p in enumerate(positions.values())} | {"_r": F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1, "_row": F.row_number().over(w) - 2, "_rows": F.count(F.lit(1)).over(Window.partitionBy("symbol")) - 1})
    held = lambda i, k: F.coalesce(F.lag(f"_p{i}", k).over(w), F.lit(0)).cast("double")
    nets = F.array(*[F.struct(F.lit(name).alias("variant"), (held(i, 1) * F.col("_r") - F.abs(held(i, 1) - held(i, 2)) * cost_bps / 1e4).alias("net")) for i, name in enumerate(positions)])
    d = d.withColumn("_nets", nets).where("_row >= 0")
    return d.select("symbol", "ts", F.col("_row").alias("row"), F.col("_rows").alias("rows"), F.explode("_nets").alias("n")).select("symbol", "n.variant", "ts", "row", "rows", "n.net")


def _sharpe(n: Column, s: Column, ss: Column) -> Column:
    """Mean over deviation from a count and sums; 0 where it is not defined."""
    variance = (ss - s * s / F.nullif(n, F.lit(0))) / F.nullif(n - 1, F.lit(0))
    return F.coalesce(s / F.nullif(n, F.lit(0)) / F.nullif(F.sqrt(F.greatest(variance, F.lit(0.0))), F.lit(0.0)), F.lit(0.0))


def walk_forward(nets: DataFrame, folds: int, test_share: float = 0.5, embargo: int = 0) -> DataFrame:
    """(symbol, fold, variant, train_sharpe, test_n, test_net): of each fold, the variant with the best Sharpe ratio of a bar in all rows up to `embargo` before
    the test rows (ties: the first by name), and what it earns in them. Test rows tile the last test_share of a symbol's rows.

    Sums of a symbol, variant and stretch between fold borders are all that is joined to the folds."""
    test = F.floor(F.col("rows") * test_share / folds).cast("long")
    start = [F.col("rows") - (folds - k) * test for k in range(folds)]
    net, row = F.col("net"), F.col("row")
    sums = []
    for k in range(folds):
        train, held_out = row < start[k] - embargo, (row >= start[k]) & (row < start[k] + test)
        sums.append(F.struct(F.lit(k).alias("fold"), F.count(F.when(train, net)).alias("n"), F.sum(F.when(train, net)).alias("s"), F.sum(F.when(train, net * net)).alias("ss"), F.count(F.when(held_out, net)).alias("test_n"), F.sum(F.when(held_out, net)).alias("test_net")))
    g = nets.groupBy("symbol", "variant").agg(*[x.alias(f"f{k}") for k, x in enumerate(sums)])
    g = g.select("symbol", "variant", F.explode(F.array(*[f"f{k}" for k in range(folds)])).alias("f")).select("symbol", "variant", "f.*")
    g = g.withColumn("train_sharpe", _sharpe(F.col("n"), F.col("s"), F.col("ss")))
    best = Window.partitionBy("symbol", "fold").orderBy(F.round("train_sharpe", 9).desc(), "variant")
    return g.withColumn("_k", F.row_number().over(best)).where("_k = 1").select("symbol", "fold", "variant", "train_sharpe", "test_n", "test_net")


def overfitting(nets: DataFrame, groups: int = 6, chosen: int = 2) -> DataFrame:
    """(symbol, folds, pbo): the share of folds in which the variant best outside the chosen blocks of rows is below the median inside them.

    Blocks are equal, the last takes what is left. Only a sum for each symbol, variant and block meets the folds."""
    size = F.greatest(F.lit(1), F.floor(F.col("rows") / groups))
    block = F.least(F.floor(F.col("row") / size), F.lit(groups - 1)).cast("int")
    sums = nets.where("net IS NOT NULL").groupBy("symbol", "variant", block.alias("block")).agg(F.count("net").alias("n"), F.sum("net").alias("s"), F.sum(F.col("net") * F.col("net")).alias("ss"))
    folds = F.array(*[F.struct(F.lit(i).alias("fold"), F.array(*[F.lit(g) for g in test]).alias("test")) for i, test in enumerate(combinations(range(groups), chosen))])
    d = sums.withColumn("f", F.explode(folds)).withColumn("inside", F.array_contains("f.test", F.col("block")))
    part = lambda inside: [F.sum(F.when(F.col("inside") == inside, F.col(x))) for x in ("n", "s", "ss")]
    g = d.groupBy("symbol", F.col("f.fold").alias("fold"), "variant").agg(_sharpe(*part(False)).alias("known"), _sharpe(*part(True)).alias("tested"))
    best = F.max_by("tested", F.struct(F.round("known", 9), "variant"))
    g = g.groupBy("symbol", "fold").agg((F.round(best, 9) < F.round(F.percentile("tested", 0.5), 9)).cast("double").alias("below"))
    return g.groupBy("symbol").agg(F.count(F.lit(1)).alias("folds"), F.avg("below").alias("pbo"))


def reality_check(nets: DataFrame, draws: int, block: int, seed: int = 0) -> DataFrame:
    """(symbol, best, draws, p): the highest mean net of a symbol's variants, and how often the best of centred means in circular block draws reaches it.

    Every variant of a symbol has the same rows, so the hashed block starts draw the same rows for each."""
    resampled = block_bootstrap(nets, "net", draws, block, seed, ("symbol", "variant"))
    means = nets.groupBy("symbol", "variant").agg(F.avg("net").alias("observed"))
    best = means.groupBy("symbol").agg(F.max("observed").alias("best"))
    d = resampled.join(means, ["symbol", "variant"]).groupBy("symbol", "draw").agg(F.max(F.col("mean") - F.col("observed")).alias("top"))
    return d.join(best, "symbol").groupBy("symbol", "best").agg(F.count(F.lit(1)).alias("draws"), F.avg((F.round("top", 12) >= F.round("best", 12)).cast("double")).alias("p"))


def efficiency(train: Column, test: Column) -> Column:
    """The tested Sharpe ratio as a share of the known one; with a known one of 0, 0 or without bound, as the tested one is up to 0 or above."""
    return F.when(train == 0, F.when(test <= 0, 0.0).otherwise(float("inf"))).otherwise(test / F.nullif(train, F.lit(0.0)))


def shortest_record(sharpe: Column, skew: Column, kurt: Column, target: float = 0.95) -> Column:
    """The first of LENGTHS at which a Sharpe ratio of a bar would be above 0 with probability `target`; the last of them if none is, ENDLESS if it isn't above 0. kurt is 3 for a normal."""
    scale = F.sqrt(F.greatest(F.lit(1e-12), 1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe))
    z = NormalDist().inv_cdf(target)
    enough = [F.when(sharpe * (n - 1) ** 0.5 / scale >= z, n) for n in LENGTHS]
    return F.when(sharpe <= 0, ENDLESS).otherwise(F.coalesce(*enough, F.lit(LENGTHS[-1])))


def split_records(nets: DataFrame, target: float = 0.95) -> DataFrame:
    """(symbol, variant, train_n, test_n, train_sharpe, test_sharpe, efficiency, shortest): every variant's first half of rows against its second, from sums of one pass,
    and the record that its first half's ratio needs. Undefined ratios count as 0; a variant without known nets in its first half has no row."""
    known = F.col("row") < F.floor(F.col("rows") / 2)
    train, test = F.when(known, F.col("net")), F.when(~known, F.col("net"))
    ratio = lambda x: F.coalesce(F.avg(x) / F.nullif(F.stddev_samp(x), F.lit(0.0)), F.lit(0.0))
    shape = lambda x, default: F.coalesce(F.nanvl(x, F.lit(None).cast("double")), F.lit(default))
    t = nets.groupBy("symbol", "variant").agg(F.count(train).alias("train_n"), F.count(test).alias("test_n"), ratio(train).alias("train_sharpe"), ratio(test).alias("test_sharpe"), shape(F.skewness(train), 0.0).alias("_skew"), shape(F.kurtosis(train) + 3, 3.0).alias("_kurt"))
    t = t.where("train_n > 0").withColumn("efficiency", efficiency(F.col("train_sharpe"), F.col("test_sharpe")))
    return t.withColumn("shortest", shortest_record(F.col("train_sharpe"), F.col("_skew"), F.col("_kurt"), target)).drop("_skew", "_kurt")


def regime_records(run: DataFrame, bars_per_year: float) -> DataFrame:
    """(symbol, regime, bars, sharpe, profit_factor, max_drawdown, passed) of three stretches of as many bars (REGIMES), the last taking what is left; a stretch of one bar has no row.

    Returns are those of the compounded equity inside a stretch, the ratio takes the deviation of all of them, and the deepest fall is a share of the stretch's highest equity.
    profit_factor is without bound if nothing was lost, and 0 if nothing was earned either. passed: the ratio is above -0.5, and it isn't so that just one stretch has more than 0.5."""
    from ..operators.backtest import compound

    e = run.where("net IS NOT NULL").select("symbol", "ts", "net")
    whole = Window.partitionBy("symbol")
    e = e.withColumns({"equity": compound("net", so_far()), "_i": F.row_number().over(along()) - 1, "_n": F.count(F.lit(1)).over(whole)})
    e = e.withColumn("regime", F.when(F.col("_i") < F.floor(F.col("_n") / 3), REGIMES[0]).when(F.col("_i") < F.floor(2 * F.col("_n") / 3), REGIMES[1]).otherwise(REGIMES[2]))
    keys = ("symbol", "regime")
    e = e.withColumns({"_r": F.col("equity") / F.nullif(F.lag("equity").over(along(keys)), F.lit(0.0)) - 1, "_top": F.max("equity").over(so_far(keys))})
    wins, losses = F.sum(F.greatest("_r", F.lit(0.0))), -F.sum(F.least("_r", F.lit(0.0)))
    # Spark's greatest and least skip nulls: the first bar of a stretch counts as 0 in both sums.
    t = e.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bars"),
        (F.coalesce(F.avg("_r") / F.nullif(F.stddev_pop("_r"), F.lit(0.0)), F.lit(0.0)) * bars_per_year**0.5).alias("sharpe"),
        F.when(losses > 0, wins / F.nullif(losses, F.lit(0.0))).when(wins > 0, float("inf")).otherwise(0.0).alias("profit_factor"),
        (F.max(F.col("_top") - F.col("equity")) / F.nullif(F.max("_top"), F.lit(0.0))).alias("max_drawdown"),
    )
    earning = F.count_if(F.col("sharpe") > 0.5).over(whole)
    return t.where("bars > 1").withColumn("passed", (F.col("sharpe") > -0.5) & (earning != 1))
