"""Statistics of results: multiple testing, Sharpe inference, resampling by index tables, folds, Markov and logistic fits."""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EULER = 0.5772156649
NORMAL = NormalDist()


def holm(tests: DataFrame, p: str = "p", family: str | list[str] | None = None) -> DataFrame:
    """tests with p_holm: step-down adjusted, in families if a column or several are named. One row for each test, so families are small."""
    by = Window.partitionBy(family) if family else Window.partitionBy(F.lit(1))
    ordered = by.orderBy(p)
    raw = (F.count(F.lit(1)).over(by) - F.row_number().over(ordered) + 1) * F.col(p)
    t = tests.withColumn("_raw", raw)
    return t.withColumn("p_holm", F.least(F.lit(1.0), F.max("_raw").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))).drop("_raw")


def moments(returns: DataFrame, x: str = "net", keys=("symbol",)) -> DataFrame:
    """(n, mean, sd, skew, kurt) of each key, kurt of a normal being 3."""
    return returns.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.skewness(x).alias("skew"), (F.kurtosis(x) + 3).alias("kurt"))


def probabilistic_sharpe(sr: float, n: int, skew: float, kurt: float, benchmark: float = 0.0) -> float:
    """Probability that the Sharpe ratio of a period exceeds the benchmark."""
    scale = math.sqrt(max(1e-12, 1 - skew * sr + (kurt - 1) / 4 * sr * sr))
    return NORMAL.cdf((sr - benchmark) * math.sqrt(n - 1) / scale)


def expected_max_sharpe(trials: int, sd: float) -> float:
    """Expected best of `trials` Sharpe ratios of no skill with deviation sd."""
    return 0.0 if trials < 2 else sd * ((1 - EULER) * NORMAL.inv_cdf(1 - 1 / trials) + EULER * NORMAL.inv_cdf(1 - 1 / (trials * math.e)))


def deflated_sharpe(sr: float, trials: int, n: int, skew: float, kurt: float) -> float:
    return probabilistic_sharpe(sr, n, skew, kurt, expected_max_sharpe(trials, 1 / math.sqrt(n - 1)))


def normal_two_sided(z: float) -> float:
    return 2 * (1 - NORMAL.cdf(abs(z)))


def binomial_two_sided(k: int, n: int, p: float) -> float:
    """Exact two-sided p: all outcomes no likelier than k."""
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p) for i in range(n + 1)]
    return min(1.0, math.fsum(math.exp(x) for x in logs if x <= logs[k] + 1e-9))


def two_proportions(k1: str, n1: str, k2: str, n2: str, level: float = 0.95) -> tuple[Column, Column, Column]:
    """(difference of two shares, low, high): normal interval of independent counts, to which redrawn binomials tend; all 0 where either has no trials."""
    a, b, n, m = F.col(k1) / F.nullif(n1, F.lit(0)), F.col(k2) / F.nullif(n2, F.lit(0)), F.col(n1), F.col(n2)
    half = NORMAL.inv_cdf((1 + level) / 2) * F.sqrt(a * (1 - a) / n + b * (1 - b) / m)
    return tuple(F.coalesce(x, F.lit(0.0)) for x in (a - b, a - b - half, a - b + half))


def years_needed(sharpe: float, t: float = 2.0) -> float | None:
    return (t / sharpe) ** 2 if sharpe else None


def block_bootstrap(returns: DataFrame, x: str, draws: int, block: int, seed: int = 0, keys=("symbol",), order=("ts",)) -> DataFrame:
    """(keys, draw, mean): circular block bootstrap. Block starts come from an index table, a hash of (seed, draw, block), so reruns agree.

    Only prefix sums at row numbers are joined: a draw takes one row for each block, not for each return.
    """
    w = Window.partitionBy(*keys)
    r = returns.where(F.col(x).isNotNull()).select(*keys, *order, F.col(x).alias("_x")).withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    inside = w.orderBy("_i")
    r = r.withColumns({"_to": F.sum("_x").over(inside.rowsBetween(0, block - 1)), "_all": F.sum("_x").over(w), "_cum": F.sum("_x").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    # blocks that run over the end go on at the beginning
    first = r.select(*keys, F.col("_i").alias("_j"), F.col("_cum").alias("_head"))
    wrap = F.col("_i") + block - 1 - F.col("_n")
    sums = r.withColumn("_w", wrap).join(first.withColumnRenamed("_j", "_w"), [*keys, "_w"], "left").select(*keys, "_i", (F.col("_to") + F.coalesce("_head", F.lit(0.0))).alias("_sum"))
    sizes = returns.where(F.col(x).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    blocks = F.ceil(F.col("_n") / block).cast("int")
    table = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("_b", F.explode(F.sequence(F.lit(0), blocks - 1)))
    table = table.withColumn("_i", F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "draw", "_b")), 1, 12), 16, 10).cast("long"), F.col("_n")).cast("int"))
    return table.join(sums, [*keys, "_i"]).groupBy(*keys, "draw").agg((F.sum("_sum") / (F.count(F.lit(1)) * block)).alias("mean"))


def bootstrap_interval(draws: DataFrame, x: str = "mean", keys=("symbol",)) -> DataFrame:
    q = F.percentile(x, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return draws.groupBy(*keys).agg(F.count(F.lit(1)).alias("draws"), q.alias("_q"), F.avg((F.col(x) <= 0).cast("double")).alias("share_below_zero")).select(*keys, "draws", *[F.get("_q", F.lit(i)).alias(n) for i, n in enumerate(("low", "median", "high"))], "share_below_zero")


def expanding_folds(spark: SparkSession, n: int, folds: int, test_share: float, embargo: int, purge: int) -> DataFrame:
    """(fold, train_start, train_end, test_start, test_end) row ranges, ends exclusive: test windows tile the end; training stops embargo and purge rows before."""
    test = int(n * test_share / folds)
    rows = [(k, 0, max(0, n - (folds - k) * test - embargo - purge), n - (folds - k) * test, n - (folds - k - 1) * test) for k in range(folds)]
    return spark.createDataFrame(rows, "fold int, train_start long, train_end long, test_start long, test_end long")


def combinatorial_folds(spark: SparkSession, n: int, groups: int = 6, chosen: int = 2) -> DataFrame:
    """(fold, start, end): test ranges of every choice of groups; the last group takes what is left."""
    size = n // groups
    rows = [(f, g * size, n if g == groups - 1 else (g + 1) * size) for f, test in enumerate(combinations(range(groups), chosen)) for g in test]
    return spark.createDataFrame(rows, "fold int, start long, end long")


def markov(samples: DataFrame, state: str, up: str, train: str) -> DataFrame:
    """(symbol, state, n, p_up): share of ups after each state among training rows, smoothed by one of either kind."""
    return samples.where(F.col(train)).groupBy("symbol", F.col(state).alias("state")).agg(F.count(F.lit(1)).alias("n"), ((F.count_if(F.col(up)) + 1) / (F.count(F.lit(1)) + 2)).alias("p_up"))


def ridge_logistic(df: DataFrame, features: list[str], target: str, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights with intercept first, means, population deviations): Newton steps over sums that one aggregation each gives; the intercept isn't penalised. Only sums of the size of the features squared reach the driver."""
    d = df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(target).cast("double").alias("_y")).na.drop().persist()
    try:
        s = d.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
        k = len(features)
        mean = np.array([s[f"m{i}"] or 0.0 for i in range(k)])
        dev = np.array([s[f"s{i}"] or 1.0 for i in range(k)])
        x = [F.lit(1.0), *[(F.col(f) - float(mean[i])) / float(dev[i]) for i, f in enumerate(features)]]
        w = np.zeros(k + 1)
        for _ in range(rounds):
            score = sum((x[i] * float(w[i]) for i in range(k + 1)), F.lit(0.0))
            p = 1 / (1 + F.exp(-score))
            sums = [F.sum(x[i] * (F.col("_y") - p)) for i in range(k + 1)] + [F.sum(x[i] * x[j] * p * (1 - p)) for i in range(k + 1) for j in range(i, k + 1)]
            row = list(d.agg(*[v.alias(f"c{i}") for i, v in enumerate(sums)]).first())
            penalty = np.diag([0.0] + [ridge] * k)
            hessian = np.zeros((k + 1, k + 1))
            hessian[np.triu_indices(k + 1)] = row[k + 1 :]
            hessian = hessian + np.triu(hessian, 1).T + penalty
            step = np.linalg.solve(hessian, np.array(row[: k + 1]) - penalty @ w)
            w = w + step
            if np.abs(step).max() < 1e-10:
                break
        return w, mean, dev
    finally:
        d.unpersist()
