"""Placebos and comparisons: chance by seeded hash draws, shares and means of two groups, and how much evidence a ratio needs.

A draw is the hash of (seed, draw, row), so reruns agree and no row waits for another; rows are trades or bars, not ticks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import c
from .inference import expected_max_sharpe

#: Coefficients of the rational approximation to the normal tail (Hart 1968, as given by West 2005), highest power first: fixed values.
UPPER = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
LOWER = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf(x: str) -> str:
    """SQL (of Spark and DuckDB) for the normal distribution function of the expression x, to about 14 digits."""
    double = lambda v: f"CAST({v!r} AS DOUBLE)"

    def polynomial(coefficients: tuple[float, ...], z: str) -> str:
        text = double(coefficients[0])
        for k in coefficients[1:]:
            text = f"({text} * {z} + {double(k)})"
        return text

    z = f"least(abs({x}), {double(37.0)})"
    near = f"{polynomial(UPPER, z)} / {polynomial(LOWER, z)}"
    far = f"1 / ({z} + 1 / ({z} + 2 / ({z} + 3 / ({z} + 4 / ({z} + {double(0.65)}))))) / {double(2.506628274631)}"
    tail = f"exp(-({z} * {z}) / 2) * (CASE WHEN {z} < {double(7.07106781186547)} THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def with_chance(df: DataFrame, difference: Column, error: Column, out: str = "p") -> DataFrame:
    """df with the chance of a difference as large if there is none; by its sign alone where the error is 0."""
    d = df.withColumns({"_d": difference, "_e": error}).withColumn("_z", c("_d") / F.nullif(c("_e"), F.lit(0.0)))
    p = F.when(c("_e") > 0, 1 - F.expr(normal_cdf("_z"))).otherwise(F.when(c("_d") > 0, 0.0).otherwise(1.0))
    return d.withColumn(out, p).drop("_d", "_e", "_z")


def share_difference(rows: DataFrame, group: Column, success: Column, keys=("symbol",)) -> DataFrame:
    """(keys, n_a, n_b, share_a, share_b, p): of rows inside (a) and outside the group the share of successes, and the chance that a's is no larger. Rows with an unknown part are left out."""
    d = rows.select(*keys, group.alias("_g"), success.cast("double").alias("_s")).where("_g IS NOT NULL AND _s IS NOT NULL")
    s = d.groupBy(*keys).agg(F.count_if("_g").alias("n_a"), F.count_if(~c("_g")).alias("n_b"), F.avg(F.when(c("_g"), c("_s"))).alias("share_a"), F.avg(F.when(~c("_g"), c("_s"))).alias("share_b"))
    error = F.sqrt(c("share_a") * (1 - c("share_a")) / c("n_a") + c("share_b") * (1 - c("share_b")) / c("n_b"))
    return with_chance(s.where("n_a > 0 AND n_b > 0"), c("share_a") - c("share_b"), error)


def mean_difference(rows: DataFrame, group: Column, value: Column, keys=("symbol",)) -> DataFrame:
    """(keys, n_a, n_b, mean_a, mean_b, p), like share_difference, from means and sample variances; groups of one row are left out."""
    d = rows.select(*keys, group.alias("_g"), value.cast("double").alias("_v")).where("_g IS NOT NULL AND _v IS NOT NULL")
    inside, outside = F.when(c("_g"), c("_v")), F.when(~c("_g"), c("_v"))
    s = d.groupBy(*keys).agg(F.count(inside).alias("n_a"), F.count(outside).alias("n_b"), F.avg(inside).alias("mean_a"), F.avg(outside).alias("mean_b"), F.var_samp(inside).alias("_va"), F.var_samp(outside).alias("_vb"))
    error = F.sqrt(c("_va") / c("n_a") + c("_vb") / c("n_b"))
    return with_chance(s.where("n_a > 1 AND n_b > 1"), c("mean_a") - c("mean_b"), error).drop("_va", "_vb")


def ticket(seed: int, *parts: str) -> Column:
    """48 random bits of the seed and the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[c(p).cast("string") for p in parts])), 1, 12), 16, 10).cast("long")


def drawn(rows: DataFrame, draws: int) -> DataFrame:
    return rows.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))


def random_sides(trades: DataFrame, draws: int, seed: int, keys=("symbol",)) -> DataFrame:
    """(keys, n, observed, p) of trades (keys, row, side 1 or -1, gross, cost): the share of draws whose net is no less than the observed, where each trade keeps its size and
    cost and a fair coin gives its side. Sums are added up before they meet."""
    t = trades.where("side != 0 AND gross IS NOT NULL")
    seen = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(c("gross") - c("cost")).alias("observed"), F.sum("cost").alias("_cost"))
    coin = F.when(ticket(seed, "draw", "row") % 2 == 0, 1).otherwise(-1)
    sums = drawn(t.select(*keys, "row", (c("gross") * c("side")).alias("_move")), draws).groupBy(*keys, "draw").agg(F.sum(coin * c("_move")).alias("_net"))
    both = sums.join(seen, list(keys))
    better = F.round(c("_net") - c("_cost"), 9) >= F.round("observed", 9)
    return both.groupBy(*keys, "n", "observed").agg(F.avg(better.cast("double")).alias("p"))


def shuffled_signs(events: DataFrame, cell: list[str], draws: int, seed: int, keys=("symbol",)) -> DataFrame:
    """(keys, n, observed, p) of events (keys, cell, row, side, move): as random_sides, but sides are shuffled inside each cell, so each keeps its number of longs.

    A cell's rows are ranked once for each draw; cells are blocks of time, so none grows with the series."""
    e = events.where("side != 0 AND move IS NOT NULL")
    by = Window.partitionBy(*keys, *cell)
    e = e.withColumn("_longs", F.count_if(c("side") > 0).over(by))
    rank = F.row_number().over(Window.partitionBy(*keys, *cell, "draw").orderBy(ticket(seed, "draw", "row"), "row"))
    d = drawn(e, draws).withColumn("_side", F.when(rank <= c("_longs"), 1).otherwise(-1))
    sums = d.groupBy(*keys, "draw").agg(F.sum(c("_side") * c("move")).alias("_net"))
    seen = e.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(c("side") * c("move")).alias("observed"))
    better = F.round("_net", 9) >= F.round("observed", 9)
    return sums.join(seen, list(keys)).groupBy(*keys, "n", "observed").agg(F.avg(better.cast("double")).alias("p"))


def resampled(values: DataFrame, draws: int, seed: int, keys=("symbol",)) -> DataFrame:
    """values (keys, row from 0, n, ...) drawn with replacement: column draw and place, n places for each draw. A draw takes the same rows for all columns."""
    sizes = values.groupBy(*keys).agg(F.max("n").alias("_n"))
    table = drawn(sizes, draws).withColumn("place", F.explode(F.sequence(F.lit(0), (c("_n") - 1).cast("int"))))
    return table.withColumn("row", (ticket(seed, "draw", "place") % c("_n")).cast("int")).drop("_n").join(values, [*keys, "row"])


def best_t(values: DataFrame, variants: list[str], draws: int, seed: int, keys=("symbol",)) -> DataFrame:
    """(keys, observed, p): the best t statistic among variants (columns) above zero, and the share of resamples, each variant centred, whose best is no less."""
    t = lambda v: F.avg(v) / F.nullif(F.stddev_samp(v) / F.sqrt(F.count(v)), F.lit(0.0))
    seen = values.groupBy(*keys).agg(F.coalesce(F.greatest(*[t(v) for v in variants], F.lit(-1e300)), F.lit(0.0)).alias("observed"), *[F.avg(v).alias(f"_m_{v}") for v in variants])
    centred = values.join(seen, list(keys)).withColumns({v: c(v) - c(f"_m_{v}") for v in variants}).select(*keys, "row", "n", *variants)
    best = resampled(centred, draws, seed, keys).groupBy(*keys, "draw").agg(F.greatest(*[t(v) for v in variants], F.lit(-1e300)).alias("_best"))
    better = F.round("_best", 9) >= F.round("observed", 9)
    return best.join(seen.select(*keys, "observed"), list(keys)).groupBy(*keys, "observed").agg(F.avg(better.cast("double")).alias("p"))


def drawdowns(values: DataFrame, x: str, draws: int, seed: int, keys=("symbol",)) -> DataFrame:
    """(keys, draws, mean, q95, shortfall) of the deepest drawdown of resampled returns x, of which -1 and less lose all; shortfall: the mean of those from the 95 % quantile on."""
    w = Window.partitionBy(*keys, "draw").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    path = resampled(values, draws, seed, keys).withColumn("_log", F.sum(F.log(F.greatest(1 + c(x), F.lit(1e-12)))).over(w))
    path = path.withColumn("_down", 1 - F.exp(c("_log") - F.max("_log").over(w)))
    deepest = path.groupBy(*keys, "draw").agg(F.round(F.max("_down"), 12).alias("d"))
    q = deepest.groupBy(*keys).agg(F.count(F.lit(1)).alias("draws"), F.avg("d").alias("mean"), F.percentile("d", 0.95).alias("q95"))
    return q.join(deepest, list(keys)).groupBy(*keys, "draws", "mean", "q95").agg(F.avg(F.when(c("d") >= c("q95") - 1e-12, c("d"))).alias("shortfall"))


def sharpe_chances(moments: DataFrame, trials: int) -> DataFrame:
    """moments (n, mean, sd, skew, kurt) with sharpe, psr, the probability that it is above zero, and dsr, that it is above the best of `trials` without skill."""
    m = moments.where("sd > 0 AND n > 1").withColumn("sharpe", c("mean") / c("sd"))
    scale = F.sqrt(F.greatest(F.lit(1e-12), 1 - c("skew") * c("sharpe") + (c("kurt") - 1) / 4 * c("sharpe") * c("sharpe")))
    z = lambda benchmark: (c("sharpe") - benchmark) * F.sqrt(c("n") - 1) / scale
    m = m.withColumns({"_z": z(F.lit(0.0)), "_zd": z(F.lit(expected_max_sharpe(trials, 1.0)) / F.sqrt(c("n") - 1))})
    return m.withColumns({"psr": F.expr(normal_cdf("_z")), "dsr": F.expr(normal_cdf("_zd"))}).drop("_z", "_zd")


def least_sharpe(years: Column, t: float = 2.0) -> Column:
    """The smallest yearly Sharpe ratio that reaches t in so many years."""
    return F.lit(t) / F.sqrt(F.nullif(years, F.lit(0.0)))


def surface(ratios: DataFrame, x: str, keys=("symbol",)) -> DataFrame:
    """(keys, mean, sd, peak, stability) of a rule's ratio over its parameters: stable if the peak lies less than two deviations over the mean."""
    s = ratios.groupBy(*keys).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.max(x).alias("peak"))
    return s.withColumn("stability", F.when(c("peak") - c("mean") < 2 * c("sd"), "stable").otherwise("isolated"))


def shuffled_labels(trades: DataFrame, draws: int, seed: int, keys=("symbol",)) -> DataFrame:
    """(keys, label, n, observed, p) of trades (keys, row, net, label): the share of draws in which a label, dealt out anew over the same trades, nets no less."""
    slots = trades.select(*keys, "label", F.row_number().over(Window.partitionBy(*keys).orderBy("label", "row")).alias("slot"))
    rank = F.row_number().over(Window.partitionBy(*keys, "draw").orderBy(ticket(seed, "draw", "row"), "row"))
    dealt = drawn(trades.drop("label"), draws).withColumn("slot", rank).join(slots, [*keys, "slot"])
    seen = trades.groupBy(*keys, "label").agg(F.count(F.lit(1)).alias("n"), F.sum("net").alias("observed"))
    sums = dealt.groupBy(*keys, "label", "draw").agg(F.sum("net").alias("_net")).join(seen, [*keys, "label"])
    better = F.round("_net", 9) >= F.round("observed", 9)
    return sums.groupBy(*keys, "label", "n", "observed").agg(F.avg(better.cast("double")).alias("p"))


def shuffled_order(trades: DataFrame, draws: int, seed: int, keys=("symbol",)) -> DataFrame:
    """(keys, observed, p) of trades (keys, row, net): the deepest fall of their running sum, and the share of random orders with one as deep."""
    d = drawn(trades, draws + 1).withColumn("_o", F.when(c("draw") == 0, c("row").cast("long")).otherwise(ticket(seed, "draw", "row")))
    w = Window.partitionBy(*keys, "draw").orderBy("_o", "row").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_c", F.sum("net").over(w)).withColumn("_down", F.greatest(F.lit(0.0), F.max("_c").over(w)) - c("_c"))
    deepest = d.groupBy(*keys, "draw").agg(F.round(F.max("_down"), 12).alias("d"))
    seen = deepest.where("draw = 0").select(*keys, c("d").alias("observed"))
    return deepest.where("draw > 0").join(seen, list(keys)).groupBy(*keys, "observed").agg(F.avg((c("d") >= c("observed")).cast("double")).alias("p"))


def random_choice(values: DataFrame, variants: list[str], draws: int, seed: int, keys=("symbol",)) -> DataFrame:
    """(keys, best, best_net, expected, q05, q95): the best single variant (ties to the smaller name), and the nets of choosing one at random at every row."""
    nets = values.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in variants])
    ranked = F.array_min(F.array(*[F.struct((-F.round(v, 12)).alias("m"), F.lit(v).alias("v"), c(v).alias("net")) for v in variants]))
    total = sum((c(v) for v in variants[1:]), c(variants[0]))
    seen = nets.withColumn("_b", ranked).select(*keys, c("_b.v").alias("best"), c("_b.net").alias("best_net"), (total / len(variants)).alias("expected"))
    pick = F.get(F.array(*[c(v) for v in variants]), (ticket(seed, "draw", "row") % len(variants)).cast("int"))
    sums = drawn(values.select(*keys, "row", *variants), draws).groupBy(*keys, "draw").agg(F.sum(pick).alias("_net"))
    q = sums.groupBy(*keys).agg(F.percentile("_net", 0.05).alias("q05"), F.percentile("_net", 0.95).alias("q95"))
    return seen.join(q, list(keys))


def ledger_gate(trades: DataFrame, extra_cost: float, least_t: float, keys=("symbol",)) -> DataFrame:
    """(keys, trades, days, net, stressed_net, win_rate, profit_factor, day_t, passed) of trades (keys, ts, gross, cost): passed if the net is positive with extra_cost more for each trade, and the mean of trading days is least_t errors above zero."""
    t = trades.withColumns({"_net": c("gross") - c("cost"), "_day": F.to_date("ts")})
    days = t.groupBy(*keys, "_day").agg(F.sum("_net").alias("_d")).groupBy(*keys).agg(F.count(F.lit(1)).alias("days"), (F.avg("_d") / F.nullif(F.stddev_samp("_d") / F.sqrt(F.count(F.lit(1))), F.lit(0.0))).alias("day_t"))
    won, lost = F.sum(F.greatest(c("_net"), F.lit(0.0))), -F.sum(F.least(c("_net"), F.lit(0.0)))
    s = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("trades"), F.sum("_net").alias("net"), F.sum(c("_net") - extra_cost).alias("stressed_net"), F.avg((c("_net") > 0).cast("double")).alias("win_rate"), (won / F.nullif(lost, F.lit(0.0))).alias("profit_factor"))
    return s.join(days, list(keys)).withColumn("passed", F.coalesce((c("stressed_net") > 0) & (c("day_t") >= least_t), F.lit(False)))


def interaction(neither: Column, first: Column, second: Column, both: Column) -> Column:
    """What two changes do together beyond the sum of each alone."""
    return both - first - second + neither
