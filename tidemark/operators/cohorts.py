"""Closed trades taken apart: by what they have in common, by rules that would have left some out, and one ledger beside another day by day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import c
from ..functions.inference import block_bootstrap
from ..functions.quantiles import exact_quantiles

#: A paired comparison of fewer days has no interval.
LEAST_DAYS = 28


def iso_week(ts: Column | str) -> Column:
    """Year and week of a stamp as 2024-W01; the year is that of the week's Thursday."""
    x = F.col(ts) if isinstance(ts, str) else ts
    return F.concat(F.extract(F.lit("YEAROFWEEK"), x).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(x).cast("string"), 2, "0"))


def breakdowns(trades: DataFrame, net: Column, by: dict[str, Column]) -> DataFrame:
    """(kind, name, trades, total, mean, median, win_rate, mean_win, mean_loss, hurdle) of all trades (kind whole) and of each value of every column of `by`.

    Trades without a known net don't count; an unknown value is a name of its own (null). hurdle is the win rate at which the mean win and the mean loss cancel out, null
    without both. Every kind comes from one pass; medians are found by rank, so one value may hold most trades.
    """
    kinds = {"whole": F.lit("whole")} | by
    each = F.array(*[F.struct(F.lit(k).alias("kind"), x.cast("string").alias("name")) for k, x in kinds.items()])
    t = trades.select(net.cast("double").alias("net"), F.explode(each).alias("k")).where("net IS NOT NULL").select("k.kind", F.coalesce("k.name", F.lit("")).alias("name"), c("k.name").isNull().alias("none"), "net")
    keys = ["kind", "name", "none"]
    win, loss = F.when(c("net") > 0, c("net")), F.when(c("net") < 0, c("net"))
    s = t.groupBy(*keys).agg(F.count(F.lit(1)).alias("trades"), F.sum("net").alias("total"), F.avg("net").alias("mean"), F.count(win).alias("_wins"), F.avg(win).alias("mean_win"), F.avg(loss).alias("mean_loss"))
    s = s.join(exact_quantiles(t, keys, "net", {"median": 0.5}), keys)
    hurdle = -c("mean_loss") / F.nullif(c("mean_win") - c("mean_loss"), F.lit(0.0))
    return s.select("kind", F.when(~c("none"), c("name")).alias("name"), "trades", "total", "mean", "median", (c("_wins") / c("trades")).alias("win_rate"), "mean_win", "mean_loss", hurdle.alias("hurdle"))


def kept_variants(trades: DataFrame, net: Column, size: Column, keep: dict[str, Column], charges: tuple[float, ...] = (10, 20, 30), keys: tuple[str, ...] = ("period",)) -> DataFrame:
    """(keys, variant, positions, wins, win_rate, net, size, after (net less each of `charges` for a unit of size), excluded, excluded_net, delta) of every rule that would have kept some trades.

    delta is net less that of all trades; unknown rules keep nothing, and a rule that keeps nothing has no win rate. Trades are what happened: nothing is
    replayed, so a trade left out changes no other. Variants add columns to one grouping, not shuffles.
    """
    t = trades.withColumns({"_net": F.coalesce(net, F.lit(0)), "_size": F.coalesce(size, F.lit(0)).cast("double")})
    sums = []
    for name, rule in keep.items():
        k = F.coalesce(rule, F.lit(False))
        of = lambda x, k=k: F.coalesce(F.sum(F.when(k, x)), F.lit(0))
        sums.append(F.struct(F.lit(name).alias("variant"), F.count_if(k).alias("positions"), F.count_if(k & (c("_net") > 0)).alias("wins"), of(c("_net")).alias("net"), of(c("_size")).cast("double").alias("size"), F.count_if(~k).alias("excluded"), F.coalesce(F.sum(F.when(~k, c("_net"))), F.lit(0)).alias("excluded_net")))
    g = t.groupBy(*keys).agg(F.sum("_net").alias("_all"), *[x.alias(f"_v{i}") for i, x in enumerate(sums)])
    g = g.select(*keys, "_all", F.explode(F.array(*[f"_v{i}" for i in range(len(sums))])).alias("v")).select(*keys, "_all", "v.*")
    after = F.array(*[c("net") - float(x) * c("size") for x in charges])
    return g.select(*keys, "variant", "positions", "wins", (c("wins") / F.nullif("positions", F.lit(0))).alias("win_rate"), "net", "size", after.alias("after"), "excluded", "excluded_net", (c("net") - c("_all")).alias("delta"))


def in_every_period(variants: DataFrame, charge: int) -> DataFrame:
    """(variant, periods, better, above): whether a rule beat all trades in every period, and whether it was above 0 in every one after the charge of that place."""
    return variants.groupBy("variant").agg(F.count(F.lit(1)).alias("periods"), F.every(c("delta") > 0).alias("better"), F.every(F.get("after", F.lit(charge)) > 0).alias("above"))


def ledger_arm(trades: DataFrame, equity: float, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, deals, positions, net, expectancy, profit_factor, drawdown_pct) of deals (keys, ts, seq, position, net): wins and losses are those of whole positions, and the
    deepest fall of the running net from its peak (0 at first) is in per cent of the equity. Windows go over days, and a table of one row for each day carries balance and peak on."""
    day = (*keys, "_day")
    inside = Window.partitionBy(*day).orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    d = trades.withColumns({"_day": F.to_date("ts"), "net": F.coalesce(c("net"), F.lit(0)).cast("double")}).withColumn("_run", F.sum("net").over(inside))
    d = d.withColumn("_high", F.max("_run").over(inside))
    before = Window.partitionBy(*keys).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = d.groupBy(*day).agg(F.sum("net").alias("_sum"), F.max("_run").alias("_top")).withColumn("_from", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)))
    days = days.withColumn("_peak", F.greatest(F.lit(0.0), F.max(c("_from") + c("_top")).over(before))).select(*day, "_from", "_peak")
    fall = F.greatest("_peak", c("_from") + c("_high")) - (c("_from") + c("_run"))
    whole = d.join(days, [*day]).groupBy(*keys).agg(F.count(F.lit(1)).alias("deals"), F.sum("net").alias("net"), F.max(fall).alias("_fall"))
    p = trades.groupBy(*keys, "position").agg(F.sum(F.coalesce(c("net"), F.lit(0)).cast("double")).alias("_net"))
    p = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("positions"), F.sum(F.greatest("_net", F.lit(0.0))).alias("_win"), (-F.sum(F.least("_net", F.lit(0.0)))).alias("_loss"))
    t = whole.join(p, [*keys])
    return t.select(*keys, "deals", "positions", "net", (c("net") / c("positions")).alias("expectancy"), (c("_win") / F.nullif("_loss", F.lit(0.0))).alias("profit_factor"), (F.greatest(F.lit(0.0), "_fall") * 100 / equity).alias("drawdown_pct"))


def paired_days(candidate: DataFrame, reference: DataFrame, equity: tuple[float, float], keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, ts, difference): each calendar day from the first to the last with a deal of either ledger, and the candidate's net of that day less the reference's, each
    in per cent of its own equity. Days without deals count as 0."""
    part = lambda t, e, sign: t.groupBy(*keys, F.to_date("ts").alias("ts")).agg((F.sum("net").cast("double") * sign * 100 / e).alias("_x"))
    known = part(candidate, equity[0], 1).unionByName(part(reference, equity[1], -1)).where("ts IS NOT NULL").groupBy(*keys, "ts").agg(F.sum("_x").alias("_x"))
    every = known.groupBy(*keys).agg(F.min("ts").alias("_a"), F.max("ts").alias("_b")).select(*keys, F.explode(F.sequence("_a", "_b")).alias("ts"))
    return every.join(known, [*keys, "ts"], "left").select(*keys, "ts", F.coalesce("_x", F.lit(0.0)).alias("difference"))


def compare_ledgers(candidate: DataFrame, reference: DataFrame, equity: tuple[float, float], draws: int = 2000, seed: int = 0, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """(keys, days, mean, lower): the mean of paired_days() and the value that 1 % of circular draws of whole weeks don't exceed (the draws // 100-th smallest), null with fewer
    than LEAST_DAYS days. Draws go by a hash; the last week of a draw isn't cut."""
    days = paired_days(candidate, reference, equity, keys)
    t = days.groupBy(*keys).agg(F.count(F.lit(1)).alias("days"), F.avg("difference").alias("mean"))
    low = block_bootstrap(days, "difference", draws, 7, seed, keys).groupBy(*keys).agg(F.get(F.sort_array(F.collect_list("mean")), F.lit(max(0, draws // 100 - 1))).alias("_low"))
    return t.join(low, [*keys], "left").withColumn("lower", F.when(c("days") >= LEAST_DAYS, c("_low"))).drop("_low")
