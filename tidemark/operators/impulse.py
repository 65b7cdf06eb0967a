"""A study of impulses in one plan: every family and horizon against bars without events, by parts of time, with all tests corrected together."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frames import along
from ..functions.indicators import back, c
from ..functions.inference import binomial_two_sided, holm, two_proportions
from .assays import detectors
from .signals import greedy


def measured(bars: DataFrame, horizons: tuple[int, ...] = (4, 12), latency: int = 1, suppress: int = 12, warmup: int = 26, shares: tuple[float, float] = (0.6, 0.2), seed: int = 0, **parameters) -> DataFrame:
    """(symbol, family, horizon, split, row, event, side, return_bps) of all events and of the bars that serve as their baseline.

    Entry is the close `latency` bars after the event, exit `horizon` bars later; return_bps is null where the series ends before. Events within `suppress` bars of one taken
    are none. Baseline (event false): bars from `warmup` on whose path is whole and that lie beyond every event's path of the same family, with a side by a hash of
    (seed, symbol, row), so reruns agree. split: discovery and validation by shares of the symbol's bars; what is left is locked and appears nowhere. Families and horizons
    are rows of one frame: one shuffle for the events and one for the paths, whatever their number.
    """
    w, each = along(), Window.partitionBy("symbol", "family")
    d = bars.withColumns({"move3": c("close") - back("close", 3), "return1": c("close") / F.nullif(back("close"), F.lit(0.0)) - 1, "row": F.row_number().over(w) - 1, "rows": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    found = F.array(*[F.struct(F.lit(name).alias("family"), F.coalesce(x, F.lit(0)).cast("int").alias("direction")) for name, x in detectors(**parameters).items()])
    entry = F.lead("close", latency).over(w) if latency else c("close")
    ends = F.array(*[F.struct(F.lit(h).alias("horizon"), ((F.lead("close", latency + h).over(w) / F.nullif(entry, F.lit(0.0)) - 1) * 1e4).alias("move_bps")) for h in horizons])
    split = F.when(c("row") < F.floor(c("rows") * shares[0]), "discovery").when(c("row") < F.floor(c("rows") * sum(shares)), "validation")
    d = d.withColumns({"found": found, "ends": ends, "split": split}).select("symbol", "ts", "row", "rows", "split", "ends", F.explode("found").alias("f")).select("symbol", "ts", "row", "rows", "split", "ends", "f.*")
    shown = d.select("symbol", "family", "ts", "row", "direction", (c("direction") != 0).alias("shown"))
    taken = greedy(shown, "shown", suppress, keys=("symbol", "family")).select("symbol", "family", "row", c("direction").alias("taken"))
    d = d.drop("direction").join(taken, ["symbol", "family", "row"], "left")
    d = d.withColumn("last", F.max(F.when(c("taken").isNotNull(), c("row"))).over(each.orderBy("row").rowsBetween(Window.unboundedPreceding, 0)))
    d = d.where("split IS NOT NULL").withColumn("e", F.explode("ends")).withColumns({"horizon": c("e.horizon"), "move_bps": c("e.move_bps"), "event": c("taken").isNotNull()})
    free = (c("row") >= warmup) & (c("row") < c("rows") - (latency + c("horizon"))) & (c("last").isNull() | (c("row") - c("last") > latency + c("horizon")))
    coin = F.when(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "symbol", "row")), 1, 1), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)
    d = d.where(c("event") | free).withColumn("side", F.coalesce("taken", coin))
    return d.select("symbol", "family", "horizon", "split", "row", "event", "side", (c("side") * c("move_bps")).alias("return_bps"))


def _binomial(k: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([binomial_two_sided(int(a), int(b), min(max(float(q), 1e-9), 1 - 1e-9)) if b else 1.0 for a, b, q in zip(k, n, p, strict=True)])


def study(paths: DataFrame, cost_bps: float = 2.0) -> DataFrame:
    """A row for each symbol, family, horizon and split (and both splits, "pooled") of measured(): counts, shares of continuations of events and baseline, their
    difference with its interval, the exact binomial p (to 12 digits) against the baseline's share (0.5 without one) and p_holm over the families, and returns before and after costs."""
    event, known, on = c("event"), c("return_bps").isNotNull(), c("return_bps") > 0
    n = F.count_if
    g = paths.withColumn("split", F.explode(F.array("split", F.lit("pooled")))).groupBy("symbol", "family", "horizon", "split").agg(
        n(event).alias("detected"), n(event & known).alias("measured"), n(event & on).alias("continued"), n(event & (c("return_bps") < 0)).alias("reversed"), n(event & (c("side") > 0)).alias("longs"),
        n(~event & known).alias("baseline"), n(~event & on).alias("baseline_continued"), F.avg(F.when(event, c("return_bps"))).alias("gross_bps"), F.stddev_samp(F.when(event, c("return_bps"))).alias("sd_bps"),
        F.avg(F.when(event & (c("side") > 0), c("return_bps") - cost_bps)).alias("long_net_bps"), F.avg(F.when(event & (c("side") < 0), c("return_bps") - cost_bps)).alias("short_net_bps"),
    )
    rate = F.coalesce(c("baseline_continued") / F.nullif("baseline", F.lit(0)), F.lit(0.5))
    diff, low, high = two_proportions("continued", "measured", "baseline_continued", "baseline")
    g = g.withColumns({"baseline_rate": rate, "diff": diff, "diff_low": low, "diff_high": high, "net_bps": c("gross_bps") - cost_bps})
    g = g.withColumn("sharpe", c("net_bps") / F.nullif("sd_bps", F.lit(0.0))).withColumn("p", F.round(F.pandas_udf(_binomial, "double")("continued", "measured", "baseline_rate"), 12))
    return holm(g, "p", ["symbol", "horizon", "split"]).drop("sd_bps")


def cost_sweep(results: DataFrame, cost_bps: float, times: tuple[float, ...] = (0.5, 1.0, 2.0, 3.0)) -> DataFrame:
    """(symbol, family, horizon, times, net_bps) of pooled results of study() at multiples of the cost."""
    each = F.array(*[F.struct(F.lit(float(t)).alias("times"), (c("gross_bps") - t * cost_bps).alias("net_bps")) for t in times])
    return results.where("split = 'pooled'").select("symbol", "family", "horizon", F.explode(each).alias("x")).select("symbol", "family", "horizon", "x.*")
