"""Checks of bars and ticks: gaps, bar rules, spreads, same-stamp groups and jumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import along, previous, seconds
from ..functions.quantiles import exact_quantiles


def gaps(bars: DataFrame, cadence_s: int, closures: DataFrame | None = None) -> DataFrame:
    """(symbol, gap_start, gap_end, missing, expected): holes longer than the cadence. Expected: over a weekend, or overlapping a closure (start, end)."""
    w = along()
    g = bars.withColumn("gap_start", F.lag("ts").over(w)).withColumn("delta", seconds("ts") - seconds("gap_start")).where(F.col("delta") > cadence_s)
    # weekday 4 is Friday; a hole from Friday to Saturday, Sunday or Monday is a weekend
    weekend = (F.weekday("gap_start") == 4) & F.weekday("ts").isin(5, 6, 0) & (F.col("delta") < 4 * 86400)
    g = g.select("symbol", "gap_start", F.col("ts").alias("gap_end"), (F.round(F.col("delta") / cadence_s) - 1).cast("long").alias("missing"), weekend.alias("expected"))
    if closures is None:
        return g
    c = F.broadcast(closures.select(F.col("start").alias("_s"), F.col("end").alias("_e")).distinct())  # a calendar: some rows for each day
    hit = g.join(c, (F.col("_s") < F.col("gap_end")) & (F.col("_e") > F.col("gap_start")), "left_semi").select("symbol", "gap_start").withColumn("_closed", F.lit(True))
    return g.join(hit, ["symbol", "gap_start"], "left").withColumn("expected", F.col("expected") | F.coalesce("_closed", F.lit(False))).drop("_closed")


def gap_summary(bars: DataFrame, cadence_s: int, closures: DataFrame | None = None, most: float = 0.02) -> DataFrame:
    """Of each symbol: bars, gaps, missing intervals expected or not, and whether the unexpected share is `most` or less."""
    g = gaps(bars, cadence_s, closures).groupBy("symbol").agg(F.count(F.lit(1)).alias("n_gaps"), F.sum(F.when(~F.col("expected"), F.col("missing")).otherwise(0)).alias("unexpected"), F.sum(F.when(F.col("expected"), F.col("missing")).otherwise(0)).alias("closed"))
    n = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_bars")).join(g, "symbol", "left").na.fill(0)
    return n.withColumn("passed", F.col("unexpected") / (F.col("n_bars") + F.col("unexpected")) <= most)


def bar_rules() -> dict[str, Column]:
    """Violations of single bars."""
    prices = [F.col(x) for x in ("open", "high", "low", "close")]
    return {
        "unknown_price": F.greatest(*[(p.isNull() | F.isnan(p)).cast("int") for p in prices]) == 1,
        "not_positive": F.least(*prices) <= 0,
        "high_below": F.col("high") < F.greatest("open", "close", "low"),
        "low_above": F.col("low") > F.least("open", "close", "high"),
        "wide_range": (F.col("high") - F.col("low")) / F.nullif("close", F.lit(0.0)) > 0.1,
        "negative_volume": F.col("volume") < 0,
    }


def check_bars(bars: DataFrame) -> DataFrame:
    """(symbol, rows, duplicates, and a count for each bar rule)."""
    each = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), (F.count(F.lit(1)) - F.count_distinct("ts")).alias("duplicates"), *[F.count_if(c).alias(k) for k, c in bar_rules().items()])
    return each


def spread_profile(ticks: DataFrame) -> DataFrame:
    """Exact quantiles of the quoted spread in bps of mid, by rank over ranges of values."""
    bps = (F.col("ask_c") - F.col("bid_c")) / ((F.col("ask_c") + F.col("bid_c")) / 2) * 1e4
    t = ticks.where("bid_c > 0 AND ask_c >= bid_c").select("symbol", bps.alias("bps"))
    sums = t.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.min("bps").alias("min_bps"), F.max("bps").alias("max_bps"), F.avg("bps").alias("mean_bps"))
    return sums.join(exact_quantiles(t, ["symbol"], "bps", {"p50_bps": 0.5, "p90_bps": 0.9, "p95_bps": 0.95, "p99_bps": 0.99}), "symbol")


def stamp_groups(ticks: DataFrame) -> DataFrame:
    """Groups of ticks with one stamp, and how many quotes they hold beyond different ones."""
    g = ticks.groupBy("symbol", "ts").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("bid_c", "ask_c").alias("d"))
    return g.groupBy("symbol").agg(F.count_if(F.col("n") > 1).alias("groups"), F.sum("n").alias("ticks"), F.sum(F.col("n") - F.col("d")).alias("repeated"))


def largest_gaps(ticks: DataFrame, k: int = 5) -> DataFrame:
    """The k longest silences of each symbol; ties to the earlier. Only a row's predecessor is needed, so days are ranked apart before the last ranking."""
    from pyspark.sql import Window

    p = previous(ticks.withColumn("stamp", F.col("ts")), ["stamp"], order=("ts", "seq")).withColumn("gap_s", seconds("ts") - seconds("prev_stamp")).where("gap_s > 0")
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("gap_s"), "ts", "seq"))
    near = p.withColumn("day", F.to_date("ts")).withColumn("r", rank("symbol", "day")).where(F.col("r") <= k)
    return near.withColumn("rank", rank("symbol")).where(F.col("rank") <= k).select("symbol", "rank", "ts", "gap_s")


def coverage(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("symbol", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("ticks"), F.min("ts").alias("first"), F.max("ts").alias("last"))
