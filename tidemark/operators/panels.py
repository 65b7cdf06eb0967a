"""Tick panels: named states against what follows, two-sided quoting, quote changes, activity by hour and gaps.

Windows go over stretches of rows with overlapping borders, so a long series is many tasks; each panel ends in one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..frames import previous, seconds
from ..functions.indicators import c
from .assays import TICK, numbered, quote_moves, with_ahead

def by_row() -> WindowSpec:
    return Window.partitionBy("symbol", "stretch").orderBy("row")


def tick_states(past: int = 16) -> dict[str, Column]:
    """Boolean states of a row with columns mid_c, spread_c and move_c (its step from the row before), each from rows up to it."""
    w = by_row().rowsBetween(-past, -1)
    before = F.lag("move_c").over(by_row())
    return {
        "wide": c("spread_c") * past > F.sum("spread_c").over(w),
        "tight": c("spread_c") * past < F.sum("spread_c").over(w),
        "large": F.abs("move_c") * past > F.sum(F.abs("move_c")).over(w),
        "small": F.abs("move_c") * past < F.sum(F.abs("move_c")).over(w),
        "run": c("move_c") * before > 0,
        "turn": c("move_c") * before < 0,
        "any": F.lit(True),
    }


def state_panel(ticks: DataFrame, horizons: tuple[int, ...] = (4, 16, 64), past: int = 16) -> DataFrame:
    """(symbol, state, horizon, n, mean_abs_c, up_share): moves of the mid over the horizons after each state, at every row that has `past` steps behind it."""
    rows = previous(numbered(ticks), ["mid_c"], order=TICK)
    rows = rows.select("symbol", "row", "mid_c", (c("ask_c") - c("bid_c")).alias("spread_c"), (c("mid_c") - c("prev_mid_c")).alias("move_c"))
    s = with_ahead(rows, max(horizons), past)
    states = F.array(*[F.when(on, F.lit(name)) for name, on in tick_states(past).items()])
    ends = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead("mid_c", h).over(by_row()).alias("m")) for h in horizons])
    s = s.withColumns({"states": F.array_compact(states), "ends": ends}).where(c("own") & (c("row") > past))
    s = s.select("symbol", "mid_c", F.explode("states").alias("state"), "ends").select("symbol", "mid_c", "state", F.explode("ends").alias("e")).where("e.m IS NOT NULL")
    move = c("e.m") - c("mid_c")
    return s.groupBy("symbol", "state", c("e.horizon").alias("horizon")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(move)).alias("mean_abs_c"), F.avg((move > 0).cast("double")).alias("up_share"))


def two_sided_quotes(ticks: DataFrame, fill_rows: int = 16, far_rows: int = 256, cost_c: float = 2) -> DataFrame:
    """(symbol, n, buy_share, sell_share, both_share, mean_net_c, mean_excursion_c) of quoting both sides at every row that has far_rows after it.

    The bid is filled when a bid within fill_rows is as low, the ask when an ask is as high; both earn the spread less the cost, one alone counts as nothing.
    """
    s = with_ahead(numbered(ticks).select("symbol", "row", "mid_c", "bid_c", "ask_c"), far_rows)
    near, far = by_row().rowsBetween(1, fill_rows), by_row().rowsBetween(1, far_rows)
    s = s.withColumns({
        "buy": F.min("bid_c").over(near) <= c("bid_c"),
        "sell": F.max("ask_c").over(near) >= c("ask_c"),
        "excursion": F.greatest(F.max("mid_c").over(far) - c("mid_c"), c("mid_c") - F.min("mid_c").over(far)),
        "end": F.lead("mid_c", far_rows).over(by_row()),
    }).where(c("own") & c("end").isNotNull())
    both = c("buy") & c("sell")
    share = lambda x: F.avg(x.cast("double"))
    net = F.when(both, c("ask_c") - c("bid_c") - cost_c).otherwise(0.0)
    return s.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), share(c("buy")).alias("buy_share"), share(c("sell")).alias("sell_share"), share(both).alias("both_share"), F.avg(net).alias("mean_net_c"), F.avg("excursion").alias("mean_excursion_c"))


def change_panel(ticks: DataFrame, horizon: int = 4) -> DataFrame:
    """(symbol, state, n, up_share, mean_move_c): moves from one row after a quote change, by its state 0 to 8, to `horizon` rows later. 1 and 7 move the bid alone, 2 widens, 6 tightens."""
    s = with_ahead(quote_moves(numbered(ticks)).select("symbol", "row", "mid_c", "state"), horizon + 1)
    move = F.lead("mid_c", horizon + 1).over(by_row()) - F.lead("mid_c").over(by_row())
    s = s.withColumn("move", move).where(c("own") & c("move").isNotNull() & c("state").isNotNull())
    return s.groupBy("symbol", "state").agg(F.count(F.lit(1)).alias("n"), F.avg((c("move") > 0).cast("double")).alias("up_share"), F.avg("move").alias("mean_move_c"))


def hourly_activity(ticks: DataFrame, past: int = 16) -> DataFrame:
    """(symbol, hour, n, mean_spread_c, median_spread_c, mean_abs_c): ticks, spreads and sizes of moves over `past` rows for each hour of the day."""
    s = with_ahead(numbered(ticks).select("symbol", "row", "ts", "mid_c", (c("ask_c") - c("bid_c")).alias("spread_c")), 0, past)
    s = s.withColumn("move", F.abs(c("mid_c") - F.lag("mid_c", past).over(by_row()))).where("own")
    return s.groupBy("symbol", F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.avg("spread_c").alias("mean_spread_c"), F.percentile("spread_c", 0.5).alias("median_spread_c"), F.avg("move").alias("mean_abs_c"))


def gap_histogram(ticks: DataFrame, edges_s: list[float]) -> DataFrame:
    """(symbol, bucket, n): seconds between consecutive ticks, bucket being how many of the edges they reach."""
    p = previous(ticks, ["ts"], order=TICK).where("prev_ts IS NOT NULL").withColumn("gap", seconds() - seconds("prev_ts"))
    bucket = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges_s]), lambda e: e <= c("gap")))
    return p.groupBy("symbol", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def missing_ranges(rows: DataFrame, key: str, number: str, stretch: int = 100_000) -> DataFrame:
    """(key, first_missing, last_missing, n): ranges of numbers that a key's sequence skips; repeated numbers count once.

    Windows go over stretches of numbers; a table of one row for each stretch carries the number before it."""
    d = rows.where(F.col(number).isNotNull()).select(key, F.col(number).alias("_n")).distinct().withColumn("_s", F.floor(F.col("_n") / stretch))
    tops = d.groupBy(key, "_s").agg(F.max("_n").alias("_top")).withColumn("_carry", F.lag("_top").over(Window.partitionBy(key).orderBy("_s"))).drop("_top")
    before = F.coalesce(F.lag("_n").over(Window.partitionBy(key, "_s").orderBy("_n")), F.col("_carry"))
    d = d.join(tops, [key, "_s"]).withColumn("_before", before).where(F.col("_n") > F.col("_before") + 1)
    return d.select(key, (F.col("_before") + 1).alias("first_missing"), (F.col("_n") - 1).alias("last_missing"), (F.col("_n") - F.col("_before") - 1).alias("n"))
