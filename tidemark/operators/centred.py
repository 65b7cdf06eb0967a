"""Events around a centre row: a move into it that exceeds the spread, and what the next row makes of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import numbered, seconds
from ..functions.indicators import c
from .assays import with_ahead


def centres(ticks: DataFrame, share: tuple[int, int] = (60, 100), gap_s: float = 1.0) -> DataFrame:
    """(symbol, row, ts, side, net_c, net_bps, late_bps, turned, near, inverted, apart, known) of every centre: a row whose mid differs from the row before's by more than
    that row's spread, all quotes of both and of the next row being positive.

    side: sign of the move in; turned: 1 if the next mid goes back, -1 if it goes on, 0 if it stays. net_c and net_bps: gain of standing against the move for a row,
    less the centre's spread; late_bps the same two rows on, null where that row is missing, not positive or beyond the border. near: the next row comes within gap_s.
    inverted: an ask lies under its bid. apart: centres three rows apart, which share no row. known: all three rows lie before the border, share[0] / share[1] of the
    symbol's time. Rows are numbered over the whole symbol and looked at in stretches with borders, so each centre counts once however they are cut.
    """
    w = Window.partitionBy("symbol", "stretch").orderBy("row")
    at = lambda x, k: F.lag(x, -k).over(w)
    span = ticks.groupBy("symbol").agg(F.unix_micros(F.min("ts").cast("timestamp")).alias("_from"), F.unix_micros(F.max("ts").cast("timestamp")).alias("_to"))
    border = c("_from") + F.expr(f"((_to - _from) * {share[0]}) div {share[1]}")
    s = with_ahead(numbered(ticks).select("symbol", "row", "ts", "bid_c", "ask_c"), 2, 1).join(F.broadcast(span.select("symbol", border.alias("border"))), "symbol")
    s = s.withColumns({"m": c("bid_c") + c("ask_c"), "spread": c("ask_c") - c("bid_c"), "ok": (c("bid_c") > 0) & (c("ask_c") > 0), "before": F.unix_micros(c("ts").cast("timestamp")) < c("border")})
    all3 = lambda x: at(x, -1) & c(x) & at(x, 1)
    move, on = c("m") - at("m", -1), at("m", 1) - c("m")
    against = lambda k: (-F.signum(move) * (at("m", k) - c("m")) / 2 - c("spread")).cast("double")
    bps = lambda x: x / (c("m") / 2) * 1e4
    s = s.withColumns({
        "side": F.signum(move).cast("int"), "event": all3("ok") & (F.abs(move) > 2 * at("spread", -1)) & (move != 0), "net_c": against(1), "net_bps": bps(against(1)), "late_bps": F.when(at("ok", 2) & at("before", 2), bps(against(2))),
        "turned": (-F.signum(move) * F.signum(on)).cast("int"), "near": seconds(at("ts", 1)) - seconds("ts") <= gap_s, "inverted": (at("spread", -1) < 0) | (c("spread") < 0) | (at("spread", 1) < 0), "apart": c("row") % 3 == 0, "known": all3("before"),
    })
    return s.where(c("own") & c("event")).select("symbol", "row", "ts", "side", "net_c", "net_bps", "late_bps", "turned", "near", "inverted", "apart", "known")


def centre_sums(events: DataFrame, keys: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Counts, means and shares of centres() before the border: of all, of those with a near next row, a row later, and of those apart, which alone are fit for a test;
    z is that of their turns against one half. beyond: centres that touch rows beyond the border, which nothing else counts."""
    known = c("known")
    n = lambda x: F.count_if(known & x)
    mean = lambda v, x: F.avg(F.when(known & x, c(v)))
    yes, apart = F.lit(True), c("apart")
    turns, ons = n(apart & (c("turned") == 1)), n(apart & (c("turned") == -1))
    return events.groupBy(*keys).agg(
        n(yes).alias("events"), n(c("turned") == 1).alias("turns"), n(c("turned") == -1).alias("goes_on"), n(c("turned") == 0).alias("stays"), mean("net_c", yes).alias("mean_net_c"), mean("net_bps", yes).alias("mean_net_bps"), n(c("net_c") > 0).alias("gains"),
        n(c("near")).alias("near_events"), n(c("near") & (c("turned") == 1)).alias("near_turns"), mean("net_bps", c("near")).alias("near_net_bps"), n(c("late_bps").isNotNull()).alias("late_events"), mean("late_bps", yes).alias("late_net_bps"),
        n(apart).alias("apart_events"), turns.alias("apart_turns"), ons.alias("apart_goes_on"), mean("net_bps", apart).alias("apart_net_bps"), n(apart & (c("net_c") > 0)).alias("apart_gains"), _half(turns, ons).alias("z"),
        n(c("inverted")).alias("inverted_events"), F.count_if(~known).alias("beyond"),
    )


def _half(k: Column, other: Column) -> Column:
    return (k - other) / F.nullif(F.sqrt(k + other), F.lit(0.0))
