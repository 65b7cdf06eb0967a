"""Quotes left on both sides of the market: how often both would be hit soon, how far the mid then runs, and whether calm states beat wild ones in every fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import numbered
from ..functions.indicators import c
from .assays import with_ahead

#: What calm must do better than wild in a fold: both hit more often (share), the mid's run (ratio, and gap in cents), and net cents at the spread and at twice the spread.
FLOORS = {"lift": 0.05, "ratio": 1.25, "gap": 10.0, "net": 8.0, "net_twice": 0.0}
STATES = {"f": "calm", "u": "wild"}


def quote_pairs(ticks: DataFrame, fill: int = 16, ahead: int = 256, trail: int = 16, charge_c: float = 2.0, gap_s: float = 3600, block: int = 1024) -> DataFrame:
    """(symbol, anchor, ts, block, gap_clear, both, late_both, and in cents trail_c, spread_c, moved_c, most_c, net_c) of every anchor: a row every fill + 1 rows, from
    the first that has one such step and `trail` rows before it to the last that has `ahead` rows after it.

    A pair is quoted at the anchor's bid and ask. both: a bid at or under the quoted one and an ask at or over the quoted one come within `fill` rows; late_both: the
    same of the next row's quotes, false where the series ends before their last row. trail_c is the mid's absolute move over the `trail` rows before, moved_c over the
    `ahead` rows after, most_c its farthest in any of them; net_c is the spread less the charge where both are hit, else 0. gap_clear: no two rows from the
    anchor to its last row are gap_s or more apart. Stretches of rows with borders are tasks of their own.
    """
    w = Window.partitionBy("symbol", "stretch").orderBy("row")
    s = with_ahead(numbered(ticks).select("symbol", "row", "ts", "bid_c", "ask_c"), max(ahead, fill + 1), max(trail, 1))
    s = s.withColumns({"mid2": c("bid_c") + c("ask_c"), "spread_c": (c("ask_c") - c("bid_c")).cast("double"), "_at": F.unix_micros(c("ts").cast("timestamp"))})
    s = s.withColumn("_gap", F.coalesce((c("_at") - F.lag("_at").over(w) >= gap_s * 1e6).cast("int"), F.lit(0)))
    rows = lambda a, b: w.rowsBetween(a, b)
    hit = lambda bid, ask, a: (F.min("bid_c").over(rows(a, a + fill - 1)) <= bid) & (F.max("ask_c").over(rows(a, a + fill - 1)) >= ask)
    late = F.lead("row", fill + 1).over(w).isNotNull() & hit(F.lead("bid_c").over(w), F.lead("ask_c").over(w), 2)
    after, run = F.lead("mid2", ahead).over(w), rows(1, ahead)
    s = s.withColumns({
        "both": hit(c("bid_c"), c("ask_c"), 1),
        "late_both": late,
        "trail_c": F.abs(c("mid2") - F.lag("mid2", trail).over(w)) / 2,
        "moved_c": F.abs(after - c("mid2")) / 2,
        "most_c": F.greatest(F.max("mid2").over(run) - c("mid2"), c("mid2") - F.min("mid2").over(run)) / 2,
        "gap_clear": F.sum("_gap").over(run) == 0,
    })
    step = fill + 1
    s = s.where(c("own") & (c("row") % step == 0) & (c("row") >= step + trail) & c("moved_c").isNotNull())
    net = F.when(c("both"), c("spread_c") - charge_c).otherwise(0.0)
    return s.select("symbol", c("row").alias("anchor"), "ts", F.floor(c("row") / step / block).alias("block"), "gap_clear", "both", "late_both", "trail_c", "spread_c", "moved_c", "most_c", net.alias("net_c"))


def states(pairs: DataFrame, calm: Column, wild: Column) -> DataFrame:
    """The pairs of two states, as state (calm or wild); others go, and those of both are calm."""
    return pairs.withColumn("state", F.when(calm, STATES["f"]).when(wild, STATES["u"])).where("state IS NOT NULL")


def in_folds(events: DataFrame, folds: int = 5) -> DataFrame:
    """events with fold: equal counts of a symbol's events in the order of their anchors, the last taking what is left (all, if there are fewer events than folds)."""
    e = numbered(events, order=("ts", "anchor"))
    size = F.floor(c("n") / folds)
    fold = F.when(size > 0, F.least(F.floor(c("row") / size), F.lit(folds - 1))).otherwise(folds - 1)
    return e.join(events.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")), "symbol").withColumn("fold", fold.cast("int")).drop("row", "n")


def compared(events: DataFrame, keys: tuple[str, ...], charge_c: float = 2.0) -> DataFrame:
    """Calm (_f) against wild (_u) pairs of the keys: n, p (both hit), moved, most, net, risk (net for a cent of the farthest run) and p_late of each, blocks, lift,
    ratio and gap of the runs, net_twice (calm pairs that were hit, at twice the spread; 0 without any) and late_lift. Null where a state has no pairs."""
    is_ = {k: c("state") == v for k, v in STATES.items()}
    mean = lambda x, s: F.avg(F.when(s, x.cast("double")))
    values = {"p": c("both"), "moved": c("moved_c"), "most": c("most_c"), "net": c("net_c"), "p_late": c("late_both")}
    t = events.groupBy(*keys).agg(
        *[F.count_if(s).alias(f"n_{k}") for k, s in is_.items()],
        F.count_distinct("block").alias("blocks"),
        *[mean(x, s).alias(f"{name}_{k}") for name, x in values.items() for k, s in is_.items()],
        F.coalesce(mean(2 * c("spread_c") - charge_c, is_["f"] & c("both")), F.lit(0.0)).alias("net_twice"),
    )
    risk = {f"risk_{k}": F.when(c(f"most_{k}") == 0, 0.0).otherwise(c(f"net_{k}") / F.nullif(c(f"most_{k}"), F.lit(0.0))) for k in STATES}
    ratio = F.when(c("moved_f") == 0, 0.0).otherwise(c("moved_u") / F.nullif(c("moved_f"), F.lit(0.0)))
    return t.withColumns(risk | {"lift": c("p_f") - c("p_u"), "ratio": ratio, "gap": c("moved_u") - c("moved_f"), "late_lift": c("p_late_f") - c("p_late_u")})


def judged(table: DataFrame, least: int, floors: dict[str, float] | None = None) -> DataFrame:
    """compared() rows with status: inconclusive with fewer than `least` pairs of a state, passed if every floor is met, calm earns more for its risk and is ahead with late quotes too, else failed."""
    f = FLOORS | (floors or {})
    good = (c("lift") >= f["lift"]) & (c("ratio") >= f["ratio"]) & (c("gap") >= f["gap"]) & (c("net_f") > f["net"]) & (c("net_twice") > f["net_twice"]) & (c("risk_f") > c("risk_u")) & (c("late_lift") > 0)
    return table.withColumn("status", F.when((c("n_f") < least) | (c("n_u") < least), "inconclusive").when(good, "passed").otherwise("failed"))


def stable(folds: DataFrame, whole: DataFrame, count: int = 5, floors: dict[str, float] | None = None) -> DataFrame:
    """(symbol, folds, passed, failed, inconclusive, decision) from judged folds and the symbol's whole comparison: inconclusive with a fold that is or is missing, rejected
    if any fold failed or the whole misses the floors of lift or ratio, else tested."""
    f = FLOORS | (floors or {})
    of = lambda s: F.count_if(c("status") == s).alias(s)
    t = folds.groupBy("symbol").agg(F.count(F.lit(1)).alias("folds"), of("passed"), of("failed"), of("inconclusive"))
    t = t.join(whole.select("symbol", F.coalesce((c("lift") >= f["lift"]) & (c("ratio") >= f["ratio"]), F.lit(False)).alias("_good")), "symbol")
    decision = F.when((c("inconclusive") > 0) | (c("folds") < count), "inconclusive").when((c("failed") > 0) | ~c("_good"), "rejected").otherwise("tested")
    return t.withColumn("decision", decision).drop("_good")
