"""Anchors on a grid of rows: outcomes at several horizons that don't overlap, in strata of time and blocks, and what they tell about states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..frames import numbered, seconds
from ..functions.indicators import c
from ..functions.quantiles import exact_quantiles
from .assays import with_ahead


def anchors(ticks: DataFrame, horizons: tuple[int, ...], apart: int, entry: int = 0, trail: int = 0, gap_s: float = 3600, parts: int = 3, block: int = 100) -> DataFrame:
    """(symbol, horizon, row, ts, part, block, gap_clear, and in cents bid_move, ask_move, since_s, trail_c, move_c, later_c, cost_c) of every anchor: a row every
    horizon + apart rows, from the first that has one stride and `trail` rows before it to the last that has its outcome.

    Entry is `entry` rows after the anchor and exit `horizon` rows later; move_c is the mid's move between them, later_c the same a row later (null at the end), cost_c the mean
    spread of both. bid_move and ask_move are the moves since the row before, since_s the seconds, trail_c the mid's move over `trail` rows. part: thirds (or
    `parts`) of the symbol's time; block: stretches of `block` anchors. gap_clear: no two rows from the anchor to the exit are gap_s or more apart. All horizons
    come from one numbering, in stretches of rows with borders, so a symbol is many tasks.
    """
    w = Window.partitionBy("symbol", "stretch").orderBy("row")
    s = with_ahead(numbered(ticks).select("symbol", "row", "ts", "bid_c", "ask_c"), max(horizons) + entry + 1, max(trail, 1))
    s = s.withColumns({"mid2": c("bid_c") + c("ask_c"), "spread": c("ask_c") - c("bid_c"), "since_s": seconds("ts") - seconds(F.lag("ts").over(w))})
    s = s.withColumns({"gap": F.coalesce((c("since_s") >= gap_s).cast("int"), F.lit(0)), "bid_move": c("bid_c") - F.lag("bid_c").over(w), "ask_move": c("ask_c") - F.lag("ask_c").over(w)})
    at = lambda x, k: F.lead(x, k).over(w) if k else c(x)
    trailing = (c("mid2") - F.lag("mid2", trail).over(w)) / 2 if trail else F.lit(None).cast("double")
    out = lambda h: F.struct(
        F.lit(h).alias("horizon"), ((at("mid2", entry + h) - at("mid2", entry)) / 2).alias("move_c"), ((at("mid2", entry + h + 1) - at("mid2", entry + 1)) / 2).alias("later_c"),
        ((at("spread", entry + h) + at("spread", entry)) / 2).alias("cost_c"), (F.sum("gap").over(w.rowsBetween(1, entry + h)) == 0).alias("gap_clear"),
    )
    s = s.withColumns({"trail_c": trailing, "ends": F.array(*[out(h) for h in horizons])}).where("own")
    s = s.select("symbol", "row", "ts", "bid_move", "ask_move", "since_s", "trail_c", F.explode("ends").alias("e")).select("symbol", "row", "ts", "bid_move", "ask_move", "since_s", "trail_c", "e.*")
    stride = c("horizon") + apart
    s = s.where((c("row") % stride == 0) & (c("row") >= stride + trail) & c("move_c").isNotNull())
    span = ticks.groupBy("symbol").agg(F.unix_micros(F.min("ts").cast("timestamp")).alias("_from"), F.unix_micros(F.max("ts").cast("timestamp")).alias("_to"))
    part = F.floor((F.unix_micros(c("ts").cast("timestamp")) - c("_from")) * parts / (c("_to") + 1 - c("_from"))).cast("int")
    return s.join(F.broadcast(span), "symbol").withColumns({"part": part, "block": F.floor(F.floor(c("row") / stride) / block)}).drop("_from", "_to")


def two_states(events: DataFrame, a: Column, b: Column, keys: tuple[str, ...] = ("symbol", "horizon")) -> DataFrame:
    """(keys, n_a, n_b, mean_a, mean_b, ratio, gap, p_a, p_b, lift): absolute moves in two states, and how often they exceed the cost."""
    move, over = F.abs("move_c"), (F.abs("move_c") > c("cost_c")).cast("double")
    e = events.withColumns({"_a": F.coalesce(a, F.lit(False)), "_b": F.coalesce(b, F.lit(False))})
    of = lambda x, s: F.avg(F.when(c(s), x))
    t = e.groupBy(*keys).agg(F.count_if("_a").alias("n_a"), F.count_if("_b").alias("n_b"), of(move, "_a").alias("mean_a"), of(move, "_b").alias("mean_b"), of(over, "_a").alias("p_a"), of(over, "_b").alias("p_b"))
    return t.withColumns({"ratio": c("mean_a") / F.nullif("mean_b", F.lit(0.0)), "gap": c("mean_a") - c("mean_b"), "lift": c("p_a") - c("p_b")})


def opposed(events: DataFrame, up: Column, down: Column) -> DataFrame:
    """events in two states that foretell opposite moves, as state (1 or -1), gross_c (the move in the foretold direction) and net_c."""
    state = F.when(up, 1).when(down, -1)
    e = events.withColumn("state", state).where("state IS NOT NULL")
    return e.withColumn("gross_c", c("state") * c("move_c")).withColumn("net_c", c("gross_c") - c("cost_c"))


def family_sums(events: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Sums of opposed() events that family() needs; they add up over blocks, parts and draws."""
    both = {"a": c("state") == 1, "b": c("state") == -1}
    each = [x for k, s in both.items() for x in (F.count_if(s).alias(f"n_{k}"), F.count_if(s & (c("gross_c") > 0)).alias(f"right_{k}"), F.sum(F.when(s, c("gross_c")).otherwise(0)).alias(f"gross_{k}"), F.sum(F.when(s, c("net_c")).otherwise(0)).alias(f"net_{k}"))]
    return events.groupBy(*keys).agg(*each)


def family(sums: DataFrame) -> DataFrame:
    """Adds what family_sums() tell of a pair of states: mean_gross, mean_net and match of each, lift (both matches less one: up after the one less up after the other), pooled_net. Null where a state has no events."""
    of = lambda x, k: c(f"{x}_{k}") / F.nullif(c(f"n_{k}"), F.lit(0))
    t = sums.withColumns({f"{name}_{k}": of(x, k) for name, x in (("mean_gross", "gross"), ("mean_net", "net"), ("match", "right")) for k in "ab"})
    return t.withColumns({"lift": c("match_a") + c("match_b") - 1, "pooled_net": (c("mean_net_a") + c("mean_net_b")) / 2})


def stratified_draws(sums: DataFrame, draws: int, seed: int = 0, keys: tuple[str, ...] = ("symbol", "horizon")) -> DataFrame:
    """family_sums() of every draw: in each part of the keys as many blocks as it has are drawn with replacement, by a hash of (seed, draw, part, place). sums: by (keys, part, block).

    Every block's place brings its own draws, so they are made where the blocks are; draws and blocks meet by a shuffle, as both grow with the data and neither may be sent through the driver."""
    group = Window.partitionBy(*keys, "part")
    placed = sums.withColumns({"_i": F.row_number().over(group.orderBy("block")) - 1, "_n": F.count(F.lit(1)).over(group)})
    drawn = placed.select(*keys, "part", "_n", c("_i").alias("_b")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    pick = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "draw", "part", "_b")), 1, 12), 16, 10).cast("long"), c("_n")).cast("int")
    values = [x for x in sums.columns if x not in (*keys, "part", "block")]
    both = drawn.select(*keys, "part", "draw", pick.alias("_i")).hint("merge").join(placed.select(*keys, "part", "_i", *values), [*keys, "part", "_i"])
    return both.groupBy(*keys, "draw").agg(*[F.sum(v).alias(v) for v in values])


def lift_interval(draws: DataFrame, keys: tuple[str, ...] = ("symbol", "horizon")) -> DataFrame:
    """(keys, draws, low, high, share_up): the middle 90 % of the drawn lifts, and how many are above 0; draws without a lift don't count."""
    q = F.percentile("lift", F.array(F.lit(0.05), F.lit(0.95)))
    t = family(draws).where("lift IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("draws"), q.alias("_q"), F.avg((c("lift") > 0).cast("double")).alias("share_up"))
    return t.select(*keys, "draws", F.get("_q", F.lit(0)).alias("low"), F.get("_q", F.lit(1)).alias("high"), "share_up")


def walk_forward(events: DataFrame) -> DataFrame:
    """two_states() of each part for large and small trailing moves: at or above the part's own upper third, and at or below its lower; nothing of other parts sets its borders."""
    keys = ["symbol", "horizon", "part"]
    e = events.withColumn("size", F.abs("trail_c"))
    borders = exact_quantiles(e, keys, "size", {"lower": 1 / 3, "upper": 2 / 3})
    return two_states(e.join(borders, keys), c("size") >= c("upper"), c("size") <= c("lower"), tuple(keys))


def directional_panel(ticks: DataFrame, past: int = 16, horizons: tuple[int, ...] = (1, 4, 16)) -> DataFrame:
    """(symbol, side, horizon, n, mean_move_c, mean_net_c): moves after past moves of a sign; entry one row later, anchors horizon + past + 2 rows apart, cost the mean spread of both ends."""
    e = anchors(ticks, horizons, past + 2, entry=1, trail=past).withColumn("side", F.signum("trail_c").cast("int")).where("side != 0")
    move = c("side") * c("move_c")
    return e.groupBy("symbol", "side", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg(move).alias("mean_move_c"), F.avg(move - c("cost_c")).alias("mean_net_c"))
