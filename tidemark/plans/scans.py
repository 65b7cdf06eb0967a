"""Queries over grids of anchors, exact ranks and forecasts, with their twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..frames import shared_dir
from ..functions import prequential
from ..functions.indicators import c
from ..functions.quantiles import exact_quantiles
from ..operators import assays, grid, lifecycle
from ..sources import market
from ..streaming import observe
from .market import NUMBERED, query, six


def grid_sql(horizons: tuple[int, ...], apart: int, entry: int = 0, trail: int = 0, parts: int = 3, block: int = 100) -> str:
    """anc: the rows of grid.anchors()."""
    each = " UNION ALL ".join(
        f"""SELECT symbol, {h} AS horizon, row, ts, bid_move, ask_move, since_s, trail_c, (lead(m2, {h + entry}) OVER w - lead(m2, {entry}) OVER w) / 2 AS move_c, (lead(sp, {h + entry}) OVER w + lead(sp, {entry}) OVER w) / 2 AS cost_c,
  coalesce(sum(gap) OVER (PARTITION BY symbol ORDER BY row ROWS BETWEEN 1 FOLLOWING AND {h + entry} FOLLOWING), 0) = 0 AS gap_clear FROM moved WINDOW w AS (PARTITION BY symbol ORDER BY row)"""
        for h in horizons
    )
    trailing = f"(m2 - lag(m2, {trail}) OVER w) / 2" if trail else "NULL"
    return NUMBERED + f""", m2 AS (SELECT *, (bid_c + ask_c)::DOUBLE AS m2, (ask_c - bid_c)::DOUBLE AS sp FROM num),
m3 AS (SELECT *, epoch_us(ts - lag(ts) OVER w) / 1e6 AS since_s, bid_c - lag(bid_c) OVER w AS bid_move, ask_c - lag(ask_c) OVER w AS ask_move, {trailing} AS trail_c FROM m2 WINDOW w AS (PARTITION BY symbol ORDER BY row)),
moved AS (SELECT *, CASE WHEN since_s >= 3600 THEN 1 ELSE 0 END AS gap FROM m3),
ends AS ({each}),
span AS (SELECT symbol, min(epoch_us(ts)) AS f, max(epoch_us(ts)) AS t FROM ticks GROUP BY symbol),
anc AS (SELECT e.*, floor((epoch_us(ts) - f) * {parts} / (t + 1 - f)::DOUBLE)::INT AS part, (row // (horizon + {apart})) // {block} AS block FROM ends e JOIN span USING (symbol)
  WHERE row % (horizon + {apart}) = 0 AND row >= horizon + {apart} + {trail} AND move_c IS NOT NULL)
"""


def two_states_sql(a: str, b: str, keys: str, source: str = "anc") -> str:
    return f"""SELECT {keys}, count(*) FILTER ({a}) AS n_a, count(*) FILTER ({b}) AS n_b, {six(f"avg(abs(move_c)) FILTER ({a})")} AS mean_a, {six(f"avg(abs(move_c)) FILTER ({b})")} AS mean_b,
  {six(f"avg(abs(move_c)) FILTER ({a}) / nullif(avg(abs(move_c)) FILTER ({b}), 0)")} AS ratio, {six(f"avg(abs(move_c)) FILTER ({a}) - avg(abs(move_c)) FILTER ({b})")} AS gap,
  {six(f"avg((abs(move_c) > cost_c)::INT) FILTER ({a})")} AS p_a, {six(f"avg((abs(move_c) > cost_c)::INT) FILTER ({b})")} AS p_b,
  {six(f"avg((abs(move_c) > cost_c)::INT) FILTER ({a}) - avg((abs(move_c) > cost_c)::INT) FILTER ({b})")} AS lift FROM {source} GROUP BY {keys}"""


#: Opposed states: quotes that widened foretell a rise, quotes that tightened a fall.
FAMILY = """, opp AS (SELECT *, CASE WHEN ask_move > bid_move THEN 1 WHEN ask_move < bid_move THEN -1 END AS state FROM anc), ev AS (SELECT *, state * move_c AS gross, state * move_c - cost_c AS net FROM opp WHERE state IS NOT NULL)
"""
SUMS = "count(*) FILTER (state = 1) AS n_a, count(*) FILTER (state = -1) AS n_b, count(*) FILTER (state = 1 AND gross > 0) AS right_a, count(*) FILTER (state = -1 AND gross > 0) AS right_b, coalesce(sum(gross) FILTER (state = 1), 0) AS gross_a, coalesce(sum(gross) FILTER (state = -1), 0) AS gross_b, coalesce(sum(net) FILTER (state = 1), 0) AS net_a, coalesce(sum(net) FILTER (state = -1), 0) AS net_b"


def spread_events(spark, d):
    e = grid.anchors(market.ticks(spark, d), (4, 16), 2, entry=1)
    return grid.opposed(e, c("ask_move") > c("bid_move"), c("ask_move") < c("bid_move"))


@query(grid_sql((1, 4, 16), 18, 1, 16) + f"""SELECT symbol, sign(trail_c)::INT AS side, horizon, count(*) AS n, {six("avg(sign(trail_c) * move_c)")} AS mean_move_c, {six("avg(sign(trail_c) * move_c - cost_c)")} AS mean_net_c FROM anc WHERE trail_c <> 0 GROUP BY ALL""")
def directional_panel(spark, d):
    return grid.directional_panel(market.ticks(spark, d))


@query(grid_sql((4, 16), 2, 1) + FAMILY + f""", f AS (SELECT symbol, horizon, part, {SUMS} FROM ev WHERE gap_clear GROUP BY ALL)
SELECT symbol, horizon, part, n_a, n_b, {six("gross_a / nullif(n_a, 0)")} AS mean_gross_a, {six("gross_b / nullif(n_b, 0)")} AS mean_gross_b, {six("net_a / nullif(n_a, 0)")} AS mean_net_a, {six("net_b / nullif(n_b, 0)")} AS mean_net_b,
  {six("right_a / nullif(n_a, 0)")} AS match_a, {six("right_b / nullif(n_b, 0)")} AS match_b, {six("right_a / nullif(n_a, 0) + right_b / nullif(n_b, 0) - 1")} AS lift, {six("(net_a / nullif(n_a, 0) + net_b / nullif(n_b, 0)) / 2")} AS pooled_net FROM f""")
def spread_state_panel(spark, d):
    """Widened quotes against tightened ones, by thirds of time, where no gap lies before the exit."""
    f = grid.family(grid.family_sums(spread_events(spark, d).where("gap_clear"), ("symbol", "horizon", "part")))
    return f.drop("right_a", "right_b", "gross_a", "gross_b", "net_a", "net_b")


@query(grid_sql((4, 16), 2, 1, block=5) + FAMILY + f""", s AS (SELECT symbol, horizon, part, block, {SUMS} FROM ev GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY symbol, horizon, part ORDER BY block) - 1 AS i, count(*) OVER (PARTITION BY symbol, horizon, part) AS n FROM s),
z AS (SELECT DISTINCT symbol, horizon, part, n FROM p), dr AS (SELECT symbol, horizon, part, draw, unnest(generate_series(0, n - 1)) AS b, n FROM z, (SELECT unnest(generate_series(0, 49)) AS draw)),
x AS (SELECT dr.symbol, dr.horizon, draw, sum(n_a) AS n_a, sum(n_b) AS n_b, sum(right_a) AS ra, sum(right_b) AS rb FROM dr JOIN p ON p.symbol = dr.symbol AND p.horizon = dr.horizon AND p.part = dr.part AND p.i = ('0x' || substr(md5('0:' || draw || ':' || dr.part || ':' || b), 1, 12))::BIGINT % dr.n GROUP BY ALL),
l AS (SELECT symbol, horizon, ra / nullif(n_a, 0) + rb / nullif(n_b, 0) - 1 AS lift FROM x)
SELECT symbol, horizon, count(*) AS draws, {six("quantile_cont(lift, 0.05)")} AS low, {six("quantile_cont(lift, 0.95)")} AS high, {six("avg((lift > 0)::INT)")} AS share_up FROM l WHERE lift IS NOT NULL GROUP BY ALL""")
def spread_lift_interval(spark, d):
    """Lifts of widened against tightened quotes when blocks of anchors are drawn again inside thirds of time."""
    e = grid.anchors(market.ticks(spark, d), (4, 16), 2, entry=1, block=5)
    e = grid.opposed(e, c("ask_move") > c("bid_move"), c("ask_move") < c("bid_move"))
    return grid.lift_interval(grid.stratified_draws(grid.family_sums(e, ("symbol", "horizon", "part", "block")), 50))


ACTIVE, QUIET, HIGH = 600, 1200, 20000


@query(grid_sql((4, 16), 1, 0, 16) + two_states_sql(f"abs(trail_c) >= {HIGH} AND since_s > 0 AND since_s <= {ACTIVE}", f"abs(trail_c) >= {HIGH} AND since_s > {QUIET}", "symbol, horizon, part"))
def activity_panel(spark, d):
    """After large trailing moves: rows that came soon after the one before, against rows that came late."""
    e = grid.anchors(market.ticks(spark, d), (4, 16), 1, trail=16)
    high = F.abs("trail_c") >= HIGH
    return grid.two_states(e, high & (c("since_s") > 0) & (c("since_s") <= ACTIVE), high & (c("since_s") > QUIET), ("symbol", "horizon", "part"))


@query(grid_sql((4, 16), 1, 0, 16) + two_states_sql("abs(trail_c) >= 20000", "abs(trail_c) < 20000", "symbol, horizon"))
def move_size_panel(spark, d):
    """Rows after large trailing moves against rows after small ones."""
    e = grid.anchors(market.ticks(spark, d), (4, 16), 1, trail=16)
    return grid.two_states(e, F.abs("trail_c") >= HIGH, F.abs("trail_c") < HIGH)


@query(grid_sql((4, 16), 1, 0, 16, parts=5) + ", b AS (SELECT symbol, horizon, part, quantile_cont(abs(trail_c), 1 / 3.0) AS lo, quantile_cont(abs(trail_c), 2 / 3.0) AS hi FROM anc GROUP BY ALL), j AS (SELECT anc.*, lo, hi FROM anc JOIN b USING (symbol, horizon, part))\n" + two_states_sql("abs(trail_c) >= hi", "abs(trail_c) <= lo", "symbol, horizon, part", "j"))
def walk_forward_panel(spark, d):
    """Five folds of time; large and small trailing moves by each fold's own thirds."""
    return grid.walk_forward(grid.anchors(market.ticks(spark, d), (4, 16), 1, trail=16, parts=5))


@query(NUMBERED + f""", p AS (SELECT symbol, row, mid_c, list(mid_c) OVER (PARTITION BY symbol ORDER BY row ROWS BETWEEN 1 FOLLOWING AND 4096 FOLLOWING) AS path FROM num),
h AS (SELECT *, list_position(list_transform(path, lambda m: abs(m - mid_c) >= 30000), true) AS pos FROM p)
SELECT symbol, sign(path[pos] - mid_c)::INT AS hit, count(*) AS n, {six("quantile_cont(pos, 0.5)")} AS median_rows FROM h WHERE pos > 0 GROUP BY ALL""")
def passage_medians(spark, d):
    """The median number of rows until the mid has moved, for each side that was hit."""
    hits = assays.first_passage(market.ticks(spark, d), 30000, 4096).where("hit_rows IS NOT NULL")
    n = hits.groupBy("symbol", "hit").agg(F.count(F.lit(1)).alias("n"))
    return n.join(exact_quantiles(hits, ["symbol", "hit"], "hit_rows", {"median_rows": 0.5}), ["symbol", "hit"])


DEALS = """, dl AS (SELECT l_orderkey AS position_key, l_shipdate AS ts, l_linenumber AS seq, l_linenumber % 2 = 1 AS is_entry, CASE WHEN (l_linenumber % 2 = 1) <> (l_returnflag = 'R') THEN 'buy' ELSE 'sell' END AS side, 1 + l_quantity::BIGINT % 2 AS qty, round(l_extendedprice / l_quantity * 100)::BIGINT AS price, round(l_discount * 100)::BIGINT AS gross, -round(l_tax * 100)::BIGINT AS charge FROM lineitem),
dn AS (SELECT *, row_number() OVER (PARTITION BY position_key ORDER BY ts, seq) AS n, sum(CASE WHEN is_entry THEN qty ELSE -qty END) OVER (PARTITION BY position_key ORDER BY ts, seq) AS o FROM dl),
d1 AS (SELECT position_key, min(n) FILTER (is_entry) AS fi, min(n) FILTER (NOT is_entry) AS fo, arg_min(side, n) FILTER (is_entry) AS fs FROM dn GROUP BY 1),
d2 AS (SELECT dn.*, CASE WHEN is_entry THEN CASE WHEN n > fo THEN 'entry_after_exit' WHEN side <> fs THEN 'entry_sides_differ' END ELSE CASE WHEN fi IS NULL OR fi > n OR side = fs THEN 'wrong_exit' WHEN o < 0 THEN 'exit_too_large' END END AS broken FROM dn JOIN d1 USING (position_key)),
d3 AS (SELECT position_key, arg_min(broken, n) FILTER (broken IS NOT NULL) AS broken, count(*) AS deals, count(*) FILTER (NOT is_entry) AS exits, coalesce(sum(qty) FILTER (is_entry), 0)::BIGINT AS qty_in, coalesce(sum(qty) FILTER (NOT is_entry), 0)::BIGINT AS qty_out, coalesce(sum(qty * price) FILTER (is_entry), 0) AS paid, coalesce(sum(qty * price) FILTER (NOT is_entry), 0) AS got, sum(gross) AS gross, sum(charge) AS charges FROM d2 GROUP BY 1)
"""


def deals(spark, d):
    """Deals of lineitem: an order is a position, odd lines enter and even ones leave; returned lines are on the other side."""
    t = market.table(spark, d, "lineitem")
    entry = c("l_linenumber") % 2 == 1
    cents = lambda x: F.round(x * 100).cast("long")
    return t.select(c("l_orderkey").alias("position_key"), c("l_shipdate").alias("ts"), c("l_linenumber").alias("seq"), entry.alias("is_entry"), F.when(entry != (c("l_returnflag") == "R"), "buy").otherwise("sell").alias("side"), (1 + c("l_quantity").cast("long") % 2).alias("qty"), cents(c("l_extendedprice") / c("l_quantity")).alias("price"), cents(c("l_discount")).alias("gross"), (-cents(c("l_tax"))).alias("charge"))


@query(DEALS + f"""SELECT position_key, coalesce(broken, CASE WHEN exits = 0 OR qty_in <> qty_out THEN 'not_closed' WHEN exits > 1 THEN 'complete_in_parts' ELSE 'complete' END) AS status, deals, qty_in, qty_out, {six("paid / nullif(qty_in, 0)")} AS entry_price, {six("got / nullif(qty_out, 0)")} AS exit_price,
  gross::BIGINT AS gross, (charges + coalesce(late, 0))::BIGINT AS charges, (gross + charges + coalesce(late, 0))::BIGINT AS net, late IS NOT NULL AS revised
FROM d3 LEFT JOIN (SELECT o_orderkey AS position_key, -round(o_totalprice / 1e4)::BIGINT AS late FROM orders WHERE o_orderstatus = 'F') USING (position_key)""")
def round_trips(spark, d):
    """Every order's lines as one position, with what makes it unfit to count; finished orders bring a late charge."""
    late = market.table(spark, d, "orders").where("o_orderstatus = 'F'").select(c("o_orderkey").alias("position_key"), (-F.round(c("o_totalprice") / 1e4)).cast("long").alias("charge"))
    return lifecycle.with_late_charges(lifecycle.round_trips(deals(spark, d)), late)


@query(DEALS + f"""SELECT side, sum(qty)::BIGINT AS qty, sum(charge)::BIGINT AS charge, {six("sum(charge) / nullif(sum(qty), 0)")} AS per_lot FROM dl GROUP BY side""")
def charge_per_lot(spark, d):
    return lifecycle.charge_per_lot_side(deals(spark, d))


@query(""", a AS (SELECT session, seq, CASE WHEN mid_c <= 1000 THEN 'VALIDATION_REJECTED' WHEN row_number() OVER (PARTITION BY mid_c > 1000, session, ts::DATE ORDER BY ts, seq) > 1 THEN 'DUPLICATE' ELSE 'STORED' END AS o FROM ticks)
SELECT session, count(*) AS attempts, 0::BIGINT AS session_start, count(*) FILTER (o = 'STORED') AS stored, count(*) FILTER (o = 'DUPLICATE') AS duplicate, count(*) FILTER (o = 'VALIDATION_REJECTED') AS validation_rejected, 0::BIGINT AS retrieval_error, 0::BIGINT AS storage_error, 0::BIGINT AS unresolved,
  true AS balanced, count(*) FILTER (o = 'STORED') AS store_rows, 0::BIGINT AS missing, 0::BIGINT AS orphans, true AS agree FROM a GROUP BY session""")
def attempt_outcomes(spark, d):
    """Each tick is an attempt to store a session's quote of the day; low prices are refused."""
    stream = observe.tick_stream(spark, d).withColumn("day", F.to_date("ts"))
    attempts, rows = observe.record_attempts(stream, shared_dir(spark), f"attempts-{uuid.uuid4().hex}", ["session", "day"], c("mid_c") > 1000)
    return observe.reconcile_attempts(attempts, rows)


@query()
def monthly_forecasts(spark, d):
    """Forecasts of each priority's mean order price, month by month; the slope is that of largest to mean price."""
    o = market.table(spark, d, "orders").groupBy(c("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").cast("timestamp_ntz").alias("ts"))
    daily = o.agg(F.avg("o_totalprice").alias("close"), F.log(F.max("o_totalprice") / F.avg("o_totalprice")).alias("value"))
    monthly = prequential.monthly_features(daily.select("symbol", "ts", "close"), daily.select("symbol", "ts", "value"))
    return prequential.prequential_ridge(monthly, lookback=60, least=24)
