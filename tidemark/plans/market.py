"""Queries over the tables of a folder, each with the DuckDB SQL that gives the same rows (doubles rounded to six digits)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import along, shared_dir
from ..functions import clock, inference, placebo
from ..functions.indicators import back, c, channel, ema, rolling_ols_z, rolling_quantile, rolling_z, rsi, simple_return, sma, trailing_percentile, true_range
from ..operators import assays, backtest, ledger, quality, signals
from ..operators.asof import asof
from ..operators.resample import complete, quote_bars, resample, ticks_to_bars, trading_days
from ..sources import market
from ..streaming import observe

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

YEAR = 1460.0
COST = 2.0

PRELUDE = """WITH RECURSIVE t0 AS (SELECT event_type AS symbol, ts, event_id AS seq, user_id AS session, round(value * 100)::BIGINT AS mid_c FROM events),
ticks AS (SELECT *, mid_c - greatest(1, mid_c * 2 // 10000) AS bid_c, mid_c + greatest(1, mid_c * 2 // 10000) AS ask_c FROM t0),
bars AS (SELECT symbol, b AS ts, first(mid_c ORDER BY ts, seq) / 100::DOUBLE AS open, max(mid_c) / 100::DOUBLE AS high, min(mid_c) / 100::DOUBLE AS low, last(mid_c ORDER BY ts, seq) / 100::DOUBLE AS close, count(*)::DOUBLE AS volume
  FROM (SELECT *, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS b FROM ticks) GROUP BY symbol, b),
q0 AS (SELECT *, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '1970-01-01') AS b FROM ticks),
quotes AS (SELECT symbol, b AS ts, first(bid_c ORDER BY ts, seq) AS open_bid, first(ask_c ORDER BY ts, seq) AS open_ask, last(bid_c ORDER BY ts, seq) AS close_bid, last(ask_c ORDER BY ts, seq) AS close_ask, max(ask_c) AS high_ask, min(bid_c) AS low_bid, avg(ask_c - bid_c) AS mean_spread FROM q0 GROUP BY symbol, b),
fills AS (SELECT l_suppkey AS position_key, l_orderkey * 8 + l_linenumber AS seq, l_shipdate AS ts, CASE WHEN l_linenumber % 2 = 1 THEN 'buy' ELSE 'sell' END AS side, l_quantity::BIGINT AS qty, round(l_extendedprice / l_quantity * 100)::BIGINT AS price_c FROM lineitem)
"""
#: Moving-average rule on 6-hour bars: r, held, net.
RUN = """, s0 AS (SELECT *, close / lag(close) OVER w - 1 AS r, CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) = 20 THEN sign(avg(close) OVER (w ROWS 4 PRECEDING) - avg(close) OVER (w ROWS 19 PRECEDING)) END AS position FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
s1 AS (SELECT *, coalesce(lag(position) OVER w, 0)::DOUBLE AS held FROM s0 WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
s2 AS (SELECT *, abs(held - coalesce(lag(held) OVER w, 0)) AS traded FROM s1 WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
run AS (SELECT *, held * r - traded * 2 / 1e4 AS net, traded * 2 / 1e4 AS cost FROM s2)
"""


def six(x: str) -> str:
    return f"round(({x})::DOUBLE, 6) + 0::DOUBLE"


def product(over: str = "") -> str:
    """Product of 1 + net in SQL, with signs."""
    return f"CASE WHEN count(*) FILTER (1 + net = 0) {over} > 0 THEN 0 ELSE exp(sum(ln(nullif(abs(1 + net), 0))) {over}) * CASE WHEN (count(*) FILTER (1 + net < 0) {over}) % 2 = 1 THEN -1 ELSE 1 END END"


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) + F.lit(0.0) for n, t in df.dtypes if t == "double"})


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE[f.__name__] = PRELUDE + sql
        return f

    return add


def bars6(spark: SparkSession, d: str) -> DataFrame:
    return ticks_to_bars(market.ticks(spark, d))


def sma_run(spark: SparkSession, d: str) -> DataFrame:
    return backtest.run_vector(bars6(spark, d).withColumn("position", signals.sma_cross(5, 20)), "position", COST)


W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"


@query(RUN + f""", i AS (SELECT *, CASE WHEN lag(held) OVER w IS DISTINCT FROM held OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM run WHERE net IS NOT NULL {W}),
e AS (SELECT *, sum(new) OVER w AS island, {product("OVER w")} AS equity FROM i {W}),
m AS (SELECT *, 1 - equity / greatest(1.0, max(equity) OVER w) AS dd FROM e {W})
SELECT symbol, count(*) AS n_bars, {six(product() + " - 1")} AS total_return, {six(f"coalesce(avg(net) / nullif(stddev_samp(net), 0) * sqrt({YEAR}), 0)")} AS sharpe,
  {six(f"coalesce(avg(net) / nullif(stddev_samp(net) FILTER (net < 0), 0) * sqrt({YEAR}), 0)")} AS sortino, {six("max(dd)")} AS max_drawdown, {six("sum(greatest(net, 0)) / nullif(-sum(least(net, 0)), 0)")} AS profit_factor,
  {six("avg((net > 0)::INT)")} AS win_rate, {six("avg((held <> 0)::INT)")} AS exposure, {six("sum(traded)")} AS turnover, count(DISTINCT CASE WHEN held <> 0 THEN island END) AS trades FROM m GROUP BY symbol""")
def flagship_sma_backtest(spark, d):
    return backtest.metrics(sma_run(spark, d), YEAR)


@query(RUN + f"SELECT symbol, date_trunc('month', ts)::DATE AS period, count(*) AS n_bars, {six(product() + ' - 1')} AS total_return FROM run WHERE net IS NOT NULL GROUP BY ALL")
def returns_by_month(spark, d):
    return backtest.by_period(sma_run(spark, d))


@query(RUN + f"SELECT symbol, CASE WHEN held > 0 THEN 'long' WHEN held < 0 THEN 'short' ELSE 'flat' END AS side, count(*) AS n_bars, {six('sum(net)')} AS net, {six('sum(cost)')} AS cost FROM run WHERE net IS NOT NULL GROUP BY ALL")
def returns_by_side(spark, d):
    return backtest.by_side(sma_run(spark, d))


@query(RUN + f""", a AS (SELECT symbol, count(*) AS n, regr_slope(net, r) AS beta, regr_intercept(net, r) AS a, regr_syy(net, r) AS syy, regr_sxy(net, r) AS sxy FROM run WHERE net IS NOT NULL AND r IS NOT NULL GROUP BY symbol)
SELECT symbol, n, {six("beta")} AS beta, {six(f"a * {YEAR}")} AS alpha, {six("a / nullif(sqrt(greatest(syy - beta * sxy, 0) / (n - 1)) / sqrt(n), 0)")} AS alpha_t FROM a WHERE n >= 30""")
def alpha_of_sma(spark, d):
    return backtest.alpha(sma_run(spark, d), YEAR)


@query(RUN + f""", u AS (SELECT symbol, ts, net, net - avg(net) OVER (PARTITION BY symbol) AS u FROM run WHERE net IS NOT NULL),
l AS (SELECT symbol, net, u * u AS u0, {", ".join(f"u * lag(u, {k}) OVER w AS u{k}" for k in range(1, 6))} FROM u {W})
SELECT symbol, count(*) AS n, {six("avg(net)")} AS mean, {six("avg(net) / nullif(sqrt(greatest(sum(u0) + " + " + ".join(f"2 * (1 - {k} / 6::DOUBLE) * coalesce(sum(u{k}), 0)" for k in range(1, 6)) + ", 0)) / count(*), 0)")} AS t FROM l GROUP BY symbol""")
def newey_west_mean(spark, d):
    return backtest.newey_west(sma_run(spark, d))


@query(RUN + f""", x AS (SELECT *, unnest([0.0, 1.0, 2.0, 5.0])::DOUBLE AS cost_multiple FROM s2), y AS (SELECT *, held * r - traded * cost_multiple * 2 / 1e4 AS net FROM x)
SELECT symbol, cost_multiple, count(*) AS n_bars, {six(product() + " - 1")} AS total_return FROM y WHERE net IS NOT NULL GROUP BY ALL""")
def cost_stress(spark, d):
    p = bars6(spark, d).withColumn("position", signals.sma_cross(5, 20))
    return backtest.stress(p, "position", COST, [0, 1, 2, 5], YEAR).select("symbol", "cost_multiple", "n_bars", "total_return")


@query("SELECT * FROM bars")
def bars_6h(spark, d):
    return bars6(spark, d)


@query("""SELECT symbol, b AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume, count(*) AS n_bars
FROM (SELECT *, time_bucket(INTERVAL '7 days', ts, TIMESTAMP '1970-01-04') AS b FROM bars) GROUP BY symbol, b""")
def bars_weekly(spark, d):
    return resample(bars6(spark, d), "7 days", "3 days")


@query("""SELECT symbol, b AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume, count(*) AS n_bars
FROM (SELECT *, date_trunc('day', ts)::TIMESTAMP AS b FROM bars) GROUP BY symbol, b HAVING count(*) = 4""")
def bars_daily_complete(spark, d):
    return complete(bars6(spark, d), "1 day", 4)


@query("""SELECT symbol, (ts + INTERVAL '7 hours')::DATE AS ts, first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume, count(*) AS n_bars
FROM bars b GROUP BY symbol, (b.ts + INTERVAL '7 hours')::DATE HAVING count(*) >= 3""")
def bars_trading_days(spark, d):
    return trading_days(bars6(spark, d), 7, 3)


@query(f"SELECT * REPLACE ({six('mean_spread')} AS mean_spread) FROM quotes")
def bars_quotes_15m(spark, d):
    return quote_bars(market.ticks(spark, d))


def _closes(spark, d):
    """Daily closes, known from the day's end on."""
    days = resample(bars6(spark, d), "1 day")
    return days.select("symbol", (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"), F.col("close").alias("value"))


CLOSES = ", closes AS (SELECT symbol, b + INTERVAL '1 day' AS ts, last(close ORDER BY ts) AS value FROM (SELECT *, date_trunc('day', ts)::TIMESTAMP AS b FROM bars) GROUP BY symbol, b)\n"


@query(CLOSES + "SELECT t.symbol, t.seq, t.ts, c.value, c.ts AS matched_ts FROM ticks t ASOF LEFT JOIN closes c ON t.symbol = c.symbol AND t.ts >= c.ts")
def asof_backward(spark, d):
    return asof(market.ticks(spark, d).select("symbol", "seq", "ts"), _closes(spark, d))


@query(CLOSES + ", m AS (SELECT b.symbol, b.ts, c.value, c.ts AS c FROM bars b ASOF LEFT JOIN closes c ON b.symbol = c.symbol AND b.ts > c.ts) SELECT symbol, ts, CASE WHEN ts - c <= INTERVAL '12 hours' THEN value END AS value, CASE WHEN ts - c <= INTERVAL '12 hours' THEN c END AS matched_ts FROM m")
def asof_strict_tolerance(spark, d):
    return asof(bars6(spark, d).select("symbol", "ts"), _closes(spark, d), strict=True, max_age_s=43200)


GAPS = ", g0 AS (SELECT symbol, lag(ts) OVER w AS gap_start, ts AS gap_end FROM quotes WINDOW w AS (PARTITION BY symbol ORDER BY ts)), gaps AS (SELECT *, round(epoch(gap_end - gap_start) / 900)::BIGINT - 1 AS missing, dayofweek(gap_start) = 5 AND dayofweek(gap_end) IN (6, 0, 1) AND gap_end - gap_start < INTERVAL '4 days' AS expected FROM g0 WHERE gap_end - gap_start > INTERVAL '15 minutes')\n"


@query(GAPS + "SELECT * FROM gaps")
def bar_gaps(spark, d):
    return quality.gaps(quote_bars(market.ticks(spark, d)), 900)


@query(GAPS + """, s AS (SELECT symbol, count(*) AS n_gaps, sum(CASE WHEN NOT expected THEN missing ELSE 0 END)::BIGINT AS unexpected, sum(CASE WHEN expected THEN missing ELSE 0 END)::BIGINT AS closed FROM gaps GROUP BY symbol),
n AS (SELECT symbol, count(*) AS n_bars FROM quotes GROUP BY symbol) SELECT symbol, n_bars, coalesce(n_gaps, 0) AS n_gaps, coalesce(unexpected, 0) AS unexpected, coalesce(closed, 0) AS closed, coalesce(unexpected, 0) / (n_bars + coalesce(unexpected, 0)) <= 0.02 AS passed FROM n LEFT JOIN s USING (symbol)""")
def bar_gap_summary(spark, d):
    return quality.gap_summary(quote_bars(market.ticks(spark, d)), 900)


@query("""SELECT symbol, count(*) AS rows, count(*) - count(DISTINCT ts) AS duplicates, count(*) FILTER (open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL) AS unknown_price, count(*) FILTER (least(open, high, low, close) <= 0) AS not_positive,
count(*) FILTER (high < greatest(open, close, low)) AS high_below, count(*) FILTER (low > least(open, close, high)) AS low_above, count(*) FILTER ((high - low) / nullif(close, 0) > 0.1) AS wide_range, count(*) FILTER (volume < 0) AS negative_volume FROM bars GROUP BY symbol""")
def bar_checks(spark, d):
    return quality.check_bars(bars6(spark, d))


@query(f""", b AS (SELECT symbol, (ask_c - bid_c) / ((ask_c + bid_c) / 2) * 1e4 AS bps FROM ticks WHERE bid_c > 0 AND ask_c >= bid_c)
SELECT symbol, count(*) AS n, {six("min(bps)")} AS min_bps, {", ".join(f"{six(f'quantile_cont(bps, {q})')} AS {n}" for q, n in ((0.5, "p50_bps"), (0.9, "p90_bps"), (0.95, "p95_bps"), (0.99, "p99_bps")))}, {six("max(bps)")} AS max_bps, {six("avg(bps)")} AS mean_bps FROM b GROUP BY symbol""")
def spread_profile(spark, d):
    return quality.spread_profile(market.ticks(spark, d))


@query(", g AS (SELECT symbol, ts, count(*) AS n, count(DISTINCT (bid_c, ask_c)) AS d FROM ticks GROUP BY ALL) SELECT symbol, count(*) FILTER (n > 1) AS groups, sum(n)::BIGINT AS ticks, sum(n - d)::BIGINT AS repeated FROM g GROUP BY symbol")
def stamp_groups(spark, d):
    return quality.stamp_groups(market.ticks(spark, d))


@query(f", p AS (SELECT symbol, ts, seq, epoch_us(ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts, seq)) / 1e6 AS gap_s FROM ticks), r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY gap_s DESC, ts, seq)::INT AS rank FROM p WHERE gap_s > 0) SELECT symbol, rank, ts, {six('gap_s')} AS gap_s FROM r WHERE rank <= 5")
def largest_gaps(spark, d):
    return quality.largest_gaps(market.ticks(spark, d))


@query("SELECT symbol, ts::DATE AS day, count(*) AS ticks, min(ts) AS first, max(ts) AS last FROM ticks t GROUP BY symbol, t.ts::DATE")
def tick_coverage(spark, d):
    return quality.coverage(market.ticks(spark, d))


def gate(expr: str, n: int) -> str:
    return f"CASE WHEN count(*) OVER (w ROWS {n - 1} PRECEDING) = {n} THEN {expr} END"


@query(f""", p AS (SELECT *, lag(close) OVER w AS pc, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars {W})
SELECT symbol, ts, {six("close / nullif(pc, 0) - 1")} AS ret, {six("tr")} AS tr, {six(gate("avg(tr) OVER (w ROWS 13 PRECEDING)", 14))} AS atr14, {six(gate("avg(close) OVER (w ROWS 19 PRECEDING)", 20))} AS sma20,
{six(gate("(close - avg(close) OVER (w ROWS 19 PRECEDING)) / nullif(stddev_samp(close) OVER (w ROWS 19 PRECEDING), 0)", 20))} AS z20, {six(gate("quantile_cont(close, 0.25) OVER (w ROWS 19 PRECEDING)", 20))} AS q25,
CASE WHEN row_number() OVER w > 20 THEN max(high) OVER (w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) END AS top20 FROM p {W}""")
def rolling_indicators(spark, d):
    b = bars6(spark, d).withColumn("tr", true_range())
    return b.select("symbol", "ts", simple_return().alias("ret"), "tr", sma("tr", 14).alias("atr14"), sma("close", 20).alias("sma20"), rolling_z("close", 20).alias("z20"), rolling_quantile("close", 0.25, 20).alias("q25"), channel(20)[0].alias("top20"))


@query(f""", v AS (SELECT symbol, ts, close, list(close) OVER (w ROWS 39 PRECEDING) AS v FROM bars {W})
SELECT symbol, ts, {six("CASE WHEN len(v) >= 20 THEN (len(list_filter(v, lambda x: x < close)) + 0.5 * len(list_filter(v, lambda x: x = close))) / len(v) END")} AS pct FROM v""")
def trailing_rank(spark, d):
    return bars6(spark, d).select("symbol", "ts", trailing_percentile("close", 40, 20).alias("pct"))


@query(f""", o AS (SELECT *, regr_slope(close, volume) OVER (w ROWS 29 PRECEDING) AS s, regr_intercept(close, volume) OVER (w ROWS 29 PRECEDING) AS i, regr_syy(close, volume) OVER (w ROWS 29 PRECEDING) AS syy, regr_sxy(close, volume) OVER (w ROWS 29 PRECEDING) AS sxy, count(*) OVER (w ROWS 29 PRECEDING) AS n FROM bars {W})
SELECT symbol, ts, {six("CASE WHEN n = 30 THEN (close - i - s * volume) / sqrt(nullif(greatest(syy - s * sxy, 0) / 28, 0)) END")} AS z FROM o""")
def rolling_ols(spark, d):
    return bars6(spark, d).select("symbol", "ts", rolling_ols_z("close", "volume", 30).alias("z"))


@query(f""", o AS (SELECT *, row_number() OVER w AS n, close - lag(close) OVER w AS m FROM bars {W}),
f AS (SELECT symbol, ts, n, close, close AS e, NULL::DOUBLE AS g, NULL::DOUBLE AS l FROM o WHERE n = 1 UNION ALL
 SELECT o.symbol, o.ts, o.n, o.close, 2 / 13::DOUBLE * o.close + (1 - 2 / 13::DOUBLE) * f.e, CASE WHEN f.g IS NULL THEN greatest(o.m, 0) ELSE greatest(o.m, 0) / 14 + f.g * 13 / 14 END, CASE WHEN f.l IS NULL THEN greatest(-o.m, 0) ELSE greatest(-o.m, 0) / 14 + f.l * 13 / 14 END FROM f JOIN o ON o.symbol = f.symbol AND o.n = f.n + 1)
SELECT symbol, ts, {six("CASE WHEN n >= 12 THEN e END")} AS ema12, {six("CASE WHEN n >= 15 THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END")} AS rsi14 FROM f""")
def exponential_indicators(spark, d):
    out = rsi(ema(bars6(spark, d), "close", 12, "ema12"), 14, "rsi14", 100.0)
    return out.select("symbol", "ts", "ema12", "rsi14")


@query(f""", a AS (SELECT *, close / lag(close) OVER w - 1 AS r, abs(close - lag(close) OVER w) AS step, close - lag(close, 20) OVER w AS drift, row_number() OVER w AS n FROM bars {W}),
b AS (SELECT *, CASE WHEN n > 20 THEN stddev_samp(r) OVER (w ROWS 19 PRECEDING) END AS vol, CASE WHEN n > 20 THEN least(1.0, abs(drift) / nullif(sum(step) OVER (w ROWS 19 PRECEDING), 0)) END AS er FROM a {W}),
v AS (SELECT *, list_filter(list(vol) OVER (w ROWS 79 PRECEDING), lambda x: x IS NOT NULL) AS v FROM b {W}),
k AS (SELECT *, CASE WHEN len(v) >= 20 AND vol IS NOT NULL THEN (len(list_filter(v, lambda x: x < vol)) + 0.5 * len(list_filter(v, lambda x: x = vol))) / len(v) END AS rk FROM v)
SELECT symbol, CASE WHEN rk IS NULL OR er IS NULL THEN 'UNKNOWN' WHEN rk >= 0.8 THEN 'HIGH_VOL' WHEN er >= 0.3 THEN CASE WHEN drift > 0 THEN 'TREND_UP' ELSE 'TREND_DOWN' END ELSE 'RANGE' END AS regime, count(*) AS n FROM k GROUP BY ALL""")
def regime_counts(spark, d):
    return signals.regimes(bars6(spark, d)).groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("n"))


@query(f""", x AS (SELECT *, row_number() OVER w AS n, lag(close, 10) OVER w AS c10, avg(close) OVER (w ROWS 19 PRECEDING) AS m, stddev_samp(close) OVER (w ROWS 19 PRECEDING) AS s, quantile_cont(close, 0.25) OVER (w ROWS 19 PRECEDING) AS q, max(high) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS hi, min(low) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS lo FROM bars {W})
SELECT symbol, ts, sign(close / c10 - 1)::INT AS momentum, CASE WHEN n >= 20 THEN (close > m)::INT END AS above_mean, CASE WHEN n >= 20 AND s > 0 THEN CASE WHEN (close - m) / s <= -1.5 THEN 1 WHEN (close - m) / s >= 1.5 THEN -1 ELSE 0 END END AS fade, CASE WHEN n >= 20 THEN (close < q)::INT END AS contrarian,
(hour(ts) >= 18 OR hour(ts) < 6) AS overnight, (day(ts) <= 3 OR day(ts) > day(last_day(ts)) - 2)::INT AS turn,
coalesce(last_value(CASE WHEN n > 10 AND close > hi THEN 1 WHEN n > 10 AND close < lo THEN -1 END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING), 0) AS breakout FROM x {W}""")
def vector_signals(spark, d):
    s = signals
    return bars6(spark, d).select("symbol", "ts", s.time_series_momentum(10).alias("momentum"), s.above_sma(20).alias("above_mean"), s.z_fade("close", 20, 1.5).alias("fade"), F.when(sma("close", 20).isNotNull(), s.low_quantile("close", 0.25, 20)).alias("contrarian"), s.in_hours(18, 6).alias("overnight"), s.turn_of_month().alias("turn"), s.donchian_persistent(10).alias("breakout"))


@query(f""", x AS (SELECT symbol, ts, row_number() OVER w AS n, CASE WHEN row_number() OVER w <= 10 THEN -1 ELSE (close > max(high) OVER p)::INT + 2 * (close < min(low) OVER p)::INT + 4 * (close < min(low) OVER q)::INT + 8 * (close > max(high) OVER q)::INT END AS code FROM bars
 WINDOW w AS (PARTITION BY symbol ORDER BY ts), p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), q AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
f AS (SELECT symbol, ts, n, 0 AS position FROM x WHERE n = 1 UNION ALL SELECT x.symbol, x.ts, x.n, CASE WHEN code < 0 THEN position WHEN position = 0 THEN CASE WHEN code & 1 > 0 THEN 1 WHEN code & 2 > 0 THEN -1 ELSE 0 END WHEN position > 0 AND code & 4 > 0 OR position < 0 AND code & 8 > 0 THEN 0 ELSE position END FROM f JOIN x ON x.symbol = f.symbol AND x.n = f.n + 1)
SELECT symbol, ts, position FROM f""")
def channel_positions(spark, d):
    return signals.channel_rule(bars6(spark, d), 10, 5).select("symbol", "ts", "position")


@query(f""", x AS (SELECT symbol, ts, row_number() OVER w AS n, {gate("(close - avg(close) OVER (w ROWS 19 PRECEDING)) / nullif(stddev_samp(close) OVER (w ROWS 19 PRECEDING), 0)", 20)} AS z FROM bars {W}),
f AS (SELECT symbol, ts, n, 0 AS position FROM x WHERE n = 1 UNION ALL SELECT x.symbol, x.ts, x.n, CASE WHEN z IS NULL THEN position WHEN position = 0 THEN CASE WHEN z <= -1.5 THEN 1 WHEN z >= 1.5 THEN -1 ELSE 0 END WHEN position * z >= 0 THEN 0 ELSE position END FROM f JOIN x ON x.symbol = f.symbol AND x.n = f.n + 1)
SELECT symbol, ts, position FROM f""")
def band_positions(spark, d):
    return signals.band_rule(bars6(spark, d), 20, 1.5).select("symbol", "ts", "position")


MOVES = ", mv AS (SELECT symbol, ts, seq, (sign(bid_c - lag(bid_c) OVER w)::INT + 1) * 3 + sign(ask_c - lag(ask_c) OVER w)::INT + 1 AS state FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)), tr AS (SELECT symbol, lag(state) OVER (PARTITION BY symbol ORDER BY ts, seq) AS from_state, state AS to_state FROM mv WHERE state IS NOT NULL), joint AS (SELECT symbol, from_state, to_state, count(*) AS n FROM tr WHERE from_state IS NOT NULL GROUP BY ALL)\n"


@query(MOVES + "SELECT * FROM joint")
def quote_transitions(spark, d):
    return assays.transitions(assays.quote_moves(market.ticks(spark, d)))


@query(MOVES + f""", j AS (SELECT *, n / sum(n) OVER (PARTITION BY symbol) AS p, sum(n) OVER (PARTITION BY symbol, from_state) / sum(n) OVER (PARTITION BY symbol) AS a, sum(n) OVER (PARTITION BY symbol, to_state) / sum(n) OVER (PARTITION BY symbol) AS b FROM joint)
SELECT symbol, sum(n)::BIGINT AS n, {six("sum(p * log2(p / (a * b)))")} AS bits, {six("-sum(p * log2(b))")} AS entropy FROM j GROUP BY symbol""")
def quote_information(spark, d):
    return assays.mutual_information(assays.transitions(assays.quote_moves(market.ticks(spark, d))))


@query(""", m AS (SELECT symbol, ts, seq, sign(mid_c - lag(mid_c) OVER w)::INT AS direction FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)),
i AS (SELECT *, CASE WHEN lag(direction) OVER w IS DISTINCT FROM direction THEN 1 ELSE 0 END AS new FROM m WHERE direction IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq)),
g AS (SELECT symbol, direction, sum(new) OVER (PARTITION BY symbol ORDER BY ts, seq) AS island FROM i),
l AS (SELECT symbol, direction, island, count(*) AS length, max(island) OVER (PARTITION BY symbol) AS last FROM g GROUP BY symbol, direction, island) SELECT symbol, direction, length, count(*) AS runs FROM l WHERE island < last GROUP BY ALL""")
def run_lengths(spark, d):
    return assays.run_histogram(market.ticks(spark, d))


NUMBERED = ", num AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) - 1 AS row FROM ticks)\n"


@query(NUMBERED + """, p AS (SELECT symbol, row, mid_c, list(mid_c) OVER (PARTITION BY symbol ORDER BY row ROWS BETWEEN 1 FOLLOWING AND 4096 FOLLOWING) AS path FROM num),
h AS (SELECT *, list_position(list_transform(path, lambda m: abs(m - mid_c) >= 30000), true) AS pos FROM p)
SELECT symbol, row, CASE WHEN pos > 0 THEN pos END AS hit_rows, CASE WHEN pos > 0 THEN sign(path[pos] - mid_c)::INT END AS hit FROM h""")
def first_passage(spark, d):
    return assays.first_passage(market.ticks(spark, d), 30000, 4096)


@query(f""", x AS (SELECT *, close_bid + close_ask AS x, row_number() OVER w AS n FROM quotes {W}),
z AS (SELECT *, CASE WHEN n > 48 THEN (x - avg(x) OVER p) / nullif(stddev_pop(x) OVER p, 0) END AS z, sum(CASE WHEN epoch(ts - pt) > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts) AS g FROM (SELECT *, lag(ts) OVER w AS pt FROM x {W}) WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)),
d AS (SELECT *, CASE WHEN z <= -2 THEN 1 WHEN z >= 2 THEN -1 ELSE 0 END AS direction, lead(open_bid) OVER w AS ib, lead(open_ask) OVER w AS ia, lead(close_bid, 6) OVER w AS ob, lead(close_ask, 6) OVER w AS oa, lead(g, 6) OVER w AS eg FROM z {W}),
e AS (SELECT *, row_number() OVER w AS k FROM d WHERE direction <> 0 AND eg = g {W}),
f AS (SELECT symbol, k, n AS last, true AS taken FROM e WHERE k = 1 UNION ALL SELECT e.symbol, e.k, CASE WHEN e.n > f.last + 6 THEN e.n ELSE f.last END, e.n > f.last + 6 FROM f JOIN e ON e.symbol = f.symbol AND e.k = f.k + 1),
s AS (SELECT e.symbol, CASE WHEN direction = 1 THEN ob - ia ELSE ib - oa END AS net FROM e JOIN f ON e.symbol = f.symbol AND e.k = f.k AND taken)
SELECT symbol, count(*) AS n, count(*) FILTER (net > 0) AS wins, count(*) FILTER (net < 0) AS losses, {six("avg(net)")} AS mean_net_c, {six("sum(greatest(net, 0)) / nullif(-sum(least(net, 0)), 0)")} AS profit_factor FROM s GROUP BY symbol""")
def bar_assay_reversal(spark, d):
    return assays.outcomes(assays.bar_samples(quote_bars(market.ticks(spark, d)), assays.reversal_direction(), 6, 86400))


#: Direction of each impulse family over bars with the levels of IMPULSE.
FAMILIES = {
    "range_expansion": "CASE WHEN high - low > 1.2 * usual THEN side ELSE 0 END",
    "price_velocity": "CASE WHEN abs(move) > 1.2 * spread THEN sign(move) ELSE 0 END",
    "range_breakout": "CASE WHEN close > top THEN 1 WHEN close < bottom THEN -1 ELSE 0 END",
    "breakout_with_expansion": "CASE WHEN high - low > 1.2 * usual AND (close > top AND side = 1 OR close < bottom AND side = -1) THEN side ELSE 0 END",
    "vol_expansion": "CASE WHEN older > 0 AND recent > 1.2 * older THEN sign(close - lag(close, 6) OVER w) ELSE 0 END",
}
PRIOR = "(w ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"
IMPULSE = f""", i0 AS (SELECT *, row_number() OVER w AS n, close - lag(close, 3) OVER w AS move, close / nullif(lag(close) OVER w, 0) - 1 AS r, CASE WHEN close >= open THEN 1 ELSE -1 END AS side FROM bars {W}),
i1 AS (SELECT *, CASE WHEN n > 20 THEN quantile_cont(high - low, 0.5) OVER {PRIOR} END AS usual, CASE WHEN n > 20 THEN max(high) OVER {PRIOR} END AS top, CASE WHEN n > 20 THEN min(low) OVER {PRIOR} END AS bottom,
  CASE WHEN n > 26 THEN stddev_pop(move) OVER (w ROWS BETWEEN 23 PRECEDING AND 4 PRECEDING) END AS spread, CASE WHEN n > 6 THEN stddev_pop(r) OVER (w ROWS 5 PRECEDING) END AS recent, CASE WHEN n > 24 THEN stddev_pop(r) OVER (w ROWS BETWEEN 23 PRECEDING AND 6 PRECEDING) END AS older,
  list({{h: high, l: low, c: close}}) OVER (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS path FROM i0 {W}),
"""


def impulse_sql(direction: str) -> str:
    way = lambda x: f"direction * (x.{x} / entry - 1) * 1e4"
    return IMPULSE + f"""d AS (SELECT *, ({direction})::INT AS direction FROM i1 {W}), e AS (SELECT *, close AS entry, row_number() OVER w AS k FROM d WHERE direction <> 0 {W}),
f AS (SELECT symbol, k, n AS last, true AS taken FROM e WHERE k = 1 UNION ALL SELECT e.symbol, e.k, CASE WHEN e.n > f.last + 4 THEN e.n ELSE f.last END, e.n > f.last + 4 FROM f JOIN e ON e.symbol = f.symbol AND e.k = f.k + 1),
p AS (SELECT e.symbol, e.ts, direction, entry, coalesce(len(path), 0) AS m, list_transform(path, lambda x: greatest({way("h")}, {way("l")})) AS good, list_transform(path, lambda x: least({way("h")}, {way("l")})) AS bad, path[len(path)].c AS c FROM e JOIN f ON e.symbol = f.symbol AND e.k = f.k AND taken),
h AS (SELECT *, coalesce(list_position(list_transform(good, lambda x: x >= 5000), true), 0) AS hit, coalesce(list_position(list_transform(bad, lambda x: x <= -5000), true), 0) AS stop FROM p)
SELECT symbol, ts, direction, CASE WHEN m < 4 THEN 'excluded' WHEN stop > 0 AND (hit = 0 OR stop <= hit) THEN 'stop' WHEN hit > 0 THEN 'target' ELSE 'time' END AS result,
{six("CASE WHEN m = 4 THEN list_max(good) END")} AS mfe_bps, {six("CASE WHEN m = 4 THEN list_min(bad) END")} AS mae_bps, {six("CASE WHEN m = 4 THEN direction * (c / entry - 1) * 1e4 END")} AS return_bps FROM h"""


def impulse_study(family: str):
    def run(spark, d):
        b = bars6(spark, d)
        return assays.measure_paths(b, assays.impulse_events(b, family, 4, k=1.2), 4, 5000, 5000)

    run.__name__ = f"impulse_{family}"
    return query(impulse_sql(FAMILIES[family]))(run)


for _family in FAMILIES:
    impulse_study(_family)


#: Round turns: between two neighbouring ends of the running sums of both sides, one lot of either side is at hand.
FIFO = """, c AS (SELECT *, sum(qty) OVER (PARTITION BY position_key, side ORDER BY ts, seq) AS e FROM fills WHERE qty > 0),
b AS (SELECT * FROM c WHERE side = 'buy'), s AS (SELECT * FROM c WHERE side = 'sell'),
most AS (SELECT position_key, least(max(e) FILTER (side = 'buy'), max(e) FILTER (side = 'sell')) AS most FROM c GROUP BY 1),
ends AS (SELECT DISTINCT c.position_key, c.e AS p FROM c JOIN most ON c.position_key = most.position_key AND c.e <= most.most),
steps AS (SELECT *, p - coalesce(lag(p) OVER (PARTITION BY position_key ORDER BY p), 0) AS qty FROM ends),
opened AS (SELECT steps.*, b.seq AS open_seq, b.price_c AS open_price_c FROM steps ASOF JOIN b ON steps.position_key = b.position_key AND steps.p <= b.e),
turns AS (SELECT opened.position_key, open_seq, s.seq AS close_seq, opened.qty::BIGINT AS qty, open_price_c, s.price_c AS close_price_c FROM opened ASOF JOIN s ON opened.position_key = s.position_key AND opened.p <= s.e)
"""


@query(FIFO + "SELECT * FROM turns")
def fifo_round_turns(spark, d):
    return ledger.fifo(market.fills(spark, d))


@query(FIFO + f""", t AS (SELECT *, qty * (close_price_c - open_price_c) AS g, qty * (close_price_c - open_price_c) - qty * (open_price_c + close_price_c) * 2 / 1e4 AS net FROM turns)
SELECT position_key, count(*) AS trades, {six("avg((net > 0)::INT)")} AS win_rate, {six("sum(g)")} AS gross_c, {six("sum(net)")} AS net_c, {six("sum(greatest(net, 0)) / nullif(-sum(least(net, 0)), 0)")} AS profit_factor FROM t GROUP BY position_key""")
def position_summary(spark, d):
    return ledger.trade_summary(ledger.fifo(market.fills(spark, d)), 2.0)


@query(FIFO + f", n AS (SELECT sum(qty * (open_price_c + close_price_c))::DOUBLE AS notional FROM turns), k AS (SELECT unnest(['spread', 'commission', 'slippage']) AS component, unnest([1.5, 0.5, 0.25])::DOUBLE AS bps) SELECT component, {six('notional * bps / 1e4')} AS charge_c, {six('bps / 2.25')} AS share FROM n, k")
def cost_breakdown(spark, d):
    return ledger.cost_components(ledger.fifo(market.fills(spark, d)), {"spread": 1.5, "commission": 0.5, "slippage": 0.25})


AVERAGE = """, o AS (SELECT *, row_number() OVER (PARTITION BY position_key ORDER BY ts, seq) AS n, CASE WHEN side = 'buy' THEN qty ELSE -qty END AS q FROM fills WHERE qty > 0),
f AS (SELECT position_key, seq, n, q AS net, price_c::DOUBLE AS a, 0::DOUBLE AS realized FROM o WHERE n = 1 UNION ALL
  SELECT o.position_key, o.seq, o.n, f.net + o.q, CASE WHEN f.net * o.q >= 0 THEN (abs(f.net) * f.a + abs(o.q) * o.price_c) / (abs(f.net) + abs(o.q)) WHEN abs(o.q) > abs(f.net) THEN o.price_c ELSE f.a END,
  CASE WHEN f.net * o.q >= 0 THEN 0 ELSE least(abs(f.net), abs(o.q)) * (o.price_c - f.a) * sign(f.net) END FROM f JOIN o ON o.position_key = f.position_key AND o.n = f.n + 1)
"""


@query(AVERAGE + f"""SELECT position_key, seq, net::BIGINT AS net_qty, {six("CASE WHEN net <> 0 THEN a END")} AS avg_price_c, {six("realized")} AS realized_c FROM f""")
def average_cost_positions(spark, d):
    return ledger.average_cost(market.fills(spark, d))


@query(AVERAGE + f""", l AS (SELECT position_key, arg_max(price_c, (ts, seq)) AS price_c FROM fills GROUP BY position_key), e AS (SELECT position_key, arg_max(net, n)::BIGINT AS net_qty, arg_max(a, n) AS a FROM f GROUP BY position_key)
SELECT position_key, net_qty, {six("CASE WHEN net_qty <> 0 THEN a END")} AS avg_price_c, price_c, {six("CASE WHEN net_qty <> 0 THEN net_qty * (price_c - a) END")} AS unrealized_c FROM e JOIN l USING (position_key)""")
def marked_positions(spark, d):
    f = market.fills(spark, d)
    held = ledger.average_cost(f).join(f.select("position_key", "seq", "ts"), ["position_key", "seq"])
    return ledger.mark_to_market(held, f.groupBy("position_key").agg(F.max_by("price_c", F.struct("ts", "seq")).alias("price_c")))


@query(f""", q AS (SELECT symbol, sign(close_bid + close_ask - lag(close_bid + close_ask) OVER w)::INT AS direction, lead(open_bid) OVER w AS ib, lead(open_ask) OVER w AS ia, lead(close_bid, 6) OVER w AS ob, lead(close_ask, 6) OVER w AS oa FROM quotes {W}),
s AS (SELECT symbol, direction, (ib + ia) / 2.0 AS m, (ob - ia)::DOUBLE AS l, (ib - oa)::DOUBLE AS h FROM q WHERE direction <> 0 AND oa IS NOT NULL), z AS (SELECT *, greatest(0, -(l + h) / 2) AS cost, CASE WHEN direction > 0 THEN l ELSE h END AS net FROM s)
SELECT symbol, count(*) AS n, {six("avg((net + cost) / m * 1e4)")} AS move_bps, {six("avg(cost / m * 1e4)")} AS cost_bps, {six("avg(net / m * 1e4)")} AS net_bps FROM z GROUP BY symbol""")
def quote_costs(spark, d):
    w = along()
    q = quote_bars(market.ticks(spark, d))
    mid = c("close_bid") + c("close_ask")
    q = q.withColumns({"direction": F.signum((mid - F.lag(mid).over(w)).cast("double")).cast("int"), "ib": F.lead("open_bid").over(w), "ia": F.lead("open_ask").over(w), "ob": F.lead("close_bid", 6).over(w), "oa": F.lead("close_ask", 6).over(w)}).where("oa IS NOT NULL")
    return ledger.quote_costs(q.select("symbol", "direction", ((c("ib") + c("ia")) / 2.0).alias("entry_mid"), (c("ob") - c("ia")).cast("double").alias("pnl_long"), (c("ib") - c("oa")).cast("double").alias("pnl_short")))


@query(""", a AS (SELECT o_orderkey AS k, count(*) AS n, max(o_totalprice) AS v FROM orders GROUP BY 1), b AS (SELECT l_orderkey AS k, count(*) AS n, max(l_extendedprice) AS v FROM lineitem GROUP BY 1)
SELECT CASE WHEN a.n > 1 OR b.n > 1 THEN 'ambiguous' WHEN b.n IS NULL THEN 'left_only' WHEN a.n IS NULL THEN 'right_only' WHEN abs(a.v - b.v) > 100000 THEN 'changed' ELSE 'matched' END AS status, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""")
def paired_reconciliation(spark, d):
    """Orders against their lines: one line within the tolerance of the order's price matches, several are ambiguous."""
    orders = market.table(spark, d, "orders").select(c("o_orderkey").alias("k"), c("o_totalprice").alias("v"))
    lines = market.table(spark, d, "lineitem").select(c("l_orderkey").alias("k"), c("l_extendedprice").alias("v"))
    return ledger.reconcile(orders, lines, ["k"], "v", 100_000)


@query(RUN + f""", m AS (SELECT symbol, abs(avg(net)) AS p FROM run WHERE net IS NOT NULL GROUP BY symbol), h AS (SELECT *, row_number() OVER (ORDER BY p) AS k, count(*) OVER () AS n FROM m)
SELECT symbol, {six("p")} AS p, {six("least(1.0, max((n - k + 1) * p) OVER (ORDER BY p))")} AS p_holm FROM h""")
def holm_adjusted(spark, d):
    p = sma_run(spark, d).where("net IS NOT NULL").groupBy("symbol").agg(F.abs(F.avg("net")).alias("p"))
    return inference.holm(p)


@query(RUN + f""", v AS (SELECT symbol, net, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM run WHERE net IS NOT NULL {W}), z AS (SELECT DISTINCT symbol, n FROM v),
d AS (SELECT symbol, n, unnest(range(0, 50)) AS draw FROM z), b AS (SELECT *, unnest(range(0, ceil(n / 5)::BIGINT)) AS b FROM d),
s AS (SELECT symbol, n, draw, b, unnest(range(0, 5)) AS o, (('0x' || substr(md5('7:' || draw || ':' || b), 1, 12))::BIGINT % n) AS i FROM b),
m AS (SELECT s.symbol, s.draw, avg(v.net) AS mean FROM s JOIN v ON v.symbol = s.symbol AND v.i = (s.i + s.o) % s.n GROUP BY ALL)
SELECT symbol, count(*) AS draws, {six("quantile_cont(mean, 0.025)")} AS low, {six("quantile_cont(mean, 0.5)")} AS median, {six("quantile_cont(mean, 0.975)")} AS high, {six("avg((mean <= 0)::INT)")} AS share_below_zero FROM m GROUP BY symbol""")
def bootstrap_of_mean(spark, d):
    return inference.bootstrap_interval(inference.block_bootstrap(sma_run(spark, d), "net", 50, 5, 7))


@query(f""", m AS (SELECT *, sign(close - lag(close) OVER w)::INT AS state, lead(close) OVER w > close AS up, row_number() OVER w - 1 < floor(count(*) OVER (PARTITION BY symbol) * 0.6::DOUBLE) AS train FROM bars {W}),
k AS (SELECT symbol, state, count(*) AS n, (count(*) FILTER (up) + 1) / (count(*) + 2) AS p_up FROM m WHERE train AND state IS NOT NULL AND up IS NOT NULL GROUP BY ALL),
o AS (SELECT symbol, state, count(*) AS n_after, avg(up::INT) AS up_share_after FROM m WHERE NOT train AND state IS NOT NULL AND up IS NOT NULL GROUP BY ALL)
SELECT symbol, state, n, {six("p_up")} AS p_up, n_after, {six("up_share_after")} AS up_share_after FROM k FULL JOIN o USING (symbol, state)""")
def markov_states(spark, d):
    """Learned from each symbol's discovery part, and what the bars after it did."""
    b = backtest.chronological(bars6(spark, d)).withColumns({"state": F.signum(c("close") - back("close")).cast("int"), "up": F.lead("close").over(along()) > c("close"), "train": c("part") == "discovery"})
    known = b.where("state IS NOT NULL AND up IS NOT NULL")
    after = known.where(~c("train")).groupBy("symbol", "state").agg(F.count(F.lit(1)).alias("n_after"), F.avg(c("up").cast("double")).alias("up_share_after"))
    return inference.markov(known, "state", "up", "train").join(after, ["symbol", "state"], "full")


SKEWED = """, m0 AS (SELECT symbol, count(net) AS n, avg(net) AS m, stddev_samp(net) AS sd, stddev_pop(net) AS sp FROM run GROUP BY symbol), m1 AS (SELECT r.symbol, any_value(n) AS n, any_value(m) / any_value(sd) AS s, avg(pow(net - m, 3)) / pow(any_value(sp), 3) AS g, avg(pow(net - m, 4)) / pow(any_value(sp), 4) AS k FROM run r JOIN m0 ON r.symbol = m0.symbol WHERE net IS NOT NULL AND sd > 0 GROUP BY r.symbol),
m2 AS (SELECT *, sqrt(greatest(1e-12, 1 - g * s + (k - 1) / 4 * s * s)) AS w FROM m1)
"""


@query(RUN + SKEWED + f""", z AS (SELECT symbol, n, s, s * sqrt(n - 1) / w AS z, (s - {inference.expected_max_sharpe(5, 1.0)!r}::DOUBLE / sqrt(n - 1)) * sqrt(n - 1) / w AS zd FROM m2)
SELECT symbol, n, {six("s")} AS sharpe, {six(placebo.normal_cdf("z"))} AS psr, {six(placebo.normal_cdf("zd"))} AS dsr FROM z""")
def sharpe_inference(spark, d):
    """Probabilistic Sharpe ratios, and deflated ones for five trials."""
    return placebo.sharpe_chances(inference.moments(sma_run(spark, d)), 5).select("symbol", "n", "sharpe", "psr", "dsr")


@query("SELECT d::TIMESTAMP + INTERVAL '22 hours' AS start, d::TIMESTAMP + INTERVAL '23 hours' AS \"end\" FROM (SELECT unnest(generate_series(DATE '2024-01-08', DATE '2024-01-18', INTERVAL 1 DAY)) AS d) WHERE dayofweek(d) BETWEEN 1 AND 4 UNION ALL SELECT TIMESTAMP '2024-01-12 22:00:00', TIMESTAMP '2024-01-14 23:00:00'")
def closure_calendar(spark, d):
    return clock.closures(spark, "2024-01-08", "2024-01-18")


@query(""", w AS (SELECT *, time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01') AS b FROM ticks), m AS (SELECT max(ts) - INTERVAL '10 minutes' AS mark FROM ticks)
SELECT symbol, b AS ts, first(mid_c ORDER BY ts, seq) AS open_c, max(mid_c) AS high_c, min(mid_c) AS low_c, last(mid_c ORDER BY ts, seq) AS close_c, count(*) AS n FROM w, m WHERE b + INTERVAL '6 hours' <= mark GROUP BY symbol, b""")
def streamed_bars(spark, d):
    return observe.run_available(observe.stream_bars(observe.tick_stream(spark, d)), _scratch(spark), f"bars-{uuid.uuid4().hex}")


@query(f""", o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS n FROM ticks), f AS (SELECT symbol, seq, n, mid_c::DOUBLE AS e FROM o WHERE n = 1 UNION ALL SELECT o.symbol, o.seq, o.n, 0.1 * o.mid_c + 0.9 * f.e FROM f JOIN o ON o.symbol = f.symbol AND o.n = f.n + 1)
SELECT symbol, seq, {six("e")} AS ema FROM f""")
def streamed_ema(spark, d):
    return observe.run_exponential(observe.tick_stream(spark, d), _scratch(spark), f"ema-{uuid.uuid4().hex}", 0.1)


@query("SELECT symbol, count(*) AS n, sum(mid_c)::BIGINT AS sum_c, min(mid_c) AS low_c, max(mid_c) AS high_c FROM ticks GROUP BY symbol")
def streamed_totals(spark, d):
    return observe.run_available(observe.running_totals(observe.tick_stream(spark, d)), _scratch(spark), f"totals-{uuid.uuid4().hex}")


def _scratch(spark: SparkSession) -> str:
    return shared_dir(spark)
