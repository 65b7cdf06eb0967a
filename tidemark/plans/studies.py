"""Studies over ticks, quote bars and 6-hour bars, with their DuckDB twins: tick panels, bar assays, selection among variants, labels, chains and overlaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..frames import along
from ..functions import clock, selection
from ..functions.indicators import c, rsi, simple_return, sma
from ..operators import assays, backtest, engine, evidence, ledger, panels, signals
from ..operators.resample import quote_bars
from ..sources import market
from .market import FIFO, NUMBERED, ORACLE, QUERIES, RUN, YEAR, W, bars6, query, six, sma_run

BY_ROW = "WINDOW w AS (PARTITION BY symbol ORDER BY row)"


@query(NUMBERED + f""", a AS (SELECT symbol, row, mid_c, ask_c - bid_c AS s, mid_c - lag(mid_c) OVER w AS m FROM num {BY_ROW}),
b AS (SELECT *, lag(m) OVER w AS pm, sum(s) OVER p AS ss, sum(abs(m)) OVER p AS sm, {", ".join(f"lead(mid_c, {h}) OVER w AS m{h}" for h in (4, 16, 64))} FROM a WINDOW w AS (PARTITION BY symbol ORDER BY row), p AS (PARTITION BY symbol ORDER BY row ROWS BETWEEN 16 PRECEDING AND 1 PRECEDING)),
st AS ({" UNION ALL ".join(f"SELECT *, '{n}' AS state FROM b WHERE {e}" for n, e in (("wide", "s * 16 > ss"), ("tight", "s * 16 < ss"), ("large", "abs(m) * 16 > sm"), ("small", "abs(m) * 16 < sm"), ("run", "m * pm > 0"), ("turn", "m * pm < 0"), ("any", "true")))}),
u AS ({" UNION ALL ".join(f"SELECT symbol, state, {h} AS horizon, m{h} - mid_c AS move FROM st WHERE row > 16 AND m{h} IS NOT NULL" for h in (4, 16, 64))})
SELECT symbol, state, horizon, count(*) AS n, {six("avg(abs(move))")} AS mean_abs_c, {six("avg((move > 0)::INT)")} AS up_share FROM u GROUP BY ALL""")
def state_panel(spark, d):
    return panels.state_panel(market.ticks(spark, d))


@query(NUMBERED + f""", q AS (SELECT *, min(bid_c) OVER near <= bid_c AS buy, max(ask_c) OVER near >= ask_c AS sell, greatest(max(mid_c) OVER far - mid_c, mid_c - min(mid_c) OVER far) AS ex, lead(mid_c, 256) OVER (PARTITION BY symbol ORDER BY row) AS e FROM num
  WINDOW near AS (PARTITION BY symbol ORDER BY row ROWS BETWEEN 1 FOLLOWING AND 16 FOLLOWING), far AS (PARTITION BY symbol ORDER BY row ROWS BETWEEN 1 FOLLOWING AND 256 FOLLOWING))
SELECT symbol, count(*) AS n, {six("avg(buy::INT)")} AS buy_share, {six("avg(sell::INT)")} AS sell_share, {six("avg((buy AND sell)::INT)")} AS both_share, {six("avg(CASE WHEN buy AND sell THEN ask_c - bid_c - 2 ELSE 0 END)")} AS mean_net_c, {six("avg(ex)")} AS mean_excursion_c FROM q WHERE e IS NOT NULL GROUP BY symbol""")
def two_sided_quotes(spark, d):
    return panels.two_sided_quotes(market.ticks(spark, d))


@query(NUMBERED + f""", q AS (SELECT symbol, (sign(bid_c - lag(bid_c) OVER w)::INT + 1) * 3 + sign(ask_c - lag(ask_c) OVER w)::INT + 1 AS state, lead(mid_c, 5) OVER w - lead(mid_c) OVER w AS move FROM num {BY_ROW})
SELECT symbol, state, count(*) AS n, {six("avg((move > 0)::INT)")} AS up_share, {six("avg(move)")} AS mean_move_c FROM q WHERE move IS NOT NULL AND state IS NOT NULL GROUP BY ALL""")
def quote_change_panel(spark, d):
    return panels.change_panel(market.ticks(spark, d))


@query(NUMBERED + f""", q AS (SELECT symbol, hour(ts)::INT AS hour, ask_c - bid_c AS s, abs(mid_c - lag(mid_c, 16) OVER w) AS m FROM num {BY_ROW})
SELECT symbol, hour, count(*) AS n, {six("avg(s)")} AS mean_spread_c, {six("quantile_cont(s, 0.5)")} AS median_spread_c, {six("avg(m)")} AS mean_abs_c FROM q GROUP BY ALL""")
def hourly_activity(spark, d):
    return panels.hourly_activity(market.ticks(spark, d))


EDGES = [1, 10, 60, 600, 3600, 14400, 86400]


@query(f", g AS (SELECT symbol, epoch_us(ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts, seq)) / 1e6 AS gap FROM ticks) SELECT symbol, ({' + '.join(f'(gap >= {e})::INT' for e in EDGES)})::INT AS bucket, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY ALL")
def gap_histogram(spark, d):
    return panels.gap_histogram(market.ticks(spark, d), EDGES)


@query(", u AS (SELECT DISTINCT symbol, seq FROM ticks), l AS (SELECT *, lag(seq) OVER (PARTITION BY symbol ORDER BY seq) AS b FROM u) SELECT symbol, b + 1 AS first_missing, seq - 1 AS last_missing, seq - b - 1 AS n FROM l WHERE seq > b + 1")
def missing_sequence_ranges(spark, d):
    return panels.missing_ranges(market.ticks(spark, d), "symbol", "seq")


#: Columns that a bar assay's direction needs, and the direction itself, over quote bars x with n, x and its step r.
ASSAYS = {
    "volatility_ratio": ("CASE WHEN n > 12 THEN avg(abs(r)) OVER (w ROWS 11 PRECEDING) END AS a, CASE WHEN n > 60 THEN avg(abs(r)) OVER (w ROWS BETWEEN 59 PRECEDING AND 12 PRECEDING) END AS b", "CASE WHEN a / nullif(b, 0) >= 1.5 THEN sign(r) WHEN a / nullif(b, 0) <= 0.75 THEN -sign(r) ELSE 0 END"),
    "sequence": ("sign(lag(r) OVER w) AS a, sign(lag(r, 2) OVER w) AS b", "CASE WHEN sign(r) = a AND sign(r) = b THEN sign(r) ELSE 0 END"),
    "alignment": ("sign(x - lag(x, 3) OVER w) AS a, sign(x - lag(x, 12) OVER w) AS b, sign(x - lag(x, 48) OVER w) AS e", "CASE WHEN a = b AND a = e THEN a ELSE 0 END"),
    "short_strength": ("greatest(r, 0) + greatest(lag(r) OVER w, 0) AS a, greatest(-r, 0) + greatest(-lag(r) OVER w, 0) AS b, lag(r) OVER w AS e", "CASE WHEN e IS NULL THEN 0 WHEN coalesce(100.0 * a / nullif(a + b, 0), 50) <= 10 THEN 1 WHEN coalesce(100.0 * a / nullif(a + b, 0), 50) >= 90 THEN -1 ELSE 0 END"),
    "compression": ("CASE WHEN n > 288 THEN quantile_cont(m, 0.5) OVER (w ROWS BETWEEN 256 PRECEDING AND 1 PRECEDING) END AS e, max(high_ask) OVER (w ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING) AS a, min(low_bid) OVER (w ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING) AS b", "CASE WHEN m < e AND x > 2 * a THEN 1 WHEN m < e AND x < 2 * b THEN -1 ELSE 0 END"),
}


def assay_sql(name: str) -> str:
    columns, direction = ASSAYS[name]
    return f""", x AS (SELECT *, close_bid + close_ask AS x, row_number() OVER w AS n, lag(ts) OVER w AS pt FROM quotes {W}),
r0 AS (SELECT *, x - lag(x) OVER w AS r, (high_ask - low_bid) / nullif(x, 0) AS width FROM x {W}),
r1 AS (SELECT *, CASE WHEN n > 32 THEN quantile_cont(width, 0.5) OVER (w ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING) END AS m, sum(CASE WHEN epoch(ts - pt) > 86400 THEN 1 ELSE 0 END) OVER w AS g FROM r0 {W}),
z AS (SELECT *, {columns} FROM r1 {W}),
d AS (SELECT *, {direction} AS direction, lead(open_bid) OVER w AS ib, lead(open_ask) OVER w AS ia, lead(close_bid, 6) OVER w AS ob, lead(close_ask, 6) OVER w AS oa, lead(g, 6) OVER w AS eg FROM z {W}),
k AS (SELECT *, row_number() OVER w AS k FROM d WHERE direction <> 0 AND eg = g {W}),
f AS (SELECT symbol, k, n AS last, true AS taken FROM k WHERE k = 1 UNION ALL SELECT k.symbol, k.k, CASE WHEN k.n > f.last + 6 THEN k.n ELSE f.last END, k.n > f.last + 6 FROM f JOIN k ON k.symbol = f.symbol AND k.k = f.k + 1),
s AS (SELECT k.symbol, CASE WHEN direction = 1 THEN ob - ia ELSE ib - oa END AS net FROM k JOIN f ON k.symbol = f.symbol AND k.k = f.k AND taken)
SELECT symbol, count(*) AS n, count(*) FILTER (net > 0) AS wins, count(*) FILTER (net < 0) AS losses, {six("avg(net)")} AS mean_net_c, {six("sum(greatest(net, 0)) / nullif(-sum(least(net, 0)), 0)")} AS profit_factor FROM s GROUP BY symbol"""


def bar_assay(name: str):
    def run(spark, d):
        bars = assays.with_assay_moves(quote_bars(market.ticks(spark, d)))
        return assays.outcomes(assays.bar_samples(bars, assays.assay_directions()[name], 6, 86400))

    run.__name__ = f"bar_assay_{name}"
    return query(assay_sql(name))(run)


for _name in ASSAYS:
    bar_assay(_name)


@query(""", d AS (SELECT *, ts::DATE AS day, hour(ts) AS h FROM quotes), r AS (SELECT symbol, day, max(high_ask) AS top, min(low_bid) AS bottom FROM d WHERE h = 8 GROUP BY ALL),
b AS (SELECT symbol, day, ts, CASE WHEN high_ask > top AND low_bid < bottom THEN 0 WHEN high_ask > top THEN 1 WHEN low_bid < bottom THEN -1 END AS direction FROM d JOIN r USING (symbol, day) WHERE h BETWEEN 9 AND 14),
f AS (SELECT symbol, day, min(ts) AS ts, arg_min(direction, ts) AS direction FROM b WHERE direction IS NOT NULL GROUP BY ALL) SELECT * FROM f WHERE direction <> 0""")
def breaks_of_opening_range(spark, d):
    return assays.opening_range(quote_bars(market.ticks(spark, d)), 8, 6)


CROSSES = {"fast": (3, 10), "middle": (5, 20), "slow": (10, 40)}
NETS = ", v0 AS (SELECT *, close / lag(close) OVER w - 1 AS r, row_number() OVER w - 2 AS row, count(*) OVER (PARTITION BY symbol) - 1 AS n_rows FROM bars " + W + "),\n" + "v1 AS (" + " UNION ALL ".join(f"SELECT symbol, ts, r, row, n_rows, '{name}' AS variant, CASE WHEN count(*) OVER (w ROWS {b - 1} PRECEDING) = {b} THEN sign(avg(close) OVER (w ROWS {a - 1} PRECEDING) - avg(close) OVER (w ROWS {b - 1} PRECEDING)) END AS p FROM v0 {W}" for name, (a, b) in CROSSES.items()) + """),
v2 AS (SELECT *, coalesce(lag(p) OVER w, 0)::DOUBLE AS h, coalesce(lag(p, 2) OVER w, 0)::DOUBLE AS h2 FROM v1 WINDOW w AS (PARTITION BY symbol, variant ORDER BY ts)),
nets AS (SELECT symbol, variant, ts, row, n_rows, h * r - abs(h - h2) * 2 / 1e4 AS net FROM v2 WHERE row >= 0)
"""


def cross_nets(spark, d):
    return selection.variant_nets(bars6(spark, d), {name: signals.sma_cross(a, b) for name, (a, b) in CROSSES.items()}, 2.0)


@query(NETS + f""", t AS (SELECT *, floor(n_rows * 0.5 / 4)::BIGINT AS test FROM nets), k AS (SELECT *, unnest([0, 1, 2, 3]) AS fold FROM t), b AS (SELECT *, n_rows - (4 - fold) * test AS start FROM k),
g AS (SELECT symbol, fold, variant, coalesce(avg(net) FILTER (row < start) / nullif(stddev_samp(net) FILTER (row < start), 0), 0) AS train_sharpe, count(net) FILTER (row >= start AND row < start + test) AS test_n, sum(net) FILTER (row >= start AND row < start + test) AS test_net FROM b GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY symbol, fold ORDER BY round(train_sharpe, 9) DESC, variant) AS i FROM g)
SELECT symbol, fold, variant, {six("train_sharpe")} AS train_sharpe, test_n, {six("test_net")} AS test_net FROM o WHERE i = 1""")
def walk_forward_choice(spark, d):
    return selection.walk_forward(cross_nets(spark, d), 4)


@query(NETS + f""", bl AS (SELECT *, least(row // greatest(1, n_rows // 6), 5) AS block FROM nets WHERE net IS NOT NULL), pairs AS (SELECT a, b FROM (SELECT unnest(range(6)) AS a), (SELECT unnest(range(6)) AS b) WHERE a < b),
g AS (SELECT symbol, a, b, variant, round(coalesce(avg(net) FILTER (block NOT IN (a, b)) / nullif(stddev_samp(net) FILTER (block NOT IN (a, b)), 0), 0), 9) AS known, round(coalesce(avg(net) FILTER (block IN (a, b)) / nullif(stddev_samp(net) FILTER (block IN (a, b)), 0), 0), 9) AS tested FROM bl, pairs GROUP BY ALL),
m AS (SELECT symbol, a, b, arg_max(tested, (known, variant)) < round(quantile_cont(tested, 0.5), 9) AS below FROM g GROUP BY ALL)
SELECT symbol, count(*) AS folds, {six("avg(below::INT)")} AS pbo FROM m GROUP BY symbol""")
def overfitting_share(spark, d):
    return selection.overfitting(cross_nets(spark, d))


@query(f""", a AS (SELECT *, abs(close - lag(close) OVER w) AS step, close - lag(close, 20) OVER w AS drift, row_number() OVER w AS n, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars {W}),
b AS (SELECT *, CASE WHEN n >= 20 THEN avg(tr) OVER (w ROWS 19 PRECEDING) END AS atr, CASE WHEN n > 20 THEN least(1.0, abs(drift) / nullif(sum(step) OVER (w ROWS 19 PRECEDING), 0)) END AS er FROM a {W}),
k AS (SELECT *, CASE WHEN count(atr) OVER p = 60 THEN quantile_cont(atr, 0.5) OVER p END AS usual FROM b WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)),
labels AS (SELECT symbol, ts, CASE WHEN er IS NULL OR usual IS NULL THEN 'warming_up' ELSE CASE WHEN er >= 0.3 THEN CASE WHEN drift > 0 THEN 'trend_up' ELSE 'trend_down' END WHEN er <= 0.2 THEN 'range' ELSE 'transition' END || CASE WHEN atr > 1.5 * usual THEN '_high_vol' ELSE '' END END AS label FROM k)
SELECT symbol, label, count(*) AS n FROM labels GROUP BY ALL""")
def adaptive_regime_counts(spark, d):
    return signals.adaptive_regimes(bars6(spark, d)).groupBy("symbol", "label").agg(F.count(F.lit(1)).alias("n"))


@query(RUN + f""", k AS (SELECT symbol, ts, strftime(lag(ts) OVER w, '%A') AS label FROM bars {W}) SELECT symbol, label, count(*) AS n_bars, {six("sum(net)")} AS net FROM run JOIN k USING (symbol, ts) WHERE net IS NOT NULL GROUP BY ALL""")
def returns_by_label(spark, d):
    b = bars6(spark, d)
    return backtest.by_label(sma_run(spark, d), b.select("symbol", "ts", F.date_format("ts", "EEEE").alias("label")), "label")


@query(FIFO + f""", t AS (SELECT *, (qty * (close_price_c - open_price_c))::DOUBLE AS gross_c FROM turns)
SELECT position_key, count(*) AS n, {six("avg(gross_c)")} AS mean, {six("avg(gross_c) FILTER (gross_c > 0)")} AS mean_win, {six("avg(gross_c) FILTER (gross_c < 0)")} AS mean_loss, {six("quantile_cont(gross_c, 0.05)")} AS worst_5 FROM t GROUP BY position_key""")
def trade_expectancy(spark, d):
    turns = ledger.fifo(market.fills(spark, d))
    return backtest.expectancy(turns.withColumn("gross_c", (c("qty") * (c("close_price_c") - c("open_price_c"))).cast("double")), "gross_c", ("position_key",))


def hac_sum(name: str, now: str, lagged: str) -> str:
    return f"sum({now}) + " + " + ".join(f"{1 - k / 6!r} * coalesce(sum({lagged.format(k=k)}), 0)" for k in range(1, 6)) + f" AS {name}"


@query(RUN + f""", f AS (SELECT symbol, ts, net, r AS b, regr_slope(net, r) OVER p AS beta, regr_intercept(net, r) OVER p AS a FROM run WHERE net IS NOT NULL AND r IS NOT NULL WINDOW p AS (PARTITION BY symbol)),
u0 AS (SELECT *, net - a - beta * b AS u FROM f), u1 AS (SELECT *, {", ".join(f"lag(u, {k}) OVER w AS u{k}, lag(b, {k}) OVER w AS b{k}" for k in range(1, 6))} FROM u0 {W}),
g AS (SELECT symbol, count(*) AS n, sum(b) AS sb, sum(b * b) AS sbb, max(a) AS a, max(beta) AS beta, {hac_sum("s00", "u * u", "2 * u * u{k}")}, {hac_sum("s01", "u * u * b", "u * u{k} * (b + b{k})")}, {hac_sum("s11", "u * u * b * b", "2 * u * u{k} * b * b{k}")} FROM u1 GROUP BY symbol),
i AS (SELECT *, sbb / nullif(n * sbb - sb * sb, 0) AS p, -sb / nullif(n * sbb - sb * sb, 0) AS q FROM g WHERE n >= 18)
SELECT symbol, n, {six(f"a * {YEAR}")} AS alpha, {six("beta")} AS beta, {six("a / nullif(sqrt(greatest(p * p * s00 + 2 * p * q * s01 + q * q * s11, 0)), 0)")} AS t FROM i""")
def hac_alpha_of_sma(spark, d):
    return backtest.hac_alpha(sma_run(spark, d), YEAR)


@query(", n AS (SELECT symbol, ts, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars) SELECT symbol, CASE WHEN i < floor(n * 0.6::DOUBLE) THEN 'discovery' WHEN i < floor(n * 0.8::DOUBLE) THEN 'validation' ELSE 'locked' END AS part, count(*) AS n, min(ts) AS first, max(ts) AS last FROM n GROUP BY ALL")
def chronological_parts(spark, d):
    return backtest.chronological(bars6(spark, d)).groupBy("symbol", "part").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query(f""", x AS (SELECT symbol, ts, row_number() OVER w AS n, CASE WHEN row_number() OVER w > 10 THEN CASE WHEN close > max(high) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) THEN 1 WHEN close < min(low) OVER (w ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) THEN -1 END END AS e FROM bars {W}),
l AS (SELECT *, last_value(CASE WHEN e IS NOT NULL THEN n END IGNORE NULLS) OVER w AS ln, last_value(e IGNORE NULLS) OVER w AS le FROM x {W}) SELECT symbol, ts, CASE WHEN n - ln < 5 THEN le ELSE 0 END AS position FROM l""")
def timed_positions(spark, d):
    high, low = signals.channel(10)
    return signals.timed_rule(bars6(spark, d), F.when(c("close") > high, 1).when(c("close") < low, -1), 5).select("symbol", "ts", "position")


@query(f""", a AS (SELECT o_orderdate::DATE AS day, avg(o_totalprice::DOUBLE) AS value FROM orders GROUP BY 1), b AS (SELECT o_orderdate::DATE AS day, quantile_cont(o_totalprice::DOUBLE, 0.5) AS value FROM orders GROUP BY 1),
j AS (SELECT day, a.value AS a, b.value AS b, sign(a.value - lag(a.value) OVER (ORDER BY day)) = sign(b.value - lag(b.value) OVER (ORDER BY day)) AS same FROM a JOIN b USING (day))
SELECT count(*) AS n, {six("max(abs(a - b))")} AS max_diff, {six("corr(a, b)")} AS corr, {six("avg(same::INT)")} AS same_sign FROM j""")
def series_agreement(spark, d):
    """Mean and median order price of each day, as two copies of one series."""
    o = market.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day"))
    both = o.agg(F.avg(c("o_totalprice").cast("double")).alias("mean"), F.percentile(c("o_totalprice").cast("double"), 0.5).alias("median"))
    return market.agreement(both.select("day", c("mean").alias("value")), both.select("day", c("median").alias("value")), ["day"])


@query(""", r AS (SELECT symbol, date_trunc('month', ts)::DATE AS month, row_number() OVER (PARTITION BY symbol, date_trunc('month', ts) ORDER BY ts) AS n, strftime(ts, '%Y-%m-%d %H:%M') || ':' || round(close * 100)::BIGINT AS t FROM bars),
h AS (SELECT symbol, month, n, sha256(t) AS head FROM r WHERE n = 1 UNION ALL SELECT r.symbol, r.month, r.n, sha256(h.head || r.t) FROM h JOIN r ON r.symbol = h.symbol AND r.month = h.month AND r.n = h.n + 1) SELECT symbol, month, max(n) AS n, arg_max(head, n) AS head FROM h GROUP BY ALL""")
def bar_chain(spark, d):
    b = bars6(spark, d).withColumn("month", F.trunc("ts", "MM"))
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit(":"), F.round(c("close") * 100).cast("long").cast("string"))
    return market.row_chain(b, ["symbol", "month"], ["ts"], text)


@query()
def fixed_unit_trades(spark, d):
    """Trades of the moving-average rule in fixed units, with stops of twice the mean range and financing."""
    b = bars6(spark, d)
    spread = F.avg(c("high") - c("low")).over(along().rowsBetween(-13, 0))
    return engine.trades(engine.run_plan(b.withColumns({"target": signals.sma_cross(5, 20), "size": F.lit(0.5), "stop_dist": 2 * spread}), 2.0, 0.05))


@query(NUMBERED + """, p AS (SELECT symbol, row, mid_c - 500 AS lim, list({b: bid_c, a: ask_c}) OVER (PARTITION BY symbol ORDER BY row ROWS BETWEEN 1 FOLLOWING AND 32 FOLLOWING) AS path FROM num),
f AS (SELECT *, coalesce(list_position(list_transform(path, lambda q: q.a <= lim), true), 0) AS fill FROM p),
r AS (SELECT *, CASE WHEN fill > 0 THEN path[fill + 1:] END AS rest FROM f), l AS (SELECT *, coalesce(list_position(list_transform(rest, lambda q: q.b <= lim - 1000 OR q.b >= lim + 1000), true), 0) AS x FROM r),
o AS (SELECT *, CASE WHEN x > 0 THEN rest[x].b END AS bid, CASE WHEN fill > 0 THEN path[len(path)].b END AS last FROM l)
SELECT symbol, row, CASE WHEN fill > 0 THEN fill END AS fill_rows, CASE WHEN x > 0 THEN x END AS exit_rows, CASE WHEN fill = 0 THEN 'unfilled' WHEN bid <= lim - 1000 THEN 'stop' WHEN bid IS NOT NULL THEN 'target' ELSE 'open' END AS result,
CASE WHEN fill = 0 THEN 0 WHEN bid <= lim - 1000 THEN bid - lim WHEN bid IS NOT NULL THEN 1000 ELSE last - lim END AS pnl_c FROM o""")
def limit_orders(spark, d):
    return evidence.limit_replay(market.ticks(spark, d), 500, 1000, 1000, 32)


GATES = {"return": ("total_return", ">=", 0.0), "sharpe": ("sharpe", ">=", 0.5), "drawdown": ("max_drawdown", "<=", 0.2), "trades": ("trades", ">=", 20)}
METRICS = "(" + ORACLE["flagship_sma_backtest"] + ")"


def on_metrics(sql: str):
    """A query whose DuckDB twin reads the rounded metrics of the moving-average rule as m."""

    def add(f):
        query("x")(f)
        ORACLE[f.__name__] = sql.replace("FROM m", f"FROM {METRICS} AS m")
        return f

    return add


@on_metrics(" UNION ALL ".join(f"SELECT symbol, '{g}' AS gate, {col}::DOUBLE AS value, {b}::DOUBLE AS bound, coalesce({col} {how} {b}, false) AS passed FROM m" for g, (col, how, b) in GATES.items()))
def gate_table(spark, d):
    return evidence.gates(QUERIES["flagship_sma_backtest"](spark, d), GATES)


@on_metrics(f"SELECT symbol, {six(f'CASE WHEN 1 + total_return > 0 THEN pow(1 + total_return, {YEAR} / n_bars) - 1 END')} AS cagr, {six(f'CASE WHEN 1 + total_return > 0 THEN (pow(1 + total_return, {YEAR} / n_bars) - 1) / nullif(max_drawdown, 0) END')} AS calmar FROM m")
def growth_ratios(spark, d):
    return backtest.growth(QUERIES["flagship_sma_backtest"](spark, d), YEAR)


@query(NETS + f""", n AS (SELECT symbol, variant, net, row_number() OVER (PARTITION BY symbol, variant ORDER BY ts) - 1 AS i, count(*) OVER (PARTITION BY symbol, variant) AS n FROM nets WHERE net IS NOT NULL), z AS (SELECT DISTINCT symbol, n FROM n),
dr AS (SELECT symbol, n, unnest(range(0, 50)) AS draw FROM z), bl AS (SELECT *, unnest(range(0, ceil(n / 5)::BIGINT)) AS b FROM dr),
st AS (SELECT symbol, n, draw, unnest(range(0, 5)) AS o, (('0x' || substr(md5('3:' || draw || ':' || b), 1, 12))::BIGINT % n) AS i FROM bl),
mm AS (SELECT st.symbol, n.variant, st.draw, avg(n.net) AS mean FROM st JOIN n ON n.symbol = st.symbol AND n.i = (st.i + st.o) % st.n GROUP BY ALL), ob AS (SELECT symbol, variant, avg(net) AS observed FROM nets GROUP BY ALL),
tp AS (SELECT mm.symbol, draw, max(mean - observed) AS top FROM mm JOIN ob ON mm.symbol = ob.symbol AND mm.variant = ob.variant GROUP BY ALL), be AS (SELECT symbol, max(observed) AS best FROM ob GROUP BY symbol)
SELECT tp.symbol, {six("any_value(best)")} AS best, count(*) AS draws, {six("avg((round(top, 12) >= round(best, 12))::INT)")} AS p FROM tp JOIN be ON tp.symbol = be.symbol GROUP BY tp.symbol""")
def reality_check(spark, d):
    return selection.reality_check(cross_nets(spark, d), 50, 5, 3)


@query(f""", x AS (SELECT symbol, ts, (close / (CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) = 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) END) - 1) AS x, row_number() OVER w - 1 AS n FROM bars {W}),
y AS (SELECT symbol, ts, coalesce(last_value(CASE WHEN x > 0.1 THEN 1 WHEN x < -0.1 THEN -1 END IGNORE NULLS) OVER w, 0) AS held, sign(x)::INT AS s, n FROM x {W}),
z AS (SELECT *, max(CASE WHEN n % 7 = 0 THEN n END) OVER w AS k FROM y {W}), q AS (SELECT z.symbol, z.ts, z.held, v.s AS kept FROM z LEFT JOIN y v ON v.symbol = z.symbol AND v.n = z.k)
SELECT symbol, ts, held, coalesce(lag(kept) OVER w, 0) AS cadence FROM q {W}""")
def held_positions(spark, d):
    b = bars6(spark, d).withColumn("x", c("close") / sma("close", 20) - 1)
    b = signals.hysteresis(b, "x", 0.1, out="held").withColumn("s", signals.sign(c("x")))
    return signals.sampled(b, "s", 7, "cadence").select("symbol", "ts", "held", "cadence")


@query(f""", r AS (SELECT symbol, ts, close / lag(close) OVER w - 1 AS r FROM bars {W}), k AS (SELECT symbol, ts, r, unnest([-43200, -21600, 0, 21600, 43200])::INT AS shift_s FROM r WHERE r IS NOT NULL),
m AS (SELECT k.symbol, shift_s, count(*) AS n, round(corr(k.r, v.r), 9) AS corr FROM k JOIN r v ON v.symbol = 'view' AND v.r IS NOT NULL AND v.ts = k.ts + to_seconds(k.shift_s) GROUP BY ALL)
SELECT symbol, arg_max(shift_s, (corr, -shift_s)) AS shift_s, arg_max(n, (corr, -shift_s)) AS n, {six("arg_max(corr, (corr, -shift_s))")} AS corr FROM m WHERE n >= 20 AND corr IS NOT NULL GROUP BY symbol""")
def clock_shift(spark, d):
    r = bars6(spark, d).select("symbol", "ts", simple_return().alias("r"))
    return clock.clock_fit(r.where("symbol = 'view'"), r, [-43200, -21600, 0, 21600, 43200], 20)


@query(f""", k AS (SELECT symbol, ts, sign(close - open)::INT AS label FROM bars), i AS (SELECT *, lag(label) OVER w AS b FROM k {W}) SELECT symbol, b AS from_label, label AS to_label, count(*) AS n FROM i WHERE b IS NOT NULL AND b <> label GROUP BY ALL""")
def label_changes(spark, d):
    return evidence.changes(bars6(spark, d), signals.sign(c("close") - c("open")))


@query(""", asked AS (SELECT symbol, ts, seq, row_number() OVER (PARTITION BY symbol ORDER BY ts, seq) AS i FROM ticks WHERE seq % 2 = 1), given AS (SELECT symbol, ts, seq FROM ticks WHERE seq % 2 = 0),
pass AS (SELECT symbol, 0::BIGINT AS i, NULL::BIGINT AS seq, NULL::BIGINT AS fill_seq, []::BIGINT[] AS used FROM asked WHERE i = 1
  UNION ALL SELECT symbol, i, seq, fill_seq, list_append(used, fill_seq) FROM (
    SELECT a.symbol, a.i, a.seq, p.used, arg_max(g.seq, (-abs(epoch_us(g.ts) - epoch_us(a.ts)), g.ts, g.seq)) AS fill_seq FROM pass p JOIN asked a ON a.symbol = p.symbol AND a.i = p.i + 1
    LEFT JOIN given g ON g.symbol = a.symbol AND g.ts BETWEEN a.ts - INTERVAL 600 SECOND AND a.ts + INTERVAL 600 SECOND AND NOT list_contains(p.used, g.seq) GROUP BY a.symbol, a.i, a.seq, p.used))
SELECT p.symbol, p.seq, p.fill_seq, round(abs(epoch_us(g.ts) - epoch_us(a.ts)) / 1e6, 6) AS distance_s FROM pass p JOIN asked a ON a.symbol = p.symbol AND a.i = p.i LEFT JOIN given g ON g.symbol = p.symbol AND g.seq = p.fill_seq""")
def matched_intents(spark, d):
    """Odd ticks as intents, even ones as fills, within ten minutes."""
    t = market.ticks(spark, d).select("symbol", "ts", "seq")
    return evidence.nearest_match(t.where("seq % 2 = 1"), t.where("seq % 2 = 0"), 600)


@query(f""", m AS (SELECT *, row_number() OVER w AS n, close - lag(close) OVER w AS m, CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) = 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) END AS slow, CASE WHEN count(*) OVER (w ROWS 4 PRECEDING) = 5 THEN avg(close) OVER (w ROWS 4 PRECEDING) END AS fast FROM bars {W}),
g AS (SELECT symbol, n, greatest(m, 0) AS g, greatest(-m, 0) AS l FROM m WHERE n = 2 UNION ALL SELECT m.symbol, m.n, 0.5 * greatest(m.m, 0) + 0.5 * g.g, 0.5 * greatest(-m.m, 0) + 0.5 * g.l FROM g JOIN m ON m.symbol = g.symbol AND m.n = g.n + 1),
r AS (SELECT m.*, CASE WHEN m.n >= 3 THEN CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END END AS rsi FROM m LEFT JOIN g ON m.symbol = g.symbol AND m.n = g.n),
k AS (SELECT symbol, ts, n, CASE WHEN rsi < 15 AND close > slow THEN 1 WHEN rsi > 85 AND close < slow THEN 2 ELSE 0 END AS way, CASE WHEN close > fast THEN 1 WHEN close < fast THEN -1 ELSE 0 END AS side FROM r),
f AS (SELECT symbol, ts, n, CASE way WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS s FROM k WHERE n = 1 UNION ALL SELECT k.symbol, k.ts, k.n, CASE WHEN f.s = 0 THEN CASE way WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END WHEN abs(f.s) >= 5 OR side = sign(f.s) THEN 0 ELSE f.s + sign(f.s)::INT END FROM f JOIN k ON k.symbol = f.symbol AND k.n = f.n + 1)
SELECT symbol, ts, sign(s)::INT AS position FROM f""")
def short_rsi_positions(spark, d):
    return signals.short_rsi_rule(rsi(bars6(spark, d), 2, "rsi2", 100.0), "rsi2", 15, 20, 5, 5).select("symbol", "ts", "position")
