"""Rules from slow drivers, votes and calendars, placebos and comparisons, and stored series, with their DuckDB twins."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..frames import along
from ..functions import clock, placebo
from ..functions.quantiles import exact_quantiles
from ..functions.indicators import back, c, exponential, simple_return, sma, true_range
from ..operators import checks, drivers, signals
from ..operators.asof import asof, asof_forward
from ..operators.resample import quote_bars
from ..sources import market
from .market import CLOSES, RUN, W, _closes, _scratch, bars6, query, six, sma_run
from .studies import NETS, cross_nets

#: Bars with two drivers: x, the ticks of a bar, and y, its range.
XY = f", xy AS (SELECT symbol, ts, close, high, volume AS x, high - low AS y, row_number() OVER w AS n FROM bars {W})\n"


def with_drivers(spark, d):
    return bars6(spark, d).withColumns({"x": c("volume"), "y": c("high") - c("low")})


def flag(condition: str) -> str:
    return f"coalesce(({condition})::INT, 0)"


def growth(x: str, n: int) -> str:
    return f"({x} / nullif(lag({x}, {n}) OVER w, 0) - 1)"


def quantile(x: str, n: int, q: float = 0.5) -> str:
    return f"(CASE WHEN count({x}) OVER (w ROWS {n - 1} PRECEDING) >= {n // 2} THEN quantile_cont({x}, {q}) OVER (w ROWS {n - 1} PRECEDING) END)"


def z(x: str, n: int) -> str:
    frame = f"OVER (w ROWS {n - 1} PRECEDING)"
    return f"(CASE WHEN count({x}) {frame} = {n} THEN ({x} - avg({x}) {frame}) / nullif(stddev_samp({x}) {frame}, 0) END)"


def product_of(x: str) -> str:
    return f"CASE WHEN count(*) FILTER (1 + {x} = 0) > 0 THEN 0 ELSE exp(sum(ln(nullif(abs(1 + {x}), 0)))) * CASE WHEN count(*) FILTER (1 + {x} < 0) % 2 = 1 THEN -1 ELSE 1 END END"


TREND = f"sign({growth('close', 12)})::INT"


@query(XY + f""", g AS (SELECT *, {growth("x", 4)} AS gx, {TREND} AS trend FROM xy {W})
SELECT symbol, ts, {flag("x > lag(x, 12) OVER w")} AS rising, {flag("x < lag(x, 12) OVER w")} AS falling, coalesce(-sign(x - lag(x, 8) OVER w)::INT, 0) AS against, greatest(coalesce(-sign(x - lag(x, 8) OVER w)::INT, 0), 0) AS against_long,
{flag("x > 3")} AS over_level, {flag(f"x > {quantile('x', 15)}")} AS over_median, {flag(f"x > {quantile('x', 15, 0.75)}")} AS over_quantile, {flag(f"gx > {quantile('gx', 15)}")} AS growing, {flag(f"{growth('x', 4)} > {growth('y', 4)}")} AS faster,
{flag(f"round({z('x', 20)}, 9) > 0.5")} AS strong, {six(f"({flag('x > lag(x, 4) OVER w')} + {flag('y > lag(y, 8) OVER w')} + {flag('x < lag(x, 2) OVER w')}) / 3")} AS composite,
CASE WHEN y < {quantile("y", 15)} THEN coalesce(trend, 0) ELSE 0 END AS calm_trend, {six("greatest(-1, least(1, coalesce(trend, 0) * " + flag("x < lag(x, 12) OVER w") + "))")} AS agreeing FROM g {W}""")
def driver_positions(spark, d):
    b = with_drivers(spark, d).withColumn("gx", simple_return("x", 4))
    trend = signals.time_series_momentum(12)
    legs = (drivers.rising("x", 4), drivers.rising("y", 8), drivers.falling("x", 2))
    rules = {
        "rising": drivers.rising("x", 12), "falling": drivers.falling("x", 12), "against": drivers.against("x", 8), "against_long": drivers.against("x", 8, False), "over_level": drivers.over_level("x", 3), "over_median": drivers.over_median("x", 15),
        "over_quantile": drivers.over_quantile("x", 0.75, 15), "growing": drivers.over_median("gx", 15), "faster": drivers.faster_growth("x", "y", 4), "strong": drivers.over_z("x", 20, 0.5), "composite": drivers.composite(*legs),
        "calm_trend": drivers.while_calm(trend, "y", 15), "agreeing": F.coalesce(trend, F.lit(0)) * drivers.falling("x", 12).cast("double"),
    }
    return b.select("symbol", "ts", *[v.alias(n) for n, v in rules.items()])


@query("""SELECT symbol, ts, CASE WHEN hour(ts) = 6 THEN -1 WHEN hour(ts) IN (12, 18) THEN 1 ELSE 0 END AS hours, CASE isodow(ts) WHEN 5 THEN -1 WHEN 1 THEN 1 ELSE 0 END AS weekdays,
(hour(ts) >= 18 OR hour(ts) < 6)::INT AS overnight, (month(ts) IN (1, 9))::INT AS months FROM bars""")
def calendar_positions(spark, d):
    return bars6(spark, d).select("symbol", "ts", drivers.hours((12, 18), (6,)).alias("hours"), drivers.weekdays().alias("weekdays"), signals.in_hours(18, 6).cast("int").alias("overnight"), drivers.months((1, 9)).alias("months"))


VOTES = " + ".join(f"sign({growth('close', n)})::INT" for n in (3, 6, 12))


@query(XY + f""", v AS (SELECT *, {VOTES} AS v, {growth("x", 6)} > 0 AS up, close / nullif(x, 0) AS ratio, CASE WHEN count(*) OVER (w ROWS 23 PRECEDING) = 24 THEN close < 0.85 * max(close) OVER (w ROWS 23 PRECEDING) END AS deep FROM xy {W})
SELECT symbol, ts, sign(v)::INT AS majority, {six("sign(v) * abs(v) / 3.0")} AS graded, CASE WHEN sign(v) > 0 THEN 1 WHEN sign(v) < 0 AND up THEN -1 ELSE 0 END AS veto,
CASE WHEN sign(v) > 0 AND NOT coalesce(up, false) THEN 1 WHEN sign(v) < 0 AND coalesce(up, false) THEN -1 ELSE 0 END AS agreement, sign({growth("ratio", 6)})::INT AS relative,
{six("CASE WHEN deep THEN sign(v) * 0.5 ELSE sign(v) END")} AS braked, {six(f"(coalesce(sign({growth('close', 5)}), 0) + coalesce(sign({growth('close', 20)}), 0)) / 2")} AS average FROM v {W}""")
def voting_positions(spark, d):
    b, looks = with_drivers(spark, d), (3, 6, 12)
    side = signals.sign(drivers.votes(looks))
    return b.select("symbol", "ts", side.alias("majority"), drivers.graded(side, looks).cast("double").alias("graded"), drivers.veto(looks, "x", 6).alias("veto"), drivers.agreement(looks, "x", 6).alias("agreement"), drivers.relative_trend("x", 6).alias("relative"), drivers.braked(side.cast("double"), 24, 0.85, 0.5).alias("braked"), drivers.average(signals.time_series_momentum(5), signals.time_series_momentum(20)).alias("average"))


ATR = f", tr AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars {W}), atr AS (SELECT symbol, ts, close, high, low, row_number() OVER w AS n, CASE WHEN count(*) OVER (w ROWS 13 PRECEDING) = 14 THEN avg(tr) OVER (w ROWS 13 PRECEDING) END AS atr FROM tr {W})\n"


def with_atr(spark, d):
    return bars6(spark, d).withColumn("tr", true_range()).withColumn("atr", sma("tr", 14))


@query(ATR + f""", k AS (SELECT *, CASE WHEN lag(close) OVER w IS NULL OR atr IS NULL THEN -1 ELSE CASE WHEN close > lag(close) OVER w + atr * 0.5 THEN 1 WHEN close < lag(close) OVER w - atr * 0.5 THEN 2 ELSE 0 END + CASE WHEN close < avg(close) OVER (w ROWS 9 PRECEDING) THEN 4 WHEN close > avg(close) OVER (w ROWS 9 PRECEDING) THEN 8 ELSE 0 END END AS k FROM atr {W}),
f AS (SELECT symbol, ts, n, k, 0 AS s FROM k WHERE n = 1 UNION ALL SELECT k.symbol, k.ts, k.n, k.k, CASE WHEN k.k < 0 THEN f.s WHEN f.s = 0 THEN CASE WHEN k.k % 2 = 1 THEN 1 WHEN (k.k // 2) % 2 = 1 THEN -1 ELSE 0 END WHEN f.s > 0 AND (k.k // 4) % 2 = 1 OR f.s < 0 AND (k.k // 8) % 2 = 1 THEN 0 ELSE f.s END FROM f JOIN k ON k.symbol = f.symbol AND k.n = f.n + 1)
SELECT symbol, ts, CASE WHEN k >= 0 THEN s ELSE 0 END AS position FROM f""")
def breakout_positions(spark, d):
    return drivers.breakout_rule(with_atr(spark, d), 0.5, 10, "atr").select("symbol", "ts", "position")


@query(f""", r AS (SELECT *, row_number() OVER w AS n, high - low AS g FROM bars {W}), i AS (SELECT *, n >= 7 AND g <= min(g) OVER (w ROWS 6 PRECEDING) AS narrow FROM r {W}),
s AS (SELECT *, max(CASE WHEN narrow THEN n END) OVER w AS k FROM i {W}), e AS (SELECT s.*, CASE WHEN NOT s.narrow AND s.n - s.k <= 5 THEN CASE WHEN s.close > a.high THEN 1 WHEN s.close < a.low THEN -1 END END AS side FROM s LEFT JOIN i a ON a.symbol = s.symbol AND a.n = s.k),
o AS (SELECT *, CASE WHEN n = min(CASE WHEN side IS NOT NULL THEN n END) OVER (PARTITION BY symbol, k) THEN side END AS ev FROM e), l AS (SELECT *, last_value(CASE WHEN ev IS NOT NULL THEN n END IGNORE NULLS) OVER w AS ln, last_value(ev IGNORE NULLS) OVER w AS le FROM o {W})
SELECT symbol, ts, CASE WHEN n - ln < 4 THEN le ELSE 0 END AS position FROM l""")
def narrow_range_positions(spark, d):
    return drivers.narrow_range_rule(bars6(spark, d), 4).select("symbol", "ts", "position")


@query(ATR + f""", f AS (SELECT symbol, ts, n, close, atr, close AS e FROM atr WHERE n = 1 UNION ALL SELECT a.symbol, a.ts, a.n, a.close, a.atr, 0.1 * a.close + 0.9 * f.e FROM f JOIN atr a ON a.symbol = f.symbol AND a.n = f.n + 1), m AS (SELECT *, CASE WHEN n >= 19 THEN e END AS m FROM f)
SELECT symbol, ts, {six("CASE WHEN m - lag(m) OVER w IS NOT NULL AND atr IS NOT NULL THEN 2 * greatest(-0.5, least(0.5, (m - lag(m) OVER w) / (atr + 1e-12))) END")} AS position FROM m {W}""")
def slope_positions(spark, d):
    b = exponential(with_atr(spark, d), "close", 0.1, "mean", 19)
    return drivers.slope_rule(b, "mean", "atr").select("symbol", "ts", "position")


@query(XY + f""", a AS (SELECT *, {TREND} AS trend, CASE WHEN count(x) OVER (w ROWS 2 PRECEDING) = 3 THEN avg(x) OVER (w ROWS 2 PRECEDING) END AS m FROM xy {W}), g0 AS (SELECT *, m - CASE WHEN count(m) OVER p = 12 THEN min(m) OVER p END AS g FROM a WINDOW p AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
g1 AS (SELECT *, lag(g, 2) OVER w AS gap FROM g0 {W}) SELECT symbol, ts, {six("gap")} AS gap, CASE WHEN trend IS NULL OR gap IS NULL THEN NULL WHEN round(gap, 9) >= 0.5 THEN trend ELSE 0 END AS position FROM g1""")
def gap_gated_positions(spark, d):
    b = drivers.with_gap_over_low(with_drivers(spark, d), "x", "gap").withColumn("trend", signals.time_series_momentum(12))
    return b.select("symbol", "ts", "gap", drivers.gate(c("trend"), F.round("gap", 9) >= 0.5).alias("position"))


LABEL = "CASE WHEN p IS NULL THEN 'unknown' WHEN p > 0 THEN 'up' WHEN p < 0 THEN 'down' ELSE 'flat' END"


@query(NETS + f""", k AS (SELECT symbol, ts, {LABEL.replace("p ", "p ")} AS regime FROM (SELECT symbol, ts, sign(close - lag(close, 10) OVER w) AS p FROM bars {W})), r AS (SELECT n.symbol, n.row, n.variant, n.net, k.regime FROM nets n JOIN k ON n.symbol = k.symbol AND n.ts = k.ts),
a AS (SELECT *, count(net) OVER p AS n, round(avg(net) OVER p, 12) AS m FROM r WINDOW p AS (PARTITION BY symbol, variant, regime ORDER BY row RANGE BETWEEN 40 PRECEDING AND 1 PRECEDING)), f AS (SELECT symbol, row, arg_min(variant, (-m, variant)) AS variant FROM a WHERE n >= 5 AND m > 0 GROUP BY ALL)
SELECT symbol, variant, count(*) AS rows, min(row) AS first FROM f GROUP BY ALL""")
def routed_variants(spark, d):
    p = F.signum(c("close") - back("close", 10))
    label = F.when(p.isNull(), "unknown").when(p > 0, "up").when(p < 0, "down").otherwise("flat")
    rows = cross_nets(spark, d).join(bars6(spark, d).select("symbol", "ts", label.alias("regime")), ["symbol", "ts"])
    return drivers.routed(rows, 40, 5).groupBy("symbol", "variant").agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("first"))


def halves(bars):
    """Each symbol's median volume, which parts busy bars from calm ones."""
    return exact_quantiles(bars, ["symbol"], "volume", {"half": 0.5})


def with_half(bars):
    return bars.join(halves(bars), "symbol")


@query(f""", k AS (SELECT symbol, ts, sign(close - lag(close, 10) OVER w)::INT AS p, CASE WHEN volume > half THEN 'busy' ELSE 'calm' END AS regime FROM bars JOIN (SELECT symbol, quantile_cont(volume, 0.5) AS half FROM bars GROUP BY symbol) USING (symbol) {W})
SELECT symbol, ts, CASE WHEN regime = 'busy' THEN p ELSE 0 END AS busy, CASE WHEN ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-15' THEN p ELSE 0 END AS inside FROM k""")
def masked_positions(spark, d):
    b = with_half(bars6(spark, d)).withColumns({"p": signals.sign(c("close") - back("close", 10)), "regime": F.when(c("volume") > c("half"), "busy").otherwise("calm")})
    return b.select("symbol", "ts", drivers.in_regimes(c("p"), "regime", ["busy"]).alias("busy"), drivers.in_window(c("p"), "2024-01-05", "2024-01-15").alias("inside"))


@query(""", t AS (SELECT DISTINCT symbol, ts::DATE AS day FROM ticks), q AS (SELECT symbol, day, day::TIMESTAMP + INTERVAL '8 hours' AS s FROM t), lastq AS (SELECT symbol, ts, last(mid_c ORDER BY seq) AS m FROM ticks GROUP BY ALL), firstq AS (SELECT symbol, ts, first(bid_c ORDER BY seq) AS b, first(ask_c ORDER BY seq) AS a FROM ticks GROUP BY ALL),
x1 AS (SELECT q.*, r.ts AS rt, r.m AS rm FROM q ASOF LEFT JOIN lastq r ON q.symbol = r.symbol AND q.s - INTERVAL '2 hours' > r.ts), x2 AS (SELECT x1.*, r.ts AS gt, r.m AS gm FROM x1 ASOF LEFT JOIN lastq r ON x1.symbol = r.symbol AND x1.s > r.ts),
x3 AS (SELECT x2.*, r.ts AS et, r.b AS eb, r.a AS ea FROM x2 ASOF LEFT JOIN firstq r ON x2.symbol = r.symbol AND x2.s <= r.ts), x4 AS (SELECT x3.*, r.ts AS xt, r.b AS xb, r.a AS xa FROM x3 ASOF LEFT JOIN firstq r ON x3.symbol = r.symbol AND x3.s + INTERVAL '4 hours' <= r.ts),
e AS (SELECT *, sign(gm - rm)::INT AS direction FROM x4 WHERE rt IS NOT NULL AND xt IS NOT NULL AND epoch(gt - rt) >= 3600 AND epoch(et - s) <= 3600 AND epoch(xt - s) - 14400 <= 3600)
SELECT symbol, day, direction, et AS entry_ts, xt AS exit_ts, (CASE WHEN direction > 0 THEN xb - ea ELSE eb - xa END)::BIGINT AS net_c FROM e WHERE direction <> 0""")
def session_events(spark, d):
    """Each day the side of the two hours before 08:00, held until 12:00, where quotes lie near those times."""
    t = market.ticks(spark, d)
    starts = t.select("symbol", F.to_date("ts").alias("day")).distinct().withColumn("s", c("day").cast("timestamp_ntz") + F.expr("INTERVAL 8 HOURS"))
    lasts = t.groupBy("symbol", "ts").agg(F.max_by("mid_c", "seq").alias("m"))
    firsts = t.groupBy("symbol", "ts").agg(F.min_by(F.struct("bid_c", "ask_c"), "seq").alias("q"))

    def at(df, shift: str, name: str, forward: bool):
        probe = df.withColumn("ts", c("s") + F.expr(f"INTERVAL {shift} HOURS"))
        if forward:
            return asof_forward(probe, firsts, "q").withColumnsRenamed({"q": name, "matched_ts": f"{name}_ts"}).drop("ts")
        return asof(probe, lasts, "m", strict=True).withColumnsRenamed({"m": name, "matched_ts": f"{name}_ts"}).drop("ts")

    e = at(at(at(at(starts, "-2", "before", False), "0", "signal", False), "0", "entry", True), "4", "exit", True)
    apart = lambda a, b: F.unix_micros(F.col(a).cast("timestamp")) / 1e6 - F.unix_micros(F.col(b).cast("timestamp")) / 1e6
    e = e.where((apart("signal_ts", "before_ts") >= 3600) & (apart("entry_ts", "s") <= 3600) & (apart("exit_ts", "s") - 14400 <= 3600))
    e = e.withColumn("direction", signals.sign((c("signal") - c("before")).cast("double"))).where("direction != 0")
    net = F.when(c("direction") > 0, c("exit.bid_c") - c("entry.ask_c")).otherwise(c("entry.bid_c") - c("exit.ask_c"))
    return e.select("symbol", "day", "direction", c("entry_ts"), c("exit_ts"), net.alias("net_c"))


@query(f""", o AS (SELECT o_orderpriority AS symbol, o_orderdate::DATE AS day, avg(o_totalprice) AS price FROM orders GROUP BY ALL), x AS (SELECT symbol, day, lead(price, 5) OVER w / lead(price) OVER w - 1 AS r FROM o WINDOW w AS (PARTITION BY symbol ORDER BY day)),
months AS (SELECT unnest(generate_series(date_trunc('year', min(day)), max(day), INTERVAL 1 MONTH))::DATE AS m FROM o), rel AS (SELECT m + ((12 - isodow(m)) % 7)::INT AS day FROM months),
e AS (SELECT symbol, day, r FROM x JOIN rel USING (day)), z AS (SELECT *, count(r) OVER p AS n, avg(r) OVER p AS m, stddev_samp(r) OVER p AS s FROM e WINDOW p AS (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT symbol, day, {six("r")} AS r, CASE WHEN n >= 8 AND abs(m / nullif(s / sqrt(n), 0)) >= 0.5 THEN sign(m)::INT ELSE 0 END AS direction FROM z""")
def payroll_drift(spark, d):
    """Returns of four trading days from the day after each payroll release, and the side that all earlier ones give; a side needs eight of them."""
    daily = market.table(spark, d, "orders").groupBy(c("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("day")).agg(F.avg("o_totalprice").alias("price"))
    w = along(order=("day",))
    x = daily.select("symbol", "day", (F.lead("price", 5).over(w) / F.lead("price").over(w) - 1).alias("r"))
    first, last = daily.agg(F.year(F.min("day")), F.year(F.max("day"))).first()
    releases = clock.payroll_releases(spark, first, last).select(F.to_date("ts").alias("day"))
    e = x.join(F.broadcast(releases), "day").select("symbol", c("day").cast("timestamp_ntz").alias("ts"), "r", "day")
    return e.withColumn("direction", signals.expanding_drift("r", 0.5, 8, ("symbol",)).cast("int")).drop("ts")


@query(f""", g AS (SELECT symbol, epoch(ts - lag(ts) OVER w) AS s FROM bars {W}), y AS (SELECT symbol, 252 * 86400.0 / quantile_cont(s, 0.5) AS a FROM g WHERE s > 0 GROUP BY symbol HAVING count(*) >= 2), n AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol)
SELECT n.symbol, {six("coalesce(a, 252)")} AS bars_per_year, {six("n / coalesce(a, 252)")} AS years, {six("2 / sqrt(n / coalesce(a, 252))")} AS least_sharpe FROM n LEFT JOIN y USING (symbol)""")
def bars_per_year(spark, d):
    b = bars6(spark, d)
    y = clock.bars_per_year(b).join(b.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")), "symbol").withColumn("years", c("n") / c("bars_per_year"))
    return y.select("symbol", "bars_per_year", "years", placebo.least_sharpe(c("years")).alias("least_sharpe"))


@query("SELECT l_returnflag, count(*) AS n, sum(greatest(0, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)))::BIGINT AS nights FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def nights_held(spark, d):
    both = market.table(spark, d, "lineitem").join(market.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum(clock.nights("o_orderdate", "l_shipdate")).cast("long").alias("nights"))


@query(""", k AS (SELECT d::TIMESTAMP + INTERVAL '22 hours' AS s, d::TIMESTAMP + INTERVAL '23 hours' AS e FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-10', INTERVAL 1 DAY)) AS d) WHERE dayofweek(d) BETWEEN 1 AND 4
  UNION ALL SELECT d::TIMESTAMP + INTERVAL '22 hours', d::TIMESTAMP + INTERVAL '71 hours' FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-02-10', INTERVAL 1 DAY)) AS d) WHERE dayofweek(d) = 5)
SELECT symbol, count(*) AS n FROM ticks t WHERE EXISTS (SELECT 1 FROM k WHERE t.ts >= k.s AND t.ts < k.e) GROUP BY symbol""")
def ticks_in_closures(spark, d):
    inside = clock.in_intervals(market.ticks(spark, d).select("symbol", "seq", "ts"), clock.closures(spark, "2024-01-01", "2024-02-10"))
    return inside.where("inside").groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query(CLOSES + ", v AS (SELECT symbol, ts FROM closes WHERE day(ts) % 3 = 0), a AS (SELECT b.symbol, b.ts, c.ts AS c FROM bars b ASOF LEFT JOIN closes c ON b.symbol = c.symbol AND b.ts >= c.ts), z AS (SELECT a.*, v.ts AS v FROM a ASOF LEFT JOIN v ON a.symbol = v.symbol AND a.ts >= v.ts) SELECT symbol, ts FROM z WHERE ts - c <= INTERVAL '2 days' AND ts - v <= INTERVAL '2 days'")
def complete_stamps(spark, d):
    """Bars at which both drivers, daily closes and every third of them, were observed within two days."""
    closes = _closes(spark, d)
    return checks.complete(bars6(spark, d).select("symbol", "ts"), {"close": closes, "third": closes.where(F.dayofmonth("ts") % 3 == 0)}, 2 * 86400)


@query(f""", n AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY symbol) AS m FROM bars {W}), cuts AS (SELECT unnest([25, 50, 75, 100]) AS cut), p AS (SELECT cut, n.* FROM n JOIN cuts ON n.n * 100 <= cut * n.m), rule AS (SELECT cut, symbol, ts, sign(avg(close) OVER (v ROWS 4 PRECEDING) - avg(close) OVER (v ROWS 19 PRECEDING)) AS s FROM p WINDOW v AS (PARTITION BY cut, symbol ORDER BY ts)) SELECT cut, count(*) AS checked, 0::BIGINT AS differing FROM rule GROUP BY cut""")
def truncation_check(spark, d):
    return checks.truncation(bars6(spark, d), lambda b: b.withColumn("position", signals.sma_cross(5, 20)), "position", [25, 50, 75, 100], per_cent=True)


@query(f""", n AS (SELECT symbol, ts, row_number() OVER w AS n, CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) = 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) END AS v FROM bars {W}) SELECT symbol, count(*) AS compared, true AS passed FROM n WHERE n > 25 + 30 GROUP BY symbol""")
def warmup_check(spark, d):
    w = checks.warmup(bars6(spark, d), lambda b: b.withColumn("mean", sma("close", 20)), "mean", 30, 25)
    return w.select("symbol", "compared", (c("worst") <= 1e-8).alias("passed"))


@query(RUN + f""", k AS (SELECT symbol, net > 0 AS s, net, volume > half AS g FROM run JOIN (SELECT symbol, quantile_cont(volume, 0.5) AS half FROM bars GROUP BY symbol) USING (symbol) WHERE net IS NOT NULL), a AS (SELECT symbol, count(*) FILTER (g) AS n_a, count(*) FILTER (NOT g) AS n_b, avg(s::INT) FILTER (g) AS share_a, avg(s::INT) FILTER (NOT g) AS share_b, avg(net) FILTER (g) AS mean_a, avg(net) FILTER (NOT g) AS mean_b, var_samp(net) FILTER (g) AS va, var_samp(net) FILTER (NOT g) AS vb FROM k GROUP BY symbol),
e AS (SELECT *, sqrt(share_a * (1 - share_a) / n_a + share_b * (1 - share_b) / n_b) AS es, sqrt(va / n_a + vb / n_b) AS em FROM a WHERE n_a > 1 AND n_b > 1), z AS (SELECT *, (share_a - share_b) / nullif(es, 0) AS zs, (mean_a - mean_b) / nullif(em, 0) AS zm FROM e)
SELECT symbol, n_a, n_b, {six("share_a")} AS share_a, {six("share_b")} AS share_b, {six(f"CASE WHEN es > 0 THEN 1 - {placebo.normal_cdf('zs')} WHEN share_a > share_b THEN 0 ELSE 1 END")} AS share_p, {six("mean_a")} AS mean_a, {six("mean_b")} AS mean_b, {six(f"CASE WHEN em > 0 THEN 1 - {placebo.normal_cdf('zm')} WHEN mean_a > mean_b THEN 0 ELSE 1 END")} AS mean_p FROM z""")
def busy_against_calm(spark, d):
    run = sma_run(spark, d).join(halves(bars6(spark, d)), "symbol").where("net IS NOT NULL")
    shares = placebo.share_difference(run, c("volume") > c("half"), c("net") > 0).withColumnRenamed("p", "share_p")
    means = placebo.mean_difference(run, c("volume") > c("half"), c("net")).select("symbol", "mean_a", "mean_b", c("p").alias("mean_p"))
    return shares.join(means, "symbol")


DRAW = "(('0x' || substr(md5({seed} || ':' || draw || ':' || {row}), 1, 12))::BIGINT)"
SIDES = RUN + f", t AS (SELECT symbol, row_number() OVER w - 1 AS row, ts, sign(held)::INT AS side, held * r AS gross, cost FROM run {W}), e AS (SELECT * FROM t WHERE side <> 0 AND gross IS NOT NULL)\n"


def held_trades(spark, d):
    return sma_run(spark, d).select("symbol", "ts", (F.row_number().over(along()) - 1).alias("row"), signals.sign(c("held")).alias("side"), (c("held") * c("r")).alias("gross"), "cost")


@query(SIDES + f""", s AS (SELECT symbol, count(*) AS n, sum(gross - cost) AS observed, sum(cost) AS cost FROM e GROUP BY symbol), dr AS (SELECT e.*, unnest(range(0, 100)) AS draw FROM e),
m AS (SELECT symbol, draw, sum(CASE WHEN {DRAW.format(seed=5, row="row")} % 2 = 0 THEN 1 ELSE -1 END * gross * side) AS net FROM dr GROUP BY ALL)
SELECT s.symbol, any_value(n) AS n, {six("any_value(observed)")} AS observed, {six("avg((round(net - cost, 9) >= round(observed, 9))::INT)")} AS p FROM m JOIN s USING (symbol) GROUP BY s.symbol""")
def random_sides(spark, d):
    return placebo.random_sides(held_trades(spark, d), 100, 5)


@query(SIDES + f""", b AS (SELECT symbol, row, side, row // 40 AS block, gross * side AS move, count(*) FILTER (side > 0) OVER (PARTITION BY symbol, row // 40) AS longs FROM e), s AS (SELECT symbol, count(*) AS n, sum(side * move) AS observed FROM b GROUP BY symbol), dr AS (SELECT b.*, unnest(range(0, 50)) AS draw FROM b),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, block, draw ORDER BY {DRAW.format(seed=7, row="row")}, row) AS k FROM dr), m AS (SELECT symbol, draw, sum(CASE WHEN k <= longs THEN move ELSE -move END) AS net FROM k GROUP BY ALL)
SELECT s.symbol, any_value(n) AS n, {six("any_value(observed)")} AS observed, {six("avg((round(net, 9) >= round(observed, 9))::INT)")} AS p FROM m JOIN s USING (symbol) GROUP BY s.symbol""")
def shuffled_signs(spark, d):
    e = held_trades(spark, d).select("symbol", "row", "side", F.floor(c("row") / 40).alias("block"), (c("gross") * c("side")).alias("move"))
    return placebo.shuffled_signs(e, ["block"], 50, 7)


def wide_nets(spark, d):
    """(symbol, row, n, fast, middle, slow): nets of the three moving-average rules where all are known."""
    nets = cross_nets(spark, d).groupBy("symbol", "ts").pivot("variant", ["fast", "middle", "slow"]).agg(F.first("net")).na.drop()
    return nets.withColumns({"row": (F.row_number().over(along()) - 1).cast("int"), "n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})


WIDE = NETS + f", wide AS (SELECT symbol, ts, max(net) FILTER (variant = 'fast') AS fast, max(net) FILTER (variant = 'middle') AS middle, max(net) FILTER (variant = 'slow') AS slow FROM nets GROUP BY ALL), vals AS (SELECT *, row_number() OVER w - 1 AS row, count(*) OVER (PARTITION BY symbol) AS n FROM wide WHERE fast IS NOT NULL AND middle IS NOT NULL AND slow IS NOT NULL {W}),\n" + f"places AS (SELECT symbol, n, draw, unnest(range(0, n)) AS place FROM (SELECT DISTINCT symbol, n, unnest(range(0, 50)) AS draw FROM vals)), idx AS (SELECT *, {DRAW.format(seed=11, row='place')} % n AS row FROM places)\n"
BEST = "greatest(" + ", ".join(f"avg({v}) / nullif(stddev_samp({v}) / sqrt(count({v})), 0)" for v in ("fast", "middle", "slow")) + ")"


@query(WIDE + f""", s AS (SELECT symbol, {BEST} AS observed, avg(fast) AS a, avg(middle) AS b, avg(slow) AS c FROM vals GROUP BY symbol), cen AS (SELECT vals.symbol, row, fast - a AS fast, middle - b AS middle, slow - c AS slow FROM vals JOIN s ON vals.symbol = s.symbol),
m AS (SELECT idx.symbol, draw, {BEST} AS best FROM idx JOIN cen ON idx.symbol = cen.symbol AND idx.row = cen.row GROUP BY ALL) SELECT s.symbol, {six("any_value(observed)")} AS observed, {six("avg((round(best, 9) >= round(observed, 9))::INT)")} AS p FROM m JOIN s ON m.symbol = s.symbol GROUP BY s.symbol""")
def best_variant_chance(spark, d):
    return placebo.best_t(wide_nets(spark, d), ["fast", "middle", "slow"], 50, 11)


@query(WIDE + f""", l AS (SELECT idx.symbol, draw, place, sum(ln(greatest(1 + middle, 1e-12))) OVER (PARTITION BY idx.symbol, draw ORDER BY place) AS l FROM idx JOIN vals ON idx.symbol = vals.symbol AND idx.row = vals.row), dd AS (SELECT symbol, draw, 1 - exp(l - max(l) OVER (PARTITION BY symbol, draw ORDER BY place)) AS dd FROM l),
deep AS (SELECT symbol, draw, round(max(dd), 12) AS d FROM dd GROUP BY ALL), q AS (SELECT symbol, count(*) AS draws, avg(d) AS mean, quantile_cont(d, 0.95) AS q95 FROM deep GROUP BY symbol)
SELECT q.symbol, draws, {six("any_value(mean)")} AS mean, {six("any_value(q95)")} AS q95, {six("avg(d) FILTER (d >= q95 - 1e-12)")} AS shortfall FROM q JOIN deep ON q.symbol = deep.symbol GROUP BY q.symbol, draws""")
def drawdown_distribution(spark, d):
    return placebo.drawdowns(wide_nets(spark, d), "middle", 50, 11)


@query(NETS + f""", s AS (SELECT symbol, variant, avg(net) / nullif(stddev_samp(net), 0) AS s FROM nets GROUP BY ALL), f AS (SELECT symbol, avg(s) AS mean, stddev_pop(s) AS sd, max(s) AS peak FROM s GROUP BY symbol)
SELECT symbol, {six("mean")} AS mean, {six("sd")} AS sd, {six("peak")} AS peak, CASE WHEN peak - mean < 2 * sd THEN 'stable' ELSE 'isolated' END AS stability FROM f""")
def parameter_surface(spark, d):
    ratios = cross_nets(spark, d).groupBy("symbol", "variant").agg((F.avg("net") / F.nullif(F.stddev_samp("net"), F.lit(0.0))).alias("s"))
    return placebo.surface(ratios, "s")


@query(", o AS (SELECT date_trunc('month', o_orderdate)::DATE AS m, arg_max(v, o_orderdate) AS value FROM (SELECT o_orderdate, avg(o_totalprice) AS v FROM orders GROUP BY 1) GROUP BY 1) SELECT last_day(m + INTERVAL 1 MONTH)::DATE AS ts, round(value, 6) + 0::DOUBLE AS value FROM o")
def monthly_series(spark, d):
    return market.monthly(market.daily_series(spark, d), 1)


@query(", o AS (SELECT date_trunc('week', o_orderdate)::DATE AS m, arg_max(v, o_orderdate) AS value FROM (SELECT o_orderdate, avg(o_totalprice) AS v FROM orders GROUP BY 1) GROUP BY 1) SELECT (m + INTERVAL 13 DAY)::DATE AS ts, round(value, 6) + 0::DOUBLE AS value FROM o")
def weekly_series(spark, d):
    return market.weekly(market.daily_series(spark, d), 7)


@query("SELECT * FROM bars")
def stored_bars(spark, d):
    """Bars written as a version, checked against the manifest, and read back by the latest usable version."""
    root = f"{_scratch(spark)}/store-{uuid.uuid4().hex}"
    market.write_bars(bars6(spark, d), root, "6h", "v1")
    market.write_bars(bars6(spark, d), root, "6h", "v0")
    market.purge_version(spark, root, "6h", "v0")
    usable = [r["version"] for r in market.usable_versions(spark, root).collect()]
    return market.read_bars(spark, root, "6h", market.latest_version(spark, root, "6h") if usable == ["v1"] else "none")


@query("SELECT symbol, ts, open, high, low, close, volume FROM bars")
def csv_bars(spark, d):
    """Every symbol's bars written as CSV and read again; a reader takes one instrument, as files name none."""
    path, bars = f"{_scratch(spark)}/csv-{uuid.uuid4().hex}", bars6(spark, d)
    out = None
    for (symbol,) in bars.select("symbol").distinct().orderBy("symbol").collect():  # instruments, not rows
        market.write_bar_csv(bars.where(c("symbol") == symbol), f"{path}/{symbol}")
        one = market.read_bar_csv(spark, f"{path}/{symbol}", symbol, 21600).select(*[c(n).cast("timestamp_ntz") if n == "ts" else c(n) for n in market.BAR_COLUMNS])
        out = one if out is None else out.union(one)
    return out


@query(", o AS (SELECT o_orderdate::DATE AS ts, floor(avg(o_totalprice)) AS value FROM orders GROUP BY 1) SELECT ts, value FROM o WHERE value > 0")
def csv_series(spark, d):
    path = f"{_scratch(spark)}/series-{uuid.uuid4().hex}"
    market.daily_series(spark, d).select(c("ts").alias("date"), F.floor("value").alias("level")).write.csv(path, header=True)
    return market.read_series_csv(spark, path, "date", "level", positive=True)


LAGS, SPANS = (1, 3, 5, 15, 60), (5, 15, 60)


@query(f""", m AS (SELECT symbol, ts, (close_bid + close_ask) / 2.0 AS m, mean_spread, row_number() OVER w AS n FROM quotes {W}), r AS (SELECT *, abs(ln(m / lag(m) OVER w)) AS r FROM m {W}),
f AS (SELECT symbol, ts, n, {", ".join(f"ln(m / lag(m, {k}) OVER w) AS return_{k}" for k in LAGS)}, {", ".join(f"CASE WHEN count(r) OVER (w ROWS {k - 1} PRECEDING) = {k} THEN avg(r) OVER (w ROWS {k - 1} PRECEDING) END AS activity_{k}" for k in SPANS)}, mean_spread / m * 1e4 AS spread_bps FROM r {W})
SELECT symbol, ts, {", ".join(f"{six(f'return_{k}')} AS return_{k}" for k in LAGS)}, {", ".join(f"{six(f'activity_{k}')} AS activity_{k}" for k in SPANS)}, {six("spread_bps")} AS spread_bps FROM f WHERE return_60 IS NOT NULL AND activity_60 IS NOT NULL""")
def bar_features(spark, d):
    return drivers.bar_features(quote_bars(market.ticks(spark, d)), LAGS, SPANS)


@query(f""", g AS (SELECT symbol, ts, close, hour(ts) >= 18 OR hour(ts) < 12 AS inside, epoch(ts - lag(ts) OVER w) AS gap, close / nullif(lag(close) OVER w, 0) - 1 AS r, (ts + CASE WHEN hour(ts) >= 18 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END)::DATE AS day FROM bars {W}),
e AS (SELECT *, CASE WHEN inside AND lag(inside) OVER w AND gap <= 32400 THEN r ELSE 0 END AS net FROM g {W}) SELECT symbol, day, {six(product_of("net") + " - 1")} AS session_return FROM e GROUP BY symbol, day""")
def session_returns(spark, d):
    """What bars from 18:00 to 12:00 earn inside each session, named by the day it ends."""
    return drivers.session_returns(bars6(spark, d), 18, 12, 32400)


@query(""", n AS (SELECT symbol, ts, close, hour(ts) >= 18 AS evening, hour(ts) < 12 AS morning, (ts + CASE WHEN hour(ts) >= 18 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END)::DATE AS day FROM bars WHERE hour(ts) >= 18 OR hour(ts) < 12),
m AS (SELECT symbol, day, arg_max(close, ts) / arg_min(close, ts) - 1 AS move FROM n GROUP BY ALL HAVING bool_or(evening) AND bool_or(morning))
SELECT b.symbol, b.ts, CASE WHEN hour(b.ts) = 12 THEN coalesce(-sign(move)::INT, 0) ELSE 0 END AS reversal, CASE WHEN hour(b.ts) = 12 THEN coalesce(sign(move)::INT, 0) ELSE 0 END AS momentum FROM bars b LEFT JOIN m ON b.symbol = m.symbol AND b.ts::DATE = m.day""")
def overnight_positions(spark, d):
    """At 12:00, against and with the completed move of the night before."""
    b = drivers.with_overnight_move(bars6(spark, d), 18, 12)
    inside = signals.in_hours(12, 18)
    side = F.coalesce(signals.sign(c("move")), F.lit(0))
    return b.select("symbol", "ts", F.when(inside, -side).otherwise(0).alias("reversal"), F.when(inside, side).otherwise(0).alias("momentum"))


@query(SIDES + f""", t1 AS (SELECT symbol, ts::DATE AS day, gross - cost - 0.0001 AS stressed, gross - cost AS net FROM e), dd AS (SELECT symbol, day, sum(net) AS net FROM t1 GROUP BY ALL), a AS (SELECT symbol, count(*) AS days, avg(net) / nullif(stddev_samp(net) / sqrt(count(*)), 0) AS t FROM dd GROUP BY symbol)
SELECT t1.symbol, count(*) AS trades, any_value(days) AS days, {six("sum(net)")} AS net, {six("sum(stressed)")} AS stressed_net, {six("avg((net > 0)::INT)")} AS win_rate, {six("sum(greatest(net, 0)) / nullif(-sum(least(net, 0)), 0)")} AS profit_factor, {six("any_value(t)")} AS day_t, coalesce(sum(stressed) > 0 AND any_value(t) >= 2, false) AS passed FROM t1 JOIN a ON t1.symbol = a.symbol GROUP BY t1.symbol""")
def ledger_gate(spark, d):
    return placebo.ledger_gate(held_trades(spark, d).where("side != 0 AND gross IS NOT NULL"), 0.0001, 2.0)


@query(WIDE + f""", u AS (SELECT symbol, row, unnest(['fast', 'middle', 'slow']) AS variant, unnest([fast, middle, slow]) AS net FROM vals), s AS (SELECT symbol, variant, sum(net) AS net FROM u GROUP BY ALL), b AS (SELECT symbol, arg_min(variant, (-round(net, 12), variant)) AS best, max(net) AS best_net, sum(net) / 3 AS expected FROM s GROUP BY symbol),
dr AS (SELECT symbol, row, fast, middle, slow, unnest(range(0, 50)) AS draw FROM vals), m AS (SELECT symbol, draw, sum(CASE {DRAW.format(seed=13, row="row")} % 3 WHEN 0 THEN fast WHEN 1 THEN middle ELSE slow END) AS net FROM dr GROUP BY ALL)
SELECT b.symbol, any_value(best) AS best, {six("any_value(best_net)")} AS best_net, {six("any_value(expected)")} AS expected, {six("quantile_cont(net, 0.05)")} AS q05, {six("quantile_cont(net, 0.95)")} AS q95 FROM m JOIN b ON m.symbol = b.symbol GROUP BY b.symbol""")
def random_choice(spark, d):
    return placebo.random_choice(wide_nets(spark, d), ["fast", "middle", "slow"], 50, 13)


@query(SIDES + f""", t1 AS (SELECT symbol, row, gross - cost AS net, CASE WHEN row % 7 < 3 THEN 'a' ELSE 'b' END AS label FROM e), o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY label, row) AS slot FROM t1), dr AS (SELECT t1.*, unnest(range(0, 30)) AS draw FROM t1),
k AS (SELECT *, row_number() OVER (PARTITION BY symbol, draw ORDER BY {DRAW.format(seed=17, row="row")}, row) AS slot FROM dr), m AS (SELECT k.symbol, k.draw, o.label, sum(k.net) AS net FROM k JOIN o ON k.symbol = o.symbol AND k.slot = o.slot GROUP BY ALL), s AS (SELECT symbol, label, count(*) AS n, sum(net) AS observed FROM t1 GROUP BY ALL)
SELECT s.symbol, s.label, any_value(n) AS n, {six("any_value(observed)")} AS observed, {six("avg((round(net, 9) >= round(observed, 9))::INT)")} AS p FROM m JOIN s ON m.symbol = s.symbol AND m.label = s.label GROUP BY ALL""")
def label_placebo(spark, d):
    t = held_trades(spark, d).where("side != 0 AND gross IS NOT NULL")
    t = t.select("symbol", "row", (c("gross") - c("cost")).alias("net"), F.when(c("row") % 7 < 3, "a").otherwise("b").alias("label"))
    return placebo.shuffled_labels(t, 30, 17)


@query(SIDES + f""", t1 AS (SELECT symbol, row, gross - cost AS net FROM e), dr AS (SELECT t1.*, unnest(range(0, 31)) AS draw FROM t1), k AS (SELECT *, CASE WHEN draw = 0 THEN row ELSE {DRAW.format(seed=19, row="row")} END AS o FROM dr),
c AS (SELECT symbol, draw, row, o, sum(net) OVER (PARTITION BY symbol, draw ORDER BY o, row) AS c FROM k), dd AS (SELECT symbol, draw, greatest(0, max(c) OVER (PARTITION BY symbol, draw ORDER BY o, row)) - c AS dd FROM c), x AS (SELECT symbol, draw, round(max(dd), 12) AS d FROM dd GROUP BY ALL)
SELECT a.symbol, {six("any_value(a.d)")} AS observed, {six("avg((x.d >= a.d)::INT)")} AS p FROM x JOIN x a ON a.symbol = x.symbol AND a.draw = 0 AND x.draw > 0 GROUP BY a.symbol""")
def order_placebo(spark, d):
    t = held_trades(spark, d).where("side != 0 AND gross IS NOT NULL")
    return placebo.shuffled_order(t.select("symbol", "row", (c("gross") - c("cost")).alias("net")), 30, 19)


@query(WIDE + f", s AS (SELECT symbol, sum(fast) AS f, sum(middle) AS m, sum(slow) AS s FROM vals GROUP BY symbol) SELECT symbol, {six('s - f - m + 0')} AS interaction FROM s")
def factorial_interaction(spark, d):
    """Of the slow rule as both changes, fast and middle as one each, against no position."""
    s = wide_nets(spark, d).groupBy("symbol").agg(F.sum("fast").alias("f"), F.sum("middle").alias("m"), F.sum("slow").alias("s"))
    return s.select("symbol", placebo.interaction(F.lit(0.0), c("f"), c("m"), c("s")).alias("interaction"))
