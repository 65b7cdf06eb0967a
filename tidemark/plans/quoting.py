"""Queries over quoted pairs and over the records of rules, with their twins."""

from __future__ import annotations

from ..functions import selection
from ..functions.indicators import c
from ..operators import quoting
from ..sources import market
from .market import NUMBERED, RUN, YEAR, product, query, six, sma_run
from .studies import NETS, cross_nets

FILL, AHEAD, TRAIL, LEAST, CHARGE = 4, 16, 16, 3, 1
CALM, WILD, TIGHT, WIDE = 3000, 3000, 2, 4
FLOORS = {"lift": 0.0, "net": 0.0}

PAIRS = NUMBERED + f""", p0 AS (SELECT *, bid_c + ask_c AS m, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 3600000000 THEN 1 ELSE 0 END AS gap FROM num WINDOW w AS (PARTITION BY symbol ORDER BY row)),
p1 AS (SELECT symbol, row AS anchor, ts, row // {FILL + 1} // 1024 AS block, (ask_c - bid_c)::DOUBLE AS spread_c,
  min(bid_c) OVER (w ROWS BETWEEN 1 FOLLOWING AND {FILL} FOLLOWING) <= bid_c AND max(ask_c) OVER (w ROWS BETWEEN 1 FOLLOWING AND {FILL} FOLLOWING) >= ask_c AS both_hit,
  min(bid_c) OVER (w ROWS BETWEEN 2 FOLLOWING AND {FILL + 1} FOLLOWING) <= lead(bid_c) OVER w AND max(ask_c) OVER (w ROWS BETWEEN 2 FOLLOWING AND {FILL + 1} FOLLOWING) >= lead(ask_c) OVER w AND lead(row, {FILL + 1}) OVER w IS NOT NULL AS late_both,
  abs(m - lag(m, {TRAIL}) OVER w) / 2 AS trail_c, abs(lead(m, {AHEAD}) OVER w - m) / 2 AS moved_c,
  greatest(max(m) OVER (w ROWS BETWEEN 1 FOLLOWING AND {AHEAD} FOLLOWING) - m, m - min(m) OVER (w ROWS BETWEEN 1 FOLLOWING AND {AHEAD} FOLLOWING)) / 2 AS most_c,
  sum(gap) OVER (w ROWS BETWEEN 1 FOLLOWING AND {AHEAD} FOLLOWING) = 0 AS gap_clear FROM p0 WINDOW w AS (PARTITION BY symbol ORDER BY row)),
p2 AS (SELECT *, CASE WHEN both_hit THEN spread_c - {CHARGE} ELSE 0 END AS net_c, CASE WHEN trail_c <= {CALM} AND spread_c <= {TIGHT} THEN 'f' WHEN trail_c >= {WILD} AND spread_c >= {WIDE} THEN 'u' END AS state
  FROM p1 WHERE anchor % {FILL + 1} = 0 AND anchor >= {FILL + 1 + TRAIL} AND moved_c IS NOT NULL),
p3 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY anchor) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM p2 WHERE state IS NOT NULL),
p4 AS (SELECT *, CASE WHEN n // 5 > 0 THEN least(i // (n // 5), 4) ELSE 4 END::INT AS fold FROM p3)
"""


def compared_sql(keys: str, source: str) -> str:
    """quoting.compared() and judged()."""
    each = ", ".join(f"avg({x}) FILTER (state = '{k}') AS {name}_{k}" for name, x in (("p", "both_hit::INT"), ("moved", "moved_c"), ("most", "most_c"), ("net", "net_c"), ("p_late", "late_both::INT")) for k in "fu")
    return f"""(SELECT *, CASE WHEN n_f < {LEAST} OR n_u < {LEAST} THEN 'inconclusive' WHEN lift >= 0 AND ratio >= 1.25 AND gap >= 10 AND net_f > 0 AND net_twice > 0 AND risk_f > risk_u AND late_lift > 0 THEN 'passed' ELSE 'failed' END AS status FROM (
SELECT *, CASE WHEN most_f = 0 THEN 0 ELSE net_f / most_f END AS risk_f, CASE WHEN most_u = 0 THEN 0 ELSE net_u / most_u END AS risk_u, p_f - p_u AS lift, CASE WHEN moved_f = 0 THEN 0 ELSE moved_u / moved_f END AS ratio, moved_u - moved_f AS gap, p_late_f - p_late_u AS late_lift FROM (
SELECT {keys}, count(*) FILTER (state = 'f') AS n_f, count(*) FILTER (state = 'u') AS n_u, count(DISTINCT block) AS blocks, {each}, coalesce(avg(2 * spread_c - {CHARGE}) FILTER (state = 'f' AND both_hit), 0) AS net_twice FROM {source} GROUP BY {keys})))"""


SHOWN = [f"{x}_{k}" for x in ("p", "moved", "most", "net", "p_late", "risk") for k in "fu"] + ["net_twice", "lift", "ratio", "gap", "late_lift"]


def events(spark, d):
    pairs = quoting.quote_pairs(market.ticks(spark, d), FILL, AHEAD, TRAIL, CHARGE)
    return quoting.in_folds(quoting.states(pairs, (c("trail_c") <= CALM) & (c("spread_c") <= TIGHT), (c("trail_c") >= WILD) & (c("spread_c") >= WIDE)))


def judged(spark, d, *keys):
    return quoting.judged(quoting.compared(events(spark, d), keys, CHARGE), LEAST, FLOORS)


@query(PAIRS + f"SELECT symbol, fold, n_f, n_u, blocks, {', '.join(f'{six(x)} AS {x}' for x in SHOWN)}, status FROM {compared_sql('symbol, fold', 'p4')}")
def quoting_folds(spark, d):
    """Pairs quoted in calm and tight markets against those in moving and wide ones, in five folds of as many pairs."""
    return judged(spark, d, "symbol", "fold").select("symbol", "fold", "n_f", "n_u", "blocks", *SHOWN, "status")


@query(PAIRS + f"""SELECT f.symbol, count(*) AS folds, count(*) FILTER (f.status = 'passed') AS passed, count(*) FILTER (f.status = 'failed') AS failed, count(*) FILTER (f.status = 'inconclusive') AS inconclusive,
  CASE WHEN count(*) FILTER (f.status = 'inconclusive') > 0 OR count(*) < 5 THEN 'inconclusive' WHEN count(*) FILTER (f.status = 'failed') > 0 OR NOT coalesce(first(w.lift >= 0 AND w.ratio >= 1.25), false) THEN 'rejected' ELSE 'tested' END AS decision
FROM {compared_sql('symbol, fold', 'p4')} f JOIN {compared_sql('symbol', 'p4')} w USING (symbol) GROUP BY f.symbol""")
def quoting_stability(spark, d):
    """Whether calm pairs do better in every fold and in all."""
    return quoting.stable(judged(spark, d, "symbol", "fold"), judged(spark, d, "symbol"), floors=FLOORS)


@query(NETS + f""", h AS (SELECT *, row < n_rows // 2 AS known FROM nets WHERE net IS NOT NULL),
m AS (SELECT symbol, variant, known, count(*) AS n, avg(net) AS m, coalesce(avg(net) / nullif(stddev_samp(net), 0), 0) AS sr FROM h GROUP BY ALL),
s AS (SELECT symbol, variant, known, m.n, sr, avg(pow(h.net - m.m, 2)) AS m2, avg(pow(h.net - m.m, 3)) AS m3, avg(pow(h.net - m.m, 4)) AS m4 FROM h JOIN m USING (symbol, variant, known) GROUP BY ALL),
k AS (SELECT a.symbol, a.variant, a.n AS train_n, coalesce(b.n, 0) AS test_n, a.sr AS train_sharpe, coalesce(b.sr, 0) AS test_sharpe, greatest(1e-12, 1 - coalesce(a.m3 / nullif(pow(a.m2, 1.5), 0), 0) * a.sr + (coalesce(a.m4 / nullif(a.m2 * a.m2, 0), 3) - 1) / 4 * a.sr * a.sr) AS scale
  FROM (SELECT * FROM s WHERE known) a LEFT JOIN (SELECT * FROM s WHERE NOT known) b ON a.symbol = b.symbol AND a.variant = b.variant)
SELECT symbol, variant, train_n, test_n, {six("train_sharpe")} AS train_sharpe, {six("test_sharpe")} AS test_sharpe, {six("CASE WHEN train_sharpe = 0 THEN CASE WHEN test_sharpe <= 0 THEN 0 ELSE 'inf'::DOUBLE END ELSE test_sharpe / train_sharpe END")} AS efficiency,
  CASE WHEN train_sharpe <= 0 THEN 999999 ELSE coalesce((SELECT min(n) FROM (SELECT unnest([50, 100, 200, 500, 1000, 2000, 5000]) AS n) WHERE train_sharpe * sqrt(n - 1) / sqrt(scale) >= 1.6448536269514722), 5000) END::INT AS shortest FROM k""")
def split_records(spark, d):
    """Each variant's first half against its second, and how long a record its first half would need."""
    return selection.split_records(cross_nets(spark, d))


@query(RUN + f""", e0 AS (SELECT symbol, ts, {product("OVER w")} AS equity, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM run WHERE net IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
e1 AS (SELECT *, CASE WHEN i < n // 3 THEN 'trend' WHEN i < 2 * n // 3 THEN 'range' ELSE 'high_vol' END AS regime FROM e0),
e2 AS (SELECT *, equity / nullif(lag(equity) OVER w, 0) - 1 AS r, max(equity) OVER w AS top FROM e1 WINDOW w AS (PARTITION BY symbol, regime ORDER BY ts)),
e3 AS (SELECT symbol, regime, count(*) AS bars, coalesce(avg(r) / nullif(stddev_pop(r), 0), 0) * sqrt({YEAR}) AS sharpe, sum(greatest(r, 0)) AS wins, -sum(least(r, 0)) AS losses, max(top - equity) / nullif(max(top), 0) AS max_drawdown FROM e2 GROUP BY ALL HAVING count(*) > 1)
SELECT symbol, regime, bars, {six("sharpe")} AS sharpe, {six("CASE WHEN losses > 0 THEN wins / losses WHEN wins > 0 THEN 'inf'::DOUBLE ELSE 0 END")} AS profit_factor, {six("max_drawdown")} AS max_drawdown,
  sharpe > -0.5 AND count(*) FILTER (sharpe > 0.5) OVER (PARTITION BY symbol) <> 1 AS passed FROM e3""")
def regime_records(spark, d):
    """The moving-average rule in three equal stretches of time; nothing passes if only one of them earns."""
    return selection.regime_records(sma_run(spark, d), YEAR)
