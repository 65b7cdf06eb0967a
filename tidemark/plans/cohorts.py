"""Queries over closed trades (the lines of orders), with their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.indicators import c
from ..operators import cohorts
from ..sources import market
from .market import query, six

CHARGES, SMALL, LARGE, EQUITY = (1, 2, 3), 25, 40, (1e6, 2e6)

LINES = """, ln AS (SELECT l_returnflag AS symbol, l_orderkey AS position, l_shipdate AS ts, l_orderkey * 8 + l_linenumber AS seq, CASE WHEN l_linenumber % 2 = 1 THEN 'BUY' ELSE 'SELL' END AS side, l_linestatus AS status, l_quantity AS lots,
  round(l_extendedprice * 100)::BIGINT % 20001 - 10000 AS net, year(l_shipdate)::INT AS period FROM lineitem)
"""


def lines(spark, d):
    """Lines as closed trades: the last digits of their prices, in cents, are what they earned."""
    t = market.table(spark, d, "lineitem")
    net = F.round(c("l_extendedprice") * 100).cast("long") % 20001 - 10000
    return t.select(c("l_returnflag").alias("symbol"), c("l_orderkey").alias("position"), c("l_shipdate").alias("ts"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("seq"), F.when(c("l_linenumber") % 2 == 1, "BUY").otherwise("SELL").alias("side"), c("l_linestatus").alias("status"), c("l_quantity").alias("lots"), net.alias("net"), F.year("l_shipdate").alias("period"))


KINDS = {"whole": "'whole'", "side": "side", "flag": "symbol", "status": "status", "week": "strftime(ts, '%G-W%V')"}


@query(LINES + ", k AS (" + " UNION ALL ".join(f"SELECT '{kind}' AS kind, {name} AS name, net FROM ln" for kind, name in KINDS.items()) + f""")
SELECT kind, name, count(*) AS trades, {six("sum(net)")} AS total, {six("avg(net)")} AS mean, {six("quantile_cont(net, 0.5)")} AS median, {six("avg((net > 0)::INT)")} AS win_rate, {six("avg(net) FILTER (net > 0)")} AS mean_win, {six("avg(net) FILTER (net < 0)")} AS mean_loss,
  {six("-avg(net) FILTER (net < 0) / (avg(net) FILTER (net > 0) - avg(net) FILTER (net < 0))")} AS hurdle FROM k GROUP BY kind, name""")
def trade_breakdowns(spark, d):
    """All trades, and those of each side, flag, status and week."""
    t = lines(spark, d)
    return cohorts.breakdowns(t, c("net"), {"side": c("side"), "flag": c("symbol"), "status": c("status"), "week": cohorts.iso_week("ts")})


#: The last rule knows the outcome: a control that must win in every year.
RULES = {"all": "true", "small": f"lots <= {SMALL}", "no_large_buys": f"NOT (side = 'BUY' AND lots > {LARGE})", "in_hindsight": "net > 0"}
KEPT = LINES + ", v AS (" + " UNION ALL ".join(
    f"""SELECT period, '{name}' AS variant, count(*) FILTER ({rule}) AS positions, count(*) FILTER ({rule} AND net > 0) AS wins, coalesce(sum(net) FILTER ({rule}), 0)::BIGINT AS net, coalesce(sum(lots) FILTER ({rule}), 0) AS size,
  count(*) FILTER (NOT ({rule})) AS excluded, coalesce(sum(net) FILTER (NOT ({rule})), 0)::BIGINT AS excluded_net, sum(net)::BIGINT AS whole FROM ln GROUP BY period"""
    for name, rule in RULES.items()
) + ")\n"


def kept(spark, d):
    return cohorts.kept_variants(lines(spark, d), c("net"), c("lots"), {name: F.expr(rule) for name, rule in RULES.items()}, CHARGES)


@query(KEPT + f"SELECT period, variant, positions, wins, {six('wins / nullif(positions, 0)')} AS win_rate, net, {six('size')} AS size, {', '.join(six(f'net - {x} * size') + f' AS after_{x}' for x in CHARGES)}, excluded, excluded_net, net - whole AS delta FROM v")
def kept_trades(spark, d):
    """Each year's trades under rules that would have left some out."""
    return kept(spark, d).select("period", "variant", "positions", "wins", "win_rate", "net", "size", *[F.get("after", F.lit(i)).alias(f"after_{x}") for i, x in enumerate(CHARGES)], "excluded", "excluded_net", "delta")


@query(KEPT + f"SELECT variant, count(*) AS periods, bool_and(net > whole) AS better, bool_and(net - {CHARGES[1]} * size > 0) AS above FROM v GROUP BY variant")
def kept_in_every_year(spark, d):
    return cohorts.in_every_period(kept(spark, d), 1)


@query(LINES + f""", r AS (SELECT *, sum(net) OVER w AS run FROM ln WINDOW w AS (PARTITION BY symbol, side ORDER BY ts, seq)), f AS (SELECT *, greatest(0, max(run) OVER w) - run AS fall FROM r WINDOW w AS (PARTITION BY symbol, side ORDER BY ts, seq)),
a AS (SELECT symbol, side, count(*) AS deals, sum(net) AS net, max(fall) AS fall FROM f GROUP BY ALL), p AS (SELECT symbol, side, position, sum(net) AS net FROM ln GROUP BY ALL),
b AS (SELECT symbol, side, count(*) AS positions, sum(greatest(net, 0)) AS win, -sum(least(net, 0)) AS loss FROM p GROUP BY ALL)
SELECT symbol, side, deals, positions, {six("net")} AS net, {six("net / positions")} AS expectancy, {six("win / nullif(loss, 0)")} AS profit_factor, {six(f"greatest(0, fall) * 100 / {EQUITY[0]}")} AS drawdown_pct FROM a JOIN b USING (symbol, side)""")
def ledger_arms(spark, d):
    """Each flag's and side's ledger: positions, expectancy and the deepest fall of its running net."""
    return cohorts.ledger_arm(lines(spark, d), EQUITY[0], ("symbol", "side"))


@query(LINES + f""", x AS (SELECT symbol, ts::DATE AS day, sum(CASE WHEN side = 'BUY' THEN net * 100 / {EQUITY[0]} ELSE -net * 100 / {EQUITY[1]} END) AS x FROM ln GROUP BY ALL), e AS (SELECT symbol, min(day) AS a, max(day) AS b FROM x GROUP BY symbol),
y AS (SELECT symbol, unnest(generate_series(a, b, INTERVAL 1 DAY))::DATE AS day FROM e), v AS (SELECT symbol, day, coalesce(x, 0) AS net, row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM y LEFT JOIN x USING (symbol, day)),
z AS (SELECT DISTINCT symbol, n FROM v), dr AS (SELECT symbol, n, unnest(range(0, 200)) AS draw FROM z), b AS (SELECT *, unnest(range(0, ceil(n / 7)::BIGINT)) AS b FROM dr),
s AS (SELECT symbol, n, draw, b, unnest(range(0, 7)) AS o, (('0x' || substr(md5('0:' || draw || ':' || b), 1, 12))::BIGINT % n) AS i FROM b),
m AS (SELECT s.symbol, s.draw, avg(v.net) AS mean FROM s JOIN v ON v.symbol = s.symbol AND v.i = (s.i + s.o) % s.n GROUP BY ALL), l AS (SELECT symbol, list_sort(list(mean))[2] AS low FROM m GROUP BY symbol)
SELECT symbol, count(*) AS days, {six("avg(net)")} AS mean, {six("CASE WHEN count(*) >= 28 THEN first(low) END")} AS lower FROM v JOIN l USING (symbol) GROUP BY symbol""")
def ledger_comparison(spark, d):
    """Bought lines against sold ones, day by day, with the first percentile of draws of weeks."""
    t = lines(spark, d)
    return cohorts.compare_ledgers(t.where("side = 'BUY'"), t.where("side = 'SELL'"), EQUITY, 200)
