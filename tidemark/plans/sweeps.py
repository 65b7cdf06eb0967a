"""Queries over sessions, unbroken runs, centred events, lags and canonical text, with their twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import canonical, clock, timing
from ..functions.indicators import c
from ..operators import centred, impulse, sessions, signals
from ..operators.resample import ticks_to_bars
from ..sources import market
from .market import COST, FAMILIES, IMPULSE, NUMBERED, YEAR, W, bars6, query, six


def bars_sql(width: str) -> str:
    """b1: bars of a width, as ticks_to_bars() makes them."""
    return f""", b1 AS (SELECT symbol, b AS ts, first(mid_c ORDER BY ts, seq) / 100::DOUBLE AS open, max(mid_c) / 100::DOUBLE AS high, min(mid_c) / 100::DOUBLE AS low, last(mid_c ORDER BY ts, seq) / 100::DOUBLE AS close
  FROM (SELECT *, time_bucket(INTERVAL '{width}', ts, TIMESTAMP '1970-01-01') AS b FROM ticks) GROUP BY symbol, b)
"""


#: The mean true range from its weights: 1 for the first bar and 1/14 for others, times 13/14 for each bar since.
MEAN_RANGE = """, tr0 AS (SELECT *, row_number() OVER w - 1 AS i, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM b1 WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
tr1 AS (SELECT *, CASE WHEN i >= 13 THEN (SELECT sum(y.tr * (CASE WHEN y.i = 0 THEN 1 ELSE 1 / 14.0::DOUBLE END) * pow(13 / 14.0::DOUBLE, x.i - y.i)) FROM tr0 y WHERE y.symbol = x.symbol AND y.i <= x.i AND y.i > x.i - 700) END AS atr FROM tr0 x)
"""


@query(bars_sql("15 minutes") + MEAN_RANGE + f""", d0 AS (SELECT *, ts::DATE AS day, hour(ts) AS h FROM tr1),
d1 AS (SELECT *, max(high) FILTER (h < 7) OVER p AS top, min(low) FILTER (h < 7) OVER p AS bottom, count(*) FILTER (h < 7) OVER p AS known FROM d0 WINDOW p AS (PARTITION BY symbol, day)),
d2 AS (SELECT *, CASE WHEN h >= 7 AND h < 16 AND known >= 8 THEN CASE WHEN close > top + 0.25 * atr THEN 1 WHEN close < bottom - 0.25 * atr THEN -1 END END AS side FROM d1),
d3 AS (SELECT symbol, day, min(ts) AS entry, arg_min(side, ts) AS side FROM d2 WHERE side IS NOT NULL GROUP BY ALL),
d4 AS (SELECT d2.*, d3.entry, d3.side AS first FROM d2 LEFT JOIN d3 USING (symbol, day)),
d5 AS (SELECT symbol, ts, close, CASE WHEN atr IS NOT NULL THEN CASE WHEN h < 7 OR h >= 19 OR entry IS NULL OR ts < entry THEN 0 ELSE first END END AS position, CASE WHEN ts = entry THEN CASE WHEN first > 0 THEN close - bottom ELSE top - close END END AS stop FROM d4)
SELECT symbol, ts, position::INT AS position, {six("stop")} AS stop_distance, {six("CASE WHEN stop > 0 THEN least(1.0, 0.01 / (stop / close)) END")} AS size FROM d5""")
def session_breakout_positions(spark, d):
    """Closes of 15 minutes that leave the night's range by a quarter of a mean true range."""
    return sessions.session_breakout(ticks_to_bars(market.ticks(spark, d), "15 minutes"), 0.25).select("symbol", "ts", "position", "stop_distance", "size")


@query(bars_sql("1 hour") + """, r0 AS (SELECT *, row_number() OVER w AS n, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap FROM b1 WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
r1 AS (SELECT *, n - max(CASE WHEN gap IS NULL OR gap <> 3600000000 THEN n END) OVER (PARTITION BY symbol ORDER BY ts) + 1 AS run FROM r0),
r2 AS (SELECT *, sign(close / lag(close, 12) OVER w - 1) AS t, sign(close / lag(close, 4) OVER w - 1) AS m, max(high) OVER (w ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING) AS top, min(low) OVER (w ROWS BETWEEN 32 PRECEDING AND 1 PRECEDING) AS bottom FROM r1 WINDOW w AS (PARTITION BY symbol ORDER BY ts))
SELECT symbol, ts, run::BIGINT AS run, CASE WHEN run >= 13 THEN t ELSE 0 END::INT AS trend, CASE WHEN run >= 5 THEN -m ELSE 0 END::INT AS reversal, CASE WHEN run >= 33 AND close > top THEN 1 WHEN run >= 33 AND close < bottom THEN -1 ELSE 0 END::INT AS breakout, CASE WHEN run >= 5 AND hour(ts) BETWEEN 7 AND 17 THEN m ELSE 0 END::INT AS session FROM r2""")
def unbroken_run_rules(spark, d):
    """Four rules on hourly bars that wait until no hour has been missing for as long as they look back."""
    t = sessions.run_rules(ticks_to_bars(market.ticks(spark, d), "1 hour"), 3600)
    return t.select("symbol", "ts", c("run").cast("long").alias("run"), "trend", "reversal", "breakout", "session")


CENTRES = NUMBERED + """, sp AS (SELECT symbol, min(epoch_us(ts)) + (max(epoch_us(ts)) - min(epoch_us(ts))) * 60 // 100 AS border FROM ticks GROUP BY symbol),
c0 AS (SELECT symbol, row, ts, bid_c + ask_c AS m, ask_c - bid_c AS spread, bid_c > 0 AND ask_c > 0 AS ok, epoch_us(ts) < border AS before FROM num JOIN sp USING (symbol)),
c1 AS (SELECT *, lag(m) OVER w AS m0, lead(m) OVER w AS m1, lead(m, 2) OVER w AS m2, lag(spread) OVER w AS s0, lead(spread) OVER w AS s1, lag(ok) OVER w AND ok AND lead(ok) OVER w AS fit, lag(before) OVER w AND before AND lead(before) OVER w AS known,
  lead(ok, 2) OVER w AND lead(before, 2) OVER w AS fit2, epoch_us(lead(ts) OVER w) - epoch_us(ts) <= 600000000 AS near FROM c0 WINDOW w AS (PARTITION BY symbol ORDER BY row)),
ce AS (SELECT *, sign(m - m0) AS side, (-sign(m - m0) * (m1 - m) / 2 - spread)::DOUBLE AS net, CASE WHEN fit2 THEN -sign(m - m0) * (m2 - m) / 2 - spread END / (m / 2) * 1e4 AS late, -sign(m - m0) * sign(m1 - m) AS turned, row % 3 = 0 AS apart, s0 < 0 OR spread < 0 OR s1 < 0 AS inverted FROM c1 WHERE fit AND abs(m - m0) > 2 * s0 AND m <> m0)
"""


@query(CENTRES + f"""SELECT symbol, count(*) FILTER (known) AS events, count(*) FILTER (known AND turned = 1) AS turns, count(*) FILTER (known AND turned = -1) AS goes_on, count(*) FILTER (known AND turned = 0) AS stays, {six("avg(net) FILTER (known)")} AS mean_net_c, {six("avg(net / (m / 2) * 1e4) FILTER (known)")} AS mean_net_bps, count(*) FILTER (known AND net > 0) AS gains,
  count(*) FILTER (known AND near) AS near_events, count(*) FILTER (known AND near AND turned = 1) AS near_turns, {six("avg(net / (m / 2) * 1e4) FILTER (known AND near)")} AS near_net_bps, count(late) FILTER (known) AS late_events, {six("avg(late) FILTER (known)")} AS late_net_bps,
  count(*) FILTER (known AND apart) AS apart_events, count(*) FILTER (known AND apart AND turned = 1) AS apart_turns, count(*) FILTER (known AND apart AND turned = -1) AS apart_goes_on, {six("avg(net / (m / 2) * 1e4) FILTER (known AND apart)")} AS apart_net_bps, count(*) FILTER (known AND apart AND net > 0) AS apart_gains,
  {six("(count(*) FILTER (known AND apart AND turned = 1) - count(*) FILTER (known AND apart AND turned = -1)) / nullif(sqrt(count(*) FILTER (known AND apart AND turned <> 0)), 0)")} AS z, count(*) FILTER (known AND inverted) AS inverted_events, count(*) FILTER (NOT known) AS beyond FROM ce GROUP BY symbol""")
def centred_events(spark, d):
    """Moves beyond the spread and the row after them, in the first 60 % of each symbol's time; near: within ten minutes."""
    return centred.centre_sums(centred.centres(market.ticks(spark, d), gap_s=600))


LAGS = """, s0 AS (SELECT *, close / nullif(lag(close) OVER w, 0) - 1 AS r, CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) = 20 THEN sign(avg(close) OVER (w ROWS 4 PRECEDING) - avg(close) OVER (w ROWS 19 PRECEDING)) END AS position FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
s1 AS (""" + " UNION ALL ".join(f"SELECT symbol, {k} AS lag, r, coalesce(lag(position, {k + 1}) OVER w, 0)::DOUBLE AS held, coalesce(lag(position, {k + 2}) OVER w, 0)::DOUBLE AS was FROM s0 WINDOW w AS (PARTITION BY symbol ORDER BY ts)" for k in range(4)) + """),
s2 AS (SELECT symbol, lag, r, held * r - abs(held - was) * 2 / 1e4 AS net FROM s1 WHERE r IS NOT NULL),
s3 AS (SELECT symbol, lag, count(*) AS n, avg(r) AS mx, avg(net) AS my, regr_sxx(net, r) AS sxx, regr_sxy(net, r) AS sxy, regr_syy(net, r) AS syy FROM s2 GROUP BY ALL),
sw AS (SELECT symbol, lag, n, sxy / sxx AS beta, (my - sxy / sxx * mx) * 1460 AS alpha_ann, (my - sxy / sxx * mx) / sqrt((syy - sxy * sxy / sxx) / (n - 2) * (1 / n::DOUBLE + mx * mx / sxx)) AS alpha_t FROM s3)
"""


def sweep(spark, d):
    return timing.lag_sweep(bars6(spark, d).withColumn("position", signals.sma_cross(5, 20)), "position", cost_bps=COST, bars_per_year=YEAR)


@query(LAGS + f"SELECT symbol, lag::INT AS lag, n, {six('beta')} AS beta, {six('alpha_ann')} AS alpha_ann, {six('alpha_t')} AS alpha_t FROM sw")
def lag_sweep(spark, d):
    """The moving-average rule at lags of 0 to 3 bars."""
    return sweep(spark, d)


@query(LAGS + f"""SELECT a.symbol, 1 AS required_lag, {six('b.alpha_ann')} AS alpha_ann, {six('b.alpha_t')} AS alpha_t, {six('a.alpha_ann')} AS lag0_alpha_ann, {six('a.alpha_t')} AS lag0_alpha_t, {six('a.alpha_t - b.alpha_t')} AS decay, b.alpha_ann > 0 AND b.alpha_t >= 0.5 AS survives FROM sw a JOIN sw b ON a.symbol = b.symbol AND a.lag = 0 AND b.lag = 1""")
def lag_survivors(spark, d):
    """Whether the rule holds at the lag that a morning price and an evening driver require."""
    lag = timing.required_lag(timing.PRICE_HOURS["lbma_am_fix"], timing.DRIVER_HOURS["dxy_close"])
    return timing.survives(sweep(spark, d), lag, 0.5)


@query(""", dr AS (SELECT o_orderdate::DATE AS ts, max(o_totalprice) AS level, min(length(o_orderstatus)) AS width FROM orders GROUP BY 1), pr AS (SELECT DISTINCT l_shipdate::DATE AS ts FROM lineitem)
SELECT count(*) AS driver_rows, (SELECT count(*) FROM pr) AS price_rows, (SELECT count(*) FROM dr JOIN pr USING (ts)) AS overlapping, concat_ws(',', CASE WHEN min(level) IS NOT DISTINCT FROM max(level) THEN 'level' END, CASE WHEN min(width) IS NOT DISTINCT FROM max(width) THEN 'width' END) AS constant,
  (SELECT count(*) FROM dr JOIN pr USING (ts)) > 0 AND min(level) IS DISTINCT FROM max(level) AND min(width) IS DISTINCT FROM max(width) AS usable FROM dr""")
def driver_alignment(spark, d):
    """Days of orders as drivers of shipping days; the width of their states never changes."""
    o = market.table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("ts")).agg(F.max("o_totalprice").alias("level"), F.min(F.length("o_orderstatus")).alias("width"))
    p = market.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("ts")).distinct()
    return timing.alignment(o, p, "ts", ["level", "width"])


@query(r""", e AS (SELECT event_id, event_type, user_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE '"' || replace(event_type, '"', '\"') || '"' END AS label, json_extract(props, '$.k')::BIGINT AS k FROM events)
SELECT event_id, '{"label":' || coalesce(label, 'null') || ',"props":{"a":' || user_id || CASE WHEN k IS NULL THEN '' ELSE ',"k":' || CASE WHEN user_id % 2 = 0 THEN -user_id ELSE k END END || '},"tags":["' || event_type || '",null]}' AS text, sha256('{"label":' || coalesce(label, 'null') || ',"props":{"a":' || user_id || CASE WHEN k IS NULL THEN '' ELSE ',"k":' || CASE WHEN user_id % 2 = 0 THEN -user_id ELSE k END END || '},"tags":["' || event_type || '",null]}') AS digest FROM e""")
def canonical_events(spark, d):
    """Every event as key-sorted text: its properties, merged with values of its own that win, a label and tags."""
    e = market.table(spark, d, "events").withColumn("_p", F.from_json("props", "map<string,bigint>"))
    own = F.map_concat(F.create_map(F.lit("a"), c("user_id")), F.when((c("user_id") % 2 == 0) & c("_p.k").isNotNull(), F.create_map(F.lit("k"), -c("user_id"))).otherwise(F.map_filter(F.create_map(F.lit("k"), c("user_id")), lambda k, v: F.lit(False))))
    row = F.struct(F.array("event_type", F.lit(None).cast("string")).alias("tags"), canonical.merged("_p", own).alias("props"), F.when(c("event_id") % 10 != 0, c("event_type")).alias("label"))
    e = e.select("event_id", row.alias("row"))
    of = e.schema["row"].dataType
    return e.select("event_id", canonical.canonical_json("row", of).alias("text"), canonical.digest("row", of).alias("digest"))


TRIALS = """, t AS (SELECT event_type AS family, 'm' || user_id % 3 AS mechanism, ['f' || event_id % 4, 'f' || user_id % 2] AS features, CASE WHEN user_id % 2 = 0 THEN ['k', 'w'] ELSE ['k'] END AS keys FROM events),
tf AS (SELECT substr(sha256('{"family": "' || family || '", "features": ["' || array_to_string(list_sort(features), '", "') || '"], "mechanism": "' || mechanism || '", "param_keys": ["' || array_to_string(keys, '", "') || '"]}'), 1, 12) AS fingerprint FROM t)
"""


def trials(spark, d):
    """Events as trials: their values are parameters, and only the names of parameters tell ideas apart."""
    own = F.when(c("user_id") % 2 == 0, F.create_map(F.lit("w"), c("value"), F.lit("k"), c("value"))).otherwise(F.create_map(F.lit("k"), c("value")))
    features = F.array(F.concat(F.lit("f"), c("event_id") % 4), F.concat(F.lit("f"), c("user_id") % 2))
    return market.table(spark, d, "events").select(c("event_type").alias("family"), F.concat(F.lit("m"), c("user_id") % 3).alias("mechanism"), features.alias("features"), own.alias("params"))


@query(TRIALS + "SELECT fingerprint, count(*) AS trials FROM tf GROUP BY fingerprint")
def trial_clusters(spark, d):
    return canonical.clusters(trials(spark, d))


@query(TRIALS + "SELECT count(*) AS total_trials, count(DISTINCT fingerprint) AS distinct_hypotheses, (SELECT max(n) FROM (SELECT count(*) AS n FROM tf GROUP BY fingerprint)) AS largest_cluster FROM tf")
def trial_novelty(spark, d):
    return canonical.novelty(trials(spark, d))


STUDY = IMPULSE + "d AS (" + " UNION ALL ".join(f"SELECT symbol, ts, n - 1 AS row, '{k}' AS family, coalesce(({x})::INT, 0) AS direction FROM i1 {W}" for k, x in FAMILIES.items()) + f"""),
e AS (SELECT *, row_number() OVER (PARTITION BY symbol, family ORDER BY row) AS k FROM d WHERE direction <> 0),
f AS (SELECT symbol, family, k, row AS last, true AS taken FROM e WHERE k = 1 UNION ALL
  SELECT e.symbol, e.family, e.k, CASE WHEN e.row > f.last + 4 THEN e.row ELSE f.last END, e.row > f.last + 4 FROM f JOIN e ON e.symbol = f.symbol AND e.family = f.family AND e.k = f.k + 1),
t AS (SELECT e.symbol, e.family, e.row, e.direction AS taken FROM e JOIN f ON e.symbol = f.symbol AND e.family = f.family AND e.k = f.k AND f.taken),
px AS (SELECT symbol, row_number() OVER w - 1 AS row, count(*) OVER (PARTITION BY symbol) AS rows, lead(close, 1) OVER w AS c0, lead(close, 5) OVER w AS c4, lead(close, 13) OVER w AS c12 FROM bars {W}),
g0 AS (SELECT d.symbol, d.family, d.row, px.rows, t.taken, c0, c4, c12, max(CASE WHEN t.taken IS NOT NULL THEN d.row END) OVER (PARTITION BY d.symbol, d.family ORDER BY d.row) AS last,
  CASE WHEN d.row < floor(px.rows * 0.6::DOUBLE) THEN 'discovery' WHEN d.row < floor(px.rows * 0.8::DOUBLE) THEN 'validation' END AS split FROM d JOIN px ON px.symbol = d.symbol AND px.row = d.row LEFT JOIN t ON t.symbol = d.symbol AND t.family = d.family AND t.row = d.row),
g1 AS (SELECT *, taken IS NOT NULL AS event, (CASE horizon WHEN 4 THEN c4 ELSE c12 END / nullif(c0, 0) - 1) * 1e4 AS move, coalesce(taken, CASE WHEN ('0x' || substr(md5('0:' || symbol || ':' || row), 1, 1))::INT % 2 = 0 THEN 1 ELSE -1 END) AS side FROM g0, (VALUES (4), (12)) AS hz(horizon) WHERE split IS NOT NULL),
g2 AS (SELECT symbol, family, horizon, unnest([split, 'pooled']) AS split, event, side, side * move AS ret FROM g1 WHERE event OR row >= 26 AND row < rows - (1 + horizon) AND (last IS NULL OR row - last > 1 + horizon)),
g3 AS (SELECT symbol, family, horizon, split, count(*) FILTER (event) AS detected, count(ret) FILTER (event) AS measured, count(*) FILTER (event AND ret > 0) AS continued, count(*) FILTER (event AND ret < 0) AS reversed, count(*) FILTER (event AND side > 0) AS longs, count(ret) FILTER (NOT event) AS baseline,
  count(*) FILTER (NOT event AND ret > 0) AS baseline_continued, avg(ret) FILTER (event) AS gross, stddev_samp(ret) FILTER (event) AS sd, avg(ret - 2) FILTER (event AND side > 0) AS long_net, avg(ret - 2) FILTER (event AND side < 0) AS short_net FROM g2 GROUP BY ALL),
g4 AS (SELECT *, coalesce(baseline_continued / nullif(baseline, 0)::DOUBLE, 0.5) AS rate, continued / nullif(measured, 0)::DOUBLE AS pa, baseline_continued / nullif(baseline, 0)::DOUBLE AS pb FROM g3),
g5 AS (SELECT *, least(greatest(rate, 1e-9), 1 - 1e-9) AS q, list_transform(generate_series(0, measured), lambda i: lgamma(measured + 1) - lgamma(i + 1) - lgamma(measured - i + 1) + i * ln(least(greatest(rate, 1e-9), 1 - 1e-9)) + (measured - i) * ln(1 - least(greatest(rate, 1e-9), 1 - 1e-9))) AS logs FROM g4),
g6 AS (SELECT *, CASE WHEN measured = 0 THEN 1 ELSE least(1.0, round(list_sum(list_transform(list_filter(logs, lambda x: x <= logs[continued + 1] + 1e-9), lambda x: exp(x))), 12)) END AS p FROM g5),
g7 AS (SELECT *, (count(*) OVER h - row_number() OVER (h ORDER BY p) + 1) * p AS raw FROM g6 WINDOW h AS (PARTITION BY symbol, horizon, split)),
g8 AS (SELECT *, least(1.0, max(raw) OVER (PARTITION BY symbol, horizon, split ORDER BY p, raw DESC ROWS UNBOUNDED PRECEDING)) AS p_holm, sqrt(pa * (1 - pa) / measured + pb * (1 - pb) / baseline) * 1.959963984540054 AS half FROM g7)
"""


def impulse_results(spark, d):
    return impulse.study(impulse.measured(bars6(spark, d), suppress=4, k=1.2), COST)


@query(STUDY + f"""SELECT symbol, family, horizon, split, detected, measured, continued, reversed, longs, baseline, baseline_continued, {six("rate")} AS baseline_rate, {six("coalesce(pa - pb, 0)")} AS diff, {six("coalesce(pa - pb - half, 0)")} AS diff_low, {six("coalesce(pa - pb + half, 0)")} AS diff_high,
  {six("gross")} AS gross_bps, {six("gross - 2")} AS net_bps, {six("long_net")} AS long_net_bps, {six("short_net")} AS short_net_bps, {six("(gross - 2) / nullif(sd, 0)")} AS sharpe, {six("p")} AS p, {six("p_holm")} AS p_holm FROM g8""")
def impulse_study(spark, d):
    """All families of impulses at two horizons against bars without events; the last fifth of time is never measured."""
    return impulse_results(spark, d)


@query(STUDY + f"SELECT symbol, family, horizon, times, {six('gross - times * 2')} AS net_bps FROM g3, (VALUES (0.5::DOUBLE), (1), (2), (3)) AS x(times) WHERE split = 'pooled'")
def impulse_costs(spark, d):
    return impulse.cost_sweep(impulse_results(spark, d), COST)


def server_utc_sql(zone: str, winter: int) -> str:
    probe = "(stamp - INTERVAL 3 HOUR)"
    summer = f"epoch(({probe} AT TIME ZONE 'UTC') AT TIME ZONE '{zone}') - epoch({probe}) <> {winter}"
    return f"CASE WHEN {summer} THEN {probe} ELSE stamp - INTERVAL 2 HOUR END"


@query(f""", st AS (SELECT l_shipdate::DATE AS day, l_shipdate::TIMESTAMP + to_hours((l_orderkey % 24)::INT) AS stamp FROM lineitem),
su AS (SELECT day, stamp, {server_utc_sql("America/New_York", -18000)} AS ny, {server_utc_sql("Europe/Athens", 7200)} AS athens FROM st)
SELECT day, count(*) AS n, count(*) FILTER (stamp - ny = INTERVAL 3 HOUR) AS summer_ny, count(*) FILTER (stamp - athens = INTERVAL 3 HOUR) AS summer_athens, count(*) FILTER (ny <> athens) AS differ, min(ny) AS first_ny, max(athens) AS last_athens FROM su GROUP BY day""")
def server_stamps(spark, d):
    """Stamps of a server's clock over seven years as UTC, when it follows New York's summer time and when it follows Athens'; the two differ for some weeks each year."""
    t = market.table(spark, d, "lineitem").select(F.to_date("l_shipdate").alias("day"), (F.to_date("l_shipdate").cast("timestamp_ntz") + F.make_interval(hours=(c("l_orderkey") % 24).cast("int"))).alias("stamp"))
    t = t.withColumns({"ny": clock.server_to_utc(c("stamp")), "athens": clock.server_to_utc(c("stamp"), "Europe/Athens")})
    late = lambda x: F.unix_seconds(c("stamp").cast("timestamp")) - F.unix_seconds(c(x).cast("timestamp")) == 3 * 3600
    return t.groupBy("day").agg(F.count(F.lit(1)).alias("n"), F.count_if(late("ny")).alias("summer_ny"), F.count_if(late("athens")).alias("summer_athens"), F.count_if(c("ny") != c("athens")).alias("differ"), F.min("ny").alias("first_ny"), F.max("athens").alias("last_athens"))
