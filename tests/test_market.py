"""Every market query against its DuckDB twin, and operators on small frames."""

import datetime as dt
import random
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark import catalog
from tidemark.frames import along, carried_last, islands, numbered
from tidemark.functions import clock, inference, placebo, selection
from tidemark.operators import assays, backtest, checks, engine, evidence, ledger, panels, quality, signals
from tidemark.operators.asof import asof
from tidemark.operators.resample import ticks_to_bars
from tidemark.sources import market
from tidemark.streaming import observe

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return "~"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows = [r.asDict() for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows or name.startswith("impulse")
        return
    found = duck.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in rows) == want


def bars(spark, closes, symbol="x", hours=1):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(symbol, t0 + dt.timedelta(hours=i * hours), float(c), float(c) + 1, float(c) - 1, float(c), 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double")


def test_always_long_earns_the_price(spark):
    b = bars(spark, [100, 110, 99, 120]).withColumn("p", F.lit(1))
    m = backtest.metrics(backtest.run_vector(b, "p", 0.0), 252).first()
    assert m["total_return"] == pytest.approx(0.2) and m["trades"] == 1 and m["max_drawdown"] == pytest.approx(0.1)


def test_flat_position_costs_nothing(spark):
    b = bars(spark, [100, 110, 99, 120]).withColumn("p", F.lit(0))
    m = backtest.metrics(backtest.run_vector(b, "p", 5.0), 252).first()
    assert m["total_return"] == 0 and m["turnover"] == 0 and m["sharpe"] == 0


def test_losses_beyond_capital_turn_negative(spark):
    d = spark.createDataFrame([(-3.0,), (0.5,)], "net double")
    assert d.agg(backtest.compound("net").alias("x")).first()["x"] == pytest.approx(-3.0)


def test_positions_use_no_later_bar(spark):
    closes = [100 + (i * 37 % 23) - (i % 7) for i in range(60)]
    rule = lambda b: {(r["ts"], r["position"]) for r in signals.channel_rule(b, 5, 3).select("ts", "position").collect()}
    whole, part = rule(bars(spark, closes)), rule(bars(spark, closes[:40]))
    assert part <= whole


def test_asof_ties_strict_and_age(spark):
    left = bars(spark, [1, 2, 3]).select("symbol", "ts")
    right = bars(spark, [10, 20]).select("symbol", "ts", F.col("close").alias("value"))
    got = lambda **k: [r["value"] for r in asof(left, right, **k).orderBy("ts").collect()]
    assert got() == [10, 20, 20]
    assert got(strict=True) == [None, 10, 20]
    assert got(max_age_s=1) == [10, 20, None]
    assert asof(left.limit(0), right).count() == 0


def test_carried_last_over_days(spark):
    d = bars(spark, [1, 2, 3], hours=30).withColumn("v", F.when(F.col("close") == 1, 7))
    assert [r["v_last"] for r in carried_last(d, ["v"]).orderBy("ts").collect()] == [7, 7, 7]


def test_islands_treat_null_as_value(spark):
    d = bars(spark, [1, 1, 2, 1]).withColumn("v", F.when(F.col("close") == 1, F.lit(1)))
    assert [r["island"] for r in islands(d, "v").orderBy("ts").collect()] == [1, 1, 2, 3]


def test_first_passage_over_stretches(spark):
    t = market.ticks(spark, SF)
    small = assays.with_ahead(numbered(t).select("symbol", "row", "mid_c"), 8, 0, 16)
    assert small.where("own").count() == t.count()


def test_first_passage_against_brute_force():
    import numpy as np

    rng = np.random.default_rng(4)
    for horizon in (1, 3, 7, 64):
        mid = np.cumsum(rng.integers(-3, 4, 200))
        want = [next((j for j in range(1, horizon + 1) if i + j < 200 and abs(mid[i + j] - mid[i]) >= 5), 0) for i in range(200)]
        assert assays.passage(mid, 5, horizon).tolist() == want


def test_fifo_small(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, i, t + dt.timedelta(days=i), side, q, p) for i, (side, q, p) in enumerate([("buy", 5, 10), ("buy", 5, 20), ("sell", 7, 30), ("sell", 1, 5)])]
    f = spark.createDataFrame(rows, "position_key long, seq long, ts timestamp, side string, qty long, price_c long")
    got = sorted((r["open_seq"], r["close_seq"], r["qty"]) for r in ledger.fifo(f).collect())
    assert got == [(0, 2, 5), (1, 2, 2), (1, 3, 1)]
    last = ledger.average_cost(f).orderBy(F.desc("seq")).first()
    assert last["net_qty"] == 2 and last["avg_price_c"] == 15 and last["realized_c"] == -10


def test_gap_over_weekend_is_expected(spark):
    friday = dt.datetime(2024, 1, 5, 20)
    rows = [("x", s) for s in (friday, friday + dt.timedelta(hours=1), friday + dt.timedelta(days=2), friday + dt.timedelta(days=2, hours=5))]
    g = quality.gaps(spark.createDataFrame(rows, "symbol string, ts timestamp_ntz"), 3600).orderBy("gap_start").collect()
    assert [(r["missing"], r["expected"]) for r in g] == [(46, True), (4, False)]


def test_conflicting_chunks_are_refused(spark):
    b = bars(spark, [1, 2])
    assert market.merge_chunks(b.union(b)).count() == 2
    with pytest.raises(Exception, match="conflicting"):
        market.merge_chunks(b.union(b.withColumn("close", F.col("close") + 1))).collect()


def test_store_round_trip(spark, tmp_path):
    b = ticks_to_bars(market.ticks(spark, SF))
    market.write_bars(b, str(tmp_path), "6h", "v1")
    with pytest.raises(Exception, match="exist"):
        market.write_bars(b, str(tmp_path), "6h", "v1")
    assert market.latest_version(spark, str(tmp_path), "6h") == "v1" and market.usable_versions(spark, str(tmp_path)).count() == 1
    assert market.read_bars(spark, str(tmp_path), "6h", "v1").exceptAll(b.select(*market.BAR_COLUMNS)).count() == 0


def test_bar_csv(spark, tmp_path):
    (tmp_path / "b.csv").write_text("time,open,high,low,close\n2024-01-01 00:00:00,1,2,0.5,1.5\n")
    r = market.read_bar_csv(spark, str(tmp_path / "b.csv"), "x", 3600).first()
    assert r["volume"] == 1000 and r["close"] == 1.5 and str(r["close_time"]) == "2024-01-01 01:00:00"


def test_inference():
    assert inference.probabilistic_sharpe(0.0, 100, 0, 3) == pytest.approx(0.5)
    assert inference.deflated_sharpe(0.1, 10, 500, 0, 3) < inference.probabilistic_sharpe(0.1, 500, 0, 3)
    assert inference.binomial_two_sided(5, 10, 0.5) == pytest.approx(1.0) and inference.binomial_two_sided(0, 10, 0.5) == pytest.approx(2 / 1024)


def test_holm_and_folds(spark):
    t = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "k string, p double")
    assert {r["k"]: round(r["p_holm"], 6) for r in inference.holm(t).collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    assert inference.combinatorial_folds(spark, 100).count() == 30
    assert [r["test_end"] for r in inference.expanding_folds(spark, 100, 2, 0.4, 5, 5).orderBy("fold").collect()] == [80, 100]


def test_logistic_finds_the_sign(spark):
    d = spark.range(400).select(((F.col("id") % 20) - 10).cast("double").alias("x"), ((F.col("id") % 20) + (F.col("id") % 3) > 10).cast("int").alias("y"))
    w, _, _ = inference.ridge_logistic(d, ["x"], "y")
    assert w[1] > 1


def plan(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("x", t0 + dt.timedelta(days=i), *map(float, r[:4]), *r[4:]) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, open double, high double, low double, close double, target int, size double, stop_dist double")


def test_fixed_units_stop_inside_a_bar_and_bar_the_side(spark):
    p = plan(spark, [(100, 101, 99, 100, 1, 1.0, 5.0), (100, 102, 99, 101, 1, 1.0, 5.0), (101, 101, 90, 92, 1, 1.0, 5.0), (92, 120, 92, 120, None, None, None)])
    run = engine.run_plan(p, 0.0)
    assert [(t.entry, t.exit, round(t.pnl, 9), t.exit_reason) for t in engine.trades(run).collect()] == [(100.0, 95.0, -0.05, "stop")]
    assert [(r.side, round(r.equity, 9)) for r in run.orderBy("ts").collect()] == [(0, 1.0), (1, 1.01), (0, 0.95), (0, 0.95)]


def test_fixed_units_gap_through_a_stop_fills_at_the_open(spark):
    p = plan(spark, [(100, 100, 100, 100, -1, 0.5, 2.0), (100, 101, 99, 100, -1, 0.5, 2.0), (110, 111, 109, 110, 0, None, None)])
    t = engine.trades(engine.run_plan(p, 0.0)).first()
    assert (t.exit, round(t.pnl, 9)) == (110.0, -0.05)


def test_fixed_units_turn_pays_both_sides_and_the_end_closes(spark):
    p = plan(spark, [(100, 100, 100, 100, 1, 1.0, None), (100, 100, 100, 100, -1, 1.0, None), (100, 100, 100, 100, None, None, None)])
    t = engine.trades(engine.run_plan(p, 10.0)).orderBy("exit_ts", "entry_ts").collect()
    assert [x.exit_reason for x in t] == ["target", "end"] and all(abs(x.pnl / 0.002 + 1) < 0.01 for x in t)


def test_fixed_units_pay_financing_by_elapsed_days(spark):
    p = plan(spark, [(100, 100, 100, 100, 1, 1.0, None)] + [(100, 100, 100, 100, None, None, None)] * 3)
    assert abs(engine.run_plan(p, 0.0, 0.365).orderBy("ts").collect()[-1].equity - 0.998) < 1e-9


def test_fixed_units_of_no_bars(spark):
    assert engine.run_plan(plan(spark, [(1.0, 1.0, 1.0, 1.0, 1, 1.0, None)]).limit(0), 1.0).count() == 0


def test_missing_ranges_ignore_repeats_and_nulls(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("a", None), ("a", 5), ("b", 7)], "key string, n long")
    assert [tuple(r) for r in panels.missing_ranges(rows, "key", "n").collect()] == [("a", 2, 4, 3)]


def test_walk_forward_takes_the_better_variant_and_reports_later_rows(spark):
    rows = [("x", v, i, i, 40, (0.01 if v == "good" else -0.01) + 0.001 * (i % 2)) for i in range(40) for v in ("bad", "good")]
    nets = spark.createDataFrame(rows, "symbol string, variant string, ts int, row int, rows int, net double")
    got = selection.walk_forward(nets, 2).orderBy("fold").collect()
    assert [(r.variant, r.test_n, round(r.test_net, 6)) for r in got] == [("good", 10, 0.105), ("good", 10, 0.105)]
    assert selection.overfitting(nets).first().pbo == 0


def test_row_chain_depends_on_order_and_content(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("m", 1, "b"), ("m", 2, "a")], "k string, i int, t string")
    heads = {r.k: r.head for r in market.row_chain(rows, ["k"], ["i"], F.col("t")).collect()}
    assert heads["k"] != heads["m"]


def test_opening_range_drops_days_that_break_both_sides(spark):
    t = dt.datetime(2024, 1, 1)
    row = lambda day, hour, top, bottom: ("x", t + dt.timedelta(days=day, hours=hour), top, bottom)
    quotes = spark.createDataFrame([row(0, 8, 10, 5), row(0, 9, 10, 5), row(0, 10, 11, 6), row(1, 8, 10, 5), row(1, 9, 12, 3), row(2, 9, 12, 3)], "symbol string, ts timestamp_ntz, high_ask long, low_bid long")
    assert [(r.ts.hour, r.direction) for r in assays.opening_range(quotes, 8, 6).collect()] == [(10, 1)]


def stamped(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([("x", None if s is None else t0 + dt.timedelta(seconds=s), n) for s, n in rows], "symbol string, ts timestamp_ntz, seq long")


def test_nearest_match_uses_a_fill_once_and_later_of_ties(spark):
    got = evidence.nearest_match(stamped(spark, [(10, 1), (12, 2), (500, 3), (None, 4)]), stamped(spark, [(8, 11), (12, 12), (900, 13)]), 60)
    assert {r.seq: (r.fill_seq, r.distance_s) for r in got.collect()} == {1: (12, 2.0), 2: (11, 4.0), 3: (None, None), 4: (None, None)}


def test_nearest_match_equals_one_fold_over_all(spark):
    ticks = market.ticks(spark, SF).select("symbol", "ts", "seq").collect()
    left, right = [[t for t in ticks if t.seq % 2 == k] for k in (1, 0)]
    used, want = set(), {}
    for i in sorted(left, key=lambda t: (t.symbol, t.ts, t.seq)):
        near = [(-abs((f.ts - i.ts).total_seconds()), f.ts, f.seq) for f in right if f.symbol == i.symbol and f.seq not in used and abs((f.ts - i.ts).total_seconds()) <= 3600]
        want[i.seq] = max(near)[2] if near else None
        used.add(want[i.seq])
    t = market.ticks(spark, SF)
    got = {r.seq: r.fill_seq for r in evidence.nearest_match(t.where("seq % 2 = 1"), t.where("seq % 2 = 0"), 3600).collect()}
    assert got == want


def in_one_pass(intents, fills, within):
    """The places of fills that intents take, in order; rows are (second, seq), repeated rows count each for itself."""
    used, out = set(), []
    for at, seq in sorted(intents):
        near = [(-abs(f - at), f, n, k) for k, (f, n) in enumerate(fills) if k not in used and abs(f - at) <= within]
        used.add(max(near)[3] if near else None)
        out.append((seq, max(near)[2] if near else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("span", [5_000, 60_000])
def test_matching_in_rounds_equals_one_pass_over_a_dense_symbol(spark, span):
    draw = random.Random(span)
    left, right = [[(draw.randrange(span), draw.randrange(10**6)) for _ in range(n)] for n in (5000, 5000)]
    right = right[:-50] + right[:50]
    got = evidence.nearest_match(stamped(spark, left), stamped(spark, right), 30, slice_s=600)
    assert sorted([(r.seq, r.fill_seq) for r in got.collect()], key=str) == in_one_pass(left, right, 30)


def test_a_taken_fill_is_passed_on_over_many_slices(spark):
    """Every intent but the first finds its nearest fill taken by the one before, slice after slice."""
    right = [(100 * k, k) for k in range(13)]
    left = [(100 * k + 50 - (k == 0), k) for k in range(12)] + [(99, 99)]
    got = evidence.nearest_match(stamped(spark, left), stamped(spark, right), 50, slice_s=100)
    assert sorted([(r.seq, r.fill_seq) for r in got.collect()], key=str) == in_one_pass(left, right, 50)


def test_matching_without_rows_and_with_unknown_fields(spark):
    none = stamped(spark, [])
    assert evidence.nearest_match(none, none, 60).count() == 0
    some = spark.createDataFrame([(None, 10, 1), ("x", 10, None), ("x", None, 3)], "symbol string, s int, seq long")
    some = some.select("symbol", F.expr("timestamp_ntz '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, s)").alias("ts"), "seq")
    got = evidence.nearest_match(some, some, 60).collect()
    assert sorted([(r.symbol, r.seq, r.fill_seq, r.distance_s) for r in got], key=str) == sorted([(None, 1, 1, 0.0), ("x", None, None, 0.0), ("x", 3, None, None)], key=str)
    assert {r.fill_seq for r in evidence.nearest_match(some, none, 60).collect()} == {None}


def test_logs_and_reports_are_read_by_pattern(spark, tmp_path):
    (tmp_path / "a.log").write_text("12:00 deal #7 buy 0.10 at 1900.5\nnoise\n12:01 deal #8 sell x at 1901\n")
    rows = evidence.read_log(spark, str(tmp_path / "a.log"), r"deal #(\d+) (\w+) (\S+) at (\S+)", {"deal": "long", "side": "string", "lots": "double", "price": "double"}).orderBy("deal").collect()
    assert [tuple(r) for r in rows] == [(7, "buy", 0.1, 1900.5), (8, "sell", None, 1901.0)]
    (tmp_path / "r.html").write_text("<table><tr><th>Deal</th><th>Price</th></tr><tr><td>7</td>\n<td><b>1900.5</b></td></tr><tr><td>total</td></tr></table>")
    assert [r.cells for r in evidence.read_report_rows(spark, str(tmp_path / "r.html"), 2).orderBy("row").collect()] == [["Deal", "Price"], ["7", "1900.5"]]


def test_gates_refuse_unknown_values(spark):
    m = spark.createDataFrame([("x", None, 0.1)], "symbol string, sharpe double, max_drawdown double")
    got = {r.gate: r.passed for r in evidence.gates(m, {"s": ("sharpe", ">=", 0.5), "d": ("max_drawdown", "<=", 0.2)}).collect()}
    assert got == {"s": False, "d": True}


def test_short_rsi_rule_leaves_after_most_bars(spark):
    b = bars(spark, [10, 20, 30, 40, 39, 38, 37, 36]).withColumn("v", F.when(F.col("close") == 39, 1.0).otherwise(50.0))
    got = [r.position for r in signals.short_rsi_rule(b, "v", 5, 3, 2, 2).orderBy("ts").collect()]
    assert got == [0, 0, 0, 0, 1, 1, 0, 0]


def test_batches_are_appended_once_and_in_order(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("x", t + dt.timedelta(hours=i), i, 7, 100 + i) for i in range(4)]
    batch = spark.createDataFrame(rows, "symbol string, ts timestamp, seq long, session long, mid_c long")
    assert observe.append_new(batch.where("seq < 3"), str(tmp_path / "log")) == 3
    assert observe.append_new(batch.union(batch), str(tmp_path / "log")) == 1
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    known = spark.createDataFrame([("x", t + dt.timedelta(hours=2))], "symbol string, last timestamp")
    assert observe.in_order(batch.where("seq > 1"), known).count() == 2
    with pytest.raises(Exception, match="late tick"):
        observe.in_order(batch, known).collect()


def test_outcomes_of_attempts(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, t, 5, 4, 6), (2, None, 5, 4, 6), (3, t - dt.timedelta(seconds=90), 5, 4, 6), (4, t + dt.timedelta(seconds=9), 5, 4, 6), (5, t, 0, 4, 6), (6, t, 5, 6, 4), (7, t, 5, 5, 5)]
    d = spark.createDataFrame(rows, "k int, ts timestamp, mid_c long, bid_c long, ask_c long")
    got = [r[0] for r in d.orderBy("k").select(observe.outcome(t.replace(tzinfo=dt.timezone.utc).timestamp(), 60, True)).collect()]
    assert got == ["accepted", "no_stamp", "stale", "future", "bad_price", "crossed", "locked"]


def test_timeframes_and_trader_reports(spark, tmp_path):
    assert clock.periods_per_year("15m") == 24_192 and clock.periods_per_year("D1") == 252
    with pytest.raises(ValueError, match="unknown"):
        clock.periods_per_year("7x")
    (tmp_path / "r.csv").write_text("date,code,oi,spec_long,spec_short,comm_long,comm_short\n2024-01-02, 88 ,\"1,000\",300,100,200,500\n2024-01-02,88,1000,300,100,200,500\n2024-01-09,88,0,1,1,1,1\n2024-01-09,77,9,1,1,1,1\n")
    got = market.positions_report(spark, str(tmp_path / "r.csv"), "88").collect()
    assert [(str(r["ts"]), r["value"], r["comm_net"], r["spec_share"]) for r in got] == [("2024-01-05", 200.0, -300.0, 0.4)]


def test_look_ahead_is_found(spark):
    b = bars(spark, [1, 2, 4, 3, 5, 4, 6, 8, 7, 9])
    ahead = checks.truncation(b, lambda d: d.withColumn("p", F.lead("close").over(along())), "p", [4, 8]).collect()
    assert [(r["checked"], r["differing"]) for r in ahead] == [(4, 1), (8, 1)]


def test_normal_distribution_function(spark):
    from statistics import NormalDist

    x = [-38.0, -7.5, -7.0, -2.5, -0.1, 0.0, 0.3, 1.96, 6.9, 8.0]
    d = spark.createDataFrame([(v,) for v in x], "x double").select("x", F.expr(placebo.normal_cdf("x")).alias("p")).collect()
    assert [r["p"] for r in d] == pytest.approx([NormalDist().cdf(v) for v in x], rel=1e-9, abs=1e-15)


def test_stretches_of_average_cost(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(1, i, t + dt.timedelta(days=i), side, q, p) for i, (side, q, p) in enumerate([("buy", 2, 10), ("sell", 2, 30), ("sell", 1, 50), ("buy", 3, 40), ("sell", 2, 45)])]
    f = spark.createDataFrame(rows, "position_key long, seq long, ts timestamp, side string, qty long, price_c long")
    got = [(r["seq"], r["net_qty"], r["avg_price_c"], r["realized_c"]) for r in ledger.average_cost(f).orderBy("seq").collect()]
    assert got == [(0, 2, 10.0, 0.0), (1, 0, None, 40.0), (2, -1, 50.0, 0.0), (3, 2, 40.0, 10.0), (4, 0, None, 10.0)]


def test_readers_of_outside_formats(spark, tmp_path):
    (tmp_path / "panel" / "gold").mkdir(parents=True)
    (tmp_path / "panel" / "gold" / "goldm15.csv").write_text("Date,open,high,low,close,tick_volume\n2024-01-02 01:00:00,1,2,0.5,1.5,7\n2024-01-02 01:00:00,1,2,0.5,1.5,7\n2024-02-02 01:00:00,1,2,0.5,1.5,7\n")
    got = market.read_panel(spark, str(tmp_path / "panel"), 900, "2024-01-31").collect()
    assert [(r["symbol"], r["close"], r["volume"]) for r in got] == [("gold", 1.5, 7.0)]
    (tmp_path / "v.csv").write_text("Some index\nDATE,OPEN,CLOSE\n01/03/2024,1,13.5\n01/04/2024,1,14\n")
    (tmp_path / "w.csv").write_text("DATE,CLOSE\n2024-01-03,20\n2024-01-05,-1\n")
    v = market.read_level_history(spark, str(tmp_path / "v.csv"))
    assert sorted((str(r["ts"]), r["value"]) for r in v.collect()) == [("2024-01-03", 13.5), ("2024-01-04", 14.0)]
    with pytest.raises(Exception, match="bad level"):
        market.read_level_history(spark, str(tmp_path / "w.csv")).collect()
    both = market.paired(v, v.withColumn("value", F.col("value") + 1).where("value < 15"), ("near", "far")).collect()
    assert [(r["near"], r["far"]) for r in both] == [(13.5, 14.5)]
    (tmp_path / "u.csv").write_text("DATE,UNRATE\n1999-11-01,4.1\n1999-12-01,4.0\n2000-01-01,oops\n")
    u = market.read_monthly_levels(spark, str(tmp_path / "u.csv"), "UNRATE", "2000-01-01").collect()
    assert sorted((str(r["ts"]), r["value"]) for r in u) == [("1999-11-30", 4.1), ("1999-12-31", 4.0)]
    bars(spark, [1, 2]).select(F.col("ts").alias("stamp"), "open", "high", "low", "close", F.col("volume").alias("ticks")).write.parquet(str(tmp_path / "p"))
    assert market.read_bar_parquet(spark, str(tmp_path / "p"), "g", "stamp").count() == 2
