"""Affine scans, exact quantiles, anchor grids, round trips, attempts and forecasts on small frames and against plain loops."""

import datetime as dt
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import affine, prequential
from tidemark.functions.quantiles import exact_quantiles
from tidemark.operators import grid, ledger, lifecycle
from tidemark.streaming import observe


@pytest.mark.parametrize("chunk", [3, 4096])
def test_maps_are_composed_over_chunks_of_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(affine, "CHUNK", chunk)
    rng = random.Random(1)
    rows = [(k, i, rng.choice([0.0, 1.0, rng.random()]), rng.uniform(-5, 5)) for k, n in (("a", 40), ("b", 1), ("c", 9), ("d", 27)) for i in range(n)]
    got = {(r["k"], r["row"]): (r["a"], r["b"]) for r in affine.prefix_maps(spark.createDataFrame(rows, "k string, row long, a double, b double").repartition(3), ["k"]).collect()}
    assert len(got) == len(rows)
    for k, i, a, b in rows:
        low, high = (0.0, 1.0) if i == 0 else (low, high)  # noqa: F821
        low, high = a * low + b, a * high + b
        assert got[k, i] == pytest.approx((high - low, low))


def test_a_position_that_is_never_flat_is_many_chunks(spark):
    n = 200_000
    f = spark.range(n).select(F.lit(1).cast("long").alias("position_key"), "id", F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"))
    f = f.select("position_key", F.col("id").alias("seq"), "ts", F.when(F.col("id") % 3 == 2, "sell").otherwise("buy").alias("side"), (1 + F.pmod(F.xxhash64("id"), F.lit(9))).alias("qty"), (1000 + F.pmod(F.xxhash64("id", "id"), F.lit(500))).alias("price_c"))
    rows = f.orderBy("seq").collect()
    got = {r["seq"]: r for r in ledger.average_cost(f).where("seq % 9973 = 0 OR seq = 199999").collect()}
    net, avg = 0, 0.0
    for r in rows:
        signed, realized = (r["qty"] if r["side"] == "buy" else -r["qty"]), 0.0
        if net * signed >= 0:
            avg = (abs(net) * avg + r["qty"] * r["price_c"]) / (abs(net) + r["qty"])
        else:
            realized = min(abs(net), r["qty"]) * (r["price_c"] - avg) * (1 if net > 0 else -1)
            avg = r["price_c"] if r["qty"] > abs(net) else avg
        net += signed
        if r["seq"] in got:
            g = got[r["seq"]]
            assert g["net_qty"] == net and g["realized_c"] == pytest.approx(realized, abs=1e-6) and (net == 0 or g["avg_price_c"] == pytest.approx(avg))
    assert len(got) > 20


def test_exact_quantiles(spark):
    rng = random.Random(2)
    groups = {"a": [rng.gauss(0, 1) for _ in range(3000)], "b": [5.0] * 2000 + [1e300, -1e300], "c": [7.0], "d": [float(rng.randint(0, 3)) for _ in range(999)], "e": [10.0**-k for k in range(300)]}
    rows = [(k, x) for k, v in groups.items() for x in v] + [("a", None), ("none", None)]
    got = {r["k"]: r for r in exact_quantiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", {"low": 0.05, "mid": 0.5, "high": 0.99}).collect()}
    assert got.keys() == groups.keys()
    for k, v in groups.items():
        assert [got[k][n] for n in ("low", "mid", "high")] == pytest.approx(np.quantile(v, [0.05, 0.5, 0.99]).tolist(), rel=1e-9)


def test_median_of_hit_times(spark):
    # 2 hits after one row, 1 after three: the middle one; with a fourth after five, between one and three
    for hits, want in (([1, 1, 3], 1.0), ([1, 1, 3, 5], 2.0), ([4], 4.0)):
        assert exact_quantiles(spark.createDataFrame([("x", h) for h in hits], "k string, h int"), ["k"], "h", {"m": 0.5}).first()["m"] == want


def test_anchors_do_not_overlap_and_know_gaps(spark):
    t0 = dt.datetime(2024, 1, 1)
    rng = random.Random(4)
    mids = [1000 + rng.randint(-9, 9) for _ in range(120)]
    stamps = [t0 + dt.timedelta(seconds=10 * i + (7200 if i >= 60 else 0)) for i in range(120)]
    ticks = spark.createDataFrame([("x", s, i, m - 1 - i % 2, m + 1) for i, (s, m) in enumerate(zip(stamps, mids, strict=True))], "symbol string, ts timestamp_ntz, seq long, bid_c long, ask_c long")
    got = {(r["horizon"], r["row"]): r for r in grid.anchors(ticks, (3, 7), 2, entry=1, trail=4, block=2).collect()}
    mid2, spread = [2 * m - i % 2 for i, m in enumerate(mids)], [2 + i % 2 for i in range(120)]
    want = {(h, i) for h in (3, 7) for i in range(h + 2 + 4, 120 - h - 1) if i % (h + 2) == 0}
    assert got.keys() == want
    for (h, i), r in got.items():
        assert r["move_c"] == (mid2[i + 1 + h] - mid2[i + 1]) / 2 and r["cost_c"] == (spread[i + 1] + spread[i + 1 + h]) / 2 and r["trail_c"] == (mid2[i] - mid2[i - 4]) / 2
        assert r["gap_clear"] == (not i < 60 <= i + 1 + h) and r["block"] == i // (h + 2) // 2
        span = (stamps[-1] - stamps[0]).total_seconds() * 1e6 + 1
        assert r["part"] == int((stamps[i] - t0).total_seconds() * 1e6 * 3 // span)
    e = grid.opposed(grid.anchors(ticks, (3,), 2, entry=1, block=2), F.col("ask_move") > 0, F.col("ask_move") < 0)
    whole = grid.family(grid.family_sums(e, ("symbol", "horizon"))).first()
    parts = grid.family_sums(e, ("symbol", "horizon", "part", "block"))
    assert whole["n_a"] == parts.agg(F.sum("n_a")).first()[0] and whole["lift"] == pytest.approx(whole["match_a"] + whole["match_b"] - 1)
    drawn = grid.stratified_draws(parts, 20).collect()
    assert len(drawn) == 20 and len({(r["n_a"], r["right_a"]) for r in drawn}) > 1


def test_round_trips(spark):
    d = {
        "complete": [(True, "buy", 2, 100), (False, "sell", 2, 110)], "complete_in_parts": [(True, "sell", 3, 100), (False, "buy", 1, 90), (False, "buy", 2, 80)],
        "entry_after_exit": [(True, "buy", 2, 100), (False, "sell", 1, 1), (True, "buy", 1, 1)], "entry_sides_differ": [(True, "buy", 1, 1), (True, "sell", 1, 1), (False, "sell", 1, 1)],
        "wrong_exit": [(False, "sell", 1, 1), (True, "buy", 1, 1)], "exit_too_large": [(True, "buy", 1, 1), (False, "sell", 2, 1)], "not_closed": [(True, "buy", 2, 1), (False, "sell", 1, 1)],
    }
    t0 = dt.datetime(2024, 1, 1)
    rows = [(k, t0 + dt.timedelta(days=i), i, e, s, q, p, 10, -1) for k, v in d.items() for i, (e, s, q, p) in enumerate(v)]
    deals = spark.createDataFrame(rows, "position_key string, ts timestamp_ntz, seq int, is_entry boolean, side string, qty int, price int, gross int, charge int").repartition(3)
    trips = lifecycle.round_trips(deals)
    got = {r["position_key"]: r for r in trips.collect()}
    assert {k: r["status"] for k, r in got.items()} == {k: k for k in d}
    assert got["complete_in_parts"]["exit_price"] == pytest.approx(250 / 3) and got["complete"]["net"] == 18
    late = lifecycle.with_late_charges(trips, spark.createDataFrame([("complete", -5), ("complete", -1), ("unknown", -9)], "position_key string, charge int"))
    after = {r["position_key"]: r for r in late.collect()}
    assert after["complete"]["net"] == 12 and after["complete"]["revised"] and not after["not_closed"]["revised"] and len(after) == len(d)
    sides = {r["side"]: r for r in lifecycle.charge_per_lot_side(deals).collect()}
    assert sides["buy"]["per_lot"] == pytest.approx(sides["buy"]["charge"] / sides["buy"]["qty"])


def ticks_in(spark, folder, name, rows):
    spark.createDataFrame(rows, "session long, seq long, ts timestamp, mid_c long").coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


def test_attempts_agree_with_rows(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, m)
    schema = "session long, seq long, ts timestamp, mid_c long"
    stream = lambda: spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    record = lambda border=None, name="a": observe.record_attempts(stream(), str(tmp_path), name, ["session", "ts"], F.col("mid_c") > 0, border)
    ticks_in(spark, tmp_path, "in", [(1, 1, at(1), 5), (1, 2, at(1), 6), (1, 3, at(2), 0), (2, 4, at(1), 5), (2, 5, None, 5)])
    record()
    ticks_in(spark, tmp_path, "in", [(1, 6, at(1), 7), (1, 7, at(3), 7)])
    attempts, rows = record()
    assert {r["seq"]: r["outcome"] for r in attempts.collect()} == {1: "STORED", 2: "DUPLICATE", 3: "VALIDATION_REJECTED", 4: "STORED", 5: "UNRESOLVED", 6: "DUPLICATE", 7: "STORED"}
    r = {x["session"]: x for x in observe.reconcile_attempts(attempts, rows).collect()}
    assert r[1]["attempts"] == 5 and r[1]["stored"] == r[1]["store_rows"] == 2 and all(x["balanced"] and x["agree"] for x in r.values())
    lost = {x["session"]: x for x in observe.reconcile_attempts(attempts, rows.where("seq != 7").union(rows.where("seq = 4").withColumn("record_id", F.lit("stray")))).collect()}
    assert lost[1]["missing"] == 1 and not lost[1]["agree"] and lost[2]["orphans"] == 1
    with pytest.raises(Exception, match="locked"):
        record("2024-01-01 00:03:00", "b")
    assert not (tmp_path / "b" / "rows").exists()


def test_streamed_means_go_on_from_batch_to_batch(spark, tmp_path):
    schema = "symbol string, ts timestamp, seq long, mid_c long"
    name = uuid.uuid4().hex
    want, ema = {}, {}
    for part in ([("a", 0, 10), ("b", 1, 5), ("a", 2, 20)], [("a", 3, 40), ("c", 4, 8)], [("b", 5, 7), ("a", 6, 0)]):
        spark.createDataFrame([(s, dt.datetime(2024, 1, 1, 0, i), i, m) for s, i, m in part], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        got = observe.run_exponential(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), str(tmp_path), name, 0.25)
        for s, i, m in part:
            ema[s] = want[i] = m if s not in ema else 0.25 * m + 0.75 * ema[s]
    assert {r["seq"]: r["ema"] for r in got.collect()} == pytest.approx(want)


def month_rows(n, change=None):
    rng = np.random.default_rng(7)
    day, close, out = dt.datetime(2010, 1, 1), 1300.0, []
    for i in range(n):
        close *= float(np.exp(rng.normal(0.0002, 0.01)))
        now = close * (1.8 if change is not None and i > change else 1.0)
        out.append(("x", day + dt.timedelta(days=i), now, float(0.1 + 0.05 * np.sin(i / 40)) * (3.0 if change is not None and i > change else 1.0)))
    return out


def test_forecasts_use_earlier_months_only(spark):
    schema = "symbol string, ts timestamp_ntz, close double, value double"

    def forecasts(rows):
        d = spark.createDataFrame(rows, schema)
        monthly = prequential.monthly_features(d.select("symbol", "ts", "close"), d.select("symbol", "ts", "value"))
        return monthly, {r["ts"]: r for r in prequential.prequential_ridge(monthly, lookback=36, least=24).collect()}

    rows = month_rows(1500)
    monthly, base = forecasts(rows)
    usable = [r for r in base.values() if r["usable"]]
    assert len(usable) > 10 and all(r["training_rows"] >= 24 and r["training_last"] < r["ts"] for r in usable)
    cut = rows[1200][1]
    _, changed = forecasts(month_rows(1500, 1200))
    assert {t: (r["forecast"], r["long"]) for t, r in base.items() if t <= cut} == {t: (r["forecast"], r["long"]) for t, r in changed.items() if t <= cut}
    m = monthly.orderBy("ts").toPandas()
    x, close = m[list(prequential.FEATURES)].to_numpy(float), m["close"].to_numpy(float)
    y = np.append(close[1:] / close[:-1] - 1, np.nan)
    for i, ts in enumerate(m["ts"]):
        use = [j for j in range(max(0, i - 36), i) if np.isfinite(x[j]).all() and np.isfinite(y[j])]
        r = base[ts.to_pydatetime()]
        assert r["training_rows"] == len(use)
        if r["usable"]:
            past, target = x[use], y[use]
            z = np.clip((past - past.mean(0)) / past.std(0, ddof=1), -5, 5)
            at = np.clip((x[i] - past.mean(0)) / past.std(0, ddof=1), -5, 5)
            beta = np.linalg.inv(z.T @ z + 20 * np.eye(5)) @ z.T @ (target - target.mean())
            assert r["forecast"] == pytest.approx(target.mean() + at @ beta) and r["long"] == int(r["forecast"] > 0.003)
    with pytest.raises(ValueError):
        prequential.prequential_ridge(monthly, lookback=20, least=24)
