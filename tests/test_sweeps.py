"""Session breakouts, unbroken runs, centred events, sweeps of lags and canonical text, against plain loops."""

import datetime as dt
import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import canonical, clock, inference, timing
from tidemark.operators import assays, centred, impulse, sessions

T0 = dt.datetime(2024, 1, 1)
BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double"


def walk(n, minutes, seed, drop=()):
    rng, close, out = random.Random(seed), 100.0, []
    for i in range(n):
        start, close = close, close + rng.uniform(-1, 1)
        if i not in drop:
            out.append(("x", T0 + dt.timedelta(minutes=minutes * i), start, max(start, close) + rng.random() / 4, min(start, close) - rng.random() / 4, close))
    return out


def test_session_breakouts(spark):
    rows = walk(96 * 12, 15, 3, drop=set(range(96 * 4, 96 * 4 + 22)))  # the fifth night has 6 bars
    got = {r["ts"]: r for r in sessions.session_breakout(spark.createDataFrame(rows, BARS), 0.5).collect()}
    mean, state, day, sides = None, 0, None, set()
    for i, (_, ts, _, high, low, close) in enumerate(rows):
        tr = high - low if i == 0 else max(high - low, abs(high - rows[i - 1][5]), abs(low - rows[i - 1][5]))
        mean = tr if i == 0 else mean + (tr - mean) / 14
        if ts.date() != day:
            day, night = ts.date(), [r for r in rows if r[1].date() == ts.date() and r[1].hour < 7]
            top, bottom = max(r[3] for r in night), min(r[4] for r in night)
        r, stop = got[ts], None
        if ts.hour < 7 or ts.hour >= 19:
            state = 0
        elif i >= 13 and state == 0 and len(night) >= 8 and ts.hour < 16:
            state = 1 if close > top + mean / 2 else -1 if close < bottom - mean / 2 else 0
            stop = None if state == 0 else close - bottom if state > 0 else top - close
        sides.add(state)
        assert r["position"] == (state if i >= 13 else None) and r["stop_distance"] == (None if stop is None else pytest.approx(stop))
        assert r["size"] == (None if stop is None else pytest.approx(min(1.0, 0.01 / (stop / close))))
    assert sides == {-1, 0, 1} and all(got[r[1]]["position"] == 0 for r in rows if r[1].date() == dt.date(2024, 1, 5))


def test_rules_wait_for_unbroken_runs(spark):
    rows = walk(200, 60, 5, drop={60, 61, 100, 120})
    got = {r["ts"]: r for r in sessions.run_rules(spark.createDataFrame(rows, BARS), 3600).collect()}
    run, sign, seen = 0, lambda x: (x > 0) - (x < 0), set()
    for i, (_, ts, _, _, _, close) in enumerate(rows):
        run = run + 1 if i and ts - rows[i - 1][1] == dt.timedelta(hours=1) else 1
        past = lambda k: rows[i - k][5]  # noqa: B023, E731
        r = got[ts]
        assert r["run"] == run and r["trend"] == (sign(close - past(12)) if run >= 13 else 0) and r["reversal"] == (-sign(close - past(4)) if run >= 5 else 0)
        assert r["session"] == (sign(close - past(4)) if run >= 5 and 7 <= ts.hour < 18 else 0)
        before = rows[max(0, i - 32) : i]
        assert r["breakout"] == (0 if run < 33 else 1 if close > max(b[3] for b in before) else -1 if close < min(b[4] for b in before) else 0)
        seen.add(r["breakout"])
    assert len(seen) > 1


@pytest.mark.parametrize("stretch", [4, 50_000])
def test_centred_events_count_once_however_rows_are_cut(spark, monkeypatch, stretch):
    whole = assays.with_ahead
    monkeypatch.setattr(centred, "with_ahead", lambda rows, ahead, behind: whole(rows, ahead, behind, stretch))
    rng = random.Random(7)
    quotes = [(m := rng.randint(90, 110), w := rng.choice([-1, 1, 2, 6])) and (m - w, m + w) for _ in range(90)]
    quotes[20] = (0, 100)
    stamps = [T0 + dt.timedelta(seconds=s) for s in np.cumsum([rng.choice([0.4, 1.0, 5.0]) for _ in quotes]).tolist()]
    ticks = spark.createDataFrame([("x", t, i, b, a) for i, (t, (b, a)) in enumerate(zip(stamps, quotes, strict=True))], "symbol string, ts timestamp_ntz, seq long, bid_c long, ask_c long")
    us = [round((t - T0).total_seconds() * 1e6) for t in stamps]
    border = us[0] + (us[-1] - us[0]) * 60 // 100
    want = {}
    for i in range(1, len(quotes) - 1):
        (b0, a0), (b, a), (b1, a1) = quotes[i - 1 : i + 2]
        move, on = (a + b - a0 - b0) / 2, (a1 + b1 - a - b) / 2
        if min(b0, a0, b, a, b1, a1) > 0 and abs(move) > a0 - b0 and move:
            side, known = int(np.sign(move)), us[i + 1] < border
            late = None
            if i + 2 < len(quotes) and min(quotes[i + 2]) > 0 and us[i + 2] < border:
                late = (-side * ((sum(quotes[i + 2]) - a - b) / 2) - (a - b)) / ((a + b) / 2) * 1e4
            want[i] = (side, -side * on - (a - b), late, int(-side * np.sign(on)), us[i + 1] - us[i] <= 1e6, min(a0 - b0, a - b, a1 - b1) < 0, i % 3 == 0, known)
    events = centred.centres(ticks)
    rows = events.collect()
    got = {r["row"]: r for r in rows}
    assert len(rows) == len(got) and got.keys() == want.keys() and any(v[5] for v in want.values())
    for i, (side, net, late, turned, near, inverted, apart, known) in want.items():
        r = got[i]
        assert (r["side"], r["net_c"], r["turned"], r["near"], r["inverted"], r["apart"], r["known"]) == (side, net, turned, near, inverted, apart, known), i
        assert r["late_bps"] == (None if late is None else pytest.approx(late))
    s = centred.centre_sums(events).first()
    inside = [v for v in want.values() if v[7]]
    apart = [v for v in inside if v[6]]
    assert s["events"] == len(inside) and s["beyond"] == len(want) - len(inside) > 0 and s["turns"] + s["goes_on"] + s["stays"] == s["events"] and s["apart_events"] == len(apart)
    assert s["mean_net_c"] == pytest.approx(np.mean([v[1] for v in inside]))
    k, o = sum(v[3] == 1 for v in apart), sum(v[3] == -1 for v in apart)
    assert s["z"] == pytest.approx((k - o) / (k + o) ** 0.5)


def test_alpha_that_needs_the_same_bar_collapses_with_lag(spark):
    rng = np.random.default_rng(1)
    r = rng.normal(0, 0.01, 400)
    close = 100 * np.cumprod(1 + r)
    side = [int(np.sign(r[i + 1])) if i + 1 < len(r) else 0 for i in range(len(r))]  # knows the next bar
    bars = spark.createDataFrame([("x", T0 + dt.timedelta(days=i), float(p), s) for i, (p, s) in enumerate(zip(close, side, strict=True))], "symbol string, ts timestamp_ntz, close double, side int")
    table = timing.lag_sweep(bars, "side", cost_bps=1.0)
    got = {x["lag"]: x for x in table.collect()}
    for k in range(4):
        held = np.concatenate([np.zeros(k + 1), side])[: len(r)].astype(float)
        net = held * r - np.abs(np.diff(np.concatenate([[0], held]))) / 1e4
        y, x = net[1:], close[1:] / close[:-1] - 1
        design = np.column_stack([np.ones_like(x), x])
        b, rss = np.linalg.lstsq(design, y, rcond=None)[:2]
        error = np.sqrt(rss[0] / (len(x) - 2) * np.linalg.inv(design.T @ design)[0, 0])
        assert got[k]["alpha_ann"] == pytest.approx(b[0] * 252) and got[k]["alpha_t"] == pytest.approx(b[0] / error) and got[k]["n"] == 399
    assert got[0]["alpha_t"] > 10 > 3 > abs(got[1]["alpha_t"])
    v = timing.survives(table, 1, 2.0).first()
    assert not v["survives"] and v["decay"] == pytest.approx(got[0]["alpha_t"] - got[1]["alpha_t"]) and timing.survives(table, 0, 2.0).first()["survives"]
    with pytest.raises(Exception, match="is missing"):
        timing.survives(table, 9, 2.0).collect()
    with pytest.raises(ValueError):
        timing.lag_sweep(bars, "side", (-1, 0))
    flat = timing.lag_sweep(bars.withColumn("side", F.lit(0)), "side").first()
    assert flat["alpha_t"] is None and flat["alpha_ann"] == 0
    assert timing.required_lag(10.5, 22.0) == 1 and timing.required_lag(24.0, 22.0) == 0 and timing.required_lag(24.0, 21.0, 24.0) == 1 and timing.required_lag(10.5) == 0


def test_alignment(spark):
    day = lambda i: T0 + dt.timedelta(days=i)
    schema = "ts timestamp_ntz, level double, flat double, unknown double"
    drivers = spark.createDataFrame([(day(i), float(i), 1.0, None) for i in range(5)], schema)
    prices = spark.createDataFrame([(day(i),) for i in range(3, 9)], "ts timestamp_ntz")
    one = lambda p, x: tuple(timing.alignment(drivers, p, "ts", x).first())
    assert one(prices, ["level"]) == (5, 6, 2, "", True) and one(prices, ["level", "flat", "unknown"]) == (5, 6, 2, "flat,unknown", False)
    assert one(prices.where(F.col("ts") > F.lit(day(6))), ["level"]) == (5, 2, 0, "", False)
    with pytest.raises(Exception, match="no driver rows"):
        timing.alignment(drivers.limit(0), prices, "ts", ["level"]).collect()


def test_canonical_text_is_that_of_sorted_json(spark):
    schema = "id int, v struct<z: string, a: struct<n: bigint, b: boolean>, m: map<string, array<bigint>>, l: array<struct<y: int, x: string>>>"
    values = [
        {"z": 'q"\\\n\té', "a": {"n": 5, "b": True}, "m": {"b": [1, None], "a": [], 'k"': [2]}, "l": [{"y": 1, "x": "s"}, {"y": None, "x": ""}]},
        {"z": None, "a": None, "m": None, "l": None}, {"z": "", "a": {"n": None, "b": None}, "m": {}, "l": []},
    ]
    df = spark.createDataFrame(list(enumerate(values)) + [(3, None)], schema)
    of = df.schema["v"].dataType
    got = {r["id"]: r for r in df.select("id", canonical.canonical_json("v", of).alias("t"), canonical.digest("v", of).alias("d"), canonical.canonical_json("v", of, ", ", ": ").alias("wide")).collect()}
    for i, v in [*enumerate(values), (3, None)]:
        want = json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert got[i]["t"] == want and got[i]["d"] == hashlib.sha256(want.encode()).hexdigest() and got[i]["wide"] == json.dumps(v, sort_keys=True, ensure_ascii=False)
    maps = spark.createDataFrame([({"a": 1, "b": 2}, {"c": 4, "b": 3}), ({"b": 2, "a": 1}, None), (None, {"a": 1}), (None, None), ({"a": 1}, {"a": None})], "a map<string,int>, b map<string,int>")
    rows = maps.select(canonical.merged("a", "b").alias("m"), canonical.looked_up("a", "b", F.lit(-1)).alias("x")).collect()
    assert [r["m"] for r in rows] == [{"a": 1, "b": 3, "c": 4}, {"a": 1, "b": 2}, {"a": 1}, None, {"a": 1}] and [r["x"] for r in rows] == [2, 2, -1, -1, -1]


def test_variations_of_one_idea_are_one_cluster(spark):
    schema = "family string, mechanism string, features array<string>, params map<string,double>"
    rows = [("trend", "m", ["a", "b"], {"n": 1.0, "k": 2.0}), ("trend", "m", ["b", "a"], {"k": 9.0, "n": 7.0}), ("trend", "m", ["a"], {"n": 1.0}), (None, None, None, None)]
    trials = spark.createDataFrame(rows, schema)
    key = lambda *x: hashlib.sha256(json.dumps(dict(zip(("family", "mechanism", "features", "param_keys"), x, strict=True)), sort_keys=True).encode()).hexdigest()[:12]
    got = {r["fingerprint"]: r["trials"] for r in canonical.clusters(trials).collect()}
    assert got == {key("trend", "m", ["a", "b"], ["k", "n"]): 2, key("trend", "m", ["a"], ["n"]): 1, key("", "", [], []): 1}
    assert tuple(canonical.novelty(trials).first()) == (4, 3, 2) and tuple(canonical.novelty(trials.limit(0)).first()) == (0, 0, 0)


def test_impulse_study_against_plain_loops(spark):
    rows = walk(260, 60, 11)
    bars = spark.createDataFrame(rows, BARS)
    paths = impulse.measured(bars, (3, 6), latency=2, suppress=4, k=1.2)
    got = {(r["family"], r["horizon"], r["row"], r["event"]): (r["split"], r["side"], r["return_bps"]) for r in paths.collect()}
    close, n, want = [r[5] for r in rows], len(rows), {}
    row_of = {r[1]: i for i, r in enumerate(rows)}
    for family in assays.detectors():
        events = {row_of[r["ts"]]: r["direction"] for r in assays.impulse_events(bars, family, 4, k=1.2).collect()}
        for h in (3, 6):
            for i in range(n):
                split = "discovery" if i < int(n * 0.6) else "validation" if i < int(n * 0.8) else None
                event, last = i in events, max((e for e in events if e <= i), default=None)
                whole = i + 2 + h < n
                if split and (event or (26 <= i < n - 2 - h and (last is None or i - last > 2 + h))):
                    side = events.get(i) or (1 if int(hashlib.md5(f"0:x:{i}".encode()).hexdigest()[0], 16) % 2 == 0 else -1)
                    want[family, h, i, event] = (split, side, side * (close[i + 2 + h] / close[i + 2] - 1) * 1e4 if whole else None)
    assert got.keys() == want.keys() and {k[3] for k in got} == {True, False}
    for k, (split, side, value) in want.items():
        assert got[k][:2] == (split, side) and got[k][2] == (None if value is None else pytest.approx(value))
    result = impulse.study(paths, 2.0)
    table = {(r["family"], r["horizon"], r["split"]): r for r in result.collect()}
    for (family, h, split), r in table.items():
        mine = [v for (f, x, _, e), v in want.items() if f == family and x == h and e and split in (v[0], "pooled")]
        base = [v for (f, x, _, e), v in want.items() if f == family and x == h and not e and split in (v[0], "pooled")]
        k, b = sum(v[2] > 0 for v in mine), sum(v[2] > 0 for v in base)
        assert (r["detected"], r["continued"], r["baseline"], r["baseline_continued"]) == (len(mine), k, len(base), b)
        q = b / len(base) if base else 0.5
        assert r["p"] == pytest.approx(inference.binomial_two_sided(k, len(mine), min(max(q, 1e-9), 1 - 1e-9)) if mine else 1.0)
        if mine and base:
            half = 1.959964 * (k / len(mine) * (1 - k / len(mine)) / len(mine) + q * (1 - q) / len(base)) ** 0.5
            assert (r["diff_low"], r["diff_high"]) == pytest.approx((k / len(mine) - q - half, k / len(mine) - q + half), abs=1e-6)
        if mine:
            assert r["net_bps"] == pytest.approx(np.mean([v[2] for v in mine]) - 2)
        group = sorted(x["p"] for y, x in table.items() if y[1:] == (h, split))
        assert r["p_holm"] == pytest.approx(min(1, max((len(group) - i) * p for i, p in enumerate(group) if p <= r["p"])))
    costs = {(r["family"], r["horizon"], r["times"]): r["net_bps"] for r in impulse.cost_sweep(result, 2.0).collect()}
    assert all(costs[f, h, 3.0] == pytest.approx(r["gross_bps"] - 6) for (f, h, s), r in table.items() if s == "pooled" and r["gross_bps"] is not None)


@pytest.mark.parametrize("zone, stamp, hours", [
    ("America/New_York", "2024-03-10 09:59", 2), ("America/New_York", "2024-03-10 10:00", 3), ("America/New_York", "2024-11-03 08:59", 3), ("America/New_York", "2024-11-03 09:00", 2),
    ("Europe/Athens", "2024-03-31 03:59", 2), ("Europe/Athens", "2024-03-31 04:00", 3), ("Europe/Athens", "2024-10-27 03:59", 3), ("Europe/Athens", "2024-10-27 04:00", 2),
])
def test_server_stamps_at_changes_of_the_clock(spark, zone, stamp, hours):
    at = dt.datetime.fromisoformat(stamp)
    d = spark.createDataFrame([(at,), (None,)], "stamp timestamp_ntz").select(clock.server_to_utc(F.col("stamp"), zone).alias("utc"))
    assert [r["utc"] for r in d.collect()] == [at - dt.timedelta(hours=hours), None]
