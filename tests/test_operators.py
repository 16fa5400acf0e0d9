import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import candles as C
from tidemark.operators import features, flow, payloads, prompts, quantiles, scoring
from tidemark.operators.asof import asof_join, window_join


def test_asof_against_brute_force_and_chunks(spark):
    rnd = random.Random(4)
    left = [(k, rnd.randrange(0, 5000), i) for i in range(60) for k in "ab"] + [(None, 5, 900), ("a", None, 901)]
    right = [(k, rnd.randrange(0, 5000), i) for i in range(80) for k in "ab"]
    l, r = spark.createDataFrame(left, "k string, t long, id long"), spark.createDataFrame(right, "k string, ts long, seq long")
    want = {}
    for k, t, i in left:
        fit = [x for x in right if x[0] == k and t is not None and x[1] <= t and t - x[1] <= 700]
        want[i, k] = max(fit, key=lambda x: (x[1], x[2]))[2] if fit else None
    for chunk in (37, 1000, 10**6):
        got = asof_join(l, r, keys=["k"], left_ts="t", right_ts="ts", seq="seq", chunk_ms=chunk, max_age_ms=700)
        assert {(x["id"], x["k"]): x["last"]["seq"] if x["last"] else None for x in got.collect()} == want


def test_label_edges(spark):
    p = spark.createDataFrame([("x", 1000)], "asset string, current_time_ms long")
    q = spark.createDataFrame([("x", i, t, 100.0, 1.0, 102.0, 3.0) for i, t in enumerate((1000, 1500, 2000, 2001))], "asset string, seq long, recv_ts_ms long, bid_price double, bid_qty double, ask_price double, ask_qty double")
    row = scoring.label_quotes(p, q, keys=["asset"], horizon_ms=1000, chunk_ms=300).withColumn("y", scoring.realized("label", "target_ms", live_ms=1000)).first()
    assert row["label"]["recv_ts_ms"] == 2000 and row["y"] == 100.5
    early = scoring.label_quotes(p, q.filter("recv_ts_ms <= 1000"), keys=["asset"], horizon_ms=1000, chunk_ms=300).first()
    assert early["label"] is None


def test_window_join_edges(spark):
    p = spark.createDataFrame([("x", 100), ("y", 100)], "asset string, now long")
    s = spark.createDataFrame([("x", t) for t in (40, 41, 100, 101)], "asset string, ts long")
    got = window_join(p, s, keys=["asset"], at="now", ts="ts", window_ms=60, outer=True).collect()
    assert sorted((r["asset"], r["ts"]) for r in got if r["ts"]) == [("x", 41), ("x", 100)] and any(r["asset"] == "y" and r["ts"] is None for r in got)


def test_gap_fill_and_moves_do_not_depend_on_chunks(spark):
    rows = [("a", t * 1000, float(t)) for t in (0, 3, 4, 9, 20)]
    c = spark.createDataFrame(rows, "k string, open_time_ms long, close double").selectExpr("*", "close open", "close high", "close low", "1D volume")
    want = None
    for bars in (2, 7, 100):
        full = C.gap_filled(c, keys=["k"], bar_ms=1000, bars_a_chunk=bars)
        got = sorted((r["open_time_ms"], r["close"], r["volume"], r["d_2"]) for r in C.moves(full, keys=["k"], steps={"2": 2}, bar_ms=1000, chunk_bars=bars).collect())
        want = want or got
        assert got == want
    assert len(want) == 21 and want[2] == (2000, 0.0, 0.0, 0.0) and want[4][3] == 4.0


def test_price_moves_against_a_plain_fold_for_any_chunk(spark):
    """Walks of two keys over ten days with quiet days, gaps and repeats; the reference outlives chunks."""
    rnd, rows, want = random.Random(11), [], []
    for key in "xy":
        price, reference = 50.0, None
        for i in range(600):
            t = i * 1_440_000 + (i // 200) * 90_000_000
            price += rnd.choice([0, 0, 0.1, -0.1, 0.2, -0.3]) * (rnd.random() < (0.03 if 200 <= i < 400 else 0.6))
            rows.append((key, i, t, round(price, 1), t + 7))
            if reference is not None and abs(round(price, 1) - reference) / 0.2 > 1 + 1e-6:
                want.append((key, t, round(price, 1), reference))
            if reference is None or (want and want[-1][:2] == (key, t)):
                reference = round(price, 1)
    g = spark.createDataFrame(rows, "asset string, seq long, ts_ms long, price double, recv_ts_ms long")
    for chunk in (7_200_000, 86_400_000, 10**12):
        got = prompts.price_moves(g, keys=["asset"], tick=0.2, chunk_ms=chunk).collect()
        assert sorted((r["asset"], r["ts_ms"], r["price"], r["reference"]) for r in got) == sorted(want)


def test_groups_take_the_last_price_and_leave_the_open_one(spark):
    rows = [(700, 20.0, 3), (700, 20.4, 4), (710, 20.1, 5), (725, 21.0, 9)]
    t = spark.createDataFrame([("x", i, *r) for i, r in enumerate(rows)], "asset string, seq long, ts_ms long, price double, recv_ts_ms long")
    assert sorted((r["ts_ms"], r["price"], r["recv_ts_ms"], r["n"]) for r in prompts.trade_groups(t, keys=["asset"]).collect()) == [(700, 20.4, 4, 2), (710, 20.1, 5, 1)]


def test_numbers_and_gaps_do_not_depend_on_chunks(spark):
    rows = [(k, t) for k in "ab" for t in (0, 3, 4, 50, 51, 120, 400)]
    d = spark.createDataFrame(rows, "k string, t long")
    for chunk in (1, 10, 10**6):
        got = prompts.numbered(d, by=["k"], ts="t", name="n", chunk_ms=chunk).collect()
        assert sorted((r["k"], r["n"], r["t"]) for r in got) == sorted((k, i + 1, t) for k in "ab" for i, t in enumerate((0, 3, 4, 50, 51, 120, 400)))
        gaps = prompts.coverage_windows(d, keys=["k"], ts="t", start=0, end=401, step=1, interior=True, wanted=spark.createDataFrame([("a",), ("c",)], "k string"), chunk_ms=chunk).collect()
        assert {(r["from_ms"], r["to_ms"]) for r in gaps if r["k"] == "a"} == {(1, 3), (5, 50), (52, 120), (121, 400)} and [(r["from_ms"], r["to_ms"]) for r in gaps if r["k"] == "c"] == [(0, 401)]
        back = prompts.time_order_violations(spark.createDataFrame([(i, t) for i, t in enumerate((5, 7, 6, 9, 1))], "seq long, ts long"), keys=[], order="seq", ts="ts", chunk=chunk)
        assert sorted((r["ts"], r["before_ms"]) for r in back.collect()) == [(1, 9), (6, 7)]
    assert prompts.clock_interval_ms(200) == 200_000
    for bad in (0, -20, 30):
        with pytest.raises(ValueError):
            prompts.clock_interval_ms(bad)


def test_newest_rows_and_mid_changes_do_not_depend_on_chunks(spark):
    rnd = random.Random(7)
    rows = [("a", i * 10, round(rnd.choice([1.0, 1.0, 1.0, 1.2]), 1)) for i in range(300)]
    d = spark.createDataFrame(rows, "k string, t long, v double")
    seen = set()
    for chunk in (50, 700, 10**6):
        aged = C.aged(d, keys=["k"], ts="t", newest=37, chunk_ms=chunk).collect()
        assert sorted((r["age"], r["t"]) for r in aged) == [(i, 2990 - 10 * i) for i in range(37)]
        c = flow.mid_change_counts(d, keys=["k"], value="v", ts="t", step_ms=10, steps=20, span=5, recent=3, chunk_ms=chunk).collect()
        seen.add(tuple(sorted((r["t"], r["changes"], r["recent"], r["still"], r["still_share"], r["since"]) for r in c)).__repr__())
    assert len(seen) == 1


def test_field_scores(spark):
    rows = [("x", 1, f"m{i}", float(i), True) for i in (1, 2, 3, 4)] + [("x", 1, "m5", None, False), ("x", 2, "m1", None, False)]
    s = spark.createDataFrame(rows, "asset string, current_time_ms long, model string, crps double, answered boolean")
    got = {r["model"]: r["field_score"] for r in scoring.field_scores(s).collect()}
    assert got["m1"] == 0 and got["m5"] == pytest.approx(2.85) and len(got) == 5


def test_depth_pair(spark):
    rows = [("x", 120_000, i, t, i) for i, t in enumerate((0, 59_000, 60_000, 61_000, 121_000)) if t <= 120_000]
    j = spark.createDataFrame(rows, "asset string, now long, seq long, recv_ts_ms long, update_id long")
    row = flow.depth_pairs(j, keys=["asset"], at="now").first()
    assert (row["start"], row["latest"], row["usable"]) == (2, 3, True)


def test_depth_bands(spark):
    level = "array<struct<price:double,qty:double>>"
    d = spark.createDataFrame([(1, [(99.0, 1.0), (80.0, 3.0)], [(101.0, 2.0), (130.0, 4.0)])], f"id long, bids {level}, asks {level}")
    got = {(r["side"], r["band"]): r["size"] for r in flow.depth_bands(d, id_cols=["id"], width=10.0).collect()}
    assert got == {("bid", 0): 1.0, ("bid", 1): 3.0, ("ask", 0): 2.0, ("ask", 3): 4.0} or got[("ask", 3)] == 4.0


def test_ingest_merge_and_coverage(spark):
    stored = spark.createDataFrame([("x", 1000, "s")], "k string, ts long, src string")
    batch = spark.createDataFrame([("x", 500, "b"), ("x", 2000, "b"), ("x", 1000, "b")], "k string, ts long, src string")
    got = {(r["ts"], r["src"]) for r in prompts.ingest_merge(stored, batch, keys=["k"], ts="ts").collect()}
    assert got == {(500, "b"), (1000, "s"), (2000, "b")}
    have = spark.createDataFrame([("x", 1000), ("x", 3000)], "k string, ts long")
    gaps = {(r["from_ms"], r["to_ms"]) for r in prompts.coverage_windows(have, keys=["k"], ts="ts", start=0, end=5000, step=1000).collect()}
    assert gaps == {(0, 1000), (4000, 5000)}
    assert prompts.coverage_windows(have, keys=["k"], ts="ts", start=1000, end=3001, step=1000).filter("to_ms <= 3000").count() == 0


def test_exclusive_percentile(spark):
    s = spark.range(1, 101).selectExpr("'x' k", "double(id) v").union(spark.range(5).selectExpr("'y'", "double(id)"))
    got = {r["k"]: r["percentile"] for r in quantiles.exclusive_percentile(s, by=["k"], value="v", p=0.95).collect()}
    assert got["x"] == pytest.approx(95.95) and got["y"] == 4.0


def test_replayed_book(spark):
    start = spark.createDataFrame([(1, "bid", 99.0, 1.0), (1, "bid", 98.0, 2.0)], "id long, side string, price double, qty double")
    diffs = spark.createDataFrame([(1, "bid", 99.0, 5.0, 1), (1, "bid", 98.0, 0.0, 2), (1, "bid", 97.0, 4.0, 3)], "id long, side string, price double, qty double, seq long")
    assert {(r["price"], r["qty"]) for r in flow.replayed_book(start, diffs, id_cols=["id"]).collect()} == {(99.0, 5.0), (97.0, 4.0)}


def test_trade_flow_window_ends_at_last_trade(spark):
    rows = [("x", 1, 1000, 4.0, False), ("x", 2, 3000, 1.0, True), ("x", 3, 5000, 1.0, False), (None, 4, 5000, 9.0, False)]
    t = spark.createDataFrame(rows, "asset string, seq long, recv_ts_ms long, qty double, buyer_is_maker boolean")
    p = spark.createDataFrame([("x", 10_000), ("x", 500), (None, 10_000), ("x", None)], "asset string, now long")
    (r,) = flow.trade_flow(p, t, keys=["asset"], at="now", reach_ms=60_000, last_n=1, window_ms=2000).collect()
    assert r["flow"] == pytest.approx(4 / 6) and r["flow_fast"] == 1.0 and r["flow_window"] == 0.0 and r["qty_window"] == 2.0


def test_empty_inputs(spark):
    t = spark.createDataFrame([], "asset string, seq long, ts_ms long, price double, recv_ts_ms long, qty double")
    assert prompts.price_moves(prompts.trade_groups(t, keys=["asset"]), keys=["asset"], tick=0.01).count() == 0
    assert C.gap_filled(C.candles_from_trades(t, keys=["asset"]), keys=["asset"]).count() == 0
    assert asof_join(t, t, keys=["asset"], left_ts="ts_ms", right_ts="recv_ts_ms", seq="seq", chunk_ms=10).count() == 0


def test_reference_price(spark):
    rows = [(1, 99.0, 100.0, 101.0), (2, 500.0, 100.0, 101.0), (3, None, None, 101.0), (4, float("nan"), float("inf"), None), (5, -1.0, 7.0, None), (6, 202.0, None, 101.0), (7, 300.0, 0.0, 101.0)]
    df = spark.createDataFrame(rows, "k int, a double, b double, close double")
    got = df.select("k", features.reference_price([F.col("a"), F.col("b")], F.col("close")).alias("p")).collect()
    assert {x.k: x.p for x in got} == {1: 99.0, 2: 100.0, 3: 101.0, 4: 1.0, 5: 7.0, 6: 202.0, 7: 101.0}


def test_blended_vol(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0, True), (2, 1.0, 2.0, False), (3, 1.0, 0.0, True), (4, 0.0, 2.0, True)], "k int, s double, f double, whole boolean")
    got = {x.k: round(x.v, 9) for x in df.select("k", features.blended_vol(F.col("s"), F.col("f"), F.col("whole")).alias("v")).collect()}
    assert got == {1: 1.4, 2: 1.0, 3: 1.0, 4: 0.8}


def test_recent_ofi_against_a_loop(spark):
    rng = np.random.default_rng(4)
    ticks = [("a", "spot", i, int(t), 100 + float(p), float(b), 101 + float(p), float(q)) for i, (t, p, b, q) in enumerate(zip(np.sort(rng.integers(0, 60_000, 300)), rng.integers(0, 3, 300), rng.integers(1, 9, 300), rng.integers(1, 9, 300)))]
    q = spark.createDataFrame(ticks, "asset string, venue string, seq long, recv_ts_ms long, bid_price double, bid_qty double, ask_price double, ask_qty double")
    at = [500, 3_000, 12_000, 40_000, 59_999]
    prompts = spark.createDataFrame([("a", t) for t in at], "asset string, current_time_ms long")
    got = {x.current_time_ms: x.value for x in flow.recent_ofi(prompts, flow.quote_ofi(q, keys=["asset", "venue"], chunk_ms=7_000), window_ms=10_000).collect()}
    for now in at:
        w = [t for t in ticks if now - 10_000 < t[3] <= now]
        late = [i for i in range(1, len(w)) if w[i][3] >= w[-1][3] - 1000]
        net = gross = 0.0
        for i in late:
            (*_, b0, s0, a0, r0), (*_, b, s, a, r) = w[i - 1], w[i]
            bid = s if b > b0 else -s0 if b < b0 else s - s0
            ask = r if a < a0 else -r0 if a > a0 else r - r0
            net, gross = net + bid - ask, gross + abs(bid) + abs(ask)
        want = net / gross if len(w) >= 8 and len(late) >= 2 and gross else 0.0
        assert got.get(now, 0.0) == pytest.approx(want)


def test_run_report(spark):
    rows = [("a", t, 0.1 * t, True, True, float(t)) for t in range(1, 25)] + [("a", 30, None, False, False, None), ("b", 1, None, False, False, None)]
    runs = spark.createDataFrame(rows, "asset string, current_time_ms long, crps double, answered boolean, readable boolean, latency_ms double")
    got = {x.asset: x for x in scoring.run_report(runs, by=["asset"], budget_ms=12.5).collect()}
    assert (got["a"].n, got["a"].n_unreadable, got["a"].median_ms, got["a"].max_ms, got["a"].within_budget) == (24, 1, 12.5, 24.0, True)
    assert got["a"].p95_ms == pytest.approx(23.75) and (got["b"].n, got["b"].n_unreadable) == (None, 1)


def test_saved_payload_violations_of_nothing(spark):
    from tidemark.sources import files

    one = spark.createDataFrame([(5, "x", 1, 10, 100, ("time", None), None)], files.PAYLOAD)
    judged = payloads.saved_payload_violations(one, assets={"x": ("X", 1.0)}, kinds=("time",))
    codes = judged.first().codes
    assert not {"version", "kind", "trigger_venue", "horizon", "percentiles", "asset"} & set(codes)
    assert {"spot:symbol", "spot:trades:missing", "futures:depth_latest:missing", "spot:depth_bands:missing", "futures:last_event_times"} <= set(codes)
    assert judged.limit(0).count() == 0


def test_ingest_merge_keeps_rows_of_one_instant(spark):
    stored = spark.createDataFrame([("x", 1000, 1)], "k string, ts long, seq long")
    batch = spark.createDataFrame([("x", 2000, 5), ("x", 2000, 6), ("x", 2000, 6), ("x", 1000, 2), ("y", 7, 1), ("y", 7, 2)], "k string, ts long, seq long")
    got = sorted((r["k"], r["ts"], r["seq"]) for r in prompts.ingest_merge(stored, batch, keys=["k"], ts="ts", ids=["seq"]).collect())
    assert got == [("x", 1000, 1), ("x", 2000, 5), ("x", 2000, 6), ("y", 7, 1), ("y", 7, 2)]


def test_book_momentum_takes_places_not_frames(spark):
    rows = [("k", s, s // 3 * 7 % 90 + s // 60 * 90, 10.0 + s % 11, 1.0, 11.0 + s % 11, 1.0) for s in range(300)] + [("k", 900, None, 1.0, 1.0, 1.0, 1.0), ("k", 901, 500, None, None, None, None)]
    q = spark.createDataFrame(rows, "key string, seq long, recv_ts_ms long, bid_price double, bid_qty double, ask_price double, ask_qty double")
    for chunk in (None, 40):
        m = flow.book_momentum(q, keys=["key"], lookback_ms=60, lags={"m": 10}, chunk_ms=chunk)
        assert "-59" not in m._jdf.queryExecution().optimizedPlan().toString()  # no frame of the lookback, whose rows each tick would go over
        got = {r["seq"]: r["m"] for r in m.collect()}
        assert len(got) == len(rows)
        mid = {s: None if b is None else (b + a) / 2 for _, s, _, b, _, a, _ in rows}
        for _, s, t, *_ in rows:
            earlier = [(u, z) for _, z, u, *_ in rows if t is not None and u is not None and t - 60 < u <= t - 10]
            before = mid[max(earlier)[1]] if earlier else None
            assert got[s] == pytest.approx(math.log(mid[s] / before) if before and mid[s] else 0.0)
