"""Window statistics against plain loops over each window's rows, for several chunks."""

import math
import random

import numpy as np
import pytest

from tidemark.operators import flow, signals
from tidemark.operators.windows import Rows, evenly

CHUNKS = (700, 5_000, None)


@pytest.fixture(scope="module")
def ticks():
    """Trades and quotes of two assets and venues at once, several at one instant, and a quiet stretch."""
    rnd, rows = random.Random(21), []
    for i in range(900):
        t = rnd.randrange(0, 20_000) if i % 3 else rnd.randrange(0, 60_000) // 500 * 500
        rows.append((rnd.choice("ab"), rnd.choice(["spot", "futures"]), i, t, 100 + rnd.randrange(9) / 4, float(rnd.randrange(1, 6)), rnd.random() < 0.5))
    return rows


@pytest.fixture(scope="module")
def tables(spark, ticks):
    t = spark.createDataFrame(ticks, "asset string, venue string, seq long, recv_ts_ms long, price double, qty double, buyer_is_maker boolean")
    q = t.selectExpr("asset", "venue", "seq", "recv_ts_ms", "price - 0.25 bid_price", "qty bid_qty", "price + 0.25 ask_price", "1D + seq % 3 ask_qty")
    at = sorted({*range(0, 62_000, 1_500), 499, 500, 501, 19_999})
    p = spark.createDataFrame([(a, v, x) for a in "ab" for v in ("spot", "futures") for x in at], "asset string, venue string, now long")
    return t, q, p


def inside(ticks, key, lo, hi):
    return sorted((r for r in ticks if (r[0], r[1]) == key and lo < r[3] <= hi), key=lambda r: (r[3], r[2]))


def micro(r):
    bid, ask, bq, aq = r[4] - 0.25, r[4] + 0.25, r[5], 1.0 + r[2] % 3
    return (bid * aq + ask * bq) / (bq + aq)


def near(got, want):
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-9), k


def test_counts_and_flows(ticks, tables):
    t, _, p = tables
    sign = lambda r: -r[5] if r[6] else r[5]
    counts, flows = {}, {}
    for a, v, x in p.collect():
        w = inside(ticks, (a, v), x - 3000, x)
        if not w:
            continue
        short = [r for r in w if r[3] > x - 700]
        vol = sum(r[5] for r in short)
        prices = [r[4] for r in short]
        counts[a, v, x] = [len(short), vol, sum(map(sign, short)), max(prices) - min(prices) if prices else -1, sum(r[4] * r[5] for r in short) / vol if vol else -1, len(w)]
        late = [r for r in w if r[3] >= w[-1][3] - 800]
        share = lambda rows: sum(map(sign, rows)) / sum(r[5] for r in rows)
        flows[a, v, x] = [share(w), share(w[-4:]), share(late), sum(r[5] for r in late)]
    for chunk in CHUNKS:
        c = flow.tick_counts(p, t, keys=["asset", "venue"], at="now", spans={"s": 700, "l": 3000}, chunk_ms=chunk)
        some = lambda x: -1 if x is None else x
        near({(r["asset"], r["venue"], r["now"]): [r["n_s"], r["vol_s"], r["flow_s"], some(r["range_s"]), some(r["vwap_s"]), r["n_l"]] for r in c.collect()}, counts)
        f = flow.trade_flow(p, t, keys=["asset", "venue"], at="now", reach_ms=3000, last_n=4, window_ms=800, chunk_ms=chunk)
        near({(r["asset"], r["venue"], r["now"]): [r["flow"], r["flow_fast"], r["flow_window"], r["qty_window"]] for r in f.collect()}, flows)


def test_volatility_with_and_without_thinning(ticks, tables):
    _, q, p = tables
    for most in (None, 9):
        want = {}
        for a, v, x in p.collect():
            w = inside(ticks, (a, v), x - 8000, x)
            w = [r for r in w if r[3] > w[-1][3] - 6000]
            if most and len(w) > most:
                w = [w[int(i)] for i in np.linspace(0, len(w) - 1, most, dtype=np.int64)]
            if len(w) >= 5:
                m = [micro(r) for r in w]
                r = np.diff(np.log(m))
                want[a, v, x] = [len(w), float(np.std(r) * math.sqrt(len(r))), math.log(max(m) / min(m))]
        assert len(want) > 50
        for chunk in CHUNKS:
            got = flow.book_volatility(p, q, keys=["asset", "venue"], at="now", reach_ms=8000, window_ms=6000, least=5, most=most, chunk_ms=chunk)
            near({(r["asset"], r["venue"], r["now"]): [r["n"], r["rv"], r["rng"]] for r in got.collect()}, want)


def test_horizon_pairs(ticks, tables):
    _, q, p = tables
    levels, want = [0.1, 0.5, 0.95], {}
    for a, v, x in p.collect():
        w = inside(ticks, (a, v), x - 9000, x)
        step = max(1, -(-len(w) // 20))
        moves = []
        for i in range(0, len(w), step):
            j = max(k for k, r in enumerate(w) if r[3] <= w[i][3] + 2000)
            if j > i and w[j][3] - w[i][3] >= 1500:
                moves.append(micro(w[j]) - micro(w[i]))
        if len(w) >= 12 and len(moves) >= 6:
            want[a, v, x] = [len(w), len(moves), sum(moves), *(np.quantile(moves, levels) - np.median(moves))]
    assert len(want) > 40
    for chunk in CHUNKS:
        got = flow.horizon_pairs(p, q, keys=["asset", "venue"], at="now", reach_ms=9000, horizon_ms=2000, gap_ms=1500, most=20, least_ticks=12, least_pairs=6, levels=levels, chunk_ms=chunk)
        near({(r["asset"], r["venue"], r["now"]): [r["n_ticks"], r["n_pairs"], r["total"], *r["q"]] for r in got.collect()}, want)


def test_liquidations_count_both_ends(spark):
    rows = [("a", i, t, 1.0, 2.0 if t else 0.0, t % 2 == 0) for i, t in enumerate((0, 1000, 2000, 3500, 4000, 4001))]
    liq = spark.createDataFrame(rows, "asset string, seq long, recv_ts_ms long, price double, qty double, is_buy boolean")
    p = spark.createDataFrame([("a", 4000), ("a", 900), ("b", 4000)], "asset string, now long")
    (r,) = flow.liquidation_signals(p, liq, keys=["asset"], at="now", reach_ms=3000, recent_ms=500, unit=10.0, long_unit=100.0).collect()
    assert r["n"] == 4 and r["direction"] == pytest.approx(math.tanh(0.4)) and r["activity"] == pytest.approx(math.tanh(0.08))


def test_basis_is_a_mean_over_the_grid(ticks, tables, spark):
    """The basis' deviation from its mean over a grid back from each prompt, by loops."""
    _, q, _ = tables
    p = spark.createDataFrame([("a", x) for x in (3000, 9750, 15_000, 30_500)], "asset string, current_time_ms long")
    last = lambda v, x: [r[4] for r in inside(ticks, ("a", v), -1, x)][-1]
    wide = signals.build_signals(
        p, quotes=q, trades=tables[0], depth=spark.createDataFrame([], "asset string, venue string, seq long, recv_ts_ms long, bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>"),
        candles=spark.createDataFrame([], "asset string, venue string, open_time_ms long, high double, low double, close double"), liquidations=spark.createDataFrame([], "asset string, seq long, recv_ts_ms long, qty double, is_buy boolean"),
        unit=1, grid_ms=100, chunk_ms=5000,
    )
    got = {r["current_time_ms"]: r for r in wide.collect()}
    assert len(got) == 4
    for x, r in got.items():
        first = max(inside(ticks, ("a", v), x - 60_000, x)[0][3] for v in ("spot", "futures"))
        for w in signals.BASIS_S:
            grid = [x - 100 * k for k in range(600) if x - 100 * k >= first and 100 * k < w * 1000]
            want = last("futures", x) - last("spot", x) - np.mean([last("futures", g) - last("spot", g) for g in grid])
            assert r[f"bdev{w}"] == pytest.approx(want, abs=1e-9)
        assert r["s_nbt1000"] == len(inside(ticks, ("a", "spot"), x - 1000, x)) and r["liq_n10"] == 0 and r["s_dspan"] is None


def test_extremes_and_even_places():
    rng = np.random.default_rng(2)
    v = rng.normal(size=77)
    rows = Rows({"t": np.arange(77)}, "t")
    lo = rng.integers(0, 77, 200)
    hi = np.minimum(lo + rng.integers(0, 78, 200), 77)
    for better, plain in ((np.fmax, max), (np.fmin, min)):
        got = rows.extremes(v, better)(lo, hi)
        assert all((math.isnan(g) and a == b) or g == plain(v[a:b]) for g, a, b in zip(got, lo, hi, strict=True))
    places, valid = evenly(np.array([3, 0, 5]), np.array([3, 4, 50]), 7)
    assert valid.sum(1).tolist() == [0, 4, 7] and places[1][:4].tolist() == [0, 1, 2, 3]
    assert places[2].tolist() == (5 + np.linspace(0, 44, 7, dtype=np.int64)).tolist()
