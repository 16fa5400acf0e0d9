"""The forecast chain against a plain reading of its rules, one row and one price at a time."""

import math
import random

import numpy as np
import pytest

from tidemark.functions import ladders as L
from tidemark.operators import chain, forecast
from tidemark.operators.windows import Rows, hour_parts

S = chain.Settings(shift_weights={"flow": 1e-3, "in_imb": 2e-3}, size_weights={"in_vol": 0.5, "in_one": 1e-3}, widths=(0.05, 5.0), band=0.02)


def median(q):
    return (q[49] + q[50]) / 2


def width(q):
    return sum(abs(v - median(q)) for v in q) / 100


def plain_ladder(c, offsets, bins):
    """One row by the order of the rules."""
    px, mu, sigma, z = c["price"], c["mu"], c["sigma"], L.mixture_z()
    z_abs = sum(map(abs, z)) / 100
    q = [px + mu + sigma * v for v in z]
    quiet = c["slot"] >= 720 and c["seas_rel"] < S.quiet_below
    cap, pivot, slope = S.quiet_book if quiet else S.book
    less = S.loud[1] if abs(c["imb"]) >= S.loud[0] else 1.0
    if offsets is not None:
        mad = sum(map(abs, offsets)) / 100
        w = min(max(slope * max(pivot - mad / (sigma * z_abs), 0), 0), cap * less) if mad > 0 else 0
        q = [(1 - w) * a + w * (px + b) for a, b in zip(q, offsets, strict=True)]
    if offsets is not None and (c["n_closes"] < 50 or c["jump_ratio"] < S.jump_from):
        w = S.history * less
        q = [(1 - w) * a + w * (px + b) for a, b in zip(q, offsets, strict=True)]
    elif c["jump_ratio"] >= S.jump_from:
        m = median(q)
        q = [m + S.calm * (v - m) if 8 <= i < 92 else v for i, v in enumerate(q)]
    add = (S.keep[0] - 1) * mu + S.keep[1] * c["c1"] * px
    q = [max(v + add, L.FLOOR) for v in q]
    q = [max(q[: i + 1]) for i in range(100)]
    if c["clock"]:
        share = 0.0
        if bins is not None:
            z0 = (c["p90"] * px - S.candle[0]) / S.candle[1] + S.candle[2] * c["activity"]
            share = 0.0 if z0 >= 20 else 1.0 if z0 <= -20 else 1 / (1 + math.exp(z0))
        if share > 1e-4:
            mean = sum(bins) / 50
            tilt = min(max(mu / px / mean, -1), 1) if mean > 0 else 0
            candles = [px * math.exp(-b * (1 - tilt)) for b in reversed(bins)] + [px * math.exp(b * (1 + tilt)) for b in bins]
            if share >= 1 - 1e-4:
                q = candles
            else:
                atoms = sorted([(v, (1 - share) / 100) for v in q] + [(v, share / 100) for v in candles])
                out, total, k = [], 0.0, -1
                for t in L.GRID:
                    while total < t - 1e-9:
                        k += 1
                        total += atoms[k][1]
                    out.append(atoms[k][0])
                q = out
    else:
        quarter = lambda i: (q[i - 1] + q[i]) / 2
        down, up = quarter(50) - quarter(25), quarter(75) - quarter(50)
        q = [v + S.centre * t * (-down if i < 50 else up) for i, (v, t) in enumerate(zip(q, L.tent(), strict=True))]
        q = [max(max(q[: i + 1]), L.FLOOR) for i in range(100)]
        clip = lambda x: min(max(x, -3), 3)
        by = (S.event[0] * clip(c["flow_z"]) + S.event[1] * clip(c["move_z"])) * width(q)
        q = [v + by for v in q]
    q = sorted(px + c["layer_scale"] * (v - px) + c["layer_shift"] if abs(v - px) > S.band else v for v in q)
    if offsets is not None:
        own, recent = width(q), sum(map(abs, offsets)) / 100
        if recent > 0 and own >= S.live["narrowest"]:
            f = min(max((recent / own) ** S.live["power"], S.live["least"]), S.live["most"])
            if abs(f - 1) >= 1e-4:
                m = median(q)
                q = sorted(v if abs(v - px) <= S.band else m + f * (v - m) for v in q)
    return q


def random_rows(n):
    rnd = random.Random(5)
    rows, offsets, bins = [], [], []
    for i in range(n):
        rows.append({
            "price": 100 + rnd.random(), "mu": rnd.gauss(0, 0.2), "sigma": rnd.uniform(0.05, 1), "slot": float(rnd.randrange(1008)), "seas_rel": rnd.uniform(0.5, 1.5), "imb": rnd.uniform(-1, 1),
            "jump_ratio": rnd.choice([3.0, 20.0, 1e9]), "n_closes": float(rnd.choice([10, 60])), "c1": rnd.gauss(0, 1e-3), "p90": rnd.choice([0.0, 0.01, 0.02, 0.3]), "activity": rnd.gauss(0, 0.3),
            "clock": float(i % 3 > 0), "flow_z": rnd.gauss(0, 2), "move_z": rnd.gauss(0, 2), "layer_shift": rnd.choice([0.0, 0.01]), "layer_scale": rnd.choice([1.0, 1.1]), "mass": 0.0,
        })
        offsets.append(sorted(rnd.gauss(0, 0.3) for _ in range(100)) if i % 4 else None)
        bins.append(sorted(abs(rnd.gauss(0, 0.004)) for _ in range(50)) if i % 5 else None)
    return rows, offsets, bins


def test_ladders_against_plain_rows():
    rows, offsets, bins = random_rows(300)
    c = {n: np.array([r[n] for r in rows]) for n in rows[0]}
    matrix = lambda lists, w: (np.array([x or [0.0] * w for x in lists]), np.array([x is not None for x in lists]))
    got = chain.ladder_rows(c, matrix(offsets, 100), matrix(bins, 50), S)
    for row, o, b, q in zip(rows, offsets, bins, got, strict=True):
        assert np.allclose(q, plain_ladder(row, o, b), atol=1e-8), row
    c["mass"] = np.full(len(rows), 0.4)
    still = chain.ladder_rows(c, matrix(offsets, 100), matrix(bins, 50), S)
    assert all((np.abs(q - p) < 1e-9).sum() >= 38 for q, p in zip(still, c["price"], strict=True) if q[0] < p < q[-1])
    assert (np.diff(still, axis=1) > 0).all() and (np.diff(got, axis=1) > 0).all()


FEATURES = "vol_1s vol_fast s_imb f_imb flow_fast f_flow_window s_rng f_rng s_rv f_rv s_qty_window f_qty_window momentum basis s_m1 f_m1 s_m3 f_m3 s_m5 f_m5 obi c1 c3 stale_ms flow liq_dir band_imb liq_hour".split()


@pytest.fixture(scope="module")
def table(spark):
    rnd, rows = random.Random(9), []
    for i in range(60):
        own = [abs(rnd.gauss(0, 0.01)) if n[:3] in ("vol", "liq") or n.endswith(("rv", "rng", "window", "ms")) else rnd.gauss(0, 0.3) for n in FEATURES]
        hour = [abs(rnd.gauss(0, 0.01)) for _ in range(4)] + [5.0, 0.01, 0.1, 80.0] if i % 4 else [None] * 8
        bins = [0.001 * (k + 1) for k in range(50)] if i % 4 else None
        rows.append((f"p{i}", 100.0 + i if i != 7 else None, i % 9 != 0, *own, *hour, bins, [0.01 * (k - 49.5) for k in range(100)] if i % 3 else None, "time" if i % 2 else "event", i, 0.002, 1.1, rnd.uniform(-1, 1)))
    names = ", ".join(f"{n} double" for n in FEATURES)
    return spark.createDataFrame(rows, f"asset string, price double, quoted boolean, {names}, mad double, ewma double, hour_rv double, hour_rng double, jump_ratio double, p90 double, activity double, n_closes double, bins array<double>, offsets array<double>, kind string, slot int, seas_abs double, seas_rel double, ofi double")


def test_every_row_gets_a_valid_ladder(spark, table):
    got = {r["asset"]: r["q"] for r in chain.forecasts(table, S, keys=["asset"]).collect()}
    assert len(got) == 60
    for i in range(60):
        q = np.array(got[f"p{i}"])
        assert len(q) == 100 and (q > 0).all() and (np.diff(q) > 0).all()
        if i % 9 == 0 or i == 7:  # no quote: wide, about the price
            assert q.mean() == pytest.approx(1.0 if i == 7 else 100.0 + i, rel=1e-6) and (i == 7 or width(q) == pytest.approx(0.01 * (100 + i) * chain.Z_ABS, rel=1e-6))
    assert chain.forecasts(table.limit(0), S, keys=["asset"]).count() == 0
    bare = table.withColumn("seas_abs", table["seas_abs"] * 0).drop("ofi").selectExpr("*", "0D ofi")
    assert chain.forecasts(bare, S, keys=["asset"]).count() == 60


def test_widths_against_plain_rows(table):
    out = chain.widths(chain.model_inputs(table, root=math.sqrt(10.0)), S).collect()
    checked = 0
    for r in out:
        if r["price"] is None:
            continue
        px, z = r["price"], chain.Z_ABS
        held = lambda w: min(max(w, S.widths[0]), S.widths[1])
        bound = lambda m, w: min(max(m, -S.most_shift * w), S.most_shift * w)
        imb = (r["s_imb"] + r["f_imb"]) / 2
        ret = (1e-3 * r["flow"] + 2e-3 * imb) * S.shift_gain
        size = max(0.5 * r["vol_1s"] * math.sqrt(10) + 1e-3, 0)
        a, b, always = S.size_gain
        mu = ret * px
        w = held(max((a * size + b * abs(ret) + always) * px, (S.tick_gain[0] * max(r["s_rng"], r["f_rng"]) + S.tick_gain[1] * max(r["s_rv"], r["f_rv"])) * px))
        mad, recent = px * (r["mad"] or 0) / z, px * (r["ewma"] or 0) / z
        w = w * (mad / w) ** 0.8 if mad > w else w
        if r["ewma"] is not None:
            parts = [w, recent, px * r["hour_rv"] / z, px * r["hour_rng"] / z]
            w = math.exp(sum(k * math.log(max(p, S.widths[0])) for k, p in zip(S.vol_weights, parts, strict=True)))
        w = held(w)
        mu = bound(mu, w) + (S.liq[0] * r["liq_dir"] + S.liq[1] * r["band_imb"]) * w
        w = held(w * (1 + S.liq[2] * max(r["liq_hour"], 0)))
        w = held(w * min(max(0.62 + 0.38 * recent / w, 0.62), 1)) if recent > 0 else held(w)
        mu = bound(mu, w)
        if recent > 0:
            ratio = recent / w
            beyond = max(abs(mu) / w - S.flex["excess"], 0)
            gain = min(max(1 - S.flex["pull"] * beyond / min(max(ratio, S.flex["fade"][0]), S.flex["fade"][1]), S.flex["floor"]), 1)
            mu, w = mu * gain, w * min(max(ratio ** S.flex["power"], S.flex["narrowest"]), 1)
        w = held(w)
        mu = bound(mu, w)
        season = px * r["seas_abs"] / z
        w = held(w * math.exp(min(max(S.season[0] * (math.log(season) - math.log(w)), -S.season[1]), S.season[1])))
        mu = bound(mu + (S.flow_gain * r["ofi"] + S.imbalance_gain[r["kind"] != "time"] * imb) * w, w)
        assert r["sigma"] == pytest.approx(w, rel=1e-9) and r["mu"] == pytest.approx(mu, rel=1e-9, abs=1e-12)
        checked += 1
    assert checked == 59


def test_hours_without_enough_closes():
    measure, _ = hour_parts(50, 1000, step=10, short=20, half=30, quick=5, bins=50, decay=0.9, least=5)
    rows = Rows({"t": np.arange(1, 41) * 1000, "close": np.linspace(100, 104, 40)}, "t")
    got = measure(rows, np.array([500, 5_000, 12_000, 20_000, 40_000]))
    assert got["there"].tolist() == [False, True, True, True, True] and got["n_closes"].tolist() == [0, 5, 12, 20, 40]
    assert np.isnan(got["mad"][:2]).all() and got["jump_ratio"][2] == 1e9 and got["bins"][2] is None and len(got["bins"][4]) == 50
    assert (np.diff(got["bins"][4]) >= 0).all()


def test_futures_stand_in_for_short_spot_hours(spark):
    rows = [("a", "spot", 50, 1.0), ("a", "futures", 90, 2.0), ("b", "spot", 39, 1.0), ("b", "futures", 40, 2.0), ("c", "spot", 10, 1.0), ("c", "futures", 39, 2.0), ("d", "futures", 5, 2.0)]
    got = chain.preferred_hours(spark.createDataFrame(rows, "asset string, venue string, n_closes long, mad double"), ["asset"]).collect()
    assert {r["asset"]: r["venue"] for r in got} == {"a": "spot", "b": "futures", "c": "spot", "d": "futures"}


def test_a_users_model(spark):
    rows = spark.createDataFrame([("a", 100.0), ("b", -1.0), ("c", 50.0)], "asset string, price double")

    def model(pdf):
        return pdf["price"].to_numpy()[:, None] + np.arange(100) / 100

    got = {r["asset"]: r for r in forecast.score_with(rows, model, keys=["asset"]).collect()}
    assert got["a"]["q"][99] == 100.99 and got["a"]["codes"] == [] and got["b"]["q"] is None and "not_positive" in got["b"]["codes"]

    def broken(pdf):
        raise ValueError("no")

    assert {tuple(r["codes"]) for r in forecast.score_with(rows, broken, keys=["asset"]).collect()} == {("missing",)}
