"""The whole forecast: feature rows to ladders, with widths as columns and ladders as matrices of an Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ladders as L
from tidemark.functions import quotes as Q
from tidemark.operators import forecast

BINS = L.N // 2
_Z = np.array(L.mixture_z())
#: Mean distance of the unit ladder from its median: turns a mean move into a width.
Z_ABS = float(np.abs(_Z).mean())


@dataclass(frozen=True)
class Settings:
    """What a fitted model would bring; every number is a parameter."""

    shift_weights: dict[str, float]
    size_weights: dict[str, float]
    shift_gain: float = 1.2
    size_gain: tuple[float, float, float] = (0.8, 0.1, 1e-5)  # of the size, of the shift, and always
    tick_gain: tuple[float, float] = (0.1, 0.2)  # of the range and volatility of ticks
    widths: tuple[float, float] = (0.05, 60.0)
    most_shift: float = 0.9  # of the width
    vol_weights: tuple[float, float, float, float] = (0.4, 0.2, 0.2, 0.2)  # of the width, recent moves, short volatility, range
    liq: tuple[float, float, float] = (0.1, 0.05, 0.2)  # direction, bands, hour's activity
    flex: dict[str, float | tuple[float, float]] = field(default_factory=lambda: {"pull": 0.5, "excess": 0.2, "floor": 0.4, "power": 0.5, "narrowest": 0.6, "fade": (0.5, 2.0)})
    season: tuple[float, float] = (0.2, 0.25)  # weight and most
    flow_gain: float = 0.05
    imbalance_gain: tuple[float, float] = (0.1, 0.2)  # on the clock, and on events
    book: tuple[float, float, float] = (0.3, 0.9, 1.5)  # cap, pivot, slope
    quiet_book: tuple[float, float, float] = (0.5, 1.1, 1.5)
    quiet_below: float = 0.8
    loud: tuple[float, float] = (0.7, 0.5)  # an imbalance from here on halves the books' part
    history: float = 0.2
    jump_from: float = 12.0
    calm: float = 0.98
    keep: tuple[float, float] = (0.9, 0.1)  # of the shift, and of the last single move
    candle: tuple[float, float, float] = (1.2, 0.4, 0.7)  # pivot, scale, beta
    centre: float = 0.08
    event: tuple[float, float] = (0.1, -0.05)  # of the flow's and the spent move's z
    live: dict[str, float] = field(default_factory=lambda: {"power": 0.5, "least": 0.8, "most": 1.25, "narrowest": 1e-6})
    band: float = 0.005
    still: dict[str, float] = field(default_factory=lambda: {"widen": 0.5, "shift": 0.3, "hole": 0.2})
    fallback: float = 0.01


def model_inputs(features: DataFrame, *, root: float) -> DataFrame:
    """``features`` with the derived inputs of both linear heads; ``root`` turns a bar's volatility into the horizon's."""
    f = lambda n: F.coalesce(F.col(n), F.lit(0.0))
    vol, fast = f("vol_1s") * root, f("vol_fast") * root
    imb, flow = 0.5 * (f("s_imb") + f("f_imb")), 0.5 * (f("flow_fast") + f("f_flow_window"))
    rng, rv = F.greatest(f("s_rng"), f("f_rng")), F.greatest(f("s_rv"), f("f_rv"))
    qty = {v: F.log1p(F.greatest(f(f"{v}_qty_window"), F.lit(0.0))) for v in "sf"}
    sizes = {f"abs_{n}": F.abs(f(n)) for n in ("momentum", "basis", "s_m1", "f_m1", "s_m3", "f_m3", "s_m5", "f_m5", "s_imb", "obi", "flow_fast", "c1", "c3")}
    made = {
        "one": F.lit(1.0), "imb": imb, "flow_mix": flow, "imb_vol": imb * vol, "flow_vol": flow * vol, "c1_tanh": F.tanh(f("c1") * 1000), "basis_vol": f("basis") * vol, "vol": vol, "fast": fast,
        "rng": rng, "rv": rv, "vol_most": F.greatest(vol, fast), "rng_over": F.greatest(rng - vol, F.lit(0.0)), "s_qty_log": qty["s"], "f_qty_log": qty["f"], "qty_rng": qty["f"] * rng, "stale": f("stale_ms") / 1000,
    }
    return features.withColumns({f"in_{n}": c for n, c in (made | sizes).items()})


def widths(df: DataFrame, s: Settings) -> DataFrame:
    """``df`` with ``mu`` and ``sigma`` in price: both heads, then the width's steps in their order, held in its bounds after each.

    Floor by the ticks' range and volatility; raised to the hour's moves; drawn in logarithms to the latest ones; widened by
    liquidations; shrunk in a regime calmer than it; flexed with the shift; drawn to the slot's season. The shift takes
    liquidations, bands, order flow and imbalance on the way and never exceeds its part of the width.
    """
    px, c = F.greatest("price", F.lit(L.FLOOR)), lambda n: F.coalesce(F.col(n), F.lit(0.0))
    low, high = (F.lit(x) for x in s.widths)
    held = lambda w: F.least(F.greatest(w, low), high)
    bound = lambda m, w: F.least(F.greatest(m, -s.most_shift * w), s.most_shift * w)

    def step(df: DataFrame, **columns: Column) -> DataFrame:
        return df.withColumns(columns)

    d = step(df, __mu_ret=forecast.linear(s.shift_weights) * s.shift_gain, __size=F.greatest(forecast.linear(s.size_weights), F.lit(0.0)))
    a, b, always = s.size_gain
    d = step(d, mu=F.col("__mu_ret") * px, sigma=held(F.greatest((a * F.col("__size") + b * F.abs("__mu_ret") + always) * px, (s.tick_gain[0] * c("in_rng") + s.tick_gain[1] * c("in_rv")) * px)))
    d = step(d, sigma=forecast.blended_width(F.col("sigma"), px * c("mad") / Z_ABS))
    recent = px * c("ewma") / Z_ABS
    parts = [F.col("sigma"), recent, *[F.coalesce(px * F.when(F.col(n) > 0, F.col(n)) / Z_ABS, recent) for n in ("hour_rv", "hour_rng")]]
    log = sum((w * F.ln(F.greatest(p, low)) for w, p in zip(s.vol_weights, parts, strict=True)), F.lit(0.0))
    d = step(d, sigma=held(F.when(F.col("ewma").isNotNull(), F.exp(log)).otherwise(F.col("sigma"))))
    d = step(d, mu=bound(F.col("mu"), F.col("sigma")) + (s.liq[0] * c("liq_dir") + s.liq[1] * c("band_imb")) * F.col("sigma"))
    d = step(d, sigma=held(forecast.liquidation_width(F.col("sigma"), c("liq_hour"), gain=s.liq[2])))
    d = step(d, sigma=held(forecast.regime_width(F.col("sigma"), recent)))
    mu, sigma = forecast.flexed(bound(F.col("mu"), F.col("sigma")), F.col("sigma"), recent, **s.flex)
    d = step(d, __m=mu, __s=held(sigma)).drop("mu", "sigma").withColumnsRenamed({"__m": "mu", "__s": "sigma"})
    d = step(d, mu=bound(F.col("mu"), F.col("sigma")), sigma=held(forecast.season_width(F.col("sigma"), px * c("seas_abs") / Z_ABS, weight=s.season[0], most=s.season[1])))
    imb = F.when(F.col("kind") == "time", s.imbalance_gain[0]).otherwise(s.imbalance_gain[1]) * c("in_imb")
    d = step(d, mu=bound(F.col("mu") + (s.flow_gain * c("ofi") + imb) * F.col("sigma"), F.col("sigma")))
    return d.drop("__mu_ret", "__size")


def _lists(batch: pa.RecordBatch, name: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """A column of arrays as a matrix, and which rows have one of that length and finite."""
    lists = batch.column(name)
    whole = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == width
    out = np.zeros((len(lists), width))
    out[whole] = lists.filter(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    whole &= np.isfinite(out).all(1)
    out[~whole] = 0.0
    return out, whole


def _books(c: dict[str, np.ndarray], q: np.ndarray, offsets: np.ndarray, has: np.ndarray, s: Settings) -> np.ndarray:
    """The ladder drawn to the quantiles of recent moves, the more the narrower they are; then their fixed part, or a calmer
    core where the hour jumps. Quiet weekend slots trust them more, a loud imbalance less."""
    px, sigma = c["price"][:, None], c["sigma"]
    quiet = (c["slot"] >= 5 * 144) & (c["seas_rel"] < s.quiet_below)
    cap, pivot, slope = (np.where(quiet, a, b) for a, b in zip(s.quiet_book, s.book, strict=True))
    less = np.where(np.abs(c["imb"]) >= s.loud[0], s.loud[1], 1.0)
    mad = np.abs(offsets).mean(1)
    weight = np.clip(slope * np.maximum(pivot - mad / (sigma * Z_ABS), 0), 0, cap * less)
    weight = np.where(has & (mad > 0), weight, 0.0)[:, None]
    q = (1 - weight) * q + weight * (px + offsets)
    jumpy = c["jump_ratio"] >= s.jump_from
    known = has & ((c["n_closes"] < 50) | ~jumpy)
    part = np.where(known, s.history * less, 0.0)[:, None]
    q = (1 - part) * q + part * (px + offsets)
    middle = 0.5 * (q[:, L.N // 2 - 1] + q[:, L.N // 2])[:, None]
    core = (~known & jumpy)[:, None] & ((np.arange(L.N) >= 8) & (np.arange(L.N) < L.N - 8))
    return np.where(core, middle + s.calm * (q - middle), q)


def mirrored_rows(bins: np.ndarray, price: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """``ladders.mirrored``, a row each."""
    mean = bins.mean(1)
    tilt = np.clip(np.divide(drift, mean, out=np.zeros(len(mean)), where=mean > 0), -1, 1)[:, None]
    return price[:, None] * np.exp(np.concatenate([-bins[:, ::-1] * (1 - tilt), bins * (1 + tilt)], axis=1))


def centre_rows(q: np.ndarray, spread: float) -> np.ndarray:
    """``ladders.centre_widened``, a row each."""
    at = lambda i: 0.5 * (q[:, i - 1] + q[:, i])[:, None]
    half = L.N // 2
    gap = np.where(np.arange(L.N) < half, -spread * (at(half) - at(half // 2)), spread * (at(half + half // 2) - at(half)))
    return np.maximum.accumulate(np.maximum(q + gap * np.array(L.tent()), L.FLOOR), axis=1)


def ladder_rows(c: dict[str, np.ndarray], offsets: tuple[np.ndarray, np.ndarray], bins: tuple[np.ndarray, np.ndarray], s: Settings) -> np.ndarray:
    """R1, R5, R6 to R8, R10, R12, R13, R11, R9 and R2 of rows with a price, a shift and a width; ``offsets`` and ``bins`` come with their flags."""
    px, mu, sigma = c["price"], c["mu"], c["sigma"]
    q = _books(c, px[:, None] + mu[:, None] + sigma[:, None] * _Z, *offsets, s)
    q = q + ((s.keep[0] - 1) * mu + s.keep[1] * c["c1"] * px)[:, None]
    q = np.maximum.accumulate(np.maximum(q, L.FLOOR), axis=1)
    clock = c["clock"] > 0
    pivot, scale, beta = s.candle
    z = np.clip((c["p90"] * px - pivot) / scale + beta * c["activity"], -50, 50)
    share = np.where(clock & bins[1], np.where(z >= 20, 0.0, np.where(z <= -20, 1.0, 1 / (1 + np.exp(z)))), 0.0)
    candles = mirrored_rows(bins[0], px, mu / px)
    some = (share > 1e-4) & (share < 1 - 1e-4)
    q = np.where((share >= 1 - 1e-4)[:, None], candles, q)
    q[some] = L.mixed_rows(q[some], candles[some], share[some])
    width = lambda q: np.abs(q - 0.5 * (q[:, L.N // 2 - 1 : L.N // 2] + q[:, L.N // 2 : L.N // 2 + 1])).mean(1)
    moved = centre_rows(q, s.centre)
    moved = moved + ((s.event[0] * np.clip(c["flow_z"], -3, 3) + s.event[1] * np.clip(c["move_z"], -3, 3)) * width(moved))[:, None]
    q = np.where(clock[:, None], q, moved)
    away = np.abs(q - px[:, None]) > s.band
    q = np.sort(np.where(away, px[:, None] + c["layer_scale"][:, None] * (q - px[:, None]) + c["layer_shift"][:, None], q), axis=1)
    own, recent = width(q), np.abs(offsets[0]).mean(1)
    factor = np.clip(np.divide(recent, own, out=np.ones(len(own)), where=own > 0) ** s.live["power"], s.live["least"], s.live["most"])
    factor = np.where(offsets[1] & (recent > 0) & (own >= s.live["narrowest"]) & (np.abs(factor - 1) >= 1e-4), factor, 1.0)[:, None]
    middle = 0.5 * (q[:, L.N // 2 - 1] + q[:, L.N // 2])[:, None]
    q = np.sort(np.where((np.abs(q - px[:, None]) <= s.band) & (factor != 1), q, middle + factor * (q - middle)), axis=1)
    mass = c["mass"]
    use = (mass > 0) & (mass < 1)
    still = L.still_rows(q, px, np.where(use, mass, 0.5), width(q), **s.still)
    return L.sanitized_rows(np.where(use[:, None], still, q))


#: Numbers of a row that the ladder's steps read beside price, mu and sigma, and what stands for an absent one.
NUMBERS = {"slot": 0.0, "seas_rel": 1.0, "imb": 0.0, "jump_ratio": 1e9, "n_closes": 0.0, "c1": 0.0, "p90": 0.0, "activity": 0.0, "clock": 1.0, "flow_z": 0.0, "move_z": 0.0, "layer_shift": 0.0, "layer_scale": 1.0, "mass": 0.0}


def forecasts(rows: DataFrame, s: Settings, *, keys: list[str]) -> DataFrame:
    """``keys, q`` for every row, never null: the chain over a table of features, hours, offsets and season.

    ``rows`` has the features of ``complete_features``, ``hour_parts`` (its ``rv`` and ``rng`` as ``hour_rv``, ``hour_rng``), ``offsets``
    (100 centred quantiles or null), ``kind``, ``slot``, ``seas_abs``, ``seas_rel``, ``ofi``, and of ``NUMBERS`` what there is; absent ones
    count as listed there. A row without a quote, or whose price, shift or width is no number, gets a wide ladder about its
    price (about 1 without one). A row's own work: nothing is shuffled.
    """
    d = widths(model_inputs(rows, root=float(np.sqrt(10.0))), s)
    d = d.withColumns({"imb": F.col("in_imb"), "clock": (F.col("kind") == "time").cast("double")})
    number = lambda n, default: F.coalesce(F.col(n).cast("double"), F.lit(default)).alias(n) if n in d.columns else F.lit(default).alias(n)
    known = (F.col("price") > 0) & (F.col("price") < float("inf"))
    price = F.when(known, F.col("price").cast("double")).otherwise(1.0)
    good = F.coalesce("quoted", F.lit(False)) & known & (F.abs("mu") < float("inf")) & (F.col("sigma") > 0) & (F.col("sigma") < float("inf"))
    picked = d.select(*keys, price.alias("price"), F.coalesce(good, F.lit(False)).alias("good"), *[number(n, 0.0) for n in ("mu", "sigma")], *[number(n, v) for n, v in NUMBERS.items()], "offsets", "bins")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = batch.column("good").to_numpy(zero_copy_only=False).astype(bool)
            c = {n: batch.column(n).to_numpy(zero_copy_only=False).astype(float)[good] for n in ("price", "mu", "sigma", *NUMBERS)}
            price = batch.column("price").to_numpy(zero_copy_only=False)
            q = L.sanitized_rows(price[:, None] * (1 + s.fallback * _Z))
            if good.any():
                offsets, bins = ([x[good] for x in _lists(batch, n, w)] for n, w in (("offsets", L.N), ("bins", BINS)))
                q[good] = ladder_rows(c, tuple(offsets), tuple(bins), s)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * L.N, pa.int32()), pa.array(q.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], flat], [*keys, "q"])

    schema = ", ".join(f"`{k}` {picked.schema[k].dataType.simpleString()}" for k in keys)
    return picked.mapInArrow(run, f"{schema}, q array<double>")


def preferred_hours(hours: DataFrame, keys: list[str], *, least: int = 40) -> DataFrame:
    """Of each prompt's hours by ``venue`` the spot's; the futures' where only those have ``least`` closes."""
    enough = F.col("n_closes") >= least
    rank = F.when(enough, F.when(F.col("venue") == "spot", 3).otherwise(2)).otherwise((F.col("venue") == "spot").cast("int"))
    columns = [c for c in hours.columns if c not in keys]
    return hours.groupBy(*keys).agg(F.max_by(F.struct(*columns), rank).alias("h")).select(*keys, "h.*")


def with_parts(features: DataFrame, parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """``features`` with the columns of each part, null where it has no row."""
    for part in parts:
        features = features.join(part, keys, "left")
    return features


def season_columns(prompts: DataFrame, season: DataFrame, at: str) -> DataFrame:
    """``slot, seas_abs, seas_rel`` of each prompt; a season table has at most 1,008 rows."""
    return prompts.withColumn("slot", Q.season_slot(at)).join(F.broadcast(season.select("slot", "seas_abs", "seas_rel")), "slot", "left")
