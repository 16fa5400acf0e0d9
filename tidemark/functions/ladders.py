"""Forecast ladders: 100 ordered prices per prompt, as array columns."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

N = 100
#: Probability levels of a ladder: (2i - 1) / 200.
GRID = [(2 * i - 1) / (2 * N) for i in range(1, N + 1)]
FLOOR, STEP = 1e-8, 1e-12


def laplace_z(n: int = N) -> list[float]:
    """Quantiles of the Laplace distribution with mean absolute deviation 1 on the centred grid."""
    levels = [(2 * i - 1) / (2 * n) for i in range(1, n + 1)]
    return [math.copysign(-math.log(1 - 2 * abs(t - 0.5)), t - 0.5) for t in levels]


def mixture_z(share: float = 0.15, ratio: float = 3.0, n: int = N) -> list[float]:
    """Quantiles of (1 - share) Laplace(1) + share Laplace(ratio) on the centred grid, all levels halved at once.

    The lower half is found between where the wider part alone would put it and 0, the upper half is its mirror.
    """
    levels = (2 * np.arange(1, n // 2 + 1) - 1) / (2 * n)
    low, high = np.full(n // 2, ratio * math.log(2 / (2 * n))), np.zeros(n // 2)
    for _ in range(80):
        mid = 0.5 * (low + high)
        below = 0.5 * ((1 - share) * np.exp(mid) + share * np.exp(mid / ratio)) < levels
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    half = 0.5 * (low + high)
    return [*half.tolist(), *(-half[::-1]).tolist()]


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for the row, not for every price."""
    return F.get(F.transform(F.array(value), body), 0)


def ladder(price: Column, shift: Column, width: Column, z: list[float]) -> Column:
    """price + shift + width * z."""
    pair = F.struct((price + shift).alias("at"), width.alias("w"))
    return let(pair, lambda p: F.transform(F.array(*[F.lit(float(v)) for v in z]), lambda v: p["at"] + p["w"] * v))


def median(q: Column) -> Column:
    return let(q, lambda q: 0.5 * (F.get(q, N // 2 - 1) + F.get(q, N // 2)))


def width(q: Column) -> Column:
    """Mean distance from the median."""
    return let(q, lambda q: let(median(q), lambda m: F.aggregate(q, F.lit(0.0), lambda s, v: s + F.abs(v - m)) / N))


def violations(q: Column) -> Column:
    """Codes of what is wrong with a ladder, in order; empty for a good one, ``missing`` for null."""
    finite = F.forall(q, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    falls = F.exists(F.zip_with(F.slice(q, 2, N), F.slice(q, 1, N - 1), lambda b, a: b < a), lambda x: x)
    rules = F.array(F.when(F.size(q) != N, "length"), F.when(~finite, "not_finite"), F.when(F.exists(q, lambda v: v <= 0), "not_positive"), F.when((F.size(q) == N) & finite & falls, "decreasing"))
    return F.when(q.isNull(), F.array(F.lit("missing"))).otherwise(F.array_compact(rules))


def pinball_crps(q: Column, realized: Column) -> Column:
    """Twice the mean pinball loss over the grid."""
    grid = F.array(*[F.lit(t) for t in GRID])
    loss = F.zip_with(q, grid, lambda x, t: (realized - x) * (t - F.when(realized < x, 1.0).otherwise(0.0)))
    return F.aggregate(loss, F.lit(0.0), lambda s, v: s + v) * (2.0 / N)


def widened(q: Column, factor: Column, anchor: Column | None = None, band: float = 0.0) -> Column:
    """med + factor * (q - med); prices within ``band`` of the anchor stay; ordered by size."""
    keep = (lambda v: F.abs(v - anchor) <= band) if anchor is not None else (lambda v: F.lit(False))
    return let(q, lambda q: let(median(q), lambda m: F.array_sort(F.transform(q, lambda v: F.when(keep(v), v).otherwise(m + factor * (v - m))))))


def live_factor(w: Column, recent: Column, *, power: float, least: float, most: float, narrowest: float) -> Column:
    """How much a ladder's width ``w`` is to change towards that of recent moves' quantiles: 1 for a
    ladder too narrow to judge, without recent moves, or within a ten-thousandth of right."""
    factor = F.least(F.greatest(F.pow(recent / w, F.lit(power)), F.lit(least)), F.lit(most))
    usable = recent.isNotNull() & (recent > 0) & (w >= narrowest)
    return F.when(usable & (F.abs(factor - 1) >= 1e-4), factor).otherwise(1.0)


def trade_anchored(q: Column, anchor: Column, last_trade: Column, *, share: float, band: float) -> Column:
    """Prices farther than ``band`` from the anchor move by a share of the last trade's gap to it; in order again."""
    gap = F.when(last_trade > 0, share * (last_trade - anchor)).otherwise(0.0)
    return let(F.struct(gap.alias("d"), anchor.alias("a")), lambda g: F.array_sort(F.transform(q, lambda v: F.when(F.abs(v - g["a"]) > band, v + g["d"]).otherwise(v))))


def layered(q: Column, price: Column, shift: Column, scale: Column, *, tick: float) -> Column:
    """Scales and shifts a ladder about the price; prices within half a tick of it stay; in order again."""
    by = F.struct(price.alias("p"), shift.alias("d"), scale.alias("s"))
    return let(by, lambda b: F.array_sort(F.transform(q, lambda v: F.when(F.abs(v - b["p"]) > 0.5 * tick, b["p"] + b["s"] * (v - b["p"]) + b["d"]).otherwise(v))))


def shifted(q: Column, by: Column) -> Column:
    return let(by, lambda d: F.transform(q, lambda v: v + d))


def tent() -> list[float]:
    """1 at the quartiles, falling in straight lines to 0 at the median and at 10 and 90 percent, 0 beyond.

    The eleven levels at each end and the two at the middle don't move at all.
    """
    out = []
    for i, t in enumerate(GRID):
        d = abs(t - 0.5)
        still = i < 11 or i >= N - 11 or i in (N // 2 - 1, N // 2)
        out.append(0.0 if still else d / 0.25 if d <= 0.25 else (0.4 - d) / 0.15)
    return out


def centre_widened(q: Column, spread: float = 0.08) -> Column:
    """Moves the quartiles out by ``spread`` of their distance from the median, others between by the tent; never falling."""
    shape = F.array(*[F.lit(v) for v in tent()])
    at = lambda q, i: 0.5 * (F.get(q, i - 1) + F.get(q, i))
    quarters = lambda q: F.struct((at(q, N // 2) - at(q, N // 4)).alias("down"), (at(q, 3 * N // 4) - at(q, N // 2)).alias("up"))
    side = F.sequence(F.lit(0), F.lit(N - 1))
    moved = lambda q, g: F.zip_with(q, F.zip_with(shape, side, lambda w, i: F.when(i < N // 2, -spread * w * g["down"]).otherwise(spread * w * g["up"])), lambda v, d: v + d)
    return let(q, lambda q: let(quarters(q), lambda g: rising(moved(q, g))))


def rising(q: Column) -> Column:
    """The running maximum of a ladder above the floor."""
    first = F.struct(F.array().cast("array<double>").alias("done"), F.lit(FLOOR).alias("top"))

    def step(s: Column, v: Column) -> Column:
        return F.struct(F.concat(s["done"], F.array(F.greatest(s["top"], v))).alias("done"), F.greatest(s["top"], v).alias("top"))

    return F.aggregate(q, first, step, lambda s: s["done"])


def blended(a: Column, b: Column, weight: Column) -> Column:
    return let(weight, lambda w: F.zip_with(a, b, lambda x, y: (1 - w) * x + w * y))


def blend_weight(relative: Column, *, slope: float, pivot: float, cap: float) -> Column:
    return F.least(F.greatest(slope * F.greatest(pivot - relative, F.lit(0.0)), F.lit(0.0)), F.lit(cap))


def mirrored(bins: Column, price: Column, drift: Column) -> Column:
    """Levels of absolute log returns mirrored about the price, tilted by the drift, as prices."""
    mean = F.aggregate(bins, F.lit(0.0), lambda s, v: s + v) / F.size(bins)
    tilt = F.when(mean > 0, F.least(F.greatest(drift / mean, F.lit(-1.0)), F.lit(1.0))).otherwise(0.0)

    def prices(t: Column) -> Column:
        down = F.transform(F.reverse(bins), lambda v: -v * (1 - t))
        return F.transform(F.concat(down, F.transform(bins, lambda v: v * (1 + t))), lambda r: price * F.exp(r))

    return let(tilt, prices)


def _rows(q: pd.Series) -> np.ndarray:
    return np.array([np.full(N, np.nan) if v is None or len(v) != N else np.asarray(v, float) for v in q]).reshape(-1, N)


def sanitized_rows(x: np.ndarray) -> np.ndarray:
    """``sanitized`` of ladders, a row each."""
    x = np.nan_to_num(x, nan=FLOOR, posinf=1e16, neginf=FLOOR)
    x = np.maximum.accumulate(np.maximum(x, FLOOR), axis=1)
    flat = np.diff(x, axis=1) <= 0
    x[:, 1:] += np.cumsum(np.where(flat, STEP, 0.0), axis=1)
    return x


def sanitized(q: Column) -> Column:
    """Ladders above a floor, never falling, ties apart by tiny steps; not-finite values scrubbed."""

    @F.pandas_udf("array<double>")
    def sanitize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for q in batches:
            yield pd.Series(list(sanitized_rows(_rows(q))))

    return sanitize(q)


def mixed_rows(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``mixed`` of ladders, a row each."""
    both = np.concatenate([x, y], axis=1)
    order = np.argsort(both, axis=1, kind="stable")
    mass = np.concatenate([np.repeat((1 - w)[:, None] / N, N, 1), np.repeat(w[:, None] / N, N, 1)], axis=1)
    values, total = np.take_along_axis(both, order, 1), np.cumsum(np.take_along_axis(mass, order, 1), axis=1)
    # The first place whose mass reaches each level: rows are set apart by whole numbers and searched as one.
    rows, levels = np.arange(len(total))[:, None], np.array(GRID)
    at = np.searchsorted((total / total[:, -1:] * 0.999 + rows).ravel(), ((levels - 1e-12) * 0.999 + rows).ravel()).reshape(len(total), N) - rows * 2 * N
    return np.take_along_axis(values, np.minimum(at, 2 * N - 1), 1)


def mixed(a: Column, b: Column, weight: Column) -> Column:
    """Quantiles of the mixture of two ladders, each price of either an atom of equal mass."""

    @F.pandas_udf("array<double>")
    def mix(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b, w in batches:
            yield pd.Series(list(mixed_rows(_rows(a), _rows(b), w.to_numpy(float))))

    return mix(a, b, weight)


def with_point_mass(q: Column, price: Column, mass: Column) -> Column:
    """The ladder with ``mass`` moved to ``price``: quantiles of the mixture, the atom kept whole."""

    @F.pandas_udf("array<double>")
    def put(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        levels = np.array(GRID)[None, :]
        for q, price, mass in batches:
            x, p = _rows(q), price.to_numpy(float)[:, None]
            m = mass.to_numpy(float)[:, None]
            use = ((m > 0) & (m < 1))[:, 0]
            m = np.where(use[:, None], m, 0.5)
            below = (x < p).sum(1, keepdims=True) / N * (1 - m)
            first, last = levels < below, levels > below + m
            # Positions on the ladder's own levels, between neighbours, as far out as its ends.
            t = np.where(first, levels / (1 - m), (levels - m) / (1 - m))
            at = np.clip(t * N - 0.5, 0, N - 1)
            low = np.minimum(at.astype(int), N - 2)
            a, b = np.take_along_axis(x, low, 1), np.take_along_axis(x, low + 1, 1)
            moved = a + (at - low) * (b - a)
            out = np.where(first, np.minimum(moved, p), np.where(last, np.maximum(moved, p), p))
            yield pd.Series(list(np.where(use[:, None], out, x)))

    return put(q, price, mass)


def quantile_rows(x: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Each ladder's prices at levels of its own, straight between its grid's, its ends beyond."""
    at = np.clip(level * N - 0.5, 0, N - 1)
    low = np.minimum(at.astype(int), N - 2)
    part = at - low
    return np.take_along_axis(x, low, 1) * (1 - part) + np.take_along_axis(x, low + 1, 1) * part


def still_rows(x: np.ndarray, price: np.ndarray, mass: np.ndarray, width: np.ndarray, *, widen: float, shift: float, hole: float) -> np.ndarray:
    """Quantiles of ``mass`` at the price and the rest on a reshaped ladder, a row each; as ``still_mixed`` says."""
    p, px = mass[:, None], price[:, None]
    keep = 1 - p
    middle = 0.5 * (x[:, N // 2 - 1 : N // 2] + x[:, N // 2 : N // 2 + 1])
    off = shift * p / keep * (middle - px)
    r = x + off
    r = r + widen * p * (r - (middle + off))
    h = np.maximum(hole * width, 0)[:, None]
    away = np.abs(r - px)
    with np.errstate(divide="ignore", invalid="ignore"):
        pushed = px + np.sign(r - px) * (away + h * (1 - np.exp(-away / h)))
    r = np.where(h > 0, pushed, r)
    k = (r < px).sum(1)
    inside = (k > 0) & (k < N)
    below, above = (np.take_along_axis(r, np.clip(i, 0, N - 1)[:, None], 1)[:, 0] for i in (k - 1, k))
    part = np.divide(price - below, above - below, out=np.zeros(len(k)), where=inside & (above > below))
    left = np.where(inside, (2 * k - 1) / (2 * N) + np.clip(part, 0, 1) / N, np.where(k > 0, 1.0, 0.0))
    levels, first = np.array(GRID)[None, :], keep[:, 0] * left
    low = quantile_rows(r, levels / keep)
    high = quantile_rows(r, (levels - p) / keep)
    out = np.where(levels < first[:, None], low, np.where(levels <= (first + mass)[:, None], px, high))
    return np.maximum.accumulate(out, axis=1)


def still_mixed(q: Column, price: Column, mass: Column, width: Column, *, widen: float, shift: float, hole: float) -> Column:
    """The ladder of a price that stays with probability ``mass``: a point at the price, and the rest reshaped.

    The rest is moved off the price by ``shift`` * mass / (1 - mass) of the median's own distance, so that
    the mean survives the point; widened about its median by 1 + ``widen`` * mass; and pushed out of a hole of about
    ``hole`` * ``width`` round the price. Quantiles are the mixture's, inverted in straight lines, never falling. A
    mass of 0 or below, 1 or above, or none leaves the ladder as it is.
    """

    @F.pandas_udf("array<double>")
    def mix(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, price, mass, width in batches:
            x, m = _rows(q), mass.to_numpy(float)
            use = (m > 0) & (m < 1)
            out = still_rows(x, price.to_numpy(float), np.where(use, m, 0.5), width.to_numpy(float), widen=widen, shift=shift, hole=hole)
            yield pd.Series(list(np.where(use[:, None], out, x)))

    return mix(q, price, mass, width)


def empirical(price: Column, offsets: Column) -> Column:
    """The price and centred quantiles of recent moves beside it, above the floor and never falling; null without offsets."""
    return F.when(offsets.isNotNull(), rising(F.transform(offsets, lambda v: price + v)))
