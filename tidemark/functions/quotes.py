"""Column expressions over quotes, prices and clocks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def microprice(bid="bid_price", bid_qty="bid_qty", ask="ask_price", ask_qty="ask_qty", *, or_mid: bool = False) -> Column:
    """Each side's price weighted by the other's size; null (or the mid) without size."""
    b, bq, a, aq = map(col, (bid, bid_qty, ask, ask_qty))
    total = bq + aq
    return F.when(total > 0, (b * aq + a * bq) / total).otherwise(0.5 * (b + a) if or_mid else F.lit(None))


def valid_quote(bid="bid_price", bid_qty="bid_qty", ask="ask_price", ask_qty="ask_qty") -> Column:
    """Finite, prices above zero, sizes not below, some size; false where anything is null."""
    b, bq, a, aq = map(col, (bid, bid_qty, ask, ask_qty))
    finite = [~F.isnan(c) & (F.abs(c) < float("inf")) for c in (b, bq, a, aq)]
    rule = finite[0] & finite[1] & finite[2] & finite[3] & (b > 0) & (a > 0) & (bq >= 0) & (aq >= 0) & (bq + aq > 0)
    return F.coalesce(rule, F.lit(False))


def mid(bid="bid_price", ask="ask_price") -> Column:
    return F.when((col(bid) <= 0) & (col(ask) <= 0), 0.0).otherwise(0.5 * (col(bid) + col(ask)))


def spread(bid="bid_price", ask="ask_price") -> Column:
    return F.when((col(bid) <= 0) & (col(ask) <= 0), 0.0).otherwise(F.greatest(col(ask) - col(bid), F.lit(0.0)))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, 0 where the whole isn't above 0 or is null."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def imbalance(bid_qty="bid_qty", ask_qty="ask_qty") -> Column:
    return ratio(col(bid_qty) - col(ask_qty), col(bid_qty) + col(ask_qty))


def moved(price, before, tick, *, slack: float = 1e-6) -> Column:
    """More than one tick from ``before``."""
    return F.abs(col(price) - col(before)) / col(tick) > 1 + slack


def price_scale(asset, price, *, reference: str = "BTC", reference_price: float = 85_000.0) -> Column:
    p = col(price)
    usable = (p > 0) & (p < float("inf")) & (col(asset) != reference)
    return F.when(usable, p / reference_price).otherwise(1.0)


def staleness_ms(now, times: Column) -> Column:
    """Age of the latest of a map's times, at least 0; 0 without any."""
    return F.greatest(F.lit(0).cast("long"), col(now) - F.coalesce(F.array_max(F.map_values(times)), col(now)))


def clip(x: Column, lo, hi) -> Column:
    return F.when(x < lo, F.lit(lo)).when(x > hi, F.lit(hi)).otherwise(x)


def robust_z(value: Column, centre: Column, scale: Column, *, kind: str = "robust", width: Column | None = None) -> Column:
    """(v - c) / d within 6 either way, over 3, and 0 where the value isn't finite.

    ``kind`` says what v is: the value (``robust``), log(1 + value) above 0 (``log1p``), or the log of the value over
    the ladder's ``width`` (``log_width``); ``raw`` is the value itself without centre and scale.
    """
    if kind == "raw":
        return F.when(F.abs(value) < float("inf"), value).otherwise(0.0)
    v = F.when(F.abs(value) < float("inf"), value)
    if kind == "log1p":
        v = F.log1p(F.greatest(F.coalesce(v, F.lit(0.0)), F.lit(0.0)))
    elif kind == "log_width":
        v = F.when((width > 0) & v.isNotNull(), F.ln(F.greatest(v, F.lit(1e-12)) / width))
    z = clip((v - centre) / F.when(scale != 0, scale), -6.0, 6.0) / 3
    return F.when(z.isNull() | F.isnan(z), 0.0).otherwise(z)


def logistic(bias, values: list[Column], weights: list[float]) -> Column:
    """Logistic function of a weighted sum, saturated at 30 either way."""
    total = F.lit(float(bias))
    for v, w in zip(values, weights, strict=True):
        total = total + v * F.lit(float(w))
    return 1 / (1 + F.exp(-clip(total, -30.0, 30.0)))


def log_blend(bias: float, values: list[Column], weights: list[float], floor: float) -> Column:
    total = F.lit(float(bias))
    for v, w in zip(values, weights, strict=True):
        total = total + F.lit(float(w)) * F.ln(F.greatest(v, F.lit(float(floor))))
    return F.exp(total)


def to_ms(ts) -> Column:
    """Microseconds (10^15 and above) as milliseconds."""
    return F.when(col(ts) >= 10**15, F.floor(col(ts) / 1000)).otherwise(col(ts)).cast("long")


def ms_to_utc(ms) -> Column:
    """ISO text with milliseconds; needs a session in UTC."""
    return F.date_format(F.timestamp_millis(col(ms)), "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")


def next_slot(ms, *, clock: int, offset=0) -> Column:
    """The next instant on the clock, now included."""
    o = col(offset) if isinstance(offset, str) else F.lit(offset)
    return (col(ms) + F.pmod(o - col(ms), F.lit(clock))).cast("long")


def event_slot(ms, *, clock: int, opens: int, length: int, offset=0) -> Column:
    """The slot whose event window, from ``opens`` for ``length`` ms, holds ``ms``; else null."""
    o = col(offset) if isinstance(offset, str) else F.lit(offset)
    into = F.pmod(col(ms) - o, F.lit(clock))
    return F.when((into >= opens) & (into < opens + length), col(ms) - into).cast("long")


def season_slot(ms) -> Column:
    """Ten-minute slot of the UTC week from Monday, 0 to 1007."""
    return (F.pmod(F.floor(col(ms) / 600_000) - 4 * 144, F.lit(1008))).cast("int")


def hash_unit(*parts: Column) -> Column:
    """A number from 0 to 1 that depends on the parts alone."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def event_coin(*key: Column, chance: float = 0.5) -> Column:
    return hash_unit(F.lit("coin"), *key) < chance


def event_delay_ms(*key: Column, longest: int = 500) -> Column:
    """No delay for half of the moves, an even spread up to ``longest`` for the others."""
    u = hash_unit(F.lit("delay"), *key)
    return F.when(u < 0.5, 0).otherwise(F.floor((u - 0.5) * 2 * longest)).cast("long")


def tick_size(info, fallback) -> Column:
    """Tick of the price filter in exchange information (JSON), else the fallback."""
    parsed = F.from_json(col(info), "filters array<struct<filterType:string,tickSize:string>>")
    price = F.filter(parsed["filters"], lambda f: f["filterType"] == "PRICE_FILTER")
    size = F.get(price, 0)["tickSize"].try_cast("double")
    return F.coalesce(F.when(size > 0, size), col(fallback))
