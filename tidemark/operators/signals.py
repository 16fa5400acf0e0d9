"""Signals beside the feature table: 87 names per prompt, in long form."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import quotes as Q
from tidemark.operators import flow
from tidemark.operators.asof import asof_join, chunked, without_halo
from tidemark.operators.windows import Rows, sliced, window_stats

PROMPT, AT = ["asset", "current_time_ms"], "current_time_ms"
#: Windows of the signals, in the names' own units.
BASIS_S, CHANGE_MS, FLOW_MS, QUOTES_MS, RANGE_S, LIQ_S = (5, 15, 30, 60), (250, 500, 1000, 2000, 5000), (500, 2000, 10_000), (1000, 5000, 10_000, 60_000), (10, 60), (10, 60, 600)
MOVE_BARS, RANGE_BARS, FUTURES_BARS, LEVELS = (60, 300, 900, 3600), (10, 60, 300), (60, 300), (1, 3, 10, 20)


def _both(rows: DataFrame) -> DataFrame:
    """One row per prompt from one per venue: columns with ``s_`` and ``f_`` before them."""
    names = [c for c in rows.columns if c not in (*PROMPT, "venue")]
    pick = lambda v, c: F.max(F.when(F.col("venue") == v, F.col(c)))
    return rows.groupBy(*PROMPT).agg(*[pick(v, c).alias(f"{p}_{c}") for v, p in (("spot", "s"), ("futures", "f")) for c in names])


def _venues(made: Callable[[Rows, np.ndarray], dict[str, np.ndarray]], reach_ms: int) -> Callable[[Rows, np.ndarray], dict[str, np.ndarray]]:
    """A measure of both venues' rows from one of a venue's: ``s_`` and ``f_`` before its names, no numbers where a venue has no row in reach."""

    def measure(rows: Rows, at: np.ndarray) -> dict[str, np.ndarray]:
        out, there = {}, np.zeros(len(at), bool)
        for p, futures in (("s", 0), ("f", 1)):
            own = rows.part(rows["futures"] == futures)
            lo, hi = own.window(at, reach_ms)
            there |= hi > lo
            if len(own):
                out |= {f"{p}_{n}": np.where(hi > lo, v, np.nan) for n, v in made(own, at).items()}
        return out | {"there": there} if out else {}

    return measure


def _both(rows: DataFrame) -> DataFrame:
    """One row per prompt from one per venue: columns with ``s_`` and ``f_`` before them."""
    names = [c for c in rows.columns if c not in (*PROMPT, "venue")]
    pick = lambda v, c: F.max(F.when(F.col("venue") == v, F.col(c)))
    return rows.groupBy(*PROMPT).agg(*[pick(v, c).alias(f"{p}_{c}") for v, p in (("spot", "s"), ("futures", "f")) for c in names])


def quote_measure(unit: int, grid_ms: int, least: int) -> tuple[Callable, str]:
    """Last mid and microprice, mids so long ago (the window's first tick, where it is younger), counts and ranges of
    the mid, per venue; and ``bdev``: basis now less its mean on a grid of ``grid_ms`` back from the prompt, from where both venues
    have a tick in the window. Prompts need ``least`` quotes of both."""
    reach = 60_000 * unit

    def of_venue(rows: Rows, at: np.ndarray) -> dict[str, np.ndarray]:
        lo, hi = rows.window(at, reach)
        some = hi > lo
        high, low = rows.extremes(rows["mid"], np.fmax), rows.extremes(rows["mid"], np.fmin)
        out = {"mid": rows.pick("mid", hi - 1, some), "micro": rows.pick("micro", hi - 1, some), "n": hi - lo, "first": rows.pick("recv_ts_ms", lo, some)}
        for w in CHANGE_MS:
            out[f"mid{w}"] = rows.pick("mid", np.maximum(lo, rows.upto(at - w * unit) - 1), some)
        for w in QUOTES_MS:
            out[f"nbt{w}"] = hi - np.maximum(lo, rows.upto(at - w * unit))
        for w in RANGE_S:
            since = np.maximum(lo, rows.upto(at - w * 1000 * unit))
            out[f"brng{w}"] = np.nan_to_num(high(since, hi) - low(since, hi))
        return out

    both, names = _venues(of_venue, reach), ("mid", "micro", *[f"mid{w}" for w in CHANGE_MS], *[f"nbt{w}" for w in QUOTES_MS], *[f"brng{w}" for w in RANGE_S])

    def measure(rows: Rows, at: np.ndarray) -> dict[str, np.ndarray]:
        out = both(rows, at)
        if "s_n" not in out or "f_n" not in out:
            return {}
        there = (out.pop("s_n") >= least) & (out.pop("f_n") >= least)
        first = np.maximum(out.pop("s_first"), out.pop("f_first"))
        spot, futures = (rows.part(rows["futures"] == k) for k in (0, 1))
        back, means = np.arange(reach // grid_ms) * grid_ms, np.full((len(BASIS_S), len(at)), np.nan)
        for part in sliced(len(at), len(back)):
            grid = at[part][:, None] - back
            s, f = (v.upto(grid.ravel()).reshape(grid.shape) - 1 for v in (spot, futures))
            basis = futures["mid"][np.maximum(f, 0)] - spot["mid"][np.maximum(s, 0)]
            known = grid >= first[part][:, None]
            for i, w in enumerate(BASIS_S):
                mine = known & (back < w * 1000 * unit)
                n = mine.sum(1)
                means[i, part] = np.divide(np.where(mine, basis, 0.0).sum(1), n, out=np.full(len(n), np.nan), where=n > 0)
        now = out["f_mid"] - out["s_mid"]
        return out | {f"bdev{w}": now - means[i] for i, w in enumerate(BASIS_S)} | {"there": there}

    return measure, ", ".join(f"{c} double" for c in (*[f"{p}_{n}" for p in "sf" for n in names], *[f"bdev{w}" for w in BASIS_S]))


def trade_measure(unit: int) -> tuple[Callable, str]:
    """Last trade, and flow, volume, count and VWAP of the last milliseconds, per venue."""
    reach = 60_000 * unit

    def of_venue(rows: Rows, at: np.ndarray) -> dict[str, np.ndarray]:
        lo, hi = rows.window(at, reach)
        some = hi > lo
        signed, qty, paid = rows.sums(rows["signed"]), rows.sums(rows["qty"]), rows.sums(rows["price"] * rows["qty"])
        out = {"lastpx": rows.pick("price", hi - 1, some), "last_side": np.where(rows.pick("maker", hi - 1, some) > 0, -1.0, 1.0), "last_age": at - rows.pick("recv_ts_ms", hi - 1, some)}
        for w in FLOW_MS:
            since = rows.upto(at - w * unit)
            out |= {f"flow{w}": signed(since, hi), f"vol{w}": qty(since, hi), f"n{w}": hi - since}
        vol = out["vol10000"]
        return out | {"vwap10": np.divide(paid(rows.upto(at - 10_000 * unit), hi), vol, out=np.full(len(at), np.nan), where=vol > 0)}

    names = ("lastpx", "last_side", "last_age", "vwap10", *[f"{n}{w}" for w in FLOW_MS for n in ("flow", "vol", "n")])
    return _venues(of_venue, reach), ", ".join(f"{p}_{n} double" for p in "sf" for n in names)


def depth_signals(prompts: DataFrame, depth: DataFrame, *, notional: float, chunk_ms: int) -> DataFrame:
    """Imbalance of the best levels, span of what is visible, and the book's gap for a notional, of the last snapshot per venue."""
    size = lambda side, n: F.aggregate(F.slice(side, 1, n), F.lit(0.0), lambda s, x: s + x["qty"])
    dimb = [((size("bids", n) - size("asks", n)) / F.greatest(size("bids", n) + size("asks", n), F.lit(1e-12))).alias(f"dimb{n}") for n in LEVELS]
    span = F.element_at("asks", -1)["price"] - F.element_at("bids", -1)["price"]
    small = flow.walked_book(depth.filter("size(bids) > 0 and size(asks) > 0"), notional=notional).select("asset", "venue", "seq", "recv_ts_ms", *dimb, span.alias("dspan"), F.col("gap").alias("dthin"))
    last = asof_join(_asked(prompts), small, keys=["asset", "venue"], left_ts=AT, right_ts="recv_ts_ms", seq="seq", chunk_ms=chunk_ms)
    return _both(last.select(*PROMPT, "venue", *[F.col("last")[c].alias(c) for c in (*[f"dimb{n}" for n in LEVELS], "dspan", "dthin")]))


def _asked(prompts: DataFrame) -> DataFrame:
    return prompts.select(*PROMPT, F.explode(F.array(F.lit("spot"), F.lit("futures"))).alias("venue"))


def candle_signals(prompts: DataFrame, candles: DataFrame, *, bar_ms: int, bars: float, least: int, chunk_ms: int) -> DataFrame:
    """Mean move over ten bars and mean range of the last bars that ended by each prompt; ``bars`` scales the names' counts."""
    n = lambda w: max(1, round(w * bars))
    longest = n(MOVE_BARS[-1]) + 10
    dealt = chunked(candles.select("asset", "venue", "open_time_ms", "high", "low", "close"), keys=["asset", "venue"], ts="open_time_ms", seq="open_time_ms", chunk_ms=max(chunk_ms, longest * bar_ms), halo_ms=longest * bar_ms)
    w = Window.partitionBy("asset", "venue", "__chunk").orderBy("open_time_ms")
    dealt = dealt.withColumn("move", F.abs(F.col("close") - F.lag("close", 10).over(w))).withColumn("range", F.col("high") - F.col("low"))
    over = lambda c, k: F.avg(c).over(w.rowsBetween(-(n(k) - 1), 0))
    rows = without_halo(dealt.withColumn("nth", F.count(F.lit(1)).over(w.rowsBetween(-(least - 1), 0))).withColumns({f"mad{k}": over("move", k) for k in MOVE_BARS} | {f"rng{k}": over("range", k) for k in RANGE_BARS}))
    rows = rows.filter(F.col("nth") >= least).withColumn("end_ms", F.col("open_time_ms") + bar_ms)
    names = [*[f"mad{k}" for k in MOVE_BARS], *[f"rng{k}" for k in RANGE_BARS]]
    last = asof_join(_asked(prompts), rows.select("asset", "venue", "end_ms", *names), keys=["asset", "venue"], left_ts=AT, right_ts="end_ms", seq="end_ms", chunk_ms=chunk_ms)
    both = _both(last.select(*PROMPT, "venue", *[F.col("last")[n].alias(n) for n in names]))
    return both.select(*PROMPT, *[F.col(f"s_{n}").alias(f"c_{n}") for n in names], *[F.col(f"f_mad{k}").alias(f"fc_mad{k}") for k in FUTURES_BARS])


def build_signals(prompts: DataFrame, *, quotes: DataFrame, trades: DataFrame, depth: DataFrame, candles: DataFrame, liquidations: DataFrame, unit: int = 1, grid_ms: int = 100, notional: float = 25_000.0, bar_ms: int = 1000, bars: float = 1.0, least_bars: int = 120, chunk_ms: int = 3_600_000) -> DataFrame:
    """One row per prompt and its 87 signals; null where a stream has nothing to say.

    Prompts need five quotes of both venues in the window. Each stream meets its prompts once, by
    ``window_stats`` or as of, and gives a row per prompt; ``unit`` stretches all windows in time.
    """
    p = prompts.select(*PROMPT, *[c for c in ("venue",) if c in prompts.columns])
    at, futures = prompts.select(*PROMPT), (F.col("venue") == "futures").cast("int").alias("futures")
    ticks = quotes.filter("venue in ('spot', 'futures')").select("asset", "seq", "recv_ts_ms", futures, Q.mid().alias("mid"), Q.microprice(or_mid=True).alias("micro"))
    dealt = trades.filter("venue in ('spot', 'futures')").select("asset", "seq", "recv_ts_ms", futures, "price", "qty", flow.signed_qty().alias("signed"), F.col("buyer_is_maker").cast("int").alias("maker"))
    made = lambda rows, measure, gives: window_stats(at, rows, keys=["asset"], at=AT, ts="recv_ts_ms", seq="seq", reach_ms=60_000 * unit, measure=measure, gives=gives)
    book = made(ticks, *quote_measure(unit, grid_ms, 5))
    liq = flow.liquidation_sums(at, liquidations, keys=["asset"], at=AT, spans={str(w): w * 1000 * unit for w in LIQ_S})
    parts = [made(dealt, *trade_measure(unit)), depth_signals(at, depth, notional=notional, chunk_ms=chunk_ms), candle_signals(at, candles, bar_ms=bar_ms, bars=bars, least=least_bars, chunk_ms=chunk_ms), liq]
    j = p.withColumnRenamed("venue", "__venue") if "venue" in p.columns else p.withColumn("__venue", F.lit(None).cast("string"))
    j = j.join(book, PROMPT)
    for part in parts:
        j = j.join(part, PROMPT, "left")
    change = lambda v, w: F.col(f"{v}_mid") - F.col(f"{v}_mid{w}")
    out: list[Column] = [F.when(F.col("__venue") == "futures", 1.0).otherwise(0.0).alias("venue_fut"), *[F.col(f"bdev{w}") for w in BASIS_S]]
    for w in CHANGE_MS:
        out += [change("f", w).alias(f"fchg{w}"), change("s", w).alias(f"schg{w}"), (change("f", w) - change("s", w)).alias(f"lead{w}")]
    for v in "sf":
        micro = F.col(f"{v}_micro")
        out += [(micro - F.col(f"{v}_mid")).alias(f"{v}_micro_mid"), (F.col(f"{v}_lastpx") - micro).alias(f"{v}_lastpx_vs_micro"), F.col(f"{v}_last_side"), F.col(f"{v}_last_age"), (F.col(f"{v}_vwap10") - micro).alias(f"{v}_vwap10_vs_micro")]
        out += [F.col(f"{v}_{n}{w}") for w in FLOW_MS for n in ("flow", "vol", "n")]
        out += [F.col(f"{v}_{c}") for c in (*[f"dimb{n}" for n in LEVELS], "dspan", "dthin", *[f"nbt{w}" for w in QUOTES_MS], *[f"brng{w}" for w in RANGE_S])]
    out += [F.col(f"c_mad{k}") for k in MOVE_BARS] + [F.col(f"c_rng{k}") for k in RANGE_BARS] + [F.col(f"fc_mad{k}") for k in FUTURES_BARS]
    out += [F.coalesce(f"liq_{c}{w}", F.lit(0.0)).alias(f"liq_{c}{w}") for w in LIQ_S for c in ("signed", "n")]
    return j.select(*PROMPT, *out)


def long_form(wide: DataFrame) -> DataFrame:
    """``asset, current_time_ms, signal, value``; absent signals are left out."""
    names = [c for c in wide.columns if c not in PROMPT]
    pairs = F.array(*[F.struct(F.lit(c).alias("signal"), F.col(c).cast("double").alias("value")) for c in names])
    return wide.select(*PROMPT, F.inline(pairs)).filter("value is not null")
