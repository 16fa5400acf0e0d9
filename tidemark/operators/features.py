"""The feature table: one row per prompt from its trailing windows."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import quotes as Q
from tidemark.operators import candles as C
from tidemark.operators import flow, windows
from tidemark.operators.asof import asof_join, chunked, without_halo
from tidemark.operators.windows import Rows, window_stats

PROMPT = ["asset", "current_time_ms"]
AT = "current_time_ms"


def book_measure(window_ms: int, lags: dict[str, int], vol_ms: int, least: int) -> tuple[Callable, str]:
    """Last quote's measures, momentum against ticks at least so old, volatility and range.

    Times count back from the last tick in the window, not from the prompt.
    """
    names, vol = ("micro", "mid", "spread", "imb"), windows.book_volatility(window_ms, vol_ms, least)[0]

    def measure(rows: Rows, at: np.ndarray) -> dict[str, np.ndarray]:
        lo, hi = rows.window(at, window_ms)
        some = hi > lo
        out = {n: rows.pick(n, hi - 1, some) for n in names}
        newest = rows.ts[np.maximum(hi - 1, 0)]
        for n, ms in lags.items():
            old = rows.upto(newest - ms) - 1
            before = rows.pick("micro", old, some & (old >= lo))
            known = (before > 0) & (out["micro"] > 0)
            out[n] = np.log(np.divide(out["micro"], before, out=np.ones(len(at)), where=known))
        found = vol(rows, at)
        enough = found.get("there", np.zeros(len(at), bool))
        return out | {"recv_ts_ms": newest, "there": some} | {n: np.where(enough, found[n], np.nan) if found else np.full(len(at), np.nan) for n in ("rv", "rng")}

    return measure, ", ".join(f"{n} double" for n in (*names, *lags, "rv", "rng")) + ", recv_ts_ms long"


def book_features(prompts: DataFrame, quotes: DataFrame, *, window_ms: int, lags: dict[str, int], vol_ms: int, least: int = 6) -> DataFrame:
    """``book_measure`` per prompt and venue with a quote in the window."""
    rows = quotes.select("asset", "venue", "seq", "recv_ts_ms", Q.microprice(or_mid=True).alias("micro"), Q.mid().alias("mid"), Q.spread().alias("spread"), Q.imbalance().alias("imb"))
    measure, gives = book_measure(window_ms, lags, vol_ms, least)
    return window_stats(per_venue(prompts), rows, keys=["asset", "venue"], at=AT, ts="recv_ts_ms", seq="seq", reach_ms=window_ms, measure=measure, gives=gives)


def per_venue(prompts: DataFrame) -> DataFrame:
    """Each prompt once for spot and once for futures."""
    return prompts.select(*PROMPT, F.explode(F.array(F.lit("spot"), F.lit("futures"))).alias("venue"))


def by_venue(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per prompt: ``s_`` and ``f_`` columns of spot and futures."""
    pick = lambda v, c: F.max(F.when(F.col("venue") == v, F.col(c)))
    return rows.groupBy(*PROMPT).agg(*[pick(v, c).alias(f"{p}_{c}") for v, p in (("spot", "s"), ("futures", "f")) for c in columns])


def half(a: Column, b: Column) -> Column:
    return 0.5 * (F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0)))


def _joined(prompts: DataFrame, *, trades: DataFrame, quotes: DataFrame, liquidations: DataFrame, depth: DataFrame, window_ms: int, flow_ms: int, last_n: int, lags: dict[str, int], vol_ms: int, liq_recent_ms: int, liq_unit: float, liq_long_unit: float, least: int = 6) -> DataFrame:
    """A row per prompt of what its windows hold, by venue; null where they hold nothing."""
    book = by_venue(book_features(prompts, quotes, window_ms=window_ms, lags=lags, vol_ms=vol_ms, least=least), ["micro", "mid", "spread", "imb", "recv_ts_ms", *lags, "rv", "rng"])
    asked = per_venue(prompts)
    flows = by_venue(flow.trade_flow(asked, trades, keys=["asset", "venue"], at=AT, reach_ms=window_ms, last_n=last_n, window_ms=flow_ms), ["flow", "flow_fast", "flow_window", "qty_window"])
    liq = flow.liquidation_signals(prompts, liquidations, keys=["asset"], at=AT, reach_ms=window_ms, recent_ms=liq_recent_ms, unit=liq_unit, long_unit=liq_long_unit)
    d = flow.depth_imbalance(depth).select("asset", "venue", "seq", "recv_ts_ms", "obi", "top_obi", depth_mid().alias("depth_mid"))
    deep = asof_join(asked, d, keys=["asset", "venue"], left_ts=AT, right_ts="recv_ts_ms", seq="seq", chunk_ms=4 * window_ms, max_age_ms=window_ms - 1)
    deep = by_venue(deep.select(*PROMPT, "venue", *[F.col("last")[c].alias(c) for c in ("obi", "top_obi", "depth_mid")]), ["obi", "top_obi", "depth_mid"])
    j = prompts.select(*PROMPT)
    for part in (book, flows, liq.drop("n"), deep):
        j = j.join(part, PROMPT, "left")
    return j


def _selected(j: DataFrame, price: Column, lags: dict[str, int], more: dict[str, Column] | None = None) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0)).alias(c)
    j = j.withColumn("__price", price)
    price = F.col("__price")
    venues = [f"{p}_{c}" for p in "sf" for c in ("imb", *lags, "rv", "rng", "flow_window", "qty_window")]
    basis = F.when((F.col("s_micro") > 0) & F.col("f_micro").isNotNull(), (F.col("f_micro") - F.col("s_micro")) / F.col("s_micro")).otherwise(0.0)
    stale = F.greatest(F.col(AT) - F.col("s_recv_ts_ms"), F.col(AT) - F.col("f_recv_ts_ms"))
    return j.select(
        *PROMPT, price.alias("price"), F.coalesce("s_mid", price).alias("mid"), half(F.col("s_obi"), F.col("f_obi")).alias("obi"), half(F.col("s_top_obi"), F.col("f_top_obi")).alias("top_obi"),
        half(F.col("s_flow"), F.col("f_flow")).alias("flow"), half(F.col("s_flow_fast"), F.col("f_flow_fast")).alias("flow_fast"), *[zero(c) for c in venues], basis.alias("basis"),
        F.coalesce(F.col("s_spread") / price, F.lit(0.0)).alias("spread_rel"), F.coalesce(stale, F.lit(0)).alias("stale_ms"),
        F.coalesce("direction", F.lit(0.0)).alias("liq_dir"), F.coalesce("activity", F.lit(0.0)).alias("liq_hour"), F.coalesce("s_micro", "s_mid", "f_micro", "f_mid").isNotNull().alias("quoted"),
        *[c.alias(n) for n, c in (more or {}).items()],
    )


def build_features(prompts: DataFrame, *, lags: dict[str, int], **sources) -> DataFrame:
    """Features of each prompt; what its windows lack is 0, but for the price, which is 1; ``quoted`` says if it is a quote's.

    Each stream is joined to its prompts once, reduced to a row per prompt, and only those rows
    are joined with each other. ``sources`` are the tables and windows of ``_joined``.
    """
    return _selected(_joined(prompts, lags=lags, **sources), F.coalesce("s_micro", "s_mid", "f_micro", "f_mid", F.lit(1.0)), lags)


def depth_mid() -> Column:
    """Mid of a snapshot's best levels, or the one side there is; null without either."""
    best = lambda side: F.when(F.get(side, 0)["price"] > 0, F.get(side, 0)["price"])
    return F.coalesce(0.5 * (best("bids") + best("asks")), best("bids"), best("asks"))


def reference_price(candidates: list[Column], close: Column, *, most: float = 2.0) -> Column:
    """The first positive, finite candidate within a factor ``most`` of the close; else the close; else 1.

    Without a positive close every positive, finite candidate will do.
    """
    ref = F.when((close > 0) & (close < float("inf")), close)
    fits = lambda p: F.when((p > 0) & (p < float("inf")) & F.coalesce(F.abs(F.ln(p / ref)) <= math.log(most), F.lit(True)), p)
    return F.coalesce(*[fits(p) for p in candidates], ref, F.lit(1.0))


def blended_vol(spot: Column, futures: Column, futures_complete: Column, *, share: float = 0.6) -> Column:
    """``share`` of the spot's volatility and the rest of the futures'; spot stands in for futures whose history isn't complete or that shows none."""
    f = F.when(futures_complete, futures).otherwise(spot)
    return F.when(f > 0, share * spot + (1 - share) * f).otherwise(spot)


def candle_tails(prompts: DataFrame, candles: DataFrame, *, bar_ms: int, history: int, steps: dict[str, int], slow: tuple[int, float], fast: tuple[int, float], chunk_bars: int, chunk_ms: int) -> DataFrame:
    """Per prompt and venue of full candles: last close, log changes by ``steps``, EWMA volatilities, whether the history is complete.

    A bar counts from its end on. ``slow`` and ``fast`` are (bars, decay); weights are by age at
    the prompt. Changes come from the bars' own table and each prompt takes its last bar's.
    """
    first = candles.groupBy("asset", "venue").agg(F.min("open_time_ms").alias("first_ms"))
    m = C.moves(candles.select("asset", "venue", "open_time_ms", "close"), keys=["asset", "venue"], steps=steps | {"__1": 1}, bar_ms=bar_ms, chunk_bars=chunk_bars)
    m = m.withColumn("end_ms", F.col("open_time_ms") + bar_ms).select("asset", "venue", "end_ms", "close", *[f"r_{n}" for n in steps], F.col("r___1").alias("ret"))
    asked = per_venue(prompts)
    last = asof_join(asked, m, keys=["asset", "venue"], left_ts=AT, right_ts="end_ms", seq="end_ms", chunk_ms=chunk_ms).filter("last is not null")
    last = last.select(*PROMPT, "venue", "last.end_ms", "last.close", *[F.col(f"last.r_{n}").alias(n) for n in steps]).join(first, ["asset", "venue"])
    last = last.withColumn("complete", F.col("end_ms") - F.col("first_ms") >= history * bar_ms).drop("end_ms", "first_ms")
    returns = m.filter("ret is not null").select("asset", "venue", "end_ms", "ret")
    measure, gives = windows.recent_average((slow[0], bar_ms), {"vol": slow, "vol_fast": fast})
    vols = window_stats(asked, returns, keys=["asset", "venue"], at=AT, ts="end_ms", seq="end_ms", reach_ms=slow[0] * bar_ms, measure=measure, gives=gives)
    return last.join(vols, [*PROMPT, "venue"], "left")


def complete_features(prompts: DataFrame, *, candles: DataFrame, lags: dict[str, int], bar_ms: int, history: int, slow: tuple[int, float], fast: tuple[int, float], horizon_bars: int, band_width: float, band_reach: float, band_age_ms: int, chunk_bars: int, chunk_ms: int, **sources) -> DataFrame:
    """All 36 features (with lags ``m1, m3, m5``) and ``quoted``: those of ``build_features``, with the price by ``reference_price``,
    and what candles, depth bands and the last spot trade add.

    ``s_last_trade`` and ``band_imb`` are 0 without a trade in the window, or a spot snapshot
    younger than ``band_age_ms``; bands lie round their own snapshot's mid and are read round the
    present one.
    """
    window_ms, trades, depth = sources["window_ms"], sources["trades"], sources["depth"]
    j = _joined(prompts, lags=lags, **sources)
    asked = per_venue(prompts)
    last = asof_join(asked, trades.select("asset", "venue", "seq", "recv_ts_ms", "price"), keys=["asset", "venue"], left_ts=AT, right_ts="recv_ts_ms", seq="seq", chunk_ms=chunk_ms, max_age_ms=window_ms - 1)
    j = j.join(by_venue(last.select(*PROMPT, "venue", F.col("last.price").alias("trade")), ["trade"]), PROMPT, "left")
    tails = candle_tails(prompts, candles, bar_ms=bar_ms, history=history, steps={"c1": 1, "c3": 3, "mom": horizon_bars}, slow=slow, fast=fast, chunk_bars=chunk_bars, chunk_ms=chunk_ms)
    j = j.join(by_venue(tails, ["close", "c1", "c3", "mom", "vol", "vol_fast", "complete"]), PROMPT, "left")
    names = ("s_micro", "s_mid", "f_micro", "f_mid", "s_depth_mid", "f_depth_mid", "s_close", "f_close", "s_trade", "f_trade")
    price = reference_price([F.col(n) for n in names], F.coalesce("s_close", "f_close"))
    snap = asof_join(j.select(*PROMPT, F.coalesce("s_mid", price).alias("mid")), depth.filter("venue = 'spot'").select("asset", "seq", "recv_ts_ms", "bids", "asks"), keys=["asset"], left_ts=AT, right_ts="recv_ts_ms", seq="seq", chunk_ms=chunk_ms, max_age_ms=band_age_ms)
    snap = snap.filter("last is not null").select(*PROMPT, "mid", "last.bids", "last.asks").withColumn("anchor", depth_mid())
    bands = flow.band_imbalance(flow.depth_bands(snap, id_cols=[*PROMPT, "anchor", "mid"], width=band_width), id_cols=PROMPT, width=band_width, reach=band_reach)
    j = j.join(bands, PROMPT, "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    whole = F.coalesce("f_complete", F.lit(False))
    more = {
        "vol_1s": blended_vol(none("s_vol"), none("f_vol"), whole), "vol_fast": none("s_vol_fast"), "momentum": half(F.col("s_mom"), F.when(whole, F.col("f_mom")).otherwise(F.col("s_mom"))), "c1": none("s_c1"), "c3": none("s_c3"),
        "spot_complete": F.coalesce("s_complete", F.lit(False)).cast("double"), "fut_complete": whole.cast("double"), "band_imb": none("band_imb"), "s_last_trade": none("s_trade"),
    }
    return _selected(j, price, lags, more)


def _held(candles: DataFrame, *, span: int, within: float, shares: dict[str, int], bar_ms: int) -> DataFrame:
    """Per asset and bar of the spot candles, the share of the last rolling windows of ``span`` closes that stay within a range."""
    halo = (max(shares.values()) + span) * bar_ms
    dealt = chunked(candles.filter("venue = 'spot'").select("asset", "open_time_ms", "close"), keys=["asset"], ts="open_time_ms", seq="open_time_ms", chunk_ms=4 * halo, halo_ms=halo)
    w = Window.partitionBy("asset", "__chunk").orderBy("open_time_ms")
    frame = w.rowsBetween(-(span - 1), 0)
    full = F.count(F.lit(1)).over(frame) == span
    dealt = dealt.withColumn("held", F.when(full, (F.max("close").over(frame) - F.min("close").over(frame) <= within).cast("double")))
    return without_halo(dealt.withColumns({n: F.avg("held").over(w.rowsBetween(-(k - 1), 0)) for n, k in shares.items()})).select("asset", (F.col("open_time_ms") + bar_ms).alias("end_ms"), *shares)


def still_features(prompts: DataFrame, *, quotes: DataFrame, trades: DataFrame, candles: DataFrame, season: DataFrame, step_ms: int = 100, steps: int = 599, span: int = 100, recent: int = 100, flow_ms: int = 10_000, within: float = 0.004, hold: float = 0.011, hold_bars: dict[str, int], hold_span: int = 11, bar_ms: int = 1000, spread_scale: float = 100.0, chunk_ms: int = 3_600_000) -> DataFrame:
    """Stillness of each prompt that stands on the grid of ``step_ms`` and has quotes for a span: 13 columns.

    ``p0book`` share of spans of the grid in which the spot mid held; ``pois60`` exp(-changes / 6);
    ``nchg10, fchg10, fchg60`` log of 1 + changes, ``age`` log of 1 + seconds since the last one (all
    of the window without one); ``minq`` and ``q_flow`` the touch's size alone and against flow;
    ``spread`` scaled to at most 1; ``p0range30m, p0range5m`` (named by ``hold_bars``) shares of
    windows of closes that held; ``seas`` log of the slot's move; ``m0`` the ladder's mass at the
    price, 0 before there is a ladder.
    """
    span_of = prompts.groupBy("asset").agg(F.min(AT).alias("lo"), F.max(AT).alias("hi"))
    points = span_of.select("asset", F.explode(F.sequence(F.col("lo") - (steps + span) * step_ms, F.col("hi"), F.lit(step_ms).cast("long"))).alias(AT))

    def on_grid(venue: str) -> DataFrame:
        q = quotes.filter(F.col("venue") == venue).select("asset", "seq", "recv_ts_ms", Q.mid().alias("mid"), "bid_qty", "ask_qty", Q.spread().alias("spread"))
        g = asof_join(points, q, keys=["asset"], left_ts=AT, right_ts="recv_ts_ms", seq="seq", chunk_ms=chunk_ms).filter("last is not null").select("asset", AT, "last.*")
        return flow.mid_change_counts(g, keys=["asset"], value="mid", ts=AT, step_ms=step_ms, steps=steps, span=span, within=within, recent=recent)

    s, f = on_grid("spot"), on_grid("futures").select("asset", AT, F.col("changes").alias("f60"), F.col("recent").alias("f10"))
    sides = flow.side_flow(prompts.select(*PROMPT), trades.filter("venue = 'spot'"), keys=["asset"], at=AT, reach_ms=flow_ms, window_ms=flow_ms)
    j = prompts.select(*PROMPT).join(s.filter("still_share is not null"), PROMPT).join(f, PROMPT, "left").join(sides, PROMPT, "left")
    j = asof_join(j, _held(candles, span=hold_span, within=hold, shares=hold_bars, bar_ms=bar_ms), keys=["asset"], left_ts=AT, right_ts="end_ms", seq="end_ms", chunk_ms=chunk_ms, name="held")
    j = j.withColumn("slot", Q.season_slot(AT)).join(F.broadcast(season.select("slot", "seas_abs")), "slot", "left")  # at most 1,008 rows
    none = lambda c: F.coalesce(c, F.lit(0.0))
    bought, sold = none(F.col("bought")), none(F.col("sold"))
    age = F.least(F.coalesce(F.col("since") + step_ms, F.lit(steps * step_ms)), F.lit(steps * step_ms)) / 1000
    ratio = F.least(F.ln((F.col("bid_qty") + 0.001) / (sold + 0.05)), F.ln((F.col("ask_qty") + 0.001) / (bought + 0.05)))
    return j.select(
        *PROMPT, F.col("still_share").alias("p0book"), F.exp(-F.col("changes") / 6).alias("pois60"), F.log1p("recent").alias("nchg10"), F.log1p(age).alias("age"), F.log1p(F.greatest(F.least("bid_qty", "ask_qty"), F.lit(0.0))).alias("minq"), ratio.alias("q_flow"),
        Q.clip(F.col("spread") * spread_scale, 0.0, 1.0).alias("spread"), F.log1p(none(F.col("f10"))).alias("fchg10"), F.log1p(none(F.col("f60"))).alias("fchg60"), *[none(F.col("held")[n]).alias(n) for n in hold_bars],
        F.when(F.col("seas_abs") > 0, F.ln("seas_abs")).otherwise(0.0).alias("seas"), F.lit(0.0).alias("m0"),
    )
