"""Queries over the given tables, by the blueprint's names.

The events table stands for ticks (see ``tidemark.sources.ticks``); its ticks are minutes
apart, so windows are given in hours.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import ladders as L
from tidemark.functions import quotes as Q
from tidemark.operators import candles as C
from tidemark.operators import chain, features, flow, forecast, payloads, prompts, scoring, signals, windows
from tidemark.operators.asof import asof_join, chunked, window_join, without_halo
from tidemark.operators.quantiles import exclusive_percentile, quantiles, robust_center_scale
from tidemark.sources import files
from tidemark.sources import messages as M
from tidemark.sources import ticks as T
from tidemark.plans import fixtures
from tidemark.scratch import fresh, written
from tidemark.streaming import jobs

HOUR, DAY = T.HOUR, 86_400_000
KEY = T.KEY
CHUNK = 6 * HOUR
REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    REGISTRY[f.__name__] = f
    return f


def r(c, places: int = 6):
    """Rounded for comparison; a zero has no sign."""
    return F.round(c, places) + F.lit(0.0)


def spot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.quotes(spark, sf_dir).filter("venue = 'spot'").drop("venue")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock prompts with their label quote and realised price, an hour ahead."""
    out = scoring.label_quotes(T.clock_prompts(spark, sf_dir), spot(spark, sf_dir), keys=["asset"], horizon_ms=HOUR, chunk_ms=CHUNK)
    return out.withColumn("realized", scoring.realized("label", "target_ms", live_ms=HOUR))


def priced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clock prompts with the spot microprice that stood at each."""
    at = asof_join(T.clock_prompts(spark, sf_dir), spot(spark, sf_dir), keys=["asset"], left_ts="current_time_ms", right_ts="recv_ts_ms", seq="seq", chunk_ms=CHUNK)
    return at.select("asset", "current_time_ms", Q.microprice(*[F.col("last")[c] for c in ("bid_price", "bid_qty", "ask_price", "ask_qty")], or_mid=True).alias("price")).filter("price is not null")


def models(spark: SparkSession) -> DataFrame:
    return spark.range(8).select(F.concat(F.lit("m"), "id").alias("model"), F.col("id").alias("model_no"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight flat-width models' ladders for each priced prompt, an eleventh left out."""
    m = F.array(*[F.lit(i) for i in range(8)])
    p = priced(spark, sf_dir).withColumn("model_no", F.explode(m)).withColumn("model", F.concat(F.lit("m"), "model_no"))
    no = F.col("current_time_ms") / HOUR + F.col("model_no")
    q = L.ladder(F.col("price"), (F.col("model_no") - 3) * 0.05, 0.2 + 0.1 * F.col("model_no"), L.laplace_z())
    return p.filter(no % 11 != 0).select("asset", "current_time_ms", "model", q.alias("q"))


def all_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = priced(spark, sf_dir).select("asset", "current_time_ms")
    return scoring.scored(scoring.prompt_model_grid(p, models(spark), answers(spark, sf_dir)), labelled(spark, sf_dir))


def trade_window(spark: SparkSession, sf_dir: str, hours: int = 6) -> DataFrame:
    return window_join(T.clock_prompts(spark, sf_dir), T.trades(spark, sf_dir), keys=["asset"], at="current_time_ms", ts="recv_ts_ms", window_ms=hours * HOUR)


def venue_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.per_venue(T.clock_prompts(spark, sf_dir))


def latest_trades(spark: SparkSession, sf_dir: str, hours: int = 6) -> DataFrame:
    """Clock prompts and venues with the last trade of the hours before."""
    t = T.trades(spark, sf_dir)
    last = asof_join(venue_prompts(spark, sf_dir), t, keys=KEY, left_ts="current_time_ms", right_ts="recv_ts_ms", seq="seq", chunk_ms=CHUNK, max_age_ms=hours * HOUR - 1)
    return last.filter("last is not null")


def hour_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.candles_from_trades(T.trades(spark, sf_dir), keys=KEY, bar_ms=HOUR)


def full_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.gap_filled(hour_candles(spark, sf_dir), keys=KEY, bar_ms=HOUR, bars_a_chunk=48)


def moved(spark: SparkSession, sf_dir: str, **steps: int) -> DataFrame:
    return C.moves(full_candles(spark, sf_dir), keys=KEY, steps=steps or {"10": 10}, bar_ms=HOUR, chunk_bars=48)


@query
def p1_quote_measures(spark, sf_dir):
    q = T.quotes(spark, sf_dir)
    return q.select(*KEY, "seq", r(Q.microprice()).alias("micro"), r(Q.mid()).alias("mid"), r(Q.spread()).alias("spread"), r(Q.imbalance()).alias("imbalance"), Q.valid_quote().alias("valid"))


@query
def p9_complete_history(spark, sf_dir):
    return C.complete_history(hour_candles(spark, sf_dir), keys=KEY, bars=600, bar_ms=HOUR)


@query
def p11_price_scale(spark, sf_dir):
    return T.trades(spark, sf_dir).select(*KEY, "seq", r(Q.price_scale("asset", "price", reference="click", reference_price=101.0)).alias("scale"))


@query
def p12_moved_trades(spark, sf_dir):
    t = chunked(T.trades(spark, sf_dir).select(*KEY, "seq", "recv_ts_ms", "price"), keys=KEY, ts="recv_ts_ms", seq="seq", chunk_ms=DAY, carry=True)
    t = without_halo(t.withColumn("before", F.lag("price").over(Window.partitionBy(*KEY, "__chunk").orderBy("recv_ts_ms", "seq"))))
    return t.filter("before is not null").select(*KEY, "seq", Q.moved("price", "before", F.lit(0.5)).alias("moved"))


@query
def p14_staleness(spark, sf_dir):
    last = latest_trades(spark, sf_dir).select("asset", "current_time_ms", "venue", F.col("last.recv_ts_ms").alias("t"))
    m = last.groupBy("asset", "current_time_ms").agg(F.map_from_entries(F.collect_list(F.struct("venue", "t"))).alias("times"))
    return m.select("asset", "current_time_ms", Q.staleness_ms("current_time_ms", F.col("times")).alias("stale_ms"), F.size("times").alias("n_streams"))


@query
def p16_last_trade_gap(spark, sf_dir):
    t = T.trades(spark, sf_dir).filter("venue = 'spot'").select("asset", "seq", "recv_ts_ms", "price", "buyer_is_maker")
    at = asof_join(priced(spark, sf_dir), t, keys=["asset"], left_ts="current_time_ms", right_ts="recv_ts_ms", seq="seq", chunk_ms=CHUNK)
    return at.select("asset", "current_time_ms", r(F.col("last.price") - F.col("price")).alias("gap"), F.when(F.col("last.buyer_is_maker"), -1).otherwise(1).alias("side"), (F.col("current_time_ms") - F.col("last.recv_ts_ms")).alias("age_ms"))


@query
def j1_asof_quotes(spark, sf_dir):
    t = T.trades(spark, sf_dir).filter("venue = 'futures'").select("asset", F.col("seq").alias("trade"), F.col("recv_ts_ms").alias("at_ms"))
    at = asof_join(t, spot(spark, sf_dir), keys=["asset"], left_ts="at_ms", right_ts="recv_ts_ms", seq="seq", chunk_ms=CHUNK, max_age_ms=4 * HOUR)
    return at.select("asset", "trade", F.col("last.seq").alias("quote"), r(F.col("last.bid_price")).alias("bid_price"))


@query
def j2_label_quotes(spark, sf_dir):
    return labelled(spark, sf_dir).select("asset", "current_time_ms", "target_ms", F.col("label.seq").alias("quote"), F.col("label.recv_ts_ms").alias("recv_ts_ms"), r("realized").alias("realized"))


@query
def j4_prompt_windows(spark, sf_dir):
    return trade_window(spark, sf_dir).select("asset", "current_time_ms", "venue", "seq")


@query
def j5_depth_pairs(spark, sf_dir):
    d = fixtures.depth(spark, sf_dir).filter("venue = 'spot'").select("asset", "seq", "recv_ts_ms", "update_id")
    w = window_join(T.clock_prompts(spark, sf_dir), d, keys=["asset"], at="current_time_ms", ts="recv_ts_ms", window_ms=12 * HOUR)
    return flow.depth_pairs(w, keys=["asset"], at="current_time_ms", back_ms=6 * HOUR, tolerance_ms=HOUR)


@query
def j6_horizon_pairs(spark, sf_dir):
    q = spot(spark, sf_dir).withColumn("micro", Q.microprice(or_mid=True)).select("asset", "seq", "recv_ts_ms", "micro")
    start = q.select("asset", F.col("seq").alias("start"), F.col("recv_ts_ms").alias("at_ms"), F.col("micro").alias("micro_0"), (F.col("recv_ts_ms") + 3 * HOUR).alias("until_ms"))
    ends = asof_join(start, q, keys=["asset"], left_ts="until_ms", right_ts="recv_ts_ms", seq="seq", chunk_ms=CHUNK)
    good = ends.filter((F.col("last.recv_ts_ms") - F.col("at_ms") >= 2 * HOUR))
    return good.select("asset", "start", F.col("last.seq").alias("end"), r(F.col("last.micro") - F.col("micro_0")).alias("move"))


def window_moves(spark, sf_dir, prompts: DataFrame | None = None) -> DataFrame:
    """Moves over three hours within the two days before each prompt, from sixteen starts at most."""
    levels = [float(x) for x in L.GRID]
    return flow.horizon_pairs(
        T.clock_prompts(spark, sf_dir) if prompts is None else prompts, spot(spark, sf_dir), keys=["asset"], at="current_time_ms", reach_ms=48 * HOUR, horizon_ms=3 * HOUR, gap_ms=2 * HOUR, most=16, least_ticks=20, least_pairs=8, levels=levels,
    )


@query
def j6_window_pairs(spark, sf_dir):
    return window_moves(spark, sf_dir).select("asset", "current_time_ms", "n_ticks", "n_pairs", r("total").alias("total"))


@query
def a14_window_offsets(spark, sf_dir):
    return window_moves(spark, sf_dir).select("asset", "current_time_ms", F.posexplode("q").alias("i", "v")).select("asset", "current_time_ms", "i", r("v", 9).alias("offset"))


@query
def j7_basis_grid(spark, sf_dir):
    out = T.clock_prompts(spark, sf_dir)
    for venue in ("spot", "futures"):
        q = T.quotes(spark, sf_dir).filter(F.col("venue") == venue).drop("venue").withColumn("mid", Q.mid()).select("asset", "seq", "recv_ts_ms", "mid")
        out = asof_join(out, q, keys=["asset"], left_ts="current_time_ms", right_ts="recv_ts_ms", seq="seq", chunk_ms=CHUNK, name=venue)
    return out.select("asset", "current_time_ms", r(F.col("futures.mid") - F.col("spot.mid")).alias("basis"))


@query
def j8_season_lookup(spark, sf_dir):
    s = C.season(moved(spark, sf_dir), move="d_10", slot=Q.season_slot("open_time_ms"))
    p = T.clock_prompts(spark, sf_dir).withColumn("slot", Q.season_slot("current_time_ms"))
    return p.join(F.broadcast(s), "slot", "left").select("asset", "current_time_ms", "slot", r("seas_abs").alias("seas_abs"))


@query
def j9_prompt_model_grid(spark, sf_dir):
    p = priced(spark, sf_dir).select("asset", "current_time_ms")
    g = scoring.prompt_model_grid(p, models(spark), answers(spark, sf_dir))
    return g.select("asset", "current_time_ms", "model", F.col("q").isNotNull().alias("answered"))


@query
def j10_eligible_models(spark, sf_dir):
    s = all_scores(spark, sf_dir).filter((F.col("model") != "m7") | (F.col("asset") != "click") | ~F.col("answered"))
    return scoring.eligible(s).groupBy("asset", "model").agg(F.count(F.lit(1)).alias("n"))


@query
def j11_missing_prompts(spark, sf_dir):
    return prompts.missing(T.clock_prompts(spark, sf_dir), priced(spark, sf_dir).filter(F.col("current_time_ms") / HOUR % 3 == 0), keys=["asset", "current_time_ms"])


@query
def j12_near_identical_models(spark, sf_dir):
    return scoring.near_identical_models(answers(spark, sf_dir), most=0.6).withColumn("distance", r("distance"))


@query
def a1_candles(spark, sf_dir):
    return hour_candles(spark, sf_dir).select(*KEY, "open_time_ms", *[r(c).alias(c) for c in ("open", "high", "low", "close", "volume")])


@query
def a2_upsert_candles(spark, sf_dir):
    t = T.trades(spark, sf_dir).select(*KEY, F.col("ts_ms").alias("open_time_ms"), "seq", "price", "qty")
    return C.upsert(t, keys=[*KEY, "open_time_ms"], seq="seq")


@query
def a3_trade_flow(spark, sf_dir):
    f = flow.trade_flow(venue_prompts(spark, sf_dir), T.trades(spark, sf_dir), keys=KEY, at="current_time_ms", reach_ms=6 * HOUR, last_n=5, window_ms=2 * HOUR)
    return f.select("asset", "venue", "current_time_ms", *[r(c).alias(c) for c in ("flow", "flow_fast", "flow_window", "qty_window")])


@query
def a4_side_flow(spark, sf_dir):
    return flow.side_flow(venue_prompts(spark, sf_dir), T.trades(spark, sf_dir), keys=KEY, at="current_time_ms", reach_ms=6 * HOUR, window_ms=2 * HOUR).select("asset", "venue", "current_time_ms", "bought", "sold")


@query
def a5_depth_imbalance(spark, sf_dir):
    return flow.depth_imbalance(fixtures.depth(spark, sf_dir)).select(*KEY, "seq", r("obi").alias("obi"), r("top_obi").alias("top_obi"))


@query
def a6_liquidation_signals(spark, sf_dir):
    s = flow.liquidation_signals(T.clock_prompts(spark, sf_dir), T.liquidations(spark, sf_dir), keys=["asset"], at="current_time_ms", reach_ms=6 * HOUR, recent_ms=HOUR, unit=10.0, long_unit=100.0)
    return s.select("asset", "current_time_ms", r("direction").alias("direction"), r("activity").alias("activity"), "n")


@query
def a7_depth_bands(spark, sf_dir):
    return flow.depth_bands(fixtures.depth(spark, sf_dir), id_cols=[*KEY, "seq"], width=0.05).groupBy(*KEY, "side", "band").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"))


@query
def a9_ewma_vol(spark, sf_dir):
    m = C.aged(moved(spark, sf_dir, one=1).filter("r_one is not null"), keys=KEY, ts="open_time_ms", newest=120)
    out = m.groupBy(*KEY).agg(F.sqrt(C.ewma(F.pow("r_one", F.lit(2)), F.col("age"), 0.94)).alias("vol_slow"), F.sqrt(C.ewma(F.when(F.col("age") < 90, F.pow("r_one", F.lit(2))), F.col("age"), 0.85)).alias("vol_fast"))
    return out.select(*KEY, r("vol_slow", 9).alias("vol_slow"), r("vol_fast", 9).alias("vol_fast"))


@query
def a10_book_volatility(spark, sf_dir):
    b = flow.book_volatility(venue_prompts(spark, sf_dir), T.quotes(spark, sf_dir), keys=KEY, at="current_time_ms", reach_ms=6 * HOUR, window_ms=5 * HOUR)
    return b.select("asset", "venue", "current_time_ms", "n", r("rv").alias("rv"), r("rng").alias("rng"))


@query
def a10_thinned_volatility(spark, sf_dir):
    b = flow.book_volatility(venue_prompts(spark, sf_dir), T.quotes(spark, sf_dir), keys=KEY, at="current_time_ms", reach_ms=48 * HOUR, window_ms=40 * HOUR, most=16)
    return b.select("asset", "venue", "current_time_ms", "n", r("rv").alias("rv"), r("rng").alias("rng"))


@query
def a12_hour_stats(spark, sf_dir):
    s = C.hour_stats(moved(spark, sf_dir), keys=KEY, move="d_10")
    return s.select(*KEY, "n", r("median").alias("median"), r("mad").alias("mad"), r("jump_ratio").alias("jump_ratio"))


@query
def a14_quantile_offsets(spark, sf_dir):
    m = moved(spark, sf_dir).filter("d_10 is not null")
    q = quantiles(m, by=KEY, value="d_10", levels=[0.5, *map(float, L.GRID)])
    return q.select(*KEY, F.get("q", F.lit(0)).alias("median"), F.posexplode(F.slice("q", 2, L.N)).alias("i", "v")).select(*KEY, "i", r(F.col("v") - F.col("median")).alias("offset"))


@query
def a16_activity_ratio(spark, sf_dir):
    m = C.aged(moved(spark, sf_dir).filter("r_10 is not null"), keys=KEY, ts="open_time_ms", newest=480)
    slow, fast = F.avg(F.abs("r_10")), F.avg(F.when(F.col("age") < 60, F.abs("r_10")))
    return m.groupBy(*KEY).agg(r(F.ln((1e-6 + fast) / (1e-6 + slow))).alias("activity"))


@query
def a17_pinball_crps(spark, sf_dir):
    return all_scores(spark, sf_dir).select("asset", "current_time_ms", "model", "answered", r("crps").alias("crps"))


@query
def a18_field_scores(spark, sf_dir):
    return scoring.field_scores(all_scores(spark, sf_dir)).select("asset", "current_time_ms", "model", r("field_score").alias("field_score"))


@query
def run_summary(spark, sf_dir):
    s = scoring.run_summary(all_scores(spark, sf_dir), by=["asset", "model"])
    return s.select("asset", "model", "n", "n_scored", "n_dropped", *[r(f"crps_{c}").alias(f"crps_{c}") for c in ("mean", "median", "min", "max")], "first_ms", "last_ms")


@query
def a19_exclusive_p95(spark, sf_dir):
    p = exclusive_percentile(all_scores(spark, sf_dir), by=["asset", "model"], value="crps", p=0.95)
    return p.withColumn("percentile", r("percentile"))


@query
def a20_leaderboard(spark, sf_dir):
    b = scoring.leaderboard(scoring.field_scores(all_scores(spark, sf_dir)))
    return b.withColumn("score", r("score"))


@query
def a21_reward_split(spark, sf_dir):
    b = scoring.leaderboard(scoring.field_scores(all_scores(spark, sf_dir)))
    return scoring.reward_split(b, pool=1000.0, shares=(0.5, 0.3, 0.2)).select("asset", "model", "rank", r("reward").alias("reward"))


@query
def q7_rank_models(spark, sf_dir):
    b = scoring.rank_models(priced(spark, sf_dir), models(spark), answers(spark, sf_dir), labelled(spark, sf_dir), pool=1000.0, shares=(0.5, 0.3, 0.2))
    return b.select("asset", "model", r("score").alias("score"), "n_prompts", "rank", r("reward").alias("reward"))


@query
def a22_rolling_crps(spark, sf_dir):
    s = scoring.rolling_crps(all_scores(spark, sf_dir), by=["asset", "model"], window_ms=DAY, step_ms=6 * HOUR, least=10)
    return s.withColumn("crps_mean", r("crps_mean"))


@query
def a23_split_eval(spark, sf_dir):
    return scoring.split_eval(all_scores(spark, sf_dir), split_ms=1_705_363_200_000).withColumn("crps_mean", r("crps_mean"))


@query
def a24_season_table(spark, sf_dir):
    s = C.season(moved(spark, sf_dir), move="d_10", slot=Q.season_slot("open_time_ms"))
    return s.select("slot", "n", r("seas_abs").alias("seas_abs"), r("seas_rel").alias("seas_rel"))


@query
def a24_hour_autocorrelation(spark, sf_dir):
    a = C.hour_autocorrelation(moved(spark, sf_dir), keys=KEY, move="d_10", bar_ms=HOUR, chunk_bars=48)
    return a.select("hour", "n", r("lag1").alias("lag1"))


@query
def a25_trigger_rates(spark, sf_dir):
    """Prompts by kind an hour, from each asset's first prompt to its last."""
    p = q1_build_prompts(spark, sf_dir)
    span = p.groupBy("asset").agg(((F.max("current_time_ms") - F.min("current_time_ms")) / HOUR).alias("hours"))
    per = scoring.trigger_mix(p).join(span, "asset")  # a row an asset
    return per.select("asset", "kind", "n", r("share").alias("share"), r(F.when(F.col("hours") > 0, F.col("n") / F.col("hours"))).alias("an_hour"))


@query
def a25_trigger_mix(spark, sf_dir):
    return scoring.trigger_mix(q1_build_prompts(spark, sf_dir)).withColumn("share", r("share"))


@query
def a26_tick_counts(spark, sf_dir):
    t = flow.tick_counts(venue_prompts(spark, sf_dir), T.trades(spark, sf_dir), keys=KEY, at="current_time_ms", spans={"1h": HOUR, "6h": 6 * HOUR})
    return t.select("asset", "venue", "current_time_ms", *[r(c, 9).alias(c) if c[0] in "rv" else c for c in t.columns[3:]])


@query
def a31_robust_center_scale(spark, sf_dir):
    t = flow.tick_counts(venue_prompts(spark, sf_dir), T.trades(spark, sf_dir), keys=KEY, at="current_time_ms", spans={"6h": 6 * HOUR})
    long = t.select("venue", F.stack(F.lit(3), F.lit("n"), F.col("n_6h").cast("double"), F.lit("flow"), F.col("flow_6h"), F.lit("range"), F.col("range_6h")).alias("signal", "value"))
    return robust_center_scale(long, by=["venue", "signal"], value="value").select("venue", "signal", r("centre").alias("centre"), r("scale").alias("scale"))


@query
def w1_gap_fill(spark, sf_dir):
    return full_candles(spark, sf_dir).select(*KEY, "open_time_ms", r("close").alias("close"), r("volume").alias("volume"))


@query
def w2_lag_returns(spark, sf_dir):
    m = moved(spark, sf_dir, one=1, three=3, ten=10)
    return m.select(*KEY, "open_time_ms", *[r(f"{k}_{n}").alias(f"{k}_{n}") for k in "rd" for n in ("one", "three", "ten")])


@query
def w4_quote_ofi(spark, sf_dir):
    o = flow.quote_ofi(T.quotes(spark, sf_dir), keys=KEY)
    hour = (F.floor(F.col("recv_ts_ms") / DAY) * DAY).cast("long").alias("day_ms")
    return o.groupBy(*KEY, hour).agg(r(F.sum("ofi")).alias("net"), r(F.sum("gross")).alias("gross"), F.count(F.lit(1)).alias("n"))


@query
def w5_book_momentum(spark, sf_dir):
    m = flow.book_momentum(T.quotes(spark, sf_dir), keys=KEY, lookback_ms=12 * HOUR, lags={"m1": HOUR, "m3": 3 * HOUR})
    return m.select(*KEY, "seq", r("m1").alias("m1"), r("m3").alias("m3"))


@query
def w8_mid_changes(spark, sf_dir):
    g = j7_basis_grid(spark, sf_dir).filter("basis is not null")
    c = flow.mid_change_counts(g, keys=["asset"], value="basis", ts="current_time_ms", step_ms=HOUR, steps=10, span=5)
    return c.select("asset", "current_time_ms", "changed", "changes", "still", "since")


@query
def w9_range_hold(spark, sf_dir):
    return C.range_hold_share(full_candles(spark, sf_dir), keys=KEY, bars=11, within=4.0, bar_ms=HOUR, chunk_bars=48).withColumn("held", r("held"))


@query
def w10_ewma_abs_return(spark, sf_dir):
    m = C.aged(moved(spark, sf_dir).filter("r_10 is not null"), keys=KEY, ts="open_time_ms", newest=480)
    return m.groupBy(*KEY).agg(r(C.ewma(F.abs("r_10"), F.col("age"), 0.98), 9).alias("ewma_abs"))


@query
def w11_vol_blend_inputs(spark, sf_dir):
    m = C.aged(moved(spark, sf_dir, one=1), keys=KEY, ts="open_time_ms", newest=60)
    return m.groupBy(*KEY).agg(r(F.stddev_pop("r_one") * F.sqrt(F.lit(10.0)), 9).alias("rv"), r(F.ln(F.max(F.when(F.col("age") < 10, F.col("close"))) / F.min(F.when(F.col("age") < 10, F.col("close")))), 9).alias("range"))


@query
def w12_trade_groups(spark, sf_dir):
    return prompts.trade_groups(T.trades(spark, sf_dir), keys=KEY).select(*KEY, "ts_ms", r("price").alias("price"), "recv_ts_ms", "seq", "n")


def all_moves(spark, sf_dir):
    return prompts.price_moves(prompts.trade_groups(T.trades(spark, sf_dir), keys=KEY), keys=KEY, tick=0.5)


@query
def w13_price_moves(spark, sf_dir):
    return all_moves(spark, sf_dir).select(*KEY, "ts_ms", r("price").alias("price"), r("reference").alias("reference"), "recv_ts_ms")


@query
def w14_sequence_gaps(spark, sf_dir):
    u = T.ticks(spark, sf_dir).select("seq", F.col("seq").alias("final_id"), (F.col("seq") - 1 - (F.col("seq") % 3 == 0).cast("int")).alias("prev_final_id"))
    return prompts.sequence_gaps(u, keys=[], order="seq", first="final_id", before="prev_final_id", chunk=1000).select("seq", "expected", "prev_final_id")


@query
def w15_time_order(spark, sf_dir):
    t = T.trades(spark, sf_dir).select(*KEY, "seq", (F.col("recv_ts_ms") - F.col("seq") % 5 * 6_000_000).alias("at_ms"))
    return prompts.time_order_violations(t, keys=KEY, order="seq", ts="at_ms", chunk=1000).select(*KEY, "seq", "at_ms", "before_ms")


@query
def q1_build_prompts(spark, sf_dir):
    e = prompts.event_prompts(all_moves(spark, sf_dir), clock=HOUR, opens=600_000, length=2_400_000)
    return prompts.union_prompts(T.clock_prompts(spark, sf_dir), e)


@query
def q8_anchor_grid(spark, sf_dir):
    span = T.ticks(spark, sf_dir).agg(F.min("recv_ts_ms").alias("lo"), F.max("recv_ts_ms").alias("hi"))
    return span.select(F.explode(F.sequence("lo", F.col("hi") - 1, F.lit(6 * HOUR).cast("long"))).alias("anchor_ms"))


@query
def t2_last_closes(spark, sf_dir):
    a = C.aged(hour_candles(spark, sf_dir), keys=KEY, ts="open_time_ms", newest=24)
    return a.select(*KEY, "open_time_ms", "age", r("close").alias("close"))


def levels(d: DataFrame, *more: str) -> DataFrame:
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}s").alias("levels")) for s in ("bid", "ask")])
    return d.select(*KEY, "seq", *more, F.inline(sides)).select(*KEY, "seq", *more, "side", F.inline("levels"))


@query
def t3_top_levels(spark, sf_dir):
    top = flow.top_levels(levels(fixtures.depth(spark, sf_dir)), id_cols=[*KEY, "seq"], n=3)
    return top.select(*KEY, "seq", "side", F.col("level").cast("int").alias("level"), r("price").alias("price"), "qty")


@query
def t4_walk_the_book(spark, sf_dir):
    w = flow.walked_book(fixtures.depth(spark, sf_dir), notional=2000.0)
    return w.select(*KEY, "seq", *[r(c).alias(c) for c in ("bid_walk", "ask_walk", "gap")])


@query
def t5_replay_book(spark, sf_dir):
    by = Window.partitionBy(*KEY, "block_ms")
    t = T.ticks(spark, sf_dir).withColumn("block_ms", F.floor(F.col("seq") / 50).cast("long")).withColumn("first", F.min("seq").over(by))  # levels are made where their block is
    lv = levels(fixtures.depth_of(t, "block_ms", "first"), "block_ms", "first").withColumn("price", r("price", 2))
    gone = (F.col("seq") > F.col("first")) & ((F.col("qty") + F.col("seq")) % 4 == 0)
    book = flow.last_levels(lv.withColumn("qty", F.when(gone, 0.0).otherwise(F.col("qty"))), id_cols=[*KEY, "block_ms"])
    return book.groupBy(*KEY, "block_ms", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"))


@query
def t6_best_and_worst(spark, sf_dir):
    e = scoring.extremes(all_scores(spark, sf_dir).withColumn("crps", r("crps")), n=3)
    return e.select("asset", "model", "end", F.col("nth").cast("int").alias("nth"), "current_time_ms", "crps")


@query
def u1_union_moves(spark, sf_dir):
    m = all_moves(spark, sf_dir)
    both = m.filter("venue = 'spot'").unionByName(m.filter("venue = 'futures'"))
    return both.select("asset", "recv_ts_ms", "venue", r("price").alias("price"))


@query
def u3_ingest_merge(spark, sf_dir):
    t = T.trades(spark, sf_dir).select(*KEY, "recv_ts_ms", "seq", F.lit("stored").alias("origin"))
    stored = t.filter((F.col("seq") % 3 != 0) & (F.col("recv_ts_ms") < 1_705_900_000_000))
    return prompts.ingest_merge(stored, t.withColumn("origin", F.lit("batch")), keys=KEY, ts="recv_ts_ms", ids=["seq"])


@query
def u4_coverage_windows(spark, sf_dir):
    c = hour_candles(spark, sf_dir)
    stored = c.filter("asset <> 'view' or venue <> 'futures'")
    return prompts.coverage_windows(stored, keys=KEY, ts="open_time_ms", start=1_704_067_200_000, end=1_706_918_400_000, step=HOUR, interior=True, wanted=c)


@query
def u5_common_prompts(spark, sf_dir):
    a = answers(spark, sf_dir)
    out = None
    for i in range(8):
        own = a.filter(F.col("model") == f"m{i}").select("asset", "current_time_ms")
        out = own if out is None else out.intersect(own)
    return out


@query
def f1_clock_functions(spark, sf_dir):
    t = T.trades(spark, sf_dir)
    ms = F.col("recv_ts_ms")
    return t.select("seq", Q.to_ms(ms * 1000).alias("ms"), Q.ms_to_utc(ms).alias("utc"), Q.next_slot(ms, clock=20_000, offset=5000).alias("next_slot"), Q.event_slot(ms, clock=20_000, opens=10_250, length=4000).alias("event_slot"), Q.season_slot(ms).alias("season_slot"))


@query
def f15_event_coin(spark, sf_dir):
    t = T.trades(spark, sf_dir)
    key = [F.col("asset"), F.col("venue"), F.col("recv_ts_ms")]
    return t.select("seq", Q.event_coin(*key).alias("taken"), Q.event_delay_ms(*key).alias("delay_ms"))


@query
def f10_signal_scores(spark, sf_dir):
    t = flow.tick_counts(venue_prompts(spark, sf_dir), T.trades(spark, sf_dir), keys=KEY, at="current_time_ms", spans={"6h": 6 * HOUR})
    z = Q.robust_z(F.col("flow_6h"), F.lit(0.5), F.lit(8.0))
    z1 = Q.robust_z(F.col("n_6h").cast("double"), F.lit(1.5), F.lit(0.7), kind="log1p")
    return t.select("asset", "venue", "current_time_ms", r(z).alias("z"), r(z1).alias("z_log"), r(Q.logistic(0.2, [z, z1], [1.5, -0.7])).alias("p"), r(Q.log_blend(0.1, [F.col("vol_6h"), F.col("range_6h")], [0.4, 0.3], 1e-3)).alias("blend"))


@query
def r1_ladders(spark, sf_dir):
    a = answers(spark, sf_dir)
    q = F.col("q")
    return a.select("asset", "current_time_ms", "model", r(F.get(q, 0)).alias("q_first"), r(F.get(q, 99)).alias("q_last"), r(L.median(q)).alias("median"), r(L.width(q)).alias("width"), F.size(L.violations(q)).alias("n_bad"))


def partnered(a: DataFrame) -> DataFrame:
    """Each model's ladder ``a`` beside that of the model four numbers on, ``b``."""
    no = F.substring("model", 2, 1).cast("int")
    other = a.select("asset", "current_time_ms", F.concat(F.lit("m"), (no + 4) % 8).alias("model"), F.col("q").alias("b"))
    return a.withColumnRenamed("q", "a").join(other, ["asset", "current_time_ms", "model"])


@query
def r5_blend_ladders(spark, sf_dir):
    a = answers(spark, sf_dir)
    j = partnered(a)
    w = L.blend_weight(L.width(F.col("a")) / L.width(F.col("b")), slope=1.5, pivot=0.9, cap=0.6)
    out = j.select("asset", "current_time_ms", "model", r(w).alias("weight"), F.posexplode(L.blended(F.col("a"), F.col("b"), w)).alias("i", "v"))
    return out.groupBy("asset", "current_time_ms", "model", "weight").agg(r(F.sum("v"), 4).alias("total"), r(F.min("v")).alias("low"), r(F.max("v")).alias("high"))


@query
def r10_reshaped_ladders(spark, sf_dir):
    q = F.col("q")
    shapes = {"centre": L.centre_widened(q), "wide": L.widened(q, F.lit(1.25)), "moved": L.shifted(q, 0.1 * L.width(q))}
    return answers(spark, sf_dir).select("asset", "current_time_ms", "model", *[r(F.get(c, 24)).alias(f"{n}_q25") for n, c in shapes.items()], *[r(L.width(c)).alias(f"{n}_width") for n, c in shapes.items()])


def messages(spark, sf_dir) -> DataFrame:
    return M.read_raw_messages(fixtures.raw_from_ticks(T.ticks(spark, sf_dir)))


@query
def s2_normalized_trades(spark, sf_dir):
    return M.normalize_trades(messages(spark, sf_dir), keep=[*KEY, "seq"])


@query
def s3_normalized_quotes(spark, sf_dir):
    q = M.normalize_book_ticker(messages(spark, sf_dir), keep=[*KEY, "seq"])
    return q.select(*KEY, "seq", "recv_ts_ms", r("bid_price").alias("bid_price"), "bid_qty", r("ask_price").alias("ask_price"), "ask_qty", "event_ts_ms")


@query
def s6_normalized_liquidations(spark, sf_dir):
    return M.normalize_liquidations(messages(spark, sf_dir), keep=[*KEY, "seq"])


@query
def s12_score_report(spark, sf_dir):
    s = all_scores(spark, sf_dir).select("asset", "model", "current_time_ms", (F.col("current_time_ms") + HOUR).alias("target_ms"), F.lit(None).cast("long").alias("book_recv_ts_ms"), "crps", "realized", F.lit(0.5).alias("predict_ms"))
    return files.score_report(s, by=["asset", "model"]).drop("book_recv_ts_ms")


@query
def p7_forecast_violations(spark, sf_dir):
    a = answers(spark, sf_dir)
    no = F.col("current_time_ms") / HOUR % 5
    q = F.when(no == 1, F.slice("q", 1, 99)).when(no == 2, F.reverse("q")).when(no == 3, F.transform("q", lambda v: -v)).otherwise(F.col("q"))
    return a.select("asset", "current_time_ms", "model", F.array_join(L.violations(q), ",").alias("codes"))


@query
def p8_determinism(spark, sf_dir):
    a = answers(spark, sf_dir).select("asset", "current_time_ms", "model", "q")
    twice = a.union(a.withColumn("q", F.when(F.col("model") == "m3", L.shifted(F.col("q"), F.lit(0.01))).otherwise(F.col("q"))))
    return twice.groupBy("asset", "current_time_ms", "model").agg(F.count(F.lit(1)).alias("n_answers"), (F.count_distinct("q") == 1).alias("same"))


@query
def p10_asset_params(spark, sf_dir):
    assets = T.ticks(spark, sf_dir).select("asset").distinct()
    shared = spark.createDataFrame([("REG_A", 0.62), ("WIDTH", 1.0)], "name string, value double")
    own = spark.createDataFrame([("click", "REG_A", 0.7), ("view", "WIDTH", 1.2)], "asset string, name string, own double")
    every = assets.withColumn("name", F.explode(F.array(F.lit("REG_A"), F.lit("WIDTH"))))
    return every.join(F.broadcast(shared), "name").join(F.broadcast(own), ["asset", "name"], "left").select("asset", "name", F.coalesce("own", "value").alias("value"))


@query
def t1_latest_rows(spark, sf_dir):
    return latest_trades(spark, sf_dir).select("asset", "venue", "current_time_ms", "last.seq", "last.price", "last.recv_ts_ms")


@query
def w6_mid_change_lookback(spark, sf_dir):
    out = T.clock_prompts(spark, sf_dir)
    for venue in ("spot", "futures"):
        q = T.quotes(spark, sf_dir).filter(F.col("venue") == venue).withColumn("mid", Q.mid()).select("asset", "seq", "recv_ts_ms", "mid")
        for name, back in (("now", 0), ("then", 3 * HOUR)):
            at = out.withColumn("__t", F.col("current_time_ms") - back)
            out = asof_join(at, q, keys=["asset"], left_ts="__t", right_ts="recv_ts_ms", seq="seq", chunk_ms=CHUNK, name=f"{venue}_{name}").drop("__t")
    change = {v: F.col(f"{v}_now.mid") - F.col(f"{v}_then.mid") for v in ("spot", "futures")}
    return out.select("asset", "current_time_ms", r(change["spot"]).alias("schg"), r(change["futures"]).alias("fchg"), r(change["futures"] - change["spot"]).alias("lead"))


@query
def w7_basis_deviation(spark, sf_dir):
    g = j7_basis_grid(spark, sf_dir).filter("basis is not null")
    dealt = chunked(g, keys=["asset"], ts="current_time_ms", seq="current_time_ms", chunk_ms=48 * HOUR, halo_ms=15 * HOUR)
    w = Window.partitionBy("asset", "__chunk").orderBy("current_time_ms")
    for k in (5, 15):
        dealt = dealt.withColumn(f"bdev{k}", r(F.col("basis") - F.avg("basis").over(w.rangeBetween(-(k - 1) * HOUR, 0))))
    return without_halo(dealt).select("asset", "current_time_ms", "bdev5", "bdev15")


@query
def w16_prompt_spacing(spark, sf_dir):
    p = q1_build_prompts(spark, sf_dir).filter("kind = 'event'")
    return p.groupBy("asset", (F.floor(F.col("current_time_ms") / HOUR) * HOUR).cast("long").alias("slot")).agg(F.count(F.lit(1)).alias("n"))


@query
def a8_band_imbalance(spark, sf_dir):
    anchor, mid = 0.5 * (F.get("bids", 0)["price"] + F.get("asks", 0)["price"]), F.get("bids", 0)["price"] + 0.004
    d = fixtures.depth(spark, sf_dir).withColumns({"anchor": anchor, "mid": mid})  # beside their snapshot, so nothing is joined
    bands = flow.depth_bands(d, id_cols=[*KEY, "seq", "anchor", "mid"], width=0.05)
    return flow.band_imbalance(bands, id_cols=[*KEY, "seq"], width=0.05, reach=0.1).select(*KEY, "seq", r("band_imb").alias("band_imb"))


@query
def a30_liquidation_sums(spark, sf_dir):
    return flow.liquidation_sums(T.clock_prompts(spark, sf_dir), T.liquidations(spark, sf_dir), keys=["asset"], at="current_time_ms", spans={"_1h": HOUR, "_6h": 6 * HOUR})


@query
def a32_touch_queue_ratio(spark, sf_dir):
    q = spot(spark, sf_dir)
    at = asof_join(T.clock_prompts(spark, sf_dir), q, keys=["asset"], left_ts="current_time_ms", right_ts="recv_ts_ms", seq="seq", chunk_ms=CHUNK)
    f = flow.side_flow(T.clock_prompts(spark, sf_dir), T.trades(spark, sf_dir).filter("venue = 'spot'"), keys=["asset"], at="current_time_ms", reach_ms=6 * HOUR, window_ms=6 * HOUR)
    j = at.join(f, ["asset", "current_time_ms"]).filter("last is not null")
    bid, ask = F.col("last.bid_qty"), F.col("last.ask_qty")
    ratio = F.least(F.ln((bid + 0.001) / (F.col("sold") + 0.05)), F.ln((ask + 0.001) / (F.col("bought") + 0.05)))
    return j.select("asset", "current_time_ms", r(F.log1p(F.least(bid, ask))).alias("minq"), r(ratio).alias("q_flow"))


@query
def x1_stream_candles(spark, sf_dir):
    """Candles built by a stream over the events files, each batch's changes written to the shared folder."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    stream = spark.readStream.schema(raw.schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern, as a stream takes no single file; it fits the table alone
    candles = jobs.stream_candles(T.from_events(stream), keys=KEY, bar="1 hour", delay="1 hour")
    out, check = fresh(spark, "x1"), fresh(spark, "x1-checkpoint")
    candles.writeStream.foreachBatch(jobs.batch_folders(out)).option("checkpointLocation", check).outputMode("update").trigger(availableNow=True).start().awaitTermination()
    rows = C.upsert(spark.read.parquet(out), keys=[*KEY, "open_time_ms"], seq="batch")
    return rows.select(*KEY, "open_time_ms", *[r(c).alias(c) for c in ("open", "high", "low", "close", "volume")])


def feature_table(spark, sf_dir) -> DataFrame:
    return features.build_features(
        T.clock_prompts(spark, sf_dir), trades=T.trades(spark, sf_dir), quotes=T.quotes(spark, sf_dir), liquidations=T.liquidations(spark, sf_dir), depth=fixtures.depth(spark, sf_dir),
        window_ms=6 * HOUR, flow_ms=2 * HOUR, last_n=5, lags={"m1": HOUR, "m3": 3 * HOUR}, vol_ms=5 * HOUR, liq_recent_ms=HOUR, liq_unit=10.0, liq_long_unit=100.0, least=3,
    )


@query
def q2_build_features(spark, sf_dir):
    f = feature_table(spark, sf_dir).drop("quoted")
    return f.select("asset", "current_time_ms", *[c if c == "stale_ms" else r(c).alias(c) for c in f.columns[2:]])


def signal_rows(spark, sf_dir) -> DataFrame:
    """All 87 signals of the clock prompts; a second of the names is six minutes here."""
    p = T.clock_prompts(spark, sf_dir)
    wide = signals.build_signals(
        p, quotes=T.quotes(spark, sf_dir), trades=T.trades(spark, sf_dir), depth=fixtures.depth(spark, sf_dir), candles=full_candles(spark, sf_dir), liquidations=T.liquidations(spark, sf_dir),
        unit=360, grid_ms=HOUR // 10, notional=2000.0, bar_ms=HOUR, bars=0.1, least_bars=24, chunk_ms=CHUNK,
    )
    return signals.long_form(wide)


@query
def q4_build_signals(spark, sf_dir):
    return signal_rows(spark, sf_dir).select("asset", "current_time_ms", "signal", r("value").alias("value"))


#: Weights that a fit would bring, for an hour as a second.
CHAIN = chain.Settings(
    shift_weights={"basis": 0.02, "flow": 5e-4, "flow_fast": 2e-4, "momentum": 0.05, "c1": 0.1, "in_imb": 2e-4, "in_imb_vol": 0.05, "in_basis_vol": 0.1},
    size_weights={"in_vol": 0.4, "in_fast": 0.2, "in_rv": 0.3, "in_rng": 0.1, "in_abs_c1": 0.1, "in_f_qty_log": 1e-4, "in_stale": 1e-9, "in_one": 1e-3},
    widths=(0.02, 20.0),
)


def complete_features(spark, sf_dir, p: DataFrame) -> DataFrame:
    """All 36 features; an hour for a second, and 24 bars for the volatility's 120."""
    return features.complete_features(
        p, trades=T.trades(spark, sf_dir), quotes=T.quotes(spark, sf_dir), liquidations=T.liquidations(spark, sf_dir), depth=fixtures.depth(spark, sf_dir), candles=full_candles(spark, sf_dir),
        window_ms=6 * HOUR, flow_ms=2 * HOUR, last_n=5, lags={"m1": HOUR, "m3": 3 * HOUR, "m5": 5 * HOUR}, vol_ms=5 * HOUR, liq_recent_ms=HOUR, liq_unit=10.0, liq_long_unit=100.0, least=3,
        bar_ms=HOUR, history=600, slow=(24, 0.94), fast=(12, 0.85), horizon_bars=10, band_width=0.05, band_reach=0.1, band_age_ms=4 * HOUR, chunk_bars=48, chunk_ms=CHUNK,
    )


def prompt_hours(spark, sf_dir, p: DataFrame) -> DataFrame:
    """What the closes of the 120 bars before each prompt say, by venue."""
    c = full_candles(spark, sf_dir).select(*KEY, (F.col("open_time_ms") + HOUR).alias("end_ms"), "close")
    measure, gives = windows.hour_parts(120, HOUR, step=10, short=60, half=90, quick=20, bins=chain.BINS, decay=0.98)
    return windows.window_stats(features.per_venue(p), c, keys=KEY, at="current_time_ms", ts="end_ms", seq="end_ms", reach_ms=120 * HOUR, measure=measure, gives=gives)


def batch_forecasts(spark, sf_dir) -> DataFrame:
    """Ladders of all prompts, of the clock and of events, by the whole chain; those without a quote get the wide fallback."""
    keys = ["asset", "current_time_ms"]
    p = written(q1_build_prompts(spark, sf_dir), "prompts")
    at = p.select(*keys)
    hours = chain.preferred_hours(prompt_hours(spark, sf_dir, at), keys).drop("venue").withColumnsRenamed({"rv": "hour_rv", "rng": "hour_rng"})
    offsets = window_moves(spark, sf_dir, at).select(*keys, F.col("q").alias("offsets"))
    ofi = flow.recent_ofi(at, flow.quote_ofi(spot(spark, sf_dir).withColumn("venue", F.lit("spot")), keys=KEY), window_ms=6 * HOUR, recent_ms=2 * HOUR, least=5).select(*keys, F.col("value").alias("ofi"))
    taker = flow.side_flow(at, T.trades(spark, sf_dir).filter("venue = 'futures'"), keys=["asset"], at="current_time_ms", reach_ms=2 * HOUR, window_ms=2 * HOUR).select(*keys, ((F.col("bought") - F.col("sold")) / 8.0).alias("flow_z"))
    rows = chain.with_parts(complete_features(spark, sf_dir, at), [p.select(*keys, "kind"), hours, offsets, ofi, taker], keys)
    season = C.season(moved(spark, sf_dir), move="r_10", slot=Q.season_slot("open_time_ms"))
    rows = chain.season_columns(rows, season, "current_time_ms").withColumns({"mass": F.when(F.col("s_m1") == 0, 0.25).otherwise(0.05), "move_z": F.col("f_m1") * 200})
    return chain.forecasts(rows, CHAIN, keys=[*keys, "kind"])


@query
def q6_backtest(spark, sf_dir):
    """Forecasts of all prompts judged, scored against their labels and summed up by kind of prompt."""
    f = written(batch_forecasts(spark, sf_dir).withColumn("model", F.concat(F.lit("chain-"), "kind")).drop("kind"), "forecasts")
    labels = scoring.label_quotes(f.select("asset", "current_time_ms"), spot(spark, sf_dir), keys=["asset"], horizon_ms=HOUR, chunk_ms=CHUNK).withColumn("realized", scoring.realized("label", "target_ms", live_ms=HOUR))
    s = scoring.run_summary(scoring.scored(f, labels), by=["asset", "model"])
    return s.select("asset", "model", "n", "n_scored", *[r(c).alias(c) for c in ("crps_mean", "crps_median", "crps_max")])


@query
def r14_forecast_batch(spark, sf_dir):
    f = batch_forecasts(spark, sf_dir)
    q = F.col("q")
    return f.select("asset", "current_time_ms", "kind", r(L.median(q)).alias("median"), r(L.width(q)).alias("width"), F.size(L.violations(q)).alias("n_bad"))


@query
def a15_prompt_hours(spark, sf_dir):
    h = prompt_hours(spark, sf_dir, T.clock_prompts(spark, sf_dir)).filter("n_closes > 10 and venue = 'spot'")
    stats = [r(c, 9).alias(c) for c in ("mad", "ewma", "rv", "rng", "p90", "activity")]
    bins = [r(F.get("bins", F.lit(i)), 9).alias(f"bin{i}") for i in (0, 10, 25, 40, 49)]
    return h.select("asset", "current_time_ms", "n_closes", *stats, r("jump_ratio").alias("jump_ratio"), *bins)


@query
def r9_point_mass(spark, sf_dir):
    a = answers(spark, sf_dir).join(priced(spark, sf_dir), ["asset", "current_time_ms"])
    out = forecast.computed(a, "q", L.with_point_mass(F.col("q"), F.col("price"), F.lit(0.25)))
    return out.select("asset", "current_time_ms", "model", F.size(F.filter("q", lambda v: v == F.col("price"))).alias("n_atom"), F.size(L.violations(F.col("q"))).alias("n_bad"), r(F.aggregate("q", F.lit(0.0), lambda s, v: s + v), 4).alias("total"), r(F.get("q", 0)).alias("low"))


@query
def a15_weighted_bin_means(spark, sf_dir):
    m = C.aged(moved(spark, sf_dir).filter("r_10 is not null").withColumn("a10", F.abs("r_10")), keys=KEY, ts="open_time_ms", newest=480)
    b = forecast.weighted_bin_means(m.select(*KEY, "a10", "age"), keys=KEY, value="a10", age="age", bins=20)
    return b.select(*KEY, "bin", r("mean", 9).alias("mean"))


@query
def p5_filter_depth_updates(spark, sf_dir):
    u = T.ticks(spark, sf_dir).select(*KEY, "recv_ts_ms", (F.col("seq") * 3 - 2).alias("first_id"), (F.col("seq") * 3).alias("final_id"), F.floor(F.col("recv_ts_ms") / DAY).alias("day"))
    first = u.groupBy(*KEY, "day").agg(F.min(F.struct("recv_ts_ms", "final_id")).alias("s"))
    starts = first.select(*KEY, "day", (F.col("s.final_id") - 1).alias("start_id"), (F.col("s.recv_ts_ms") + 1000).alias("start_recv_ms"), (F.col("s.recv_ts_ms") + HOUR).alias("lo_ms"), (F.col("s.recv_ts_ms") + 8 * HOUR).alias("hi_ms"))
    return payloads.filter_depth_updates(u, starts, keys=[*KEY, "day"]).select(*KEY, "first_id", "final_id", "start_id")


@query
def q3_still_features(spark, sf_dir):
    """Stillness of the spot mid on the clock's grid: 13 columns, with a step of an hour for 100 ms and days for minutes."""
    f = features.still_features(
        T.clock_prompts(spark, sf_dir), quotes=T.quotes(spark, sf_dir), trades=T.trades(spark, sf_dir), candles=full_candles(spark, sf_dir), season=C.season(moved(spark, sf_dir), move="d_10", slot=Q.season_slot("open_time_ms")),
        step_ms=HOUR, steps=24, span=4, recent=6, flow_ms=6 * HOUR, within=0.005, hold=4.0, hold_bars={"p0range30m": 72, "p0range5m": 24}, hold_span=11, bar_ms=HOUR, spread_scale=20.0, chunk_ms=CHUNK,
    )
    return f.select("asset", "current_time_ms", *[r(c).alias(c) for c in f.columns[2:]])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from tidemark.plans import captures  # noqa: F401  (registers its queries, which build on these)

    return dict(REGISTRY)
