"""Queries over files and streams that Spark makes from the given tables, and over forecast steps."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import ladders as L
from tidemark.functions import quotes as Q
from tidemark.operators import candles as C
from tidemark.operators import flow, forecast, payloads, scoring
from tidemark.plans import fixtures
from tidemark.plans.queries import CHUNK, HOUR, KEY, all_moves, all_scores, answers, complete_features, full_candles, moved, partnered, priced, query, r, signal_rows, spot, window_moves
from tidemark.scratch import fresh
from tidemark.sources import files
from tidemark.sources import messages as M
from tidemark.sources import ticks as T
from tidemark.streaming import jobs


#: Lines that are written whole for a job to read: packed. A packed file is read by one task, so writers bound its rows.
PACKED = {"compression": "gzip"}


def lines(df: DataFrame, name: str, *columns: str) -> str:
    """The path of a folder of CSV files without header, as archives have them."""
    path = fresh(df.sparkSession, name)
    df.select(*columns).write.csv(path)
    return path


#: Rows of a stream's file, about; one task writes a file.
FILE_ROWS = 100_000


def streamed(spark: SparkSession, df: DataFrame, name: str, *, ts: str = "recv_ts_ms", slices: int = 3, beat: bool = False, files: int | None = None) -> DataFrame:
    """A table as a stream of its files: slices of time, written one after the other, a micro-batch each.

    A slice has as many files as its rows need (``files``, found from their number), the same for all slices.
    With ``beat`` two last slices hold rows without an asset, a year on and more: the first closes what waits for
    the watermark, the second what an operator behind another one waits for.
    """
    path, span = fresh(spark, name), df.agg(F.min(ts), F.max(ts), F.count(ts)).first()
    cuts = [span[0] + (span[1] + 1 - span[0]) * i // slices for i in range(slices + 1)] if span[0] is not None else []
    files = files or max(1, span[2] // (slices * FILE_ROWS))
    for i, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)):
        part = df.filter(F.col(ts).between(lo, hi - 1)).repartition(files)
        part.write.mode("append").parquet(path)
        if files > 1 and len(spark.read.schema(df.schema).parquet(path).inputFiles()) != files * (i + 1):  # so uneven that a file stayed empty
            return streamed(spark, df, name, ts=ts, slices=slices, beat=beat, files=files // 2)
    if beat:
        for days in (366, 400):
            late = [F.lit(cuts[-1] + days * 24 * HOUR if f.name == ts else "" if f.name == "asset" else None).cast(f.dataType).alias(f.name) for f in df.schema]
            spark.range(0, files, 1, files).select(*late).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings of the session for the streams started within."""
    names = {f"spark.sql.{k.replace('__', '.')}": v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: The state store that timers and map states need.
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """What a stream gives until its source is read, from folders of batches; a handful of keys need few partitions of state."""
    spark = df.sparkSession
    out, check = fresh(spark, name), fresh(spark, f"{name}-checkpoint")
    few = str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), 8))
    with settings(spark, shuffle__partitions=few):
        df.writeStream.foreachBatch(jobs.batch_folders(out)).option("checkpointLocation", check).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out)


@query
def s4_depth_updates(spark, sf_dir):
    t = T.ticks(spark, sf_dir)
    side = lambda c: F.array(*[F.array(F.format_string("%.4f", F.col(f"{c}_price") + i), F.format_string("%.1f", F.col(f"{c}_qty"))) for i in range(2)])
    body = F.to_json(F.struct(F.lit("depthUpdate").alias("e"), F.col("recv_ts_ms").alias("E"), (F.col("seq") * 2 - 1).alias("U"), (F.col("seq") * 2).alias("u"), F.when(F.col("venue") == "futures", F.col("seq") * 2 - 2).alias("pu"), side("bid").alias("b"), side("ask").alias("a")))
    m = M.read_raw_messages(t.select(*KEY, "seq", "recv_ts_ms", body.alias("value")))
    u = M.chained(M.normalize_depth_updates(m, keep=[*KEY, "seq"]), keys=KEY, order="seq")
    return u.select(*KEY, "seq", "event_ts_ms", "first_id", "final_id", "prev_final_id", F.size("bids").alias("n_bids"), r(F.get("bids", 1)["price"]).alias("second_bid"), F.get("asks", 0)["qty"].alias("ask_qty"))


@query
def s5_klines(spark, sf_dir):
    c = C.candles_from_trades(T.trades(spark, sf_dir), keys=KEY, bar_ms=HOUR)
    num = lambda n: F.format_string("%.4f", F.col(n))
    k = F.struct((F.col("open_time_ms") * 1000).alias("t"), num("open").alias("o"), num("high").alias("h"), num("low").alias("l"), num("close").alias("c"), num("volume").alias("v"), F.lit(True).alias("x"))
    raw = c.select(*KEY, F.col("open_time_ms").alias("seq"), F.col("open_time_ms").alias("recv_ts_ms"), F.to_json(F.struct(F.lit("kline").alias("e"), k.alias("k"))).alias("value"))
    return M.normalize_klines(M.read_raw_messages(raw), keep=KEY).select(*KEY, "open_time_ms", *[r(c).alias(c) for c in ("open", "high", "low", "close", "volume")], "closed")


@query
def s7_payloads(spark, sf_dir):
    p = files.read_payloads(spark, fixtures.payload_files(spark, sf_dir) + "/*/*/kind=payload")
    return p.select("asset", "folder_ms", "schema_version", F.size("venues.spot.depth_updates").alias("n_updates"), F.size(F.coalesce("venues.futures.liquidations", F.array())).alias("n_liquidations"), F.col("_corrupt_record").isNotNull().alias("corrupt"))


@query
def s8_payloads_for_scoring(spark, sf_dir):
    p = files.read_payloads_for_scoring(spark, fixtures.payload_files(spark, sf_dir) + "/*/*/kind=payload")
    kept = "depth_updates" in p.select("venues.spot.*").columns
    return p.select("asset", "folder_ms", F.lit(kept).alias("has_updates"), r(F.get("venues.spot.trades", 0)["price"]).alias("price"), F.size("venues.spot.book_ticker").alias("n_quotes"))


@query
def s9_saved_pairs(spark, sf_dir):
    p = files.read_saved_pairs(spark, fixtures.payload_files(spark, sf_dir), payload="kind=payload", book="kind=book")
    return p.select("asset", "folder_ms", "readable", r(Q.microprice("book.bid_price", "book.bid_qty", "book.ask_price", "book.ask_qty")).alias("micro"), F.size("payload.venues.spot.trades").alias("n_trades"))


@query
def s10_exploded_payloads(spark, sf_dir):
    p = files.read_payloads(spark, fixtures.payload_files(spark, sf_dir) + "/*/*/kind=payload")
    both = files.exploded(p, venue="spot", stream="trades").unionByName(files.exploded(p, venue="futures", stream="trades"))
    quotes = files.exploded(p, venue="spot", stream="book_ticker").select("asset", "current_time_ms", "venue", "seq", F.lit("quote").alias("stream"), r("bid_price").alias("price"))
    return both.select("asset", "current_time_ms", "venue", "seq", F.lit("trade").alias("stream"), r("price").alias("price")).union(quotes)


@query
def s11_written_payloads(spark, sf_dir):
    p = files.read_payloads(spark, fixtures.payload_files(spark, sf_dir) + "/*/*/kind=payload").drop("folder_ms", "_corrupt_record")
    path = fresh(spark, "payloads")
    files.write_payloads(p, path)
    back = spark.read.schema(files.PAYLOAD).json(path)
    return back.select("asset", "current_time_ms", F.size("venues.spot.trades").alias("n_trades"), F.col("schema_version"))


@query
def s13_trades_csv(spark, sf_dir):
    t = T.trades(spark, sf_dir)
    path = fresh(spark, "trades")
    maker = F.when(~F.col("buyer_is_maker"), "False").when(F.col("seq") % 4 == 1, "1").otherwise("True")
    t.select(F.col("seq").alias("agg_trade_id"), (F.col("recv_ts_ms") * 1000).alias("ts_ms"), F.lit("-").alias("ts_utc"), "price", "qty", maker.alias("buyer_is_maker")).write.csv(path, header=True)
    return files.read_trades_csv(spark, path).withColumn("price", r("price"))


@query
def s14_depth_csv(spark, sf_dir):
    d = fixtures.depth(spark, sf_dir)
    side = lambda n: d.select("recv_ts_ms", F.lit("-").alias("recv_ts_utc"), "update_id", F.lit(None).cast("long").alias("event_ts_ms"), F.lit(None).cast("long").alias("transaction_ts_ms"), F.lit(n).alias("side"), F.posexplode(f"{n}s").alias("level", "x")).select("recv_ts_ms", "recv_ts_utc", "update_id", "event_ts_ms", "transaction_ts_ms", "side", "level", "x.price", "x.qty")
    path = fresh(spark, "depth")
    side("bid").union(side("ask")).write.options(**PACKED, maxRecordsPerFile=200_000).csv(path, header=True)
    s = files.read_depth_csv(spark, path)
    return s.select("recv_ts_ms", "update_id", F.size("bids").alias("n_bids"), r(F.get("bids", 0)["price"]).alias("bid"), r(F.get("asks", 19)["price"]).alias("last_ask"), F.col("event_ts_ms").isNull().alias("no_event"))


@query
def s15_kline_archive(spark, sf_dir):
    c = C.candles_from_trades(T.trades(spark, sf_dir), keys=KEY, bar_ms=HOUR)
    path = lines(c.withColumn("t", F.col("open_time_ms") * 1000).union(c.withColumn("t", F.col("open_time_ms"))).withColumn("t", F.col("t").cast("string")).union(c.limit(1).withColumn("t", F.lit("open_time"))), "klines", "t", "open", "high", "low", "close", "volume")
    return files.read_kline_archive(spark, path).groupBy("open_time_ms").agg(F.count(F.lit(1)).alias("n"), r(F.sum("close"), 4).alias("close"), r(F.max("high")).alias("high"))


@query
def s16_book_depth_archive(spark, sf_dir):
    t = T.ticks(spark, sf_dir).select(F.date_format(F.timestamp_millis("recv_ts_ms"), "yyyy-MM-dd HH:mm:ss").alias("at"), F.explode(F.array(*map(F.lit, (-2, -1, 1, 2)))).alias("pct"), "price", "qty")
    t = t.withColumn("notional", F.col("qty") * (F.col("price") + F.col("pct")))
    rows = files.read_book_depth_archive(spark, lines(t, "bookdepth", "at", "pct", "qty", "notional"))
    b = files.book_from_percent_levels(rows)
    return b.select("recv_ts_ms", F.size("bids").alias("n_bids"), r(F.get("bids", 0)["price"]).alias("bid"), r(F.get("asks", 0)["price"]).alias("ask"))


@query
def s17_book_ticker_archive(spark, sf_dir):
    q = T.quotes(spark, sf_dir)
    return files.read_book_ticker_archive(spark, lines(q.withColumn("event", F.col("recv_ts_ms") + 7), "tickers", "seq", "bid_price", "bid_qty", "ask_price", "ask_qty", "recv_ts_ms", "event")).select("update_id", "recv_ts_ms", "transaction_ts_ms", r("bid_price").alias("bid_price"), "ask_qty")


@query
def s18_kept_captures(spark, sf_dir):
    t = T.ticks(spark, sf_dir).select(F.when(F.col("seq") % 13 == 0, F.concat(F.lit("tmp-"), "seq")).otherwise(F.col("recv_ts_ms").cast("string")).alias("folder"))
    return files.kept_captures(t, now_ms=1_706_000_000_000)


@query
def s18_pruned_captures(spark, sf_dir):
    """What is left of the saved captures when those older than ten days are deleted."""
    root = fixtures.payload_files(spark, sf_dir)
    files.prune_captures(spark, root, now_ms=1_706_054_400_000, keep_ms=240 * HOUR)
    return files.read_payloads(spark, root + "/*/*/kind=payload").select("asset", "folder_ms")


@query
def f7_tick_sizes(spark, sf_dir):
    t = T.ticks(spark, sf_dir).select("seq", F.when(F.col("seq") % 3 == 0, F.format_string('{"filters":[{"filterType":"LOT_SIZE","tickSize":"9"},{"filterType":"PRICE_FILTER","tickSize":"0.0%d"}]}', F.col("seq") % 9 + 1)).when(F.col("seq") % 3 == 1, "{broken").alias("info"), F.lit(0.5).alias("fallback"))
    return t.select("seq", Q.tick_size("info", "fallback").alias("tick"))


@query
def f8_candle_quotes(spark, sf_dir):
    c = C.candles_from_trades(T.trades(spark, sf_dir), keys=KEY, bar_ms=HOUR)
    q = files.book_from_candles(c, spread=F.lit(0.2), bid_qty=F.lit(1.0), ask_qty=F.lit(2.0))
    return q.select(*KEY, "open_time_ms", r("bid_price").alias("bid_price"), r("ask_price").alias("ask_price"), "ask_qty")


@query
def f13_widths(spark, sf_dir):
    """The width's steps of a forecast one after the other, for each bar and its recent moves."""
    m = moved(spark, sf_dir, one=1, ten=10).filter("r_ten is not null")
    w0, recent, activity = 0.5 + F.abs("d_one") / 4, F.abs("d_ten") / 3, F.col("volume") / 10
    w1 = forecast.blended_width(w0, recent)
    w2 = forecast.liquidation_width(w1, activity, gain=0.3)
    w3 = forecast.regime_width(w2, recent)
    shift, w4 = forecast.flexed(F.col("d_one") / 2, w3, recent, pull=0.5, excess=0.2, floor=0.4, power=0.5, narrowest=0.6, fade=(0.5, 2.0))
    w5 = forecast.season_width(w4, F.lit(0.8), weight=0.25, most=0.2)
    return m.select(*KEY, "open_time_ms", *[r(c).alias(n) for n, c in {"blended": w1, "liquidation": w2, "regime": w3, "flexed": w4, "season": w5, "shift": shift}.items()])


@query
def r1_mixture_ladders(spark, sf_dir):
    """Ladders of the mixture of two Laplace distributions, its quantiles found by halving."""
    a = priced(spark, sf_dir).withColumn("w", 0.2 + F.col("current_time_ms") / HOUR % 9 / 10)
    q = L.ladder(F.col("price"), F.lit(0.05), F.col("w"), L.mixture_z())
    a = forecast.computed(a, "q", q)
    return a.select("asset", "current_time_ms", *[r(F.get("q", F.lit(i))).alias(f"q{i}") for i in (0, 1, 24, 49, 50, 98, 99)], r(L.width(F.col("q"))).alias("width"))


@query
def r9_still_mixtures(spark, sf_dir):
    a = answers(spark, sf_dir).join(priced(spark, sf_dir), ["asset", "current_time_ms"]).withColumn("mass", 0.1 + F.substring("model", 2, 1).cast("int") * 0.1)
    a = forecast.computed(a, "w", L.width(F.col("q")))
    a = forecast.computed(a, "q", L.still_mixed(F.col("q"), F.col("price"), F.col("mass"), F.col("w"), widen=0.5, shift=0.3, hole=0.2))
    return a.select("asset", "current_time_ms", "model", F.size(F.filter("q", lambda v: v == F.col("price"))).alias("n_atom"), *[r(F.get("q", F.lit(i))).alias(f"q{i}") for i in (0, 30, 60, 99)], r(F.aggregate("q", F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


@query
def r15_empirical_ladders(spark, sf_dir):
    m = window_moves(spark, sf_dir).select("asset", "current_time_ms", F.col("q").alias("offsets"))
    a = priced(spark, sf_dir).join(m, ["asset", "current_time_ms"], "left")
    a = forecast.computed(a, "q", L.empirical(F.col("price"), F.col("offsets"))).filter("q is not null")
    return a.select("asset", "current_time_ms", r(F.get("q", F.lit(0)), 9).alias("low"), r(F.get("q", F.lit(99)), 9).alias("high"), r(F.aggregate("q", F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


@query
def r6_mirrored_bins(spark, sf_dir):
    p = priced(spark, sf_dir)
    bins = F.transform(F.sequence(F.lit(1), F.lit(50)), lambda i: i * 1e-4)
    q = L.mirrored(bins, F.col("price"), F.pmod(F.col("current_time_ms") / HOUR, F.lit(7)) * 1e-3 - 3e-3)
    return p.select("asset", "current_time_ms", F.size(q).alias("n"), r(F.get(q, 0)).alias("low"), r(F.get(q, 99)).alias("high"), r(L.median(q)).alias("median"))


@query
def r7_mixed_ladders(spark, sf_dir):
    a = answers(spark, sf_dir)
    j = forecast.computed(partnered(a), "q", L.mixed(F.col("a"), F.col("b"), F.lit(0.3)))
    return j.select("asset", "current_time_ms", "model", r(F.get("q", 0)).alias("low"), r(F.get("q", 99)).alias("high"), r(F.aggregate("q", F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


@query
def r8_candle_weights(spark, sf_dir):
    m = moved(spark, sf_dir).filter("d_10 is not null")
    kind = F.when(F.col("open_time_ms") / HOUR % 5 == 0, "event").otherwise("time")
    return m.select(*KEY, "open_time_ms", r(forecast.candle_weight(F.abs("d_10"), F.col("r_10") * 10, kind, pivot=1.2, scale=0.4, beta=0.7)).alias("weight"))


@query
def r11_live_widths(spark, sf_dir):
    a = answers(spark, sf_dir).withColumn("recent", F.when(F.col("current_time_ms") / HOUR % 6 > 0, 0.3 + F.col("current_time_ms") / HOUR % 6 * 0.2))
    a = forecast.computed(a, "w", L.width(F.col("q")))
    a = forecast.computed(a, "f", L.live_factor(F.col("w"), F.col("recent"), power=0.5, least=0.7, most=1.4, narrowest=0.25))
    a = forecast.computed(a, "q", L.widened(F.col("q"), F.col("f")))
    return a.select("asset", "current_time_ms", "model", r("f").alias("factor"), r(L.width(F.col("q"))).alias("width"))


@query
def r12_trade_anchors(spark, sf_dir):
    a = answers(spark, sf_dir).join(priced(spark, sf_dir), ["asset", "current_time_ms"])
    q = L.trade_anchored(F.col("q"), F.col("price"), F.col("price") + F.col("current_time_ms") / HOUR % 3 - 1, share=0.4, band=0.05)
    return a.select("asset", "current_time_ms", "model", r(F.get(q, 0)).alias("low"), r(L.median(q)).alias("median"), r(F.aggregate(q, F.lit(0.0), lambda s, v: s + v), 4).alias("total"))


@query
def r13_layer_terms(spark, sf_dir):
    terms = spark.createDataFrame([("schg5000", "robust", 0.0, 1.5, "shift", 0.05), ("s_dimb3", "raw", 0.0, 1.0, "shift", 0.02), ("s_nbt60000", "log1p", 1.5, 0.7, "scale", 0.1), ("c_mad60", "robust", 1.0, 0.8, "scale", 0.2)], "signal string, kind string, centre double, spread double, op string, coef double")
    made = forecast.layer_terms(signal_rows(spark, sf_dir), terms, keys=["asset", "current_time_ms"])
    a = answers(spark, sf_dir).join(priced(spark, sf_dir), ["asset", "current_time_ms"]).join(made, ["asset", "current_time_ms"])
    q = L.layered(F.col("q"), F.col("price"), F.col("shift"), F.col("scale"), tick=0.01)
    return a.select("asset", "current_time_ms", "model", r("shift").alias("shift"), r("scale").alias("scale"), r(F.get(q, 0)).alias("low"), r(F.get(q, 99)).alias("high"))


@query
def x2_stream_moves(spark, sf_dir):
    s = streamed(spark, T.trades(spark, sf_dir), "x2-source")
    return drained(jobs.stream_moves(s, keys=KEY, tick=0.5, delay="1 hour"), "x2").select(*KEY, "recv_ts_ms", "seq", r("price").alias("price"))


@query
def x3_stream_event_prompts(spark, sf_dir):
    s = streamed(spark, all_moves(spark, sf_dir), "x3-source")
    rows = drained(jobs.stream_event_prompts(s, clock=HOUR, opens=600_000, length=2_400_000, delay="2 hours"), "x3", "update")
    return C.upsert(rows, keys=["asset", "slot"], seq="batch").select("asset", "current_time_ms", "venue", "slot")


@query
def x2_group_moves(spark, sf_dir):
    s = streamed(spark, T.trades(spark, sf_dir), "x2-source")
    return drained(jobs.stream_group_moves(s, keys=KEY, tick=0.5, delay="1 hour"), "x2").select(*KEY, "ts_ms", r("price").alias("price"), r("reference").alias("reference"), "recv_ts_ms")


@query
def x4_stream_labels(spark, sf_dir):
    """One row a prompt from a running stream: an outer interval join and an aggregation behind it."""
    p = streamed(spark, T.clock_prompts(spark, sf_dir), "x4-prompts", ts="current_time_ms", beat=True)
    q = streamed(spark, spot(spark, sf_dir).drop("bid_qty", "ask_qty"), "x4-quotes", beat=True)
    out = drained(jobs.stream_labels(p, q, horizon_ms=HOUR, delay="1 hour"), "x4").filter("asset <> ''")
    return out.select("asset", "current_time_ms", "seq", "recv_ts_ms")


@query
def x5_retention(spark, sf_dir):
    """What each stream's lifetime holds at every prompt, from state that timers and the watermark empty."""
    t = T.ticks(spark, sf_dir)
    kinds = F.array(F.lit("trades"), F.lit("quotes"), F.when(F.col("asset") == "error", F.lit("liquidations")))
    ticks = t.select(*KEY, F.explode(F.array_compact(kinds)).alias("stream"), "recv_ts_ms", F.when(F.col("stream") == "quotes", F.col("bid_qty")).otherwise(F.col("qty")).alias("size"))
    asked = T.clock_prompts(spark, sf_dir).withColumn("venue", F.explode(F.array(F.lit("spot"), F.lit("futures"))))
    rows = ticks.unionByName(asked.select(*KEY, F.lit(jobs.PROMPT).alias("stream"), F.col("current_time_ms").alias("recv_ts_ms"), F.lit(0.0).alias("size")))
    s = streamed(spark, rows, "x5-source", beat=True)
    with settings(spark, streaming__stateStore__providerClass=ROCKS_DB):
        out = drained(jobs.retained(s, keys=KEY, lifetimes={"trades": 2 * HOUR, "quotes": 5 * HOUR, "liquidations": 48 * HOUR}, delay="1 hour"), "x5")
    return out.filter("asset <> ''").drop("batch")


@query
def x6_depth_samples(spark, sf_dir):
    d = fixtures.depth(spark, sf_dir).select(*KEY, "seq", "recv_ts_ms", "update_id", "bids", "asks")
    s = streamed(spark, d, "x6-source", beat=True)
    return drained(jobs.depth_samples(s, keys=KEY, every="6 hours", delay="1 hour"), "x6").filter("asset <> ''").select(*KEY, "from_ms", "update_id")


@query
def x6_band_samples(spark, sf_dir):
    """Bands of every fourth sample, folded within the stream."""
    d = fixtures.depth(spark, sf_dir).select(*KEY, "seq", "recv_ts_ms", "update_id", "bids", "asks")
    samples = jobs.depth_samples(streamed(spark, d, "x6-source", beat=True), keys=KEY, every="6 hours", delay="1 hour")
    out = drained(jobs.band_samples(samples, keys=KEY, every_ms=6 * HOUR, nth=4, width=0.05), "x6-bands")
    return out.filter("asset <> ''").select(*KEY, "from_ms", "side", "band", r("size").alias("size"))


@query
def x7_sliding_flow(spark, sf_dir):
    s = streamed(spark, T.trades(spark, sf_dir), "x7-source", beat=True)
    return drained(jobs.sliding_flow(s, keys=KEY, window="6 hours", step="2 hours", delay="1 hour"), "x7").filter("asset <> ''").drop("batch")


@query
def x8_activity_sessions(spark, sf_dir):
    s = streamed(spark, T.trades(spark, sf_dir), "x8-source", beat=True)
    return drained(jobs.activity_sessions(s, keys=["asset"], gap="30 minutes", delay="1 hour"), "x8").filter("asset <> ''").drop("batch")


@query
def x9_once(spark, sf_dir):
    """Trades that come twice or thrice, in one file or two, written once; the last batch is then run again."""
    t = T.trades(spark, sf_dir).select(*KEY, "seq", "recv_ts_ms")
    again = t.filter("seq % 3 = 0").withColumn("recv_ts_ms", F.col("recv_ts_ms") + HOUR)
    s = streamed(spark, t.union(t.filter("seq % 5 = 0")).union(again), "x9-source")
    out, check = fresh(spark, "x9"), fresh(spark, "x9-checkpoint")
    write = jobs.batch_folders(out)

    def twice(rows: DataFrame, number: int) -> None:
        rows.persist()
        write(rows.limit(3), number)  # a batch that was cut short,
        write(rows, number)  # and runs again
        rows.unpersist()

    jobs.once(s, keys=[*KEY, "seq"], delay="3 hours").writeStream.foreachBatch(twice).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select(*KEY, "seq")


@query
def x10_trailing_window(spark, sf_dir):
    s = streamed(spark, T.trades(spark, sf_dir), "x10-source")
    out = drained(jobs.stream_trailing_window(s, keys=KEY, window_ms=6 * HOUR, delay="1 hour"), "x10")
    return out.select(*KEY, "seq", "n", r("trailing").alias("trailing"))


@query
def q2_all_features(spark, sf_dir):
    """All 36 features; an hour for a second, and 24 bars for the volatility's 120."""
    f = complete_features(spark, sf_dir, T.clock_prompts(spark, sf_dir)).drop("quoted")
    return f.select("asset", "current_time_ms", *[c if c == "stale_ms" else r(c).alias(c) for c in f.columns[2:]])


def payload_streams(spark, sf_dir) -> dict[str, DataFrame]:
    """The payload's streams, made of ticks: futures rows carry exchange times, spot rows don't."""
    t = T.ticks(spark, sf_dir)
    at, futures = F.col("recv_ts_ms"), F.col("venue") == "futures"
    place, timed = [F.col("asset"), F.col("venue"), at.alias("at"), F.col("seq")], F.when(futures, at)
    d = t.select(*place, "recv_ts_ms", "bid_price", "ask_price")  # without levels: those that prompts get are made into snapshots
    bars = full_candles(spark, sf_dir).withColumns({"at": F.col("open_time_ms") + HOUR, "seq": F.lit(0).cast("long")})
    none = F.array().cast(files.LEVELS)
    return {
        "candles_1s": bars,
        "trades": t.select(*place, "ts_ms", at.alias("event_ts_ms"), "recv_ts_ms", "price", "qty", "buyer_is_maker"),
        "book_ticker": t.select(*place, "recv_ts_ms", "bid_price", "bid_qty", "ask_price", "ask_qty", timed.alias("event_ts_ms"), timed.alias("transaction_ts_ms")),
        "liquidations": t.filter(futures & (F.col("asset") == "error")).select(*place, "ts_ms", "recv_ts_ms", "price", "qty", "is_buy"),
        "depth_updates": t.select(*place, "recv_ts_ms", at.alias("event_ts_ms"), timed.alias("transaction_ts_ms"), (F.col("seq") * 3 - 2).alias("first_id"), (F.col("seq") * 3).alias("final_id"), F.when(futures, F.col("seq") * 3 - 3).alias("prev_final_id"), none.alias("bids"), none.alias("asks")),
        "depth": d,
        "bands": d.filter(~futures & F.col("bid_price").isNotNull() & F.col("ask_price").isNotNull()),
    }


def leveled(quotes: DataFrame) -> DataFrame:
    """Quotes as the payload's snapshots; futures have exchange times."""
    timed = F.when(F.col("venue") == "futures", F.col("at"))
    return fixtures.depth_of(quotes, "at").withColumns({"update_id": F.col("seq") * 3 - 1, "event_ts_ms": timed, "transaction_ts_ms": timed})


def banded(quotes: DataFrame) -> DataFrame:
    """Quotes as the payload's bands round the mids of their snapshots."""
    b = flow.dense_bands(fixtures.depth_of(quotes, "at"), id_cols=[*KEY, "at", "seq", "recv_ts_ms"], width=0.05)
    return b.withColumnsRenamed({"anchor": "anchor_price", "bid_bands": "bids", "ask_bands": "asks"})


@query
def q5_whole_payloads(spark, sf_dir):
    """Whole payloads of the clock prompts, and what the rules of saved payloads say of them; an hour for a second."""
    p = T.clock_prompts(spark, sf_dir).select("asset", "current_time_ms", F.lit("time").alias("kind"), F.lit(None).cast("string").alias("venue"))
    assets = {a: (a.upper(), 0.05) for a in ("click", "error", "purchase", "signup", "view")}
    lives = {"candles_1s": 48 * HOUR, "trades": 6 * HOUR, "book_ticker": 6 * HOUR, "liquidations": 48 * HOUR, "depth_updates": 24 * HOUR, "depth": 24 * HOUR, "bands": 6 * HOUR}
    w = payloads.whole_payloads(p, payload_streams(spark, sf_dir), assets=assets, lives=lives, bars=48, bar_ms=HOUR, back_ms=12 * HOUR, tolerance_ms=4 * HOUR, bridge_ms=6 * HOUR, made={"depth": leveled, "bands": banded})
    judged = payloads.saved_payload_violations(w, assets=assets, kinds=("time", "event"), bars=48, bar_ms=HOUR)
    sizes = [F.size(f"venues.{v}.{s}").alias(f"{v}_{s}") for v in ("spot", "futures") for s in ("candles_1s", "trades", "book_ticker", "liquidations", "depth_updates")]
    ids = [F.col(f"venues.{v}.{d}.update_id").alias(f"{v}_{d}") for v in ("spot", "futures") for d in ("depth_start", "depth_latest")]
    bands = F.aggregate("venues.spot.depth_bands.bids", F.lit(0.0), lambda s, x: s + x)
    return judged.select("asset", "current_time_ms", *sizes, *ids, F.col("venues.spot.complete_history").alias("complete"), r(bands).alias("bid_bands"), F.array_join("codes", ",").alias("codes"))


@query
def q5_assembled_payloads(spark, sf_dir):
    """Sizes of the windows, and what the rules say where the prompt's time is set back behind its rows."""
    p = T.clock_prompts(spark, sf_dir).select("asset", "current_time_ms", F.lit("time").alias("kind"), F.lit(None).cast("string").alias("venue"))
    assets = {a: (a.upper(), 0.05) for a in ("click", "error", "purchase", "view")}
    lives = {n: (2 if n == "book_ticker" else 6) * HOUR for n in payloads.STREAM_FIELDS}
    w = payloads.whole_payloads(p, payload_streams(spark, sf_dir), assets=assets, lives=lives, bars=6, bar_ms=HOUR, back_ms=3 * HOUR, tolerance_ms=HOUR, bridge_ms=HOUR, made={"depth": leveled, "bands": banded})
    at = F.col("current_time_ms")
    w = w.withColumn("current_time_ms", F.when(at % (7 * HOUR) == 0, at - 3 * HOUR).otherwise(at))
    v = payloads.saved_payload_violations(w, assets=assets, kinds=("time", "event"), bars=6, bar_ms=HOUR)
    sizes = [F.size(f"venues.{v}.{s}").alias(f"n_{n}_{v}") for n, s in (("trades", "trades"), ("quotes", "book_ticker")) for v in ("spot", "futures")]
    ahead = F.exists("venues.spot.trades", lambda x: x["recv_ts_ms"] > F.col("current_time_ms"))
    return v.select("asset", "current_time_ms", *sizes, F.array_contains("codes", "asset").alias("bad_asset"), ahead.alias("ahead"))


@query
def w4_recent_ofi(spark, sf_dir):
    o = flow.recent_ofi(T.clock_prompts(spark, sf_dir), flow.quote_ofi(T.quotes(spark, sf_dir), keys=KEY), window_ms=6 * HOUR, recent_ms=2 * HOUR, least=5)
    return o.select("asset", "current_time_ms", "venue", "n", "n_recent", r("value").alias("value"))


@query
def a19_run_report(spark, sf_dir):
    """The runs' latencies and readability are made of the prompt's hour and the model's number."""
    hour, no = F.col("current_time_ms") / HOUR, F.substring("model", 2, 1).cast("int")
    runs = all_scores(spark, sf_dir).withColumns({"readable": (hour + no) % 13 != 0, "latency_ms": 0.5 + (hour * 7 + no * 3) % 11})
    out = scoring.run_report(runs, by=["asset", "model"], budget_ms=5.0)
    return out.select("asset", "model", "n", "n_scored", "n_unreadable", r("crps_mean").alias("crps_mean"), "median_ms", r("p95_ms").alias("p95_ms"), "max_ms", "within_budget")


@query
def p6_payload_rules(spark, sf_dir):
    """A payload of each tick, fifteen of sixteen with a fault each; two assets are unknown."""
    t = T.ticks(spark, sf_dir)
    fault = F.col("seq") % 16
    bad = lambda n, wrong, right: F.when(fault == n, wrong).otherwise(right)
    at, null = F.col("recv_ts_ms"), F.lit(None).cast("long")
    level = lambda p: F.struct(p.alias("price"), F.lit(1.0).alias("qty"))

    def venue(name: str):
        far, near = F.array(level(F.col("bid_price") - 1), level(F.col("bid_price"))), F.array(level(F.col("bid_price")), level(F.col("bid_price") - 1))
        time = at if name == "futures" else null
        of = lambda n, wrong, right, v="spot": bad(n, wrong, right) if name == v else right
        trade = lambda ms, price: F.struct("ts_ms", ms.alias("event_ts_ms"), ms.alias("recv_ts_ms"), price.alias("price"), "qty", "buyer_is_maker")
        snap = lambda event, bids: F.struct(event.alias("event_ts_ms"), time.alias("transaction_ts_ms"), bids.alias("bids"), F.array(level(F.col("ask_price"))).alias("asks"))
        sizes = F.array(F.lit(1.0), F.lit(2.0))
        liq = F.array(F.struct(at.alias("ts_ms"), "recv_ts_ms", "price", "qty", "is_buy"))
        bands = F.struct(F.lit(100.0).alias("anchor_price"), of(12, F.lit(2.0), F.lit(0.5)).alias("bucket_usd"), sizes.alias("bids"), of(11, F.array(F.lit(1.0)), sizes).alias("asks"), at.alias("recv_ts_ms")) if name == "spot" else F.struct(F.lit(0.0).alias("anchor_price"), F.lit(0.5).alias("bucket_usd"), F.array().cast("array<double>").alias("bids"), F.array().cast("array<double>").alias("asks"), F.lit(0).cast("long").alias("recv_ts_ms"))
        bars = F.transform(F.array(F.lit(2), F.lit(1)), lambda k: F.struct((at - k * 1000).alias("open_time_ms"), *[F.col("price").alias(c) for c in ("open", "high", "low", "close")], F.col("qty").alias("volume")))
        return F.struct(
            of(5, F.lit("?"), F.upper("asset")).alias("symbol"), of(13, F.lit(False), F.lit(True)).alias("complete_history"), bars.alias("candles_1s"),
            F.array(trade(of(6, at + 5, at - 5), F.col("price")), trade(at, of(15, F.lit(None).cast("double"), F.col("price")))).alias("trades"),
            F.array(F.struct("recv_ts_ms", "bid_price", "bid_qty", "ask_price", "ask_qty", of(9, at, time).alias("event_ts_ms"), time.alias("transaction_ts_ms"))).alias("book_ticker"),
            (liq if name == "futures" else F.when(fault == 10, liq).otherwise(F.slice(liq, 1, 0))).alias("liquidations"),
            F.array(F.struct("recv_ts_ms", at.alias("event_ts_ms"), time.alias("transaction_ts_ms"), of(14, null, time, "futures").alias("prev_final_id"))).alias("depth_updates"),
            snap(of(8, null, time, "futures"), near).alias("depth_start"), snap(time, of(7, far, near)).alias("depth_latest"), bands.alias("depth_bands"), F.create_map(F.lit("trades"), at).alias("last_event_times"),
        )

    trigger = F.struct(bad(3, F.lit("other"), F.lit("time")).alias("kind"), bad(4, F.lit("spot"), F.lit(None).cast("string")).alias("venue"))
    body = F.struct(bad(1, F.lit(4), F.lit(5)).alias("schema_version"), "asset", at.alias("current_time_ms"), bad(2, F.lit(60), F.lit(10)).alias("horizon_seconds"), F.lit(100).alias("num_percentiles"), trigger.alias("trigger"), F.struct(venue("spot").alias("spot"), venue("futures").alias("futures")).alias("venues"))
    path = fresh(spark, "judged")
    t.select(F.to_json(body).alias("value")).write.options(**PACKED, maxRecordsPerFile=10_000).text(path)
    judged = payloads.saved_payload_violations(spark.read.schema(files.PAYLOAD).json(path), assets={a: (a.upper(), 0.5) for a in ("click", "error", "purchase")}, kinds=("time", "event"), bars=2, bar_ms=1000)
    return judged.select("asset", "current_time_ms", F.array_join("codes", ",").alias("codes"))
