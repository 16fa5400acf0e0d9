"""Messages, snapshots and saved captures that the queries make of the given ticks, for the library to read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.scratch import fresh
from tidemark.sources.ticks import KEY, ticks

DAY = 86_400_000


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots with 20 levels a side, best first."""
    return depth_of(ticks(spark, sf_dir))


def depth_of(t: DataFrame, *more: str) -> DataFrame:
    """Ticks as snapshots, with ``more`` of their columns."""

    def side(touch: str, step: float):
        return F.transform(F.sequence(F.lit(0), F.lit(19)), lambda i: F.struct((F.col(touch) + i * F.lit(step)).alias("price"), (1 + (F.col("seq") + i) % 9).cast("double").alias("qty")))

    return t.select(*KEY, "seq", "recv_ts_ms", F.col("seq").alias("update_id"), side("bid_price", -0.01).alias("bids"), side("ask_price", 0.01).alias("asks"), *more)


def raw_from_ticks(ticks: DataFrame) -> DataFrame:
    """Ticks as raw messages, ``value`` beside ``asset, venue, seq, recv_ts_ms``: trades by default,
    each fifth a quote, each seventh a liquidation, some wrapped in envelopes, some broken."""
    s = F.col("seq")
    num = lambda c: F.format_string("%.4f", F.col(c))
    trade = F.to_json(F.struct(F.lit("aggTrade").alias("e"), F.col("recv_ts_ms").alias("E"), (F.col("ts_ms") * 1000).alias("T"), num("price").alias("p"), num("qty").alias("q"), F.col("buyer_is_maker").alias("m")))
    quote = F.to_json(F.struct(num("bid_price").alias("b"), num("bid_qty").alias("B"), num("ask_price").alias("a"), num("ask_qty").alias("A")))
    order = F.struct(F.when(F.col("is_buy"), "BUY").otherwise("SELL").alias("S"), num("price").alias("p"), F.lit("0").alias("ap"), num("qty").alias("q"), F.col("ts_ms").alias("T"))
    liq = F.to_json(F.struct(F.lit("forceOrder").alias("e"), F.col("recv_ts_ms").alias("E"), order.alias("o")))
    body = F.when(s % 7 == 0, liq).when(s % 5 == 0, quote).otherwise(trade)
    value = F.when(s % 97 == 0, "{broken").when(s % 89 == 0, '{"result":null,"id":1}').when(s % 3 == 0, F.concat(F.lit('{"stream":"s","data":'), body, F.lit("}"))).otherwise(body)
    return ticks.select("asset", "venue", "seq", "recv_ts_ms", value.alias("value"))


def payload_files(spark: SparkSession, sf_dir: str) -> str:
    """A database of pairs: a payload of all ticks of each asset and day, and the label book at its end, some broken or absent."""
    root = fresh(spark, "database")
    t = ticks(spark, sf_dir)
    trade = F.struct("ts_ms", F.col("recv_ts_ms").alias("event_ts_ms"), "recv_ts_ms", "price", "qty", "buyer_is_maker")
    quote = F.struct("recv_ts_ms", "bid_price", "bid_qty", "ask_price", "ask_qty")
    held = lambda venue, row: F.transform(F.array_sort(F.collect_list(F.when(F.col("venue") == venue, F.struct("seq", row.alias("row"))))), lambda x: x["row"])
    last = F.max_by(F.struct("recv_ts_ms", "bid_price", "bid_qty", "ask_price", "ask_qty"), F.when(F.col("venue") == "spot", F.col("seq")))
    per = t.groupBy("asset", ((F.floor(F.col("ts_ms") / DAY) + 1) * DAY).cast("long").alias("folder_ms")).agg(held("spot", trade).alias("st"), held("spot", quote).alias("sq"), held("futures", trade).alias("ft"), last.alias("last"))
    spot = F.struct(F.col("st").alias("trades"), F.col("sq").alias("book_ticker"), F.array(F.struct(F.lit(1).alias("first_id"))).alias("depth_updates"))
    venues = F.struct(spot.alias("spot"), F.struct(F.col("ft").alias("trades")).alias("futures")).alias("venues")
    body = F.struct(F.lit(5).alias("schema_version"), "asset", F.col("folder_ms").alias("current_time_ms"), venues, F.lit("x").alias("unknown"))
    book = F.struct(F.col("folder_ms").alias("current_time_ms"), "last.*")
    day = F.col("folder_ms") / DAY
    books = F.when(day % 7 == 0, "\x00\x00").otherwise(F.to_json(book))
    both = F.array(*[F.struct(F.lit(kind).alias("kind"), value.alias("value")) for kind, value in (("payload", F.to_json(body)), ("book", books))])
    rows = per.select("asset", "folder_ms", "last", F.inline(both)).filter((F.col("kind") == "payload") | ((day % 5 != 0) & F.col("last").isNotNull()))
    rows.select("asset", "folder_ms", "kind", "value").write.partitionBy("asset", "folder_ms", "kind").text(root)
    return root
