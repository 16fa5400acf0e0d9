"""The events table as tick tables, and small dimensions derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR = 3_600_000
KEY = ["asset", "venue"]


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trades and quotes of one row: the projections of the fixtures."""
    return from_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def from_events(e: DataFrame) -> DataFrame:
    """Events, read or streamed, as ticks."""
    recv = F.unix_millis(F.col("ts").cast("timestamp"))
    price = F.floor((F.lit(100.0) + F.col("value") / 100) * 100 + 0.5) / 100
    t = e.select(
        F.col("event_type").alias("asset"),
        F.when(F.col("user_id") % 2 == 0, "spot").otherwise("futures").alias("venue"),
        F.col("event_id").alias("seq"),
        recv.alias("recv_ts_ms"),
        (recv - recv % HOUR).alias("ts_ms"),
        price.alias("price"),
        (1 + F.col("event_id") % 7).cast("double").alias("qty"),
        (F.col("event_id") % 2 == 1).alias("buyer_is_maker"),
        (F.col("user_id") % 3 == 0).alias("is_buy"),
        "props",
    )
    return t.withColumns({
        "bid_price": F.col("price") - 0.01 * (1 + F.col("seq") % 3),
        "ask_price": F.col("price") + 0.01 * (1 + F.col("seq") % 2),
        "bid_qty": (1 + F.col("seq") % 5).cast("double"),
        "ask_qty": (1 + F.col("seq") % 4).cast("double"),
    })


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).select(*KEY, "seq", "recv_ts_ms", "ts_ms", "price", "qty", "buyer_is_maker")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).select(*KEY, "seq", "recv_ts_ms", "bid_price", "bid_qty", "ask_price", "ask_qty")


def liquidations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ticks(spark, sf_dir).filter("asset = 'error'").select("asset", "seq", "recv_ts_ms", "price", "qty", "is_buy")


def clock_prompts(spark: SparkSession, sf_dir: str, *, clock: int = HOUR) -> DataFrame:
    """Prompts of each asset on the clock, from its first tick to its last."""
    span = ticks(spark, sf_dir).groupBy("asset").agg(F.min("recv_ts_ms").alias("lo"), F.max("recv_ts_ms").alias("hi"))
    first = F.col("lo") + F.pmod(-F.col("lo"), F.lit(clock))
    return span.filter(first <= F.col("hi")).select("asset", F.explode(F.sequence(first, F.col("hi"), F.lit(clock).cast("long"))).alias("current_time_ms"))
