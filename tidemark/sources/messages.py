"""Raw exchange messages as typed tables; works on batch and streaming text alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.quotes import to_ms

LEVEL = "array<array<string>>"
#: Fields of a message and their columns; Spark's names ignore case, the messages' don't.
FIELDS = {"e": "event", "E": "event_time", "T": "trade_time", "p": "p_", "q": "q_", "m": "maker", "b": "bid", "B": "bid_size", "a": "ask", "A": "ask_size", "U": "first_u", "u": "last_u", "pu": "prev_u", "k": "kline", "o": "order"}


def read_raw_messages(lines: DataFrame, *, value: str = "value") -> DataFrame:
    """The fields of each message (see ``FIELDS``) and ``stream``: envelopes opened, acknowledgements
    and malformed lines left out.

    ``stream`` is the envelope's name, else the event name, else null. Other columns stay. Each
    message is parsed twice in all, as envelope and as body.
    """
    outer = lines.filter(F.ltrim(value).startswith("{")).select("*", F.json_tuple(value, "stream", "data", "id").alias("__stream", "__data", "__id"))
    ack = F.col("__id").isNotNull() & F.col(value).contains('"result"')
    body = F.when(F.col("__data").startswith("{"), F.col("__data")).otherwise(F.col(value))
    inner = outer.filter(~ack).withColumn("__body", body).select("*", F.json_tuple("__body", *FIELDS).alias(*FIELDS.values()))
    some = F.coalesce("event", "bid", "first_u", "kline", "order").isNotNull()
    return inner.filter(some).withColumn("stream", F.coalesce("__stream", "event")).drop(value, "__stream", "__data", "__id", "__body")


def _num(name: str) -> Column:
    return F.col(name).try_cast("double")


def _ms(name: str) -> Column:
    return to_ms(F.col(name).try_cast("long"))


def kind() -> Column:
    """What a message is. A spot quote has no event name: prices and sizes without update ids."""
    e, stream = F.col("event"), F.coalesce(F.col("stream"), F.lit(""))
    sided = F.col("bid").isNotNull() & F.col("bid_size").isNotNull() & F.col("ask").isNotNull() & F.col("ask_size").isNotNull()
    quote = sided & ~F.col("bid").startswith("[") & F.col("first_u").isNull()
    return (
        F.when(e.isin("aggTrade", "trade"), "trade").when(e == "kline", "kline").when(e == "forceOrder", "liquidation")
        .when((e == "depthUpdate") | (F.col("first_u").isNotNull() & F.col("bid").startswith("[")), "depth")
        .when((e == "bookTicker") | stream.endswith("bookTicker") | quote, "quote")
    )


def normalize_trades(m: DataFrame, *, keep: list[str]) -> DataFrame:
    return m.filter(kind() == "trade").select(*keep, _ms("trade_time").alias("ts_ms"), _ms("event_time").alias("event_ts_ms"), "recv_ts_ms", _num("p_").alias("price"), _num("q_").alias("qty"), (F.col("maker") == "true").alias("buyer_is_maker"))


def normalize_book_ticker(m: DataFrame, *, keep: list[str]) -> DataFrame:
    """Quotes; exchange times are null where the message has none."""
    return m.filter(kind() == "quote").select(*keep, "recv_ts_ms", _num("bid").alias("bid_price"), _num("bid_size").alias("bid_qty"), _num("ask").alias("ask_price"), _num("ask_size").alias("ask_qty"), _ms("event_time").alias("event_ts_ms"), _ms("trade_time").alias("transaction_ts_ms"))


def _levels(name: str) -> Column:
    rows = F.from_json(F.col(name), LEVEL)
    return F.coalesce(F.transform(rows, lambda x: F.struct(F.get(x, 0).try_cast("double").alias("price"), F.get(x, 1).try_cast("double").alias("qty"))), F.array().cast("array<struct<price:double,qty:double>>"))


def normalize_depth_updates(m: DataFrame, *, keep: list[str]) -> DataFrame:
    """Diffs with ``prev_final_id`` as sent (null on spot); see ``chained``."""
    return m.filter(kind() == "depth").select(*keep, "recv_ts_ms", _ms("event_time").alias("event_ts_ms"), _ms("trade_time").alias("transaction_ts_ms"), F.col("first_u").try_cast("long").alias("first_id"), F.col("last_u").try_cast("long").alias("final_id"), F.col("prev_u").try_cast("long").alias("prev_final_id"), _levels("bid").alias("bids"), _levels("ask").alias("asks"))


def chained(updates: DataFrame, *, keys: list[str], order: str) -> DataFrame:
    """A missing ``prev_final_id`` is the row before's last id, or one less than the first id."""
    before = F.lag("final_id").over(Window.partitionBy(*keys).orderBy(order))
    return updates.withColumn("prev_final_id", F.coalesce("prev_final_id", before, F.col("first_id") - 1))


def normalize_klines(m: DataFrame, *, keep: list[str]) -> DataFrame:
    k = m.filter(kind() == "kline").select(*keep, F.from_json("kline", "t long, o string, h string, l string, c string, v string, x boolean").alias("k"))
    parts = {"open": "o", "high": "h", "low": "l", "close": "c", "volume": "v"}
    return k.select(*keep, to_ms("k.t").alias("open_time_ms"), *[_num(f"k.{n}").alias(c) for c, n in parts.items()], F.col("k.x").alias("closed"))


def normalize_liquidations(m: DataFrame, *, keep: list[str]) -> DataFrame:
    """Average price, else the order's; filled quantity, else the order's; the order's own side."""
    o = m.filter(kind() == "liquidation").withColumn("o", F.from_json("order", "S string, p string, ap string, q string, z string, T long"))

    def first(a: str, b: str) -> Column:
        pick = lambda n: F.when(_num(n) != 0, _num(n))
        return F.coalesce(pick(a), pick(b), F.lit(0.0))

    return o.select(*keep, F.coalesce(to_ms("o.T"), _ms("event_time"), F.col("recv_ts_ms")).alias("ts_ms"), "recv_ts_ms", first("o.ap", "o.p").alias("price"), first("o.z", "o.q").alias("qty"), (F.upper("o.S") == "BUY").alias("is_buy"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)
