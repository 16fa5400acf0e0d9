"""History archives, saved payloads and reports: readers and writers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.quotes import to_ms
from tidemark.operators.prompts import numbered

LEVELS = "array<struct<price:double,qty:double>>"
SNAPSHOT = f"struct<recv_ts_ms:bigint,update_id:bigint,event_ts_ms:bigint,transaction_ts_ms:bigint,bids:{LEVELS},asks:{LEVELS}>"
UPDATE = f"struct<recv_ts_ms:bigint,event_ts_ms:bigint,transaction_ts_ms:bigint,first_id:bigint,final_id:bigint,prev_final_id:bigint,bids:{LEVELS},asks:{LEVELS}>"
#: One venue of a payload: its streams as arrays of rows, two depth snapshots, bands, and the streams' last times.
STREAMS = {
    "candles_1s": "array<struct<open_time_ms:bigint,open:double,high:double,low:double,close:double,volume:double>>",
    "trades": "array<struct<ts_ms:bigint,event_ts_ms:bigint,recv_ts_ms:bigint,price:double,qty:double,buyer_is_maker:boolean>>",
    "book_ticker": "array<struct<recv_ts_ms:bigint,bid_price:double,bid_qty:double,ask_price:double,ask_qty:double,event_ts_ms:bigint,transaction_ts_ms:bigint>>",
    "liquidations": "array<struct<ts_ms:bigint,recv_ts_ms:bigint,price:double,qty:double,is_buy:boolean>>",
    "depth_updates": f"array<{UPDATE}>",
}
VENUE = f"struct<symbol:string,complete_history:boolean,{','.join(f'{n}:{k}' for n, k in STREAMS.items())},depth_start:{SNAPSHOT},depth_latest:{SNAPSHOT},depth_bands:struct<anchor_price:double,bucket_usd:double,bids:array<double>,asks:array<double>,recv_ts_ms:bigint>,last_event_times:map<string,bigint>>"
PAYLOAD = f"schema_version int, asset string, current_time_ms bigint, horizon_seconds int, num_percentiles int, trigger struct<kind:string,venue:string>, venues struct<spot:{VENUE},futures:{VENUE}>"
SCORING = PAYLOAD.replace(f",depth_updates:array<{UPDATE}>", "")
BOOK = "current_time_ms bigint, target_ms bigint, recv_ts_ms bigint, bid_price double, bid_qty double, ask_price double, ask_qty double"
REPORT = ("test", "current_time_ms", "start", "target", "book_recv_ts_ms", "realized", "crps", "predict_ms")


def _typed(df: DataFrame, **kinds: str) -> DataFrame:
    return df.select(*[F.col(c).try_cast(k).alias(c) for c, k in kinds.items()])


def read_trades_csv(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=True)
    maker = F.lower(F.trim("buyer_is_maker")).isin("true", "1")
    return raw.select(F.col("agg_trade_id").try_cast("long").alias("seq"), to_ms(F.col("ts_ms").try_cast("long")).alias("ts_ms"), F.col("price").try_cast("double").alias("price"), F.col("qty").try_cast("double").alias("qty"), maker.alias("buyer_is_maker"))


def read_depth_csv(spark: SparkSession, path: str) -> DataFrame:
    """One snapshot per receipt and update; sides by level; blank exchange times are null."""
    raw = spark.read.csv(path, header=True)
    t = _typed(raw, recv_ts_ms="long", update_id="long", event_ts_ms="long", transaction_ts_ms="long", side="string", level="int", price="double", qty="double")

    def side(name: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("side") == name, F.struct("level", "price", "qty"))))
        return F.transform(rows, lambda x: F.struct(x["price"].alias("price"), x["qty"].alias("qty")))

    return t.groupBy("recv_ts_ms", "update_id").agg(F.first("event_ts_ms").alias("event_ts_ms"), F.first("transaction_ts_ms").alias("transaction_ts_ms"), side("bid").alias("bids"), side("ask").alias("asks"))


def read_kline_archive(spark: SparkSession, path: str) -> DataFrame:
    """Archived candles without header; a header row and other malformed rows go."""
    names = ["open_time_ms", "open", "high", "low", "close", "volume"]
    raw = spark.read.csv(path, header=False)
    t = raw.select(*[F.col(f"_c{i}").try_cast("long" if i == 0 else "double").alias(n) for i, n in enumerate(names)])
    return t.filter("open_time_ms is not null").withColumn("open_time_ms", to_ms("open_time_ms"))


def read_book_depth_archive(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.csv(path, header=False)
    at = F.unix_millis(F.try_to_timestamp("_c0", F.lit("yyyy-MM-dd HH:mm:ss")))
    return raw.select(at.alias("recv_ts_ms"), F.col("_c1").try_cast("double").alias("percentage"), F.col("_c2").try_cast("double").alias("depth"), F.col("_c3").try_cast("double").alias("notional")).filter("recv_ts_ms is not null")


def read_book_ticker_archive(spark: SparkSession, path: str) -> DataFrame:
    """Archived quotes; the event time stands for the receipt."""
    names = [("update_id", "long"), ("bid_price", "double"), ("bid_qty", "double"), ("ask_price", "double"), ("ask_qty", "double"), ("transaction_ts_ms", "long"), ("event_ts_ms", "long")]
    raw = spark.read.csv(path, header=False)
    return raw.select(*[F.col(f"_c{i}").try_cast(k).alias(n) for i, (n, k) in enumerate(names)]).filter("update_id is not null").withColumn("recv_ts_ms", F.col("event_ts_ms"))


def book_from_percent_levels(rows: DataFrame) -> DataFrame:
    """Levels by percentage as a book: price is notional over depth, the sign gives the side, best first."""
    ok = rows.filter("depth > 0").withColumn("price", F.col("notional") / F.col("depth")).withColumn("side", F.when(F.col("percentage") < 0, "bid").otherwise("ask"))
    level = F.struct(F.abs("percentage").alias("far"), "price", F.col("depth").alias("qty"))
    cut = lambda name: F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == name, level))), lambda x: F.struct(x["price"].alias("price"), x["qty"].alias("qty")))
    return ok.groupBy("recv_ts_ms").agg(cut("bid").alias("bids"), cut("ask").alias("asks"))


def book_from_candles(candles: DataFrame, *, spread: Column, bid_qty: Column, ask_qty: Column) -> DataFrame:
    """A quote about each close: half the template's spread either way, its sizes."""
    return candles.select("*", (F.col("close") - spread / 2).alias("bid_price"), (F.col("close") + spread / 2).alias("ask_price"), bid_qty.alias("bid_qty"), ask_qty.alias("ask_qty"))


def _folder() -> list[Column]:
    """The asset and the instant that a file's folders name."""
    path, end = F.col("_metadata.file_path"), r"(?:[a-z_]+=)?(\d+)/(?:kind=[a-z]+/)?[^/]*$"
    return [F.regexp_extract(path, r"/(?:[a-z_]+=)?([^/=]+)/" + end, 1).alias("asset"), F.regexp_extract(path, "/" + end, 1).try_cast("long").alias("folder_ms")]


def read_payloads(spark: SparkSession, path: str, *, schema: str = PAYLOAD) -> DataFrame:
    """Saved payloads, one JSON a file; fields that came later are empty when absent, unknown ones dropped.

    The prompt's folder (``.../asset/ms/``, or named by partition, ``asset=../folder_ms=../kind=..``) gives
    ``folder_ms``; rows of other folders go.
    """
    raw = spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path, multiLine=True)
    return raw.select("*", _folder()[1].alias("folder_ms")).filter("folder_ms is not null")


def read_payloads_for_scoring(spark: SparkSession, path: str) -> DataFrame:
    """Saved payloads with only what a forecast reads: no tape of depth updates is parsed at all."""
    return read_payloads(spark, path, schema=SCORING)


def read_saved_pairs(spark: SparkSession, database: str, *, payload: str = "payload.json", book: str = "book.json") -> DataFrame:
    """``folder_ms, payload, book, readable`` for each complete pair under ``database/asset/ms/``, by folder.

    ``payload`` and ``book`` name the files, or folders of kinds, within.

    A pair is a payload and a book in one numbered folder; folders that lack either and those
    without a number go. A book that is no JSON object is null and not ``readable``: it is
    counted, never fatal. ``asset`` is the folder's.
    """
    at = _folder()
    books = spark.read.text(f"{database}/*/*/{book}", wholetext=True).select(*at, F.from_json("value", BOOK).alias("book"), F.ltrim("value").startswith("{").alias("__object"))
    payloads = spark.read.schema(SCORING).json(f"{database}/*/*/{payload}", multiLine=True)
    named = payloads.select(*at, F.struct(*payloads.columns).alias("payload"))
    whole = F.coalesce(F.col("__object") & F.col("book.bid_price").isNotNull(), F.lit(False)) | F.coalesce(F.col("__object") & F.col("book.current_time_ms").isNotNull(), F.lit(False))
    return named.join(books, ["asset", "folder_ms"]).filter("folder_ms is not null").select("asset", "folder_ms", "payload", F.when(whole, F.col("book")).alias("book"), whole.alias("readable"))


def exploded(payloads: DataFrame, *, venue: str, stream: str) -> DataFrame:
    """One stream of one venue as rows of the normalised table."""
    rows = F.posexplode(F.col(f"venues.{venue}.{stream}"))
    out = payloads.select("asset", "current_time_ms", F.lit(venue).alias("venue"), rows.alias("seq", "r"))
    return out.select("asset", "current_time_ms", "venue", "seq", "r.*")


def write_payloads(payloads: DataFrame, path: str) -> None:
    """JSON by asset and prompt."""
    out = payloads.withColumn("prompt_ms", F.col("current_time_ms")).withColumn("asset_key", F.col("asset"))
    out.write.mode("append").partitionBy("asset_key", "prompt_ms").json(path)


def score_report(scores: DataFrame, *, by: list[str] | None = None) -> DataFrame:
    """The report's eight columns, numbered in the order of time; blanks for what is missing.

    ``by`` names columns (asset, model) of several runs in one table: they stay, and each run has
    numbers of its own.
    """
    by = by or []
    iso = lambda c: F.date_format(F.timestamp_millis(F.col(c)), "yyyy-MM-dd'T'HH:mm:ss.SSS'+00:00'")
    shown = lambda c, p: F.when(F.col(c).isNull(), "").otherwise(F.format_string(f"%.{p}f", F.col(c)))
    rows = numbered(scores, by=by, ts="current_time_ms", name="test")
    return rows.select(*by, "test", "current_time_ms", iso("current_time_ms").alias("start"), iso("target_ms").alias("target"), "book_recv_ts_ms", shown("realized", 6).alias("realized"), shown("crps", 6).alias("crps"), shown("predict_ms", 3).alias("predict_ms"))


def write_score_csv(scores: DataFrame, path: str) -> None:
    score_report(scores).sort("test").write.mode("overwrite").csv(path, header=True)


def kept_captures(captures: DataFrame, *, now_ms: int, keep_ms: int = 7 * 86_400_000) -> DataFrame:
    """Captures not older than the retention; the edge stays; folders without a number are none."""
    ms = F.col("folder").try_cast("long")
    return captures.filter(ms.isNotNull() & (ms >= now_ms - keep_ms))


def prune_captures(spark: SparkSession, database: str, *, now_ms: int, keep_ms: int = 7 * 86_400_000) -> int:
    """Deletes the folders ``database/asset/ms`` older than the retention, as ``kept_captures`` judges them; how many went.

    The session's file system does it, a call a folder; the edge and folders without a number stay.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(database).getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    for found in fs.globStatus(path(f"{database}/*/*")) or []:
        name = found.getPath().getName().rpartition("=")[2]
        if found.isDirectory() and name.isdecimal() and int(name) < now_ms - keep_ms:
            gone += bool(fs.delete(found.getPath(), True))
    return gone
