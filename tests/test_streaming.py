import shutil
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import candles as C
from tidemark.plans import queries
from tidemark.sources import ticks as T
from tidemark.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ticks") / "t")
    t = T.ticks(spark, SF).drop("props")
    for part in ("seq < 300", "seq between 300 and 699", "seq >= 700"):  # files in the order of time
        t.filter(part).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1)
    return path


def drained(spark, df, tmp, mode="append"):
    out, check = str(tmp / "out"), str(tmp / "check")
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def read(spark, path):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_candles_equal_batch(spark, source, tmp_path):
    got = drained(spark, jobs.stream_candles(read(spark, source), keys=T.KEY, bar="1 hour", delay="30 days"), tmp_path)
    got2 = jobs.stream_candles(spark.read.parquet(source), keys=T.KEY, bar="1 hour", delay="30 days")
    want = C.candles_from_trades(spark.read.parquet(source), keys=T.KEY, ts="recv_ts_ms", bar_ms=T.HOUR)
    assert got2.select(*want.columns).exceptAll(want).count() == 0 and got2.count() == want.count()
    assert got.select(*want.columns).exceptAll(want).count() == 0


@pytest.mark.parametrize("part, beside", [("part-0.parquet", "events_old.parquet"), ("part-0", "orders.parquet")])  # a table's files need no ending
def test_candles_read_the_events_table_alone(spark, tmp_path, part, beside):
    (tmp_path / "events.parquet").mkdir()
    shutil.copy(f"{SF}/events.parquet", tmp_path / "events.parquet" / part)
    shutil.copy("/root/testdata/sf0.01/events.parquet", tmp_path / beside)
    want = jobs.stream_candles(T.ticks(spark, SF), keys=T.KEY, bar="1 hour", delay="1 hour")
    got = queries.x1_stream_candles(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_moves_keep_state_across_batches(spark, source, tmp_path):
    got = drained(spark, jobs.stream_moves(read(spark, source), keys=T.KEY, tick=0.5, delay="1 hour"), tmp_path)
    rows = spark.read.parquet(source).sort("recv_ts_ms", "seq").collect()
    reference, want = {}, set()
    for r in rows:
        k = (r["asset"], r["venue"])
        move = k in reference and abs(r["price"] - reference[k]) / 0.5 > 1 + 1e-6
        if move:
            want.add(r["seq"])
        if move or k not in reference:
            reference[k] = r["price"]
    assert {r["seq"] for r in got.collect()} == want and want


def slices(spark, df, path, ts, cuts):
    """Files in the order of time, one a micro-batch, and a late row that closes what waits."""
    for lo, hi in zip(cuts, cuts[1:]):
        df.filter(F.col(ts).between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(path)
    for late in (10**11, 2 * 10**11):
        spark.range(1).select(*[F.lit(cuts[-1] + late if f.name == ts else "" if f.name == "asset" else None).cast(f.dataType).alias(f.name) for f in df.schema]).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_labels_are_one_row_a_prompt(spark, tmp_path):
    """Prompts with quotes in the window, on its ends, and without any; the last one waits for the watermarks."""
    p = spark.createDataFrame([("a", t) for t in range(10_000, 100_000, 10_000)] + [("b", 5_000)], "asset string, current_time_ms long")
    q = spark.createDataFrame([("a", i, t, 1.0 + i, 2.0) for i, t in enumerate((10_000, 12_000, 15_000, 15_001, 20_000, 47_000, 49_999, 96_000))], "asset string, seq long, recv_ts_ms long, bid_price double, ask_price double")
    cuts = [0, 25_000, 60_000, 100_000]
    stream = jobs.stream_labels(slices(spark, p, str(tmp_path / "p"), "current_time_ms", cuts), slices(spark, q, str(tmp_path / "q"), "recv_ts_ms", cuts), horizon_ms=5000, delay="5 seconds")
    got = [r for r in drained(spark, stream, tmp_path).collect() if r["asset"]]
    assert {(r["asset"], r["current_time_ms"]): r["seq"] for r in got} == {("a", t): {10_000: 2}.get(t) for t in range(10_000, 100_000, 10_000)} | {("b", 5_000): None}
    assert len(got) == 10


def test_group_moves_equal_the_batch(spark, source, tmp_path):
    from tidemark.operators import prompts

    t = spark.read.parquet(source)
    got = drained(spark, jobs.stream_group_moves(read(spark, source), keys=T.KEY, tick=0.5, delay="1 hour"), tmp_path)
    want = prompts.price_moves(prompts.trade_groups(t, keys=T.KEY), keys=T.KEY, tick=0.5).select(*got.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count() > 0


def test_retention_holds_lifetimes_only(spark, tmp_path):
    """Two hours of ticks, four a second: windows at prompts are right and state stays as small as the lifetimes."""
    lives = {"trades": 70_000, "depth": 180_000}
    ticks = [("a", "trades" if i % 4 else "depth", i * 250, float(i % 5)) for i in range(1, 7200 * 4)]
    asked = [("a", jobs.PROMPT, t, 0.0) for t in range(30_000, 7_200_000, 60_000)]
    df = spark.createDataFrame(ticks + asked, "asset string, stream string, recv_ts_ms long, size double")
    s = slices(spark, df, str(tmp_path / "s"), "recv_ts_ms", list(range(0, 7_200_001, 900_000)))
    name, partitions = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
    before = spark.conf.get(name), spark.conf.get(partitions)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set(partitions, "1")
    try:
        q = jobs.retained(s, keys=["asset"], lifetimes=lives, delay="1 second").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(name, before[0])
        spark.conf.set(partitions, before[1])
    got = {r["current_time_ms"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect() if r["asset"]}
    assert sorted(got) == [t for _, _, t, _ in asked]
    for t, r in got.items():
        for stream, life in lives.items():
            inside = [x for _, s, at, x in ticks if s == stream and t - life < at <= t]
            assert (r[f"n_{stream}"], r[f"size_{stream}"]) == (len(inside), sum(inside))
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(rows) < 200 and rows[-1] <= 8  # buckets, prompts and timers: a slice's and a lifetime's; then swept


class Held:
    """A map state that counts its reads."""

    def __init__(self):
        self.values, self.reads = {}, 0

    def getValue(self, k):
        self.reads += 1
        return self.values.get(k)

    def updateValue(self, k, v):
        self.values[k] = v

    def containsKey(self, k):
        return k in self.values

    def removeKey(self, k):
        self.values.pop(k)

    def keys(self):
        return iter(list(self.values))


class Clock:
    def __init__(self, at):
        self.at = at

    def getExpiryTimeInMs(self):
        return self.at

    def getCurrentWatermarkInMs(self):
        return 0


def test_retention_reads_state_by_the_quarter():
    """Packed quarters, each read once for prompts in a row, right after late rows and between two keys."""
    states, timers = {}, []
    job = jobs.Retention({"trades": 4000, "depth": 8000}, ["asset"])
    job.init(type("Handle", (), {"getMapState": lambda s, n, *_: states.setdefault(n, Held()), "registerTimer": lambda s, at: timers.append(at)})())
    ticks = [("trades" if i % 3 else "depth", 10 * i, float(i % 5)) for i in range(3000)]
    asked = [(jobs.PROMPT, t, 0.0) for t in range(5000, 25_000, 500)]
    table = lambda rows: pd.DataFrame(rows, columns=["stream", "recv_ts_ms", "size"])
    ends = lambda t, key=("a",): next(iter(job.handleExpiredTimer(key, Clock(0), Clock(t)))).iloc[0]
    sums = lambda rows, t: [f([x for s, at, x in rows if s == n and t - life < at <= t]) for n, life in job.lifetimes.items() for f in (len, sum)]
    columns = ["n_trades", "size_trades", "n_depth", "size_depth"]
    list(job.handleInputRows(("a",), iter([table(ticks[:700] + asked), table(ticks[700:]), table([(None, 0, None)])]), Clock(0)))
    assert all(isinstance(x, bytes) for v in states["buckets"].values.values() for x in v)
    assert set(timers) > {t for _, t, _ in asked}
    reads = states["buckets"].reads
    for _, t, _ in asked[:-2]:
        assert ends(t)[columns].tolist() == sums(ticks, t)
    assert states["buckets"].reads - reads <= len(states["buckets"].values)
    late = [("trades", 24_100, 7.0), ("depth", 20_100, 3.0)]
    list(job.handleInputRows(("a",), iter([table(late)]), Clock(0)))
    assert ends(24_500)[columns].tolist() == sums(ticks + late, 24_500)
    states["buckets"].values, kept = {}, states["buckets"].values  # the runtime shows another key's state
    assert ends(24_000, ("b",))[columns].tolist() == [0, 0.0, 0, 0.0]
    assert kept


def test_flow_sessions_and_samples_in_batch(spark, source):
    t = spark.read.parquet(source)
    assert jobs.sliding_flow(t, keys=T.KEY, window="2 hours", step="1 hour", delay="1 hour").agg(F.sum("n")).first()[0] == 2 * t.count()
    assert jobs.activity_sessions(t, keys=["asset"], gap="1 hour", delay="1 hour").agg(F.sum("n")).first()[0] == t.count()
    d = t.withColumns({"update_id": F.col("seq"), "bids": F.array(), "asks": F.array()})
    assert jobs.depth_samples(d, keys=T.KEY, every="1 hour", delay="1 hour").count() == C.candles_from_trades(t, keys=T.KEY, ts="recv_ts_ms", bar_ms=T.HOUR).count()


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    """Keys come once through the stream; a half-written batch is replaced, and older batches aren't touched or read."""
    t = spark.createDataFrame([("a", i, 1000 + i * 1000) for i in range(60)], "asset string, seq long, recv_ts_ms long")
    again = t.filter("seq % 4 = 0").withColumn("recv_ts_ms", F.col("recv_ts_ms") + 5000)
    s = slices(spark, t.union(again).union(t.filter("seq % 7 = 0")), str(tmp_path / "s"), "recv_ts_ms", [0, 21_000, 41_000, 67_000])
    out, seen = f"file://{tmp_path}/sink", []
    write = jobs.batch_folders(out)

    def twice(rows, number):
        rows.persist()
        write(rows.limit(2), number)
        write(rows, number)
        seen.append(number)
        rows.unpersist()

    jobs.once(s, keys=["asset", "seq"], delay="10 seconds").writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = [r["seq"] for r in spark.read.parquet(out).collect() if r["asset"]]
    assert sorted(got) == list(range(60)) and len(seen) >= 3
    write(spark.createDataFrame([("a", 999, 0)], t.schema), 0)
    after = spark.read.parquet(out).filter("batch > 0 and asset = 'a'").count()
    assert after == len(got) - len([x for x in got if x < 20])


def test_trailing_window_counts_ticks_of_its_instant(spark, tmp_path):
    path = str(tmp_path / "ties")
    rows = [("a", "spot", 1000, 1, 1.0), ("a", "spot", 2000, 2, 2.0), ("a", "spot", 2000, 3, 4.0), ("a", "spot", 2500, 4, 8.0)]
    t = spark.createDataFrame(rows, "asset string, venue string, recv_ts_ms long, seq long, qty double")
    t.coalesce(1).write.parquet(path)
    w = jobs.stream_trailing_window(spark.readStream.schema(t.schema).parquet(path), keys=["asset", "venue"], window_ms=1500, delay="1 hour")
    got = {r["seq"]: (r["n"], r["trailing"]) for r in drained(spark, w, tmp_path).collect()}
    assert got == {1: (1, 1.0), 2: (3, 7.0), 3: (3, 7.0), 4: (3, 14.0)}
