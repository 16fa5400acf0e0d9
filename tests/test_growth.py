"""What the queries move and write as the tables grow."""

import glob

from pyspark.sql import functions as F

from tidemark.operators import payloads
from tidemark.plans import captures, queries
from tidemark.streaming import jobs

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_replay_moves_ticks_not_levels(spark):
    logical, physical = plan(queries.t5_replay_book(spark, SF))
    assert "Join" not in logical and physical.count("Exchange hashpartitioning") == 1


def test_stream_slices_have_files_for_their_rows(spark, monkeypatch):
    paths = []
    monkeypatch.setattr(captures, "FILE_ROWS", 40)
    monkeypatch.setattr(captures, "fresh", lambda s, n, f=captures.fresh: paths.append(f(s, n)) or paths[-1])
    rows = spark.range(0, 600, 1, 2).select(F.lit("a").alias("asset"), F.col("id").alias("seq"), (F.col("id") * 1000).alias("recv_ts_ms"))
    got = captures.drained(captures.streamed(spark, rows, "many", beat=True), "many-out")
    written = spark.read.parquet(paths[0])
    assert len(written.inputFiles()) == 5 * 5  # three slices and two beats, each a micro-batch
    spans = got.filter("asset <> ''").groupBy("batch").agg(F.min("seq"), F.max("seq"), F.count("seq")).orderBy("batch").collect()
    assert [tuple(r)[1:] for r in spans] == [(0, 199, 200), (200, 399, 200), (400, 599, 200)]
    assert got.filter("asset = ''").select("batch").distinct().count() == 2


def test_stream_labels_deal_by_time_too(spark):
    prompts = [("a", t) for t in (0, 99, 100, 101, 150, 700)] + [("b", 100)]
    quotes = [("a", t, i) for i, t in enumerate((0, 99, 100, 120, 199, 200, 201, 250, 251, 400))]
    p, q = spark.createDataFrame(prompts, "asset string, current_time_ms long"), spark.createDataFrame(quotes, "asset string, recv_ts_ms long, seq long")
    out = jobs.stream_labels(p, q, horizon_ms=100, delay="1 hour")
    assert "p_part" in plan(out)[0]  # or each prompt looks at all quotes of its asset
    want = {(a, at): max(((t, s) for k, t, s in quotes if k == a and at < t <= at + 100), default=(None, None)) for a, at in prompts}
    assert {(r["asset"], r["current_time_ms"]): (r["recv_ts_ms"], r["seq"]) for r in out.collect()} == want


def test_band_imbalance_joins_nothing(spark):
    assert "Join" not in plan(queries.a8_band_imbalance(spark, SF))[0]


def test_s14_depth_csv_writes_packed_files(spark, monkeypatch):
    paths = []
    monkeypatch.setattr(captures, "fresh", lambda s, n, f=captures.fresh: paths.append(f(s, n)) or paths[-1])
    captures.s14_depth_csv(spark, SF)
    assert glob.glob(paths[-1].removeprefix("file://") + "/*.csv.gz") and not glob.glob(paths[-1].removeprefix("file://") + "/*.csv")


def test_p6_payload_rules_writes_packed_files(spark, monkeypatch):
    paths = []
    monkeypatch.setattr(captures, "fresh", lambda s, n, f=captures.fresh: paths.append(f(s, n)) or paths[-1])
    captures.p6_payload_rules(spark, SF)
    assert glob.glob(paths[-1].removeprefix("file://") + "/*.txt.gz") and not glob.glob(paths[-1].removeprefix("file://") + "/*.txt")


def test_payload_rows_go_to_two_buckets_and_few_prompts_a_task(spark, monkeypatch):
    widths = []
    monkeypatch.setattr(payloads, "_tagged", lambda streams, lives, width, f=payloads._tagged: widths.append((lives, width)) or f(streams, lives, width))
    physical = plan(captures.q5_assembled_payloads(spark, SF))[1]
    lives, width = widths[0]
    assert all(life <= width for life in lives.values())
    assert physical.count("REPARTITION_BY_NUM") == 2  # and no other exchange between these and the fold
