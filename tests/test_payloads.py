"""Whole payloads: what is picked, and what moves."""

from pyspark.sql import functions as F

from tidemark.operators import payloads

KINDS = {"candles_1s": "open_time_ms long, open double, high double, low double, close double, volume double", "trades": "ts_ms long, event_ts_ms long, recv_ts_ms long, price double, qty double, buyer_is_maker boolean", "book_ticker": "recv_ts_ms long, bid_price double, bid_qty double, ask_price double, ask_qty double, event_ts_ms long, transaction_ts_ms long", "liquidations": "ts_ms long, recv_ts_ms long, price double, qty double, is_buy boolean", "depth_updates": "recv_ts_ms long, event_ts_ms long, transaction_ts_ms long, first_id long, final_id long, prev_final_id long, bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>"}


def whole(spark, prompts, snapshots, made):
    none = {n: spark.createDataFrame([], f"asset string, venue string, at long, seq long, {k}") for n, k in KINDS.items()}
    levels = "array<struct<price:double,qty:double>>"
    d = spark.createDataFrame(snapshots, f"asset string, venue string, at long, seq long, update_id long, bids {levels}, asks {levels}").withColumn("recv_ts_ms", F.col("at"))
    null = F.lit(None).cast("long")
    streams = none | {"depth": d.withColumns({"event_ts_ms": null, "transaction_ts_ms": null}), "bands": d}
    p = spark.createDataFrame(prompts, "asset string, current_time_ms long").withColumns({"kind": F.lit("time"), "venue": F.lit(None).cast("string")})
    lives = {n: 100 for n in payloads.STREAM_FIELDS}
    return payloads.whole_payloads(p, streams, assets={"a": ("A", 0.5)}, lives=lives, bars=2, bar_ms=10, back_ms=50, tolerance_ms=30, bridge_ms=20, made={"bands": made})


def test_only_picked_snapshots_move(spark):
    seen = spark.sparkContext.accumulator(0)

    def made(rows):
        def counted(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        rows = rows.mapInArrow(counted, rows.schema)
        sizes = lambda c: F.transform(c, lambda x: x["qty"])
        return rows.withColumns({"anchor_price": F.lit(1.0), "bids": sizes("bids"), "asks": sizes("asks")})

    level = [(1.0, 2.0)]
    snapshots = [("a", "spot", t, 10 * t + k, 10 * t + k, level, level) for t in range(0, 400, 4) for k in range(3)]  # three an instant
    prompts = [("a", 200), ("a", 200), ("a", 381), ("a", 9000), (None, 200), ("b", 200), ("a", None)]
    w = whole(spark, prompts, snapshots, made)
    assert "hashpartitioning(__id" not in w._jdf.queryExecution().toString()  # neither window rows nor payloads move by prompt
    ids = [F.col(f"venues.spot.{n}.update_id").alias(n) for n in ("depth_start", "depth_latest")]
    got = sorted(map(tuple, w.select("asset", "current_time_ms", *ids, "venues.spot.depth_bands.recv_ts_ms").collect()), key=str)
    none = (None, None, 0)
    # at 200: the last of 200's three; 148 and 152 are as near to 150, the earlier counts, of it the first
    assert got == sorted([("a", 200, 1480, 2002, 200)] * 2 + [("a", 381, 3320, 3802, 380), ("a", 9000, *none), (None, 200, *none), ("b", 200, *none), ("a", None, *none)], key=str)
    assert seen.value <= 4  # bands of two snapshots, made once or twice, not of 300


def test_windows_are_slices_of_a_bucket_held_once(spark):
    at = [(37 * i * i + 11 * i) % 500 for i in range(300)]  # out of order, some instants shared
    venues = ["spot", "futures", "other", None]
    tick = [("a" if i % 7 else None, venues[i * i % 11 % 4], t, i) for i, t in enumerate(at)]
    trades = [(*k, t, t, t, float(k[3]), 1.0, True) for k, t in zip(tick, at, strict=True)]
    updates = [(*k, t, t, None, None if i % 13 == 0 else i - 2, i + 40, None, [(float(i), 1.0)] if i % 3 else [], None if i % 5 else []) for i, (k, t) in enumerate(zip(tick, at, strict=True))]
    books = [(*k, t, k[3]) for k, t in zip(tick, at, strict=True) if k[3] % 9 == 0]
    levels = "array<struct<price:double,qty:double>>"
    place = "asset string, venue string, at long, seq long"
    streams = {n: spark.createDataFrame([], f"{place}, {k}") for n, k in KINDS.items()} | {n: spark.createDataFrame(x, f"{place}, {KINDS[n]}") for n, x in (("trades", trades), ("depth_updates", updates))}
    null, none = F.lit(None).cast("long"), F.array().cast(levels)
    d = spark.createDataFrame(books, f"{place}, recv_ts_ms long, update_id long").withColumns({"event_ts_ms": null, "transaction_ts_ms": null, "bids": none, "asks": none})
    streams |= {"depth": d, "bands": d.filter("false").select(*place.replace(" string", "").replace(" long", "").split(", "), "recv_ts_ms", F.lit(1.0).alias("anchor_price"), F.array(F.lit(1.0)).alias("bids"), F.array(F.lit(1.0)).alias("asks"))}
    prompts = [("a", t) for t in (*range(0, 700, 35), 210)] + [("b", 100), (None, 100), ("a", None)]
    p = spark.createDataFrame(prompts, "asset string, current_time_ms long").withColumns({"kind": F.lit("time"), "venue": F.lit(None).cast("string")})
    lives = {n: 100 for n in payloads.STREAM_FIELDS} | {"depth_updates": 230}
    w = payloads.whole_payloads(p, streams, assets={"a": ("A", 0.5)}, lives=lives, bars=2, bar_ms=10, back_ms=50, tolerance_ms=30, bridge_ms=20)
    logical = w._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in logical and "Join" not in logical  # or a task holds each row once a prompt

    def seen(rows, now, v, life):
        return sorted((r for r in rows if r[0] == "a" and r[1] == v and now is not None and now - life < r[2] <= now), key=lambda r: r[2:4])

    want = []
    for asset, now in prompts:
        row = [asset, now]
        for v in ("spot", "futures"):
            t, u, b = (seen(x, now, v, life) if asset == "a" else [] for x, life in ((trades, 100), (updates, 230), (books, 100)))
            start = min(b, key=lambda r: (abs(r[2] - (now - 50)), r[2], r[3]), default=None)
            start = start if start and abs(start[2] - (now - 50)) <= 30 else None
            kept = [r for r in u if start and r[8] >= start[5] and (r[4] > now - 50 or (r[4] > start[4] - 20 and r[7] is not None and r[7] <= start[5] + 1))]
            times = {n: x[-1][2] for n, x in (("trades", t), ("depth_updates", u), ("depth", b)) if x}
            row += [[r[7] for r in t], [(r[8], r[10] and [tuple(x) for x in r[10]], r[11]) for r in kept], start and start[5], times]
        want.append(row)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, 16)  # a bucket in many batches
    try:
        rows = w.select("asset", "current_time_ms", "venues.*").collect()
    finally:
        spark.conf.unset(batch)
    levels_of = lambda x: x and [tuple(y) for y in x]
    got = [[r["asset"], r["current_time_ms"], *[x for v in ("spot", "futures") for x in ([t["price"] for t in r[v]["trades"]], [(u["final_id"], levels_of(u["bids"]), levels_of(u["asks"])) for u in r[v]["depth_updates"]], r[v]["depth_start"] and r[v]["depth_start"]["update_id"], r[v]["last_event_times"])]] for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(r[3] for r in want) and any(r[7] for r in want)
