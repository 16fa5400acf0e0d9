import json

from pyspark.sql import functions as F

from tidemark.sources import files, messages


def raw(spark, *bodies):
    rows = [("BTC", "futures", i, 5000 + i, b if isinstance(b, str) else json.dumps(b)) for i, b in enumerate(bodies)]
    return messages.read_raw_messages(spark.createDataFrame(rows, "asset string, venue string, seq long, recv_ts_ms long, value string"))


KEEP = ["asset", "venue", "seq"]


def test_messages(spark):
    m = raw(
        spark,
        {"e": "aggTrade", "T": 1_736_424_305_125_000, "E": 7, "p": "10.5", "q": "2", "m": True},
        {"stream": "x@bookTicker", "data": {"b": "1", "B": "2", "a": "3", "A": "4", "u": 9}},
        {"e": "depthUpdate", "E": 1, "U": 5, "u": 7, "pu": 4, "b": [["99", "1"]], "a": []},
        {"e": "forceOrder", "E": 950, "o": {"S": "SELL", "p": "100", "ap": "99.5", "q": "1", "z": ".4", "T": 900}},
        {"e": "kline", "k": {"t": 1000, "o": "1", "h": "2", "l": "0.5", "c": "1.5", "v": "3", "x": True}},
        {"id": 1, "result": None},
        "{broken",
        "[1, 2]",
    ).cache()
    t = messages.normalize_trades(m, keep=KEEP).first()
    assert (t["ts_ms"], t["price"], t["qty"], t["buyer_is_maker"], t["seq"]) == (1_736_424_305_125, 10.5, 2.0, True, 0)
    q = messages.normalize_book_ticker(m, keep=KEEP).collect()
    assert [(r["bid_price"], r["ask_qty"], r["event_ts_ms"], r["seq"]) for r in q] == [(1.0, 4.0, None, 1)]
    d = messages.normalize_depth_updates(m, keep=KEEP).first()
    assert (d["first_id"], d["final_id"], d["prev_final_id"]) == (5, 7, 4) and d["bids"][0]["price"] == 99.0 and d["asks"] == []
    liq = messages.normalize_liquidations(m, keep=KEEP).first()
    assert (liq["price"], liq["qty"], liq["ts_ms"], liq["is_buy"]) == (99.5, 0.4, 900, False)
    k = messages.normalize_klines(m, keep=KEEP).first()
    assert (k["open_time_ms"], k["close"], k["closed"]) == (1000, 1.5, True)
    assert m.count() == 5


def test_chained_ids(spark):
    u = spark.createDataFrame([("x", 1, 5, 7, None), ("x", 2, 8, 9, None), ("x", 3, 10, 11, 9)], "k string, seq long, first_id long, final_id long, prev_final_id long")
    assert [r["prev_final_id"] for r in messages.chained(u, keys=["k"], order="seq").sort("seq").collect()] == [4, 7, 9]


def test_archives(spark, tmp_path):
    (tmp_path / "t.csv").write_text("agg_trade_id,ts_ms,ts_utc,price,qty,buyer_is_maker\n41,7300,x,31.25,0.5,1\n42,7310,x,31.5,3,False\n43,7330,x,31.75,2.25,true\n44,7340,x,32,6,0\n")
    assert [(r["price"], r["buyer_is_maker"]) for r in files.read_trades_csv(spark, str(tmp_path / "t.csv")).sort("seq").collect()] == [(31.25, True), (31.5, False), (31.75, True), (32.0, False)]
    (tmp_path / "k.csv").write_text("open_time,open,high,low,close,volume\n1736424305125000,1,2,0.5,1.5,9\n")
    assert [tuple(r) for r in files.read_kline_archive(spark, str(tmp_path / "k.csv")).collect()] == [(1_736_424_305_125, 1.0, 2.0, 0.5, 1.5, 9.0)]
    (tmp_path / "d.csv").write_text("timestamp,percentage,depth,notional\n2024-01-01 00:00:05,-1,2,198\n2024-01-01 00:00:05,1,2,202\n2024-01-01 00:00:05,-2,1,98\n")
    b = files.book_from_percent_levels(files.read_book_depth_archive(spark, str(tmp_path / "d.csv"))).first()
    assert b["recv_ts_ms"] == 1_704_067_205_000 and [x["price"] for x in b["bids"]] == [99.0, 98.0] and b["asks"][0]["price"] == 101.0
    head = "recv_ts_ms,recv_ts_utc,update_id,event_ts_ms,transaction_ts_ms,side,level,price,qty\n"
    (tmp_path / "s.csv").write_text(head + "10,x,1,,,bid,1,98,2\n10,x,1,,,bid,0,99,1\n10,x,1,,,ask,0,101,1\n")
    s = files.read_depth_csv(spark, str(tmp_path / "s.csv")).first()
    assert [x["price"] for x in s["bids"]] == [99.0, 98.0] and s["event_ts_ms"] is None
    (tmp_path / "q.csv").write_text("update_id,b,bq,a,aq,t,e\n7,1,2,3,4,50,60\n")
    q = files.read_book_ticker_archive(spark, str(tmp_path / "q.csv")).collect()
    assert [(r["update_id"], r["recv_ts_ms"], r["ask_qty"]) for r in q] == [(7, 60, 4.0)]


def test_payload_round_trip_and_report(spark, tmp_path):
    trades = [{"ts_ms": 1, "event_ts_ms": 1, "recv_ts_ms": 2, "price": 3.0, "qty": 4.0, "buyer_is_maker": True}]
    body = {"schema_version": 5, "asset": "BTC", "current_time_ms": 77, "venues": {"spot": {"trades": trades}, "futures": {}}, "unknown": 1}
    (tmp_path / "BTC" / "77").mkdir(parents=True)
    (tmp_path / "BTC" / "77" / "payload.json").write_text(json.dumps(body))
    p = files.read_payloads(spark, str(tmp_path / "BTC" / "*" / "payload.json"))
    assert [(r["seq"], r["price"]) for r in files.exploded(p, venue="spot", stream="trades").collect()] == [(0, 3.0)]
    files.write_payloads(p.drop("folder_ms", "_corrupt_record"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "asset_key=BTC" / "prompt_ms=77").exists()
    s = spark.createDataFrame([(2000, 12000, None, None, 1.0, None), (1000, 11000, 10_900, 100.5, 0.25, 3.0)], "current_time_ms long, target_ms long, book_recv_ts_ms long, crps double, realized double, predict_ms double")
    rows = files.score_report(s).sort("test").collect()
    assert tuple(rows[0])[0] == 1 and rows[0]["realized"] == "0.250000" and rows[1]["predict_ms"] == "" and rows[1]["crps"] == ""


def test_retention_edges(spark):
    now, week = 10**12, 7 * 86_400_000
    c = spark.createDataFrame([(str(now - week - 1),), (str(now - week),), ("notes",), (str(now),)], "folder string")
    assert {r[0] for r in files.kept_captures(c, now_ms=now).collect()} == {str(now - week), str(now)}
    assert F is not None


def test_pruning_deletes_old_folders_only(spark, tmp_path):
    root = tmp_path / "captures"
    for name in ("1000", "folder_ms=1999", "2000", "2001", "notes", "12x"):
        (root / "a" / name).mkdir(parents=True)
        (root / "a" / name / "payload.json").write_text("{}")
    (root / "a" / "500").write_text("a file")
    assert files.prune_captures(spark, f"file://{root}", now_ms=3000, keep_ms=1000) == 2
    assert sorted(p.name for p in (root / "a").iterdir()) == ["12x", "2000", "2001", "500", "notes"]
    assert files.prune_captures(spark, f"file://{root}/none", now_ms=3000) == 0
