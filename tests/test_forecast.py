import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import ladders as L
from tidemark.operators import chain
from tidemark.plans import fixtures, queries
from tidemark.sources import ticks as T


def test_batch_keeps_prompts_without_quotes_and_cheap_assets(spark, monkeypatch):
    """Quotes that cost under 1, a prompt hours after the last of them, and the chain's atom at the price."""
    quotes = [("a", "spot", i, i * T.HOUR, 0.5 + 0.01 * (i % 3), 1.0, 0.52 + 0.01 * (i % 3), 2.0) for i in range(1, 9)]
    q = spark.createDataFrame(quotes, "asset string, venue string, seq long, recv_ts_ms long, bid_price double, bid_qty double, ask_price double, ask_qty double")
    t = q.selectExpr("asset", "venue", "seq", "recv_ts_ms", "recv_ts_ms ts_ms", "bid_price price", "bid_qty qty", "seq % 2 = 1 buyer_is_maker")
    side = lambda c: F.array(F.struct(F.col(f"{c}_price").alias("price"), F.col(f"{c}_qty").alias("qty"))).alias(f"{c}s")
    given = {"quotes": q, "trades": t, "liquidations": t.selectExpr("asset", "seq", "recv_ts_ms", "price", "qty", "true is_buy").limit(0), "depth": q.select("asset", "venue", "seq", "recv_ts_ms", side("bid"), side("ask"))}
    given["clock_prompts"] = spark.createDataFrame([("a", 8 * T.HOUR), ("a", 40 * T.HOUR)], "asset string, current_time_ms long")
    for name, df in given.items():
        monkeypatch.setattr(fixtures if name == "depth" else T, name, lambda spark, sf_dir, df=df: df)
    found = queries.batch_forecasts(spark, "").select("current_time_ms", "kind", "q", L.violations(F.col("q")).alias("bad")).sort("current_time_ms").collect()
    assert [(r["current_time_ms"], r["kind"], r["bad"]) for r in found] == [(8 * T.HOUR, "time", []), (40 * T.HOUR, "time", [])]
    live, wide = (np.array(r["q"]) for r in found)
    price = (0.52 * 2.0 + 0.54 * 1.0) / 3  # the last quote's microprice: the thinner side counts
    assert (np.abs(live - price) < 1e-9).sum() >= 5
    middle = 0.5 * (wide[49] + wide[50])
    assert 0.5 <= middle <= 0.53 and np.abs(wide - middle).mean() == pytest.approx(queries.CHAIN.fallback * middle * chain.Z_ABS, rel=1e-6)
