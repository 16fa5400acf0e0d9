"""Selection by bins against numpy on whole groups, with splits forced by small limits."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import quantiles as Qn

LEVELS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.995, 1.0]


@pytest.mark.parametrize("limit,bins,rows", [(50_000, 2048, 200_000), (60, 16, 0)])
def test_against_whole_groups(spark, monkeypatch, limit, bins, rows):
    monkeypatch.setattr(Qn, "SORTED", limit)
    monkeypatch.setattr(Qn, "BINS", bins)
    monkeypatch.setattr(Qn, "BROADCAST_ROWS", rows)
    rnd, groups = random.Random(limit), {}
    groups["normal"] = [rnd.gauss(0, 1) for _ in range(1500)]
    groups["equal"] = [2.5] * 900
    groups["mass"] = [0.0] * 700 + [rnd.random() for _ in range(30)]
    groups["tails"] = [math.exp(rnd.gauss(0, 12)) * rnd.choice([-1, 1]) for _ in range(800)]
    groups["huge"] = [-1.7e308, 1.7e308, *[rnd.uniform(-1, 1) for _ in range(200)]]
    groups["one"] = [7.0]
    groups[None] = [1.0, 2.0]
    data = [(k, v) for k, vs in groups.items() for v in vs] + [("one", None), ("one", math.nan), ("one", math.inf), ("void", None)]
    rnd.shuffle(data)
    df = spark.createDataFrame(data, "k string, v double").selectExpr("*", "1 n", "2 rank", "'x' ranks")
    got = {r["k"]: r for r in Qn.quantiles(df, by=["k"], value="v", levels=LEVELS).collect()}
    assert got.keys() == groups.keys()
    for k, vs in groups.items():
        assert got[k]["n"] == len(vs)
        if k != "huge":  # numpy's difference of its ends overflows
            assert np.allclose(got[k]["q"], np.quantile(vs, LEVELS), rtol=1e-12, atol=1e-300), k
    picked = {r["k"]: r["picked"] for r in Qn.order_statistics(df, by=["k"], value="v", ranks=lambda n: F.array(F.lit(0).cast("long"), n.cast("long") - 1, F.floor(n / 3).cast("long"))).collect()}
    for k, vs in groups.items():
        assert picked[k] == {i: sorted(vs)[i] for i in {0, len(vs) - 1, len(vs) // 3}}


def test_robust_center_scale(spark):
    rows = [("a", float(x)) for x in (1, 2, 3, 10)] + [("b", 4.0), ("b", None)]
    got = {r["k"]: (r["centre"], r["scale"]) for r in Qn.robust_center_scale(spark.createDataFrame(rows, "k string, v double"), by=["k"], value="v").collect()}
    assert got == {"a": (2.5, 2.5), "b": (4.0, 0.0)}
    empty = spark.createDataFrame([], "k string, v double")
    assert Qn.quantiles(empty, by=["k"], value="v", levels=[0.5]).count() == 0 and Qn.quantiles(empty, by=[], value="v", levels=[0.5]).count() == 0
    whole = spark.createDataFrame([(float(i),) for i in range(5)], "v double")
    assert Qn.quantiles(whole, by=[], value="v", levels=[0.5]).first()["q"] == [2.0]
