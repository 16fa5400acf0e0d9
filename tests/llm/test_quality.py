import math
import random
import zlib

import numpy as np

from tidemark.llm import quality

SF = "/root/testdata/sf0.01"


def made_texts(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        good = rnd.random() < 0.7
        words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(rnd.randrange(5, 80))]
        text = " ".join(words) + "." if good else " ".join(rnd.choice([w.upper() + "!!", w + "#$%", "| 12"]) for w in words)
        rows.append((i, text, int(good)))
    return rows


def test_held_out_rows_are_told_apart(make, spark):
    rows = made_texts(600, 1)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 3] + [(9999, 1), (None, 0), (4, None)], "doc_id long, quality int").selectExpr("*", "'x' text", "1 label", "2 x")
    docs = make([(i, t) for i, t, _ in rows] + [(2000, None), (2001, ""), (None, "a b"), (5, rows[5][1]), (2002, "ab cd " * 400_000), (2003, "x" * 2_500_000)])
    got = quality.scored(docs, labels).collect()
    assert len(got) == len(rows) + 6 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in by.items() if i is not None)
    held = [(i, y) for i, _, y in rows if by[i]["held_out"]]
    assert len(held) > 80 and sum(by[i]["predicted"] == y for i, y in held) >= 0.98 * len(held)
    again = quality.scored(docs.repartition(7), labels.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_labels_of_held_out_rows_teach_nothing(make, spark):
    rows = made_texts(300, 2)
    docs = make([(i, t) for i, t, _ in rows])
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]
    one = quality.scored(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int"))
    two = quality.scored(docs, spark.createDataFrame(turned, "doc_id long, quality int"))
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))


def test_few_labels(make, spark):
    docs = make([(i, f"text {i}") for i in range(20)])
    labels = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    assert {r["score"] for r in quality.scored(docs, labels).collect()} == {1.0}
    assert {r["score"] for r in quality.scored(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.scored(docs.limit(0), labels).count() == 0


def test_given_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.scored(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    assert len(got) > 50 and sum(r["predicted"] == r["quality"] for r in got) >= 0.97 * len(got)


def test_discriminant_against_densities():
    """Exact sums against numpy's covariances, and scores against the densities' textbook form."""
    rnd = np.random.default_rng(5)
    d = quality.WIDTH
    x = [np.rint(rnd.normal(k, 1 + k, (80 + 40 * k, d)) * quality.UNIT).astype(np.int64) for k in (0, 1)]
    sums = [(len(a), a.sum(0).astype(object), (a.T @ a).astype(object)) for a in x]
    model = quality.Discriminant.of(sums, 0.3, 0.1)
    cov = [np.cov(a.T / quality.UNIT, bias=True) for a in x]
    pooled = (80 * cov[0] + 120 * cov[1]) / 200
    ask = np.rint(rnd.normal(0.5, 2, (30, d)) * quality.UNIT).astype(np.int64)
    logs = []
    for a, c in zip(x, cov, strict=True):
        s = 0.9 * (0.7 * c + 0.3 * pooled) + 0.1 * np.diag(np.diag(pooled) + 1e-6)
        z = ask / quality.UNIT - a.mean(0) / quality.UNIT
        logs.append(math.log(len(a) / 200) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z))
    assert np.allclose(model.log_odds(ask), logs[1] - logs[0], rtol=1e-9)


def test_statistics_of_slices(monkeypatch):
    rnd = random.Random(8)
    text = " ".join("".join(rnd.choice("aBc1.") for _ in range(rnd.randrange(1, 9))) for _ in range(3000)).encode()
    whole = quality.statistics(text)
    monkeypatch.setattr(quality, "SLICE", 100)
    assert quality.statistics(text) == whole
