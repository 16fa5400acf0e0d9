import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import url_filter, vector_dedup


def pages(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'h' host", "1 gram", "2 n")


def test_hosts_and_rules(spark):
    urls = ["https://A.B.org/x?y", "http://example.org/es/1", "http://www.example.org/en/12#a", "https://shop.com/fr/", "http://xcom/fr/", "no scheme", None, "", "http://q.org", "ftp://u.com/de/é?z=://"]
    got = {r["page_id"]: r for r in url_filter.judged(pages(spark, urls)).collect()}
    assert (got[0]["__host"], got[0]["__path"], got[0]["__rule"], got[0]["__verdict"]) == ("a.b.org", "/x", "org/", "allow")
    assert [got[i]["__rule"] for i in range(10)] == ["org/", "example.org/es/", "example.org/en/1", "com/fr/", None, None, None, None, None, "com/de/"]
    assert (got[6]["__host"], got[6]["__path"], got[6]["__verdict"], got[6]["__score"]) == ("", "", got[7]["__verdict"], got[7]["__score"])
    assert got[5]["__host"] == "" and got[9]["__path"] == "/de/é"
    long = url_filter.judged(pages(spark, ["http://a.net/" + "q" * 200_000, *urls, *urls])).collect()
    assert len(long) == 21 and len({(r["url"], r["__verdict"]) for r in long}) == 11
    assert url_filter.judged(pages(spark, urls).limit(0)).count() == 0


def test_cut_by_errors(spark):
    rnd = random.Random(2)
    rows = [("allow", rnd.gauss(1, 1)) for _ in range(300)] + [("block", rnd.gauss(-1, 1)) for _ in range(100)]
    cut = url_filter.best_cut(spark.createDataFrame(rows, "__class string, __score double"))
    errors = lambda t: sum(c == "allow" and s < t for c, s in rows) / 300 + sum(c == "block" and s >= t for c, s in rows) / 100
    assert errors(cut) <= min(errors(t / 1000) for t in range(-4000, 4000)) + 1e-9


def test_ratio_tells_classes_apart(spark):
    rnd = random.Random(1)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(8))
    urls = [f"http://x.net/{word('abcd')}.org/" if i % 2 else f"http://x.net/{word('wxyz')}.de/" for i in range(300)]
    urls += [f"http://{word('abcd')}.org/{word('abcd')}" for _ in range(200)] + [f"http://{word('wxyz')}.com/de/{word('wxyz')}" for _ in range(200)]
    got = url_filter.judged(pages(spark, urls)).filter("__rule is null").collect()
    right = sum((r["__verdict"] == "allow") == (".org" in r["url"]) for r in got)
    assert len(got) == 300 and right >= 290
    once = url_filter.judged(pages(spark, urls + urls)).groupBy("url").agg(F.count_distinct("__score").alias("k")).filter("k > 1")
    assert once.count() == 0


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 16))
    x[100:400] = x[0] + rng.normal(size=(300, 16)) * 0.25
    x[400:420] = x[5]
    rows = [(i, [float(v) for v in r], 0) for i, r in enumerate(np.float32(x))]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None, *[1.0] * 15], 0), (904, [], 0), (905, [1.0, 2.0], 0), (906, [2.0, 4.0], 0), (None, [1.0] * 16, 0), (907, [float("inf")] * 16, 0)]
    copies = [(rows[5][0], rows[5][1], 0), (910, rows[200][1], 0), (7, [float(v) for v in x[8]], 1)]  # a repeated row, a copy, a key's other vector
    df = spark.createDataFrame(rows + odd + copies, "vec_id long, embedding array<float>, id int").selectExpr("*", "1 n", "2 least")
    out = vector_dedup.near_vectors(df).collect()
    got = {r["vec_id"]: r for r in out}
    u = np.float32([r[1] for r in rows + copies]).astype(float)
    ids = np.array([r[0] for r in rows + copies])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T >= 0.9
    np.fill_diagonal(s, False)
    label = ids.copy()
    while True:
        new = np.minimum(label, np.where(s, label[None, :], 10**9).min(1))
        if (new == label).all():
            break
        label = new
    want = Counter((int(i), int(n), int(c)) for i, n, c in zip(ids, s.sum(1), label, strict=True))
    have = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in out if r["vec_id"] is not None and (r["vec_id"] < 600 or r["vec_id"] == 910))
    assert sum(have.values()) == sum(want.values()) and sum((have & want).values()) >= 0.97 * sum(want.values())
    assert 0.99 * s.sum() <= sum(n * k for (_, n, _), k in have.items()) <= s.sum()
    assert sum(1 for r in out if r["vec_id"] == 7) == 2 and sum(1 for r in out if r["vec_id"] == 5) == 2
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in (900, 901, 902, 903, 904, 907))
    assert got[905]["n_links"] == got[906]["n_links"] == 1 and got[906]["component_id"] == 905 and not got[None]["kept"]
    assert vector_dedup.near_vectors(df.limit(0)).count() == 0
    assert vector_dedup.near_vectors(df.filter("vec_id = 900")).collect()[0]["kept"]
    twins = spark.createDataFrame([(None, [1.0, 2.0]), (None, [1.0, 2.1]), (3, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r["n_links"], r["component_id"] or 0, r["kept"]) for r in vector_dedup.near_vectors(twins).collect()) == [(0, 3, True), (1, 0, False), (1, 0, False)]


def test_recall_of_planted_neighbours(spark):
    """Neighbours at a cosine of 0.90 to 0.97 among 24,000 vectors, with as many lists as their number asks for."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(24_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    off = rng.normal(size=(2000, 64))
    off -= (off * x[:2000]).sum(1)[:, None] * x[:2000]
    off /= np.linalg.norm(off, axis=1, keepdims=True)
    cosine = rng.uniform(0.901, 0.97, 2000)[:, None]
    x[2000:4000] = cosine * x[:2000] + np.sqrt(1 - cosine**2) * off
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(8)
    got = vector_dedup.near_vectors(df).filter("vec_id < 4000").agg(F.sum("n_links")).first()[0]
    assert 0.97 * 4000 <= got <= 4000
