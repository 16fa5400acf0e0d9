import hashlib
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import fill_middle

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(key, text):
    text = text or ""
    parts = UNIT.findall(text)
    n = len(parts)
    digest = hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(parts[:a]), "".join(parts[a:b]), "".join(parts[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return (key, n, "plain", None, None, text)
    if h[3] % 100 < 80:
        return (key, n, "spm", prefix, middle, f"<S>{suffix}<P>{prefix}<M>{middle}")
    return (key, n, "psm", prefix, middle, f"<P>{prefix}<S>{suffix}<M>{middle}")


def test_against_brute_force(make, monkeypatch):
    rnd = random.Random(1)
    parts = ["a", "Bc", " ", "  ", "\n", "\t", "\r", "é", "日本", "\x00", "<P>", "<S", "P>", "<M>", ">", "<", "\x1c", "　", "\x0b\x0c", " "]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(20)))) for i in range(3000)]
    rows += [(1, None), (2, ""), (2, ""), (None, "x y z"), (3, "é " * 200_000), (4, " \n"), (5, "a" * 500_000)]
    got = fill_middle.transformed(make(rows)).select("*", fill_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert sorted(map(str, (tuple(r)[:6] for r in got))) == sorted(map(str, (brute(*r) for r in rows)))
    assert sorted(r["back"] for r in got) == sorted(t or "" for _, t in rows)
    assert all(sum(r["form"] == f for r in got) > 50 for f in ("plain", "spm", "psm"))
    monkeypatch.setattr(fill_middle, "STEP_BYTES", 7)
    few = rows[:300]
    again = fill_middle.transformed(make(few)).collect()
    assert sorted(map(str, map(tuple, again))) == sorted(map(str, (brute(*r) for r in few)))


def test_odd_tables(make, spark):
    empty = fill_middle.transformed(make([(1, "a")]).limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "n", "form", "prefix", "middle", "output"]
    raw = spark.createDataFrame([(7, bytearray(b"a \xff b"))], "doc_id long, text binary").withColumn("text", F.col("text").cast("string"))
    r = fill_middle.transformed(raw, rate=100).select("*", fill_middle.restored(F.col("output"), F.col("form")).alias("back")).first()
    assert r["n"] == 3 and r["back"] == "a � b"
    flat, parent, n = fill_middle.units(pa.array([b"", b"a b ", b" "], pa.large_binary()))
    assert flat.to_pylist() == [b"a", b" b", b" ", b" "] and n.tolist() == [0, 3, 1] and parent.to_pylist() == [1, 1, 1, 2]
