import random
import re
from collections import Counter, defaultdict

import numpy as np

from tidemark.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, most):
    """Rows of (lang, source, part, item, value, rank) from whole counts."""
    n, docs, groups = defaultdict(Counter), Counter(), set()
    for _, text, source, lang in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = TERM.findall(lower(text or ""))
        n[lang, source].update(found)
        docs.update((lang, t) for t in set(found))
    out = []
    for lang in {g[0] for g in groups}:
        terms = sorted(t for (of, t), c in docs.items() if of == lang and c >= least)
        sources = sorted(s for of, s in groups if of == lang)
        whole = Counter()
        for s in sources:
            whole.update({t: n[lang, s][t] for t in terms})
        price = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[t] for t in terms) + 5 * len(terms)) for t in terms}
        p, q = {s: price(n[lang, s]) for s in sources}, price(whole)
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in terms), o) for o in sources if o != s]
            rare = [(p[s][t] - q[t], t) for t in terms if n[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, values, limit in (("pair", pairs, None), ("term", rare, most)):
                ranked = sorted(values, key=lambda v: (-v[0], v[1].encode()))[:limit]
                out += [(lang, s, part, item, value, i) for i, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def corpus(seed, sources):
    rnd = random.Random(seed)
    words = ["The", "the", "of", "élan", "ÉLAN", "日本", "a1b", "x_y", "foo", "Bar", "baz", " ", "ünter", "z"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(12) for j in range(12)]
    rows = []
    for i in range(400):
        n = 0 if i % 40 == 0 else rnd.randrange(1, 120)
        rows.append((i, " ".join(rnd.choice(words[: rnd.randrange(5, len(words))]) for _ in range(n)), rnd.choice(sources), rnd.choice(["en", "en", "de", None])))
    return rows + [(900, None, "only", "fr"), (901, "", None, "en"), (902, "lonely word", "new", "en"), (903, "12 -- 3", "s1", "fr"), (5, *rows[5][1:]), (None, "the of", "s1", "en"), (904, "the " * 200_000 + "é" * 300_000, "s0", "en")]


def found(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(map(tuple, df.collect()))


def test_against_brute_force(make):
    rows = corpus(1, ["s0", "s1", "s2", None, "é"])
    docs = make(rows).selectExpr("*", "'x' term", "1 whole", "2 block", "3 row")
    assert found(divergence.audited(docs, least_docs=8, most_terms=10)) == brute(rows, 8, 10)
    assert found(divergence.audited(docs, least_docs=10_000)) == brute(rows, 10_000, 50)
    assert divergence.audited(docs.limit(0)).count() == 0


def test_many_lots_and_blocks(make, monkeypatch):
    """Groups in many lots, terms in many blocks, tables cut by columns: the same sums."""
    rows = corpus(2, [f"s{i}" for i in range(23)])
    monkeypatch.setattr(divergence, "BLOCK_GROUPS", 4)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 20)
    monkeypatch.setattr(divergence, "HELD", 50)
    monkeypatch.setattr(divergence, "MOST_COLUMNS", 16)
    monkeypatch.setattr(divergence, "LEAST_TERMS", 2)
    monkeypatch.setattr(divergence, "BROADCAST_ROWS", 0)
    assert found(divergence.audited(make(rows), least_docs=5, most_terms=7)) == brute(rows, 5, 7)


def test_shares_are_exact(spark):
    rnd = random.Random(4)
    pairs = [(rnd.randrange(1, w + 1), w) for w in (rnd.randrange(1, 10 ** rnd.randrange(1, 16)) for _ in range(3000))]
    want = [1 + 10**9 * n // w for n, w in pairs]
    n, w = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
    assert divergence.share(n, w).tolist() == want
    df = spark.createDataFrame([(i, a - divergence.PRIOR, b) for i, (a, b) in enumerate(pairs)], "i long, n long, w long")
    got = df.select("i", divergence._p(df["n"], df["w"]).alias("p")).sort("i").collect()
    assert [r["p"] for r in got] == want


def test_joint_tables_count_levels():
    rnd = np.random.default_rng(3)
    counts = rnd.integers(0, 4, (50, 3)) * rnd.integers(0, 2, (50, 3))
    for left, right in ((counts, None), (counts, counts[:, :2] + 1)):
        got = Counter()
        for table, g, c, h, d in divergence.joint_tables(left, right):
            for i, j in zip(*np.nonzero(table), strict=True):
                got[g[i], c[i], h[j], d[j]] += int(table[i, j])
        other = left if right is None else right
        assert got == Counter((g, left[t, g], h, other[t, h]) for t in range(50) for g in range(3) for h in range(other.shape[1]))
