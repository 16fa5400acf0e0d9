import random
import re
from itertools import combinations

from tidemark.llm import near_dup
from tidemark.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute(rows, percent=85):
    sets = []
    for i, text in rows:
        w = WORD.findall((text or "").encode().lower())
        sets.append((i, frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(sets)), 2):
        x, y = sets[a][1], sets[b][1]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            parent[root(a)] = root(b)
    ids = {}
    for k, (i, _) in enumerate(sets):
        ids.setdefault(root(k), []).append(i)
    return {i: (len(s), min(ids[root(k)])) for k, (i, s) in enumerate(sets)}


def corpus(seed, n=150):
    """A text with many near copies, edited in 1 to 6 places, beside others and odd cases."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [rnd.choice(vocab) for _ in range(150)]
    rows = []
    for i in range(n):
        words = list(base) if i % 3 else [rnd.choice(vocab) for _ in range(rnd.randrange(0, 60))]
        for _ in range(rnd.randrange(0, 7) if i % 3 else 0):
            words[rnd.randrange(len(words))] = rnd.choice(vocab)
        rows.append((1000 - i, " ".join(words)))
    return rows + [(2000, None), (2001, ""), (2002, " \t\n"), (2003, "one two"), (2004, "ONE  two"), (2005, "one two three"), (2006, "x " * 30_000), (2007, "X\n" * 30_000)]


def test_against_brute_force(make):
    for seed in (1, 2):
        rows = corpus(seed)
        got = near_dup.near_duplicates(make(rows)).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(rows)
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_odd_rows(make):
    got = near_dup.near_duplicates(make([(None, "a b c d e f"), (5, "a b c d e f"), (5, "a b c d e f"), (None, None)]))
    assert sorted(((r[0], r[2], r[3]) for r in got.collect()), key=str) == [(5, 5, True), (5, 5, True), (None, 5, False), (None, None, False)]
    assert near_dup.near_duplicates(make([]).limit(0)).count() == 0


def test_one_of_each_group_stays(make):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "q r s t u v"), (3, "q r s t u v"), (4, ""), (None, None)]
    left = near_dup.deduplicated(make(rows))
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 1, 3, 4]
    assert left.columns == make(rows).columns


def test_a_repeated_key_stands_for_each_of_its_texts(make):
    """A copy's key also names a text that nothing else holds; a smallest key names two near copies."""
    base = [f"w{i}" for i in range(200)]
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "k l m n o p q"), (3, " ".join(base)), (3, " ".join([*base, "z"])), (3, "r s t u v w x"), (4, " ".join(base)), (4, " "), (4, "")]
    left = sorted((r["doc_id"], r["text"][:5]) for r in near_dup.deduplicated(make(rows)).collect())
    assert left == [(1, "a b c"), (2, "k l m"), (3, "r s t"), (3, "w0 w1"), (4, ""), (4, " ")]


def test_components_of_a_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(40)]
    hub = [(100, 100 + i) for i in range(1, 50)] + [(149, 60), (7, 7), (None, 3)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(path + hub, "u long, v long")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(100, 150)} == {60}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
