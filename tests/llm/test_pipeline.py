import random

import corpus_pipeline
from test_near_dup import brute
from tidemark.llm import decontam, mixing

SF = "/root/testdata/sf0.001"


def test_stages_work_on_what_came_before(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given, counts = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).persist()
        counts.append((name, out.count()))
        if name != "mixing":
            assert out.columns == given.columns
            docs = out
    kept = dict(counts)
    assert kept["language ID"] >= 0.97 * given.count() and kept["line dedup"] == kept["language ID"]
    assert 0 < kept["benchmark decontamination"] <= kept["MinHash near-dedup"] <= kept["line dedup"]
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontam.contaminated(docs, bench).count() == 0
    mix = mixing.mixed(docs)
    assert out.count() == mix.agg({"__copies": "sum"}).first()[0]


def test_run_gives_the_mix(spark):
    out = corpus_pipeline.run(spark, SF)
    assert "copy" in out.columns and out.count() > 0


def test_near_duplicates_link_from_080(spark, make):
    """Pairs of texts whose similarity lies at 0.80 to below 0.85, beside closer and farther ones."""
    rnd, rows = random.Random(3), []
    for i in range(60):
        words = [f"w{i}x{j}" for j in range(120)]
        other = list(words)
        for k in range(1 + i % 5):
            other[12 + 25 * k] = f"z{rnd.randrange(10**9)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    want = {i for i, (_, first) in brute(rows, 80).items() if i == first}
    assert len({i for i, (_, first) in brute(rows, 85).items() if i == first}) - len(want) >= 10
    assert {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, make(rows), SF).collect()} == want


def test_lines_on_a_minority_of_sites_go(spark, make):
    """Of 20 sites, five hold one passage and four another; only the first goes, but for one holder."""
    rows = [(i, "\n".join([f"own {i}", *["on five sites"] * (i % 20 < 5), *["on four sites"] * (i % 20 < 4)]), f"site {i % 20}") for i in range(40)]
    left = [r["text"] for r in corpus_pipeline.lines(spark, make(rows), SF).collect()]
    assert len(left) == 40 and sum("on five sites" in t for t in left) == 1 and sum("on four sites" in t for t in left) == 8


def odd_documents(make):
    """Two languages, copies, a benchmark passage, and every oddity of a row; all with clashing extra columns."""
    rnd = random.Random(12)
    words = {"aa": ["kala", "tuna", "rimo", "sada", "luma"], "bb": ["schwer", "dicht", "wand", "stolz", "grund"]}
    rows = [(i, " ".join(rnd.choice(words[x]) + str(rnd.randrange(9)) for _ in range(40)), f"s{i % 7}", x) for i in range(120) for x in [rnd.choice(["aa", "bb"])]]
    long = " ".join(rnd.choice(words["aa"]) + str(rnd.randrange(999)) for _ in range(200_000))
    odd = [(500, None, "s1", "aa"), (501, "", None, None), (502, " \n\t", "s2", "aa"), (503, "12 !! ½", "s3", "bb"), (None, rows[3][1] + " kala", "s1", "aa"), (504, long, None, "aa")]
    twice = [rows[5], rows[5], (505, rows[6][1], "s1", "aa"), (506, rows[7][1] + " luma1", "s2", None)]
    return rows, make(rows + odd + twice)


def test_stages_with_odd_rows(spark, make):
    rows, docs = odd_documents(make)
    given = docs.columns
    out = corpus_pipeline.language(spark, docs, SF)
    kept = [r["doc_id"] for r in out.collect()]
    assert out.columns == given and not {500, 501, 502, 503} & set(kept) and {504, 505, 506, None} <= set(kept)
    assert len(kept) >= 0.97 * (len(rows) + 6)
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, SF).persist()
        assert docs.columns == given, name
    left = [r["doc_id"] for r in docs.collect()]
    assert len(left) == len(set(left)) and 505 not in left and 506 not in left and {6, 7, 504, None} <= set(left)
    mix = corpus_pipeline.mixing_stage(spark, docs, SF)
    assert "copy" in mix.columns and mix.count() > 0 and mix.filter("doc_id is not null").select("doc_id").distinct().count() <= len(left)


def test_stages_with_an_empty_table(spark, make):
    docs = make([(1, "a b c")]).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0, name


def test_very_long_lines_and_texts(spark, make):
    """A line of two million characters on many sites, and a document of a million words."""
    line = "ab" * 1_000_000
    rows = [(i, f"own {i}\n{line}", f"s{i}") for i in range(6)] + [(10, "w " * 1_000_000, "s0"), (11, "", "s1")]
    left = {r["doc_id"]: r["text"] for r in corpus_pipeline.lines(spark, make(rows), SF).collect()}
    assert left[0] == rows[0][1] and all(left[i] == f"own {i}" for i in range(1, 6)) and left[10] == rows[6][1]
    mix = {r["doc_id"]: r for r in mixing.mixed(make(rows)).select("doc_id", "__size", "__copies").collect()}
    assert mix[10]["__size"] == 1_000_000 and mix[11]["__size"] == 0 and all(0 <= r["__copies"] <= 2 for r in mix.values())
