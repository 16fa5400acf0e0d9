import hashlib
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

from tidemark.llm import chat, decontam, langid, line_dedup, mixing, secrets, token_counts
from tidemark.llm.common import word_count

ODD = [(1, None), (2, ""), (2, ""), (None, "x y"), (3, "é" * 200_000), (4, " \n\t ")]


def test_word_count(make):
    texts = [None, "", " ", "a", " a\tb\n", "\x0b\x0ca\r\rb c", "a b c"]
    got = make(list(enumerate(texts))).select("doc_id", word_count(F.col("text"))).sort("doc_id").collect()
    assert [r[1] for r in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_token_counts_are_the_librarys(make):
    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rnd = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "\t", "\r", "é", "▁", "<s>", "</s>", "日本", "\x00", "🙂", "ing", "12", ".", "　", "<0x0A>"]
    rows = [(i + 10, "".join(rnd.choice(parts) for _ in range(rnd.randrange(14)))) for i in range(2000)] + ODD
    got = token_counts.token_counts(make(rows), vocabulary=path).collect()
    want = sorted((str(i), len((t or "").encode()), len(sp.encode(t or "")), len(sp.encode(t or "")) > 4096) for i, t in rows)
    assert sorted((str(r[0]), r[1], r[2], r[3]) for r in got) == want
    assert token_counts.token_counts(make(ODD).limit(0), vocabulary=path).count() == 0


def test_secret_spans(make):
    near = "user=alice\nkey Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5MEFCQ0RFRg== at https://db.example.com/x"
    rows = [(10, 'Password = "hunter22" and token: abc'), (11, "AKIA" + "A" * 16 + " " + "AKIA123"), (12, "é " + "ab01" * 8), (13, near), (14, near.split("\n")[1].split(" at ")[0]), (15, "api_key=" + "Ab1" * 20), *ODD]
    got = {r["doc_id"]: r for r in secrets.scan_report(make(rows)).collect()}
    assert got[10]["n_assign"] == 1 and got[10]["spans"] == "assign:0:20"
    assert got[11]["spans"] == "access:0:20" and got[12]["spans"] == "hex:2:34"
    assert [s.split(":")[0] for s in got[13]["spans"].split(",")] == ["identifier", "secret", "endpoint"]
    assert got[14]["spans"] == "" and got[14]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert got[10]["base_sha256"] == hashlib.sha256(b"assign:0:20").hexdigest()
    assert secrets.scan_report(make(rows)).count() == len(rows)


def test_base_kinds_against_plain_scans(make):
    """Random texts of parts of secrets; each kind by a scan character by character."""

    def run(text, at, ok):
        end = at
        while end < len(text) and ok(text[end]):
            end += 1
        return end

    small = lambda c: c in "0123456789abcdef"
    value = lambda c: c.isascii() and (c.isalnum() or c in "+/_.=-")

    def brute(text):
        out, at = [], 0
        while at < len(text):  # access and hex: whole runs
            if text.startswith("AKIA", at) and (end := run(text, at + 4, lambda c: c.isascii() and (c.isdigit() or c.isupper()))) > at + 4:
                out += [("access", at, end)] if end - at >= 20 else []
                at = end
            else:
                at += 1
        at = 0
        while at < len(text):
            end = run(text, at, small)
            out += [("hex", at, end)] if end - at >= 24 else []
            at = max(end, at + 1)
        at = 0
        while at < len(text):
            end = None
            for name in ("password", "passwd", "secret", "token", "api_key", "apikey"):
                if text[at : at + len(name)].lower() == name and text[at : at + len(name)].isascii():
                    i = at + len(name)
                    i += text[i : i + 1] in ("'", '"') and i < len(text)
                    i = run(text, i, lambda c: c == " ")
                    if text[i : i + 1] in (":", "=") and i < len(text):
                        i = run(text, i + 1, lambda c: c == " ")
                        i += text[i : i + 1] in ("'", '"') and i < len(text)
                        if (stop := run(text, i, value)) > i:
                            end = stop
                            out += [("assign", at, end)] if end - i >= 6 else []
            at = end or at + 1
        return sorted(out, key=lambda s: (s[1], secrets.BASE.index(s[0])))

    rnd, found = random.Random(31), 0
    parts = ["password", "PassWd", "secret", "Token", "api_key", "APIKEY", "'", '"', " ", "=", ":", "AKIA", "ABCD1234EFGH5678", "deadbeef", "0123456789abcdef01234567", "hunter22", "x", "é", "\n", "==", "ſecret"]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(40)))) for i in range(1500)]
    got = {r["doc_id"]: r for r in secrets.scan_report(make(rows)).collect()}
    for i, text in rows:
        want = brute(text)
        found += len(want)
        digest = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i]["base_sha256"] == hashlib.sha256(digest.encode()).hexdigest(), (text, want, got[i]["spans"])
        assert [got[i][f"n_{k}"] for k in secrets.BASE] == [sum(s[0] == k for s in want) for k in secrets.BASE]
    assert found > 1000 and secrets.scan_report(make(rows).limit(0)).count() == 0


def test_secrets_of_any_length():
    for n in (32, 126, 128, 129, 150, 5000, 200_000):
        secret = ("Ab1" * n)[:n]
        assert secrets.spans_of(f"user: bob\n{secret} end", 200) == [(5, 0, 9), (3, 10, 10 + n)]


def test_linking_against_all_pairs():
    rnd = random.Random(3)
    pieces = ["user=bob ", "Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5MEFCQ0RFRg ", "https://a.example/b ", "word " * 20, "\n\n", "AKIA" + "Q1" * 8 + " "]
    for _ in range(200):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 25)))
        base = secrets.base_spans(text)
        weak = secrets.weak_spans(text, base)
        ends = [m.end() for m in secrets.SCOPE_END.finditer(text)]
        scope = lambda s: sum(e <= s[0] for e in ends)
        parts = weak | base
        want = {k: [s for s in weak[k] if any(o != s and scope(o) == scope(s) and 0 <= max(o[0] - s[1], s[0] - o[1]) <= 150 for c in secrets.COMPLEMENTS[k] for o in parts[c])] for k in secrets.WEAK}
        assert secrets.linked(weak, base, ends, 150) == want


def test_linking_past_overlaps():
    """Pieces whose spans overlap those of other kinds, against all pairs; one hid the valid part beside it."""
    secret = "Zm9vYmFyYmF6cXV4MTIzNDU2Nzg5MEFCQ0RF"
    text = f'login: bob\nuser: "{secret}"'
    assert secrets.spans_of(text, 200) == [(5, 0, 10), (3, 18, 54)]
    rnd, hidden = random.Random(4), 0
    pieces = ["user: bob ", f'login="{secret}" ', f"user={secret} ", "https://a.example/?token=abcdef1&password=abcdef2 ", f"https://a.example/{secret} ", "password: hunter22 ", "deadbeef" * 4 + " ", "word " * 12, "\n\n"]
    for _ in range(300):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 12)))
        base = secrets.base_spans(text)
        weak = secrets.weak_spans(text, base)
        ends = [m.end() for m in secrets.SCOPE_END.finditer(text)]
        scope = lambda s: sum(e <= s[0] for e in ends)
        parts = weak | base
        want = {k: [s for s in weak[k] if any(scope(o) == scope(s) and 0 <= max(o[0] - s[1], s[0] - o[1]) <= 60 for c in secrets.COMPLEMENTS[k] for o in parts[c])] for k in secrets.WEAK}
        assert secrets.linked(weak, base, ends, 60) == want
        hidden += any(o[0] < s[1] and s[0] < o[1] for k in secrets.WEAK for s in want[k] for c in secrets.COMPLEMENTS[k] for o in parts[c])
    assert hidden > 50


def edits(text, n, rnd):
    s = list(text)
    for _ in range(n):
        i = rnd.randrange(len(s))
        s[i : i + 1] = rnd.choice([[], ["#"], [s[i], "~"]])
    return "".join(s)


def test_distance_against_dynamic_programming():
    rnd = random.Random(0)
    for _ in range(500):
        p = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 12)))
        w = "".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 30)))
        row = [0] * (len(w) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, e in enumerate(w, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
            row = new
        assert decontam.distances(p, w, len(p))[0] == min(row)


def test_benchmark_items_are_found_with_edits(spark, make):
    rnd = random.Random(5)
    words = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 9))) for _ in range(n))
    items = [(i, words(40)) for i in range(12)] + [(50, None), (51, ""), (52, "tiny")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows, want = [], set()
    for i in range(60):
        text = words(rnd.randrange(0, 120))
        if i % 3 == 0:
            key, item = items[i % 12]
            k = decontam.budget(len(decontam.plain(item)), 0.1)
            cut = rnd.randrange(len(text) + 1)
            text = text[:cut] + " " + edits(item, rnd.randrange(0, k + 1), rnd).upper() + " " + text[cut:]
            want.add((i, key))
        rows.append((i, text))
    got = decontam.contaminated(make(rows + [(100, None), (101, ""), (None, items[0][1])]), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got if r["doc_id"] is not None} == want
    assert any(r["doc_id"] is None for r in got)
    left = decontam.decontaminated(make(rows), bench)
    assert {r["doc_id"] for r in left.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontam.contaminated(make(rows), bench.limit(0)).count() == 0


def search_row(item, text):
    """Least edits between an item and a part of a text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, e in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return min(row)


def test_decontamination_against_a_full_sweep(spark, make):
    """All items against all texts; edits below, at and above the budget; ids of text; a long text, short items."""
    rnd = random.Random(15)
    words = lambda n: " ".join("".join(rnd.choice("abcde") for _ in range(rnd.randrange(2, 6))) for _ in range(n))
    items = [(f"i{i}", words(rnd.randrange(7, 20))) for i in range(8)] + [("s1", "Short one"), ("s2", "zq"), ("e", " \n"), ("w", "\u3000\u2003"), ("n", None)]
    rows = []
    for i in range(40):
        item = items[i % 8][1]
        k = decontam.budget(len(decontam.plain(item)), 0.1)
        rows.append((i, f"{words(6)} {edits(item, max(0, k + i % 5 - 3), rnd)} {words(6)}"))
    rows += [(50, "a short  ONE here"), (51, "ashort one"), (52, "zq"), (53, "zqzq"), (54, "ab " * 100_000 + items[3][1]), (55, None), (56, "")]
    bench = spark.createDataFrame(items, "item_id string, text string").selectExpr("*", "1 key", "2 distance")
    want = set()
    for i, t in rows:
        for name, item in items:
            p, t1 = decontam.plain(item or ""), decontam.plain(t or "")
            if not p or len(t1) > 10_000:
                continue
            if len(p) < 10:
                hit = re.search(rf"(?<![a-z]){re.escape(p)}(?![a-z])", t1) is not None
            else:
                hit = search_row(p, t1) <= decontam.budget(len(p), 0.1)
            want |= {(i, name)} if hit else set()
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(make(rows), bench).collect()}
    assert {g for g in got if g[0] != 54} == want and (54, "i3") in got and {(50, "s1"), (52, "s2")} <= got
    assert {r["item_id"] for r in decontam.unsearchable(bench).collect()} == {"e", "w", "n"}


def test_the_whole_budget_is_used():
    """Items of many lengths against the whole table, with edits up to, at and above a tenth of their length."""
    rnd = random.Random(25)
    for n in [*range(1, 60), 80, 100, 140, 300]:
        item = decontam.plain("".join(rnd.choice("abcdef ") for _ in range(n)) + "x")
        k = decontam.budget(len(item), 0.1)
        assert k == len(item) // 10
        matcher = decontam.Matcher([item], 0.1)
        for e in {0, k // 2, k, k, k + 1, k + 2}:
            for _ in range(4):
                text = decontam.plain("".join(rnd.choice("abcdef ") for _ in range(60)) + edits(item, e, rnd) + "".join(rnd.choice("abcdef ") for _ in range(60)))
                least = search_row(item, text)
                got = [h[1] for h in matcher.found(text)]
                if k:
                    assert got == ([least] if least <= k else []), (item, text)


def test_blank_items_find_nothing(spark, make):
    bench = spark.createDataFrame([(1, "\u3000"), (2, "\x1c \u2003")], "item_id long, text string")
    assert decontam.contaminated(make(ODD), bench).count() == 0 and decontam.decontaminated(make(ODD), bench).count() == len(ODD)
    assert list(decontam.Matcher(["", "\u3000"], 0.1).found("a b")) == []


def test_blocks_of_items_find_the_same(spark, make, monkeypatch):
    rnd = random.Random(16)
    items = [(i, " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randrange(99)) for _ in range(9))) for i in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = make([(i, f"x {items[i % 12][1]} y") for i in range(30)])
    once = {tuple(r) for r in decontam.contaminated(docs, bench).collect()}
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 200)
    assert {tuple(r) for r in decontam.contaminated(docs, bench).collect()} == once and len(once) >= 30
    assert decontam.decontaminated(docs, bench).count() == 0


def test_lines_against_brute_force(make):
    rnd = random.Random(2)
    lines = [f"line {i}" for i in range(30)]
    rows = [(i, "\n".join(rnd.choice([*lines, "  " + lines[0], "", f"own {i} {j}"]) for j in range(rnd.randrange(0, 9))), f"s{rnd.randrange(6)}") for i in range(120)]
    rows += [(500, None, "s1"), (501, "", None), (502, "line 0\r\nline 1", None), (7, rows[7][1], rows[7][2])]
    sites, first = {}, {}
    for i, t, s in rows:
        for x in (t or "").split("\n"):
            if x.strip(" \t\n\x0b\x0c\r"):
                k = x.strip(" \t\n\x0b\x0c\r")
                sites.setdefault(k, set()).add(s)
                first[k] = min(first.get(k, i), i)
    gone = lambda i, x: (k := x.strip(" \t\n\x0b\x0c\r")) and len(sites[k]) >= 4 and first[k] != i
    want = sorted((i, None if t is None else "\n".join(x for x in t.split("\n") if not gone(i, x))) for i, t, _ in rows)
    got = line_dedup.without_boilerplate(make(rows), min_sites=4)
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == want
    assert line_dedup.without_boilerplate(make(rows).limit(0)).count() == 0


def test_mix(make):
    rnd = random.Random(8)
    rows = [(i, "w " * rnd.randrange(0, 50), rnd.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(3000)] + [(9000, None, "e"), (None, "x y", "a")]
    mix = mixing.mixed(make(rows), block_rows=100)
    got = mix.select("doc_id", "source", "__size", "__source_size", "__target", (F.col("__copies") * F.col("__size")).alias("taken"), "__copies").collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["__size"]
        by.setdefault(r["source"], [r["__source_size"], r["__target"], 0])[2] += r["taken"]
    total = sum(v[0] for v in by.values())
    assert abs(sum(v[1] for v in by.values()) - 1.5 * total) < 1e-6 * total and all(v[1] <= 2 * v[0] for v in by.values())
    assert all(abs(v[2] - v[1]) <= 100 for v in by.values())
    again = mixing.mixed(make(rows).repartition(7), block_rows=100).select("doc_id", "__copies").collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in mix.select("doc_id", "__copies").collect())
    assert mixing.emitted(mix).count() == sum(r["__copies"] for r in got)
    assert mixing.mixed(make(rows).limit(0)).count() == 0


def test_languages(make, spark):
    words = {"aa": ["kala", "tuna", "rimo", "sada"], "bb": ["schwer", "dicht", "wand", "stolz"]}
    rnd = random.Random(6)
    rows = [(i, " ".join(rnd.choice(words[x]) for _ in range(rnd.randrange(1, 40))), "s", x) for i in range(400) for x in [rnd.choice(["aa", "bb"])]]
    rows.append((400, "kala " * 60_000, "s", "aa"))
    docs = make(rows + [(900, None), (901, ""), (902, "123 !!"), (903, "漢字仮名" * 50, "s", None), (904, "漢" * 700_000, "s", None), (None, "tuna rimo", "s", None)])
    models = langid.language_models(docs)
    got = {r["doc_id"]: r for r in langid.identified(docs, models).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]  # rows that no count has seen
    assert len(held) > 50 and sum(got[r[0]]["lang_pred"] == r[3] for r in held) >= 0.98 * len(held)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and not got[903]["accepted"] and not got[904]["accepted"] and got[None]["accepted"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = {r["doc_id"] for r in langid.accepted_rows(docs, models).collect()}
    assert kept == {i for i, r in got.items() if r["accepted"]} and len(kept) >= 0.98 * len(rows)
    none = langid.language_models(docs.limit(0))
    assert {r["lang_pred"] for r in langid.identified(docs, none).collect()} == {"und"}


def test_long_words_and_layout(make):
    """A word's score doesn't depend on its company, nor a text's on its line feeds; fractions are no letters."""
    rnd = random.Random(7)
    rows = [(i, " ".join(rnd.choice(["kala", "tuna", "rimo"]) for _ in range(20)), "s", "aa") for i in range(200)]
    models = langid.language_models(make(rows))
    long = "".join(rnd.choice("kaltunrimo") for _ in range(150_000))
    alone = langid.Scorer(models).cross_entropies([long])[0]
    company = langid.Scorer(models).cross_entropies(["tuna rimo", "zz", long, "kala"])[0]
    assert alone[0, 0] == company[2, 0]
    assert abs(models.scores([long])[0, 0] - models.long_score(long)[0, 0]) < 1e-6 * abs(models.scores([long])[0, 0])
    bits, chars = langid.Scorer(models).cross_entropies(["ab cd", "ab\n\n\n\ncd", "\tab  cd "])
    assert bits[0, 0] == bits[1, 0] == bits[2, 0] and chars.tolist() == [6, 6, 6]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identified(make([(1, "½ ²"), (2, "Ⅷ ⅸ"), (3, "½ a"), (4, "漢"), (5, "_ 12")]), models).collect()}
    assert got == {1: "und", 2: "und", 3: "aa", 4: "aa", 5: "und"}


def brute_kneser_ney(texts):
    """ln P of a word's characters by the textbook's recursion over plain dictionaries."""
    raw = Counter(g for t in texts for w in t.lower().split() for p in [f" {w} "] for n in range(1, langid.ORDER + 1) for g in (p[i : i + n] for i in range(len(p) - n + 1)))
    before = Counter(g[1:] for g in raw if len(g) > 1)
    count = {g: c if len(g) == langid.ORDER or (len(g) > 1 and g[0] == " ") else before[g] for g, c in raw.items()}
    after, kinds, seen = Counter(), Counter(), Counter()
    for g, c in count.items():
        after[g[:-1]] += c
        kinds[g[:-1]] += 1
        seen[len(g), c] += 1

    def p(context, x):
        lower = 1 / langid.ALPHABET if not context else p(context[1:], x)
        if context not in after:
            return lower
        ones, twos = seen[len(context) + 1, 1], seen[len(context) + 1, 2]
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        return max(count.get(context + x, 0) - d, 0) / after[context] + d * kinds[context] / after[context] * lower

    return lambda word: sum(math.log2(p(f" {word} "[max(0, i - langid.ORDER + 1) : i], f" {word} "[i])) for i in range(1, len(word) + 2)), p, count


def test_models_against_the_plain_recursion(spark):
    rnd = random.Random(9)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 9)))
    texts = {"a": [" ".join(word("abcdé") for _ in range(30)) for _ in range(8)], "b": [" ".join(word("wxyzab") for _ in range(30)) for _ in range(8)]}
    rows = spark.createDataFrame([(x, t) for x in texts for t in texts[x]], "lang string, text string")
    models = langid.Models.of(langid.fitted(langid.gram_counts(rows)))
    asked = [word("abcdéwxyz漢") for _ in range(300)] + ["a", "é" * 40]
    got = models.scores(asked)
    for col, x in enumerate("ab"):
        of_word, p, count = brute_kneser_ney(texts[x])
        assert max(abs(g - of_word(w)) for g, w in zip(got[:, col], asked, strict=True)) < 1e-3
        letters = {g for g in count if len(g) == 1}
        for context in ["", "a", "ab", " b", "aba"]:  # the known characters and the floor's share of the others
            rest = (langid.ALPHABET - len(letters)) * p(context, "漢")
            assert abs(sum(p(context, c) for c in letters) + rest - 1) < 1e-9


def test_events_fold(spark):
    log = [
        ("c", 1, 1, "open", "user", None), ("c", 1, 2, "delta", None, "Hel"), ("c", 1, 3, "delta", None, "lo"),
        ("c", 2, 4, "open", "assistant", None), ("c", 2, 5, "delta", None, "bad"), ("c", 2, 6, "regenerate", None, None), ("c", 2, 8, "delta", None, "b"), ("c", 2, 7, "delta", None, "a"),
        ("c", 1, 9, "edit", None, "Bye"), ("c", 1, 10, "delta", None, "!"), ("c", 3, 11, "unknown", "user", "zzz"), ("d", 1, 1, "delta", "user", "no start"),
    ]
    events = spark.createDataFrame(log, "conversation string, message long, seq long, kind string, role string, text string")
    got = {r["conversation"]: r for r in chat.formatted(events).collect()}
    assert chat.parsed(got["c"]["formatted"]) == [("user", "Bye!"), ("assistant", "ab")] and chat.parsed(got["d"]["formatted"]) == [("user", "no start")]
    s = got["c"]["loss_spans"][0]
    assert got["c"]["formatted"][s["start"] : s["end"]] == "ab" and len(got["c"]["loss_spans"]) == 1
    assert chat.formatted(events.limit(0)).count() == 0


def folded(log):
    """Final messages of a log, event by event."""
    said, first, roles = {}, {}, {}
    order = {"open": 0, "regenerate": 0, "edit": 0, "delta": 1}
    for c, m, seq, kind, role, text in sorted(log, key=lambda e: (e[2], order.get(e[3], 2), e[5] or "")):
        if kind in order:
            first.setdefault((c, m), seq)
            said[c, m] = (said.get((c, m), "") if kind == "delta" else "") + (text or "")
            if role is not None:
                roles[c, m] = role
    talks = {}
    for c, m in sorted(said, key=lambda k: (first[k], k[1])):
        talks.setdefault(c, []).append((roles.get((c, m), ""), said[c, m]))
    return talks


def test_fold_against_event_by_event(spark):
    rnd, log = random.Random(12), []
    for seq in range(1500):
        kind = rnd.choice(["open", "delta", "delta", "delta", "edit", "regenerate", "noise"])
        log.append((f"c{rnd.randrange(12)}", rnd.randrange(6), seq, kind, rnd.choice([None, "user", "assistant"]), None if kind in ("open", "regenerate") else rnd.choice(["é", "</s>", "a b", "\n", None, "x" * 50])))
    rnd.shuffle(log)
    events = spark.createDataFrame(log, "conversation string, message long, seq long, kind string, role string, text string")
    got = {r["conversation"]: chat.parsed(r["formatted"]) for r in chat.formatted(events).collect()}
    assert got == folded(log)


def test_logs_of_rows_hold_edits_and_regenerations(spark):
    rows = [(i % 9, i // 9, "assistant" if i % 2 else "user", "w" * (i % 7) + f" é{i}") for i in range(400)] + [(0, 50, "assistant", "long " * 200_000), (None, None, None, None), (3, 3, "user", "twice"), (3, 3, "user", "twice")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 conversation", "2 message", "'x' kind", "3 seq", "4 style")
    log = chat.events_of_rows(t)
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == set(chat.KINDS)
    got = {r["conversation"]: chat.parsed(r["formatted"]) for r in chat.formatted(log).collect()}
    key = lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or "")
    for c in {r[0] for r in rows}:
        assert got[c] == [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=key)]


def test_bytes_that_are_no_text(spark):
    raw = spark.createDataFrame([(1, 0, "user", bytearray(b"a\xffb"))], "conv_id long, turn long, role string, text binary")
    rows = raw.withColumn("text", F.col("text").cast("string"))
    r = chat.read_back(chat.formatted(chat.events_of_rows(rows))).first()
    assert r["n_turns"] == 1 and r["turns_sha256"] == hashlib.sha256("user\na�b\n".encode()).hexdigest()


def test_chat_round_trip():
    rnd = random.Random(2)
    parts = [*chat.CONTROL, "\\", "\n", "<", "[", "|", "a", "</", "s>", "im_start|>", "\\n", "n"]
    some = lambda n: "".join(rnd.choice(parts) for _ in range(rnd.randrange(n)))
    for _ in range(5000):
        turns = [(some(5), some(9)) for _ in range(rnd.randrange(4))]
        assert chat.parsed(chat.rendered(turns)[0]) == turns
        assert not any(c in chat.escaped(t) for _, t in turns for c in chat.CONTROL)


def test_chat_rows(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "é<s>"), (2, 0, "user", "x"), (2, 0, "user", "x")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conversation"]: r for r in chat.read_back(chat.formatted(chat.events_of_rows(t))).collect()}
    assert got[1]["turns_sha256"] == hashlib.sha256("\né<s>\nassistant\n\n".encode()).hexdigest()
    assert got[1]["loss_chars"] == 0 and got[2]["n_turns"] == 2
