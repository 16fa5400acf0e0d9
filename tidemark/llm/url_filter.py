"""URL filters: rules first, then a character language-model ratio. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import md5_number, written

#: (verdict, host and path); the longest that fits wins.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
ORDER = 4
#: Log ratios are summed as whole millionths, so that sums don't depend on their order.
UNIT = 1_000_000
ALPHABET = 256.0
#: Rows of gram and ratio that are broadcast at most, some 60 bytes each; beyond, the join shuffles.
BROADCAST_GRAMS = 500_000
#: Cuts between accepted and rejected scores are whole thousandths.
CUT = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def ruled(pages: DataFrame, *, url: str, rules: tuple[tuple[str, str], ...]) -> DataFrame:
    """``pages`` with ``__host, __path, __rule, __by_rule``."""
    host, path = host_and_path(F.col(url))
    named = pages.withColumn("__host", host).withColumn("__path", path)
    fits = []
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        domain, slash, rest = rule.partition("/")
        inside = (F.col("__host") == domain) | F.col("__host").endswith("." + domain)
        fits.append(F.when(inside & F.col("__path").startswith(slash + rest), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    best = F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")
    return named.withColumn("__best", best).withColumn("__rule", F.col("__best.rule")).withColumn("__by_rule", F.col("__best.verdict")).drop("__best")


def _grams(urls: DataFrame, *keep: str) -> DataFrame:
    """A row for each character of a URL and its end: the ``ORDER`` characters up to it."""
    padded = F.concat(F.lit("\x02" * (ORDER - 1)), F.translate("__url", UPPER, LOWER), F.lit("\x03"))
    spelled = urls.select(*keep, padded.alias("__p"))
    places = F.expr(f"transform(sequence(1, length(__p) - {ORDER - 1}), i -> substring(__p, i, {ORDER}))")
    return spelled.select(*keep, F.explode(places).alias("gram"))


def gram_ratios(urls: DataFrame) -> DataFrame:
    """``gram, ratio`` for every full-length gram of ``urls`` (``__url, __class, __learn``).

    ``ratio`` is ln P(char | context, accepted) - ln P(char | context, rejected) in millionths.
    Each class has a Markov model of variable order: the count of a character after a context is
    mixed with the next shorter context's estimate by the number of different characters seen
    after it (Witten-Bell), down to a uniform floor; contexts never seen are passed over.
    Counts come from all rows with ``__learn``; shorter orders are sums of the longest.
    """
    seen = F.col("__learn") & (F.col("__class") == "allow"), F.col("__learn") & (F.col("__class") == "block")
    marked = urls.select("__url", F.coalesce(seen[0], F.lit(False)).cast("int").alias("a"), F.coalesce(seen[1], F.lit(False)).cast("int").alias("b"))
    full = written(_grams(marked, "a", "b").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "grams")
    orders = F.explode(F.sequence(F.lit(1), F.lit(ORDER))).alias("n")
    shorter = full.filter("a + b > 0").select("a", "b", "gram", orders).select("n", F.expr(f"substring(gram, {ORDER + 1} - n, n)").alias("part"), "a", "b")
    counts = written(shorter.groupBy("n", "part").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "counts")
    sums = [F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.sum((F.col("a") > 0).cast("long")).alias("ua"), F.sum((F.col("b") > 0).cast("long")).alias("ub")]
    before = written(counts.groupBy("n", F.expr("substring(part, 1, n - 1)").alias("before")).agg(*sums), "contexts")
    steps = full.select("gram")
    for n in range(1, ORDER + 1):
        # Grams are distinct, so few end in one part of three characters or more; shorter parts, which many share, are few.
        own, context = _small(counts.filter(F.col("n") == n)), _small(before.filter(F.col("n") == n))
        own = own.select(F.col("part").alias(f"__part{n}"), F.struct("a", "b").alias(f"__own{n}"))
        context = context.select(F.col("before").alias(f"__before{n}"), F.struct("ta", "ua", "tb", "ub").alias(f"__context{n}"))
        steps = steps.join(own, F.expr(f"substring(gram, {ORDER + 1 - n}, {n})") == F.col(f"__part{n}"), "left")
        steps = steps.join(context, F.expr(f"substring(gram, {ORDER + 1 - n}, {n - 1})") == F.col(f"__before{n}"), "left").drop(f"__part{n}", f"__before{n}")
    number = lambda n, c: F.coalesce(F.col(f"__own{n}" if c in "ab" else f"__context{n}")[c], F.lit(0)).cast("double").alias(c)
    steps = steps.select("gram", F.array(*[F.struct(*[number(n, c) for c in ("a", "ta", "ua", "b", "tb", "ub")]) for n in range(1, ORDER + 1)]).alias("steps"))

    def chance(c: str, t: str, u: str) -> Column:
        return F.aggregate("steps", F.lit(1 / ALPHABET), lambda p, s: F.when(s[t] > 0, (s[c] + s[u] * p) / (s[t] + s[u])).otherwise(p))

    ratio = F.ln(chance("a", "ta", "ua")) - F.ln(chance("b", "tb", "ub"))
    return steps.select("gram", F.round(ratio * UNIT).cast("long").alias("ratio"))


def _small(df: DataFrame) -> DataFrame:
    """``df`` broadcast if it has at most ``BROADCAST_GRAMS`` rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_GRAMS else df


def best_cut(scored: DataFrame) -> float | None:
    """The score from which URLs are accepted, by the errors on ``scored`` (``__class, __score``); None if a class lacks.

    Each cut rejects a share of the accepted and accepts a share of the rejected; the one with the
    least sum is taken, the lowest of equal ones, in the middle of the gap below it. Scores are
    means of log ratios and so lie within a few dozen: cut in thousandths, few bins meet in a task.
    """
    bins = scored.groupBy(F.floor(F.col("__score") * CUT).alias("bin")).agg(F.sum((F.col("__class") == "allow").cast("double")).alias("a"), F.sum((F.col("__class") == "block").cast("double")).alias("b"))
    line, everything = Window.orderBy("bin"), Window.partitionBy()
    lost = F.coalesce(F.sum("a").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) / F.sum("a").over(everything)
    let_in = F.sum("b").over(line.rowsBetween(0, Window.unboundedFollowing)) / F.sum("b").over(everything)
    cuts = bins.select("bin", (lost + let_in).alias("errors"), ((F.coalesce(F.lag("bin").over(line) + 1, F.col("bin")) + F.col("bin")) / F.lit(2.0 * CUT)).alias("cut"))
    return cuts.agg(F.min_by("cut", F.struct("errors", "bin")), F.min("errors")).first()[0]


def judged(pages: DataFrame, *, url: str = "url", rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """``pages`` with ``__host, __path, __rule, __verdict, __score``.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest
    decides. Other URLs go by the sum of their characters' log-likelihood ratios over their
    length. The cut is set by the errors on ruled URLs that a hash kept from the counts (a fifth
    of them; all of them where that fifth lacks a class), see ``best_cut``. Without rules of both
    classes to learn from the ratio says nothing and URLs pass. A null URL is judged as an empty
    one. Each distinct URL is scored once, so repeated rows agree; empty tables give no rows.
    """
    named = ruled(pages.withColumn("__u", F.coalesce(url, F.lit(""))), url="__u", rules=rules)
    fifth = md5_number(F.lit("calibrate"), F.col("__url")) % 5 == 0
    urls = named.groupBy(F.col("__u").alias("__url")).agg(F.first("__by_rule").alias("__class"))
    urls = written(urls.withColumn("__learn", F.col("__class").isNotNull() & ~fifth), "urls")
    ratios = _small(written(gram_ratios(urls), "ratios"))
    sums = _grams(urls, "__url").join(ratios, "gram").groupBy("__url").agg(F.sum("ratio").alias("sum"), F.count(F.lit(1)).alias("n"))
    scored = written(sums.select("__url", (F.col("sum") / F.col("n") / UNIT).alias("__score")).join(urls, "__url"), "scores")
    known = scored.filter(F.col("__class").isNotNull())
    apart = known.filter(~F.col("__learn"))
    if apart.select("__class").distinct().count() < 2:
        apart = known
    cut = best_cut(apart) if apart.select("__class").distinct().count() == 2 else None
    scores = scored.select("__url", "__score")
    out = named.join(scores, F.col("__u") == F.col("__url"), "left").drop("__url")
    by_model = F.lit("allow") if cut is None else F.when(F.col("__score") >= F.lit(cut), "allow").otherwise("block")
    return out.withColumn("__verdict", F.coalesce("__by_rule", by_model)).select(*pages.columns, "__host", "__path", "__rule", "__verdict", "__score")
