"""Cross-site boilerplate lines by distinct-site spread. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import BLANKS, hash_pair, written

#: A document without a key comes after all others when the first holder of a line is chosen.
LAST = (1 << 63) - 1


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _document(key: str, text: str) -> list[Column]:
    """Names a document by its key and text, so that repeated rows share a name."""
    return [c.alias(n) for c, n in zip(hash_pair(F.col(key).cast("string"), F.col(text)), ("__d1", "__d2"), strict=True)]


def site_lines(docs: DataFrame, *, key: str, text: str, site: str) -> DataFrame:
    """A row per non-blank line: its hash, site, document and place. Blanks round a line don't count."""
    picked = docs.select(F.col(key).alias("__key"), *_document(key, text), F.coalesce(F.col(site).cast("string"), F.lit("\x00")).alias("__site"), F.posexplode(_lines(F.col(text))).alias("__at", "__line"))
    line = F.btrim("__line", F.lit(BLANKS))
    h1, h2 = hash_pair(line)
    return picked.filter(F.length(line) > 0).select(h1.alias("__h1"), h2.alias("__h2"), "__site", F.coalesce("__key", F.lit(LAST)).alias("__order"), "__d1", "__d2", "__at")


def boilerplate_lines(lines: DataFrame, *, min_sites: int, precision: int = 8) -> DataFrame:
    """``__h1, __h2, __first`` of the lines on ``min_sites`` sites or more.

    A HyperLogLog sketch of sites per line hash is built map-side and merged by aggregation, so
    a line on a third of all pages moves one sketch per task. Where the estimate lies within
    four standard errors of the threshold, sites are counted exactly; elsewhere the sketch decides.
    """
    error = 4 * 1.04 / 2 ** (precision / 2)
    spread = lines.groupBy("__h1", "__h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("__site", F.lit(precision))).alias("__sites"), F.min("__order").alias("__first"))
    spread = written(spread.filter(F.col("__sites") >= min_sites * (1 - error)), "spread")
    sure = F.col("__sites") > min_sites * (1 + error)
    near = spread.filter(~sure).select("__h1", "__h2", "__first")
    sites = lines.join(near, ["__h1", "__h2"]).select("__h1", "__h2", "__first", "__site").distinct()
    exact = sites.groupBy("__h1", "__h2", "__first").agg(F.count(F.lit(1)).alias("__sites")).filter(F.col("__sites") >= min_sites)
    return spread.filter(sure).select("__h1", "__h2", "__first").union(exact.select("__h1", "__h2", "__first"))


def without_boilerplate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", site: str = "source", min_sites: int = 10) -> DataFrame:
    """``docs`` with ``text`` freed of boilerplate, ``__n_lines`` and ``__n_removed``.

    A line (trimmed of blanks, whole, case kept) is boilerplate when documents of ``min_sites``
    or more sites hold it; a null site counts as one site. It stays in the document with the
    smallest key, so that content copied across sites is not lost altogether, and goes from all
    others. Blank lines stay where they are. No document is dropped: a text may become empty,
    a null text stays null with no lines. Rows that repeat key and text are one document; rows
    that repeat a key with other texts each hold to the same rule. Null keys come last.

    Line hashes, not lines, are shuffled and kept in the shared folder; texts move once.
    """
    lines = written(site_lines(docs, key=key, text=text, site=site), "lines")
    common = boilerplate_lines(lines, min_sites=min_sites)
    goes = lines.join(common, ["__h1", "__h2"]).filter((F.col("__order") != F.col("__first")) | (F.col("__order") == LAST))
    places = goes.groupBy("__d1", "__d2").agg(F.sort_array(F.collect_set("__at")).alias("__gone"))
    named = docs.select("*", *_document(key, text))
    out = named.join(places.hint("shuffle_hash"), ["__d1", "__d2"], "left")
    all_lines = _lines(F.col(text))
    left = F.array_except(F.sequence(F.lit(0), F.size(all_lines) - 1), F.col("__gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get(all_lines, i)), "\n")
    cleaned = F.when(F.col("__gone").isNull(), F.col(text)).otherwise(kept)
    n = F.coalesce(F.size(all_lines), F.lit(0)).cast("long")
    n = F.when(F.col(text).isNull(), F.lit(0)).otherwise(n)
    return out.select(*[cleaned.alias(c) if c == text else F.col(c) for c in docs.columns], n.alias("__n_lines"), F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("__n_removed"))
