"""Source divergence audit by one-hot level products."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import code_bytes, map_texts, written

#: Bytes of terms: ASCII letters and all of non-ASCII characters; A-Z become lower case, the rest a space.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Entries of counts that a task holds before it hands them on.
HELD = 300_000
#: Terms and groups in a block of the products; columns of indicators and terms of one product.
BLOCK_TERMS, BLOCK_GROUPS = 1024, 32
MOST_COLUMNS, LEAST_TERMS = 1024, 16
#: Rows of groups that are broadcast at most; beyond, joins shuffle.
BROADCAST_ROWS = 200_000
SCALE, PRIOR = 1_000_000_000, 5


def term_counts(docs: DataFrame, *, text: str, lang: str, source: str) -> DataFrame:
    """``lang, source, term, n, docs``: partial sums of occurrences and of rows that hold the term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for (of, where), (n, rows) in seen.items():
                names = [pa.array([x] * len(n), pa.string()) for x in (of, where)]
                sums = [pa.array(x, pa.int64()) for x in (n.values(), map(rows.__getitem__, n))]
                yield pa.RecordBatch.from_arrays([*names, pa.array(n, pa.binary()), *sums], ["lang", "source", "term", "n", "docs"])
            seen.clear()

        held = 0
        for batch in batches:
            groups = zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
            for group, raw in zip(groups, code_bytes(batch, "text"), strict=True):
                found = Counter((raw or b"").translate(TERM_BYTES).split())
                n, rows = seen.setdefault(group, (Counter(), Counter()))
                before = len(n)
                n.update(found)
                rows.update(found.keys())
                held += len(n) - before
                if held > HELD:
                    yield from handed()
                    held = 0
        yield from handed()

    named = [F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]
    picked = docs.select(*named, F.col(text).cast("binary").alias("text"))
    return map_texts(picked, count, "lang string, source string, term binary, n long, docs long")


def kept_terms(counts: DataFrame, least_docs: int) -> DataFrame:
    """``lang, source, term, n, total, new``: counts of the terms that enough documents of the language hold.

    ``total`` sums the language's sources, ``new`` is 1 in one row a term. Partial sums move once,
    by language and term, and both sums are taken there.
    """
    moved = counts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    sums = {"total": F.sum("n").over(term), "of": F.sum("docs").over(term), "new": (F.col("source") == F.min("source").over(term)).cast("int")}
    return moved.withColumns(sums).filter(F.col("of") >= least_docs).select("lang", "source", "term", "n", "total", "new")


def share(n, whole, divided=lambda a, b: a // b):
    """1 + floor(1000000000 * n / whole) of whole numbers with n <= whole < 9 * 10^15.

    A thousand a step, so that no product leaves 64 bits; for numpy arrays and Spark columns.
    """
    out, rest = 1, n
    for power in (SCALE // 1000, SCALE // 1_000_000, 1):
        q = divided(rest * 1000, whole)
        out, rest = out + q * power, rest * 1000 - q * whole
    return out


def _p(n: Column, whole: Column) -> Column:
    """``share`` of the smoothed count ``n``."""
    return share(n + F.lit(PRIOR), whole, lambda a, b: F.call_function("div", a, b))


def _levels(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-hot columns of a (terms x groups) matrix: the column of each cell, each column's group and level."""
    groups = np.arange(counts.shape[1])
    order = np.argsort(counts, axis=0, kind="stable")
    ranked = np.take_along_axis(counts, order, axis=0)
    fresh = np.vstack([np.zeros((1, len(groups)), np.int64), (ranked[1:] != ranked[:-1]).astype(np.int64)])
    place = np.cumsum(fresh, axis=0)
    first = np.concatenate([[0], np.cumsum(place[-1] + 1)])
    column = np.empty_like(counts)
    np.put_along_axis(column, order, place + first[:-1], axis=0)
    level = np.empty(first[-1], np.int64)
    level[column] = counts
    return column, np.repeat(groups, place[-1] + 1), level


def _indicators(column: np.ndarray, width: int) -> np.ndarray:
    x = np.zeros((len(column), width), np.float32)  # sums of at most 2^24 ones are exact
    x[np.arange(len(column))[:, None], column] = 1
    return x


def joint_tables(left: np.ndarray, right: np.ndarray | None) -> Iterator[tuple[np.ndarray, ...]]:
    """Joint tables of count levels for all pairs of a group of ``left`` and one of ``right`` (None: left itself).

    Each item is (number of terms at the two levels, group and level of the rows, group and level of
    the columns): the indicator columns of some terms multiplied by their transpose. Terms are
    cut until the columns are few; tables of several cuts add up.
    """
    sides = [_levels(m) for m in (left, right) if m is not None]
    if max(len(level) for _, _, level in sides) > MOST_COLUMNS and len(left) > LEAST_TERMS:
        half = len(left) // 2
        yield from joint_tables(left[:half], None if right is None else right[:half])
        yield from joint_tables(left[half:], None if right is None else right[half:])
        return
    x, *y = [_indicators(column, len(level)) for column, _, level in sides]
    yield (x.T @ (y[0] if y else x), *sides[0][1:], *sides[-1][1:])


def _filled(cells: pd.DataFrame, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms x groups) counts of one side's cells, the groups' names and wholes; a cell without a term names its group."""
    names, at = np.unique(cells["source"].to_numpy(), return_inverse=True)
    counts, whole = np.zeros((terms, len(names)), np.int64), np.zeros(len(names), np.int64)
    whole[at] = cells["whole"].to_numpy()
    real = cells["row"].to_numpy() >= 0
    counts[cells["row"].to_numpy()[real], at[real]] = cells["n"].to_numpy()[real]
    return counts, names, whole


def priced(cells: pd.DataFrame, same: bool) -> pd.DataFrame:
    """``source, other, value, zero, seen``: each pair's differences summed over one block's terms, by joint tables.

    ``seen`` is the number of those terms, ``zero`` the difference at a term that neither holds.
    """
    common = cells.dropna(subset="term").groupby("term")["n"].sum().sort_values(kind="stable")  # like counts have few levels
    cells = cells.assign(row=pd.Index(common.index).get_indexer(cells["term"]))
    left, names, whole = _filled(cells[cells["side"] == 0], len(common))
    right, others, other_whole = (None, names, whole) if same else _filled(cells[cells["side"] == 1], len(common))
    value = np.zeros((len(names), len(others)), np.int64)
    for table, g, c, h, d in joint_tables(left, right) if value.size and len(common) else ():
        p, q = share(c + PRIOR, whole[g]), share(d + PRIOR, other_whole[h])
        worth = table.astype(np.int64) * np.abs(p[:, None] - q)
        rows, columns = (np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) for x in (g, h))
        value += np.add.reduceat(np.add.reduceat(worth, rows, axis=0), columns, axis=1)
    zero = np.abs(share(np.full(len(names), PRIOR), whole)[:, None] - share(np.full(len(others), PRIOR), other_whole))
    i, j = np.triu_indices(len(names), 1) if same else (x.ravel() for x in np.indices(value.shape))
    return pd.DataFrame({"source": names[i], "other": others[j], "value": value[i, j], "zero": zero[i, j], "seen": len(common)})


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _top(rows: DataFrame, most: int | None = None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = rows.withColumn("rank", rank)
    return ranked if most is None else ranked.filter(F.col("rank") <= most)


def audited(docs: DataFrame, *, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 30, most_terms: int = 50) -> DataFrame:
    """``lang, source, part, item, value, rank``: how sources of a language differ in their terms.

    Terms are runs of ASCII letters and non-ASCII characters, A-Z lower-cased; a language keeps
    those in ``least_docs`` of its documents or more. With N counted kept terms of a group and V
    kept terms of its language, a term with n occurrences has p = 1 + floor(10^9 (n + 5) / (N + 5 V)).
    Part ``pair``: each other source of the language, with the sum of the differences of p over
    the kept terms, all ranks. Part ``term``: terms of the source with p above the language's own,
    by the difference, ``most_terms`` of them. Ranks go by value, descending, then by item.

    Null texts, languages and sources count as ''. Repeated rows are documents of their own; a
    group without terms has pairs all the same (0 if its language keeps none). A language with one
    source has no pairs. An empty table gives no rows. Invalid UTF-8 stays in its terms.

    Joint tables of count levels come from products of one-hot matrices, a block of terms and of
    two lots of groups a task; a block's tables are priced where they arise and their sums added up.
    Terms that a block's groups lack are at level 0 in both and added from the number of kept terms.
    """
    groups = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"))]).distinct()
    kept = written(kept_terms(term_counts(docs, text=text, lang=lang, source=source), least_docs), "terms")
    sums = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("new").alias("v")), ["lang", "source"], "left")
    of = Window.partitionBy("lang")
    kinds = F.coalesce(F.sum("v").over(of), F.lit(0))
    wholes = [F.greatest(F.coalesce(n, F.lit(0)) + F.lit(PRIOR) * kinds, F.lit(1)) for n in (F.col("n"), F.sum("n").over(of))]
    lots = F.ceil(F.count(F.lit(1)).over(of) / F.lit(BLOCK_GROUPS)).cast("int")
    known = sums.select("lang", "source", kinds.alias("kinds"), wholes[0].alias("whole"), wholes[1].alias("every"), lots.alias("lots"))
    known = known.withColumn("lot", F.pmod(F.xxhash64("source"), F.col("lots")).cast("int"))
    known = written(known.withColumn("blocks", F.greatest(F.ceil(F.col("kinds") / F.lit(BLOCK_TERMS)), F.lit(1)).cast("int")), "groups")
    cells = kept.join(_small(known), ["lang", "source"])

    above = cells.withColumn("value", _p(F.col("n"), F.col("whole")) - _p(F.col("total"), F.col("every"))).filter("value > 0")
    terms = _top(above.select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value"), most_terms)
    both = F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))))
    pairs = _differences(cells, known).select("lang", both.alias("of"), "value")
    pairs = pairs.select("lang", *[F.col(f"of.{c}").cast("string").alias(c) for c in ("source", "item")], F.lit("pair").alias("part"), "value")
    return _top(pairs.select("lang", "source", "part", "item", "value")).unionByName(terms)


def _differences(cells: DataFrame, known: DataFrame) -> DataFrame:
    """``lang, source, other, value``: each pair of sources once, from the products of all blocks."""
    binary = [F.col("source").cast("binary").alias("source"), "whole", "kinds"]
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    held = cells.select("lang", *binary, "lot", "lots", block, "term", "n")
    # Each task also gets a cell without a term for each of its groups.
    named = known.filter("lots > 0").select("lang", *binary, "lot", "lots", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(None).cast("binary").alias("term"), F.lit(0).cast("long").alias("n"))
    # A lot meets each lot of the language; the lower one is the left side.
    met = held.unionByName(named).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)))
    side = (F.col("lot") > F.col("with")).cast("int").alias("side")
    dealt = met.select("lang", "block", F.least("lot", "with").alias("i"), F.greatest("lot", "with").alias("j"), side, *binary[1:], "source", "term", "n")

    def products(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return priced(rows, key[2] == key[3]).assign(lang=key[0], kinds=rows["kinds"].iloc[0])[["lang", "source", "other", "value", "zero", "seen", "kinds"]]

    made = dealt.groupBy("lang", "block", "i", "j").applyInPandas(products, "lang string, source binary, other binary, value long, zero long, seen long, kinds long")
    total = F.sum("value") + (F.max("kinds") - F.sum("seen")) * F.max("zero")
    return made.groupBy("lang", "source", "other").agg(total.alias("value"))
