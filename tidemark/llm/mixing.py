"""Mixing sources to target weights by systematic sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import md5_number, word_count, written

#: Expected copies are whole multiples of 2^-24, so that prefix sums are exact in any order.
UNIT = 1 << 24
#: Rows of sources or of blocks that are broadcast at most; beyond, the join shuffles.
BROADCAST_ROWS = 200_000


def source_targets(docs: DataFrame, *, source: str = "source", size: str = "__size", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: ``__source, __n, __source_size, __target``.

    Sources by code point (null last) take the weights in turn. They share ``share`` times all
    sizes; a source stops at ``most`` times its own size and its excess goes to the others by
    weight. That fixed point is a water level: target = min(cap, weight * level), with the level
    found by one running sum over the sources in the order of cap / weight. The table has a row
    per source; only these rows meet in one task. An empty table gives no rows; a source of size
    zero has target zero.
    """
    per = docs.groupBy(F.col(source).alias("__source")).agg(F.count(F.lit(1)).alias("__n"), F.sum(size).alias("__source_size"))
    by_name = Window.orderBy(F.col("__source").asc_nulls_last())
    turn = F.array(*map(F.lit, weights))[(F.row_number().over(by_name) - 1) % len(weights)]
    caps = per.withColumn("__w", turn.cast("double")).withColumn("__cap", F.col("__source_size") * F.lit(float(most)))
    level = Window.orderBy(F.col("__cap") / F.col("__w"), F.col("__source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    # Level if this source and all after it are below their caps; valid for the first that is.
    rest = F.sum("__source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    heavy = F.sum("__w").over(everything) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))
    levels = caps.withColumn("__level", rest / heavy).withColumn("__fits", F.col("__cap") >= F.col("__level") * F.col("__w"))
    water = F.min(F.when(F.col("__fits"), F.struct((F.col("__cap") / F.col("__w")).alias("a"), F.col("__level").alias("b")))).over(everything)["b"]
    target = F.when(F.col("__source_size") == 0, 0.0).otherwise(F.least(F.col("__cap"), F.coalesce(water * F.col("__w"), F.col("__cap"))))
    return levels.select("__source", "__n", "__source_size", target.alias("__target"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def mixed(docs: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", size: str | None = None, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 11, block_rows: int = 200_000) -> DataFrame:
    """Every row of ``docs`` with ``__size, __source_size, __target, __copies``.

    A document's expected copies are its source's target over the source's size. Documents stand
    by size class within the source, so that each stretch of the line holds like sizes; prefix
    sums of expected copies plus one offset for the source cross a whole number once for each
    copy. A source's line is cut into blocks of about ``block_rows`` rows: blocks are summed
    first, then each is numbered by itself, so no source meets in one task. Sums are taken over a
    narrow table of keys and sizes; the rows themselves move once, to be numbered. ``size`` names
    a column that has the sizes; without it, words of ``text`` are counted.

    The offset comes from a hash of seed and source: reruns agree. Null texts have size 0 and so
    do blank ones; they are placed like others and take no words. A null key sorts first;
    repeated rows are documents of their own, copies being the same in sum whichever comes first.
    """
    sized = docs.withColumn("__size", word_count(F.col(text)) if size is None else F.col(size))
    narrow = written(sized.select(F.col(source).alias("__source"), F.col(key).alias("__key"), "__size"), "sizes")
    targets = written(source_targets(narrow, source="__source", weights=weights, share=share, most=most), "targets")
    each = F.when(F.col("__source_size") > 0, F.floor(F.col("__target") / F.col("__source_size") * F.lit(float(UNIT)))).otherwise(0).cast("long")

    def placed(rows: DataFrame, of: str, name: str) -> DataFrame:
        rows = rows.join(_small(targets.withColumnRenamed("__source", "__t")), rows[of].eqNullSafe(F.col("__t")), "left").drop("__t")
        blocks = F.ceil(F.col("__n") / F.lit(block_rows)).cast("long")
        return rows.withColumns({"__each": each, "__band": F.length(F.bin("__size")), "__part": F.pmod(md5_number(F.lit(seed), F.col(name)), blocks)})

    sums = placed(narrow, "__source", "__key").groupBy(F.col("__source").alias("__s"), F.col("__band").alias("__b"), F.col("__part").alias("__p")).agg(F.sum("__each").alias("__sum"))
    line = Window.partitionBy("__s").orderBy("__b", "__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(sums.select("__s", "__b", "__p", F.coalesce(F.sum("__sum").over(line), F.lit(0)).alias("__start")), "starts")
    rows = placed(sized, source, key)
    rows = rows.join(_small(starts), rows[source].eqNullSafe(starts["__s"]) & (F.col("__band") == F.col("__b")) & (F.col("__part") == F.col("__p")), "left").drop("__s", "__b", "__p")
    within = Window.partitionBy(source, "__band", "__part").orderBy("__size", F.col(key).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offset = md5_number(F.lit(seed), F.col(source)) % UNIT
    from_ = F.col("__start") + F.coalesce(F.sum("__each").over(within), F.lit(0)) + offset
    copies = F.expr(f"(__from + __each) div {UNIT} - __from div {UNIT}").cast("long")
    return rows.withColumn("__from", from_).withColumn("__copies", copies).select(*docs.columns, "__size", "__source_size", "__target", "__copies")


def emitted(mix: DataFrame, *, copy: str = "copy") -> DataFrame:
    """The mix itself: each document once per whole number crossed, with the column ``copy`` from 0.

    Columns of the documents all stay; one that has the name ``copy`` already keeps it, and the
    number's name gets underscores before it.
    """
    columns = [c for c in mix.columns if c not in ("__size", "__source_size", "__target", "__copies")]
    while copy in columns:
        copy = f"_{copy}"
    return mix.filter("__copies > 0").select(*columns, F.explode(F.sequence(F.lit(0), (F.col("__copies") - 1).cast("int"))).alias(copy))
