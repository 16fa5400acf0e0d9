"""Exact order statistics of groups of any size, by distributed selection.

A group's values are counted in bins between its least and largest; only the bins that hold a wanted rank
are looked into, and split again until they are small enough to be sorted in one task. All ranks
of all groups are sought at once, so no group's values ever meet, and nothing is estimated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.scratch import written

#: Values that are sorted in one task at most (more only if they are all equal), and bins of a split.
SORTED, BINS = 50_000, 2048
#: Rows of bins that are broadcast at most; beyond, the join shuffles.
BROADCAST_ROWS = 200_000
KEY, SPAN, VALUE = "__key", "__span", "__v"


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _scaled(v: Column, logs: bool) -> Column:
    """``v`` halved (so that differences don't overflow), or its logarithm to either side of 0: both keep the order."""
    return F.signum(v) * (1100 + F.coalesce(F.log2(F.when(v != 0, F.abs(v))), F.lit(0.0))) if logs else v * 0.5


def _split(values: DataFrame, spans: DataFrame, logs: bool) -> tuple[DataFrame, DataFrame]:
    """The values that lie in bins with a wanted rank, and those bins; ``spans`` are the ones to split.

    The first split is by logarithm, so that a bin's values are of like size, and later ones linear: a
    few rounds part any two numbers, however far the tails reach.
    """
    bounds = _small(spans.select(KEY, SPAN, "lo", "hi"))
    v, lo, hi = (_scaled(F.col(c), logs) for c in (VALUE, "lo", "hi"))
    bin_ = F.least(F.floor(F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(0.0) * BINS), F.lit(BINS - 1)).cast("long").alias("__bin")
    dealt = values.join(bounds, [KEY, SPAN]).select(KEY, SPAN, bin_, VALUE)
    parents = spans.select(KEY, SPAN, F.col("before").alias("__before"), "ranks")
    bins = dealt.groupBy(KEY, SPAN, "__bin").agg(F.count(F.lit(1)).alias("n"), F.min(VALUE).alias("lo"), F.max(VALUE).alias("hi")).join(parents, [KEY, SPAN])
    earlier = Window.partitionBy(KEY, SPAN).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS rows
    bins = bins.withColumn("before", F.col("__before") + F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    bins = bins.withColumn("ranks", F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))).filter("size(ranks) > 0")
    number = F.row_number().over(Window.partitionBy(KEY).orderBy(SPAN, "__bin")).cast("long")  # at most a row a wanted rank
    found = written(bins.withColumn("__new", number).select(KEY, SPAN, "__bin", "__new", "n", "lo", "hi", "before", "ranks"), "bins")
    narrowed = dealt.join(_small(found.select(KEY, SPAN, "__bin", "__new")), [KEY, SPAN, "__bin"]).select(KEY, F.col("__new").alias(SPAN), VALUE)
    return written(narrowed, "narrowed"), found.select(KEY, F.col("__new").alias(SPAN), "n", "lo", "hi", "before", "ranks")


def _picked(values: DataFrame, spans: DataFrame) -> DataFrame:
    """``key, rank, value`` of the ranks within spans that are small or hold one value."""
    one = spans.filter("lo = hi").select(KEY, F.explode("ranks").alias("rank"), F.col("lo").alias(VALUE))
    many = _small(spans.filter("lo < hi").select(KEY, SPAN, "before", "ranks"))
    sorted_ = F.sort_array(F.collect_list(VALUE)).alias("values")
    lists = values.join(many, [KEY, SPAN]).groupBy(KEY, SPAN).agg(sorted_, F.any_value("before").alias("before"), F.any_value("ranks").alias("ranks"))
    return one.unionByName(lists.select(KEY, "before", "values", F.explode("ranks").alias("rank")).select(KEY, "rank", F.get("values", (F.col("rank") - F.col("before")).cast("int")).alias(VALUE)))


def order_statistics(rows: DataFrame, *, by: list[str], value: str | Column, ranks: Callable[[Column], Column]) -> DataFrame:
    """``by, n, picked``: of each group the number of values and a map from rank (from 0) to value.

    ``ranks`` gives the wanted ranks as an array of longs, from the group's number of values. Null,
    infinite and no-number values don't count; a group without others has no row. Null keys are
    groups like others.
    """
    key = F.struct(*[F.col(c) for c in by]) if by else F.struct(F.lit(0).alias("all"))
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    values = written(rows.select(key.alias(KEY), F.lit(0).cast("long").alias(SPAN), v.alias(VALUE)).filter(F.abs(VALUE) < float("inf")), "values")
    wanted = F.array_distinct(ranks(F.col("n"))).alias("ranks")
    spans = values.groupBy(KEY, SPAN).agg(F.count(F.lit(1)).alias("n"), F.min(VALUE).alias("lo"), F.max(VALUE).alias("hi"))
    spans = groups = written(spans.select("*", F.lit(0).cast("long").alias("before"), wanted), "groups")
    first, large, out = values, f"n > {SORTED} and lo < hi", None
    while True:
        part = _picked(values, spans.filter(f"not ({large})"))
        out = part if out is None else out.unionByName(part)
        spans = spans.filter(large)
        if spans.isEmpty():
            break
        values, spans = _split(values, spans, logs=values is first)
    maps = out.groupBy(KEY).agg(F.map_from_entries(F.collect_list(F.struct("rank", VALUE))).alias("picked"))
    return groups.select(KEY, "n").join(maps, KEY).select(*[F.col(KEY)[c].alias(c) for c in by], "n", "picked")


def quantiles(rows: DataFrame, *, by: list[str], value: str | Column, levels: list[float], name: str = "q") -> DataFrame:
    """``by, n`` and an array of the groups' quantiles at ``levels``, linear between neighbours."""
    at = lambda n: F.transform(F.array(*[F.lit(float(x)) for x in levels]), lambda x: x * (n - 1))
    both = lambda n: F.concat(F.transform(at(n), lambda p: F.floor(p).cast("long")), F.transform(at(n), lambda p: F.ceil(p).cast("long")))
    found = order_statistics(rows, by=by, value=value, ranks=both)
    low, high = (lambda p: F.col("picked")[F.floor(p).cast("long")]), (lambda p: F.col("picked")[F.ceil(p).cast("long")])
    q = F.transform(at(F.col("n")), lambda p: low(p) + (p - F.floor(p)) * (high(p) - low(p)))
    return found.select(*by, "n", q.alias(name))


def exclusive_percentile(rows: DataFrame, *, by: list[str], value: str, p: float, least: int = 20) -> DataFrame:
    """Percentile at position p * (n + 1) from 1, between neighbours; the largest value if n is under ``least``."""
    lo = lambda n: F.least(F.greatest(F.floor(F.lit(p) * (n + 1)), F.lit(1)), F.greatest(n - 1, F.lit(1)))
    ranks = lambda n: F.array(lo(n) - 1, F.least(lo(n), n - 1), n - 1)
    found = order_statistics(rows, by=by, value=value, ranks=ranks)
    n, of = F.col("n"), lambda i: F.col("picked")[i.cast("long")]
    between = of(lo(n) - 1) + (F.lit(p) * (n + 1) - lo(n)) * (of(F.least(lo(n), n - 1)) - of(lo(n) - 1))
    return found.select(*by, "n", F.when(n < least, of(n - 1)).otherwise(between).alias("percentile"))


def with_groups(rows: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` beside their group's columns; the few rows of groups are broadcast if they are few."""
    return rows.join(_small(groups), by)


def robust_center_scale(rows: DataFrame, *, by: list[str], value: str) -> DataFrame:
    """``by, centre, scale``: the median of each group and the mean distance from it."""
    kept = written(rows.select(*by, F.col(value).cast("double").alias("__x")), "signals")
    centre = written(quantiles(kept, by=by, value="__x", levels=[0.5]).select(*by, F.get("q", F.lit(0)).alias("centre")), "centres")
    return with_groups(kept, centre, by).groupBy(*by, "centre").agg(F.avg(F.abs(F.col("__x") - F.col("centre"))).alias("scale"))
