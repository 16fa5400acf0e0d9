"""Candles: building, merging, gap filling, and moves between closes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.asof import chunked, without_halo
from tidemark.operators.quantiles import quantiles, with_groups
from tidemark.scratch import written


def candles_from_trades(trades: DataFrame, *, keys: list[str], ts: str = "ts_ms", seq: str = "seq", bar_ms: int = 1000, since_ms: int | None = None) -> DataFrame:
    """Open, high, low, close and volume by bar of trade time; ties in time go by ``seq``."""
    t = trades if since_ms is None else trades.filter(F.col(ts) >= since_ms)
    order = F.struct(ts, seq)
    bar = (F.floor(F.col(ts) / bar_ms) * bar_ms).cast("long").alias("open_time_ms")
    return t.groupBy(*keys, bar).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("qty").alias("volume"))


def upsert(rows: DataFrame, *, keys: list[str], seq: str) -> DataFrame:
    """The last row written for each key."""
    values = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), seq).alias("__r")).select(*keys, "__r.*")


def gap_filled(candles: DataFrame, *, keys: list[str], bar_ms: int = 1000, bars_a_chunk: int = 3600) -> DataFrame:
    """Every bar from a key's first to its last: a missing one repeats the close with no volume.

    The grid is dealt by key and chunk of bars; a chunk gets the last close before it from one
    row per chunk, so no key is filled in one task.
    """
    width = bar_ms * bars_a_chunk
    chunk = F.floor(F.col("open_time_ms") / width).cast("long")
    span = candles.groupBy(*keys).agg(F.min("open_time_ms").alias("lo"), F.max("open_time_ms").alias("hi"))
    per = span.select(*keys, "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))).alias("chunk"))
    begin, end = F.greatest("lo", F.col("chunk") * width), F.least("hi", (F.col("chunk") + 1) * width - bar_ms)
    grid = per.select(*keys, "chunk", F.explode(F.sequence(begin, end, F.lit(bar_ms).cast("long"))).alias("open_time_ms"))
    last = candles.groupBy(*keys, chunk.alias("chunk")).agg(F.max_by("close", "open_time_ms").alias("__c"))
    all_chunks = per.select(*keys, "chunk").join(last, [*keys, "chunk"], "left")
    before = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = all_chunks.withColumn("__carry", F.last("__c", ignorenulls=True).over(before)).drop("__c")
    full = grid.join(candles, [*keys, "open_time_ms"], "left").join(carried, [*keys, "chunk"], "left")
    upto = Window.partitionBy(*keys, "chunk").orderBy("open_time_ms").rowsBetween(Window.unboundedPreceding, 0)
    close = F.coalesce(F.last("close", ignorenulls=True).over(upto), F.col("__carry"))
    filled = full.withColumn("__close", close)
    return filled.select(*keys, "open_time_ms", *[F.coalesce(c, "__close").alias(c) for c in ("open", "high", "low", "close")], F.coalesce("volume", F.lit(0.0)).alias("volume"))


def moves(candles: DataFrame, *, keys: list[str], steps: dict[str, int], bar_ms: int = 1000, chunk_bars: int = 3600) -> DataFrame:
    """Log returns (``r_name``) and differences (``d_name``) of the close over so many bars of a full grid."""
    halo = max(steps.values()) * bar_ms
    out = chunked(candles, keys=keys, ts="open_time_ms", seq="open_time_ms", chunk_ms=chunk_bars * bar_ms, halo_ms=halo)
    w = Window.partitionBy(*keys, "__chunk").orderBy("open_time_ms")
    for name, k in steps.items():
        before = F.lag("close", k).over(w)
        out = out.withColumn(f"r_{name}", F.when((before > 0) & (F.col("close") > 0), F.ln(F.col("close") / before))).withColumn(f"d_{name}", F.col("close") - before)
    return without_halo(out)


def complete_history(candles: DataFrame, *, keys: list[str], bars: int = 3600, bar_ms: int = 1000) -> DataFrame:
    """Whether a key has ``bars`` bars that span as long."""
    span = F.max("open_time_ms") - F.min("open_time_ms")
    return candles.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_bars"), span.alias("span_ms"), ((F.count(F.lit(1)) >= bars) & (span >= (bars - 1) * bar_ms)).alias("complete"))


def ewma(value: Column, age: Column, decay: float) -> Column:
    """Weighted mean of ``value`` with weights decay^age, as an aggregate."""
    w = F.pow(F.lit(float(decay)), age)
    return F.sum(F.when(value.isNotNull(), w * value)) / F.sum(F.when(value.isNotNull(), w))


def aged(rows: DataFrame, *, keys: list[str], ts: str, newest: int, chunk_ms: int = 86_400_000) -> DataFrame:
    """The newest rows of each key, with ``age`` from 0.

    Rows are counted by chunk of time first; only chunks with fewer than ``newest`` rows after
    them are ranked, so a key's task holds little more than it gives.
    """
    dealt = rows.withColumn("__chunk", F.floor(F.col(ts) / chunk_ms).cast("long"))
    sizes = dealt.groupBy(*keys, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    later = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy(F.col("__chunk").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = sizes.withColumn("__later", later).filter(F.col("__later") < newest).select(*keys, "__chunk")
    w = Window.partitionBy(*keys).orderBy(F.col(ts).desc())
    return dealt.join(near, [*keys, "__chunk"], "left_semi").drop("__chunk").withColumn("age", F.row_number().over(w) - 1).filter(F.col("age") < newest)


def hour_stats(moved: DataFrame, *, keys: list[str], move: str) -> DataFrame:
    """Mean absolute deviation from the median, and p99 over the median of absolute moves."""
    m = written(moved.filter(F.col(move).isNotNull()).select(*keys, F.col(move).cast("double").alias("__m")), "moves")
    kinds = m.select(*keys, F.explode(F.array(F.struct(F.lit(False).alias("size"), F.col("__m").alias("v")), F.struct(F.lit(True).alias("size"), F.abs("__m").alias("v")))).alias("__k"))
    both = quantiles(kinds.select(*keys, "__k.*"), by=[*keys, "size"], value="v", levels=[0.5, 0.99])
    of = lambda size, i: F.max(F.when(F.col("size") == size, F.get("q", F.lit(i))))
    mid = written(both.groupBy(*keys).agg(F.max("n").alias("n"), of(False, 0).alias("median"), of(True, 0).alias("typical"), of(True, 1).alias("extreme")), "medians")
    back = with_groups(m, mid.select(*keys, "median"), keys).groupBy(*keys).agg(F.avg(F.abs(F.col("__m") - F.col("median"))).alias("mad"))
    jump = F.when((F.col("typical") > 1e-6) & (F.col("n") >= 50), F.col("extreme") / F.col("typical")).otherwise(1e9)
    return mid.join(back, keys).select(*keys, "n", "median", "mad", jump.alias("jump_ratio"))


def range_hold_share(candles: DataFrame, *, keys: list[str], bars: int, within: float, bar_ms: int = 1000, chunk_bars: int = 3600) -> DataFrame:
    """Share of rolling windows of ``bars`` closes of a full grid that stay within a range."""
    dealt = chunked(candles, keys=keys, ts="open_time_ms", seq="open_time_ms", chunk_ms=chunk_bars * bar_ms, halo_ms=(bars - 1) * bar_ms)
    w = Window.partitionBy(*keys, "__chunk").orderBy("open_time_ms")
    frame = w.rowsBetween(-(bars - 1), 0)
    ranges = dealt.withColumn("range", F.max("close").over(frame) - F.min("close").over(frame)).withColumn("nth", F.count(F.lit(1)).over(frame))
    held = without_halo(ranges).filter(F.col("nth") == bars)
    return held.groupBy(*keys).agg(F.count(F.lit(1)).alias("windows"), F.avg((F.col("range") <= within).cast("double")).alias("held"))


def season(moved: DataFrame, *, move: str, slot: Column) -> DataFrame:
    """Mean absolute move by slot of the week, and its ratio to the weekday mean of the same hour."""
    hour, weekday = F.floor(F.col("slot") / 6) % 24, F.col("slot") < 5 * 144
    per = moved.filter(F.col(move).isNotNull()).groupBy(slot.alias("slot")).agg(F.avg(F.abs(move)).alias("seas_abs"), F.count(F.lit(1)).alias("n"))
    by_hour = per.withColumn("hour", hour)
    usual = by_hour.filter(weekday).groupBy("hour").agg((F.sum(F.col("seas_abs") * F.col("n")) / F.sum("n")).alias("usual"))
    return by_hour.join(F.broadcast(usual), "hour", "left").select("slot", "n", "seas_abs", F.when(F.col("usual") > 0, F.col("seas_abs") / F.col("usual")).alias("seas_rel"))


def hour_autocorrelation(moved: DataFrame, *, keys: list[str], move: str, bar_ms: int = 1000, chunk_bars: int = 3600, hour: Column | None = None) -> DataFrame:
    """``hour, n, lag1``: correlation of each move with the key's one a bar before, by hour of the day (UTC) of the later one.

    Rows are dealt by key and chunk with one bar of halo; a chunk gives moment sums by hour, and these are
    merged, so neither keys nor hours meet in one task. Null without spread on either side.
    """
    rows = moved.filter(F.col(move).isNotNull()).select(*keys, "open_time_ms", F.col(move).alias("__y"))
    dealt = chunked(rows, keys=keys, ts="open_time_ms", seq="open_time_ms", chunk_ms=chunk_bars * bar_ms, halo_ms=bar_ms)
    w = Window.partitionBy(*keys, "__chunk").orderBy("open_time_ms").rangeBetween(-bar_ms, -bar_ms)
    pairs = without_halo(dealt.withColumn("__x", F.first("__y").over(w))).filter("__x is not null")
    hour = F.floor(F.col("open_time_ms") / 3_600_000) % 24 if hour is None else hour
    x, y = F.col("__x"), F.col("__y")
    sums = {"n": F.count(F.lit(1)), "x": F.sum(x), "y": F.sum(y), "xy": F.sum(x * y), "xx": F.sum(x * x), "yy": F.sum(y * y)}
    s = pairs.groupBy(hour.cast("int").alias("hour")).agg(*[c.alias(f"__s{n}") for n, c in sums.items()])
    of = lambda n: F.col(f"__s{n}")
    spread = lambda a: of(a + a) - of(a) * of(a) / of("n")
    both = (of("xy") - of("x") * of("y") / of("n")) / F.sqrt(F.when((spread("x") > 0) & (spread("y") > 0), spread("x") * spread("y")))
    return s.select("hour", of("n").alias("n"), both.alias("lag1"))
