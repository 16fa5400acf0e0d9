"""Prompts: clock slots, trade groups, price moves, event prompts, ingest merges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import quotes as Q
from tidemark.operators.asof import chunked, without_halo
from tidemark.scratch import written


def trade_groups(trades: DataFrame, *, keys: list[str], ts: str = "ts_ms", open_group: bool = False) -> DataFrame:
    """Consecutive trades of one exchange time as a group: last price and last receipt.

    The group still open at a key's end isn't given unless asked for. Groups are the runs of
    equal times in the order of ``seq``; exchange times don't fall, so a time is one group.
    """
    groups = trades.groupBy(*keys, ts).agg(F.max_by("price", "seq").alias("price"), F.max_by("recv_ts_ms", "seq").alias("recv_ts_ms"), F.max("seq").alias("seq"), F.count(F.lit(1)).alias("n"))
    if open_group:
        return groups
    last = groups.groupBy(*keys).agg(F.max(ts).alias("__last"))  # a row per key; the planner decides on a broadcast
    return groups.join(last, keys).filter(F.col(ts) < F.col("__last")).drop("__last")


def fold_moves(prices: np.ndarray, reference: float | None, tick: float) -> tuple[np.ndarray, list[float], float | None]:
    """Places of the moves, the reference before each, and the one after all."""
    moves, before, most = [], [], 1 + 1e-6
    for i, price in enumerate(prices.tolist()):
        if reference is None:
            reference = price
        elif abs(price - reference) / tick > most:
            moves.append(i)
            before.append(reference)
            reference = price
    return np.array(moves, np.int64), before, reference


def fold_ends(prices: np.ndarray, tick: float) -> tuple[list[float], list[float], float]:
    """How the fold of a chunk ends for every reference it may start from.

    From a start r the first move is at the first price beyond a tick of r, and that is always a new
    highest or lowest price so far. So the highs and lows, until they are so far apart that any start
    has moved, decide with the reference that the fold ends with from there: the first of these
    prices that is a move from r names the end, and without one r stays. Also the end without a start.
    """
    values, most = prices.tolist(), 1 + 1e-6
    records, low, high = [], np.inf, -np.inf
    for i, p in enumerate(values):
        if p < low or p > high:
            records.append(i)
            low, high = min(low, p), max(high, p)
            if (high - low) / tick > 2.5:
                break
    ends: dict[int, float] = {}

    def end(i: int) -> float:
        """The reference after all if the price at ``i`` became it; folds that meet share their end."""
        path, reference = [i], values[i]
        for j in range(i + 1, len(values)):
            if abs(values[j] - reference) / tick > most:
                if j in ends:
                    reference = ends[j]
                    break
                path.append(j)
                reference = values[j]
        ends.update(dict.fromkeys(path, reference))
        return reference

    reached = [ends[i] if i in ends else end(i) for i in reversed(records)][::-1]
    return [values[i] for i in records], reached, reached[0]


def price_moves(groups: DataFrame, *, keys: list[str], tick: float, ts: str = "ts_ms", chunk_ms: int = 86_400_000) -> DataFrame:
    """Groups more than one tick from the reference, which they then become; a key's first group is its first reference.

    The fold depends on its path and a handful of keys hold all groups, so it runs per key and
    chunk of time, a day by default. First each chunk tells how it ends for any start (``fold_ends``, a few
    prices); these are put together in the order of time, a short row a chunk; then each chunk is
    folded once from its true start. The result doesn't depend on ``chunk_ms``. Null keys are
    left out; an empty table gives no rows.
    """
    dealt = written(groups.dropna(subset=keys).withColumn("__chunk", F.floor(F.col(ts) / chunk_ms).cast("long")), "groups")
    names = ", ".join(f"{k} {dealt.schema[k].dataType.simpleString()}" for k in keys)

    def ended(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([ts, "seq"], kind="stable")
        prices, ends, first = fold_ends(pdf["price"].to_numpy(), tick)
        return pdf[[*keys, "__chunk"]].head(1).assign(prices=[prices], ends=[ends], first=first)

    def chained(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, starts, reference = pdf.sort_values("__chunk"), [], None
        for prices, ends, first in zip(pdf["prices"], pdf["ends"], pdf["first"], strict=True):
            starts.append(reference)
            if reference is None:
                reference = first
            else:
                reference = next((e for p, e in zip(prices, ends, strict=True) if abs(p - reference) / tick > 1 + 1e-6), reference)
        return pdf[[*keys, "__chunk"]].assign(__start=np.array(starts, float))

    ends = dealt.select(*keys, "__chunk", ts, "seq", "price").groupBy(*keys, "__chunk").applyInPandas(ended, f"{names}, __chunk long, prices array<double>, ends array<double>, first double")
    starts = written(ends.groupBy(*keys).applyInPandas(chained, f"{names}, __chunk long, __start double"), "starts")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([ts, "seq"], kind="stable")
        start = pdf["__start"].iloc[0]
        moves, before, _ = fold_moves(pdf["price"].to_numpy(), None if pd.isna(start) else start, tick)
        return pdf.iloc[moves].assign(reference=np.array(before, float)).drop(columns=["__start", "__chunk"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema) + ", reference double"
    return dealt.join(starts, [*keys, "__chunk"]).groupBy(*keys, "__chunk").applyInPandas(fold, schema)


def event_prompts(moves: DataFrame, *, clock: int, opens: int, length: int, chance: float = 0.5, longest_delay: int = 500) -> DataFrame:
    """At most one prompt per asset and slot: the first accepted move in the slot's event window."""
    slot = Q.event_slot("recv_ts_ms", clock=clock, opens=opens, length=length)
    key = [F.col("asset"), F.col("venue"), F.col("recv_ts_ms")]
    taken = moves.withColumn("slot", slot).filter(F.col("slot").isNotNull() & Q.event_coin(*key, chance=chance))
    first = Window.partitionBy("asset", "slot").orderBy("recv_ts_ms", "venue", "seq")
    one = taken.withColumn("nth", F.row_number().over(first)).filter("nth = 1")
    return one.select("asset", (F.col("recv_ts_ms") + Q.event_delay_ms(*key, longest=longest_delay)).alias("current_time_ms"), F.lit("event").alias("kind"), "venue", "slot")


def union_prompts(clock: DataFrame, events: DataFrame) -> DataFrame:
    """Time and event prompts, one per asset and instant; a clock prompt goes first."""
    both = clock.select("asset", "current_time_ms", F.lit("time").alias("kind"), F.lit(None).cast("string").alias("venue")).unionByName(events.select("asset", "current_time_ms", "kind", "venue"))
    return both.groupBy("asset", "current_time_ms").agg(F.max("kind").alias("kind"), F.max("venue").alias("venue")).withColumn("venue", F.when(F.col("kind") == "event", F.col("venue")))


def missing(wanted: DataFrame, stored: DataFrame, *, keys: list[str]) -> DataFrame:
    return wanted.join(stored, keys, "left_anti")


def ingest_merge(stored: DataFrame, batch: DataFrame, *, keys: list[str], ts: str, ids: list[str] | None = None, fill_gaps: bool = False) -> DataFrame:
    """Stored rows and the batch's new ones: outside the stored span, or anywhere with ``fill_gaps``.

    A stored row wins over the batch's; of equal keys in the batch one row is taken. ``ids`` tell rows of one
    instant apart; without them an instant holds one row.
    """
    same = [*keys, ts, *(ids or [])]
    new = batch.dropDuplicates(same).join(stored, same, "left_anti")
    if not fill_gaps:
        span = stored.groupBy(*keys).agg(F.min(ts).alias("__lo"), F.max(ts).alias("__hi"))
        new = new.join(span, keys, "left").filter(F.col("__lo").isNull() | (F.col(ts) < F.col("__lo")) | (F.col(ts) > F.col("__hi"))).select(*batch.columns)
    return stored.unionByName(new)


def coverage_windows(stored: DataFrame, *, keys: list[str], ts: str, start: int, end: int, step: int, interior: bool = False, wanted: DataFrame | None = None, chunk_ms: int = 86_400_000) -> DataFrame:
    """Half-open missing ranges of [start, end) before the first and after the last stored row.

    ``wanted`` lists the keys that should be there: one without a stored row in the range lacks all
    of it. ``interior`` adds the gaps between stored rows.
    """
    inside = stored.filter((F.col(ts) >= start) & (F.col(ts) < end))
    span = inside.groupBy(*keys).agg(F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    if wanted is not None:
        span = wanted.select(*keys).distinct().join(span, keys, "left")
    before = F.struct(F.lit(start).cast("long").alias("from_ms"), F.coalesce("lo", F.lit(end)).cast("long").alias("to_ms"))
    after = F.struct(F.coalesce(F.col("hi") + step, F.lit(end)).cast("long").alias("from_ms"), F.lit(end).cast("long").alias("to_ms"))
    out = span.select(*keys, F.inline(F.array(before, after))).filter("from_ms < to_ms")
    if interior:
        last = F.lag(ts).over(Window.partitionBy(*keys, "__chunk").orderBy(ts))
        dealt = chunked(inside.select(*keys, ts), keys=keys, ts=ts, seq=ts, chunk_ms=chunk_ms, carry=True).withColumn("__last", last)
        out = out.unionByName(without_halo(dealt).select(*keys, (F.col("__last") + step).alias("from_ms"), F.col(ts).alias("to_ms")).filter("from_ms < to_ms"))
    return out


def sequence_gaps(updates: DataFrame, *, keys: list[str], order: str, first: str, before: str, chunk: int = 100_000) -> DataFrame:
    """Updates whose ``before`` id isn't the ``first`` id of the row before; dealt by key and chunk of ``order``."""
    dealt = chunked(updates, keys=keys, ts=order, seq=order, chunk_ms=chunk, carry=True)
    prev = F.lag(first).over(Window.partitionBy(*keys, "__chunk").orderBy(order))
    return without_halo(dealt.withColumn("expected", prev)).filter(F.col("expected").isNotNull() & (F.col(before) != F.col("expected")))


def time_order_violations(rows: DataFrame, *, keys: list[str], order: str, ts: str, chunk: int = 100_000) -> DataFrame:
    """Rows earlier than the row before them in the order of arrival; dealt by key and chunk of ``order``."""
    dealt = chunked(rows, keys=keys, ts=order, seq=order, chunk_ms=chunk, carry=True)
    prev = F.lag(ts).over(Window.partitionBy(*keys, "__chunk").orderBy(order))
    return without_halo(dealt.withColumn("before_ms", prev)).filter(F.col(ts) < F.col("before_ms"))


def numbered(rows: DataFrame, *, by: list[str], ts: str, name: str, chunk_ms: int = 86_400_000) -> DataFrame:
    """``rows`` with their number from 1 in the order of time within ``by``: rows are numbered per chunk
    of time, and a chunk adds how many rows lie before it."""
    dealt = rows.withColumn("__chunk", F.floor(F.col(ts) / chunk_ms).cast("long"))
    sizes = dealt.groupBy(*by, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    line = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(line), F.lit(0))).drop("__n")
    nth = F.row_number().over(Window.partitionBy(*by, "__chunk").orderBy(ts))
    return dealt.join(offsets, [*by, "__chunk"]).withColumn(name, (nth + F.col("__before")).cast("int")).drop("__chunk", "__before")


def clock_interval_ms(seconds: float, *, live_ms: int = 20_000) -> int:
    """A clock's period in milliseconds; it must be a positive multiple of the live clock's."""
    ms = round(seconds * 1000)
    if ms <= 0 or ms % live_ms:
        raise ValueError(f"the interval must be a multiple of {live_ms / 1000:g} s: {seconds}")
    return ms
