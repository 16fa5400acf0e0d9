"""Streaming jobs over tick streams with an event-time column ``at``."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions import quotes as Q
from tidemark.operators import flow
from tidemark.operators.prompts import fold_moves


def timed(ticks: DataFrame, *, delay: str) -> DataFrame:
    return ticks.withColumn("at", F.timestamp_millis("recv_ts_ms")).withWatermark("at", delay)


def stream_candles(ticks: DataFrame, *, keys: list[str], bar: str, delay: str) -> DataFrame:
    """Candles by tumbling window of event time; ties go by ``seq``."""
    order = F.struct("recv_ts_ms", "seq")
    c = timed(ticks, delay=delay).groupBy(*keys, F.window("at", bar)).agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("qty").alias("volume"))
    return c.select(*keys, F.unix_millis("window.start").alias("open_time_ms"), "open", "high", "low", "close", "volume")


def sliding_flow(ticks: DataFrame, *, keys: list[str], window: str, step: str, delay: str) -> DataFrame:
    """Signed flow and volume of sliding windows."""
    signed = F.when(F.col("buyer_is_maker"), -F.col("qty")).otherwise(F.col("qty"))
    f = timed(ticks, delay=delay).groupBy(*keys, F.window("at", window, step)).agg(F.sum(signed).alias("flow"), F.sum("qty").alias("volume"), F.count(F.lit(1)).alias("n"))
    return f.select(*keys, F.unix_millis("window.start").alias("from_ms"), F.unix_millis("window.end").alias("to_ms"), "flow", "volume", "n")


def activity_sessions(ticks: DataFrame, *, keys: list[str], gap: str, delay: str) -> DataFrame:
    """Bursts: ticks of a key that follow each other within the gap."""
    s = timed(ticks, delay=delay).groupBy(*keys, F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("n"), F.sum("qty").alias("qty"))
    return s.select(*keys, F.unix_millis("session_window.start").alias("from_ms"), F.unix_millis("session_window.end").alias("to_ms"), "n", "qty")


def depth_samples(snapshots: DataFrame, *, keys: list[str], every: str, delay: str) -> DataFrame:
    """The last snapshot of each interval, with its levels."""
    whole = F.struct("update_id", "bids", "asks")
    s = timed(snapshots, delay=delay).groupBy(*keys, F.window("at", every)).agg(F.max_by(whole, F.struct("recv_ts_ms", "seq")).alias("s"))
    return s.select(*keys, F.unix_millis("window.start").alias("from_ms"), "s.*")


def band_samples(samples: DataFrame, *, keys: list[str], every_ms: int, nth: int, width: float, bands: int = 100) -> DataFrame:
    """Sizes by side and band of every ``nth`` sample on the clock, a row a band; a row's own work, so it streams."""
    due = samples.filter(F.col("from_ms") % (every_ms * nth) == 0)
    return flow.depth_bands(due, id_cols=[*keys, "from_ms"], width=width, bands=bands)


def stream_moves(ticks: DataFrame, *, keys: list[str], tick: float, delay: str) -> DataFrame:
    """Trades more than one tick from the last such, a reference kept as state per key.

    Rows of a micro-batch are taken in the order of receipt and ``seq``; the state is one price.
    """
    columns = [*keys, "recv_ts_ms", "seq", "price"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ticks.select(*columns).schema)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["recv_ts_ms", "seq"])
        reference = state.get[0] if state.exists else None
        kept = []
        for price in rows["price"].to_numpy():
            move = reference is not None and abs(price - reference) / tick > 1 + 1e-6
            kept.append(move)
            if move or reference is None:
                reference = float(price)
        state.update((reference,))
        yield rows.loc[kept, columns]

    return timed(ticks.select(*columns), delay=delay).drop("at").groupBy(*keys).applyInPandasWithState(step, schema, "reference double", "append", GroupStateTimeout.NoTimeout)


def stream_group_moves(trades: DataFrame, *, keys: list[str], tick: float, delay: str) -> DataFrame:
    """Moves over groups of one exchange time, with the reference before each: ``operators.prompts`` as a stream.

    A group is closed by the first trade of a later exchange time. The state of a key is its open group and
    its reference; a micro-batch's closed groups are cut by array and folded once.
    """
    columns = [*keys, "ts_ms", "recv_ts_ms", "seq", "price"]
    kinds = {f.name: f.dataType.simpleString() for f in trades.select(*columns).schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", ts_ms long, recv_ts_ms long, price double, reference double"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts_ms", "seq"])
        ts, recv, price = (rows[c].to_numpy() for c in ("ts_ms", "recv_ts_ms", "price"))
        reference = None
        if state.exists:
            open_ts, open_recv, open_price, reference = state.get
            ts, recv, price = np.append(open_ts, ts), np.append(open_recv, recv), np.append(open_price, price)
        last = np.flatnonzero(ts[1:] != ts[:-1])  # each closed group's last trade
        moves, before, reference = fold_moves(price[last], reference, tick)
        state.update((int(ts[-1]), int(recv[-1]), float(price[-1]), reference))
        at = last[moves]
        yield pd.DataFrame({**dict(zip(keys, key, strict=True)), "ts_ms": ts[at], "recv_ts_ms": recv[at], "price": price[at], "reference": np.array(before, float)})

    rows = timed(trades.select(*columns), delay=delay).drop("at")
    held = "ts_ms long, recv_ts_ms long, price double, reference double"
    return rows.groupBy(*keys).applyInPandasWithState(step, schema, held, "append", GroupStateTimeout.NoTimeout)


def stream_event_prompts(moves: DataFrame, *, clock: int, opens: int, length: int, chance: float = 0.5, longest_delay: int = 500, delay: str) -> DataFrame:
    """At most one prompt per asset and slot: the first accepted move in its event window.

    A window of event time holds one row of state per asset and slot, which ends with the
    watermark. In update mode an earlier move that comes late replaces the prompt.
    """
    slot = Q.event_slot("recv_ts_ms", clock=clock, opens=opens, length=length)
    key = [F.col("asset"), F.col("venue"), F.col("recv_ts_ms")]
    taken = timed(moves.withColumn("slot", slot).filter(F.col("slot").isNotNull() & Q.event_coin(*key, chance=chance)), delay=delay)
    due = (F.col("recv_ts_ms") + Q.event_delay_ms(*key, longest=longest_delay)).alias("current_time_ms")
    first = taken.groupBy("asset", F.window("at", f"{clock} milliseconds"), "slot").agg(F.min_by(F.struct(due, "venue"), F.struct("recv_ts_ms", "venue", "seq")).alias("m"))
    return first.select("asset", "slot", "m.current_time_ms", "m.venue")


def stream_trailing_window(ticks: DataFrame, *, keys: list[str], window_ms: int, delay: str) -> DataFrame:
    """Each tick with the count and quantity of its key's trailing window (now - window, now], itself and all of its instant included.

    The state of a key is its window's times and quantities, no more; rows of a micro-batch are
    taken in the order of receipt and ``seq``. Ticks of one instant must come in one micro-batch to see each other.
    """
    columns = [*keys, "recv_ts_ms", "seq", "qty"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ticks.select(*columns).schema)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["recv_ts_ms", "seq"])
        times, sizes = (list(x) for x in state.get) if state.exists else ([], [])
        held = len(times)
        times += rows["recv_ts_ms"].tolist()
        sizes += rows["qty"].tolist()
        t, total = np.array(times), np.concatenate([[0.0], np.cumsum(sizes)])
        low = np.searchsorted(t, t - window_ms, side="right")
        high = np.searchsorted(t, t, side="right")
        out = rows[columns].assign(n=(high - low)[held:], trailing=(total[high] - total[low])[held:])
        keep = t > t[-1] - window_ms
        state.update((t[keep].tolist(), np.array(sizes)[keep].tolist()))
        yield out

    return timed(ticks.select(*columns), delay=delay).drop("at").groupBy(*keys).applyInPandasWithState(step, schema + ", n long, trailing double", "times array<long>, sizes array<double>", "append", GroupStateTimeout.NoTimeout)


def stream_labels(prompts: DataFrame, quotes: DataFrame, *, horizon_ms: int, delay: str) -> DataFrame:
    """One row a prompt: its last quote in (now, now + horizon], nulls if there is none.

    An outer interval join gives each prompt its quotes, or itself alone once both watermarks have
    passed; a second stateful operator behind it keeps the last one, and gives it when the join's
    output watermark has passed the prompt. A repeated prompt gives one row. Both sides are dealt by asset and stretch of
    one horizon, a prompt to the two that its horizon touches, so a prompt looks at few quotes more than its own.
    """
    p = prompts.withColumn("p_at", F.timestamp_millis("current_time_ms")).withWatermark("p_at", delay).alias("p")
    q = quotes.withColumnRenamed("asset", "q_asset").withColumn("q_at", F.timestamp_millis("recv_ts_ms")).withWatermark("q_at", delay).alias("q")
    hour = lambda c: F.floor(F.unix_millis(c) / horizon_ms)
    p = p.withColumn("p_part", F.explode(F.array_distinct(F.array(hour(F.col("p_at")), hour(F.col("p_at")) + 1)))).alias("p")
    q = q.withColumn("q_part", hour(F.col("q_at"))).alias("q")
    near = (F.col("asset") == F.col("q_asset")) & (F.col("p_part") == F.col("q_part")) & (F.col("q_at") > F.col("p_at")) & (F.col("q_at") <= F.col("p_at") + F.expr(f"interval {horizon_ms} milliseconds"))
    values = [c for c in quotes.columns if c != "asset"]
    last = F.max_by(F.struct(*values), F.struct("recv_ts_ms", "seq")).alias("l")
    return p.join(q, near, "leftOuter").groupBy("asset", "current_time_ms", "p_at").agg(last).select("asset", "current_time_ms", "l.*")


class Retention(StatefulProcessor):
    """What each stream's lifetime holds at a prompt; rows are kept in quarters of their lifetime and go by these.

    A prompt waits for the watermark by a timer. Rows that no prompt to come can reach go: those a
    lifetime before the watermark, or before the earliest prompt that still waits. A quarter's times and
    sizes are two values of packed numbers, so state is read and written by the quarter, not by the row; quarters that
    a key's last prompt has read are kept for the next one.
    """

    def __init__(self, lifetimes: dict[str, int], keys: list[str]):
        self.lifetimes, self.keys = lifetimes, keys

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.buckets = handle.getMapState("buckets", "stream string, bucket long", "times binary, sizes binary")
        self.waiting = handle.getMapState("waiting", "at long", "n long")
        self.read: tuple[tuple | None, dict] = (None, {})  # a key, and the quarters its last prompt saw

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        asked: Counter[int] = Counter()
        came: dict[tuple[str, int], list[np.ndarray]] = {}  # by stream and quarter: times and sizes in turn
        newest = None
        for given in rows:
            for stream, own in given.dropna(subset=["recv_ts_ms"]).groupby("stream"):
                at = own["recv_ts_ms"].to_numpy(np.int64)
                if stream == PROMPT:
                    asked.update(at.tolist())
                elif stream in self.lifetimes:
                    quarter = at // self._width(stream)
                    order = np.argsort(quarter, kind="stable")
                    cuts = np.flatnonzero(np.diff(quarter[order])) + 1
                    for mine in np.split(order, cuts):
                        came.setdefault((stream, int(quarter[mine[0]])), []).extend((at[mine], own["size"].to_numpy(np.float64)[mine]))
                    newest = max(int(at.max()), newest if newest is not None else int(at.max()))
        for at, n in asked.items():
            self.waiting.updateValue((at,), (n,))
            self.handle.registerTimer(at)
        held, self.read = set(self.buckets.keys()), (None, {})
        for place, parts in came.items():
            times, sizes = self.buckets.getValue(place) if place in held else (b"", b"")
            self.buckets.updateValue(place, (b"".join([times, *(x.tobytes() for x in parts[::2])]), b"".join([sizes, *(x.tobytes() for x in parts[1::2])])))
        if newest is not None:  # a key that falls silent is swept when its rows have outlived all prompts
            self.handle.registerTimer(newest + 2 * max(self.lifetimes.values()))
        self._forget(timerValues.getCurrentWatermarkInMs())
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        if not self.waiting.containsKey((at,)):
            self._forget(timerValues.getCurrentWatermarkInMs())
            return
        row = dict(zip(self.keys, key, strict=True)) | {"current_time_ms": at}
        before, now = self.read[1] if self.read[0] == key else {}, {}
        for stream, life in self.lifetimes.items():
            n, size, width = 0, 0.0, self._width(stream)
            for bucket in range((at - life) // width, at // width + 1):
                place = (stream, bucket)
                found = now[place] = before[place] if place in before else self.buckets.getValue(place)
                if found is not None:
                    times, sizes = np.frombuffer(found[0], np.int64), np.frombuffer(found[1], np.float64)
                    inside = (times > at - life) & (times <= at)
                    n, size = n + int(inside.sum()), size + float(sizes[inside].sum())
            row |= {f"n_{stream}": n, f"size_{stream}": size}
        self.read = (key, now)
        self.waiting.removeKey((at,))
        yield pd.DataFrame([row])

    def _forget(self, watermark: int) -> None:
        self.read = (None, {})
        since = min([watermark, *(at for (at,) in self.waiting.keys())])
        for stream, bucket in list(self.buckets.keys()):
            if (bucket + 1) * self._width(stream) <= since - self.lifetimes[stream]:
                self.buckets.removeKey((stream, bucket))

    def _width(self, stream: str) -> int:
        return max(self.lifetimes[stream] // 4, 1)


#: The name of prompts among the streams.
PROMPT = "prompt"


def retained(rows: DataFrame, *, keys: list[str], lifetimes: dict[str, int], delay: str) -> DataFrame:
    """Per prompt the number and summed size of each stream's rows in (now - lifetime, now], once the watermark has passed it.

    ``rows`` is a union of streams: ``keys``, ``stream`` (``prompt`` or a name of ``lifetimes``), ``recv_ts_ms``, ``size``. State
    holds the lifetimes' rows and no more; prompts that come behind the watermark are dropped.
    Needs the RocksDB state store.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", current_time_ms long, " + ", ".join(f"n_{s} long, size_{s} double" for s in lifetimes)
    grouped = timed(rows.select(*keys, "stream", "recv_ts_ms", "size"), delay=delay).groupBy(*keys)
    return grouped.transformWithStateInPandas(statefulProcessor=Retention(lifetimes, keys), outputStructType=schema, outputMode="append", timeMode="eventTime")


def batch_folders(path: str):
    """A ``foreachBatch`` that writes each batch to a folder of its own, so a batch that runs again replaces itself.

    Reading ``path`` gives the rows with their ``batch``; of an update stream's rows of one key the
    latest batch's holds.
    """

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def once(rows: DataFrame, *, keys: list[str], delay: str) -> DataFrame:
    """Rows whose key came within ``delay`` before are left out; the state of a key ends with the watermark.

    With ``batch_folders`` behind it a prompt is written once: keys are told apart by state, not by reading
    the sink, and a batch that failed half-way overwrites its own folder when it runs again.
    """
    return timed(rows, delay=delay).dropDuplicatesWithinWatermark(keys).drop("at")
