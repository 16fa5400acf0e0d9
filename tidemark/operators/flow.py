"""Order flow, quote and depth measures over trailing windows and snapshots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidemark.functions import quotes as Q
from tidemark.operators import windows
from tidemark.operators.asof import chunked, without_halo
from tidemark.operators.windows import window_stats


def signed_qty() -> Column:
    """Quantity, negative where the taker sold."""
    return F.when(F.col("buyer_is_maker"), -F.col("qty")).otherwise(F.col("qty"))


def _sized(trades: DataFrame, keys: list[str], *more: str) -> DataFrame:
    return trades.select(*keys, "seq", "recv_ts_ms", signed_qty().alias("signed"), "qty", *more)


def _of(prompts: DataFrame, rows: DataFrame, keys: list[str], at: str, reach_ms: int, made: tuple, chunk_ms: int | None) -> DataFrame:
    measure, gives = made
    return window_stats(prompts, rows, keys=keys, at=at, ts="recv_ts_ms", seq="seq", reach_ms=reach_ms, measure=measure, gives=gives, chunk_ms=chunk_ms)


def trade_flow(prompts: DataFrame, trades: DataFrame, *, keys: list[str], at: str, reach_ms: int, last_n: int = 50, window_ms: int = 2000, chunk_ms: int | None = None) -> DataFrame:
    """Per prompt with a trade in reach, signed taker imbalance of all its window, of its last prints, and of the last
    milliseconds that end at the last trade (both ends included), with their quantity."""
    return _of(prompts, _sized(trades, keys), keys, at, reach_ms, windows.trade_flow(reach_ms, last_n, window_ms), chunk_ms)


def tick_counts(prompts: DataFrame, trades: DataFrame, *, keys: list[str], at: str, spans: dict[str, int], chunk_ms: int | None = None) -> DataFrame:
    """Count, volume, signed flow, price range and VWAP of the trailing windows by name, for prompts with a trade in the longest."""
    return _of(prompts, _sized(trades, keys, "price"), keys, at, max(spans.values()), windows.tick_counts(spans), chunk_ms)


def side_flow(prompts: DataFrame, trades: DataFrame, *, keys: list[str], at: str, reach_ms: int, window_ms: int, chunk_ms: int | None = None) -> DataFrame:
    """What takers bought and sold in (at - window, at], for prompts with a trade in reach."""
    return _of(prompts, _sized(trades, keys), keys, at, max(reach_ms, window_ms), windows.side_flow(reach_ms, window_ms), chunk_ms)


def liquidation_signals(
    prompts: DataFrame, liquidations: DataFrame, *, keys: list[str], at: str, reach_ms: int = 3_600_000, recent_ms: int = 10_000,
    unit: float = 0.25, long_unit: float = 1.0, chunk_ms: int | None = None,
) -> DataFrame:
    """Direction of recent liquidations and activity over the reach, both ends included, by tanh; those without a size are left out."""
    signed = F.when(F.col("is_buy"), F.col("qty")).otherwise(-F.col("qty")).alias("signed")
    sized = liquidations.filter("qty > 0").select(*keys, "seq", "recv_ts_ms", signed, "qty")
    return _of(prompts, sized, keys, at, reach_ms, windows.liquidation_signals(reach_ms, recent_ms, unit, long_unit), chunk_ms)


def liquidation_sums(prompts: DataFrame, liquidations: DataFrame, *, keys: list[str], at: str, spans: dict[str, int], chunk_ms: int | None = None) -> DataFrame:
    """Signed quantity and count of liquidations in the trailing windows by name, for prompts with one in the longest."""
    signed = F.when(F.col("is_buy"), F.col("qty")).otherwise(-F.col("qty")).alias("signed")
    return _of(prompts, liquidations.select(*keys, "seq", "recv_ts_ms", signed), keys, at, max(spans.values()), windows.liquidation_sums(spans), chunk_ms)


def book_volatility(prompts: DataFrame, quotes: DataFrame, *, keys: list[str], at: str, reach_ms: int, window_ms: int, least: int = 6, most: int | None = None, chunk_ms: int | None = None) -> DataFrame:
    """Realised volatility and log range of microprices within the window that ends at the last tick, of ``most`` evenly spaced ticks if it holds more."""
    rows = quotes.select(*keys, "seq", "recv_ts_ms", Q.microprice(or_mid=True).alias("micro"))
    return _of(prompts, rows, keys, at, reach_ms, windows.book_volatility(reach_ms, window_ms, least, most), chunk_ms)


def horizon_pairs(
    prompts: DataFrame, quotes: DataFrame, *, keys: list[str], at: str, levels: list[float], reach_ms: int = 60_000, horizon_ms: int = 10_000,
    gap_ms: int = 9000, most: int = 1600, least_ticks: int = 80, least_pairs: int = 40, chunk_ms: int | None = None,
) -> DataFrame:
    """Moves of the microprice over the horizon within each prompt's window, from starts thinned to ``most``: their
    number, sum, and quantiles at ``levels`` less the median; prompts with too few ticks or pairs are left out."""
    rows = quotes.select(*keys, "seq", "recv_ts_ms", Q.microprice(or_mid=True).alias("micro"))
    return _of(prompts, rows, keys, at, reach_ms, windows.horizon_pairs(reach_ms, horizon_ms, gap_ms, most, least_ticks, least_pairs, levels), chunk_ms)


def quote_ofi(quotes: DataFrame, *, keys: list[str], chunk_ms: int = 3_600_000) -> DataFrame:
    """Order-flow events of each quote against the one before it: bid's and ask's."""
    quotes = chunked(quotes, keys=keys, ts="recv_ts_ms", seq="seq", chunk_ms=chunk_ms, carry=True)
    w = Window.partitionBy(*keys, "__chunk").orderBy("recv_ts_ms", "seq")

    def event(side: str, better: str) -> Column:
        p, q = F.col(f"{side}_price"), F.col(f"{side}_qty")
        p0, q0 = F.lag(f"{side}_price").over(w), F.lag(f"{side}_qty").over(w)
        up = p > p0 if better == "up" else p < p0
        return F.when(p0.isNull(), 0.0).when(up, q).when(p == p0, q - q0).otherwise(-q0)

    e = quotes.withColumn("bid_event", event("bid", "up")).withColumn("ask_event", event("ask", "down"))
    return without_halo(e).withColumn("ofi", F.col("bid_event") - F.col("ask_event")).withColumn("gross", F.abs("bid_event") + F.abs("ask_event"))


def recent_ofi(prompts: DataFrame, events: DataFrame, *, window_ms: int, recent_ms: int = 1000, least: int = 8, least_recent: int = 3) -> DataFrame:
    """Per prompt and venue, the net order flow of ``quote_ofi``'s latest events over their gross, in [-1, 1].

    Events count from ``recent_ms`` before the window's last quote, that instant included; the
    window's first quote has none before it and gives no event. 0 with fewer than ``least`` quotes in
    the window, ``least_recent`` among the latest (the one before them included), or no change.
    """
    asked = prompts.select("asset", "current_time_ms", F.explode(F.array(F.lit("spot"), F.lit("futures"))).alias("venue"))
    rows = events.select("asset", "venue", "seq", "recv_ts_ms", "ofi", "gross")
    return _of(asked, rows, ["asset", "venue"], "current_time_ms", window_ms, windows.recent_ofi(window_ms, recent_ms, least, least_recent), None)


def book_momentum(quotes: DataFrame, *, keys: list[str], lookback_ms: int, lags: dict[str, int], chunk_ms: int | None = None) -> DataFrame:
    """Log change of the microprice since the last tick at least so long ago, within the lookback; else 0.

    Of ticks at one instant the last by ``seq`` stands for it. Rows are dealt by key and chunk of four lookbacks, with a
    halo of one; within a chunk the tick before is a place in the order of time.
    """
    dealt = chunked(quotes, keys=keys, ts="recv_ts_ms", seq="seq", chunk_ms=chunk_ms or max(4 * lookback_ms, 3_600_000), halo_ms=lookback_ms)
    m = dealt.withColumn("micro", Q.microprice(or_mid=True).cast("double"))
    schema = StructType([*m.schema.fields, *[StructField(n, DoubleType()) for n in lags]])

    def run(rows: pa.Table) -> pa.Table:
        ts, n = rows.column("recv_ts_ms"), len(rows)
        made = dict.fromkeys(lags, np.zeros(n))
        if not ts.null_count:  # rows without an instant have a chunk of their own
            order = np.lexsort((rows.column("seq").to_numpy(), ts.to_numpy()))
            rows = rows.take(pa.array(order))
            at, micro = rows.column("recv_ts_ms").to_numpy(), rows.column("micro").to_numpy()
            micro = np.where(micro > 0, micro, np.nan).astype(float)
            for name, ms in lags.items():
                place = np.searchsorted(at, at - ms, side="right") - 1
                there = (place >= 0) & (at[place] > at - lookback_ms)
                move = np.log(micro / np.where(there, micro[place], np.nan))
                made[name] = np.where(np.isnan(move), 0.0, move)
        for name, values in made.items():
            rows = rows.append_column(name, pa.array(values))
        return rows

    return without_halo(m.groupBy(*keys, "__chunk").applyInArrow(run, schema))


def _size(side: str, n: int | None = None) -> Column:
    levels = F.col(side) if n is None else F.slice(side, 1, n)
    return F.aggregate(levels, F.lit(0.0), lambda s, x: s + x["qty"])


def depth_imbalance(snapshots: DataFrame, *, top: int = 5) -> DataFrame:
    """Imbalance of all levels and of the best; 0 where a side is missing."""
    has = (F.size("bids") > 0) & (F.size("asks") > 0)
    full = Q.ratio(_size("bids") - _size("asks"), _size("bids") + _size("asks"))
    best = Q.ratio(_size("bids", top) - _size("asks", top), _size("bids", top) + _size("asks", top))
    return snapshots.withColumn("obi", F.when(has, full).otherwise(0.0)).withColumn("top_obi", F.when(has, best).otherwise(0.0))


def _banded(snapshots: DataFrame, keep: list[str], width: float, bands: int, give: Callable, columns: str) -> DataFrame:
    """Snapshots with a mid, their levels as flat arrays of an Arrow batch, counted by row, side and band at once.

    ``give`` makes the columns beside ``keep`` of (rows x 2 x bands) sizes and says which rows they are of.
    """
    anchor = 0.5 * (F.get("bids", 0)["price"] + F.get("asks", 0)["price"])
    part = lambda side, c: F.transform(side, lambda x: x[c].cast("double"))
    flat = {f"__{side}_{c}": part(f"{side}s", c) for side in ("bid", "ask") for c in ("price", "qty")}
    s = snapshots.select(*keep, anchor.cast("double").alias("__anchor"), *[v.alias(n) for n, v in flat.items()]).filter("__anchor is not null")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mids = batch.column("__anchor").to_numpy()
            sizes = np.zeros((len(mids), 2, bands))
            for i, (name, side) in enumerate((("bid", 1.0), ("ask", -1.0))):
                row = np.repeat(np.arange(len(mids)), batch.column(f"__{name}_price").value_lengths().to_numpy())
                price, size = (batch.column(f"__{name}_{c}").flatten().to_numpy(zero_copy_only=False) for c in ("price", "qty"))
                off = side * (mids[row] - price) / width
                band = np.ceil(off - 1e-9) - 1 if name == "bid" else np.floor(off + 1e-9)
                inside = (band >= 0) & (band < bands) & (size > 0)
                sizes[:, i] = np.bincount(row[inside] * bands + band[inside].astype(np.int64), size[inside], minlength=len(mids) * bands).reshape(-1, bands)
            rows, made = give(sizes, mids)
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(rows)) for c in keep], *made.values()], [*keep, *made])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s.select(*keep).schema)
    return s.mapInArrow(counted, f"{own}, {columns}")


def depth_bands(snapshots: DataFrame, *, id_cols: list[str], width: float, bands: int = 100) -> DataFrame:
    """Sizes by side and band of fixed width from the mid, one row for each band that has any.

    A snapshot is one row and gives its own bands, so nothing is shuffled. One without a best level on both
    sides has no mid and no bands; levels out of the bands, or without a size, are dropped.
    """

    def rows(sizes: np.ndarray, _: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        row, side, band = np.nonzero(sizes)
        return row, {"side": pa.array(np.array(["bid", "ask"])[side].tolist(), pa.string()), "band": pa.array(band, pa.int32()), "size": pa.array(sizes[row, side, band])}

    return _banded(snapshots, id_cols, width, bands, rows, "side string, band int, size double")


def dense_bands(snapshots: DataFrame, *, id_cols: list[str], width: float, bands: int = 100) -> DataFrame:
    """``depth_bands`` as two arrays of ``bands`` sizes a snapshot, with the mid they lie round; zeros where nothing is."""

    def arrays(sizes: np.ndarray, mids: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
        offsets = pa.array(np.arange(len(mids) + 1) * bands, pa.int32())
        sides = [pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(sizes[:, i]).ravel())) for i in (0, 1)]
        return np.arange(len(mids)), {"anchor": pa.array(mids), "bid_bands": sides[0], "ask_bands": sides[1]}

    return _banded(snapshots, id_cols, width, bands, arrays, "anchor double, bid_bands array<double>, ask_bands array<double>")


def band_imbalance(bands: DataFrame, *, id_cols: list[str], width: float, reach: float) -> DataFrame:
    """Imbalance of the bands that overlap ``mid`` within ``reach``; bands lie round ``anchor``, the mid has moved on."""
    near, far = F.col("band") * width, (F.col("band") + 1) * width
    bid = (F.col("side") == "bid") & (F.col("anchor") - near > F.col("mid") - reach) & (F.col("anchor") - far < F.col("mid"))
    ask = (F.col("side") == "ask") & (F.col("anchor") + near < F.col("mid") + reach) & (F.col("anchor") + far > F.col("mid"))
    sums = [F.coalesce(F.sum(F.when(c, F.col("size"))), F.lit(0.0)) for c in (bid, ask)]
    return bands.groupBy(*id_cols).agg(Q.ratio(sums[0] - sums[1], sums[0] + sums[1]).alias("band_imb"))


def walked_book(snapshots: DataFrame, *, notional: float) -> DataFrame:
    """How far from the touch each side must be walked for a notional; gap is bid's less ask's."""

    def distance(side: str) -> Column:
        start = F.struct(F.lit(0.0).alias("sum"), F.lit(None).cast("double").alias("at"))
        end = F.aggregate(side, start, lambda s, x: F.struct((s["sum"] + x["price"] * x["qty"]).alias("sum"), F.coalesce(s["at"], F.when(s["sum"] + x["price"] * x["qty"] >= notional, x["price"])).alias("at")))
        return F.abs(F.coalesce(end["at"], F.element_at(side, -1)["price"]) - F.get(side, 0)["price"])

    s = snapshots.withColumn("bid_walk", distance("bids")).withColumn("ask_walk", distance("asks"))
    return s.withColumn("gap", F.col("bid_walk") - F.col("ask_walk"))


def top_levels(levels: DataFrame, *, id_cols: list[str], n: int = 20) -> DataFrame:
    """The best ``n`` levels of each side of a long table, ranked from 1."""
    best = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    w = Window.partitionBy(*id_cols, "side").orderBy(best)
    return levels.withColumn("level", F.row_number().over(w)).filter(F.col("level") <= n)


def replayed_book(start: DataFrame, diffs: DataFrame, *, id_cols: list[str]) -> DataFrame:
    """Levels after the diffs: the last size at a price wins, size 0 removes it."""
    first = start.select(*id_cols, "side", "price", "qty", F.lit(-1).cast("long").alias("seq"))
    return last_levels(first.unionByName(diffs.select(*id_cols, "side", "price", "qty", F.col("seq").cast("long").alias("seq"))), id_cols=id_cols)


def last_levels(rows: DataFrame, *, id_cols: list[str]) -> DataFrame:
    """Of sizes at a price the last by ``seq``, if it isn't 0; rows that are dealt by some of ``id_cols`` already don't move."""
    return rows.groupBy(*id_cols, "side", "price").agg(F.max_by("qty", "seq").alias("qty")).filter("qty > 0")


def depth_pairs(joined: DataFrame, *, keys: list[str], at: str, back_ms: int = 60_000, tolerance_ms: int = 1500) -> DataFrame:
    """The last snapshot at the anchor and the one nearest to ``back_ms`` before it, ties to the earlier."""
    distance = F.abs(F.col("recv_ts_ms") - (F.col(at) - back_ms))
    pair = joined.groupBy(*keys, at).agg(F.max_by("update_id", F.struct("recv_ts_ms", "seq")).alias("latest"), F.min_by("update_id", F.struct(distance.alias("d"), "recv_ts_ms", "seq")).alias("start"), F.min(distance).alias("off_ms"))
    return pair.withColumn("usable", F.col("off_ms") <= tolerance_ms)


def mid_change_counts(grid: DataFrame, *, keys: list[str], value: str, ts: str, step_ms: int, steps: int, span: int, within: float = 0.0, recent: int | None = None, chunk_ms: int | None = None) -> DataFrame:
    """``grid`` with ``changed, changes, still, still_share, since`` (and ``recent`` changes, if asked for).

    On a grid of ``step_ms``: changes of more than ``within`` in the last ``steps``, whether ``span``
    steps back the value was the same, the share of that in the last ``steps``, and the time since
    the last change. Rows are dealt by key and chunk of time with a halo of the frames' length;
    the last change before a chunk is one row per chunk.
    """
    wide = chunk_ms or 64 * steps * step_ms
    dealt = chunked(grid, keys=keys, ts=ts, seq=ts, chunk_ms=wide, halo_ms=(steps + span) * step_ms)
    w = Window.partitionBy(*keys, "__chunk").orderBy(ts)
    same = lambda k: F.abs(F.col(value) - F.lag(value, k).over(w)) <= within
    g = dealt.withColumn("changed", F.coalesce(~same(1), F.lit(False)).cast("int")).withColumn("__held", same(span))
    frame = w.rowsBetween(-(steps - 1), 0)
    g = g.withColumn("changes", F.sum("changed").over(frame)).withColumn("still_share", F.avg(F.col("__held").cast("double")).over(frame))
    g = g.withColumn("still", F.coalesce("__held", F.lit(False))).drop("__held")
    if recent:
        g = g.withColumn("recent", F.sum("changed").over(w.rowsBetween(-(recent - 1), 0)))
    g = without_halo(g.withColumn("__c", F.col("__chunk"))).withColumn("__t", F.when(F.col("changed") == 1, F.col(ts)))
    last = g.groupBy(*keys, "__c").agg(F.max("__t").alias("__m"))
    carried = last.withColumn("__before", F.last("__m", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1))).drop("__m")
    upto = Window.partitionBy(*keys, "__c").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("__l", F.last("__t", ignorenulls=True).over(upto)).join(carried, [*keys, "__c"], "left")
    return g.withColumn("since", F.col(ts) - F.coalesce("__l", "__before")).drop("__t", "__l", "__c", "__before")
