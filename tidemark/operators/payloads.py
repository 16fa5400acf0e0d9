"""Payloads: a prompt's windows as one nested row, and what is wrong with such rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructType

from tidemark.operators import windows
from tidemark.scratch import written
from tidemark.sources.files import PAYLOAD

PROMPT = ["asset", "current_time_ms"]


def filter_depth_updates(updates: DataFrame, starts: DataFrame, *, keys: list[str], bridge_ms: int = 2000) -> DataFrame:
    """Diffs that continue a start snapshot: within (lo, hi], or the bridge that spans the snapshot's id.

    ``starts`` has ``keys, start_id, start_recv_ms, lo_ms, hi_ms``, a row per prompt and stream.
    """
    j = updates.join(starts, keys)
    inside = F.col("recv_ts_ms") > F.col("lo_ms")
    bridge = (F.col("recv_ts_ms") > F.col("start_recv_ms") - bridge_ms) & (F.col("first_id") <= F.col("start_id") + 1)
    return j.filter((F.col("final_id") >= F.col("start_id")) & (F.col("recv_ts_ms") <= F.col("hi_ms")) & (inside | bridge))


#: The rows of a payload's streams, in the order of ``files.VENUE``'s fields; ``at`` is when a prompt can see them.
STREAM_FIELDS = {
    "candles_1s": ("open_time_ms", "open", "high", "low", "close", "volume"),
    "trades": ("ts_ms", "event_ts_ms", "recv_ts_ms", "price", "qty", "buyer_is_maker"),
    "book_ticker": ("recv_ts_ms", "bid_price", "bid_qty", "ask_price", "ask_qty", "event_ts_ms", "transaction_ts_ms"),
    "liquidations": ("ts_ms", "recv_ts_ms", "price", "qty", "is_buy"),
    "depth_updates": ("recv_ts_ms", "event_ts_ms", "transaction_ts_ms", "first_id", "final_id", "prev_final_id", "bids", "asks"),
    "depth": ("recv_ts_ms", "update_id", "event_ts_ms", "transaction_ts_ms", "bids", "asks"),
    "bands": ("anchor_price", "bids", "asks", "recv_ts_ms"),
}


#: Prompts whose payloads are folded in one task, about.
PROMPTS_A_TASK = 16

#: Streams of which a prompt gets single snapshots, and those of which it gets the rows of a window.
SNAPSHOTS = ("depth", "bands")
WINDOWS = tuple(n for n in STREAM_FIELDS if n not in SNAPSHOTS)
VENUES = ("spot", "futures")


def _picked(prompts: DataFrame, streams: dict[str, DataFrame], lives: dict[str, int], made: dict[str, Callable[[DataFrame], DataFrame]], back_ms: int) -> DataFrame:
    """A row a prompt, venue and place (``depth_latest``, ``depth_start``, ``bands_latest``) with that snapshot as ``depth`` or ``bands``.

    Places are found on instants and ``seq`` alone; the snapshots found, few and each once, are then looked up and made.
    """
    asked = prompts.select(*PROMPT).distinct().withColumn("venue", F.explode(F.array(*map(F.lit, VENUES))))
    place = ["asset", "venue", "at", "seq"]
    out = None
    for name in SNAPSHOTS:
        measure, gives = windows.snapshots(lives[name], back_ms)
        found = windows.window_stats(asked, streams[name].select(*place), keys=["asset", "venue"], at="current_time_ms", ts="at", seq="seq", reach_ms=lives[name], measure=measure, gives=gives)
        each = F.array(*[F.struct(F.lit(f"{name}_{w}").alias("place"), F.col(f"{w}_at").alias("at"), F.col(f"{w}_seq").alias("seq"), F.col("off").alias("off")) for w in (("latest", "start") if name == "depth" else ("latest",))])
        found = written(found.select(*PROMPT, "venue", F.inline(each)), "places")
        rows = streams[name].join(found.select(*place).distinct(), place).dropDuplicates(place)
        rows = made[name](rows) if name in made else rows
        rows = written(rows.select(*place, F.struct(*STREAM_FIELDS[name]).alias(name)), "snapshots")
        own = found.join(rows, place)
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def _tagged(streams: dict[str, DataFrame], lives: dict[str, int], width_ms: int) -> DataFrame:
    """All streams but snapshots as one table: ``asset, venue, at, seq``, an array column a stream, empty but for the
    row's own, and the buckets of time whose prompts can see the row.

    Empty arrays, as nulls cost their fields' width on the way to Python, and arrays in them time by the square of a batch.
    """
    kinds = {n: streams[n].select(F.array(F.struct(*STREAM_FIELDS[n])).alias(n)).schema[n].dataType for n in WINDOWS}
    out = None
    for name in kinds:
        rows = streams[name].select("asset", "venue", F.col("at"), "seq", F.lit(lives[name]).cast("long").alias("life"), F.array(F.struct(*STREAM_FIELDS[name])).alias("__row"))
        own = rows.select("asset", "venue", "at", "seq", "life", *[(F.col("__row") if n == name else F.array().cast(k)).alias(n) for n, k in kinds.items()])
        out = own if out is None else out.unionByName(own)
    seen = F.sequence(F.floor(F.col("at") / width_ms), F.floor((F.col("at") + F.col("life") - 1) / width_ms))
    return out.filter("asset is not null").withColumn("__bucket", F.explode(seen)).drop("life")


def _placed(prompts: DataFrame, picks: DataFrame, tolerance_ms: int) -> DataFrame:
    """Prompts with each venue's snapshots: ``spot_depth``, ``spot_bands`` and ``spot_start``, the first two with their instants."""
    held = []
    for v in VENUES:
        for name in SNAPSHOTS:
            latest = (F.col("venue") == v) & (F.col("place") == f"{name}_latest")
            held += [F.max_by(F.when(latest, F.col(name)), F.when(latest, F.col("at"))).alias(f"{v}_{name}"), F.max(F.when(latest, F.col("at"))).alias(f"{v}_{name}_at")]
        nearest = (F.col("venue") == v) & (F.col("place") == "depth_start") & (F.col("off") <= tolerance_ms)
        held.append(F.max_by(F.when(nearest, F.col("depth")), F.when(nearest, F.col("at"))).alias(f"{v}_start"))
    return prompts.join(picks.groupBy(*PROMPT).agg(*held), PROMPT, "left")


def _in_order(batches: list[pa.RecordBatch], name: str) -> tuple[np.ndarray, pa.StructArray]:
    """Instants and rows of one stream by ``at`` and ``seq``; rows that share both, by their fields."""
    t = pa.Table.from_batches(batches)
    rows = pa.concat_arrays([c.flatten() for c in t.column(name).chunks])
    fields = {f"f{i}": pc.struct_field(rows, [i]) for i, f in enumerate(rows.type) if not pa.types.is_nested(f.type)}
    keys = pa.table({"at": t.column("at"), "seq": t.column("seq"), **fields})
    order = pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in keys.column_names], null_placement="at_start")
    return t.column("at").take(order).to_numpy(), rows.take(order)


def _folded(rows: DataFrame, lives: dict[str, int], *, back_ms: int, bridge_ms: int) -> DataFrame:
    """The prompts among the rows of ``_tagged`` (``prompt``) with each stream's window as an array, and its newest instant.

    A bucket comes in batches and is held once, as sorted columns a stream; a window is a slice of
    them, and a prompt is a batch of its own. So what a task holds goes by its bucket's rows, not by rows times prompts.
    """
    schema = StructType().add("prompt", rows.schema["prompt"].dataType.elementType)
    for v in VENUES:
        for n in WINDOWS:
            schema = schema.add(f"{v}_{n}", rows.schema[n].dataType).add(f"{v}_{n}_at", LongType())
    wanted = to_arrow_schema(schema)

    def goes_on(updates: pa.StructArray, prompt: pa.StructArray, v: str) -> pa.Array:
        recv, first, final = (pc.struct_field(updates, f) for f in ("recv_ts_ms", "first_id", "final_id"))
        now, start, start_ms = (pc.struct_field(prompt, f)[0] for f in ("current_time_ms", [f"{v}_start", "update_id"], [f"{v}_start", "recv_ts_ms"]))
        bridge = pc.and_kleene(pc.greater(recv, pc.subtract(start_ms, bridge_ms)), pc.less_equal(first, pc.add(start, 1)))
        return pc.and_kleene(pc.greater_equal(final, start), pc.or_kleene(pc.greater(recv, pc.subtract(now, back_ms)), bridge))

    def fold(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, parts = [], {(v, n): [] for v in VENUES for n in WINDOWS}
        for b in batches:
            asked.append(b.column("prompt").flatten())
            for v, n in parts:
                mine = b.select(["at", "seq", n]).filter(pc.and_(pc.greater(pc.list_value_length(b.column(n)), 0), pc.equal(b.column("venue"), v)))
                if len(mine):
                    parts[v, n].append(mine)
        prompts = pa.concat_arrays(asked)
        held = {k: _in_order(parts.pop(k), k[1]) if parts[k] else None for k in list(parts)} if len(prompts) else {}
        for i in range(len(prompts)):
            prompt, out = prompts.slice(i, 1), {}
            now = pc.struct_field(prompt, "current_time_ms")[0].as_py()
            for (v, n), there in held.items():
                kind = wanted.field(f"{v}_{n}").type
                at, window = there or (np.empty(0, np.int64), pa.array([], kind.value_type))
                lo, hi = (0, 0) if now is None else map(int, np.searchsorted(at, [now - lives[n], now], side="right"))
                window = window.slice(lo, hi - lo)
                if n == "depth_updates" and hi > lo:
                    window = window.filter(goes_on(window, prompt, v))
                out[f"{v}_{n}"] = pa.ListArray.from_arrays(pa.array([0, len(window)], pa.int32()), window, type=kind)
                out[f"{v}_{n}_at"] = pa.array([int(at[hi - 1]) if hi > lo else None], pa.int64())
            yield pa.RecordBatch.from_arrays([prompt, *out.values()], schema=wanted)

    return rows.groupBy("__asset", "__bucket").applyInArrow(fold, schema)


def whole_payloads(
    prompts: DataFrame, streams: dict[str, DataFrame], *, assets: dict[str, tuple[str, float]], lives: dict[str, int], bars: int = 3600, bar_ms: int = 1000,
    back_ms: int = 60_000, tolerance_ms: int = 1500, bridge_ms: int = 2000, version: int = 5, horizon: int = 10, percentiles: int = 100,
    made: dict[str, Callable[[DataFrame], DataFrame]] | None = None,
) -> DataFrame:
    """One nested row of ``files.PAYLOAD``'s columns per prompt (``asset, current_time_ms, kind, venue``).

    ``streams`` names tables of ``STREAM_FIELDS`` beside ``asset, venue, at, seq``: what a prompt sees of each is the rows
    with ``at`` in (now - life, now], by ``at`` and ``seq``. Of ``depth`` it gets the last snapshot, and the nearest to
    ``back_ms`` before (ties to the earlier, none beyond ``tolerance_ms``); of ``depth_updates`` those that go on from that
    one's id, within ``back_ms`` or as the bridge to it; of ``bands`` the last. A prompt without any row gets empty arrays.
    ``made`` says how the rows of ``depth`` or ``bands`` get their fields, if they don't have them; it sees those that prompts get.

    Snapshots are found by their instants, so only those that a prompt gets are moved. The other streams are one
    tagged union, dealt once by asset and bucket of time with the prompts, and folded where they meet: neither the rows
    of the windows nor the payloads move again. For export: a row holds its windows whole, whose size the lives bound.
    """
    width = max(sorted(lives.values())[len(lives) // 4], max(lives.values()) // 4)  # or most rows would go to many buckets
    p = written(prompts.select(*PROMPT, "kind", F.col("venue").alias("__venue")), "prompts")
    asked = written(_placed(p, _picked(p, streams, lives, made or {}, back_ms), tolerance_ms), "asked")
    tasks = max(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-p.count() // PROMPTS_A_TASK))

    def dealt(df: DataFrame) -> DataFrame:
        keyed = df.withColumn("__asset", F.coalesce(F.concat(F.lit("="), "asset"), F.lit("")))  # a null has a place, too
        return keyed.drop("asset").repartition(tasks, "__asset", "__bucket")

    tagged = _tagged(streams, lives, width)
    own = F.array(F.struct(*asked.columns)).alias("prompt")
    bucket = F.coalesce(F.floor(F.col("current_time_ms") / width), F.lit(0)).alias("__bucket")
    asking = asked.select("asset", bucket, own, *[F.array().cast(tagged.schema[n].dataType).alias(n) for n in WINDOWS])
    tagged = tagged.withColumn("prompt", F.array().cast(asked.select(own).schema["prompt"].dataType))
    rows = dealt(tagged).unionByName(dealt(asking), allowMissingColumns=True)
    full = _folded(rows, lives, back_ms=back_ms, bridge_ms=bridge_ms).select("prompt.*", *[f"{v}_{n}{x}" for v in VENUES for n in WINDOWS for x in ("", "_at")])
    known = lambda i: F.coalesce(*[F.when(F.col("asset") == a, F.lit(spec[i])) for a, spec in assets.items()])

    def side(v: str) -> Column:
        opened = F.transform(f"{v}_candles_1s", lambda x: x["open_time_ms"])
        complete = (F.size(opened) >= bars) & (F.array_max(opened) - F.array_min(opened) >= (bars - 1) * bar_ms)
        b = F.col(f"{v}_bands")
        none = F.array().cast("array<double>")
        sizes = [F.coalesce(b[n], none) for n in ("bids", "asks")]
        bands = F.struct(F.coalesce(b["anchor_price"], F.lit(0.0)), known(1), *sizes, F.coalesce(b["recv_ts_ms"], F.lit(0).cast("long")))
        held = [F.col(f"{v}_{n}") for n in WINDOWS]
        times = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{v}_{n}_at").alias("at")) for n in STREAM_FIELDS]), lambda e: e["at"].isNotNull()))
        return F.struct(known(0), F.coalesce(complete, F.lit(False)), *held, F.col(f"{v}_start"), F.col(f"{v}_depth"), bands, times)

    venues = F.struct(*[side(v).alias(v) for v in VENUES])
    trigger = F.struct("kind", F.col("__venue").alias("venue"))
    numbers = [F.lit(n).cast("int").alias(c) for n, c in ((horizon, "horizon_seconds"), (percentiles, "num_percentiles"))]
    kinds = StructType.fromDDL(PAYLOAD)
    return full.select(F.lit(version).cast("int").alias("schema_version"), *PROMPT, *numbers, trigger.cast(kinds["trigger"].dataType).alias("trigger"), venues.cast(kinds["venues"].dataType).alias("venues"))


def _out_of_order(rows: str, field: str, *, rising: bool) -> Column:
    """Whether a value lies on the wrong side of the one before it."""
    t = F.transform(rows, lambda x: x[field])
    wrong = (lambda b, a: b < a) if rising else (lambda b, a: b > a)
    return F.exists(F.zip_with(F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))), t, wrong), lambda x: F.coalesce(x, F.lit(False)))


def _lacks(rows: str, *fields: str) -> Column:
    """Whether a row lacks one of the fields."""
    return F.exists(rows, lambda x: F.coalesce(*[F.when(x[f].isNull(), True) for f in fields], F.lit(False)))


def _venue_rules(v: str, symbol: Column, bucket: Column, *, bars: int, bar_ms: int) -> list[tuple[str, Column]]:
    at = f"venues.{v}"
    col = lambda name: F.col(f"{at}.{name}")
    none = lambda c: F.coalesce(c, F.lit(False))
    futures = v == "futures"
    rules = [(f"{v}:symbol", symbol.isNotNull() & ~none(col("symbol") == symbol))]
    needed = {"candles_1s": ("open_time_ms", "open", "high", "low", "close", "volume"), "trades": ("ts_ms", "event_ts_ms", "recv_ts_ms", "price", "qty", "buyer_is_maker"), "book_ticker": ("recv_ts_ms", "bid_price", "bid_qty", "ask_price", "ask_qty"), "liquidations": ("ts_ms", "recv_ts_ms", "price", "qty", "is_buy")}
    for stream, fields in needed.items():
        rules.append((f"{v}:{stream}:missing", col(stream).isNull()))
        rules.append((f"{v}:{stream}:fields", _lacks(f"{at}.{stream}", *fields)))
        rules.append((f"{v}:{stream}:time_order", _out_of_order(f"{at}.{stream}", fields[0] if stream == "candles_1s" else "recv_ts_ms", rising=True)))
    opened = F.transform(f"{at}.candles_1s", lambda x: x["open_time_ms"])
    whole = (F.size(opened) >= bars) & (F.array_max(opened) - F.array_min(opened) >= (bars - 1) * bar_ms)
    rules.append((f"{v}:complete_history", ~none(col("complete_history") == none(whole))))
    timed = lambda x: x["event_ts_ms"].isNotNull() & x["transaction_ts_ms"].isNotNull()
    blank = lambda x: x["event_ts_ms"].isNull() & x["transaction_ts_ms"].isNull()
    rules.append((f"{v}:book_ticker:times", F.exists(f"{at}.book_ticker", lambda x: ~(timed(x) if futures else blank(x)))))
    for snap in ("depth_start", "depth_latest"):
        rules.append((f"{v}:{snap}:missing", col(snap).isNull()))
        rules.append((f"{v}:{snap}:times", col(snap).isNotNull() & ~(timed(col(snap)) if futures else blank(col(snap)))))
        for side in ("bids", "asks"):
            rules.append((f"{v}:{snap}:{side}", col(snap).isNotNull() & F.coalesce(_lacks(f"{at}.{snap}.{side}", "price", "qty"), F.lit(True))))
            rules.append((f"{v}:{snap}:{side}_order", _out_of_order(f"{at}.{snap}.{side}", "price", rising=side == "asks")))
    ids = (lambda x: x["transaction_ts_ms"].isNull() | x["prev_final_id"].isNull()) if futures else (lambda x: x["transaction_ts_ms"].isNotNull())
    rules.append((f"{v}:depth_updates:fields", _lacks(f"{at}.depth_updates", "event_ts_ms")))
    rules.append((f"{v}:depth_updates:ids", F.exists(f"{at}.depth_updates", ids)))
    if not futures:
        rules.append((f"{v}:liquidations:not_empty", F.size(f"{at}.liquidations") > 0))
    b = lambda name: col(f"depth_bands.{name}")
    sizes = F.size(F.coalesce(b("bids"), F.array())) + F.size(F.coalesce(b("asks"), F.array()))
    there = col("depth_bands").isNotNull()
    rules.append((f"{v}:depth_bands:missing", ~there | b("recv_ts_ms").isNull()))
    if futures:
        rules.append((f"{v}:depth_bands:not_empty", (b("recv_ts_ms") != 0) | (sizes > 0)))
    else:
        rules.append((f"{v}:depth_bands:not_empty", (b("recv_ts_ms") == 0) & (sizes > 0)))
        rules.append((f"{v}:depth_bands:shape", (b("recv_ts_ms") != 0) & ~none((F.size(b("bids")) == F.size(b("asks"))) & (b("bucket_usd") > 0))))
        rules.append((f"{v}:depth_bands:anchor", (b("recv_ts_ms") != 0) & ~none(b("anchor_price") > 0)))
    rules.append((f"{v}:depth_bands:bucket", there & bucket.isNotNull() & ~none(F.abs(b("bucket_usd") - bucket) <= F.greatest(F.lit(1e-9), 1e-6 * bucket))))
    times = f"{at}.last_event_times"
    rules.append((f"{v}:last_event_times", F.col(times).isNull() | F.exists(F.map_values(times), lambda t: t.isNull())))
    return rules


def saved_payload_violations(payloads: DataFrame, *, assets: dict[str, tuple[str, float]], kinds: tuple[str, ...], venues: tuple[str, ...] = ("spot", "futures"), version: int = 5, horizon: int = 10, percentiles: int = 100, bars: int = 3600, bar_ms: int = 1000) -> DataFrame:
    """Saved payloads (of ``files.PAYLOAD``'s columns) with ``codes``: all rules a row breaks, in order; empty for a good one.

    ``assets`` gives each asset's symbol and width of depth bands. In a typed row a field that
    was absent is null, so the two are one. A row without venues lacks everything of theirs; of
    a missing stream only that is said.
    """
    known = lambda i: F.coalesce(*[F.when(F.col("asset") == a, F.lit(spec[i])) for a, spec in assets.items()])
    off = lambda c: ~F.coalesce(c, F.lit(False))
    kind, venue = F.col("trigger.kind"), F.col("trigger.venue")
    placed = F.when(kind == "time", venue.isNull()).otherwise(venue.isin(*venues))
    rules = [
        ("version", off(F.col("schema_version") >= version)), ("current_time", off(F.col("current_time_ms") > 0)), ("kind", off(kind.isin(*kinds))), ("trigger_venue", kind.isin(*kinds) & off(placed)),
        ("horizon", off(F.col("horizon_seconds") == horizon)), ("percentiles", off(F.col("num_percentiles") == percentiles)), ("asset", off(F.col("asset").isin(*assets))),
    ]
    for v in ("spot", "futures"):
        rules += _venue_rules(v, known(0), known(1), bars=bars, bar_ms=bar_ms)
    return payloads.withColumn("codes", F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in rules])))
