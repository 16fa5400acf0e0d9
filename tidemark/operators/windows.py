"""Statistics of trailing windows without the windows' rows.

Prompts and rows are dealt by key and chunk of time, rows with a halo of the longest window, so what is
shuffled grows with rows plus prompts. Within a chunk a window is two places in the order of
time: sums come from prefix sums, least and largest values from tables of doubled spans, and single rows by
their place. Nothing depends on the chunk.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemark.operators.asof import chunked

#: Cells of a table of prompts by places that are gathered at once.
GATHERED = 2_000_000
Between = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Rows:
    """Rows of one key and chunk in order of time: ``ts`` and numeric columns."""

    def __init__(self, columns: dict[str, np.ndarray], ts: str):
        self.columns, self.name, self.ts = columns, ts, columns[ts]

    def __len__(self) -> int:
        return len(self.ts)

    def __getitem__(self, column: str) -> np.ndarray:
        return self.columns[column]

    def part(self, keep: np.ndarray) -> Rows:
        return Rows({n: c[keep] for n, c in self.columns.items()}, self.name)

    def upto(self, at: np.ndarray) -> np.ndarray:
        """How many rows stand at or before each instant: the place behind them."""
        return np.searchsorted(self.ts, at, side="right")

    def window(self, at: np.ndarray, ms: int) -> tuple[np.ndarray, np.ndarray]:
        """Places [lo, hi) of the rows in (at - ms, at]."""
        return self.upto(at - ms), self.upto(at)

    def sums(self, values: np.ndarray) -> Between:
        """Sum of ``values`` between two places; what is no number counts 0."""
        before = np.concatenate([[0], np.cumsum(np.nan_to_num(values), dtype=np.longdouble)])
        return lambda lo, hi: (before[hi] - before[lo]).astype(float)

    def extremes(self, values: np.ndarray, better: np.ufunc) -> Between:
        """Least or largest (``better``: numpy.fmin or fmax) of ``values`` between two places; no number where there are none."""
        spans = [np.asarray(values, float)]
        while (width := 1 << len(spans)) <= len(values):
            half = spans[-1]
            spans.append(better(half[: len(values) - width + 1], half[width // 2 :][: len(values) - width + 1]))

        def between(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            out = np.full(len(lo), np.nan)
            power = np.zeros(len(lo), np.int64)
            some = hi > lo
            power[some] = np.frexp(hi[some] - lo[some])[1] - 1  # of 2 up to the number of rows
            for p in np.unique(power[some]):
                mine = some & (power == p)
                out[mine] = better(spans[p][lo[mine]], spans[p][hi[mine] - (1 << int(p))])
            return out

        return between

    def pick(self, column: str | np.ndarray, place: np.ndarray, there: np.ndarray) -> np.ndarray:
        """The column's value at each place, where there is one; else no number."""
        values = self.columns[column] if isinstance(column, str) else column
        out = np.full(len(place), np.nan)
        out[there] = values[place[there]]
        return out


Measure = Callable[[Rows, np.ndarray], dict[str, np.ndarray]]


def window_stats(prompts: DataFrame, rows: DataFrame, *, keys: list[str], at: str, ts: str, seq: str, reach_ms: int, measure: Measure, gives: str, chunk_ms: int | None = None) -> DataFrame:
    """``keys``, ``at`` and what ``measure`` gives (a schema) for each prompt; it leaves out prompts by ``there``.

    ``rows`` has numeric columns beside its keys; ``measure`` gets those of one key and chunk by
    ``ts`` and ``seq``, with all that stand within ``reach_ms`` before the chunk, and the instants of the
    chunk's prompts. Its arrays are as long as these; an array ``there`` says which prompts stay.
    Null keys and instants match nothing; repeated prompts stay. A chunk is four reaches or an hour
    long, so a row is sent 1.25 times or less on average; its rows meet in one task.
    """
    width = max(chunk_ms or max(4 * reach_ms, 3_600_000), 1)
    asked = prompts.select(*keys, at).dropna(subset=[*keys, at]).withColumn("__chunk", F.floor(F.col(at) / width).cast("long"))
    dealt = chunked(rows.dropna(subset=[*keys, ts]), keys=keys, ts=ts, seq=seq, chunk_ms=width, halo_ms=reach_ms).drop("__halo")
    numbers = [c for c in rows.columns if c not in keys]
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.select(*keys, at).schema)
    schema = StructType.fromDDL(f"{own}, {gives}")
    wanted = to_arrow_schema(schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        instants = left.column(at).to_numpy()
        columns = {c: right.column(c).to_numpy() for c in numbers}
        order = np.lexsort((columns[seq], columns[ts]))
        made = measure(Rows({c: v[order] for c, v in columns.items()}, ts), instants) if len(left) and len(right) else {}
        there = made.pop("there", None)
        if not made or not there.any():
            return wanted.empty_table()
        stay = left.filter(pa.array(there))
        return pa.table({**{c: stay.column(c) for c in (*keys, at)}, **{n: pa.array(v[there], wanted.field(n).type, from_pandas=True) for n, v in made.items()}}).select(wanted.names)

    groups = [*keys, "__chunk"]
    return asked.groupBy(*groups).cogroup(dealt.groupBy(*groups)).applyInArrow(run, schema)


def ratio(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``part / whole``, 0 where the whole isn't above 0."""
    return np.divide(part, whole, out=np.zeros(len(part)), where=whole > 0)


def trade_flow(reach_ms: int, last_n: int, window_ms: int) -> tuple[Measure, str]:
    """A3: signed taker imbalance of the window, of its last prints, and of the last milliseconds
    that end at the last trade (both ends included), with their quantity. Columns signed, qty."""

    def measure(rows: Rows, at: np.ndarray) -> dict[str, np.ndarray]:
        lo, hi = rows.window(at, reach_ms)
        there = hi > lo
        newest = rows.ts[np.maximum(hi - 1, 0)]
        late = np.maximum(lo, np.searchsorted(rows.ts, newest - window_ms, side="left"))
        signed, qty = rows.sums(rows["signed"]), rows.sums(rows["qty"])
        share = lambda a: ratio(signed(a, np.maximum(hi, a)), qty(a, np.maximum(hi, a)))
        return {"flow": share(lo), "flow_fast": share(np.maximum(lo, hi - last_n)), "flow_window": share(late), "qty_window": qty(late, np.maximum(hi, late)), "there": there}

    return measure, "flow double, flow_fast double, flow_window double, qty_window double"


def tick_counts(windows: dict[str, int]) -> tuple[Measure, str]:
    """Count, volume, signed flow, price range and VWAP of the trailing windows by name. Columns signed, qty, price."""
    reach = max(windows.values())

    def measure(rows: Rows, at: np.ndarray) -> dict[str, np.ndarray]:
        signed, qty, paid = rows.sums(rows["signed"]), rows.sums(rows["qty"]), rows.sums(rows["price"] * rows["qty"])
        high, low = rows.extremes(rows["price"], np.fmax), rows.extremes(rows["price"], np.fmin)
        out = {}
        for name, ms in windows.items():
            lo, hi = rows.window(at, ms)
            vol = qty(lo, hi)
            vwap = np.divide(paid(lo, hi), vol, out=np.full(len(at), np.nan), where=vol > 0)
            out |= {f"n_{name}": hi - lo, f"vol_{name}": vol, f"flow_{name}": signed(lo, hi), f"range_{name}": high(lo, hi) - low(lo, hi), f"vwap_{name}": vwap}
        lo, hi = rows.window(at, reach)
        return out | {"there": hi > lo}

    return measure, ", ".join(f"n_{n} long, vol_{n} double, flow_{n} double, range_{n} double, vwap_{n} double" for n in windows)


def side_flow(reach_ms: int, window_ms: int) -> tuple[Measure, str]:
    """A4: what takers bought and sold in (at - window, at], for prompts with a trade in reach. Columns signed, qty."""

    def measure(rows: Rows, at: np.ndarray) -> dict[str, np.ndarray]:
        bought, sold = rows.sums(np.maximum(rows["signed"], 0)), rows.sums(np.maximum(-rows["signed"], 0))
        lo, hi = rows.window(at, window_ms)
        return {"bought": bought(lo, hi), "sold": sold(lo, hi), "there": hi > rows.upto(at - reach_ms)}

    return measure, "bought double, sold double"


def liquidation_signals(reach_ms: int, recent_ms: int, unit: float, long_unit: float) -> tuple[Measure, str]:
    """Direction of liquidations in [at - recent, at] and activity in [at - reach, at], by tanh. Columns signed, qty above 0."""

    def measure(rows: Rows, at: np.ndarray) -> dict[str, np.ndarray]:
        signed, qty = rows.sums(rows["signed"]), rows.sums(rows["qty"])
        hi, lo, late = rows.upto(at), rows.upto(at - reach_ms - 1), rows.upto(at - recent_ms - 1)
        return {"direction": np.tanh(signed(late, hi) / unit), "activity": np.tanh(qty(lo, hi) / long_unit), "n": hi - lo, "there": hi > lo}

    return measure, "direction double, activity double, n long"


def liquidation_sums(windows: dict[str, int]) -> tuple[Measure, str]:
    """Signed quantity and count of the trailing windows by name. Column signed."""

    def measure(rows: Rows, at: np.ndarray) -> dict[str, np.ndarray]:
        signed, out = rows.sums(rows["signed"]), {}
        for name, ms in windows.items():
            lo, hi = rows.window(at, ms)
            out |= {f"liq_signed{name}": signed(lo, hi), f"liq_n{name}": hi - lo}
        lo, hi = rows.window(at, max(windows.values()))
        return out | {"there": hi > lo}

    return measure, ", ".join(f"liq_signed{n} double, liq_n{n} long" for n in windows)


def evenly(lo: np.ndarray, hi: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` places of each [lo, hi), evenly spaced with both ends, and which of the table's cells hold one."""
    n, k = np.maximum(hi - lo, 0), np.arange(most)
    spaced = (k * ((n - 1) / max(most - 1, 1))[:, None]).astype(np.int64)
    spaced[:, -1] = n - 1
    valid = k < np.minimum(n, most)[:, None]
    return lo[:, None] + np.where(valid, np.where((n > most)[:, None], spaced, k), 0), valid


def sliced(count: int, width: int) -> list[slice]:
    """Stretches of ``count`` prompts whose tables of ``width`` places stay small."""
    step = max(1, GATHERED // max(width, 1))
    return [slice(i, i + step) for i in range(0, count, step)]


def book_volatility(reach_ms: int, window_ms: int, least: int = 6, most: int | None = None) -> tuple[Measure, str]:
    """Realised volatility and log range of microprices in (newest - window, newest].

    ``most`` thins longer windows to so many evenly spaced ticks, both ends included. Column micro.
    """

    def measure(rows: Rows, at: np.ndarray) -> dict[str, np.ndarray]:
        lo, hi = rows.window(at, reach_ms)
        newest = np.where(hi > lo, rows.ts[np.maximum(hi - 1, 0)], at)
        good = rows.part(rows["micro"] > 0)
        if not len(good):
            return {}
        lo, hi = np.maximum(good.upto(at - reach_ms), good.upto(newest - window_ms)), good.upto(at)
        hi = np.maximum(hi, lo)
        n = hi - lo
        logs = np.log(good["micro"])
        rv, high, low = np.full(len(at), np.nan), np.full(len(at), np.nan), np.full(len(at), np.nan)
        if most is None:
            moves = np.concatenate([[0.0], np.diff(logs)])
            first, squares = good.sums(moves), good.sums(moves * moves)
            k = np.maximum(n - 1, 1)
            begin = np.minimum(lo + 1, hi)
            mean = first(begin, hi) / k
            rv = np.sqrt(np.maximum(squares(begin, hi) / k - mean * mean, 0)) * np.sqrt(k)
            high, low = good.extremes(logs, np.fmax)(lo, hi), good.extremes(logs, np.fmin)(lo, hi)
        else:
            for s in sliced(len(at), most):
                places, valid = evenly(lo[s], hi[s], most)
                x = np.where(valid, logs[np.minimum(places, len(logs) - 1)], np.nan)
                moves = np.diff(x, axis=1)
                k = np.maximum((~np.isnan(moves)).sum(1), 1)
                mean = np.nansum(moves, axis=1) / k
                rv[s] = np.sqrt(np.nansum((moves - mean[:, None]) ** 2, axis=1) / k) * np.sqrt(k)
                high[s], low[s] = np.fmax.reduce(x, axis=1), np.fmin.reduce(x, axis=1)
            n = np.minimum(n, most)
        return {"n": n, "rv": rv, "rng": high - low, "there": n >= max(least, 1)}

    return measure, "n long, rv double, rng double"


def horizon_pairs(reach_ms: int, horizon_ms: int, gap_ms: int, most: int, least_ticks: int, least_pairs: int, levels: list[float]) -> tuple[Measure, str]:
    """Moves of the microprice over the horizon within each window, and their centred quantiles.

    Of a window's n ticks every ceil(n / most)-th starts a pair with the window's last tick at most
    ``horizon_ms`` later; it counts if that is another row, ``gap_ms`` later or more. Prompts with fewer than
    ``least_ticks`` ticks or ``least_pairs`` pairs have none. ``q`` are linear quantiles less the median. Column micro.
    """
    grid = np.array(levels)

    def measure(rows: Rows, at: np.ndarray) -> dict[str, np.ndarray]:
        lo, hi = rows.window(at, reach_ms)
        n = hi - lo
        step = np.maximum(-(-n // most), 1)
        pairs, total, there = np.zeros(len(at), np.int64), np.zeros(len(at)), np.zeros(len(at), bool)
        quantiles: list = [None] * len(at)
        for s in sliced(len(at), most):
            start = lo[s][:, None] + np.arange(most) * step[s][:, None]
            inside = start < hi[s][:, None]
            start = np.where(inside, start, 0)
            end = np.minimum(np.searchsorted(rows.ts, rows.ts[start] + horizon_ms, side="right"), hi[s][:, None]) - 1
            end = np.maximum(end, 0)
            ok = inside & (end > start) & (rows.ts[end] - rows.ts[start] >= gap_ms)
            moves = np.where(ok, rows["micro"][end] - rows["micro"][start], np.nan)
            moves.sort(axis=1)  # what is no number goes last
            pairs[s] = ok.sum(1)
            total[s] = np.nansum(moves, axis=1)
            there[s] = (n[s] >= least_ticks) & (pairs[s] >= least_pairs)
            for i in np.flatnonzero(there[s]):
                m = moves[i, : pairs[s][i]]
                quantiles[s.start + i] = _quantiles(m, grid) - _quantiles(m, np.array([0.5]))
        return {"n_ticks": n, "n_pairs": pairs, "total": total, "q": np.array([*quantiles, None], object)[:-1], "there": there}

    return measure, "n_ticks long, n_pairs long, total double, q array<double>"


def _quantiles(ordered: np.ndarray, levels: np.ndarray) -> np.ndarray:
    at = levels * (len(ordered) - 1)
    below = at.astype(np.int64)
    part = at - below
    return ordered[below] * (1 - part) + ordered[np.minimum(below + 1, len(ordered) - 1)] * part


def recent_ofi(reach_ms: int, recent_ms: int, least: int, least_recent: int) -> tuple[Measure, str]:
    """Net over gross order flow of the latest events. Columns ofi, gross."""

    def measure(rows: Rows, at: np.ndarray) -> dict[str, np.ndarray]:
        lo, hi = rows.window(at, reach_ms)
        since = np.searchsorted(rows.ts, rows.ts[np.maximum(hi - 1, 0)] - recent_ms, side="left")
        since = np.minimum(np.maximum(since, lo + 1), np.maximum(hi, lo))  # the window's first quote has none before it
        net, gross = rows.sums(rows["ofi"])(since, np.maximum(hi, since)), rows.sums(rows["gross"])(since, np.maximum(hi, since))
        enough = (hi - lo >= least) & (hi - since + 1 >= least_recent)
        value = np.where(enough, np.divide(net, gross, out=np.zeros(len(at)), where=gross > 0), 0.0)
        return {"n": hi - lo, "n_recent": hi - since, "net": net, "gross": gross, "value": value, "there": hi > lo}

    return measure, "n long, n_recent long, net double, gross double, value double"


def snapshots(reach_ms: int, back_ms: int) -> tuple[Measure, str]:
    """Instants and ``seq`` of the last row of each window, and of the one nearest to ``back_ms`` before the prompt (ties to
    the earlier, then to the smaller ``seq``), with its distance. Column seq."""

    def measure(rows: Rows, at: np.ndarray) -> dict[str, np.ndarray]:
        lo, hi = rows.window(at, reach_ms)
        there = hi > lo
        wanted, most = at - back_ms, len(rows) - 1
        after = np.clip(rows.upto(wanted), lo, np.maximum(hi, lo))
        before = np.searchsorted(rows.ts, rows.ts[np.clip(after - 1, 0, most)], side="left")  # the first of its instant
        off = lambda place: np.abs(rows.ts[np.clip(place, 0, most)] - wanted)
        earlier = (after > lo) & ((after >= hi) | (off(before) <= off(after)))
        start, latest = np.clip(np.where(earlier, before, after), 0, most), np.clip(hi - 1, 0, most)
        return {"latest_at": rows.ts[latest], "latest_seq": rows["seq"][latest], "start_at": rows.ts[start], "start_seq": rows["seq"][start], "off": off(start), "there": there}

    return measure, "latest_at long, latest_seq long, start_at long, start_seq long, off long"


def recent_average(reach: tuple[int, int], decays: dict[str, tuple[int, float]]) -> tuple[Measure, str]:
    """Root of the weighted mean square of ``ret`` over so many bars, with weights decay^age in bars; ``reach`` is (bars, bar_ms).

    Column ret, by the bar's end. Windows of few hundred to few thousand bars are gathered by place.
    """
    bars, bar_ms = reach

    def measure(rows: Rows, at: np.ndarray) -> dict[str, np.ndarray]:
        lo, hi = rows.window(at, bars * bar_ms)
        out = {n: np.full(len(at), np.nan) for n in decays}
        for s in sliced(len(at), bars):
            place = hi[s][:, None] - 1 - np.arange(bars)
            valid = place >= lo[s][:, None]
            place = np.where(valid, place, 0)
            age = (at[s][:, None] - rows.ts[place]) // bar_ms
            square = rows["ret"][place] ** 2
            for name, (n, decay) in decays.items():
                weight = np.where(valid & (age < n), decay ** np.minimum(age, n).astype(float), 0.0)
                whole = weight.sum(1)
                out[name][s] = np.sqrt(np.divide((weight * square).sum(1), whole, out=np.full(len(whole), np.nan), where=whole > 0))
        return out | {"there": hi > lo}

    return measure, ", ".join(f"{n} double" for n in decays)


def slice_means(values: np.ndarray, weights: np.ndarray, bins: int) -> np.ndarray:
    """A15 for rows: means of the equal slices of weight of each row's sorted values, never falling; weight 0 is absent."""
    order = np.argsort(np.where(weights > 0, values, np.inf), axis=1)
    v, w = np.take_along_axis(np.nan_to_num(values), order, 1), np.take_along_axis(weights, order, 1)
    whole = w.sum(1, keepdims=True)
    out = np.zeros((len(v), bins))
    for i in np.flatnonzero(whole[:, 0] > 0):
        edge, area = np.concatenate([[0.0], np.cumsum(w[i]) / whole[i]]), np.concatenate([[0.0], np.cumsum(v[i] * w[i]) / whole[i]])
        out[i] = np.maximum.accumulate(np.diff(np.interp(np.linspace(0, 1, bins + 1), edge, area)) * bins)
    return np.maximum(out, 0.0)


def hour_parts(bars: int, bar_ms: int, *, step: int, short: int, half: int, quick: int, bins: int, decay: float, least: int = 20, jump: float = 0.99, eps: float = 1e-6) -> tuple[Measure, str]:
    """What the closes of a prompt's trailing ``bars`` say: A12, A13, A15, A16, W10 and W11 at once.

    Of moves over ``step`` bars: ``mad`` their mean distance from the median in logs, ``ewma`` the weighted mean size,
    ``jump_ratio`` the ``jump`` quantile over the median of the sizes in price (1e9 without 50 closes or a median); of the last
    ``half`` sizes in logs the means of ``bins`` slices of recency weight, ``p90`` and ``activity`` (the last ``quick`` against all).
    ``rv`` is the deviation of the last ``short`` single returns over root of ``step`` bars, ``rng`` the log range of the last
    ``step`` closes. Null where the closes are too few. Column close, by the bar's end.
    """
    names = ("mad", "ewma", "jump_ratio", "rv", "rng", "p90", "activity")

    def measure(rows: Rows, at: np.ndarray) -> dict[str, np.ndarray]:
        lo, hi = rows.window(at, bars * bar_ms)
        out = {n: np.full(len(at), np.nan) for n in names}
        slices: list = [None] * len(at)
        logs = np.log(np.where(rows["close"] > 0, rows["close"], np.nan))
        for i in np.flatnonzero(hi - lo > step):
            c, x = rows["close"][lo[i] : hi[i]], logs[lo[i] : hi[i]]
            moves, n = x[step:] - x[:-step], hi[i] - lo[i]
            sizes = np.abs(moves)
            weight = decay ** np.arange(len(sizes))[::-1].astype(float)
            out["mad"][i] = np.abs(moves - np.median(moves)).mean()
            out["ewma"][i] = (weight * sizes).sum() / weight.sum()
            out["rng"][i] = np.log(c[-step:].max() / c[-step:].min())
            if n > short:
                out["rv"][i] = np.diff(x[-short - 1 :]).std() * np.sqrt(step)
            steps = np.abs(c[step:] - c[:-step])
            typical = np.median(steps)
            out["jump_ratio"][i] = np.quantile(steps, jump) / typical if n >= 50 and typical > 1e-6 else 1e9
            if n >= step + least:
                last = sizes[-half:]
                slices[i] = slice_means(last[None, :], np.arange(1.0, len(last) + 1)[None, :], bins)[0]
                out["p90"][i] = np.quantile(last, 0.9)
                out["activity"][i] = np.log((eps + last[-quick:].mean()) / (eps + last.mean())) if len(last) >= quick else 0.0
        return out | {"n_closes": hi - lo, "bins": np.array([*slices, None], object)[:-1], "there": hi > lo}

    return measure, ", ".join(f"{n} double" for n in names) + ", n_closes long, bins array<double>"
