"""Forecasts in batch: a feature table to ladders, with user models beside the library's own."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import ladders as L
from tidemark.functions import quotes as Q


def linear(columns: dict[str, float], bias: float = 0.0) -> Column:
    """Weighted sum of feature columns; missing ones count 0."""
    total = F.lit(float(bias))
    for name, w in columns.items():
        total = total + F.coalesce(F.col(name), F.lit(0.0)) * F.lit(float(w))
    return total


def regime_width(width: Column, recent: Column, *, a: float = 0.62, b: float = 0.38) -> Column:
    """Shrinks a width that is wide of recent moves: times clip(a + b * recent / width, a, 1)."""
    usable = (width > 0) & (recent > 0)
    return F.when(usable, width * Q.clip(a + b * recent / width, a, 1.0)).otherwise(width)


def blended_width(width: Column, realized: Column, *, power: float = 0.8) -> Column:
    """Raises a width that is tighter than recent moves towards them; a wider one stays."""
    return F.when((width > 0) & (realized > width), width * F.pow(realized / width, F.lit(power))).otherwise(width)


def liquidation_width(width: Column, activity: Column, *, gain: float) -> Column:
    """Widens by the activity of liquidations."""
    return width * (1 + gain * F.greatest(activity, F.lit(0.0)))


def flexed(shift: Column, width: Column, recent: Column, *, pull: float, excess: float, floor: float, power: float, narrowest: float, fade: tuple[float, float]) -> tuple[Column, Column]:
    """Shift and width after the latest moves (``recent``, their scale): a shift far beyond its width is pulled
    in, the more the calmer it is, and a width above the recent scale shrinks towards it."""
    ratio = recent / width
    usable = (width > 0) & (recent > 0)
    beyond = F.greatest(F.abs(shift) / width - excess, F.lit(0.0))
    gain = Q.clip(1 - pull * beyond / Q.clip(ratio, *fade), floor, 1.0)
    return F.when(usable, shift * gain).otherwise(shift), F.when(usable, width * Q.clip(F.pow(ratio, F.lit(power)), narrowest, 1.0)).otherwise(width)


def season_width(width: Column, typical: Column, *, weight: float, most: float) -> Column:
    """Draws a width towards the slot's typical one, in logarithms, by at most ``most``."""
    pull = Q.clip(weight * (F.ln(typical) - F.ln(width)), -most, most)
    return F.when((width > 0) & (typical > 0), width * F.exp(pull)).otherwise(width)


def candle_weight(p90: Column, activity: Column, kind: Column, *, pivot: float, scale: float, beta: float, span: Column | float = 1.0) -> Column:
    """Share of the candles' distribution on a clock prompt, falling with its 90th percentile and activity; 0 on others.

    Saturated at 20 either way: 0 above, 1 below.
    """
    by = F.lit(float(span)) if isinstance(span, (int, float)) else span
    z = (p90 - pivot * by) / (scale * by) + beta * activity
    share = F.when(z >= 20, 0.0).when(z <= -20, 1.0).otherwise(1 / (1 + F.exp(z)))
    return F.when((kind == "time") & p90.isNotNull() & ~F.isnan(p90), share).otherwise(0.0)


def layer_terms(signals: DataFrame, terms: DataFrame, *, keys: list[str], most: float = 1.5) -> DataFrame:
    """``keys, shift, scale``: what a table of terms makes of long signals.

    ``signals`` has ``keys, signal, value``; ``terms`` has ``signal, kind, centre, spread, op, coef``,
    a row each, few of them. A term's value is its signal's robust z (``kind`` as in
    ``quotes.robust_z``); ``shift`` sums coefficients times values, ``scale`` is exp of that sum for
    the other terms, held within ``most``. Keys without any term's signal get none.
    """
    j = signals.join(F.broadcast(terms), "signal")  # a model's table, some dozens of rows
    z = F.when(F.col("kind") == "raw", Q.robust_z(F.col("value"), F.col("centre"), F.col("spread"), kind="raw")).when(F.col("kind") == "log1p", Q.robust_z(F.col("value"), F.col("centre"), F.col("spread"), kind="log1p")).otherwise(Q.robust_z(F.col("value"), F.col("centre"), F.col("spread")))
    part = lambda op: F.coalesce(F.sum(F.when(F.col("op") == op, F.col("coef") * z)), F.lit(0.0))
    return j.groupBy(*keys).agg(part("shift").alias("shift"), F.exp(Q.clip(part("scale"), -most, most)).alias("scale"))


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that the optimizer doesn't fold into later ones: Spark fails on a Python
    function of nested lambdas ("Cannot evaluate expression"), not on one of a column."""
    return df.withColumn("__c", F.explode(F.array(value))).drop(name).withColumnRenamed("__c", name)


def forecast_batch(features: DataFrame, *, shift: Column, width: Column, steps: Sequence[Callable[[Column], Column]] = (), still: Column | None = None, fallback: float = 0.01) -> DataFrame:
    """``features`` with ``q``: the Laplace ladder about the price, taken through ``steps`` in turn, an atom at the price if asked for.

    A row without a usable price, shift or width gets a wide ladder about the price (or 1), never
    null, and sees no steps.
    """
    price = F.when((F.col("price") > 0) & (F.col("price") < float("inf")), F.col("price")).otherwise(1.0)
    good = width.isNotNull() & ~F.isnan(width) & (width > 0) & shift.isNotNull() & ~F.isnan(shift)
    base = computed(features, "q", L.ladder(price, F.when(good, shift).otherwise(0.0), F.when(good, width).otherwise(price * fallback), L.laplace_z()))
    for step in steps:
        base = computed(base, "q", F.when(good, step(F.col("q"))).otherwise(F.col("q")))
    if still is not None:
        base = base.withColumn("q", L.with_point_mass(F.col("q"), price, F.coalesce(still, F.lit(0.0))))
    return base.withColumn("q", L.sanitized(F.col("q")))


def score_with(features: DataFrame, model: Callable[[pd.DataFrame], np.ndarray], *, keys: list[str]) -> DataFrame:
    """``keys, q, codes``: a user model on Arrow batches of feature rows.

    ``model`` takes a pandas frame and returns a row of 100 prices for each of its rows. Where it
    fails, or a ladder breaks a rule, the answer is null and ``codes`` says why.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            try:
                q = np.asarray(model(batch.to_pandas()), float).reshape(batch.num_rows, L.N)
                ladders = pa.array(list(q), pa.list_(pa.float64()))
            except Exception:  # a model's failure is a non-answer
                ladders = pa.nulls(batch.num_rows, pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], ladders], [*keys, "q"])

    schema = ", ".join(f"{k} {features.schema[k].dataType.simpleString()}" for k in keys)
    out = features.mapInArrow(run, f"{schema}, q array<double>").withColumn("codes", L.violations(F.col("q")))
    return out.withColumn("q", F.when(F.size("codes") == 0, F.col("q")))


def weighted_bin_means(moves: DataFrame, *, keys: list[str], value: str, age: str, bins: int = 50) -> DataFrame:
    """Mean of each equal slice of weight of the sorted values, newer ones weighing more, never falling.

    Weights fall linearly with ``age`` (0 newest). A value that lies across slices counts in each
    by the part of its weight there.
    """

    def means(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(value, kind="stable")
        w = pdf[age].max() - pdf[age].to_numpy() + 1.0
        v, edge = pdf[value].to_numpy(), np.concatenate([[0.0], np.cumsum(w / w.sum())])
        cut = np.linspace(0, 1, bins + 1)
        total = np.interp(cut, edge, np.concatenate([[0.0], np.cumsum(v * w / w.sum())]))
        out = pd.DataFrame({k: [pdf[k].iloc[0]] * bins for k in keys})
        out["bin"], out["mean"] = np.arange(bins), np.maximum.accumulate(np.diff(total) * bins)
        return out

    schema = ", ".join(f"{k} {moves.schema[k].dataType.simpleString()}" for k in keys)
    return moves.filter(F.col(value).isNotNull()).groupBy(*keys).applyInPandas(means, f"{schema}, bin int, mean double")
