"""Labels, CRPS, field scores, leaderboards and reports."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import ladders as L
from tidemark.functions import quotes as Q
from tidemark.operators.asof import asof_join
from tidemark.operators.quantiles import exclusive_percentile, quantiles
from tidemark.scratch import written


def label_quotes(prompts: DataFrame, quotes: DataFrame, *, keys: list[str], horizon_ms: int, chunk_ms: int) -> DataFrame:
    """Prompts with ``label``: the last quote in (now, now + horizon], or null."""
    asked = prompts.withColumn("target_ms", F.col("current_time_ms") + horizon_ms)
    return asof_join(asked, quotes, keys=keys, left_ts="target_ms", right_ts="recv_ts_ms", seq="seq", chunk_ms=chunk_ms, after="current_time_ms", name="label")


def realized(label: str, target: str, *, live_ms: int) -> Column:
    """Microprice of a label quote that is live at the target and valid; else null."""
    row = F.col(label)
    parts = [row[c] for c in ("bid_price", "bid_qty", "ask_price", "ask_qty")]
    live = (row["recv_ts_ms"] <= F.col(target)) & (F.col(target) - row["recv_ts_ms"] <= live_ms)
    return F.when(live & Q.valid_quote(*parts), Q.microprice(*parts))


def scored(answers: DataFrame, labels: DataFrame) -> DataFrame:
    """Answers of scored prompts, their ladder ``q`` replaced by ``answered`` and ``crps`` (null for a non-answer).

    A ladder is 100 numbers, which interpreted lambdas walk slowly: batches of rows are judged and
    scored as matrices. The rules are those of ``ladders.violations``.
    """
    joined = answers.join(labels.filter("realized is not null").select("asset", "current_time_ms", "realized"), ["asset", "current_time_ms"])
    kept = [f for f in joined.schema if f.name != "q"]
    grid = np.array(L.GRID)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("q")
            whole = np.flatnonzero((lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == L.N))
            x = lists.take(pa.array(whole)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, L.N)
            good = np.isfinite(x).all(1)
            good[good] = (x[good] > 0).all(1) & (np.diff(x[good], axis=1) >= 0).all(1)
            off = batch.column("realized").to_numpy(zero_copy_only=False)[whole[good], None] - x[good]
            answered, crps = np.zeros(batch.num_rows, bool), np.full(batch.num_rows, np.nan)
            answered[whole[good]] = True
            crps[whole[good]] = (off * (grid - (off < 0))).sum(1) * (2 / L.N)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(answered), pa.array(crps, mask=~answered)], [*[f.name for f in kept], "answered", "crps"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return joined.mapInArrow(score, f"{schema}, answered boolean, crps double")


def field_scores(scores: DataFrame) -> DataFrame:
    """Non-answers charged the 95th percentile of a prompt's answers; the prompt's best subtracted.

    Prompts that nobody answered are dropped.
    """
    w = Window.partitionBy("asset", "current_time_ms")
    charged = F.coalesce("crps", F.percentile("crps", F.lit(0.95)).over(w))
    out = scores.withColumn("charged", charged).filter("charged is not null")
    return out.withColumn("field_score", F.col("charged") - F.min("charged").over(w)).drop("charged")


def prompt_model_grid(prompts: DataFrame, models: DataFrame, answers: DataFrame) -> DataFrame:
    """Every model beside every prompt; missing answers stay as null.

    Models are a short list of a task's own, repeated for each prompt by an array.
    """
    names = models.agg(F.sort_array(F.collect_set("model")).alias("models"))
    grid = prompts.join(F.broadcast(names), F.lit(True)).select(*prompts.columns, F.explode("models").alias("model"))
    return grid.join(answers, ["asset", "current_time_ms", "model"], "left")


def eligible(scores: DataFrame) -> DataFrame:
    """Rows of models that answered at least once for the asset."""
    return scores.join(scores.filter("answered").select("asset", "model").distinct(), ["asset", "model"], "left_semi")


def leaderboard(field: DataFrame) -> DataFrame:
    """Mean field score and rank within the asset, of the models that answered there at least once.

    A model that never answered is charged what others' answers say and changes none of them, so
    it can be left out here, in the same aggregation.
    """
    mean = field.groupBy("asset", "model").agg(F.avg("field_score").alias("score"), F.count(F.lit(1)).alias("n_prompts"), F.max("answered").alias("any")).filter("any").drop("any")
    return mean.withColumn("rank", F.rank().over(Window.partitionBy("asset").orderBy(F.round("score", 9))))


def reward_split(board: DataFrame, *, pool: float, shares: tuple[float, ...]) -> DataFrame:
    """The pool in equal parts for the assets, each part by rank; ``board`` has a row per asset and model."""
    n = F.size(F.collect_set("asset").over(Window.partitionBy()))
    share = F.coalesce(F.get(F.array(*map(F.lit, shares)), F.col("rank") - 1), F.lit(0.0))
    return board.withColumn("reward", share * pool / n)


def rank_models(prompts: DataFrame, models: DataFrame, answers: DataFrame, labels: DataFrame, *, pool: float, shares: tuple[float, ...]) -> DataFrame:
    """The whole ranking in one lineage: ``asset, model, score, n_prompts, rank, reward``.

    Every model is beside every prompt, its answer is judged and scored, non-answers are charged, the prompt's best
    is subtracted, and models that answered an asset at least once are ranked and paid within it. Prompts move once
    for the models' grid, scores once by prompt and once by model.
    """
    grid = prompt_model_grid(prompts.select("asset", "current_time_ms"), models, answers)
    return reward_split(leaderboard(field_scores(scored(grid, labels))), pool=pool, shares=shares)


def run_summary(scores: DataFrame, *, by: list[str]) -> DataFrame:
    """Counts and CRPS statistics of all prompts and of those scored."""
    s = written(scores.select(*by, "current_time_ms", "crps"), "scores")
    n = F.count("crps")
    sums = s.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), n.alias("n_scored"), (F.count(F.lit(1)) - n).alias("n_dropped"), F.avg("crps").alias("crps_mean"), F.min("crps").alias("crps_min"), F.max("crps").alias("crps_max"), F.min("current_time_ms").alias("first_ms"), F.max("current_time_ms").alias("last_ms"))
    median = quantiles(s, by=by, value="crps", levels=[0.5]).select(*[F.col(c).alias(f"__{c}") for c in by], F.get("q", F.lit(0)).alias("crps_median"))
    same = [sums[c].eqNullSafe(median[f"__{c}"]) for c in by]
    return sums.join(median, same, "left").select(*by, "n", "n_scored", "n_dropped", "crps_mean", "crps_median", "crps_min", "crps_max", "first_ms", "last_ms")


def run_report(runs: DataFrame, *, by: list[str], budget_ms: float) -> DataFrame:
    """``run_summary`` of the readable rows, with ``n_unreadable`` and the latencies against the budget.

    ``runs`` has ``readable`` and ``latency_ms`` beside a score's columns. The 95th percentile is
    the exclusive one; ``within_budget`` is that the median keeps to the budget. A group without
    a readable row gives only its count.
    """
    runs = written(runs.select(*by, "current_time_ms", "crps", "readable", "latency_ms"), "runs")
    good = runs.filter("readable")
    p95 = exclusive_percentile(good, by=by, value="latency_ms", p=0.95).select(*by, F.col("percentile").alias("p95_ms"))
    median = quantiles(good, by=by, value="latency_ms", levels=[0.5]).select(*by, F.get("q", F.lit(0)).alias("median_ms"), (F.get("q", F.lit(0)) <= budget_ms).alias("within_budget"))
    most = good.groupBy(*by).agg(F.max("latency_ms").alias("max_ms"))
    out = runs.groupBy(*by).agg(F.count_if(~F.coalesce("readable", F.lit(False))).alias("n_unreadable"))
    for part in (run_summary(good, by=by), median, most, p95):
        out = out.join(part, by, "left")
    return out


def rolling_crps(scores: DataFrame, *, by: list[str], window_ms: int, step_ms: int, least: int) -> DataFrame:
    """Mean CRPS in windows stepped through time; each row goes to the windows that hold it."""
    first = (F.floor(F.col("current_time_ms") / step_ms) - (window_ms // step_ms - 1)) * step_ms
    start = F.explode(F.sequence(first.cast("long"), (F.floor(F.col("current_time_ms") / step_ms) * step_ms).cast("long"), F.lit(step_ms).cast("long")))
    small = scores.filter("crps is not null").select(*by, "current_time_ms", "crps")
    return small.withColumn("window_ms", start).groupBy(*by, "window_ms").agg(F.count(F.lit(1)).alias("n"), F.avg("crps").alias("crps_mean")).filter(F.col("n") >= least)


def split_eval(scores: DataFrame, *, split_ms: int) -> DataFrame:
    """Before and after the split, by asset and in total."""
    side = F.when(F.col("current_time_ms") < split_ms, "fit").otherwise("held")
    return scores.filter("crps is not null").withColumn("split", side).rollup("split", "asset").agg(F.count(F.lit(1)).alias("n"), F.avg("crps").alias("crps_mean"))


def trigger_mix(prompts: DataFrame) -> DataFrame:
    per = prompts.groupBy("asset", "kind").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("asset")))


def near_identical_models(answers: DataFrame, *, most: float) -> DataFrame:
    """Pairs of models whose ladders differ by little on their shared prompts, by mean |dq| over width."""
    a = answers.select("asset", "current_time_ms", F.col("model").alias("a"), F.col("q").alias("qa"))
    b = answers.select("asset", "current_time_ms", F.col("model").alias("b"), F.col("q").alias("qb"))
    both = a.join(b, ["asset", "current_time_ms"]).filter("a < b and qa is not null and qb is not null")
    gap = F.aggregate(F.zip_with("qa", "qb", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, v: s + v) / L.N
    d = gap / (0.5 * (L.width(F.col("qa")) + L.width(F.col("qb"))))
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("distance")).filter(F.col("distance") <= most)


def extremes(scores: DataFrame, *, n: int) -> DataFrame:
    """The best and the worst ``n`` prompts of each asset and model."""
    good = scores.filter("crps is not null")
    out = []
    for name, order in (("best", F.col("crps").asc()), ("worst", F.col("crps").desc())):
        w = Window.partitionBy("asset", "model").orderBy(order, "current_time_ms")
        out.append(good.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n).withColumn("end", F.lit(name)))
    return out[0].union(out[1])
