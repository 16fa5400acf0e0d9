"""Quality scores by a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import code_bytes, map_texts, written
from tidemark.llm.langid import held_out

#: Kinds of bytes: capital, small letter, digit, blank, line feed, other ASCII, stop or comma, beyond ASCII.
CAPITAL, SMALL, DIGIT, BLANK, FEED, SIGN, STOP, WIDE = range(8)
KIND = np.array([CAPITAL if 65 <= b <= 90 else SMALL if 97 <= b <= 122 else DIGIT if 48 <= b <= 57 else FEED if b == 10 else BLANK if b in b" \t\x0b\x0c\r" else STOP if b in b".," else WIDE if b >= 128 else SIGN for b in range(256)])
LETTERS = bytes(b for b in range(256) if KIND[b] in (CAPITAL, SMALL, WIDE))
#: Bytes of a text that are split into words at once.
SLICE = 1_000_000
#: Statistics are whole multiples of 1 / UNIT, so that sums of their products are exact in any order.
UNIT = 1024
#: What is tried on the rows kept for calibration: part of the common covariance, part of its diagonal, and scale of the log-odds.
COMMON, DIAGONAL, SCALES = (0.1, 0.3, 0.6, 0.9), (0.01, 0.1), (1.0, 0.5, 0.25, 0.1)


def _odds(k: float, n: float) -> float:
    """Log-odds of a share, smoothed by half a count a side."""
    return math.log((k + 0.5) / (n - k + 0.5))


def _slices(raw: bytes) -> Iterator[bytes]:
    """A text in stretches of about ``SLICE`` bytes that end at a blank, if there is one."""
    at = 0
    while at < len(raw):
        end = at + SLICE
        if end < len(raw):
            end = max(raw.rfind(b" ", at, end), raw.rfind(b"\n", at, end)) + 1 or end
        yield raw[at:end]
        at = end


def statistics(raw: bytes) -> list[float]:
    """Transformed statistics of a whole text: logs of sizes, log-odds of shares."""
    kinds, words = np.zeros(256, np.int64), Counter()
    for part in _slices(raw):
        kinds += np.bincount(np.frombuffer(part, np.uint8), minlength=256)
        words.update(part.split())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    size, (capital, small, digit, blank, _, sign, stop, wide) = len(raw), np.bincount(KIND, kinds, 8).tolist()
    n, repeated = sum(words.values()), len(lines) - len(set(lines))
    length = np.array([len(w) for w in words] or [0], float)
    often = np.array(list(words.values()) or [1], float)
    mean = (often @ length) / often.sum()
    spread = math.sqrt(max((often @ length**2) / often.sum() - mean**2, 0.0))
    p = kinds[kinds > 0] / max(size, 1)
    shouted = sum(c for w, c in words.items() if len(w) > 1 and w.isupper())
    begun = sum(c for w, c in words.items() if KIND[w[0]] == CAPITAL)
    bare = sum(c for w, c in words.items() if len(w.translate(None, LETTERS)) == len(w))
    return [
        math.log1p(n),
        math.log1p(len(lines)),
        math.log((size + 1) / (n + 1)),
        math.log((n + 1) / (len(lines) + 1)),
        math.log1p(spread),
        float(-(p @ np.log2(p))) if size else 0.0,
        _odds(capital, capital + small + wide),
        _odds(digit, size),
        _odds(sign, size),
        _odds(stop, size),
        _odds(wide, size),
        _odds(blank, size),
        _odds(len(words), n),
        _odds(max(words.values(), default=0), n),
        _odds(repeated, len(lines)),
        _odds(shouted, n),
        _odds(begun, n),
        _odds(bare, n),
    ]


WIDTH = len(statistics(b""))


def described(docs: DataFrame, *, key: str, text: str) -> DataFrame:
    """``key, x`` for every row: the text's statistics in whole multiples of 1 / ``UNIT``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(raw or b"") for raw in code_bytes(batch, "text")]).reshape(-1, WIDTH)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * WIDTH, pa.int32()), pa.array(np.rint(x * UNIT).astype(np.int32).ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), lists], ["key", "x"])

    kind = docs.schema[key].dataType.simpleString()
    return map_texts(docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")), run, f"key {kind}, x array<int>")


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    return batch.column(name).flatten().to_numpy().reshape(-1, WIDTH).astype(np.int64)


def moments(rows: DataFrame) -> dict[tuple[bool, int], tuple[int, np.ndarray, np.ndarray]]:
    """Of ``rows`` (columns kept, label, x): count, sums and sums of products by kept and label, exact.

    Tasks sum whole numbers; what reaches the driver is one row a sum, whatever the number of rows.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, kept, label = _matrix(batch), batch.column("kept").to_numpy(zero_copy_only=False), batch.column("label").to_numpy()
            for k in (False, True):
                for y in (0, 1):
                    mine = x[(kept == k) & (label == y)]
                    if len(mine):
                        flat = np.concatenate([[len(mine)], mine.sum(0), (mine.T @ mine).ravel()])
                        yield pa.RecordBatch.from_arrays([pa.array([k] * len(flat)), pa.array([y] * len(flat), pa.int32()), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["kept", "label", "at", "sum"])

    parts = rows.mapInArrow(sums, "kept boolean, label int, at int, sum long")
    found: dict[tuple[bool, int], dict[int, int]] = {}
    for kept, label, at, total in parts.groupBy("kept", "label", "at").agg(F.sum(F.col("sum").cast("decimal(38,0)"))).collect():
        found.setdefault((kept, label), {})[at] = int(total)
    flat = {which: np.array([sums[i] for i in range(1 + WIDTH + WIDTH**2)], object) for which, sums in found.items()}
    return {which: (int(f[0]), f[1 : 1 + WIDTH], f[1 + WIDTH :].reshape(WIDTH, WIDTH)) for which, f in flat.items()}


@dataclass
class Discriminant:
    """Two classes' means, inverse Cholesky factors and constants; or, without both classes, one fixed score."""

    means: np.ndarray
    factors: np.ndarray
    constants: np.ndarray
    scale: float = 1.0
    fixed: float | None = None

    @classmethod
    def of(cls, sums: list[tuple[int, np.ndarray, np.ndarray]], common: float, diagonal: float) -> Discriminant:
        """From each class's exact sums: its covariance, drawn to the common one and that one's diagonal."""
        counts = [n for n, _, _ in sums]
        means = [(s / n).astype(float) / UNIT for n, s, _ in sums]
        covariances = [((n * ss - np.outer(s, s)) / (n * n * UNIT * UNIT)).astype(float) for n, s, ss in sums]
        pooled = sum(n * c for n, c in zip(counts, covariances, strict=True)) / sum(counts)
        axes = np.diag(np.diag(pooled) + 1e-6)
        factors, constants = [], []
        for n, c in zip(counts, covariances, strict=True):
            lower = np.linalg.cholesky((1 - diagonal) * ((1 - common) * c + common * pooled) + diagonal * axes)
            factors.append(np.linalg.inv(lower))
            constants.append(math.log(n / sum(counts)) - np.log(np.diag(lower)).sum())
        return cls(np.array(means), np.array(factors), np.array(constants))

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Of class 1 against 0: difference of log-densities and priors, by Mahalanobis distances."""
        x = x / UNIT
        logs = [c - 0.5 * np.square((x - m) @ f.T).sum(1) for m, f, c in zip(self.means, self.factors, self.constants, strict=True)]
        return logs[1] - logs[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(x), self.fixed)
        return np.round(1 / (1 + np.exp(-np.clip(self.scale * self.log_odds(x), -500, 500))), 9)


def _losses(rows: DataFrame, candidates: list[Discriminant]) -> list[int]:
    """Summed log-losses of the candidates over ``rows`` (label, x), in whole millionths."""
    sent = rows.sparkSession.sparkContext.broadcast(candidates)  # a handful of small matrices

    def loss(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = _matrix(batch), batch.column("label").to_numpy()
            for i, candidate in enumerate(sent.value):
                p = np.clip(candidate.scores(x), 1e-9, 1 - 1e-9)
                total = np.rint(-1e6 * np.log(np.where(y == 1, p, 1 - p))).astype(np.int64).sum()
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total], pa.int64())], ["i", "loss"])

    sums = dict(rows.select("label", "x").mapInArrow(loss, "i int, loss long").groupBy("i").agg(F.sum("loss")).collect())
    return [sums.get(i, 0) for i in range(len(candidates))]


def fitted(described: DataFrame, labels: DataFrame, *, label: str, label_key: str) -> Discriminant:
    """A discriminant from all rows with a label 0 or 1 whose key isn't held out.

    A fifth of those is kept apart to choose shrinkage and scale by their log-loss; the result is
    fitted on all of them. Null labels and keys teach nothing; a repeated label counts as often as
    it stands. With one class only, or none, every score is the share of class 1, or a half.
    """
    known = labels.filter(F.col(label).isin(0, 1)).select(F.col(label_key).alias("key"), F.col(label).cast("int").alias("label"))
    rows = described.filter(~held_out("key")).join(known, "key")
    kept = F.pmod(F.xxhash64(F.lit("calibrate"), F.col("key").cast("string")), F.lit(5)) == 0
    rows = written(rows.select(kept.alias("kept"), "label", "x"), "labelled")
    sums = moments(rows)

    def both(*kept: bool) -> list[tuple[int, np.ndarray, np.ndarray]]:
        parts = [[sums[k, y] for k in kept if (k, y) in sums] for y in (0, 1)]
        return [tuple(sum(x) for x in zip(*p, strict=True)) if p else (0, 0, 0) for p in parts]

    counts = [n for n, _, _ in both(False, True)]
    if min(counts) < 2:
        none = np.zeros(0)
        return Discriminant(none, none, none, fixed=counts[1] / sum(counts) if sum(counts) else 0.5)
    choice = (0.6, 0.1, 1.0)
    if min(n for n, _, _ in both(False)) >= 2 and any(k for k, _ in sums):
        tried = [(c, d, s) for c in COMMON for d in DIAGONAL for s in SCALES]
        models = [Discriminant.of(both(False), c, d) for c, d, _ in tried]
        for model, (_, _, s) in zip(models, tried, strict=True):
            model.scale = s
        losses = _losses(rows.filter("kept"), models)
        choice = tried[losses.index(min(losses))]
    model = Discriminant.of(both(False, True), *choice[:2])
    model.scale = choice[2]
    return model


def scored(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", label_key: str = "doc_id", cut: float = 0.3) -> DataFrame:
    """``key, held_out, score, predicted`` for every row: how likely its text has label 1.

    Each class is a Gaussian over ``statistics`` of whole texts; the score is the logistic of the
    difference of log-densities and priors. The model learns from labelled rows alone whose key
    isn't held out, and a row is scored by its text alone. Null texts count as empty and are
    scored as such; null keys are held out; repeated rows get equal scores. An empty table gives
    no rows; without labels every score is a half. Reruns agree: all sums are whole numbers.

    Texts are read once: their statistics go to a narrow table, from which the labelled rows are
    joined and all rows are scored, without a shuffle of texts.
    """
    features = written(described(docs, key=key, text=text), "statistics")
    sent = docs.sparkSession.sparkContext.broadcast(fitted(features, labels, label=label, label_key=label_key))  # two small matrices

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = sent.value.scores(_matrix(batch))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(p, pa.float64()), pa.array((p >= cut).astype(np.int32))], ["key", "score", "predicted"])

    kind = docs.schema[key].dataType.simpleString()
    out = features.mapInArrow(score, f"key {kind}, score double, predicted int").withColumnRenamed("key", key)
    return out.select(key, held_out(key).alias("held_out"), "score", "predicted")
