"""Language identification by interpolated Kneser-Ney character models."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import BLANK_CLASS, BLANKS, code_bytes, map_texts

ORDER = 5
#: Characters that could occur at all; what no model has seen shares this uniform floor.
ALPHABET = 4096
#: Letters, and numerals that are none (fractions, powers), which ``has_letter`` leaves out.
LETTER = re.compile(r"[^\W\d_]")
#: Bytes of words that a task remembers with their scores, and characters that it scores at once.
REMEMBERED_BYTES, AT_ONCE = 16_000_000, 50_000
#: Languages that share a table of n-grams.
ABREAST = 8
#: Languages whose counts may be broadcast; beyond, texts are joined with counts by a shuffle.
MOST_BROADCAST = 10_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _hashes(codes: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` characters of ``codes`` that end at each of ``ends``."""
    h = np.full(len(ends), n, np.uint64)
    for j in range(n):
        h = (h ^ codes[ends - n + 1 + j]) * _STEP
        h ^= h >> np.uint64(29)
    return h * _MIX


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def has_letter(text: str) -> bool:
    """Whether a text holds a character of Unicode's category L."""
    return any(m[0].isalpha() for m in LETTER.finditer(text))


def held_out(key: str) -> Column:
    """Rows kept apart from learning; a null key counts as empty text and so is held out."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


@dataclass
class Model:
    """One language: sorted hashes of its n-grams with log2 probabilities, and of contexts with log2 backoff weights."""

    grams: np.ndarray
    logp: np.ndarray
    contexts: np.ndarray
    backoff: np.ndarray
    floor: float


@dataclass
class Table:
    """A few languages' models side by side: one sorted array of hashes, a column of either number a language.

    ``logp`` is not a number where a language lacks the n-gram, ``backoff`` 0 where it lacks the context.
    """

    grams: np.ndarray
    logp: np.ndarray
    backoff: np.ndarray
    floor: np.ndarray

    @classmethod
    def of(cls, models: list[Model]) -> Table:
        grams = np.unique(np.concatenate([m.grams for m in models]))
        logp = np.full((len(grams) + 1, len(models)), np.nan, np.float32)  # the last row: in no language
        backoff = np.zeros((len(grams) + 1, len(models)), np.float32)
        for i, m in enumerate(models):
            logp[np.searchsorted(grams, m.grams), i] = m.logp
            backoff[np.searchsorted(grams, m.contexts), i] = m.backoff  # a context is an n-gram, too
        return cls(grams, logp, backoff, np.array([m.floor for m in models], np.float32))

    def rows(self, h: np.ndarray) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
        i[self.grams[i] != h] = len(self.grams)
        return i


@dataclass
class Models:
    """The languages by name, their tables (``ABREAST`` languages each), and each language's limit: a rate,
    and what a text of one character may exceed it by (of n characters, a part of one in the root of n)."""

    languages: list[str]
    tables: list[Table]
    limits: np.ndarray

    @classmethod
    def of(cls, found: list[tuple[str, Model]]) -> Models:
        models = [m for _, m in found]
        tables = [Table.of(models[i : i + ABREAST]) for i in range(0, len(models), ABREAST)]
        return cls([x for x, _ in found], tables, np.tile([np.inf, 0.0], (len(found), 1)))

    def _bits(self, text: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """log2 probability of each character of ``text``, a column per language; an array a table.

        ``at`` is each character's place in its word. The character is predicted by the longest n-gram
        that a language knows; for each order that it lacks, the weight of the context (the n-gram one
        place before) counts.
        """
        deep = [np.flatnonzero(at >= n - 1) for n in range(ORDER + 1)]
        hashes = [None, *[_hashes(text, deep[n], n) for n in range(1, ORDER + 1)]]
        out = []
        for t in self.tables:
            row = np.full((ORDER + 1, len(text)), len(t.grams), np.int64)
            for n in range(1, ORDER + 1):
                row[n, deep[n]] = t.rows(hashes[n])
            total, open_ = np.zeros((len(text), len(t.floor)), np.float32), np.repeat((at > 0)[:, None], len(t.floor), 1)
            for n in range(ORDER, 0, -1):  # a word's own space, at 0, is given and not predicted
                p = t.logp.take(row[n], axis=0)
                lacks = np.isnan(p)
                if n > 1:
                    np.copyto(p[1:], t.backoff.take(row[n - 1, :-1], axis=0), where=lacks[1:])
                    p[0] = 0
                else:
                    np.copyto(p, t.floor, where=lacks)
                p *= open_
                total += p
                open_ &= lacks
            out.append(total)
        return out

    def scores(self, words: list[str]) -> np.ndarray:
        """Summed log2 probability of each word and its end, a column per language."""
        text = _codes("".join(f" {w} " for w in words))
        lengths = np.array([len(w) + 2 for w in words], np.int64)
        begin = np.cumsum(lengths) - lengths
        at = np.arange(len(text)) - np.repeat(begin, lengths)
        return np.concatenate([np.add.reduceat(t, begin, axis=0, dtype=float) for t in self._bits(text, at)], axis=1)

    def long_score(self, word: str) -> np.ndarray:
        """``scores`` of one word of any length, in stretches that each see the ``ORDER`` - 1 characters before them."""
        text, total = _codes(f" {word} "), 0.0
        for begin in range(0, len(text), AT_ONCE):
            seen = max(0, begin - ORDER + 1)
            part = text[seen : begin + AT_ONCE]
            total = total + np.concatenate([t[begin - seen :].sum(0, dtype=float) for t in self._bits(part, np.arange(len(part)))])
        return total[None, :]


def training_rows(docs: DataFrame, *, key: str, text: str, lang: str, most: int) -> DataFrame:
    """A sample of about ``most`` labelled rows a language, chosen by a hash of the key."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(key))
    counts = known.groupBy(F.col(lang).alias("__lang")).agg(F.count(F.lit(1)).alias("__n"))
    few = counts.limit(MOST_BROADCAST + 1).collect()  # a row a language
    if few and len(few) <= MOST_BROADCAST:
        counts = F.broadcast(docs.sparkSession.createDataFrame(few, counts.schema))
    u = F.pmod(F.xxhash64(F.lit("sample"), F.col(key).cast("string")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return known.join(counts, known[lang] == counts["__lang"]).filter(u * F.col("__n") < most).select(F.col("__lang").alias("lang"), F.make_valid_utf8(F.col(text)).alias("text"), F.col(key).cast("string").alias("key"))


def gram_counts(rows: DataFrame) -> DataFrame:
    """``lang, n, gram, c``: counts of n-grams within words; below the highest order and the
    start of a word, the number of different characters before them (Kneser-Ney's counts)."""
    words = rows.select("lang", F.explode(F.split(F.lower("text"), BLANK_CLASS)).alias("word")).filter("word <> ''").groupBy("lang", "word").count()
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    spelled = words.select("lang", "count", padded.alias("p"), F.explode(F.sequence(F.lit(1), F.lit(ORDER))).alias("n")).filter("length(p) >= n")
    grams = spelled.select("lang", "n", "count", F.explode(F.expr("transform(sequence(1, length(p) - n + 1), i -> substring(p, i, n))")).alias("gram"))
    raw = grams.groupBy("lang", "n", "gram").agg(F.sum("count").alias("raw"))
    before = raw.filter("n > 1").groupBy("lang", (F.col("n") - 1).alias("n"), F.expr("substring(gram, 2)").alias("gram")).agg(F.count(F.lit(1)).alias("before"))
    both = raw.join(before, ["lang", "n", "gram"], "left")
    c = F.when((F.col("n") == ORDER) | ((F.col("n") > 1) & F.col("gram").startswith(" ")), F.col("raw")).otherwise(F.coalesce("before", F.lit(0)))
    return both.select("lang", "n", "gram", c.alias("c")).filter("c > 0")


def interpolated(grams: list[str], counts: np.ndarray) -> Model:
    """One language's model from its n-grams and Kneser-Ney counts, order by order.

    p(x | context) = max(c - D, 0) / total + D * kinds / total * p(x | shorter context), with one
    discount D an order from the numbers of grams seen once and twice; below the first order, 1 /
    ``ALPHABET``. Every gram's end is a gram of the order below, as whole words were counted.
    """
    lengths = np.array([len(g) for g in grams])
    hashes, logs, contexts, backoff = [], [], [], []
    lower_h = lower_p = None
    floor = -np.log2(ALPHABET)
    for n in range(1, ORDER + 1):
        at = np.flatnonzero(lengths == n)
        if not len(at):
            break
        codes, c = _codes("".join(grams[i] for i in at)), counts[at].astype(float)
        ends = np.arange(len(at)) * n + n - 1
        h = _hashes(codes, ends, n)
        order = np.argsort(h)
        h, c, ends = h[order], c[order], ends[order]
        ones, twos = int((c == 1).sum()), int((c == 2).sum())
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        if n == 1:
            weight = discount * len(c) / c.sum()
            p = np.maximum(c - discount, 0) / c.sum() + weight / ALPHABET
            floor += np.log2(weight)
        else:
            known, which = np.unique(_hashes(codes, ends - 1, n - 1), return_inverse=True)
            total = np.bincount(which, c)
            weight = discount * np.bincount(which) / total
            p = np.maximum(c - discount, 0) / total[which] + weight[which] * lower_p[np.searchsorted(lower_h, _hashes(codes, ends, n - 1))]
            contexts.append(known)
            backoff.append(np.log2(weight))
        lower_h, lower_p = h, p
        hashes.append(h)
        logs.append(np.log2(p))
    h, p = np.concatenate(hashes), np.concatenate(logs)
    order = np.argsort(h)
    ch, cw = (np.concatenate(x) if x else np.zeros(1, t) for x, t in ((contexts, np.uint64), (backoff, float)))
    corder = np.argsort(ch)
    return Model(h[order], p[order].astype(np.float32), ch[corder], cw[corder].astype(np.float32), float(floor))


def fitted(counts: DataFrame) -> list[tuple[str, Model]]:
    """The models of ``gram_counts``, each computed by a task of its own; the arrays alone reach the driver.

    A task holds the n-grams of one language's training sample, which ``most_rows`` bounds.
    """

    def fit(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        m = interpolated(table.column("gram").to_pylist(), table.column("c").to_numpy())
        return pa.table({"lang": [key[0].as_py()], **{f: pa.array([getattr(m, f).tobytes()], pa.binary()) for f in ("grams", "logp", "contexts", "backoff")}, "floor": [m.floor]})

    rows = counts.groupBy("lang").applyInArrow(fit, "lang string, grams binary, logp binary, contexts binary, backoff binary, floor double").collect()
    kinds = (np.uint64, np.float32, np.uint64, np.float32)
    return [(r[0], Model(*[np.frombuffer(b, k) for b, k in zip(r[1:5], kinds, strict=True)], r[5])) for r in sorted(rows, key=lambda r: r[0])]


@functools.lru_cache(maxsize=1)
def _kept(sent) -> Scorer:
    """The scorer of broadcast models that a Python worker keeps between its tasks."""
    return Scorer(sent.value)


class Scorer:
    """Cross-entropies of texts; remembers words up to a number of bytes."""

    def __init__(self, models: Models):
        self.models = models
        self._fresh()

    def _fresh(self) -> None:
        scorer, self.pending, self.held, self.table = self, [], 0, np.empty((0, len(self.models.languages)))

        class Places(dict):
            def __missing__(self, word: bytes) -> int:
                i = self[word] = len(self)
                scorer.pending.append(word)
                scorer.held += len(word) + 100
                return i

        self.places = Places()

    def _scored(self) -> None:
        done, at = [self.table], 0
        while at < len(self.pending):
            words, size = [], 0
            while at < len(self.pending) and size < AT_ONCE and len(self.pending[at]) <= AT_ONCE:
                words.append(self.pending[at].decode("utf-8", "replace"))
                size += len(words[-1])
                at += 1
            if words:
                done.append(self.models.scores(words))
            else:  # a long word, always by itself: its score doesn't depend on what stands beside it
                done.append(self.models.long_score(self.pending[at].decode("utf-8", "replace")))
                at += 1
        self.table = np.concatenate(done)
        self.pending = []

    def cross_entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits a character, a row per text, inf for one without words; and its characters: those of words, and one for each word's end."""
        if self.held > REMEMBERED_BYTES:
            self._fresh()
        look = self.places.__getitem__
        rows, chars = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            low = text.lower()
            words = low.encode("utf-8", "replace").split()
            rows.append(np.fromiter(map(look, words), np.int64, len(words)))
            chars[i] = len(low) - sum(map(low.count, BLANKS)) + len(words)
        if self.pending:
            self._scored()
        out = np.full((len(texts), len(self.models.languages)), np.inf)
        for i, at in enumerate(rows):
            if len(at):
                out[i] = -self.table[at].sum(0) / chars[i]
        return out, chars


def _scores(docs: DataFrame, models: Models) -> DataFrame:
    """``docs`` (columns key, text as binary) as ``key, lang, entropy, chars, score``."""
    sent = docs.sparkSession.sparkContext.broadcast(models)  # bounded by most_rows a language

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _kept(sent)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [(raw or b"").decode("utf-8", "replace") for raw in code_bytes(batch, "text")]
                lang, entropy, chars, score = _decided(scorer, texts)
                yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(lang, pa.string()), pa.array(entropy, pa.float64()), pa.array(chars, pa.int64()), pa.array(score, pa.float64())], ["key", "lang", "entropy", "chars", "score"])

    kind = docs.schema["key"].dataType.simpleString()
    return map_texts(docs, predict, f"key {kind}, lang string, entropy double, chars long, score double")


def _decided(scorer: Scorer, texts: list[str]) -> tuple[list[str], list[float | None], list[int], list[float]]:
    names = scorer.models.languages
    if not names:
        return ["und"] * len(texts), [None] * len(texts), [0] * len(texts), [0.0] * len(texts)
    bits, chars = scorer.cross_entropies(texts)
    lang, entropy, score = [], [], []
    for text, h in zip(texts, bits, strict=True):
        if not np.isfinite(h).all() or not has_letter(text):
            lang.append("und"), entropy.append(None), score.append(0.0)
            continue
        best = int(h.argmin())  # the first of equal ones: names are sorted
        lang.append(names[best])
        entropy.append(float(h[best]))
        score.append(float(1 / np.exp2(np.maximum(8 * (h[best] - h), -1000)).sum()))
    return lang, entropy, chars.tolist(), score


def calibrated(scored: DataFrame, languages: list[str], *, quantile: float, slack: float, short: float) -> np.ndarray:
    """Each language's limit from rows of its own that ``scored`` holds (``key`` is their label).

    The rate is the ``quantile`` of their entropies and, beyond it, ``slack`` times its distance
    from the median: what lies farther out than that is unlike anything kept for calibration.
    ``short`` is the room of a text of one character; it falls with the root of the length, as
    the deviation of a mean does. A language without such rows rejects nothing.
    """
    q = scored.filter("key = lang").groupBy("lang").agg(F.percentile("entropy", F.array(F.lit(0.5), F.lit(quantile))).alias("q"))
    known = {r[0]: r[1] for r in q.collect()}  # a row a language
    return np.array([[b + slack * (b - a), short] for a, b in (known.get(x, (np.inf, np.inf)) if x in known else (0.0, np.inf) for x in languages)])


def language_models(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", most_rows: int = 500, quantile: float = 0.99, slack: float = 2.0, short: float = 12.0) -> Models:
    """Models of the languages that rows not held out are labelled with.

    They learn from a sample of about ``most_rows`` rows a language (all, if there are fewer),
    the documented bound of what a language's fit holds and of what is broadcast; every n-gram
    of it counts. A fifth of the sample is kept from the counts and calibrates rejection.
    """
    rows = training_rows(docs, key=key, text=text, lang=lang, most=most_rows)
    fifth = F.pmod(F.xxhash64(F.lit("calibrate"), "key"), F.lit(5)) == 0
    models = Models.of(fitted(gram_counts(rows.filter(~fifth))))
    if models.languages:
        scored = _scores(rows.filter(fifth).select(F.col("lang").alias("key"), F.col("text").cast("binary").alias("text")), models)
        models.limits = calibrated(scored, models.languages, quantile=quantile, slack=slack, short=short)
    return models


def within(entropy: Column, chars: Column, lang: Column, models: Models) -> Column:
    """Whether a text is like its language; false without an entropy."""
    rate, room = F.lit(None).cast("double"), F.lit(0.0)
    for name, (most, short) in zip(models.languages, models.limits, strict=True):
        rate, room = F.when(lang == name, F.lit(float(most))).otherwise(rate), F.when(lang == name, F.lit(float(short))).otherwise(room)
    return F.coalesce(entropy <= rate + room / F.sqrt(F.greatest(chars, F.lit(1))), F.lit(False))


def identified(docs: DataFrame, models: Models, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, entropy, score, accepted`` for every row, from its text alone.

    The language with the lowest cross-entropy per character wins, the first by name of equal
    ones. Null texts and texts without a letter are ``und`` with score 0. ``accepted`` is false
    for those, and where the entropy is above the language's limit for a text so long (see ``calibrated``). Null keys and repeated rows
    stay; no models (nothing to learn from) make every text ``und``.
    """
    scored = _scores(docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")), models)
    accepted = within(F.col("entropy"), F.col("chars"), F.col("lang"), models)
    return scored.select(F.col("key").alias(key), F.col("lang").alias("lang_pred"), "entropy", "score", accepted.alias("accepted"))


def accepted_rows(docs: DataFrame, models: Models, *, text: str = "text") -> DataFrame:
    """``docs`` without the rows that language identification rejects; whole rows pass through."""
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _kept(sent)
        limits = dict(zip(sent.value.languages, sent.value.limits, strict=True))
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [(raw or b"").decode("utf-8", "replace") for raw in code_bytes(batch, text)]
                lang, entropy, chars, _ = _decided(scorer, texts)
                keep = [h is not None and h <= limits[x][0] + limits[x][1] / max(n, 1) ** 0.5 for x, h, n in zip(lang, entropy, chars, strict=True)]
                yield batch.filter(pa.array(keep, pa.bool_()))

    return map_texts(docs, keep, docs.schema)
