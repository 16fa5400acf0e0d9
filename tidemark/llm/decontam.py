"""Benchmark decontamination by pigeonhole pieces and bit-parallel edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import code_bytes, map_texts, written

#: Characters of test items that one pass holds in a task's memory; more items take more passes.
BLOCK_CHARS = 1_000_000
#: Length of the q-grams that an occurrence must share with its item.
Q = 4


def plain(text: str) -> str:
    """Lower case, with single spaces for runs of white space."""
    return " ".join(text.lower().split())


def budget(n: int, rate: float) -> int:
    """Edits allowed in an item of ``n`` characters."""
    return int(rate * n + 1e-9)


def begins_within_one(part: str, text: str) -> bool:
    """Whether some prefix of ``text`` is ``part`` with one edit or none."""
    if text.startswith(part):
        return True
    i = next((i for i, (a, b) in enumerate(zip(part, text, strict=False)) if a != b), min(len(part), len(text)))
    rest = part[i + 1 :]
    return text.startswith(rest, i + 1) or text.startswith(part[i:], i + 1) or text.startswith(rest, i)


def distances(item: str, window: str, most: int) -> tuple[int, int] | None:
    """Least edit distance of ``item`` to a part of ``window``, and that part's end; None above ``most``.

    Myers' bit-vectors for search: the part may begin anywhere, and Python's integers hold items
    of any length.
    """
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(window):
        eq = masks.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        rise = minus | (full & ~(across | plus))
        fall = plus & across
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
        rise, fall = (rise << 1) & full, (fall << 1) & full
        plus = fall | (full & ~(vertical | rise))
        minus = rise & vertical
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= most else None


@dataclass
class Item:
    """A test item as it is searched for: its edits allowed, and its q-grams with how many of them must stay."""

    text: str
    edits: int
    grams: list[str]
    needed: int

    @classmethod
    def of(cls, text: str, rate: float) -> Item:
        k = budget(len(text), rate)
        grams = [text[i : i + Q] for i in range(len(text) - Q + 1)]
        return cls(text, k, grams, len(grams) - Q * k)  # an edit spoils Q of them at most

    def possible(self, window: str) -> bool:
        if self.needed <= 0:
            return True
        there = {window[i : i + Q] for i in range(len(window) - Q + 1)}
        return sum(map(there.__contains__, self.grams)) >= self.needed


@dataclass
class Place:
    """A piece within an item: the item's number, the piece's offset, and the other piece of its pair (None: unpaired)."""

    item: int
    offset: int
    other: str | None
    after: bool

    def holds(self, text: str, start: int, end: int) -> bool:
        """Whether the other piece of the pair follows, or stands before, with one edit at most."""
        if self.other is None:
            return True
        if self.after:
            return begins_within_one(self.other, text[end : end + len(self.other) + 1])
        return begins_within_one(self.other[::-1], text[max(0, start - len(self.other) - 1) : start][::-1])


class Matcher:
    """Finds items in texts. Every occurrence within the budget holds one piece unchanged.

    An item with k edits allowed is cut into k + 1 pieces, and these are paired (with k even, the last
    stays alone). If an occurrence doesn't hold the one alone, k - 1 edits fall on k / 2 pairs, else k on
    (k + 1) / 2: a pair has at most one, so one of its pieces is there unchanged and the other with one
    edit at most. Hits on a pair are dropped where that fails; what is left must share enough
    q-grams before distances are computed. Neither test loses an occurrence. Items without edits
    allowed must occur between word borders.
    """

    def __init__(self, items: list[str], rate: float):
        import ahocorasick

        self.items = [Item.of(plain(text), rate) for text in items]
        places: dict[str, list[Place]] = {}
        for number, item in enumerate(self.items):
            n, k = len(item.text), item.edits
            cuts = [n * p // (k + 1) for p in range(k + 2)]
            parts = [item.text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            for p, part in enumerate(parts):
                mate = p ^ 1
                if part:
                    places.setdefault(part, []).append(Place(number, cuts[p], parts[mate] if mate <= k else None, mate > p))
        self.words = ahocorasick.Automaton()
        for word, where in places.items():
            self.words.add_word(word, (len(word), where))
        if places:
            self.words.make_automaton()

    def found(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """(item's number, distance, start, end) of the best occurrence of each item, in ``plain(text)``."""
        if not len(self.words) or not text:
            return
        text = plain(text)
        starts: dict[int, set[int]] = {}
        for last, (size, where) in self.words.iter(text):
            begin = last + 1 - size
            for place in where:
                if place.holds(text, begin, last + 1):
                    starts.setdefault(place.item, set()).add(begin - place.offset)
        for number, at in starts.items():
            item = self.items[number]
            n, k = len(item.text), item.edits
            if not k:
                borders = (a for a in sorted(at) if not text[max(0, a - 1) : a].isalnum() and not text[a + n : a + n + 1].isalnum())
                if (a := next(borders, None)) is not None:
                    yield number, 0, a, a + n
                continue
            best = None
            for a, b in self._windows(sorted(at), n, k):
                a = max(0, a)
                window = text[a:b]
                got = distances(item.text, window, k) if item.possible(window) else None
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], a + got[1])
            if best:
                near = text[max(0, best[1] - n - k) : best[1]]
                _, back = distances(item.text[::-1], near[::-1], k)
                yield number, best[0], best[1] - back, best[1]

    @staticmethod
    def _windows(starts: list[int], m: int, k: int) -> Iterator[tuple[int, int]]:
        """Stretches that hold all candidates; those that overlap are searched once."""
        a, b = starts[0] - k, starts[0] + m + k
        for s in starts[1:]:
            if s - k > b:
                yield a, b
                a = s - k
            b = s + m + k
        yield a, b


def searchable(text: Column) -> Column:
    """Whether an item has anything to search for: a character that is no white space, of ASCII or beyond."""
    return F.coalesce(F.length(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", "")) > 0, F.lit(False))


def unsearchable(benchmark: DataFrame, *, item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The items that no search can find: null, empty or blank texts."""
    return benchmark.filter(~searchable(F.col(item_text))).select(item, item_text)


def _blocks(benchmark: DataFrame, key: str, text: str) -> Iterator[tuple[int, list, list[str]]]:
    """Ids and texts of the items, a block that fits a task at a time; the driver holds no more than one.

    An item is in the block that its hash names; their number is that of passes over the documents.
    """
    items = benchmark.filter(searchable(F.col(text))).select(key, text).distinct()
    n = -(-(items.agg(F.sum(F.length(text))).first()[0] or 0) // BLOCK_CHARS) or 1
    for i in range(n):
        rows = items.filter(F.pmod(F.xxhash64(key, text), F.lit(n)) == i).collect()
        yield n, [r[0] for r in rows], [r[1] for r in rows]


def contaminated(docs: DataFrame, benchmark: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = 0.1) -> DataFrame:
    """``key, item, distance, start, end``: a row for each document and test item found in it.

    An item of n characters (lower case, runs of white space as one space) may differ by
    floor(rate * n) edits, at any length; it is cut into one piece more than that, so some piece
    is unchanged in every occurrence. All pieces are searched for at once in whole texts; hits
    whose neighbouring piece or q-grams rule the item out are dropped, and the surroundings of
    the others are verified with Myers' bit-vectors. ``start`` and ``end`` are places in the text
    so normalised. Items too short for an edit must occur as whole words, unchanged; null, empty
    and blank ones match nothing and are what ``unsearchable`` lists. Null and empty texts match
    nothing; repeated items with the same id and text count once; repeated documents each give
    their rows; ids may be of any type. Empty tables give no rows.

    The test items are collected a block of a fixed size at a time, one pass over the documents
    for each; with several blocks, each pass is written before the next one is collected.
    Documents are never shuffled.
    """
    sc, kind, item_kind = docs.sparkSession.sparkContext, docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    out = None
    for n, ids, texts in _blocks(benchmark, item, item_text):
        sent = sc.broadcast((ids, texts))

        def search(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, items = sent.value
            matcher = Matcher(items, rate)
            for batch in batches:
                hits = [(row, *hit) for row, raw in enumerate(code_bytes(batch, "text")) for hit in matcher.found((raw or b"").decode("utf-8", "replace"))]
                rows, found, *places = list(zip(*hits, strict=True)) or [()] * 5
                ids = pa.array([names[i] for i in found], to_arrow_type(item_type))
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows, pa.int64())), ids, *(pa.array(p, pa.int64()) for p in places)], ["key", "item", "distance", "start", "end"])

        item_type = benchmark.schema[item].dataType
        hits = map_texts(docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")), search, f"key {kind}, item {item_kind}, distance long, start long, end long")
        if n > 1:
            hits = written(hits, "hits")
            sent.unpersist()
        out = hits if out is None else out.union(hits)
    return out.select(F.col("key").alias(key), F.col("item").alias(item), "distance", "start", "end")


def decontaminated(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = 0.1) -> DataFrame:
    """``docs`` without the rows in which a test item is found, by the rules of ``contaminated``.

    Whole rows pass through the search, so nothing is joined or shuffled, keys may be null or
    repeat, and every column stays as it is.
    """
    sc = docs.sparkSession.sparkContext
    for n, _, texts in _blocks(benchmark, item, item_text):
        sent = sc.broadcast(texts)

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate)
            for batch in batches:
                keep = [next(matcher.found((raw or b"").decode("utf-8", "replace")), None) is None for raw in code_bytes(batch, text)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = map_texts(docs, clean, docs.schema)
        if n > 1:
            docs = written(docs, "clean")
            sent.unpersist()
    return docs
