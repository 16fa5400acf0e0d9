"""Near-duplicate documents: MinHash bands, verified links, connected components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import code_bytes, dropped, hash_pair, map_texts, written
from tidemark.llm.components import components

CHUNK = 1 << 18
#: Rows of keys that may be broadcast: 8 to 24 bytes each; beyond, the join shuffles.
BROADCAST_KEYS = 3_000_000
#: Partners of one set in a block of work, and sets of one shingle that are ranked in one block.
PARTNERS, RANKED = 512, 4096
#: Pivots of a round at most, and the number of pairs that are tested without more rounds.
PIVOTS, FEW_PAIRS = 1 << 30, 4_000_000
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_BASE = 0x9E3779B97F4A7C15 | 1
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base modulo 2^64 and their inverses, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if n > len(self.up):
            n = max(n, 2 * len(self.up))
            base, inverse = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
            base[0] = inverse[0] = 1
            self.up, self.down = np.cumprod(base), np.cumprod(inverse)


def word_hashes(text: bytes, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``text`` (A-Z lower-cased) and where they start."""
    raw = np.frombuffer(text.lower(), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    word = ~_BLANK[raw]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    powers.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * powers.up[: len(raw)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * powers.down[starts]
    return _mixed(h + (ends - starts).astype(np.uint64) * _MIX[0]), starts


def words_of(text: bytes, powers: Powers) -> np.ndarray:
    """Word hashes of one text, a chunk at a time, cut at blanks."""
    if len(text) <= 2 * CHUNK:
        return word_hashes(text, powers)[0]
    parts, at = [], 0
    while at < len(text):
        to = min(at + CHUNK, len(text))
        while to < len(text) and not _BLANK[text[to]]:
            to += 1
        parts.append(word_hashes(text[at:to], powers)[0])
        at = to
    return np.concatenate(parts)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingles of ``width`` words, sorted; a shorter sequence is one shingle."""
    n = len(words)
    if not n:
        return words
    take = min(n, width)
    h = np.full(n - take + 1, take, np.uint64)
    for j in range(take):
        h = h * _MIX[1] + words[j : n - take + 1 + j]
    return np.unique(_mixed(h))


def document_sets(texts: list[bytes | None], width: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """For each text its sequence's digest (16 bytes) and its set of shingles."""
    powers, at = Powers(), 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size < CHUNK):
            group.append(texts[at] or b"")
            size += len(group[-1]) + 1
            at += 1
        if len(group) == 1:
            found = [words_of(group[0], powers)]
        else:
            all_words, starts = word_hashes(b" ".join(group), powers)
            begin = np.cumsum([0] + [len(t) + 1 for t in group])
            cut = np.searchsorted(starts, begin)
            found = [all_words[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        for words in found:
            yield hashlib.blake2b(words.tobytes(), digest_size=16).digest(), shingle_set(words, width)


class Signer:
    """Minima under many universal hashes a*x + b, their bands, and a byte of each minimum."""

    def __init__(self, bands: int, rows: int, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(self.a), len(sets)), np.uint64)
        i = 0
        while i < len(sets):
            j, size = i, 0
            while j < len(sets) and (j == i or size + len(sets[j]) < 1 << 14):
                size += len(sets[j])
                j += 1
            x = np.concatenate(sets[i:j])
            offsets = np.cumsum([0] + [len(s) for s in sets[i : j - 1]])
            for part in range(0, len(x), 1 << 20) if j == i + 1 else [0]:
                piece = x[part : part + (1 << 20)] if j == i + 1 else x
                for k in range(len(self.a)):
                    low = np.minimum.reduceat((piece * self.a[k] + self.b[k]) >> np.uint64(32), offsets)
                    out[k, i:j] = low if not part else np.minimum(out[k, i:j], low)
            i = j
        return out

    def signed(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Band keys (sets x bands, int64) and signatures (sets x hashes, uint8); no set is empty."""
        low = self.minima(sets)
        h = np.repeat(np.arange(self.bands, dtype=np.uint64)[:, None], len(sets), 1)
        for r in range(self.rows):
            h = _mixed(h * _MIX[0] + low[r :: self.rows])
        return h.T.astype(np.int64, copy=True), low.T.astype(np.uint8, order="C")


def _binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())


def _longs(digests: list[bytes]) -> list[pa.Array]:
    halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return [pa.array(np.ascontiguousarray(halves[:, i])) for i in (0, 1)]


def signed_documents(docs: DataFrame, *, key: str, text: str, width: int, bands: int, rows: int, carry: dict[str, Column]) -> DataFrame:
    """``key, c1, c2, n, bands, sig`` and the long columns ``carry`` per row: (c1, c2) names the sequence of words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(bands, rows)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                digests, sets = zip(*document_sets(code_bytes(batch, "text"), width), strict=True)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, sigs = [None] * len(sets), [None] * len(sets)
                if full:
                    band, sig = signer.signed([sets[i] for i in full])
                    for i, b, s in zip(full, band, sig, strict=True):
                        keys[i], sigs[i] = b, s.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column("key"), *_longs(digests), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.list_(pa.int64())), _binary(sigs), *[batch.column(c) for c in names]], ["key", "c1", "c2", "n", "bands", "sig", *names])

    kind, names = docs.schema[key].dataType.simpleString(), list(carry)
    picked = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"), *[c.alias(n) for n, c in carry.items()])
    return map_texts(picked, sign, f"key {kind}, c1 long, c2 long, n long, bands array<long>, sig binary{''.join(f', {n} long' for n in names)}")


def class_sets(docs: DataFrame, *, key: str, text: str, width: int) -> DataFrame:
    """``c1, c2, shingles`` (distinct hashes) per row."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                digests, found = zip(*document_sets(code_bytes(whole.slice(at, 512), "text"), width), strict=True)
                yield pa.RecordBatch.from_arrays([*_longs(digests), pa.array([s.astype(np.int64) for s in found], pa.list_(pa.int64()))], ["c1", "c2", "shingles"])

    return map_texts(docs.select(F.col(text).cast("binary").alias("text")), sets, "c1 long, c2 long, shingles array<long>")


def _parts(lists: pa.ListArray) -> list[np.ndarray]:
    return np.split(lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())[:-1])


def _alike(least: float):
    """Keeps pairs whose signatures may belong to sets as like as ``least``: 6 deviations of room."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("sig_u", "sig_v"))
                n = a.shape[1]
                floor = n * least - 6 * np.sqrt(n * least * (1 - least))
                yield batch.filter(pa.array((a == b).sum(1) >= floor)).select(["u", "v"])

    return keep


def _linked(percent: int):
    """Keeps pairs with 100 * intersection >= percent * union, on the full sets.

    Rows come by ``u`` and block: the set of ``u`` first (``v`` is null), then those of its partners.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for batch in batches:
            good = []
            for v, s in zip(batch.column("v").to_pylist(), _parts(batch.column("shingles")), strict=True):
                if v is None:
                    head = s.copy()
                    good.append(False)
                    continue
                n = len(np.intersect1d(head, s, assume_unique=True)) if 100 * min(len(head), len(s)) >= percent * max(len(head), len(s)) else 0
                good.append(100 * n >= percent * (len(head) + len(s) - n))
            yield batch.filter(pa.array(good, pa.bool_())).select(["u", "v"])

    return keep


def small(df: DataFrame) -> DataFrame:
    """``df``, a table of keys alone, broadcast if its count is within ``BROADCAST_KEYS``."""
    return F.broadcast(df) if df.count() <= BROADCAST_KEYS else df


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are alike.

    A partner's set moves once for each of its pairs; that of ``u``, which may stand in a third of
    all pairs, moves once for each block of its partners, and blocks are tasks of their own.
    """
    degree = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / PARTNERS).alias("blocks"))
    heads = degree.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    heads = heads.join(sets, heads["u"] == sets["node"]).select("u", "b", F.lit(None).cast("long").alias("v"), "shingles")
    asked = pairs.join(small(degree), "u").withColumn("b", F.pmod(F.xxhash64("v"), F.col("blocks")))
    asked = asked.join(sets, asked["v"] == sets["node"]).select("u", "b", "v", "shingles")
    dealt = heads.union(asked).repartition("u", "b").sortWithinPartitions("u", "b", F.col("v").asc_nulls_first())
    return dealt.select("u", "v", "shingles").mapInArrow(_linked(percent), "u long, v long")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """``token, node, size, place, rank``: each set's rarest shingles, which link to any like set.

    With shingles in one order for all (rarest among these sets first), sets of a similarity of
    t or more share a shingle among the first n - ceil(t * n) + 1 of each; sets that differ from
    a common text in many places hold only shingles of their own there and meet nothing. Shingles
    of one set alone come first in any order, so they are counted and not moved a second time.
    Within a token, sets are ranked by how common their shingles are: the text that others were
    made from comes first. A token of many sets is ranked in blocks whose ranks interleave, so no
    token is sorted in one task.
    """
    spread = sets.select("node", F.size("shingles").alias("size"), F.explode("shingles").alias("token"))
    counts = written(spread.groupBy("token").agg(F.count(F.lit(1)).alias("count")).filter("count > 1"), "token-counts")
    often = spread.join(counts, "token")
    ordered = often.groupBy("node", "size").agg(F.sort_array(F.collect_list(F.struct("count", "token"))).alias("tokens"), (F.sum(F.ln("count")) / F.first("size")).alias("common"))
    alone = F.col("size") - F.size("tokens")
    n = F.expr(f"size - cast(ceil({percent} * size / 100) as int) + 1") - alone
    first = ordered.filter(n > 0).select("node", "size", "common", alone.alias("alone"), F.posexplode(F.slice("tokens", F.lit(1), n)).alias("pos", "t"))
    first = first.select(F.col("t.token").alias("token"), "node", "size", (F.col("alone") + F.col("pos") + 1).alias("place"), "common", F.ceil(F.col("t.count") / RANKED).alias("blocks"))
    dealt = first.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    within = F.row_number().over(Window.partitionBy("token", "block").orderBy(F.col("common").desc(), "node"))
    ranked = written(dealt.withColumn("rank", (within - 1) * F.col("blocks") + F.col("block") + 1).select("token", "node", "size", "place", "rank"), "prefixes")
    dropped(counts)
    return ranked


def pivot_pairs(rows: DataFrame, done: int, upto: int, percent: int) -> DataFrame:
    """Pairs of the pivots ranked above ``done`` up to ``upto`` of each token and later sets of other
    components, if sizes and places still allow the similarity."""
    pivots = rows.filter(f"rank > {done} and rank <= {upto}").toDF(*[f"p_{c}" for c in rows.columns])
    same = (F.col("token") == F.col("p_token")) & (F.col("rank") > F.col("p_rank")) & (F.col("component") != F.col("p_component"))
    sizes = 100 * F.least("size", "p_size") >= percent * F.greatest("size", "p_size")
    overlap = F.least(F.col("size") - F.col("place"), F.col("p_size") - F.col("p_place")) + 1
    enough = overlap * (100 + percent) >= percent * (F.col("size") + F.col("p_size"))
    return rows.join(pivots, same & sizes & enough).select(F.col("p_node").alias("u"), F.col("node").alias("v")).distinct()


def labelled_rows(docs: DataFrame, *, key: str, text: str, width: int, percent: int, bands: int, rows: int, carry: dict[str, Column]) -> DataFrame:
    """``key, n, component, component_id, kept`` and the columns ``carry`` for every row, as ``near_duplicates``
    says; ``component`` tells components apart, null for texts without words.

    A class of equal word sequences gets a number when its table is written; all later tables
    hold numbers, and each is removed when it is spent.
    """
    signed = written(signed_documents(docs, key=key, text=text, width=width, bands=bands, rows=rows, carry=carry), "signed")
    classes = signed.filter("n > 0").groupBy("c1", "c2").agg(F.min("key").alias("least"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    spelled = classes.select("node", F.explode("bands").alias("bucket"))
    pivots = written(spelled.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("m")).filter("m > 1").drop("m"), "pivots")
    members = written(spelled.join(pivots, "bucket"), "members")
    dropped(pivots)

    shared = written(members.select("node").distinct(), "shared")
    sigs = written(classes.select("node", "c1", "c2", "sig", "least").join(small(shared), "node", "left_semi"), "signatures")
    least = small(sigs.select(F.col("least").alias("__least")))
    sources = docs.select(key, text).join(least, docs[key].eqNullSafe(F.col("__least")), "left_semi")
    names = small(sigs.select("node", F.col("c1").alias("__c1"), F.col("c2").alias("__c2")))
    named = class_sets(sources, key=key, text=text, width=width).join(names, (F.col("c1") == F.col("__c1")) & (F.col("c2") == F.col("__c2")))
    sets = written(named.select("node", "shingles"), "sets")
    if sets.groupBy("node").count().filter("count > 1").take(1):  # rows that repeat key and text
        sets = written(sets.dropDuplicates(["node"]), "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        like = pairs
        for end in ("v", "u"):
            like = like.join(sigs.select(F.col("node").alias(end), F.col("sig").alias(f"sig_{end}")), end)
        like = written(like.select("u", "v", "sig_u", "sig_v").mapInArrow(_alike(percent / 100), "u long, v long"), "alike")
        links = written(confirmed(like, sets, percent), "verified")
        dropped(like)
        return links

    links = verified(members.filter("node <> pivot").select(F.col("pivot").alias("u"), F.col("node").alias("v")).distinct())
    found = components(links)
    dropped(links)
    at = members.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_ = written(at.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("bucket"), "open")
    undecided = written(members.join(open_, "bucket").select("node").distinct(), "undecided")
    dropped(open_)
    dropped(members)
    if undecided.take(1):
        rows_ = prefixes(sets.join(small(undecided), "node", "left_semi"), percent)
        done, more = 0, 1
        while True:
            at = rows_.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
            open_ = written(at.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("rank").alias("last"), F.count(F.lit(1)).alias("m")).filter(f"lo <> hi and last > {done + 1}").select("token", "m"), "open")
            left = written(at.join(open_, "token"), "left")
            dropped(rows_)
            dropped(open_)
            n, pairs = left.agg(F.count(F.lit(1)), F.sum("m")).first()
            if not n:
                break
            if pairs <= 128 * n + FEW_PAIRS:
                more = PIVOTS  # what is left is small: all at once
            new = verified(pivot_pairs(left.drop("m"), done, done + more, percent))
            rows_ = left.drop("component", "m")
            if new.take(1):
                before, found = found, components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(new))
                dropped(before)
            dropped(new)
            done, more = done + more, min(PIVOTS, more * 8)
    for spent in (sets, sigs, shared, undecided):
        dropped(spent)

    grouped = found.join(classes.select("node", "least"), "node")
    ids = written(grouped.groupBy("component").agg(F.min("least").alias("component_id")), "ids")
    by_node = found.join(ids, "component").select(F.col("node").alias("__node"), "component", "component_id")
    labels = classes.join(by_node, F.col("node") == F.col("__node"), "left")
    first = F.when(F.col("__node").isNull(), F.col("least")).otherwise(F.col("component_id"))
    labels = labels.select(F.col("c1").alias("__c1"), F.col("c2").alias("__c2"), F.coalesce("component", "node").alias("component"), first.alias("component_id"))
    out = signed.join(labels, (F.col("n") > 0) & (F.col("c1") == F.col("__c1")) & (F.col("c2") == F.col("__c2")), "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key"))
    return out.select("key", "n", "component", component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(False)).alias("kept"), *carry)


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 85, bands: int = 28, rows: int = 6) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row of ``docs``.

    Two documents link when their sets of ``width``-word shingles have a Jaccard similarity of
    ``percent`` or more. Equal word sequences are one class first, so copies cost one row. A
    class's minima (``bands`` x ``rows`` universal hashes) give band keys; at 85 percent a link
    shares no band with a chance of 2 in a million. Within a bucket every class is held against
    one pivot. Classes of buckets that then still span several components are grouped anew by
    their rarest shingles (see ``prefixes``) and held against pivots there: one, eight, 64 and
    so on, only where a token spans several components and only against classes of other ones,
    until each class was a pivot. So no link between different components is left untested, and
    no bucket is paired with itself. Pairs whose signatures are far too unlike go; the rest is
    confirmed on full sets. Links go through large-star / small-star.

    Texts without words (null, empty, blank) have an empty set and are components of their own.
    ``component_id`` is the smallest key of the component; null keys lose against others, and a
    component of null keys only has a null id and keeps nothing. Rows that repeat a key and
    text get equal results. An empty table gives no rows.
    """
    found = labelled_rows(docs, key=key, text=text, width=width, percent=percent, bands=bands, rows=rows, carry={})
    return found.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id", "kept")


def deduplicated(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 85, bands: int = 28, rows: int = 6) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest key.

    Rows that repeat a key with the same text are copies and leave one. Rows that repeat a key with
    other texts are documents of their own: each goes or stays with its own component, and where
    several hold a component's smallest key, one of their texts stays. Documents without words
    stay, and so do those without a key, which nothing could name.
    """
    t1, t2 = hash_pair(F.col(text))
    found = written(labelled_rows(docs, key=key, text=text, width=width, percent=percent, bands=bands, rows=rows, carry={"t1": t1, "t2": t2}), "near-duplicates").filter(F.col("key").isNotNull())
    gone = found.filter(~F.col("kept"))
    twice = bool(found.groupBy("key").count().filter("count > 1").take(1))
    if twice:
        held = found.filter(F.col("kept") & (F.col("n") > 0)).select("key", "component", "t1", "t2").distinct()
        stays = held.groupBy("component").agg(F.min(F.struct("t1", "t2")).alias("stays"))
        gone = gone.select("key", "t1", "t2").union(held.join(stays, "component").filter(F.struct("t1", "t2") != F.col("stays")).select("key", "t1", "t2"))
    gone = gone.select(F.col("key").alias("__gone"), F.col("t1").alias("__t1"), F.col("t2").alias("__t2")).distinct()
    left = docs.join(small(gone), (docs[key] == F.col("__gone")) & (t1 == F.col("__t1")) & (t2 == F.col("__t2")), "left_anti")
    return left.dropDuplicates([key, text]) if twice else left
