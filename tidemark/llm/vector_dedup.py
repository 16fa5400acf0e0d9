"""Near-duplicate embeddings: product quantisation in inverted lists, exact cosine rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hash_pair, written
from tidemark.llm.components import components

#: The fit's bounds: vectors sampled, inverted lists, subspaces, codes a subspace.
SAMPLE, LISTS, SUBSPACES, CODES = 40_000, 1024, 8, 64
#: Lists each vector probes, its own included, and vectors of a side in one block of work.
PROBES, BLOCK = 8, 2048


@dataclass
class Index:
    """Coarse centroids and a codebook of residuals for each subspace."""

    coarse: np.ndarray
    books: np.ndarray
    cuts: np.ndarray

    def assigned(self, x: np.ndarray, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest lists (nearest first), residual codes in the nearest, and the coding error."""
        far = -2 * x @ self.coarse.T + (self.coarse**2).sum(1)
        n = min(probes, len(self.coarse))
        near = np.argpartition(far, n - 1, axis=1)[:, :n] if n < len(self.coarse) else np.tile(np.arange(n), (len(x), 1))
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(far, near, 1), axis=1, kind="stable"), 1)
        rest = x - self.coarse[near[:, 0]]
        codes = np.empty((len(x), len(self.books)), np.uint8)
        error = np.zeros(len(x))
        for m, book in enumerate(self.books):
            part = rest[:, self.cuts[m] : self.cuts[m + 1]]
            d = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
            codes[:, m] = d.argmin(1)
            error += np.maximum(d.min(1), 0)
        return near, codes, np.sqrt(error)

    def tables(self, x: np.ndarray, at: int) -> np.ndarray:
        """Squared distances of each vector's residual in list ``at`` to all codes: (vectors, subspaces, codes)."""
        rest = x - self.coarse[at]
        out = np.empty((len(x), len(self.books), self.books[0].shape[0]), np.float32)
        for m, book in enumerate(self.books):
            part = rest[:, self.cuts[m] : self.cuts[m + 1]]
            out[:, m] = (part**2).sum(1)[:, None] - 2 * part @ book.T + (book**2).sum(1)
        return out


def _means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = np.concatenate([(-2 * part @ centres.T + (centres**2).sum(1)).argmin(1) for part in np.array_split(x, max(1, len(x) // 4096))])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fitted(sample: np.ndarray, lists: int, seed: int = 3) -> Index:
    """An index for unit vectors like those of ``sample``."""
    rng = np.random.default_rng(seed)
    coarse = _means(sample, lists, 5, rng)
    near = np.concatenate([(-2 * part @ coarse.T + (coarse**2).sum(1)).argmin(1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
    rest = sample - coarse[near]
    cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
    books = np.empty(len(cuts) - 1, object)
    for m in range(len(books)):
        books[m] = _means(rest[:, cuts[m] : cuts[m + 1]], min(CODES, len(rest)), 5, rng)
    return Index(coarse, books, cuts)


def _units(raw: list[bytes], kind: str, dim: int) -> np.ndarray:
    """Vectors from their stored bytes, in double precision, of length one."""
    x = np.frombuffer(b"".join(raw), kind).reshape(-1, dim).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def packed_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """``id, vector, v1, v2`` of every row (``__id``): the vector's bytes, null where it can't link, and a hash of them."""
    kind = storage(rows, vector)

    def whole(values: np.ndarray) -> bytes | None:
        norm = float((values.astype(np.float64) ** 2).sum()) if len(values) and np.isfinite(values).all() else 0.0
        return values.tobytes() if 0 < norm < np.inf else None

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("vector")
            ends, flat = lists.offsets.to_numpy(), lists.values
            gaps = np.cumsum(np.concatenate([[0], flat.is_null().to_numpy(zero_copy_only=False)]))
            x = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
            bad = lists.is_null().to_numpy(zero_copy_only=False) | (gaps[ends[1:]] > gaps[ends[:-1]])
            kept = [None if b else whole(x[i:j]) for b, i, j in zip(bad, ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(kept, pa.binary())], ["id", "vector"])

    named = rows.select(F.col("__id").alias("id"), F.transform(F.col(vector), lambda v: v.cast("float" if kind == "<f4" else "double")).alias("vector"))
    flat = named.mapInArrow(packed, "id long, vector binary")
    return flat.select("id", "vector", *[c.alias(n) for c, n in zip(hash_pair(F.col("vector")), ("v1", "v2"), strict=True)])


def storage(rows: DataFrame, vector: str) -> str:
    """How components are kept: float as float, all else as double."""
    return "<f4" if rows.schema[vector].dataType.simpleString() == "array<float>" else "<f8"


def _coded(rows: DataFrame, index: Index, kind: str, dim: int, probes: int) -> DataFrame:
    """``id, vector, code, error, m, near``: near holds the lists that a vector probes, its own first."""
    sent = rows.sparkSession.sparkContext.broadcast(index)  # at most LISTS centroids

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                batch = whole.slice(i, 2048)
                near, codes, error = sent.value.assigned(_units(batch.column("vector").to_pylist(), kind, dim), probes)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array([c.tobytes() for c in codes]), pa.array(error.astype(np.float32)), batch.column("m"), pa.array(list(near.astype(np.int16)), pa.list_(pa.int16()))], ["id", "vector", "code", "error", "m", "near"])

    return rows.select("id", "vector", "m").mapInArrow(code, "id long, vector binary, code binary, error float, m long, near array<smallint>")


def _block_links(index_sent, kind: str, dim: int, least: float):
    """Work on one block: vectors that probe a list against members of it."""
    reach = np.sqrt(2 - 2 * least)

    def search(key: tuple, asking: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"id": np.empty(0, np.int64), "n": np.empty(0, np.int64), "least": np.empty(0, np.int64)})
        if asking.empty or members.empty:
            return none
        at = int(key[0])
        q, x = _units(list(asking.qvector), kind, dim), _units(list(members.vector), kind, dim)
        codes = np.frombuffer(b"".join(members.code), np.uint8).reshape(len(x), -1)
        error = members.error.to_numpy(float)
        qid, xid = asking.qid.to_numpy(), members.id.to_numpy()
        qm, xm = asking.qm.to_numpy(), members.m.to_numpy()
        linked = np.zeros((len(q), len(x)), bool)
        for a in range(0, len(q), 256):  # look-ups for some vectors at a time
            table = index_sent.value.tables(q[a : a + 256], at)
            far = np.zeros((len(table), len(x)), np.float32)
            for m in range(codes.shape[1]):
                far += table[:, m, codes[:, m]]
            # A true neighbour lies within reach plus the member's own coding error of the query.
            maybe = far <= ((reach + error) ** 2 + 1e-4)[None, :]
            maybe &= qid[a : a + 256, None] != xid[None, :]
            i, j = np.nonzero(maybe)
            for b in range(0, len(i), 1 << 15):
                u, v = i[b : b + (1 << 15)] + a, j[b : b + (1 << 15)]
                linked[u, v] = np.einsum("ij,ij->i", q[u], x[v]) >= least
        if not linked.any():
            return none
        # The other side's probes tell whether the pair comes up a second time, from that side.
        near, (own, which) = np.stack(members.near.to_list()), np.unique(asking.own, return_inverse=True)
        again = np.array([(near == o).any(1) for o in own])[which]
        n_q, n_x = linked @ xm, qm @ (linked & ~again)
        # Labels spread over the block's links; each linked vector then names its smallest.
        big = np.iinfo(np.int64).max
        lq, lx = qid.copy(), xid.copy()
        while True:
            nx = np.minimum(lx, np.where(linked, lq[:, None], big).min(0))
            nq = np.minimum(lq, np.where(linked, nx[None, :], big).min(1))
            if (nx == lx).all() and (nq == lq).all():
                break
            lq, lx = nq, nx
        q_in, x_in = linked.any(1), linked.any(0)
        return pd.DataFrame({"id": np.concatenate([qid[q_in], xid[x_in]]), "n": np.concatenate([n_q[q_in], n_x[x_in]]), "least": np.concatenate([lq[q_in], lx[x_in]])})

    return search


def _links_of(rows: DataFrame, n: int, kind: str, dim: int, *, least: float, probes: int) -> DataFrame:
    """``id, n, least`` per block and vector of one dimension."""
    spark = rows.sparkSession
    u = F.pmod(F.xxhash64(F.lit("sample"), "vector"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = [r[0] for r in rows.filter(u * n < SAMPLE).select("vector").collect()]
    x = _units(sample or [r[0] for r in rows.select("vector").limit(SAMPLE).collect()], kind, dim)
    lists = int(min(max(1, 3 * n**0.5), LISTS, max(1, len(x) // 30)))
    index = fitted(x, lists)
    coded = written(_coded(rows, index, kind, dim, probes), "coded")
    # Lists and those that probe them are cut into blocks; a list that holds many takes many blocks.
    sizes = coded.select(F.explode("near").alias("list"), F.element_at("near", 1).alias("own")).groupBy("list").agg(F.count(F.lit(1)).alias("asked"), F.sum((F.col("own") == F.col("list")).cast("long")).alias("held"))
    blocks = F.broadcast(sizes.filter("held > 0").select("list", F.ceil(F.col("asked") / BLOCK).cast("int").alias("qs"), F.ceil(F.col("held") / BLOCK).cast("int").alias("ms")))  # at most LISTS rows
    part = lambda by, n: F.pmod(F.xxhash64(F.lit(by), "id"), F.col(n)).cast("int")
    asking = coded.select("id", "vector", "m", F.element_at("near", 1).alias("own"), F.explode("near").alias("list")).join(blocks, "list")
    asking = asking.select("list", part("q", "qs").alias("qb"), F.explode(F.sequence(F.lit(0), F.col("ms") - 1)).alias("mb"), "id", "vector", "m", "own").toDF("list", "qb", "mb", "qid", "qvector", "qm", "own")
    members = coded.withColumn("list", F.element_at("near", 1)).join(blocks, "list")
    members = members.select("list", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)).alias("qb"), part("m", "ms").alias("mb"), "id", "vector", "code", "error", "m", "near")
    sent = spark.sparkContext.broadcast(index)
    key = ["list", "qb", "mb"]
    return asking.groupBy(*key).cogroup(members.groupBy(*key)).applyInPandas(_block_links(sent, kind, dim, least), "id long, n long, least long")


def near_vectors(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", least: float = 0.9, probes: int = PROBES) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row.

    Rows whose vectors have a cosine (double precision) of ``least`` or more link, whatever other
    columns say; ``n_links`` is the number of other rows linked directly. Equal vectors are one
    class first, with its number of rows, so copies are compared once. The index is fitted on a
    hash sample of at most about ``SAMPLE`` vectors; every class is coded and every class asks: it
    probes its ``probes`` nearest lists, table look-ups on codes leave those that may be near
    enough (a member's coding error is known, so none is lost in a probed list), and the rest is
    decided by the exact cosine. A pair found from either side counts for both. Blocks send
    counts and each vector's smallest label, not pairs.

    Null vectors, zero ones and those with null or non-finite components link with nothing;
    vectors of different length don't link. Each row is compared, rows that repeat a key and rows
    without one too; ``component_id`` is the smallest key of the component, null if all its keys
    are, and a null key keeps nothing. Repeated rows get equal results, a key with several
    vectors a result for each. An empty table gives no rows.
    """
    kind, width = storage(rows, vector), 4 if storage(rows, vector) == "<f4" else 8
    given = written(packed_vectors(rows.withColumn("__id", F.col(key).cast("long")), vector), "given")
    classes = given.filter("vector is not null").groupBy("v1", "v2").agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("m"), F.min("id").alias("least"))
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    found = None
    for size, n in classes.groupBy(F.octet_length("vector")).count().collect():  # a row per length of vector
        part = _links_of(classes.filter(F.octet_length("vector") == size), n, kind, size // width, least=least, probes=probes)
        found = part if found is None else found.union(part)
    named = given.select("id", "v1", "v2", F.col("vector").isNotNull().alias("usable"))
    if found is None:
        return named.select(F.col("id").cast(rows.schema[key].dataType).alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    found = written(found, "found")
    counts = found.groupBy(F.col("id").alias("__n")).agg(F.sum("n").alias("n"))
    labels = components(found.select(F.col("id").alias("u"), F.col("least").alias("v")))
    first = labels.join(classes.select(F.col("id").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("first"))
    labels = labels.join(first, "component").select(F.col("node").alias("__l"), "first")
    per = classes.join(counts, F.col("id") == F.col("__n"), "left").join(labels, F.col("id") == F.col("__l"), "left")
    per = per.select("v1", "v2", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.when(F.col("__l").isNull(), F.col("least")).otherwise(F.col("first")).alias("first"))
    out = named.join(per, ["v1", "v2"], "left")
    component = F.when(F.col("usable"), F.col("first")).otherwise(F.col("id"))
    return out.select(F.col("id").cast(rows.schema[key].dataType).alias(key), F.when(F.col("usable"), F.col("n_links")).otherwise(0).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
