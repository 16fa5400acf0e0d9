"""Fill-in-middle transformation of whole texts by list arrays of pyarrow.compute."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_texts

#: A unit is a word with the blanks before it; blanks at the end of a text are one of their own.
UNIT = r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes of text that one step of the pipeline holds as units; a longer text is a step of its own.
STEP_BYTES = 4_000_000
#: No byte of valid UTF-8, so it can stand between units.
BORDER = b"\xff"


def draws(key: Column, seed: int) -> list[Column]:
    """Four numbers below 2^32 from the SHA-256 of seed and key; a null key counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"__h{i + 1}") for i in range(4)]


def units(texts: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
    """All units of ``texts`` (binary), the row of each, and how many each row has."""
    parted = pc.split_pattern(pc.replace_substring_regex(texts, pattern=UNIT, replacement=rb"\1" + BORDER), BORDER)
    flat, parent = pc.list_flatten(parted), pc.list_parent_indices(parted)
    whole = pc.greater(pc.binary_length(flat), 0)  # the last part of a row, behind its last border, is empty
    flat, parent = flat.filter(whole), parent.filter(whole)
    return flat, parent, np.bincount(parent.to_numpy(), minlength=len(texts))


def pieces(texts: pa.Array, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """Units of each row, and its three parts, cut behind ``h1`` and ``h2`` modulo units + 1."""
    flat, parent, n = units(texts)
    first = np.cumsum(n) - n
    ordinal = np.arange(len(flat)) - first[parent.to_numpy()]
    cuts = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)]), axis=0)
    low, high = (pa.array(c[parent.to_numpy()]) for c in cuts)
    ordinal = pa.array(ordinal)
    role = pc.add(pc.greater_equal(ordinal, low).cast(pa.int8()), pc.greater_equal(ordinal, high).cast(pa.int8()))
    sizes = {"prefix": cuts[0], "middle": cuts[1] - cuts[0], "suffix": n - cuts[1]}
    out = {}
    for number, name in enumerate(sizes):
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes[name])]), pa.int64())
        lists = pa.LargeListArray.from_arrays(offsets, flat.filter(pc.equal(role, number)))
        out[name] = pc.binary_join(lists, pa.scalar(b"", flat.type))
    return n, out


def _joined(*parts) -> pa.Array:
    kind = pa.large_binary()
    parts = [p if isinstance(p, pa.Array) else pa.scalar(MARKS[p].encode(), kind) for p in parts]
    return pc.binary_join_element_wise(*parts, pa.scalar(b"", kind))


def rearranged(texts: pa.Array, h: list[np.ndarray], rate: int, spm: int) -> list[pa.Array]:
    """Columns n, form, prefix, middle and output of a step."""
    n, part = pieces(texts, h[0], h[1])
    marked = [pc.match_substring(texts, m.encode()) for m in MARKS.values()]
    plain = pc.or_(pc.or_(pc.or_(*marked[:2]), marked[2]), pc.or_(pa.array(n == 0), pa.array(h[2] % 100 >= rate)))
    late = pa.array(h[3] % 100 < spm)
    form = pc.if_else(plain, PLAIN, pc.if_else(late, SPM, PSM))
    psm = _joined("prefix", part["prefix"], "suffix", part["suffix"], "middle", part["middle"])
    by_suffix = _joined("suffix", part["suffix"], "prefix", part["prefix"], "middle", part["middle"])
    output = pc.if_else(plain, texts, pc.if_else(late, by_suffix, psm))
    none = pa.scalar(None, texts.type)
    return [pa.array(n, pa.int64()), form, pc.if_else(plain, none, part["prefix"]), pc.if_else(plain, none, part["middle"]), output]


def _steps(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows with ``STEP_BYTES`` of text, or one row."""
    a, held = 0, 0
    for b, size in enumerate(sizes):
        if b > a and held + size > STEP_BYTES:
            yield a, b
            a, held = b, 0
        held += size
    if len(sizes):
        yield a, len(sizes)


def transformed(docs: DataFrame, *, key: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """``key, n, form, prefix, middle, output`` for every row.

    A text is cut into units behind two places that a hash of seed and key draws. Of 100 texts
    ``rate`` are rearranged, and of 100 of those ``spm`` have the suffix first (``spm``), the
    others the prefix (``psm``); the rest is ``plain`` and its output the text. So is the output
    of empty texts and of those that hold a mark already; null texts count as empty, with output
    ''. ``prefix`` and ``middle`` are null for plain ones. Null keys draw as empty text; repeated
    rows stay and give equal rows; invalid UTF-8 is made valid first. An empty table gives none.

    One pass over two columns, no shuffle. Each Arrow batch goes through list arrays in steps of
    bounded bytes: units flattened with the row they are from, their ordinals, a filter by role,
    lists rebuilt and joined.
    """
    kind = docs.schema[key].dataType.simpleString()
    whole = F.coalesce(F.make_valid_utf8(F.col(text)), F.lit("")).cast("binary").alias("__text")
    picked = docs.select(F.col(key).alias("__key"), whole, *draws(F.col(key), seed))
    names = ["__key", "n", "form", "prefix", "middle", "output"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column("__text")).to_numpy()
            for a, b in _steps(sizes):
                step = batch.slice(a, b - a)
                h = [step.column(f"__h{i}").to_numpy() for i in range(1, 5)]
                n, form, *texts = rearranged(step.column("__text").cast(pa.large_binary()), h, rate, spm)
                # Spark asks for the 32-bit kind; a step is far below its 2 GB, or one text that came in by it
                yield pa.RecordBatch.from_arrays([step.column("__key"), n, form, *(t.cast(pa.string()) for t in texts)], names)

    out = map_texts(picked, run, f"__key {kind}, n long, form string, prefix string, middle string, output string")
    return out.withColumnRenamed("__key", key)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from: its parts stand between marks that no text of theirs holds."""
    prefix, suffix, middle = (F.lit(m) for m in MARKS.values())
    last = F.split_part(output, middle, F.lit(2))
    psm_head, psm_tail = F.split_part(output, suffix, F.lit(1)), F.split_part(output, suffix, F.lit(2))
    psm = F.concat(F.split_part(psm_head, prefix, F.lit(2)), last, F.split_part(psm_tail, middle, F.lit(1)))
    spm_head, spm_tail = F.split_part(output, prefix, F.lit(1)), F.split_part(output, prefix, F.lit(2))
    spm = F.concat(F.split_part(spm_tail, middle, F.lit(1)), last, F.split_part(spm_head, suffix, F.lit(2)))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
