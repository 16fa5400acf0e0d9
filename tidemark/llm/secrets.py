"""Secret scans with multipart credential linking."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import code_bytes, map_texts

#: Kinds by themselves, then weak ones that count only beside a complementary part.
BASE = ("assign", "access", "hex")
WEAK = ("secret", "endpoint", "identifier")
KINDS = BASE + WEAK

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{32,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"[a-z][a-z0-9+]{1,11}://[^\s\"'<>]{4,}")
IDENTIFIER = re.compile(r"""(?i:\b(?:user(?:name)?|login|account|client_id|access_key_id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""", re.ASCII)
#: A scope ends at a blank line.
SCOPE_END = re.compile(r"\n[ \t\r]*\n")
#: What completes a weak part of each kind.
COMPLEMENTS = {"secret": ("access", "endpoint", "identifier"), "endpoint": ("secret", "assign", "hex"), "identifier": ("secret", "assign", "hex")}

Span = tuple[int, int]


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of the base kinds, each found leftmost without overlap. Tests for needed characters come first."""
    assign = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if ":" in text or "=" in text else []
    access = [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []
    return {"assign": assign, "access": access, "hex": [m.span() for m in HEX.finditer(text)]}


def weak_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Candidates of the weak kinds; without identifiers and endpoints no secret could be completed."""
    endpoint = [m.span() for m in ENDPOINT.finditer(text)] if "://" in text else []
    identifier = [m.span() for m in IDENTIFIER.finditer(text)] if ":" in text or "=" in text else []
    secret: list[Span] = []
    if endpoint or identifier or base["access"]:
        for m in SECRET.finditer(text):
            s = m[0]
            if any(c.isdigit() for c in s) and s.lower() != s and s.upper() != s and not _within(m.span(), base["access"]):
                secret.append(m.span())
    return {"secret": secret, "endpoint": endpoint, "identifier": identifier}


def _within(span: Span, others: list[Span]) -> bool:
    i = bisect_right(others, (span[0], 1 << 62)) - 1
    return i >= 0 and others[i][0] <= span[0] and span[1] <= others[i][1]


def linked(weak: dict[str, list[Span]], base: dict[str, list[Span]], ends: list[int], reach: int) -> dict[str, list[Span]]:
    """Interval join within scopes: the weak parts that have a complementary part within ``reach``.

    Spans of a kind are sorted and don't overlap, so their starts and their ends both rise: the last
    that ends by the candidate's start and the first that starts from its end decide, whatever
    overlaps it, and a scope with thousands of parts costs n log n.
    """
    parts = weak | base
    starts = {kind: [a for a, _ in spans] for kind, spans in parts.items()}
    stops = {kind: [b for _, b in spans] for kind, spans in parts.items()}

    def near(span: Span, kind: str) -> bool:
        others, scope = parts[kind], bisect_right(ends, span[0])
        i, j = bisect_right(stops[kind], span[0]) - 1, bisect_left(starts[kind], span[1])
        if i >= 0 and span[0] - others[i][1] <= reach and bisect_right(ends, others[i][0]) == scope:
            return True
        return j < len(others) and others[j][0] - span[1] <= reach and bisect_right(ends, others[j][0]) == scope

    return {kind: [s for s in weak[kind] if any(near(s, c) for c in COMPLEMENTS[kind])] for kind in WEAK}


def spans_of(text: str, reach: int) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of all spans, by start and then kind; code points, end exclusive."""
    base = base_spans(text)
    found = dict(base)
    weak = weak_spans(text, base)
    if any(weak.values()):
        found |= linked(weak, base, [m.end() for m in SCOPE_END.finditer(text)], reach)
    return sorted(((KINDS.index(kind), *span) for kind, spans in found.items() for span in spans), key=lambda x: (x[1], x[0], x[2]))


def secret_spans(docs: DataFrame, *, key: str = "doc_id", text: str = "text", reach: int = 200) -> DataFrame:
    """``key, spans`` for every row; spans are an array of (kind, start, end) by start, then kind.

    Base kinds stand by themselves. A weak candidate (a secret-like string, an endpoint, an
    account identifier) is reported only if a part that completes it lies in the same scope,
    at most ``reach`` characters away. Null and empty texts have no spans; null keys and repeated
    rows stay. One pass over two columns, no shuffle.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans_of((raw or b"").decode("utf-8", "replace"), reach)] for raw in code_bytes(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(spans, kind)], ["key", "spans"])

    picked = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    return map_texts(picked, scan, f"key {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("key", key)


def digest_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_report(docs: DataFrame, *, key: str = "doc_id", text: str = "text", reach: int = 200) -> DataFrame:
    """``secret_spans`` as counts and digests per row."""
    found = secret_spans(docs, key=key, text=text, reach=reach)
    counts = [F.expr(f"size(filter(spans, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(key, *counts, F.sha2(digest_text(base), 256).alias("base_sha256"), digest_text(F.col("spans")).alias("spans"))
