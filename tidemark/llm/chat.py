"""Chat formatting from event logs."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that a tokenizer may take for control; none stays whole inside a text or role.
CONTROL = (OPEN, CLOSE, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
_INSIDE = re.compile(r"\\|[<\[](?=" + "|".join(re.escape(c[1:]) for c in CONTROL) + ")")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(re.escape(OPEN) + r"(.*?)\n(.*?)" + re.escape(CLOSE) + r"\n", re.DOTALL)
KINDS = ("open", "delta", "edit", "regenerate")


def escaped(text: str) -> str:
    """``text`` with every backslash doubled and a backslash behind the first sign of each control string."""
    return _INSIDE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def escaped_role(role: str) -> str:
    """A role stands before a line feed and so can hold none itself: it becomes backslash, n.

    No control string has n as its second sign, so nothing else looks like that.
    """
    return escaped(role).replace("\n", "\\n")


def unescaped_role(role: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role)


def rendered(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans under the loss mask: the assistant's texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body, tail = f"{OPEN}{escaped_role(role)}\n", escaped(text), f"{CLOSE}\n"
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, tail]
        at += len(head) + len(body) + len(tail)
    return "".join(parts), spans


def parsed(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation: what ``rendered`` was given."""
    return [(unescaped_role(m[1]), unescaped(m[2])) for m in _TURN.finditer(formatted)]


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def events_of_rows(rows: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A table of turns as the event log that a chat service would have written for it.

    Each turn opens and streams its text; by a hash of its place, some stream half of it, are
    regenerated and stream anew, some stream a draft that an edit replaces, and some are edited
    to their first half and stream on. Folded, each is the turn's text again. A message is named
    by its turn and its number among rows of that turn (by role, then text), so repeated rows are
    turns of their own and no conversation is sorted whole. Null texts and roles are empty.
    """
    nth = F.row_number().over(Window.partitionBy(conversation, turn).orderBy(F.col(role).asc_nulls_first(), F.col(text).asc_nulls_first()))
    whole = F.coalesce(F.col(text), F.lit(""))
    style = F.pmod(F.xxhash64(F.col(conversation).cast("string"), F.col(turn).cast("string"), nth), F.lit(4))
    named = rows.select(F.col(conversation).alias("conversation"), F.struct(F.col(turn).alias("turn"), nth.alias("nth")).alias("message"), F.coalesce(F.col(role), F.lit("")).alias("role"), whole.alias("whole"), style.alias("style"))
    half = F.expr("cast(floor(length(whole) / 2) as int)")
    first, second = F.expr("substring(whole, 1, cast(floor(length(whole) / 2) as int))"), F.substring("whole", half + 1, F.length("whole"))
    draft = F.lit("draft ")

    def log(*steps: tuple[str, Column]) -> Column:
        return F.array(*[F.struct(F.lit(kind).alias("kind"), F.struct("message.turn", "message.nth", F.lit(i).alias("step")).alias("seq"), text.alias("text")) for i, (kind, text) in enumerate(steps)])

    empty = F.lit("")
    plain = log(("open", empty), ("delta", first), ("delta", second))
    again = log(("open", empty), ("delta", second), ("regenerate", empty), ("delta", first), ("delta", second))
    replaced = log(("open", empty), ("delta", draft), ("edit", F.col("whole")))
    went_on = log(("open", empty), ("delta", draft), ("edit", first), ("delta", second))
    events = F.when(F.col("style") == 0, again).when(F.col("style") == 1, replaced).when(F.col("style") == 2, went_on).otherwise(plain)
    return named.select("conversation", "message", "role", F.inline(events))


def messages(events: DataFrame) -> DataFrame:
    """``conversation, first, message, role, text``: the final state of each message.

    ``events`` has ``conversation, message, seq, kind, role, text``; ``message`` and ``seq`` may be
    of any type that has an order. In the order of ``seq``,
    ``open`` and ``regenerate`` start a message afresh, ``edit`` puts its text in place of what
    there was, ``delta`` adds its text; so the text is all that came since the last of the
    former. Events of a message meet by (conversation, message): streams of deltas of a long
    conversation are spread. Unknown kinds are left out; equal ``seq`` go by kind and text,
    a start before its deltas; a message without a start is what its deltas say. The role is
    that of the latest event that has one.
    """
    rank = F.when(F.col("kind") == "delta", 1).otherwise(0)
    known = events.filter(F.col("kind").isin(*KINDS)).withColumn("at", F.struct("seq", rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text")))
    folded = known.groupBy("conversation", "message").agg(F.min("seq").alias("first"), F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).alias("role"), F.max(F.when(F.col("kind") != "delta", F.col("at"))).alias("since"), F.sort_array(F.collect_list("at")).alias("log"))
    after = F.filter("log", lambda e: F.coalesce(e >= F.col("since"), F.lit(True)))
    return folded.select("conversation", "first", "message", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform(after, lambda e: e["text"]), "").alias("text"))


def formatted(events: DataFrame) -> DataFrame:
    """``conversation, n_turns, formatted, loss_spans``: a row per conversation of the log.

    Final messages stand by the ``seq`` of their first event. A conversation is one row of the
    result, so its messages meet in one task; the log before it is folded per message.
    Null conversations are a conversation of their own; bytes that are no UTF-8 become replacement
    characters; an empty log gives no rows.
    """
    said = messages(events).withColumns({c: F.col(c).cast("binary") for c in ("role", "text")})
    ordered = said.groupBy("conversation").agg(F.sort_array(F.collect_list(F.struct("first", "message", "role", "text"))).alias("turns"))
    turns = ordered.select("conversation", F.transform("turns", lambda t: t["role"]).alias("roles"), F.transform("turns", lambda t: t["text"]).alias("texts"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            talks = [list(zip(map(_text, r), map(_text, t), strict=True)) for r, t in zip(batch.column("roles").to_pylist(), batch.column("texts").to_pylist(), strict=True)]
            done = [rendered(t) for t in talks]
            spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s in done], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            n = pa.array([len(t) for t in talks], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conversation"), n, pa.array([t for t, _ in done], pa.string()), spans], ["conversation", "n_turns", "formatted", "loss_spans"])

    kind = events.schema["conversation"].dataType.simpleString()
    return turns.mapInArrow(render, f"conversation {kind}, n_turns long, formatted string, loss_spans array<struct<start:bigint,end:bigint>>")


def read_back(chats: DataFrame) -> DataFrame:
    """What the formatted text says: ``conversation, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(), strict=True):
                turns = parsed(text)
                said = "".join(f"{role}\n{body}\n" for role, body in turns)
                loss = "".join(unescaped(text[s["start"] : s["end"]]) for s in spans)
                rows.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("conversation"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["conversation", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = chats.schema["conversation"].dataType.simpleString()
    return chats.select("conversation", "formatted", "loss_spans").mapInArrow(read, f"conversation {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
