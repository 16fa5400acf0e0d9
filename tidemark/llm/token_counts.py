"""Token counts of whole texts by the whole-token shortcut."""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import code_bytes, map_texts

SPACE = "▁"
RUNS = re.compile(rb" +[^ ]*|[^ ]+")
#: Bytes of pre-tokens that a task remembers beside the proven ones before it starts afresh.
REMEMBERED_BYTES = 32_000_000


def model_bytes(path: str) -> bytes:
    """The vocabulary file, through Spark's driver only: executors get it by broadcast."""
    with open(path, "rb") as file:
        return file.read()


@functools.lru_cache(maxsize=4)
def proven(model: bytes) -> tuple[dict[bytes, int], dict[bytes, int]]:
    """Vocabulary strings that encode alone as one token: after a space, and without one.

    Also proves what makes pre-tokens independent: no vocabulary string goes on after a line
    feed or holds a space mark behind another character, so no merge crosses those places. It is
    proven once for a model and process, before any text is read.
    """
    import sentencepiece as spm

    sp = spm.SentencePieceProcessor(model_proto=model)
    spaced, bare = {}, {}
    for i in range(sp.get_piece_size()):
        if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i):
            continue
        piece = sp.id_to_piece(i)
        if "\n" in piece or SPACE in piece.lstrip(SPACE):
            raise ValueError(f"pieces of this vocabulary cross pre-tokens: {piece!r}")
        word = piece.lstrip(SPACE)
        if piece == SPACE + word and len(sp.encode(word)) == 1 and word:
            spaced[word.encode()] = 1
        elif piece == word and len(sp.encode("\n" + word)) == 3:
            bare[word.encode()] = 1
    return spaced, bare


class Counts(dict):
    """Pre-token to number of tokens; merges what is not known yet, and remembers it."""

    def __init__(self, sp, known: dict[bytes, int], before: str, less: int):
        super().__init__(known)
        self.sp, self.known, self.before, self.less, self.bytes = sp, known, before, less, 0

    def __missing__(self, word: bytes) -> int:
        self.bytes += len(word) + 100
        n = self[word] = len(self.sp.encode(self.before + word.decode("utf-8", "replace"))) - self.less
        return n

    def held(self) -> None:
        if self.bytes > REMEMBERED_BYTES:
            self.bytes = 0
            self.clear()
            self.update(self.known)


def counter(model: bytes, spaced: dict[bytes, int], bare: dict[bytes, int]):
    """A function from UTF-8 bytes to the number of tokens."""
    import sentencepiece as spm

    sp = spm.SentencePieceProcessor(model_proto=model)
    after = Counts(sp, spaced, "", 0)  # the library sets one space before a text itself
    after[b""] = 1  # a space with nothing behind it
    after.known = after.known | {b"": 1}
    alone = Counts(sp, bare, "\n", 2)  # a space and a line feed stand before it
    alone[b""] = 0
    alone.known = alone.known | {b"": 0}
    newline = len(sp.encode("\n")) - 1

    def count(text: bytes) -> int:
        if not text:
            return 0
        lines = text.replace(SPACE.encode(), b" ").split(b"\n")
        lines[0] = b" " + lines[0]
        n = newline * (len(lines) - 1)
        for line in lines:
            if b"  " in line:
                for part in RUNS.findall(line):
                    n += after[part[1:]] if part[:1] == b" " else alone[part]
                continue
            first, *words = line.split(b" ")
            n += alone[first] + sum(map(after.__getitem__, words))
        after.held()
        alone.held()
        return n

    return count


def token_counts(docs: DataFrame, *, vocabulary: str, key: str = "doc_id", text: str = "text", limit: int = 4096) -> DataFrame:
    """``key, n_bytes, n_tokens, over_limit`` for every row.

    Tokens are those of the sentencepiece model at ``vocabulary``, whole texts, without begin,
    end or added special tokens. A null text counts as empty (0 tokens); repeated rows and null
    keys stay. No shuffle: one pass over two columns; a task remembers a bounded number of
    pre-tokens, whatever the length of a text.
    """
    sc = docs.sparkSession.sparkContext
    model = model_bytes(vocabulary)
    sent = sc.broadcast((model, *proven(model)))  # bounded by the vocabulary

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(*sent.value)
        for batch in batches:
            texts = code_bytes(batch, "__text")
            sizes = [len(t or b"") for t in texts]
            n = [count(t or b"") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("__key"), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["__key", "n_bytes", "n_tokens", "over_limit"])

    picked = docs.select(F.col(key).alias("__key"), F.col(text).cast("binary").alias("__text"))
    kind = docs.schema[key].dataType.simpleString()
    return map_texts(picked, counted, f"__key {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("__key", key)
