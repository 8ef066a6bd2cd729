"""Token counts with a whole-token shortcut.

A sentencepiece BPE model merges neighbouring symbols into vocabulary pieces only. No piece of the model holds the
space mark after another character, so no merge crosses from a word into the space before the next one: the count of
a text is the sum of the counts of its pre-tokens (space marks and the characters up to the next space mark).
``whole_tokens`` proves, piece by piece with the library itself, which vocabulary strings encode alone as one token;
pre-tokens among these count 1 without any merging, and only the rest goes through the library (and is remembered).

Nulls count as empty texts, empty texts have no tokens, repeated rows give repeated rows, a null id stays null, an empty
table gives no rows, extra columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import null_to_empty, ship, small_batches

MARK = "▁"
#: Remembered counts of pre-tokens that are no whole tokens: so many, of so many characters in all (4 bytes each at most);
#: beyond either the memory starts afresh. Longer pre-tokens than LONGEST, which hardly recur, aren't remembered.
REMEMBERED, REMEMBERED_CHARS, LONGEST = 600_000, 8_000_000, 64
SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")


class Counts(dict):
    """Tokens of ``mark + key``: whole tokens are entered beforehand, others are merged by the library at first use."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.whole = whole_tokens(self.model)
        self.separable = separable(self.model)
        super().__init__(self.whole)
        self.chars = 0

    def __missing__(self, word: str) -> int:
        n = len(self.model.encode(word)) if word else 1
        if len(word) > LONGEST:
            return n
        if len(self) > REMEMBERED + len(self.whole) or self.chars > REMEMBERED_CHARS:
            self.clear()
            self.update(self.whole)
            self.chars = 0
        self[word] = n
        self.chars += len(word)
        return n

    def of(self, text: str) -> int:
        if not text:
            return 0
        if not self.separable:
            return len(self.model.encode(text))
        words = text.split(" ")
        if "" in words or MARK in text:
            words = [x[1:].replace(MARK, " ") for x in SEGMENT.findall(MARK + text.replace(" ", MARK))]
        return sum(map(self.__getitem__, words))


def whole_tokens(model) -> dict[str, int]:
    """Vocabulary strings, without their leading space mark, that the library encodes alone as exactly that one token."""
    pieces = [(i, p) for i in range(model.get_piece_size()) if (p := model.id_to_piece(i)).startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
    return {p[1:]: 1 for (i, p), ids in zip(pieces, model.encode([p[1:] for _, p in pieces], num_threads=1)) if ids == [i]}


def separable(model) -> bool:
    """Whether no piece joins another character with a space mark after it, and a lone space keeps its mark."""
    crossing = re.compile(f"[^{MARK}]{MARK}")
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i)))
    spaced = [model.encode(x, out_type=str) for x in ("a", "a ", "a  b")]
    return not any(crossing.search(p) for p in pieces) and all("".join(x) == MARK + t.replace(" ", MARK) for x, t in zip(spaced, ("a", "a ", "a  b")))


_LOADED: dict[str, Counts] = {}


def loaded(path: str) -> Counts:
    if path not in _LOADED:
        _LOADED[path] = Counts(path)
    return _LOADED[path]


def count_tokens(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id_"), null_to_empty(text_col).alias("text_"))
    rows = rows.withColumn("n_bytes", F.octet_length("text_").cast("long"))

    def run(batches):
        from aerolith.llm.token_counts import loaded

        of = loaded(model_path).of
        for b in small_batches(batches, "text_", 4_000_000):
            n = pa.array([of(t.as_py()) for t in b.column("text_")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id_"), b.column("n_bytes"), n], ["id_", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(run, f"id_ {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id_").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
