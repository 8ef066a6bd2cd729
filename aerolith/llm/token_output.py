"""Token-id files: texts encoded with a tokenizer, in document order, as range-coded segments, and their reader.

``write_token_files`` deals documents by ranges of the order, encodes every text and writes segments, one row each of a
Parquet table in a folder that all machines share (so that a lost or repeated task leaves no half file). A segment
holds whole documents, their ids and numbers of tokens, a header with the order-0 frequencies, and blocks of ids, each
with a checksum, each decodable without the others (see ``range_coder``). ``read_documents`` decodes the segments.

Texts are cut before each space and around each line break: the tokenizer's pattern starts a new pre-token there, so the
ids of the pieces, joined, are the ids of the text. Pieces seen before come from a memory of bounded size, all others go
through the library, words of letters through its merges, others as lines of one text; a mark that ends a piece after a
letter or digit is a pre-token of its own. Texts with longer runs of white space, with white space of other kinds beside a cut, or with a special mark
go through the library whole.

Null texts count as empty and have only the end id; empty tables give no segments; documents of the same id stay in the
order of their texts. Columns other than id, text and the order are ignored.
"""

from __future__ import annotations

import zlib
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, kept_in_process, let_go, null_to_empty, shared_dir, ship, small_batches
from .range_coder import CorruptBlock, decode, encode

#: Ids in a segment, at least, unless a task's documents end; ids in a block; pieces remembered by a process.
SEGMENT_IDS = 6_000_000
BLOCK_IDS = 1024
#: ... and their characters, whatever their number.
REMEMBERED, REMEMBERED_CHARS = 500_000, 16_000_000
#: Pieces whose ids are put together at once.
GATHERED = 1 << 16

SEGMENT = "part int, segment int, first long, doc_ids array<{}>, n_tokens array<long>, list_check long, header binary, blocks array<binary>"


#: Marks that end a piece after a letter or digit are pre-tokens of their own.
END_MARKS = ".,;:!?"
#: Kinds of pieces: none, with a space before, a lone space or line break, only right in its whole text.
PLAIN, SPACED, BLANK, BOUND = range(4)


def kind_of(piece: str) -> int:
    x = piece[1:] if piece[:1] == " " else piece
    if not x.isalnum():
        if piece in (" ", "\n"):
            return BLANK
        if not x or x[0].isspace() or x[-1].isspace() or "<|" in x:
            return BOUND
    return PLAIN if x is piece else SPACED


def marked(piece: str) -> bool:
    """Whether a mark ends the piece that is a pre-token by itself."""
    return piece[-1] in END_MARKS and piece[-2:-1].isalnum() and "<|" not in piece


def byte_letters() -> str:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(rest)) for b in range(256))


LETTERS = byte_letters()
SPACE_LETTER = LETTERS[32]


def in_letters(text: str) -> str:
    return text.encode().decode("latin-1").translate(LETTERS)


def grown(x: np.ndarray, size: int) -> np.ndarray:
    return x if size <= len(x) else np.concatenate([x, np.zeros(max(len(x), size - len(x)), x.dtype)])


class Pieces:
    """Ids of pieces of text, remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        # the same merges over words in the vocabulary's letters, parted by a line break's letter
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = CharDelimiterSplit(LETTERS[10])
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for t, i in vocabulary.items() if t[0] == SPACE_LETTER]] = True
        self.line_break = self.tokenizer.encode("\n", add_special_tokens=False).ids
        if len(self.line_break) != 1:
            raise ValueError("a line break must be a token")
        if self.tokenizer.normalizer is not None or "ByteLevel" not in str(self.tokenizer.pre_tokenizer):
            raise ValueError("a byte-level tokenizer without normalizer is needed")
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.flat, self.used = np.zeros(1 << 20, np.uint32), 0
        self.count, self.start, self.kind, self.uses = (np.zeros(1 << 16, x) for x in (np.int32, np.int64, np.int8, np.int32))

    def forget(self) -> None:
        """Only pieces of two batches or more stay, with one of these to their credit; none if these are many themselves."""
        pieces = list(self.index)
        keep = np.flatnonzero(self.uses[: len(pieces)] > 1)
        ids, n, kinds = self.gather(keep), self.count[keep], self.kind[keep]
        pieces = [pieces[i] for i in keep.tolist()]
        self.clear()
        if 2 * len(pieces) <= REMEMBERED and 2 * sum(map(len, pieces)) <= REMEMBERED_CHARS:
            self.put(pieces, kinds, ids, n)
            self.uses[: len(pieces)] = 1

    def put(self, pieces: list[str], kinds, ids: np.ndarray, n: np.ndarray) -> None:
        k = len(self.index)
        self.flat = grown(self.flat, self.used + len(ids))
        self.count, self.start, self.kind, self.uses = (grown(x, k + len(n)) for x in (self.count, self.start, self.kind, self.uses))
        self.flat[self.used : self.used + len(ids)] = ids
        self.count[k : k + len(n)] = n
        self.start[k : k + len(n)] = self.used + np.cumsum(n) - n
        self.kind[k : k + len(n)] = kinds
        self.used += len(ids)
        self.chars += sum(map(len, pieces))
        self.index.update(zip(pieces, range(k, k + len(n))))

    def merge(self, pieces: list[str]) -> None:
        """New pieces through the library. A word of letters is one pre-token, so its merges are all that is needed, and those
        with a space before go together, as only a word's first token begins with the space's letter; other pieces are lines
        of one text, as a line break between two of them is a token; blanks and the like go by themselves."""
        plain, accented, bare, lines, odd, merges = [], [], [], [], [], self.tokenizer.model.tokenize
        for p in pieces:
            x = p[1:] if p[0] == " " else p
            if x.isalpha() and (x.isascii() or max(x) < "\u0530"):
                (bare if x is p else plain if x.isascii() else accented).append(p)
            else:
                (lines if kind_of(p) < BLANK else odd).append(p)
        for words in (plain, accented):
            for i in range(0, len(words), 20_000):
                some = words[i : i + 20_000]
                text = LETTERS[10].join(some).replace(" ", SPACE_LETTER) if words is plain else in_letters("\n".join(some))
                ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
                first = np.flatnonzero(self.begins[ids])
                if len(first) != len(some):
                    raise ValueError("the tokenizer doesn't begin each word with its space")
                self.put(some, SPACED, ids, np.diff(first, append=len(ids)))
        ids = [[t.id for t in merges(in_letters(x))] for x in bare]
        self.put(bare, PLAIN, np.fromiter(chain.from_iterable(ids), np.uint32), np.array([len(x) for x in ids], np.int64))
        for i in range(0, len(lines), 20_000):
            some = lines[i : i + 20_000]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(ids == self.line_break[0])
            n = np.diff(at, prepend=-1, append=len(ids)) - 1
            if len(n) != len(some):
                raise ValueError("the tokenizer doesn't part its text at line breaks")
            self.put(some, list(map(kind_of, some)), np.delete(ids, at), n)
        ids = [x.ids for x in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)]
        self.put(odd, list(map(kind_of, odd)), np.fromiter(chain.from_iterable(ids), np.uint32), np.array([len(x) for x in ids], np.int64))

    def gather(self, at: np.ndarray) -> np.ndarray:
        """Their ids, joined; what that needs besides doesn't grow with the pieces."""
        out, done = np.zeros(int(self.count[at].sum(dtype=np.int64)), np.uint32), 0
        for i in range(0, len(at), GATHERED):
            n = self.count[at[i : i + GATHERED]].astype(np.int64)
            end = np.cumsum(n)
            out[done : done + end[-1]] = self.flat[np.repeat(self.start[at[i : i + GATHERED]] - (end - n), n) + np.arange(end[-1])]
            done += end[-1]
        return out

    def find(self, pieces: list[str]) -> np.ndarray:
        """Numbers of different pieces."""
        known = self.index
        at = np.fromiter(map(known.get, pieces, repeat(-1)), np.int64, len(pieces))
        gone = np.flatnonzero(at < 0)
        if len(gone):
            new = [pieces[i] for i in gone.tolist()]
            ended, whole = [], dict.fromkeys(m for m in END_MARKS if m not in known)
            for p in new:
                if p[-1] in END_MARKS and marked(p):
                    ended.append(p)
                    if p[:-1] not in known:
                        whole[p[:-1]] = None
                else:
                    whole[p] = None
            self.merge(list(whole))
            ended = [p for p in ended if p not in known]
            parts = np.fromiter((known[x] for p in ended for x in (p[:-1], p[-1])), np.int64, 2 * len(ended))
            self.put(ended, self.kind[parts[::2]], self.gather(parts), self.count[parts].reshape(-1, 2).sum(1))
            at[gone] = np.fromiter(map(known.__getitem__, new), np.int64, len(new))
        self.uses[at] += 1
        return at

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and how many each has."""
        if len(self.index) > REMEMBERED or self.chars > REMEMBERED_CHARS:
            self.forget()
        odd = pc.match_substring(texts, "\0")
        cut = pc.replace_substring(pc.replace_substring(pc.if_else(odd, "", texts), " ", "\0 "), "\n", "\0\n\0")
        lists = pc.split_pattern(cut, "\0")
        flat = lists.flatten().dictionary_encode()
        own = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        words, place = flat.dictionary.to_numpy(zero_copy_only=False).tolist(), flat.indices.to_numpy()
        del cut, lists, flat
        if "" in words:  # no piece
            none = words.index("")
            words[none] = " "
            filled = place != none
            place, own = place[filled], own[filled]
        at = self.find(words)[place]
        kind = self.kind[at]
        tied = odd.to_numpy(zero_copy_only=False)
        tied[own[kind == BOUND]] = True
        # three blanks in a row, or two at the end of a text, belong together
        two = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] == BLANK) & (own[:-1] == own[1:]))
        after = np.minimum(two + 2, len(at) - 1)
        last = (two + 2 >= len(at)) | (own[after] != own[two]) if len(at) else two.astype(bool)
        tied[own[two[last | (kind[after] != PLAIN)]]] = True
        ids = self.gather(at)
        by_text = np.bincount(own, self.count[at], len(texts)).astype(np.int64)
        if tied.any():  # these go to the library whole
            parts = np.split(ids, np.cumsum(by_text)[:-1])
            whole = np.flatnonzero(tied)
            for i in whole.tolist():  # one by one, as the library's result has some hundred bytes a token
                parts[i] = np.array(self.tokenizer.encode_batch_fast([texts[i].as_py()], add_special_tokens=False)[0].ids, np.uint32)
                by_text[i] = len(parts[i])
            ids = np.concatenate(parts)
        out = np.full(len(ids) + len(texts), end_id, np.uint32)
        mine = np.ones(len(out), bool)
        mine[np.cumsum(by_text + 1) - 1] = False
        out[mine] = ids
        return out, by_text + 1


def list_check(doc_ids: list, n_tokens: np.ndarray) -> int:
    """Checksum of a segment's documents and numbers of tokens."""
    return zlib.crc32("\0".join(map(str, doc_ids)).encode("utf-8", "surrogatepass"), zlib.crc32(n_tokens.astype("<i8").tobytes()))


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None, end_id: int = 0) -> None:
    """Writes the documents' ids to ``path``, in the order of the given columns (the id)."""
    ship(docs.sparkSession)
    keys = [F.col(c).alias(f"key{i}") for i, c in enumerate(order or [id_col])]
    names = [f"key{i}" for i in range(len(keys))]
    rows = docs.select(*keys, F.col(id_col).alias("id_"), null_to_empty(text_col).alias("text_"))
    rows = rows.repartitionByRange(*names).sortWithinPartitions(*names, "text_").select("id_", "text_")
    kind = docs.schema[id_col].dataType.simpleString()
    id_type = docs.select(id_col).limit(0).toArrow().schema.field(0).type

    def run(batches):
        from pyspark import TaskContext

        from aerolith.llm.token_output import BLOCK_IDS, SEGMENT_IDS, Pieces, encode, list_check

        part, segment, first = TaskContext.get().partitionId(), 0, 0
        pieces = kept_in_process(("pieces", tokenizer_path), lambda: Pieces(tokenizer_path))
        held: list[tuple] = []

        def flush():
            nonlocal segment, first
            doc_ids, n_tokens = list(chain.from_iterable(x[0] for x in held)), np.concatenate([x[2] for x in held])
            ids, at = np.empty(int(n_tokens.sum()), np.uint32), 0
            held.reverse()
            while held:  # each part goes as soon as it is copied
                one = held.pop()[1]
                ids[at : at + len(one)] = one
                at += len(one)
            give_back()
            header, blocks = encode(ids, BLOCK_IDS)
            row = {"part": [part], "segment": [segment], "first": [first], "doc_ids": [doc_ids], "n_tokens": [n_tokens], "list_check": [list_check(doc_ids, n_tokens)], "header": [header], "blocks": [blocks]}
            segment, first = segment + 1, first + len(ids)
            del ids, one
            return pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("doc_ids", pa.list_(id_type)), ("n_tokens", pa.list_(pa.int64())), ("list_check", pa.int64()), ("header", pa.binary()), ("blocks", pa.list_(pa.binary()))]))

        for b in small_batches(batches, "text_", 4_000_000):
            held.append((b.column("id_").to_pylist(), *pieces.encode(b.column("text_"), end_id)))
            if sum(len(x[1]) for x in held) >= SEGMENT_IDS:
                yield flush()
        if held:
            yield flush()

    rows.mapInArrow(run, SEGMENT.format(kind)).write.option("compression", "uncompressed").parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, of each document, from the files."""
    files = spark.read.parquet(path)
    kind = files.schema["doc_ids"].dataType.elementType
    id_type = files.select(F.col("doc_ids")[0]).limit(0).toArrow().schema.field(0).type
    # a row for each part that was written, so no more than its tasks
    parts = files.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda s, n: s + n)).alias("n"))
    before = dict(_running((r.part, r.n) for r in parts.orderBy("part").toLocalIterator()))
    base = spark.sparkContext.broadcast(before)

    def run(batches):
        let_go()  # all has been encoded
        for b in batches:
            for i in range(b.num_rows):  # one by one, as a segment has millions of ids
                r = b.slice(i, 1).to_pylist()[0]
                ids = decode(r["header"], r["blocks"]).astype("<u4", copy=False)
                n = np.array(r["n_tokens"], np.int64)
                if list_check(r["doc_ids"], n) != r["list_check"] or int(n.sum()) != len(ids):
                    raise CorruptBlock("the documents of a segment")
                end = np.cumsum(n)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(end.tolist(), n.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(r["doc_ids"], id_type), pa.array(base.value[r["part"]] + r["first"] + end - n), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.select("part", "first", "doc_ids", "n_tokens", "list_check", "header", "blocks").mapInArrow(run, f"doc_id {kind.simpleString()}, start long, n_tokens long, ids_crc32 long")


def _running(parts):
    total = 0
    for part, n in parts:
        yield part, total
        total += n


def encode_documents(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Writes the files to a new folder beside the checkpoints and returns what reading them gives."""
    import uuid

    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer_path, **options)
    return read_documents(spark, path)
