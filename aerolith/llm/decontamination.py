"""Benchmark decontamination as a prefix-filtered set join.

An item is cut into windows of ``size`` consecutive words (an item with fewer words, but not none, is one window). A
window's shingles are its pairs of neighbouring words (its word, if it has one only), ordered by rarity: how often
they occur in all documents. For exact containment the necessary prefix of a window is its rarest shingle: a document
without it can't contain the window. Documents are joined with these prefix shingles; each match gives the place
where the window would have to start, which must lie inside the document with room for the window's length; the words
there are then compared one by one.

The windows of one block of items (at most ``block_windows``, a stated query set) are sent to all tasks; a larger
benchmark takes several blocks, each against all documents, and the findings are united.

Null texts have no words, items without words have no windows; windows of items without id are searched and hit like all
others, only the list of ids lacks them; repeated items give their windows once more for the same id only, empty tables give no findings. Columns other than id and text are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import folded_words, ship, small_batches, stored

#: Texts are worked on in parts of about so many bytes.
BATCH_BYTES = 4_000_000

class Windows:
    """Windows of a block of items as arrays of word ids, and the shingles that occur in them."""

    def __init__(self, items: list[tuple[str | None, str]], size: int):
        self.vocab: dict[bytes, int] = {}
        of: dict[tuple, set] = defaultdict(set)
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab)) for w in folded_words(text)]
            for i in range(max(1, len(ids) - size + 1) if ids else 0):
                of[tuple(ids[i : i + size])].add(item)
        self.words = list(of)
        self.items = [sorted(x - {None}) for x in of.values()]
        self.base = len(self.vocab) + 1
        #: A pair's key is first * base + second + 1; a single word's is word * base.
        self.shingles = np.unique(np.array([k for w in self.words for k in self.keys(w)], np.int64))

    def keys(self, w: tuple) -> list[int]:
        return [a * self.base + b + 1 for a, b in zip(w, w[1:])] or [w[0] * self.base]

    def plan(self, counts: dict[int, int]) -> None:
        """Chooses each window's prefix shingle, the rarest, and orders windows by it."""
        order = []
        for k, w in enumerate(self.words):
            key, at = min(((s, i) for i, s in enumerate(self.keys(w))), key=lambda x: (counts.get(x[0], 0), x))
            order.append((key, k, at))
        order.sort()
        self.prefix = np.array([x[0] for x in order], np.int64)
        self.window = np.array([x[1] for x in order], np.int64)
        self.offset = np.array([x[2] for x in order], np.int64)
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.longest = int(self.length.max()) if len(order) else 1
        self.ids = np.full((len(self.words), self.longest), -3, np.int64)
        for k, w in enumerate(self.words):
            self.ids[k, : len(w)] = w
        self.singles = bool((self.length == 1).any())
        self.unique = np.unique(self.prefix)

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word ids of a batch (-1: in no item), each document's first place, its number of words."""
        words = [folded_words(t) for t in texts]
        n = np.array([len(w) for w in words], np.int64)
        get = self.vocab.get
        ids = np.fromiter((get(w, -1) for w in chain.from_iterable(words)), np.int64, int(n.sum()))
        return ids, np.cumsum(n) - n, n

    def pairs(self, ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and keys of the shingles of known words; pairs stay inside a document."""
        last = np.zeros(len(ids), bool)
        last[(start + n - 1)[n > 0]] = True
        at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0) & ~last[:-1]) if len(ids) else np.zeros(0, np.int64)
        return at, ids[at] * self.base + ids[at + 1] + 1

    def find(self, ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, place and window of each occurrence of a window in the batch."""
        at, keys = self.pairs(ids, start, n)
        if self.singles:
            one = np.flatnonzero(ids >= 0)
            at, keys = np.concatenate([at, one]), np.concatenate([keys, ids[one] * self.base])
        near = np.searchsorted(self.unique, keys)
        good = np.flatnonzero(self.unique[np.minimum(near, len(self.unique) - 1)] == keys) if len(self.unique) else near[:0]
        at, keys = at[good], keys[good]
        lo, hi = np.searchsorted(self.prefix, keys), np.searchsorted(self.prefix, keys, "right")
        many = hi - lo
        found = []
        # so many candidate places are compared at a time
        cuts = np.searchsorted(np.cumsum(many), np.arange(1, int(many.sum()) // 200_000 + 1) * 200_000)
        for part in np.split(np.arange(len(at)), cuts):
            m = many[part]
            row = np.repeat(lo[part], m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            w = self.window[row]
            first = np.repeat(at[part], m) - self.offset[row]
            doc = np.searchsorted(start + n, np.repeat(at[part], m), "right")
            ok = (first >= start[doc]) & (first + self.length[w] <= start[doc] + n[doc])  # bounds on place and length
            w, first, doc = w[ok], first[ok], doc[ok]
            for j in range(self.longest):
                same = (self.length[w] <= j) | (ids[np.minimum(first + j, len(ids) - 1)] == self.ids[w, j])
                w, first, doc = w[same], first[same], doc[same]
            found.append((doc, first, w))
        return tuple(np.concatenate(x) for x in zip(*found))


def counted(windows: Windows, docs: DataFrame, text_col: str) -> dict[int, int]:
    """Occurrences of the windows' shingles in all documents: one row per shingle and task, then summed."""

    def run(batches):
        total = np.zeros(len(windows.shingles), np.int64)
        for b in small_batches(batches, "text_", BATCH_BYTES):
            ids, start, n = windows.encode(b.column(0).to_pylist())
            keys = np.concatenate([windows.pairs(ids, start, n)[1], ids[ids >= 0] * windows.base])
            near = np.minimum(np.searchsorted(windows.shingles, keys), max(0, len(total) - 1))
            total += np.bincount(near[windows.shingles[near] == keys], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(windows.shingles[at]), pa.array(total[at])], ["key", "n"])

    if not len(windows.shingles):
        return {}
    rows = docs.select(F.col(text_col).alias("text_")).mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return {r.key: r.n for r in rows.toLocalIterator()}  # no more rows than shingles of one block


def search(windows: Windows, rows: DataFrame, more: bool) -> DataFrame:
    """Adds a block's findings to the rows (id_, text_, and spans and items of earlier blocks); more: text_ stays."""
    sent = rows.sparkSession.sparkContext.broadcast(windows)  # at most one block of windows

    def run(batches):
        windows = sent.value
        for b in small_batches(batches, "text_", BATCH_BYTES):
            ids, start, n = windows.encode(b.column("text_").to_pylist())
            doc, first, w = windows.find(ids, start, n) if len(windows.words) else (np.zeros(0, np.int64),) * 3
            step = np.zeros(len(ids) + 1, np.int64)
            np.add.at(step, first, 1)
            np.add.at(step, first + windows.length[w] if len(w) else first, -1)
            items: dict[int, set] = defaultdict(set)
            for d, x in set(zip(doc.tolist(), w.tolist())):
                items[d].update(windows.items[x])
            if "items" in b.schema.names:
                for i, (lo, hi, known) in enumerate(zip(*(b.column(c).to_pylist() for c in ("hit_from", "hit_to", "items")))):
                    items[i].update(known)
                    np.add.at(step, start[i] + np.array(lo, np.int64), 1)
                    np.add.at(step, start[i] + np.array(hi, np.int64), -1)
            hit = np.concatenate([[0], (np.cumsum(step)[:-1] > 0).astype(np.int8), [0]])
            edge = np.diff(hit)
            cuts = start[n > 0]
            inside = cuts[(hit[cuts] > 0) & (hit[cuts + 1] > 0)]  # a span ends with its document
            edge_from, edge_to = (np.sort(np.concatenate([np.flatnonzero(edge == k), inside])) for k in (1, -1))
            cut = np.searchsorted(np.searchsorted(start + n, edge_from, "right"), np.arange(len(n) + 1))
            spans = [[(e[cut[i] : cut[i + 1]] - start[i]).tolist() for i in range(len(n))] for e in (edge_from, edge_to)]
            out = {"id_": b.column("id_"), "n_words": pa.array(n)} | {c: pa.array(x, pa.list_(pa.int32())) for c, x in zip(("hit_from", "hit_to"), spans)}
            out["items"] = pa.array([sorted(items.get(i, ())) for i in range(len(n))], pa.list_(pa.string()))
            if more:
                out["text_"] = b.column("text_")
            yield pa.RecordBatch.from_pydict(out)

    kind = rows.schema["id_"].dataType.simpleString()
    return rows.mapInArrow(run, f"id_ {kind}, n_words long, hit_from array<int>, hit_to array<int>, items array<string>" + ", text_ string" * more)


def find_contamination(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 10, block_windows: int = 500_000) -> DataFrame:
    """One row per document: id, n_words, hit_from/hit_to (hit word spans, end excluded), items (ids as strings)."""
    spark = docs.sparkSession
    ship(spark)
    items = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("text IS NOT NULL")
    # a word needs two bytes with what parts it from the next, so this bounds the number of windows
    bytes_ = items.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).alias("n")).first()["n"]
    n_blocks = int(bytes_ // 2 // block_windows) + 1
    rows = docs.select(F.col(id_col).alias("id_"), F.col(text_col).cast("string").alias("text_"))
    for k in range(n_blocks):
        block = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k)
        windows = Windows([(r.item, r.text) for r in block.toLocalIterator()], size)
        windows.plan(counted(windows, docs, text_col))
        more = k + 1 < n_blocks
        rows = search(windows, rows, more)
        if more:
            rows = stored(rows.drop("n_words"), "contamination")
    return rows.withColumnRenamed("id_", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The spans and items of ``find_contamination`` as counts and a hash of the sorted item ids."""
    n_hit = F.aggregate(F.zip_with("hit_to", "hit_from", lambda b, a: (b - a).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select(
        id_col, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )

