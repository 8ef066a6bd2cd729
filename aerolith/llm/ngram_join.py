"""N-gram Jaccard self-join: near copies among documents, by the sets of their word shingles.

1. Every text becomes the set of its ``SHINGLE`` consecutive words (a text with fewer words, but not none, is one
   shingle). Texts with equal sets are one node from here on, with the number of its copies.
2. A MinHash LSH forest finds candidates: each of ``TREES`` trees is a prefix trie of signatures of ``DEEP`` values, held as
   the hashes of its prefixes. Matching begins with whole signatures, and matched prefixes are shortened value by value.
   At depth d, a pair of similarity s is missed by all trees with probability (1 - s**d) ** TREES. A text leaves the
   forest at the first depth where this meets the target recall for the lowest similarity that a different set of its
   size can have to it, at or above the threshold; the shorter a text, the sooner (sets of 3 have no such partner). A
   pair thus meets at the depth where the first of the two leaves. No trie node is capped.
3. With whole signatures, and again at the last depth, the members of a trie node that aren't yet in one class with its
   smallest member are compared with that exactly; the links found join classes. So classes hold verified links only, and
   nodes whose members are of one class need no more work. At every depth where texts leave, members of different classes in a trie node are compared with each other
   in blocks of bounded size, so that every pair that meets has been compared or is in one class.
4. Classes are cut into blocks; each pair of blocks of a class is compared exactly in one task, by matrix products over
   shingles. A task returns, for each text, how many documents it is linked with, never the pairs. Links between all texts
   of a class are found, whatever brought them together. Texts that no links connect are never compared across a class.

A document's class is the smallest id in it. Its links are the other documents of similarity at or above the threshold,
copies among them counted singly. Null and wordless texts have no links and are alone. Repeated rows are copies.
Documents with a null id take part; a class of such documents only has a null id. Other columns are ignored.

Work that remains quadratic: counting the links of a class of m different texts compares its block pairs, in
(m / BLOCK_TEXTS) ** 2 / 2 tasks of bounded size, each text going to m / BLOCK_TEXTS of them. Likewise members of
different classes in one trie node.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, folded_words, null_to_empty, ship, small_batches, stored
from ..operators.components import connected_components

SHINGLE = 5
#: Similarity as a fraction, so that comparisons are exact: 4 / 5.
THRESHOLD = (4, 5)
#: Trees of the forest, values of a whole signature in each.
TREES, DEEP = 24, 9
TARGET_RECALL = 0.999
#: Texts and shingles of a block, about.
BLOCK_TEXTS, BLOCK_SHINGLES = 256, 400_000
#: The filter that spares texts in no candidate group a shuffle has 16 bits for each key and this size at most (16 MB);
#: with more keys the texts are joined without it.
MOST_BITS = 1 << 27
#: Keys remembered by a task, so that it sends the text of copies once.
REMEMBERED = 500_000
MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def stop_depth(threshold: tuple[int, int] = THRESHOLD, trees: int = TREES, recall: float = TARGET_RECALL, s: float | None = None) -> int:
    """Shortens prefixes from DEEP values on until a pair of this similarity (else: at the threshold) is found in some
    tree with the target recall."""
    s, d = threshold[0] / threshold[1] if s is None else s, DEEP
    while d > 1 and 1 - (1 - s**d) ** trees < recall:
        d -= 1
    return d


def lowest_similarity(n: int, threshold: tuple[int, int] = THRESHOLD) -> float | None:
    """Lowest similarity, at or above the threshold, that a set of n has to a different set; none: no such set."""
    num, den = threshold
    best = None
    for m in range(-(-n * num // den), n * den // num + 1):
        c = -(-num * (n + m) // (num + den))  # least common part that meets the threshold
        if c <= min(n, m) and not c == n == m and (best is None or c / (n + m - c) < best):
            best = c / (n + m - c)
    return best


def stop_depths(threshold: tuple[int, int], trees: int, recall: float, most: int = 64) -> list[int | None]:
    """Depth at which texts leave, by the size of their sets up to ``most``; larger ones stay to that of the threshold."""
    low = [lowest_similarity(n, threshold) if n else None for n in range(most + 1)]
    return [None if s is None else stop_depth(threshold, trees, recall, s) for s in low]


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the set of a text's shingles."""
    words = folded_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    g = np.full(n, min(len(h), size), np.uint64)
    for k in range(min(size, len(h))):
        x = h[k : k + n] * MULTIPLY[k % 5]
        g = (g ^ x ^ (x >> np.uint64(31))) * MULTIPLY[(k + 1) % 5]
    return np.unique(g ^ (g >> np.uint64(32)))


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed numbers."""
    return tuple(np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64).tolist())


class Forest:
    """Signatures of a forest, ``trees * DEEP`` minima, and the hashes of their prefixes from ``depth`` to DEEP values."""

    def __init__(self, trees: int, depth: int):
        self.trees, self.depth = trees, depth
        rng = np.random.default_rng(20_240_229)
        self.factor = rng.integers(0, 2**63, trees * DEEP, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.tree = np.arange(trees, dtype=np.uint64) + np.uint64(1)

    def minima(self, s: np.ndarray) -> np.ndarray:
        low = np.full(len(self.factor), np.uint64(2**64 - 1))
        for i in range(0, len(s), 2048):
            np.minimum(low, np.multiply.outer(self.factor, s[i : i + 2048]).min(1), out=low)
        return low

    def prefixes(self, sets: list[np.ndarray]) -> np.ndarray:
        """A row for each set: for each depth from the shortest on, a hashed prefix for each tree."""
        low = np.stack([self.minima(s) for s in sets]) if sets else np.zeros((0, len(self.factor)), np.uint64)
        value = low.reshape(len(sets), self.trees, DEEP)
        h, out = np.broadcast_to(self.tree * MULTIPLY[0], value.shape[:2]), []
        for d in range(DEEP):
            x = (value[:, :, d] ^ (value[:, :, d] >> np.uint64(29))) * MULTIPLY[1]
            h = (h ^ x ^ (x >> np.uint64(32))) * MULTIPLY[2]
            if d + 1 >= self.depth:
                out.append((h ^ (h >> np.uint64(31))).view(np.int64))
        return np.concatenate(out, 1)


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int, depth: int, trees: int) -> DataFrame:
    """id_, text_hash, k1, k2 (the set's key; null: no words), n (shingles), prefixes (for each depth, one for each tree)."""
    forest = Forest(trees, depth)
    width = trees * (DEEP - depth + 1)

    def run(batches):
        for b in small_batches(batches, "text_", 2_000_000):
            sets = [shingles(t, size) for t in b.column("text_").to_pylist()]
            some = {set_key(s): s for s in sets if len(s)}
            place = dict(zip(some, range(len(some))))
            keys = [set_key(s) if len(s) else (None, None) for s in sets]
            at = np.array([place.get(k, -1) for k in keys], np.int64)
            flat = forest.prefixes(list(some.values()))[at[at >= 0]].ravel()
            offsets = np.concatenate([[0], np.cumsum((at >= 0) * width)]).astype(np.int32)
            prefixes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            k1, k2 = (pa.array([k[i] for k in keys], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column("id_"), b.column("text_hash"), k1, k2, pa.array([len(s) for s in sets], pa.int32()), prefixes], ["id_", "text_hash", "k1", "k2", "n", "prefixes"])

    rows = docs.select(F.col(id_col).alias("id_"), null_to_empty(text_col).alias("text_")).withColumn("text_hash", F.xxhash64("text_"))
    return rows.mapInArrow(run, f"id_ {docs.schema[id_col].dataType.simpleString()}, text_hash long, k1 long, k2 long, n int, prefixes array<long>")


def trie_rows(sets: DataFrame, depth: int, shortest: int, trees: int) -> DataFrame:
    """prefix and the other columns of the sets that are still in the forest at this depth, for each tree."""
    level = F.slice("prefixes", (depth - shortest) * trees + 1, trees)
    return sets.where(F.col("stop") <= depth).withColumn("prefix", F.explode(level)).drop("prefixes")


def pieces(count: Column, shingle_count: Column) -> Column:
    """Number of blocks for so many texts and shingles."""
    return F.greatest(F.ceil(count / BLOCK_TEXTS), F.ceil(shingle_count / BLOCK_SHINGLES)).cast("int")


def star_tasks(rows: DataFrame) -> DataFrame:
    """group, i, j, node, block: in each trie node, its smallest member (block -1) against blocks of the members of other
    classes; each such pair once, whatever the number of trie nodes. rows: prefix, node, class, n."""
    tries = rows.groupBy("prefix").agg(F.min(F.struct("node", "class", "n")).alias("low"), F.min("class").alias("a"), F.max("class").alias("b")).where("a < b")
    pairs = rows.join(tries.select("prefix", "low"), "prefix").where("class <> low.class")
    pairs = pairs.groupBy(F.col("low.node").alias("group"), "node").agg(F.first("n").alias("n"))
    sizes = pairs.groupBy("group").agg(pieces(F.count("*"), F.sum("n")).alias("blocks"))
    pairs = pairs.join(sizes, "group").select("group", "node", F.pmod(F.xxhash64("node"), F.col("blocks")).alias("j"), F.lit(-1).cast("long").alias("i"))
    center = pairs.select("group", "i", "j").distinct().select("*", F.col("group").alias("node"), F.col("i").alias("block"))
    return center.unionByName(pairs.select("group", "i", "j", "node", F.col("j").alias("block")))


def cross_tasks(rows: DataFrame, depth: int) -> DataFrame:
    """group, i, j, node, block: in each trie node that a text leaves at this depth, members of different classes against
    each other. A class of many members has blocks of its own, which aren't compared among themselves; small classes are
    dealt whole to common blocks. rows: prefix, node, class, n, stop."""
    tries = rows.groupBy("prefix").agg(F.min("class").alias("a"), F.max("class").alias("b"), F.max("stop").alias("last")).where((F.col("a") < F.col("b")) & (F.col("last") == depth)).select("prefix")
    rows = rows.join(tries, "prefix").select("prefix", "node", "class", "n")
    classes = rows.groupBy("prefix", "class").agg(F.count("*").alias("m"), F.sum("n").alias("n")).withColumn("own", pieces(F.col("m"), F.col("n")))
    small = classes.where("own = 1").groupBy("prefix").agg(pieces(F.sum("m"), F.sum("n")).alias("common"))
    classes = classes.join(small, "prefix", "left").select("prefix", "class", "own", "common")
    # common blocks have numbers from 0 on, those of a large class follow its hash
    base = (F.pmod(F.xxhash64("class"), F.lit(1 << 30)) + 1) * (1 << 32)
    block = F.when(F.col("own") == 1, F.pmod(F.xxhash64("class"), F.col("common"))).otherwise(base + F.pmod(F.xxhash64("node"), F.col("own")))
    rows = rows.join(classes, ["prefix", "class"]).select("prefix", "node", block.alias("block"), F.when(F.col("own") > 1, F.col("class")).alias("only"))
    blocks = rows.groupBy("prefix", "block").agg(F.max("only").alias("only"), F.countDistinct("only").alias("k"))
    x, y = blocks.alias("x"), blocks.alias("y")
    apart = F.coalesce(F.col("x.only") != F.col("y.only"), F.lit(True)) | (F.col("x.k") > 1) | (F.col("y.k") > 1)
    pairs = x.join(y, (F.col("x.prefix") == F.col("y.prefix")) & (F.col("x.block") <= F.col("y.block"))).where(apart)
    pairs = pairs.select(F.col("x.prefix").alias("prefix"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    sides = pairs.withColumn("block", F.explode(F.array_distinct(F.array("i", "j"))))
    return sides.join(rows, ["prefix", "block"]).select(F.col("prefix").alias("group"), "i", "j", "node", "block")


def compare(left: list[np.ndarray], right: list[np.ndarray], threshold: tuple[int, int]) -> np.ndarray:
    """Whether each pair reaches the threshold, exactly."""
    num, den = threshold
    n = [np.array([len(s) for s in x], np.int64) for x in (left, right)]
    flat = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), np.concatenate(n))
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column)[column] > 1  # a shingle of one text alone is in no intersection
    column, owner = np.unique(column[often], return_inverse=True)[1], owner[often]
    common = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, int(column.max()) + 1 if len(column) else 0, 4096):
        some = (column >= at) & (column < at + 4096)
        m = np.zeros((len(left) + len(right), 4096), np.float32)
        m[owner[some], column[some] - at] = 1
        common += (m[: len(left)] @ m[len(left) :].T).astype(np.int64)
    return common * (num + den) >= num * (n[0][:, None] + n[1][None, :])


def smallest_reachable(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links: the smallest index each one reaches."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1, initial=len(label)))
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def compare_blocks(size: int, threshold: tuple[int, int]):
    def run(key, rows):
        _, i, j = (k.as_py() for k in key)
        seen: dict[int, tuple] = {}
        for node, k1, block, copies, text in zip(*(rows.column(c).to_pylist() for c in ("node", "k1", "block", "copies", "text"))):
            if node not in seen:
                s = shingles(text, size)
                if len(s) and set_key(s)[0] == k1:  # else another text of the same hash
                    seen[node] = s, block, copies
        nodes = sorted(seen)
        sets = [seen[k][0] for k in nodes]
        block, copies = (np.array([seen[k][c] for k in nodes], np.int64) for c in (1, 2))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        linked = np.zeros((len(nodes), len(nodes)), bool)
        if len(left) and len(right):
            linked[np.ix_(left, right)] = compare([sets[x] for x in left], [sets[x] for x in right], threshold)
        linked |= linked.T
        np.fill_diagonal(linked, False)
        links, root = linked @ copies, smallest_reachable(linked)
        out, nodes = np.flatnonzero(links), np.array(nodes, np.int64)
        return pa.table({"node": pa.array(nodes[out], pa.int64()), "links": pa.array(links[out], pa.int64()), "root": pa.array(nodes[root[out]], pa.int64())})

    return run


def places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """Four places of each 64-bit hash among the filter's bits."""
    u = h.view(np.uint64)
    return [((u ^ (u >> np.uint64(32))) * MULTIPLY[k] >> np.uint64(20)) & np.uint64(bits - 1) for k in range(4)]


def bloom_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """Bits that mark the hashes (one column, long), united from every task's own."""

    def run(batches):
        marks = np.zeros(bits, bool)
        for b in batches:
            for p in places(b.column(0).to_numpy(), bits):
                marks[p.astype(np.int64)] = True
        packed = np.packbits(marks, bitorder="little").view("<i8")
        at = np.flatnonzero(packed)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(packed[at])], ["word", "mask"])

    got = hashes.mapInArrow(run, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)  # no more rows than these came to the driver
    out[got.column("word").to_numpy()] = got.column("mask").to_numpy()
    return out.astype("<i8", copy=False).view(np.uint8)


def texts_of(docs: DataFrame, text_col: str, members: DataFrame) -> DataFrame:
    """text and members' columns for all different texts with the members' text_hash: copies come once, whatever their
    number. The filter spares the shuffle texts that have no member's hash; without it there are more of them, that's all."""
    rows = docs.select(null_to_empty(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    bits = max(1 << 12, 1 << (16 * members.count()).bit_length())
    if bits <= MOST_BITS:
        sent = docs.sparkSession.sparkContext.broadcast(bloom_filter(members.select("text_hash"), bits))

        def run(batches):
            marks, seen = sent.value, set()
            for b in batches:
                h = b.column("text_hash").to_numpy()
                ok = np.ones(len(h), bool)
                for p in places(h, bits):
                    ok &= (marks[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
                some = []
                for i in np.flatnonzero(ok).tolist():
                    if h[i] not in seen:
                        seen.add(h[i])
                        some.append(i)
                if len(seen) > REMEMBERED:
                    seen.clear()
                yield b.take(pa.array(some, pa.int64()))

        rows = rows.mapInArrow(run, "text string, text_hash long")
    return rows.dropDuplicates(["text_hash", "text"]).join(members, "text_hash")


def verified_classes(members: DataFrame, texts: DataFrame, *, size: int, threshold: tuple[int, int], shortest: int, trees: int) -> DataFrame:
    """node, class: what verified links between the forest's candidates connect. members: node, n, stop, prefixes."""
    classes = members.select("node", F.col("node").alias("class"))
    leaves = {r.stop for r in members.select("stop").distinct().collect()}  # DEEP at most

    def joined(tasks: DataFrame, classes: DataFrame) -> DataFrame:
        rows = tasks.join(texts, "node").select("group", "i", "j", "node", "k1", "block", "copies", "text")
        links = rows.groupBy("group", "i", "j").applyInArrow(compare_blocks(size, threshold), "node long, links long, root long")
        links = stored(links.select("node", "root").distinct(), "verified")
        if links.isEmpty():
            discard(links)
            return classes
        edges = classes.where("node <> class").select("node", F.col("class").alias("root")).unionByName(links)
        found = connected_components(edges, "node", "root")
        out = stored(members.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("class")), "classes")
        discard(links)
        return out

    for depth in range(DEEP, shortest - 1, -1):
        rows = lambda c, d=depth: trie_rows(members.join(c, "node"), d, shortest, trees)
        if depth in (DEEP, shortest):
            classes = joined(star_tasks(rows(classes)), classes)
        if depth in leaves:
            classes = joined(cross_tasks(rows(classes), depth), classes)
    return classes


def ngram_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, threshold: tuple[int, int] = THRESHOLD, trees: int = TREES, recall: float = TARGET_RECALL) -> DataFrame:
    """One row per document: id, class_id (smallest id of its class), n_links (other documents it is linked with)."""
    ship(docs.sparkSession)
    depth = stop_depth(threshold, trees, recall)
    leave = stop_depths(threshold, trees, recall)
    signed = stored(signatures(docs, id_col, text_col, size, depth, trees), "signatures")
    sets = signed.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(F.min("id_").alias("id_"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("text_hash").alias("text_hash"), F.first("prefixes").alias("prefixes"))
    # numbers given when the table is written stand for the sets from here on
    stop = F.coalesce(F.get(F.array(*(F.lit(100 if d is None else d) for d in leave)), F.col("n")), F.lit(depth))
    sets = stored(sets.withColumns({"node": F.monotonically_increasing_id(), "stop": stop}), "sets")
    # at the last depth most texts are alone in their trie nodes: only the others go on, and short ones, which leave before
    rows = trie_rows(sets.select("node", "stop", "prefixes"), depth, depth, trees)
    several = rows.groupBy("prefix").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("prefix")
    short = max((n * threshold[1] // threshold[0] for n, d in enumerate(leave) if d is not None and d > depth), default=0)
    some = rows.join(several, "prefix").select("node").unionByName(sets.where((F.col("stop") <= DEEP) & (F.col("n") <= short)).select("node")).distinct()
    members = stored(sets.join(some, "node").select("node", "k1", "text_hash", "copies", "n", "stop", "prefixes"), "members")
    texts = stored(texts_of(docs, text_col, members.select("node", "k1", "text_hash", "copies")).select("node", "k1", "copies", "text"), "texts")
    groups = verified_classes(members.select("node", "n", "stop", "prefixes"), texts, size=size, threshold=threshold, shortest=depth, trees=trees)
    groups = groups.join(members.select("node", "n"), "node").withColumnRenamed("class", "group")
    sizes = groups.groupBy("group").agg(F.count("*").alias("m"), pieces(F.count("*"), F.sum("n")).alias("blocks")).where("m > 1").drop("m")
    dealt = groups.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("n")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    pairs = texts.join(dealt, "node").select("*", other.alias("other")).select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "k1", "block", "copies", "text")
    found = stored(pairs.groupBy("group", "i", "j").applyInArrow(compare_blocks(size, threshold), "node long, links long, root long"), "links")
    # every link that made a class has been found again, so the classes are what these links connect
    classes = groups.select("node", F.col("group").alias("class"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = classes.join(links, "node").join(sets.select("node", "id_"), "node")
    lowest = linked.groupBy("class").agg(F.min("id_").alias("class_id"))
    known = sets.select("node", "k1", "k2", "copies", "id_").join(linked.join(lowest, "class").select("node", "links", "class_id"), "node", "left")
    known = known.select("k1", "k2", F.coalesce("class_id", "id_").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("id_", "k1", "k2").join(known, ["k1", "k2"], "left")
    alone = F.col("k1").isNull()
    return out.select(F.col("id_").alias(id_col), F.when(alone, F.col("id_")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents without near copies: of each class the one of the smallest id (once, if its row repeats).
    Rows without an id can't be told apart and stay."""
    found = ngram_join(docs, id_col=id_col, **options)
    kept = found.where(F.col(id_col) == F.col("class_id")).select(id_col).distinct()
    return docs.join(kept, id_col, "left_semi").dropDuplicates([id_col]).unionByName(docs.where(F.col(id_col).isNull()))
