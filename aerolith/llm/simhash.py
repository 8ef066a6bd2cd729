"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Words are runs of anything but ASCII white space, A-Z lower-cased; a shingle is 4 words joined by spaces, repeats included
(a text of fewer words is one shingle). A bit of the fingerprint is 1 if it is set in over half of the shingles' XXH64
hashes (seed 42). Texts without words, and null, have fingerprint 0 and are linked like any other.

Two fingerprints within ``radius`` bits have a variant in common that is within half of that from both. So every
different fingerprint emits all variants within half the radius (2,081 of 64 bits for a radius of 4), variants are
shuffled, and fingerprints meet where they have the same one:

1. The shuffle's key is the variant's leading bits. A fingerprint goes to all prefixes within half the radius of its own
   (56 of 10 bits instead of 2,081 rows), and there emits the variants that have this prefix, with the flips it has left.
   It has ``LEAST_BITS``, or as many more as bring the mean to ``MEAN_ROWS`` rows; prefixes with more than ``MOST_ROWS`` are extended 8 bits at a
   time, up to whole variants, of which each has 2,081 fingerprints at most.
2. A task sorts the variants of its prefix, in parts of ``AT_ONCE`` at most. Fingerprints of one variant are linked to the
   smallest of them; pairs are deduplicated and verified by their differing bits. (The variants are sorted by a mix that
   leaves room for their owners; where that brings others together, all pairs of the few are compared.)
   A task returns, for each fingerprint, the smallest one that it reaches by these pairs: a row each, however many pairs.
3. Components of the links are those of the fingerprints; a component's id is its smallest document's.

Equal texts have equal fingerprints, so copies are one from the second step on. A null id takes part and is no smallest id
(a component of null ids only has none). An empty table gives no rows. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_counted, null_to_empty, ship, small_batches, stored
from ..operators.components import connected_components

SHINGLE, SEED, RADIUS = 4, 42, 4
LEAST_BITS, MEAN_ROWS, MOST_ROWS, DEEPER = 10, 25_000, 200_000, 8
AT_ONCE = 4_000_000
MIX = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    s, n = b" ".join(words), max(1, len(words) - size + 1)
    end = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begin = np.concatenate([[0], end[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(s[a:b], SEED) for a, b in zip(begin[:n].tolist(), end[len(words) - n :].tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 65_536):
        ones += np.unpackbits(h[i : i + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id_, fp (signed)."""

    def run(batches):
        for b in small_batches(batches, "text_", 2_000_000):
            fp = np.array([fingerprint(t) for t in b.column("text_").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id_"), pa.array(fp)], ["id_", "fp"])

    rows = docs.select(F.col(id_col).alias("id_"), null_to_empty(text_col).alias("text_"))
    return rows.mapInArrow(run, f"id_ {docs.schema[id_col].dataType.simpleString()}, fp long")


@lru_cache(maxsize=256)
def flips(bits: int, most: int) -> np.ndarray:
    """All masks of up to so many of the lowest bits."""
    out = [sum(1 << b for b in some) for k in range(most + 1) for some in combinations(range(bits), k)]
    return np.array(out, np.uint64)


def top(x: np.ndarray, bits: int) -> np.ndarray:
    return x >> np.uint64(64 - bits) if bits else np.zeros_like(x)


def extended(rows: DataFrame, bits: int, more: int, half: int) -> DataFrame:
    """prefix, fp with prefixes of ``bits + more`` bits from rows with prefixes of ``bits``: all within ``half`` flips."""
    masks = [flips(more, k) for k in range(half + 1)]

    def run(batches):
        for big in batches:
            for at in range(0, big.num_rows, 4096):
                b = big.slice(at, 4096)
                prefix, x = (b.column(c).to_numpy().view(np.uint64) for c in ("prefix", "fp"))
                used = np.bitwise_count(top(x, bits) ^ prefix)
                longer = (prefix << np.uint64(more)) | (top(x, bits + more) & np.uint64((1 << more) - 1))
                for k in range(half + 1):
                    own = used == half - k
                    new = (longer[own][:, None] ^ masks[k]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(new.view(np.int64)), pa.array(np.repeat(x[own], len(masks[k])).view(np.int64))], ["prefix", "fp"])

    return rows.mapInArrow(run, "prefix long, fp long")


def joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of n nodes reaches over the pairs."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = np.minimum(new, new[new])
        if np.array_equal(new, label):
            return label
        label = new


def meetings(x: np.ndarray, left: np.ndarray, low: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indices that have a variant in common; x: sorted fingerprints, left: the flips that each has on ``low`` bits."""
    masks = {k: flips(low, k) for k in set(left.tolist())}
    if sum(int((left == k).sum()) * len(m) for k, m in masks.items()) > AT_ONCE and low:
        found = []
        for bit in (0, 1):  # the variants that have this bit next
            rest = left - ((x >> np.uint64(low - 1)) & np.uint64(1) != bit)
            some = np.flatnonzero(rest >= 0)
            if len(some) > 1:
                a, b = meetings(x[some], rest[some], low - 1, radius)
                found.append((some[a], some[b]))
        return tuple(np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1))
    room = np.uint64(max(1, int(len(x) - 1).bit_length()))
    keep = np.uint64((1 << low) - 1) if low < 64 else np.uint64(2**64 - 1)
    keys = []
    for k, m in masks.items():
        own = np.flatnonzero(left == k)
        mixed = (((x[own] & keep)[:, None] ^ m) * MIX) >> room << room
        keys.append((mixed | own.astype(np.uint64)[:, None]).ravel())
    keys = np.sort(np.concatenate(keys))
    variant, owner = keys >> room, (keys & ((np.uint64(1) << room) - np.uint64(1))).astype(np.int64)
    again = np.concatenate([[False], variant[1:] == variant[:-1]])
    start = np.maximum.accumulate(np.where(again, 0, np.arange(len(keys))))
    at = np.flatnonzero(again)
    a, b = owner[at], owner[start[at]]
    near = np.bitwise_count(x[a] ^ x[b]) <= radius
    other = [(a[near & (a != b)], b[near & (a != b)])]
    for g in np.unique(start[at[~near]]).tolist():  # different variants of one mix
        who = np.unique(owner[g : g + int(np.searchsorted(start[g:], g, "right"))])
        i, j = np.nonzero(np.triu(np.bitwise_count(x[who][:, None] ^ x[who]) <= radius, 1))
        other.append((who[i], who[j]))
    both = np.unique(np.concatenate([a * len(x) + b for a, b in other]))
    return both // len(x), both % len(x)


def links(bits: int, radius: int):
    half = (radius + 1) // 2

    def run(key, rows):
        x = np.unique(rows.column("fp").to_numpy().view(np.uint64))
        left = half - np.bitwise_count(top(x, bits) ^ np.array(key[0].as_py(), np.int64).view(np.uint64)).astype(np.int64)
        a, b = meetings(x, left, 64 - bits, radius) if len(x) > 1 else (np.zeros(0, np.int64),) * 2
        root = joined(len(x), a, b)
        out = np.flatnonzero(root != np.arange(len(x)))
        return pa.table({"a": pa.array(x[out].view(np.int64)), "b": pa.array(x[root[out]].view(np.int64))})

    return run


def near_fingerprints(nodes: DataFrame, number: int, radius: int) -> DataFrame:
    """a, b: rows whose components are those of all pairs of fingerprints (fp, each once) within the radius."""
    half, bits = (radius + 1) // 2, LEAST_BITS
    while bits < 63 and number * len(flips(bits, half)) > MEAN_ROWS << bits:
        bits += 1
    rows = extended(nodes.select(F.lit(0).cast("long").alias("prefix"), "fp"), 0, bits, half)
    out = None
    while True:
        crowded = stored(rows.groupBy("prefix").count().where(F.col("count") > MOST_ROWS).select("prefix"), "crowded")
        more = min(DEEPER, 64 - bits) if not crowded.isEmpty() else 0
        light = rows.join(crowded, "prefix", "left_anti") if more else rows
        found = light.groupBy("prefix").applyInArrow(links(bits, radius), "a long, b long")
        out = found if out is None else out.unionByName(found)
        if not more:
            return out
        rows = stored(extended(rows.join(crowded, "prefix", "left_semi"), bits, more, half), "longer")
        bits += more


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (smallest id that it reaches)."""
    if not 0 <= radius <= 8:
        raise ValueError("a radius of 0 to 8 bits")
    ship(docs.sparkSession)
    each = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = stored(each.groupBy("fp").agg(F.count("*").alias("n"), F.min("id_").alias("id_")), "nodes")
    found = connected_components(near_fingerprints(nodes, nodes.count(), radius))
    known = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    lowest = known.groupBy("component").agg(F.min("id_").alias("component_id"))
    known = stored(known.select("fp", "n", "component").join(lowest, "component").drop("component"), "components")
    out = join_counted(each, known, "fp")
    return out.select(F.col("id_").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
