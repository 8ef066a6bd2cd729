"""Toxicity by a factorization machine over hashed terms.

A text's terms are its different words and their beginnings of some lengths, hashed to ``BUCKETS``. The machine's score
is the logistic of a bias, a weight for each term, and for each pair of terms the inner product of their factors, so
that terms which mean something only together (an insult and the mention of a group) count as a pair.

It is fitted on at most ``rows`` labelled documents, those with the smallest hashes of their ids, of the part that isn't
held out. From these, the ``TERMS`` buckets that tell most about the label (by the likelihood-ratio statistic of the
two-by-two table) are kept; only they have weights. Scoring covers every document and its whole text.

Null texts are empty; a text without known terms gets the bias's score. Labels of a document that differ count as the
greatest; null labels and labels of unknown documents are ignored. Without labels of both kinds every score is next to 1
if all are toxic, else next to 0. Repeated rows get their scores repeatedly. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import folded_words, null_to_empty, ship, small_batches

BUCKETS, TERMS, FACTORS = 1 << 18, 4096, 4
#: Lengths, in bytes, of the beginnings of words that are terms.
BEGINNINGS = (4, 6, 8)
REMEMBERED = 400_000


def buckets_of(word: bytes) -> tuple[int, ...]:
    cut = [word[:k] + b"*" for k in BEGINNINGS if len(word) > k]
    return tuple(xxhash.xxh3_64_intdigest(w) % BUCKETS for w in (word, *cut))


class Terms(dict):
    """Buckets of words, or places of their kept buckets; remembers a bounded number of words."""

    def __init__(self, kept: np.ndarray | None = None):
        super().__init__()
        self.place = None if kept is None else dict(zip(kept.tolist(), range(len(kept))))

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > REMEMBERED:
            self.clear()
        found = buckets_of(word)
        if self.place is not None:
            found = tuple(self.place[b] for b in found if b in self.place)
        self[word] = found
        return found

    def of(self, text: str) -> list[int]:
        return sorted(set().union(*map(self.__getitem__, set(folded_words(text)))))


class Machine:
    """score = logistic(bias + sum w_i + sum over pairs of <v_i, v_j>), over the places of a text's kept terms."""

    def __init__(self, kept: np.ndarray, bias: float):
        self.kept, self.bias = kept, bias
        self.w = np.zeros(len(kept))
        self.v = np.random.default_rng(7).normal(0, 0.05, (len(kept), FACTORS))

    def raw(self, rows: list) -> tuple[np.ndarray, np.ndarray]:
        """Score before the logistic of each row of places, and the sums of its factors."""
        n = np.array([len(r) for r in rows], np.int64)
        flat = np.fromiter((x for r in rows for x in r), np.int64, int(n.sum()))
        own = np.repeat(np.arange(len(rows)), n)
        sums = np.zeros((len(rows), FACTORS))
        np.add.at(sums, own, self.v[flat])
        squares = np.bincount(own, (self.v[flat] ** 2).sum(1), len(rows))
        return self.bias + np.bincount(own, self.w[flat], len(rows)) + 0.5 * ((sums**2).sum(1) - squares), sums

    def score(self, rows: list) -> np.ndarray:
        return logistic(self.raw(rows)[0])

    def fit(self, rows: list, label: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.02, keep: float = 1e-4) -> None:
        """Adam on the mean logistic loss, with a squared penalty."""
        rng = np.random.default_rng(11)
        size = len(self.w) * (1 + FACTORS) + 1
        first, second, t = np.zeros(size), np.zeros(size), 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), batch):
                some = order[at : at + batch]
                x = [rows[i] for i in some]
                raw, sums = self.raw(x)
                g = (logistic(raw) - label[some]) / len(some)
                n = np.array([len(r) for r in x], np.int64)
                flat = np.fromiter((p for r in x for p in r), np.int64, int(n.sum()))
                own = np.repeat(np.arange(len(x)), n)
                gw, gv = keep * self.w, keep * self.v
                np.add.at(gw, flat, g[own])
                np.add.at(gv, flat, g[own, None] * (sums[own] - self.v[flat]))
                grad = np.concatenate([gw, gv.ravel(), [g.sum()]])
                t += 1
                first += 0.1 * (grad - first)
                second += 0.001 * (grad**2 - second)
                step = rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
                self.w -= step[: len(self.w)]
                self.v -= step[len(self.w) : -1].reshape(self.v.shape)
                self.bias -= step[-1]


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def informative(n1: np.ndarray, n0: np.ndarray, total1: int, total0: int) -> np.ndarray:
    """Likelihood-ratio statistic of each bucket's documents of either label against all."""
    out = np.zeros(len(n1))
    n = total1 + total0
    for a, row, column in ((n1, n1 + n0, total1), (n0, n1 + n0, total0), (total1 - n1, n - n1 - n0, total1), (total0 - n0, n - n1 - n0, total0)):
        out += np.where(a > 0, a * np.log(np.maximum(a, 1) * n / np.maximum(row * column, 1)), 0)
    return 2 * out


def held_out(id_col: str):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """text_, label of at most so many labelled documents; their ids and labels are sent to all tasks. Of several documents
    of one id the first text counts, so that the number of rows is bounded, too."""
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("known_")).agg(F.max(F.col(label_col)).cast("int").alias("label"))
    known = known.orderBy(F.xxhash64(F.col("known_").cast("string")), "known_").limit(rows)
    texts = docs.select(F.col(id_col).alias("id_"), null_to_empty(text_col).alias("text_"))
    return texts.join(F.broadcast(known), F.col("id_") == F.col("known_")).groupBy("known_").agg(F.min("text_").alias("text_"), F.first("label").alias("label")).select("text_", "label")


def fit_machine(sample: DataFrame) -> Machine:
    def count(batches):
        n, totals, terms = np.zeros((2, BUCKETS), np.int64), np.zeros(2, np.int64), Terms()
        for b in small_batches(batches, "text_", 4_000_000):
            for t, y in zip(b.column("text_").to_pylist(), b.column("label").to_pylist()):
                n[int(y > 0), terms.of(t)] += 1
                totals[int(y > 0)] += 1
        at = np.flatnonzero(n.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[0, at], totals[0])), pa.array(np.append(n[1, at], totals[1]))], ["bucket", "n0", "n1"])

    # no more rows than buckets
    counts = sample.mapInArrow(count, "bucket long, n0 long, n1 long").groupBy("bucket").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow().to_pydict()
    table = dict(zip(counts["bucket"], zip(counts["n0"], counts["n1"])))
    total0, total1 = table.pop(-1, (0, 0))
    share = total1 / max(1, total0 + total1)
    if not (total0 and total1):
        return Machine(np.zeros(0, np.int64), 40.0 if share else -40.0)
    bucket, n = np.array(list(table), np.int64), np.array(list(table.values()), np.int64).reshape(-1, 2)
    tells = informative(n[:, 1], n[:, 0], total1, total0)
    kept = np.sort(bucket[np.lexsort((bucket, -tells))[:TERMS]])

    def places(batches):
        terms = Terms(kept)
        for b in small_batches(batches, "text_", 4_000_000):
            found = [terms.of(t) for t in b.column("text_").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), b.column("label"), pa.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 for t in b.column("text_").to_pylist()])], ["places", "label", "text_hash"])

    # a bounded number of documents, with their kept terms; the order makes the fit the same each time
    got = sample.mapInArrow(places, "places array<int>, label int, text_hash long").orderBy("text_hash", "label").toArrow()
    machine = Machine(kept, float(np.log(share / (1 - share))))
    machine.fit(got.column("places").to_pylist(), (got.column("label").to_numpy() > 0).astype(float))
    return machine


def toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted (1 if the score reaches the threshold)."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(fit_machine(labelled_sample(docs, labels, rows, id_col, text_col, label_col)))

    def run(batches):
        machine = sent.value
        terms = Terms(machine.kept)
        for b in small_batches(batches, "text_", 4_000_000):
            found = machine.score([terms.of(t) for t in b.column("text_").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("id_"), pa.array(found)], ["id_", "score"])

    texts = docs.select(F.col(id_col).alias("id_"), null_to_empty(text_col).alias("text_"))
    out = texts.mapInArrow(run, f"id_ {docs.schema[id_col].dataType.simpleString()}, score double")
    return out.select(F.col("id_").alias(id_col), held_out("id_").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
