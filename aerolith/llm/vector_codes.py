"""Vector code compression: product quantisation in whole numbers, nearest entries found by annular norm pruning.

A component x becomes floor(1024 * x); a vector is cut into 4 equal parts of consecutive components, each with a codebook
of up to 256 entries. The codebooks start as the parts of the vectors of the smallest ids. A round assigns every part to
its nearest entry, sums the parts of each entry (one partial sum a task, then by Spark) and replaces the entry by the
floors of the means. Only codebooks (4 x 256 entries) come to the driver, which sends them to the next round.

Annular norm pruning: entries are sorted by norm. By the triangle inequality an entry nearer than d to a vector q has a
norm from |q| - d to |q| + d. With d from the entries of similar norm, binary search gives this annulus of the entries;
exactly its entries, both ends included, are evaluated, so that the result equals the search over all entries. Vectors
are taken in the order of their norms, so that neighbours have much the same annulus and one product evaluates it.

Vectors that are null, or hold a null or non-finite component, are dropped. Equal distances take the lower entry. Of
vectors with equal ids the smaller (componentwise) comes first; null ids come last. With fewer vectors than entries, the
codebooks have as many entries as there are vectors. Vectors of another length than the first one's get no code (null) and
no error and train nothing; a length that can't be cut into equal parts is a ValueError. Errors beyond 63 bits are null,
and errors that are null don't count in a label's sum. Repeated rows are encoded each. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_counted, ship, stored

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Whole numbers up to this are multiplied as floats of 64 bits, exactly; larger ones as Python's numbers.
EXACT = 1 << 20
#: Vectors that share one product; entries near in norm that give the first distance.
GROUP, FIRST = 512, 32
LIMB = 1 << 60


def whole(values: np.ndarray) -> np.ndarray:
    """floor(1024 * x), exactly; of type object if any is larger than EXACT."""
    x = values.astype(np.float64)
    if not x.size or np.abs(x).max() < EXACT / SCALE - 1:
        return np.floor(x * SCALE).astype(np.int64)
    flat = [int(v) * SCALE if abs(v) > 2.0**53 else math.floor(v * SCALE) for v in x.ravel().tolist()]
    return np.array(flat, object).reshape(x.shape)


class Codebook:
    """Entries of one part, sorted by norm."""

    def __init__(self, entries: list[list[int]]):
        self.entries = np.array(entries, object)
        self.small = not self.entries.size or max(map(abs, self.entries.ravel().tolist())) <= EXACT
        if self.small:
            e = self.entries.astype(np.int64)
            square = (e * e).sum(1)
            self.order = np.argsort(square, kind="stable")
            self.sorted, self.square = e[self.order].astype(float), square[self.order].astype(float)
            self.norm = np.sqrt(self.square)

    def distances(self, q: np.ndarray, square: np.ndarray, a: int, b: int) -> np.ndarray:
        return square[:, None] + self.square[a:b] - 2.0 * (q @ self.sorted[a:b].T)

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each vector's nearest entry, and the squared distance."""
        if not self.small or vectors.dtype == object:
            return self.nearest_large(vectors.astype(object))
        index, found = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), np.int64)
        q = vectors.astype(float)
        square = (q * q).sum(1)
        norm = np.sqrt(square)
        for some in np.array_split(by_norm := np.argsort(norm), max(1, -(-len(by_norm) // GROUP))):
            if not len(some):
                continue
            v, s, r = q[some], square[some], norm[some]
            at = int(np.searchsorted(self.norm, r[len(r) // 2]))
            a = max(0, min(at - FIRST // 2, len(self.norm) - FIRST))
            d = np.sqrt(self.distances(v, s, a, a + FIRST).min(1))
            slack = 1e-9 * (r + d) + 1e-6
            low = np.searchsorted(self.norm, r - d - slack, "left")
            high = np.searchsorted(self.norm, r + d + slack, "right")
            a, b = int(low.min()), int(high.max())
            inside = (np.arange(a, b) >= low[:, None]) & (np.arange(a, b) < high[:, None])
            d = np.where(inside, self.distances(v, s, a, b), np.inf)
            best = d.min(1)
            index[some] = np.where(d == best[:, None], self.order[a:b], len(self.order)).min(1)
            found[some] = best.astype(np.int64)
        return index, found

    def nearest_large(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        index, found = np.zeros(len(vectors), np.int64), np.zeros(len(vectors), object)
        for i, v in enumerate(vectors):
            d = ((self.entries - v) ** 2).sum(1).tolist()
            found[i] = min(d)
            index[i] = d.index(found[i])
        return index, found


def usable(vector: str) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.col(vector).isNotNull() & F.coalesce(F.forall(vector, fine), F.lit(False))


def matrix(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the vectors of this length, and their whole numbers."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    at = np.flatnonzero(sizes == length)
    return at, whole(column.take(pa.array(at)).flatten().to_numpy().reshape(-1, length))


def first_books(vectors: DataFrame, parts: int, entries: int) -> list[list[list[int]]]:
    """Parts of the vectors of the smallest ids: ``entries`` rows come to the driver."""
    rows = vectors.orderBy(F.col("id_").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    rows = [r[0] for r in rows if len(r[0]) == len(rows[0][0])]
    if not rows:
        return []
    if not rows[0] or len(rows[0]) % parts:
        raise ValueError(f"vectors of {len(rows[0])} components can't be cut into {parts} equal parts")
    numbers, width = whole(np.array(rows)), len(rows[0]) // parts
    return [numbers[:, p * width : (p + 1) * width].tolist() for p in range(parts)]


def next_books(vectors: DataFrame, books: list) -> list[list[list[int]]]:
    """A round: means of the parts assigned to each entry."""
    parts, entries, width = len(books), len(books[0]), len(books[0][0])
    found = [Codebook(b) for b in books]

    def run(batches):
        sums, counts = np.zeros((parts, entries, width), object), np.zeros((parts, entries), np.int64)
        for b in batches:
            _, m = matrix(b.column(0), parts * width)
            for p in range(parts):
                v = m[:, p * width : (p + 1) * width]
                index, _ = found[p].nearest(v)
                part = np.zeros((entries, width), v.dtype)
                np.add.at(part, index, v)
                sums[p] += part
                counts[p] += np.bincount(index, minlength=entries)
        at = np.argwhere(np.repeat(counts[:, :, None] > 0, width, axis=2))
        value = sums[tuple(at.T)].tolist()
        high = pa.array([v // LIMB for v in value], pa.decimal128(38, 0))
        columns = [*(pa.array(at[:, i], pa.int32()) for i in range(3)), high, pa.array([v % LIMB for v in value], pa.int64()), pa.array(counts[at[:, 0], at[:, 1]], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "place", "high", "low", "n"])

    got = vectors.select("vector").mapInArrow(run, "part int, entry int, place int, high decimal(38,0), low long, n long")
    got = got.groupBy("part", "entry", "place").agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"), F.sum("n").alias("n"))
    out = [[list(e) for e in b] for b in books]
    for p, e, i, high, low, n in got.collect():  # components of the codebooks
        out[p][e][i] = (int(high) * LIMB + int(low)) // n
    return out


def codes(vectors: DataFrame, books: list) -> DataFrame:
    """id_, label_, code, error of every vector."""
    parts, width = len(books), len(books[0][0])
    found = [Codebook(b) for b in books]

    def run(batches):
        for b in batches:
            at, m = matrix(b.column("vector"), parts * width)
            got = [found[p].nearest(m[:, p * width : (p + 1) * width]) for p in range(parts)]
            total = sum(g[1].astype(object) for g in got)
            code, error = [None] * b.num_rows, [None] * b.num_rows
            for i, c, e in zip(at.tolist(), np.stack([g[0] for g in got], 1).astype(np.uint8), total):
                code[i], error[i] = c.tobytes().hex(), int(e) if e < 1 << 63 else None
            yield pa.RecordBatch.from_arrays([b.column("id_"), b.column("label_"), pa.array(code, pa.string()), pa.array(error, pa.int64())], ["id_", "label_", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}
    return vectors.mapInArrow(run, f"id_ {kinds['id_']}, label_ {kinds['label_']}, code string, error long")


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per vector: id, code, error, label_error (of all vectors of the label, null being one), codebooks_sha256."""
    if not 0 < entries <= 256:
        raise ValueError("a code has 8 bits a part")
    ship(vectors.sparkSession)
    rows = vectors.where(usable(vector_col)).select(F.col(id_col).alias("id_"), F.col(label_col).alias("label_"), F.col(vector_col).alias("vector"))
    books = first_books(rows, parts, entries)
    if not books:
        return rows.select(F.col("id_").alias(id_col), F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    for _ in range(rounds):
        books = next_books(rows, books)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = stored(codes(rows, books), "codes")
    # sums of 38 digits: no label's errors overflow on the way
    totals = stored(coded.groupBy("label_").agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"), F.count("*").alias("n")), "label_errors")
    out = join_counted(coded, totals, "label_")
    return out.select(F.col("id_").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle_sql() -> str:
    """Rounds over one row per vector, part and place. An unused entry keeps its numbers."""
    width = "(len(embedding) // 4)"
    out = [f"""WITH v AS (SELECT vec_id, embedding, label FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
 c AS MATERIALIZED (SELECT vec_id, ((i - 1) // {width})::INTEGER AS part, ((i - 1) % {width})::INTEGER AS place, floor(1024 * embedding[i]::DOUBLE)::BIGINT AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM v)),
 f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < 256),
 b0 AS MATERIALIZED (SELECT part, entry, place, x FROM c JOIN f USING (vec_id))"""]
    for k in range(5):
        out.append(f"""a{k} AS MATERIALIZED (SELECT vec_id, part, entry, d FROM (SELECT vec_id, c.part, entry, sum((c.x - b.x) * (c.x - b.x))::BIGINT AS d FROM c JOIN b{k} b ON c.part = b.part AND c.place = b.place GROUP BY ALL)
 QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY d, entry) = 1)""")
        if k < 4:
            out.append(f"""b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, b.place, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN (SELECT part, entry, place, ((sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS x FROM a{k} JOIN c USING (vec_id, part) GROUP BY ALL) m USING (part, entry, place))""")
    out.append("""e AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a4 GROUP BY vec_id)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) FROM b4) AS codebooks_sha256 FROM e JOIN v USING (vec_id)""")
    return ", ".join(out)
