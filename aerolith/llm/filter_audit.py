"""Filter interaction audit: what each of five document filters removes, alone and in every order with the others.

Filters over whole texts (null is empty; words are maximal runs of anything but ASCII white space, case counts):
A fewer than 50 words; B fewer than 65 % different words; C over 5 % capitals A-Z; D any of ``#$%&*|``; E the text is
that of a smaller id anywhere in the table.

1. A fingerprint-routed RDD answers E. Rows are dealt by the xxhash of their text; equal hashes form a chain whose entries
   hold the full text and the smallest id seen, so that texts of one hash are told apart. An id that isn't the smallest
   of its text is emitted as such. Before the shuffle each task runs the same chains over its own rows, cut at
   ``HELD_BYTES``: a text that a third of all rows repeat leaves a task once, with its smallest id. After it, rows come
   sorted by hash (on disk, if there are many), so that a task holds one chain at a time.
2. Labels are joined by id, with rows of one id, part and mask already counted.
3. ``combineByKey`` merges vectors of 128 counts (5 filters, good, toxic) by part. From them follow all orders and steps.

A null id is neither smaller nor larger than another: its row never fails E, nor makes another fail. Repeated rows (one id
and text) all hold the smallest id and stay. A null part is '', a null id has no label. Of several labels of one id, any 1 counts. An empty table
gives no rows. Other columns, whatever their names, aren't read.
"""

from __future__ import annotations

import math
from itertools import groupby, permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import null_to_empty, ship

FILTERS = "ABCDE"
E_BIT, GOOD, TOXIC = 16, 32, 64
#: A task's chains before the shuffle are sent on when their texts have so many bytes.
HELD_BYTES = 32_000_000
#: Texts are dealt to so many partitions that one has about so many bytes of them at most.
PART_BYTES = 64_000_000
CAPITALS = bytes(range(65, 91))
SYMBOLS = b"#$%&*|"


def mask_of(text: str) -> int:
    """Bits 1, 2, 4, 8 of the filters A to D that a text fails."""
    b = text.encode("utf-8", "surrogatepass")
    words = b.split()
    capitals = len(b) - len(b.translate(None, CAPITALS))
    return (
        (len(words) < 50)
        | (100 * len(set(words)) < 65 * len(words)) << 1
        | (100 * capitals > 5 * len(text)) << 2
        | (len(b.translate(None, SYMBOLS)) < len(b)) << 3
    )


class Chains:
    """Entries [text, smallest id, rows of that id by (part, mask)] by the text's hash."""

    def __init__(self):
        self.by_hash: dict[int, list] = {}
        self.held = 0

    def add(self, h: int, text: str, id_, rows: dict):
        """Takes rows of a text and id; gives those (id, rows) that turn out not to be the smallest."""
        chain = self.by_hash.setdefault(h, [])
        entry = next((e for e in chain if e[0] == text), None)
        if entry is None:
            chain.append([text, id_, dict(rows)])
            self.held += len(text)
        elif id_ < entry[1]:
            out, entry[1:] = (entry[1], entry[2]), [id_, dict(rows)]
            return out
        elif id_ > entry[1]:
            return id_, rows
        else:
            for k, n in rows.items():
                entry[2][k] = entry[2].get(k, 0) + n
        return None

    def drain(self):
        for h, chain in self.by_hash.items():
            for text, id_, rows in chain:
                yield h, text, id_, rows
        self.by_hash, self.held = {}, 0


def route(rows):
    """Before the shuffle: (hash, (text, id, rows)); a settled row has no text but a verdict in its mask."""
    chains = Chains()
    for id_, text, part in rows:
        key, h = (part, mask_of(text)), xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
        if id_ is None:
            yield h, (None, None, {key: 1})
            continue
        beaten = chains.add(h, text, id_, {key: 1})
        if beaten:
            yield xxhash.xxh64_intdigest(str(beaten[0])), (None, beaten[0], failed(beaten[1]))
        if chains.held > HELD_BYTES:
            yield from ((h, (text, i, r)) for h, text, i, r in chains.drain())
    yield from ((h, (text, i, r)) for h, text, i, r in chains.drain())


def failed(rows: dict) -> dict:
    return {(part, mask | E_BIT): n for (part, mask), n in rows.items()}


def settle(routed):
    """After it: (id, part, mask, rows), E included, one hash at a time."""
    for _, group in groupby(routed, key=lambda kv: kv[0]):
        chains = Chains()
        for h, (text, id_, rows) in group:
            out = (id_, rows) if text is None else chains.add(h, text, id_, rows)
            if out:
                verdict = out[1] if text is None else failed(out[1])
                yield from ((out[0], part, mask, n) for (part, mask), n in verdict.items())
        yield from ((id_, part, mask, n) for _, _, id_, rows in chains.drain() for (part, mask), n in rows.items())


def masks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """id, part, mask (bits of the filters that are failed, E included), n (rows)."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id_"), null_to_empty(text_col).alias("text_"), null_to_empty(part_col).alias("part_"))
    size = rows.agg(F.sum(F.octet_length("text_"))).first()[0] or 0  # an RDD isn't dealt anew by what its shuffle turns out to hold
    parts = max(size // PART_BYTES, int(spark.conf.get("spark.sql.shuffle.partitions")))
    settled = rows.rdd.mapPartitions(route).repartitionAndSortWithinPartitions(parts, lambda h: h).mapPartitions(settle)
    return spark.createDataFrame(settled, f"id_ {docs.schema[id_col].dataType.simpleString()}, part string, mask int, n long", verifySchema=False)


def add_counts(v: np.ndarray, counted: tuple[int, int]) -> np.ndarray:
    v[counted[0]] += counted[1]
    return v


def orders(part: str, v: np.ndarray):
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    code = np.arange(128)
    mask, good, toxic = code & 31, (code & GOOD) > 0, (code & TOXIC) > 0
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    gone = {(s, f): (mask & s == 0) & (mask & bit[f] > 0) for f in FILTERS for s in range(32) if not s & bit[f]}
    removed = {k: int(v[m].sum()) for k, m in gone.items()}
    worth = {f: sum(math.factorial(n := s.bit_count()) * math.factorial(4 - n) * removed[s, f] for s in range(32) if not s & bit[f]) for f in FILTERS}
    for order in permutations(FILTERS):
        s = 0
        for step, f in enumerate(order, 1):
            here, fails = gone[s, f], int(v[mask & bit[f] > 0].sum())
            yield part, "".join(order), step, int(v[mask & (s | bit[f]) == 0].sum()), removed[s, f], fails - removed[s, f], int(v[mask == bit[f]].sum()), int(v[here & good].sum()), int(v[here & toxic].sum()), worth[f]
            s |= bit[f]


def audit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step."""
    spark = docs.sparkSession
    rows = masks(docs, id_col=id_col, text_col=text_col, part_col=part_col).groupBy("id_", "part", "mask").agg(F.sum("n").alias("n"))
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("int")
    marks = labels.groupBy(F.col(id_col).alias("id_")).agg((is_one("quality") * GOOD + is_one("toxic") * TOXIC).alias("marks"))
    coded = rows.join(marks, "id_", "left").select("part", (F.col("mask") + F.coalesce("marks", F.lit(0))).alias("code"), "n")
    vectors = coded.rdd.map(lambda r: (r[0], (r[1], r[2]))).combineByKey(lambda c: add_counts(np.zeros(128, np.int64), c), add_counts, np.add)
    columns = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return spark.createDataFrame(vectors.flatMap(lambda kv: orders(*kv)), columns, verifySchema=False)


def oracle_sql() -> str:
    bits = lambda x: " + ".join(f"(strpos({x}, '{f}') > 0)::INTEGER * {1 << i}" for i, f in enumerate(FILTERS))
    letters = "(VALUES ('A'), ('B'), ('C'), ('D'), ('E'))"
    return rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
 w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM d),
 m AS (SELECT doc_id, part, (len(words) < 50)::INTEGER + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INTEGER + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INTEGER
  + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER + 16 * coalesce(doc_id > first_id, false)::INTEGER AS mask FROM w),
 l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
 c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m LEFT JOIN l USING (doc_id) GROUP BY ALL),
 o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM {letters} a(x), {letters} b(x), {letters} c(x), {letters} d(x), {letters} e(x) WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
 s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, {bits("substr(filter_order, 1, step - 1)")} AS before, {bits("substr(filter_order, step, 1)")} AS own FROM o, range(1, 6) r(step)),
 r AS (SELECT part, filter_order, step::INTEGER AS step, letter, sum(CASE WHEN mask & (before | own) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & before > 0 AND mask & own > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & before = 0 AND mask & own > 0 THEN toxic ELSE 0 END) AS toxic_lost FROM c, s GROUP BY part, filter_order, step, letter)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
 (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM r"""
