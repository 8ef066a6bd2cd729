"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are dealt into blocks of ``block_docs``; a slot takes one block. A source's weight w is its exact
share of all weights, a rational number (of a float, its exact value). Its block k (from 0) is released at slot
floor(k / w) and due at slot ceil((k + 1) / w). In every slot, earliest-deadline-first takes the released block that is
due first. As the weights sum to 1, every block keeps its window: after t slots a source has had t * w of them to within
less than one block, however many slots and sources there are. What the sources have had by any slot follows from the
windows about it (``Phase.had``), so tasks schedule stretches of slots apart from each other, with the result of one run,
and write the blocks to a table; documents are joined with it.

When a source runs out, a new phase begins: the others share the slots anew, in the proportion of their weights, and
keep the bound within the phase. No document is dropped or repeated. Inside a source, documents come in an order made
by hashing their ids (of rows without one, the rows).

Default weights are the square roots of the sources' sizes. Null is a source of its own. Rows of equal source and id
come in any order among themselves. Sources given no weight get one of ``period`` slots each (of as many as there are
sources, if these are more), the others share the rest. An empty table stays empty. All columns are kept.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, stored

PERIOD = 1024
#: A source's documents are numbered in so many groups, at least, so that no task numbers a whole source.
LEAST_GROUPS = 256
#: The table of blocks is written in batches of so many.
BATCH_BLOCKS = 100_000
#: Slots of a stretch at least (short phases have shorter ones), and the most tasks that share the stretches.
STRETCH_SLOTS, MOST_TASKS = 1 << 16, 10_000


def whole(weights: dict) -> dict:
    """Whole numbers in the exact proportion of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*(x.denominator for x in exact.values()))
    return {s: int(x * unit) for s, x in exact.items()}


def parts(weights: dict, period: int) -> tuple[dict, int]:
    """Each source's part of all slots, and the sum of the parts. weights: whole numbers; without one, 1 of the period."""
    total, none = sum(weights.values()), sum(not w for w in weights.values())
    if not total:
        return dict.fromkeys(weights, 1), len(weights)
    return {s: w * (period - none) or total for s, w in weights.items()}, total * period


def shares(weights: dict, period: int) -> dict:
    """Exact shares of the period in proportion to the weights; 1 for sources without a weight."""
    if len(weights) > period:
        raise ValueError(f"{len(weights)} sources need a period of as many slots at least")
    part, of = parts(whole(weights), period)
    return {s: Fraction(n * period, of) for s, n in part.items()}


class Phase:
    """Slots, counted from 0, in which no source runs out. part / of: exact shares; base: blocks each source had before;
    slots, once known: how many until the first source runs out."""

    def __init__(self, part: dict, of: int, base: dict, slot: int, position: int):
        self.part, self.of, self.base, self.slot, self.position, self.slots = part, of, base, slot, position, 0

    def release(self, s, k: int) -> int:
        return k * self.of // self.part[s]

    def due(self, s, k: int) -> int:
        return -(-(k + 1) * self.of // self.part[s])

    def run(self, start: int, had: dict, stop: int | None = None):
        """slot, source, block of earliest-deadline-first from a slot on. had: the blocks had by then; it is kept up to date.
        Slots in which nothing is released are left out."""
        waiting = [(self.release(s, k), self.due(s, k), s) for s, k in had.items()]
        heapq.heapify(waiting)
        ready: list = []  # deadline, source
        t = start
        while stop is None or t < stop:
            while waiting and waiting[0][0] <= t:
                heapq.heappush(ready, heapq.heappop(waiting)[1:])
            if ready:
                due, s = heapq.heappop(ready)
                if t >= due:
                    raise AssertionError("a block missed its deadline")
                k = had[s]
                had[s] = k + 1
                heapq.heappush(waiting, (self.release(s, k + 1), self.due(s, k + 1), s))
                yield t, s, k
            t += 1

    def had(self, t: int) -> dict:
        """Blocks that each source has had by slot t, without a run from the first slot.

        All blocks due by t have been had, and of the open ones (released, due later; one a source at most) as many as slots
        are left over, those of the earliest deadlines for which there are slots between their release and t. An open block
        competes for these with blocks released no earlier than the first open one, so a run from there tells which:
        it is no longer than one window of the smallest share."""
        low = {s: t * p // self.of for s, p in self.part.items()}
        open_ = {s: self.release(s, k) for s, k in low.items() if t * self.part[s] % self.of}
        if not open_:
            return low
        first = min(open_.values())
        had = {s: -(-first * p // self.of) for s, p in self.part.items()}
        for _ in self.run(first, had, t):
            pass
        fit = sorted((self.due(s, low[s]), s) for s in open_ if had[s] > low[s])
        return low | {s: low[s] + 1 for _, s in fit[: t - sum(low.values())]}


def phases_of(sizes: dict, weights: dict, block_docs: int, period: int = PERIOD) -> list[Phase]:
    """One phase for each source at most. What is run is no longer than two windows of the smallest share a phase."""
    left = {s: -(-n // block_docs) for s, n in sizes.items() if n}
    weights, period = whole({s: weights[s] for s in left}), max(period, len(left))
    done, slot, position, out = dict.fromkeys(left, 0), 0, 0, []
    while left:
        phase = Phase(*parts({s: weights[s] for s in left}, period), {s: done[s] for s in left}, slot, position)
        # no source runs out before its last block is released
        start = min(phase.release(s, n - 1) for s, n in left.items())
        had = phase.had(start)
        for t, s, k in phase.run(start, had):
            if k + 1 == left[s]:
                break
        phase.slots = t + 1
        out.append(phase)
        slot += phase.slots
        # all blocks are full but the last one of a source, which ends a phase
        position += t * block_docs + min(block_docs, sizes[s] - (done[s] + k) * block_docs)
        done |= {x: done[x] + n for x, n in had.items()}
        left = {x: n - had[x] for x, n in left.items() if n > had[x]}
    return out


def stretches(phases: list[Phase], least: int = STRETCH_SLOTS) -> list[tuple[int, int, int]]:
    """Phase, first slot and end of stretches of at least ``least`` slots and four windows of the smallest share, if the
    phase has so many: to begin one costs a run of one window, so all of them cost a quarter more than one run."""
    out = []
    for i, p in enumerate(phases):
        step = max(least, 4 * -(-p.of // min(p.part.values())))
        out += [(i, t, min(t + step, p.slots)) for t in range(0, p.slots, step)]
    return out


def slots_between(phase: Phase, start: int, stop: int, block_docs: int):
    """Source, block (in its source), slot and first position of the blocks of a stretch."""
    for t, s, k in phase.run(start, phase.had(start), stop):
        yield s, phase.base[s] + k, phase.slot + t, phase.position + t * block_docs


def schedule(sizes: dict, weights: dict, block_docs: int, period: int = PERIOD):
    """Source, block (in its source), slot and first position of all blocks, slot by slot."""
    for phase in phases_of(sizes, weights, block_docs, period):
        yield from slots_between(phase, 0, phase.slots, block_docs)


def blocks_of(spark, sizes: dict, weights: dict, block_docs: int, period: int, stretch: int = STRETCH_SLOTS) -> DataFrame:
    """key_, block, slot, first (position) of all blocks: tasks take stretches of slots, none waits for another."""
    ship(spark)
    phases = phases_of(sizes, weights, block_docs, period)
    cuts = stretches(phases, stretch)
    sent = spark.sparkContext.broadcast((phases, cuts))  # a number for each source of each phase, three for a stretch

    def run(batches):
        phases, cuts = sent.value
        for b in batches:
            for n in b.column("id").to_pylist():
                i, start, stop = cuts[n]
                rows = slots_between(phases[i], start, stop, block_docs)
                while batch := list(islice(rows, BATCH_BLOCKS)):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*batch), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["key_", "block_", "slot", "first"])

    tasks = max(1, min(len(cuts), MOST_TASKS, sum(p.slots for p in phases) // stretch))
    return stored(spark.range(0, len(cuts), 1, tasks).mapInArrow(run, "key_ string, block_ long, slot long, first long"), "blocks")


def mix(docs: DataFrame, *, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source", block_docs: int = 16, period: int = PERIOD, group_rows: int = 20_000) -> DataFrame:
    """All columns of the documents in ``row``, and source, block (in its source), slot, position (in the mix, from 0)."""
    spark = docs.sparkSession
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("null"))
    sizes = {r.key: r["count"] for r in docs.groupBy(key.alias("key")).count().collect()}  # a row for each source
    wanted = None if weights is None else {"null" if s is None else f"={s}": w for s, w in weights.items()}
    weight = {s: math.sqrt(n) if wanted is None else wanted.get(s, 0) for s, n in sizes.items()}
    placed = blocks_of(spark, sizes, weight, block_docs, period)

    buckets = max(LEAST_GROUPS, sum(sizes.values()) // group_rows)
    # rows without an id go by the whole row, so that they aren't one bucket
    row = F.xxhash64(*(F.col(f.name) for f in docs.schema.fields if isinstance(f.dataType, T.AtomicType)))
    order = F.when(F.col(id_col).isNotNull(), F.xxhash64(F.col(id_col).cast("string"))).otherwise(row)
    rows = docs.select(F.struct("*").alias("row"), key.alias("key"), order.alias("h"), F.col(id_col).alias("id"))
    rows = rows.withColumn("bucket", F.pmod(F.shiftright("h", 20), F.lit(buckets)))
    counts = docs.select(key.alias("key"), order.alias("h")).groupBy("key", F.pmod(F.shiftright("h", 20), F.lit(buckets)).alias("bucket")).count()
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("key", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    number = F.row_number().over(Window.partitionBy("key", "bucket").orderBy("h", "id"))
    rows = rows.withColumn("number", number).join(counts, ["key", "bucket"]).withColumn("at", F.col("before") + F.col("number") - 1)
    rows = rows.withColumn("block", F.floor(F.col("at") / block_docs))
    rows = rows.join(placed, (F.col("key") == F.col("key_")) & (F.col("block") == F.col("block_")))
    return rows.select("row", F.col(f"row.{source_col}").alias("source"), "block", "slot", (F.col("first") + F.col("at") % block_docs).alias("position"))
