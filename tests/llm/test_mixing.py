import random
from fractions import Fraction
from itertools import islice

import pytest

from aerolith.llm import mixing as m


def simulate(sizes, weights, block_docs, period):
    """Slot by slot, with windows recomputed from the definition."""
    left, slot, out, done = {s: -(-n // block_docs) for s, n in sizes.items()}, 0, [], dict.fromkeys(sizes, 0)
    left = {s: n for s, n in left.items() if n}
    while left:
        share, had, t = m.shares({s: weights[s] for s in left}, period), dict.fromkeys(left, 0), 0
        while all(had[s] < left[s] for s in left):
            ready = [(-(-(had[s] + 1) * period // share[s]), s) for s in left if had[s] * period // share[s] <= t]
            due, s = min(ready)
            assert t < due
            out.append((s, done[s] + had[s]))
            had[s], t = had[s] + 1, t + 1
            for x in left:
                assert abs(had[x] - t * share[x] / period) < 1
        for s in list(left):
            done[s] += had[s]
            left[s] -= had[s]
            if not left[s]:
                del left[s]
        slot += t
    return out


def test_shares_are_whole_and_close():
    got = m.shares({"a": 5, "b": 3, "c": 0}, 64)
    assert sum(got.values()) == 64 and got["c"] == 1 and abs(got["a"] - 40) <= 2
    with pytest.raises(ValueError):
        m.shares(dict.fromkeys(range(9), 1), 8)


@pytest.mark.parametrize("seed", range(4))
def test_like_slot_by_slot(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([1, 5, 40, 333]) for s in ("a", "b", "c", None)} | {"hot": 1500}
    rows = [(i, s, "clash") for i, s in enumerate(x for s, n in sizes.items() for x in [s] * n)]
    weights = None if seed == 0 else {s: rng.randint(1, 9) for s in ("a", "hot", None)}
    got = m.mix(spark.createDataFrame(rows, "doc_id long, source string, slot string"), weights=weights, block_docs=8, period=32, group_rows=100).collect()
    assert sorted(r.position for r in got) == list(range(len(rows))) and {r.row.doc_id for r in got} == set(range(len(rows)))
    key = {s: "null" if s is None else f"={s}" for s in sizes}
    w = {key[s]: n**0.5 if weights is None else weights.get(s, 0) for s, n in sizes.items()}
    want = simulate({key[s]: n for s, n in sizes.items()}, w, 8, 32)
    placed = {}
    for r in sorted(got, key=lambda r: r.position):
        placed.setdefault(r.slot, set()).add((key[r.source], r.block))
    assert [placed[t] for t in range(len(want))] == [{x} for x in want]
    assert [r.slot for r in sorted(got, key=lambda r: r.position)] == sorted(r.slot for r in got)


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(1, "a")] * 20 + [(None, "a"), (None, None)]
    got = m.mix(spark.createDataFrame(rows, "doc_id long, source string"), block_docs=4, period=16).collect()
    assert sorted(r.position for r in got) == list(range(22))
    assert m.mix(spark.createDataFrame([], "doc_id long, source string")).count() == 0


@pytest.mark.parametrize("weights", [{"a": 0.9, "b": 0.1}, {"a": 1 - 1e-3 - 1e-6, "b": 1e-3, "c": 1e-6}, {f"s{k}": k + 1 for k in range(30)}])
def test_bound_holds_against_the_target_weights(weights):
    total = sum(map(Fraction, weights.values()))
    w, had = {s: Fraction(x) / total for s, x in weights.items()}, dict.fromkeys(weights, 0)
    for s, block, slot, position in islice(m.schedule(dict.fromkeys(weights, 10**7), weights, 16), 20_000):
        assert (block, position) == (had[s], 16 * slot)
        had[s] += 1
        assert abs(had[s] - (slot + 1) * w[s]) < 1
        if slot % 97 == 0:
            assert all(abs(had[x] - (slot + 1) * w[x]) < 1 for x in w)


def test_more_sources_than_slots_in_a_period(spark):
    rows = [(i, f"s{i % 1100}") for i in range(2300)]
    for weights in (None, {"s1": 1}):
        got = m.mix(spark.createDataFrame(rows, "doc_id long, source string"), weights=weights, block_docs=1).collect()
        assert sorted(r.position for r in got) == list(range(2300)) and {r.row.doc_id for r in got} == set(range(2300))


def one_run(sizes, weights, block_docs, period):
    """Every phase in one run from its first slot, ended when a source has no block left."""
    left = {s: -(-n // block_docs) for s, n in sizes.items() if n}
    weights, done, slot, position, out = m.whole({s: weights[s] for s in left}), dict.fromkeys(left, 0), 0, 0, []
    while left:
        phase = m.Phase(*m.parts({s: weights[s] for s in left}, max(period, len(left))), dict(done), slot, position)
        had = dict.fromkeys(left, 0)
        for t, s, k in phase.run(0, had):
            out.append((s, done[s] + k, slot + t, position))
            position += min(block_docs, sizes[s] - (done[s] + k) * block_docs)
            if had[s] == left[s]:
                break
        slot += t + 1
        done = {s: n + had.get(s, 0) for s, n in done.items()}
        left = {s: n - had[s] for s, n in left.items() if n > had[s]}
    return out


@pytest.mark.parametrize("seed", range(60))
def test_stretches_are_one_run(seed):
    rng = random.Random(seed)
    sources = [f"s{k}" for k in range(rng.choice([1, 2, 3, 5, 9, 30]))]
    sizes = {s: rng.choice([0, 1, 7, 60, 400]) for s in sources}
    kind = rng.choice(["root", "whole", "float", "skewed", "equal"])
    weights = {s: {"root": sizes[s] ** 0.5, "whole": rng.randint(0, 9), "float": rng.random(), "skewed": 10.0 ** -rng.randint(0, 4), "equal": 1}[kind] for s in sources}
    block, period = rng.choice([1, 3]), rng.choice([32, 1024])
    want = one_run(sizes, weights, block, period)
    phases = m.phases_of(sizes, weights, block, period)
    assert list(m.schedule(sizes, weights, block, period)) == want
    for step in (1, 2, 7, 50):
        got = [x for p in phases for t in range(0, p.slots, step) for x in m.slots_between(p, t, min(t + step, p.slots), block)]
        assert got == want


def test_a_table_of_many_stretches(spark):
    sizes, weights = {"a": 3000, "b": 900, "c": 41}, {"a": 0.7, "b": 0.2, "c": 0.1}
    cuts = m.stretches(m.phases_of(sizes, weights, 1), 100)
    assert len(cuts) > 20 and sum(b - a for _, a, b in cuts) == sum(sizes.values())
    got = m.blocks_of(spark, sizes, weights, 1, m.PERIOD, 100)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == one_run(sizes, weights, 1, m.PERIOD)
