import hashlib
import math

import numpy as np
import pytest

from aerolith.llm import vector_codes as v


def plain(rows, parts=4, entries=256, rounds=4):
    """vec_id, code, error, label_error, hash: all entries compared, in Python's numbers."""
    kept = [(i, [math.floor(1024 * x) for x in e], lab) for i, e, lab in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = [[r[1][p * width : (p + 1) * width] for r in kept] for p in range(parts)]
    books = [[list(x) for x in c[:entries]] for c in cut]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            met = {}
            for x in cut[p]:
                met.setdefault(nearest(x, books[p])[1], []).append(x)
            for k, xs in met.items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    found = [[nearest(c[i], books[p]) for p, c in enumerate(cut)] for i in range(len(kept))]
    error = [sum(d for d, _ in f) for f in found]
    by_label = {}
    for r, e in zip(kept, error):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], "".join(f"{k:02x}" for _, k in f), e, by_label[r[2]], digest) for r, f, e in zip(kept, found, error)]


def got(spark, rows, schema="vec_id long, embedding array<float>, label int", **options):
    df = v.compress(spark.createDataFrame(rows, schema), **options)
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return [tuple(r) for r in df.collect()]


def order(rows):
    return sorted(rows, key=str)


def single(x):
    return [float(np.float32(a)) for a in x]


@pytest.mark.parametrize("seed", range(2))
def test_like_plain(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), single(rng.normal(0, 1 + i % 5, 8).round(1)), int(rng.integers(0, 3)) if i % 7 else None) for i in rng.permutation(400)]
    rows += [(900, None, 1), (901, [1.0, None] * 4, 1), (902, single([float("nan")] * 8), 1), (903, [float("inf")] + [0.0] * 7, 1), (None, single([0.5] * 8), 2)]
    rows += [rows[0]] * 3  # repeated rows
    assert order(got(spark, rows)) == order(plain(rows))


def test_ties_and_fewer_vectors_than_entries(spark):
    rows = [(i, [float(i % 3), 0.0, 0.0, 1.0], None) for i in range(40)]
    assert order(got(spark, rows)) == order(plain(rows))
    assert order(got(spark, rows, entries=2, rounds=1)) == order(plain(rows, entries=2, rounds=1))


def test_large_numbers_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, single(rng.normal(0, 1, 4) * 10.0 ** rng.integers(0, 5)), i % 2) for i in range(60)] + [(99, single([3e38, -3e38, 1e20, 0.1]), 0)]
    want = {r[0]: r for r in plain(rows, entries=16)}
    found = {r[0]: r for r in got(spark, rows, entries=16)}
    for i, r in found.items():
        assert (r[1], r[4]) == (want[i][1], want[i][4]) and r[2] == (want[i][2] if want[i][2] < 2**63 else None)


def test_annulus_finds_what_all_entries_give():
    rng = np.random.default_rng(3)
    entries = np.concatenate([rng.integers(-900, 900, (200, 16)), np.repeat(rng.integers(-5, 5, (1, 16)), 56, 0)])
    book = v.Codebook(entries.tolist())
    q = np.concatenate([rng.integers(-1000, 1000, (1500, 16)), entries[::3], np.zeros((2, 16), np.int64)])
    index, found = book.nearest(q)
    for x, i, d in zip(q, index, found):
        every = ((entries - x) ** 2).sum(1)
        assert d == every.min() and i == every.argmin()


def test_other_lengths_clashing_columns_and_no_rows(spark):
    rows = [(i, [1.0 * i, 0.0, 0.0, 2.0], 1, "x", 3) for i in range(5)] + [(8, [1.0], 1, "y", 4), (9, [], 1, "y", 4)]
    found = {r[0]: r for r in got(spark, rows, "vec_id long, embedding array<float>, label int, code string, n int")}
    assert found[8][1:4] == (None, None, 0) and found[9][1] is None and found[4][1] == "04" * 1 + found[4][1][2:]
    assert got(spark, []) == []
    with pytest.raises(ValueError):
        got(spark, [(1, [1.0, 2.0, 3.0], 1)])
