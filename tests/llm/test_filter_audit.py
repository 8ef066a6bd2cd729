import math
import random
from itertools import permutations

import numpy as np
import pytest

from aerolith.llm import filter_audit as f

LABELS = "doc_id long, quality int, toxic int"


def plain(rows, labels):
    """All orders by walking through every document, one after the other."""
    docs = [(i, t or "", p or "") for i, t, p in rows]
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    marks = {c: {r[0] for r in labels if r[k] == 1 and r[0] is not None} for k, c in ((1, "good"), (2, "toxic"))}
    seen = []
    for i, t, p in docs:
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", t) if w]
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t],
        }
        seen.append((p, fails, i in marks["good"], i in marks["toxic"]))
    out, worth = {}, {}
    for p in {s[0] for s in seen}:
        own = [s for s in seen if s[0] == p]
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [s for s in left if s[1][x]]
                early = sum(s[1][x] for s in own) - len(gone)
                left = [s for s in left if not s[1][x]]
                only = sum(s[1][x] and sum(s[1].values()) == 1 for s in own)
                out[p, "".join(order), step] = len(left), len(gone), early, only, sum(s[2] for s in gone), sum(s[3] for s in gone)
                worth[p, x] = worth.get((p, x), 0) + len(gone)
    return {(p, o, k): (*v, worth[p, o[k - 1]]) for (p, o, k), v in out.items()}


def got(spark, rows, labels, schema="doc_id long, text string, source string"):
    found = f.audit(spark.createDataFrame(rows, schema), spark.createDataFrame(labels, LABELS)).collect()
    assert len({tuple(r)[:3] for r in found}) == len(found)
    return {tuple(r)[:3]: tuple(r)[3:] for r in found}


def texts(rng):
    words = [f"wört{k}" for k in range(80)]
    return [" ".join(rng.choices(words, k=n)) + tail for n in (3, 60, 90, 200) for tail in ("", " #", " ABCDEFGHIJKLMNOPQRSTUVWXYZ" * 3, "\x0b\x1c\n")] + ["", None, "x " * 40_000]


@pytest.mark.parametrize("held", [0, 1_000, 10**9])
def test_like_plain(spark, monkeypatch, held):
    monkeypatch.setattr(f, "HELD_BYTES", held)  # chains cut after every row, sometimes, never
    rng = random.Random(held)
    some = texts(rng)
    rows = [(rng.choice([None, *range(120)]), rng.choice(some), rng.choice(["a", "b", None, ""])) for _ in range(300)] + [(500 + k, some[5], "hot") for k in range(200)]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(0, 700, 3)] + [(3, 1, 0), (3, 0, 1), (None, 1, 1)]
    assert got(spark, rows, labels) == plain(rows, labels)


def test_texts_of_one_hash_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(f.xxhash, "xxh64_intdigest", lambda b: 7)
    rows = [(i, f"text {i % 3}", "a") for i in range(12)]
    beaten = sorted(r[0] for r in f.settle(sorted(f.route(rows), key=lambda kv: kv[0])) if r[2] & f.E_BIT)
    assert beaten == list(range(3, 12))


def test_copies_leave_a_task_once():
    out = list(f.route([(9 - i % 10, "copy", "a") for i in range(1_000)]))
    assert [v[:2] for _, v in out if v[0]] == [("copy", 0)] and sum(sum(v[2].values()) for _, v in out) == 1_000


def test_repeated_rows_clashing_columns_and_no_rows(spark):
    rows = [(1, "same", "a", "x", 5), (1, "same", "a", "x", 5), (2, "same", "a", "y", 6)]
    found = got(spark, rows, [], "doc_id long, text string, source string, part string, mask int")
    assert found["a", "EABCD", 1] == (2, 1, 0, 0, 0, 0, 1 * 120 - sum(found["a", o, o.index("E") + 1][2] for o in map("".join, permutations("ABCDE"))))
    assert got(spark, [], []) == {}


def test_worth_is_what_all_orders_remove():
    v = np.random.default_rng(1).integers(0, 50, 128)
    rows = list(f.orders("p", v))
    for x in "ABCDE":
        assert {r[9] for r in rows if r[1][r[2] - 1] == x} == {sum(r[4] for r in rows if r[1][r[2] - 1] == x)}
    assert len(rows) == 5 * math.factorial(5)
